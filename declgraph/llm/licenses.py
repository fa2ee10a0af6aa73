"""Licence scans by canonical digests.

A text is made canonical: lower case; lines of copyright holders and "all
rights reserved" go; everything but letters and numbers is one space;
equivalent spellings become one. The SHA-256 of the whole canonical text is
joined to the digests of the known licence texts, by hash. Beside whole
texts, single lines that speak of a licence are held against the known
notices in the same way.

Known texts count with their title, with other usual titles and without one.
Of long licences only the digest is known; short ones are here in full. The
digests of known texts are made by the same expression as those of the documents.

Only DataFrame operations; the known digests are some dozens and broadcast.

Defined cases: a null or empty text has the digest of no text and no licence,
as has a text of copyright lines alone; repeated rows are judged alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, in the order in which they are applied.
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfil ", "fulfill "),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("merchantibility", "merchantability"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)
HOLDER = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|by[ \t]|[<\[])|\(c\)[ \t]|©)[^\n]*$"
RESERVED = r"(?m)^[ \t]*all rights reserved[. \t]*$"
SEPARATORS = r"[^\p{L}\p{N}]+"

# Known licence texts.
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
BSD_CONDITIONS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so"
)
NOTICE = ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
PERMITTED = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: name, titles, text.
TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), GRANT + NOTICE + AS_IS),
    ("MIT-0", ("MIT No Attribution",), GRANT + ".\n\n" + AS_IS),
    ("X11", ("X11 License",), GRANT + NOTICE + AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM") + "\n\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise "
     "to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.\n\nX Window System is a trademark of X Consortium, Inc."),
    ("ISC", ("ISC License", "The ISC License"), PERMITTED + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_AS_IS),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), PERMITTED + ".\n\n" + ISC_AS_IS),
    ("BSD-1-Clause", ("BSD 1-Clause License",), BSD_HEAD + BSD_CONDITIONS.split("2. ")[0] + BSD_AS_IS),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), BSD_HEAD + BSD_CONDITIONS + BSD_AS_IS),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"), BSD_HEAD + BSD_CONDITIONS + BSD_NAMES + BSD_AS_IS),
    ("BSD-4-Clause", ("BSD 4-Clause License",), BSD_HEAD + BSD_CONDITIONS + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes "
     "software developed by the organization.\n" + BSD_NAMES.replace("3.", "4.") + BSD_AS_IS),
    ("Zlib", ("zlib License", "The zlib/libpng License"), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
     "software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
     "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any "
     "source distribution."),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",), "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
     "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
     "Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
     "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
     "generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", ("The Unlicense",), "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
     "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
     "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
     "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
     "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
     "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("PostgreSQL", ("PostgreSQL License", "The PostgreSQL Licence"), "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby "
     "granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.\n\nIN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, "
     "INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE "
     "POSSIBILITY OF SUCH DAMAGE.\n\nTHE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. "
     "THE SOFTWARE PROVIDED HEREUNDER IS ON AN \"AS IS\" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS."),
    ("NTP", ("NTP License",), "Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all "
     "copies and that both the copyright notice and this permission notice appear in supporting documentation, and that the name (TrademarkedName) not be used in advertising or publicity pertaining to distribution of the "
     "software without specific, written prior permission. (TrademarkedName) makes no representations about the suitability this software for any purpose. It is provided \"as is\" without express or implied warranty."),
    ("curl", ("curl License", "COPYRIGHT AND PERMISSION NOTICE"), "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
     "this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nExcept as contained in this notice, the name of a copyright holder shall not be used in "
     "advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder."),
    ("FSFAP", (), "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."),
    ("Fair", ("Fair License",), "Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument.\n\nDISCLAIMER: THE WORKS ARE WITHOUT WARRANTY."),
    ("WTFPL", ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004",), "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name "
     "is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", (), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
     "License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", (), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
# Digests of the canonical texts of longer licences.
DIGESTS = {
    "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "58b6ebdf2bd26f81dd551d8efda909bfbc8914ce77996a5c289c28616b91ceeb": "GFDL-1.2",
    "c4f8ea2b5247ab1ff721ce8255137250d4c14f50a0fb68c00fd793f496ced65e": "GFDL-1.3",
    "0c28ca4dd58dd03edf3afbd7bcf01857c943e8fa9c124d4ca1eaefab216d6b0f": "GPL-1.0",
    "9c05d74a883c3b9a1f9c0850cd047eb9d7a3580bdda1f342f19570447984ab29": "GPL-2.0",
    "dfd1fc3abea1d3d88bd12db363da0b9cdb8731d6e379deb4759ae40fc0208bcb": "GPL-3.0",
    "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d": "LGPL-2.0",
    "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56": "MPL-2.0",
}
# Known one-line notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(low, HOLDER, " "), RESERVED, " ")
    words = F.concat(F.lit(" "), F.regexp_replace(plain, SEPARATORS, " "), F.lit(" "))
    for one, other in SPELLINGS:
        words = F.replace(words, F.lit(one), F.lit(other))
    return F.trim(F.regexp_replace(words, " +", " "))


def digest_of(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def variants(texts: Iterable[tuple[str, tuple[str, ...], str]]) -> list[tuple[str, str]]:
    """(name, text) without a title and with each."""
    return [(name, f"{title}\n\n{text}" if title else text) for name, titles, text in texts for title in ("", *titles)]


def tags(names: Iterable[str]) -> list[tuple[str, str]]:
    """(name, line): the tags that name a licence in a file's head."""
    return [(name, f"SPDX-License-Identifier: {name}") for name in sorted(set(names))]


def known_lines(notices: Iterable[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(name, line) of the notices, or of the known ones and the tags of all known licences."""
    return list(notices) if notices is not None else [*NOTICES, *tags([*(n for n, _ in NOTICES), *(t[0] for t in TEXTS), *DIGESTS.values()])]


def scan(docs: DataFrame, texts: Iterable[tuple[str, str]] | None = None, notices: Iterable[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the canonical text), license (of the whole text, or null), notices (of its lines, joined by commas).

    texts and notices are pairs (name, text), in place of the known ones. Of names with the same canonical text the least counts.
    """
    spark, lines = docs.sparkSession, known_lines(notices)
    whole = spark.createDataFrame([*(variants(TEXTS) if texts is None else texts), *lines] or [("", "")], "license string, known_text string")
    known = whole.select("license", digest_of(F.col("known_text")).alias("known"))
    if texts is None:
        known = known.unionByName(spark.createDataFrame([(n, d) for d, n in DIGESTS.items()], "license string, known string"))
    known = known.groupBy("known").agg(F.min("license").alias("license"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("digest", digest_of(F.col("text")))
    names = F.lit("")
    if lines:
        told = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike("licen[cs]"))
        by_digest = spark.createDataFrame(lines, "name string, line string").groupBy(digest_of(F.col("line"))).agg(F.collect_set("name"))
        entries = [F.lit(x) for r in by_digest.collect() for x in (r[0], sorted(r[1]))]  # as many as notices are given
        found = F.flatten(F.transform(told, lambda x: F.coalesce(F.try_element_at(F.create_map(*entries), digest_of(x)), F.array().cast("array<string>"))))
        listed = F.array_join(F.array_sort(F.array_distinct(found)), ",")
        names = F.when(F.lower("text").rlike("licen[cs]"), listed).otherwise("")
    joined = own.select("doc_id", "digest", names.alias("notices")).join(F.broadcast(known), F.col("digest") == F.col("known"), "left")
    return joined.select("doc_id", "digest", "license", "notices")
