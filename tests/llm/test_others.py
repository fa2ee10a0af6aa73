"""URL filters, licences, sharding, media and the pipeline."""

import hashlib
import itertools
import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from declgraph.llm import licenses, media, queries, sharding, urls

# URL filters


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = [
    None, "", "nothing", "http://", "http://ORG", "http://org/", "https://A.Example.org/es/1", "http://example.org/en/12?x", "http://xexample.org/es/", "http://a.com/de/", "http://com/fr/#x",
    "http://a.net?b://c.org/", "x://y.org#/es/", "http://a.com/de", "://org/x", "http://É.org/\nq", "http://a.example.org/en/2",
]


def test_lists(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "x")], "page_id long, url string, host string, verdict string")
    found = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(found) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert verdict in (None, found[i].verdict)
    assert urls.judge(pages.limit(0)).count() == 0


def test_tokens_at_any_place(spark):
    """A telling segment, label, extension, scheme or key is found wherever it stands."""
    keys = "&".join(f"a{k}=1" for k in range(9))
    kinds = [("http", "ads.b", "x", "txt", keys), ("http", "b.c", "casino", "txt", keys), ("http", "b.c", "x", "exe", keys), ("ftp", "b.c", "x", "txt", keys), ("http", "b.c", "x", "txt", keys + "&z=1")]
    bad = [f"{s}://q.{h}.y.com/de/u/{p}/{i}.{e}?{k}" for i in range(40) for s, h, p, e, k in kinds]
    good = [f"http://q.b.c.y.com/fr/u/x/{i}.txt?{keys}" for i in range(200)]
    new = [f"{s}://q.{h}.z.net/v/w/{p}/{7}.{e}?{k}" for s, h, p, e, k in kinds] + [f"http://q.b.c.z.net/v/w/x/7.txt?{keys}"]
    pages = spark.createDataFrame(list(enumerate(bad + good + new)), "page_id long, url string")
    found = {r.page_id: (r.verdict, r.by) for r in urls.judge(pages).collect()}
    assert [found[400 + i] for i in range(6)] == [("block", "mined")] * 5 + [("allow", "mined")]


def test_mined_rules_are_those_of_brute_force(spark):
    kinds = [("a", "p", "q"), ("a", "p"), ("b", "p"), ("a", "r"), ("b", "q", "r"), ("c",)]
    rows = [(list(kinds[i % 6]), "block" if i % 6 in (0, 1) or i == 2 else "allow") for i in range(120)]
    for settings_ in (urls.Settings(0.05, 0.9, 1), urls.Settings(0.01, 0.04, 1)):
        found = {tuple(r[0]): (round(r[1], 9), round(r[2], 9)) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), settings_)}
        every = {}
        for n in range(1, 5):
            for items in itertools.combinations("abcpqr", n):
                holds = [v for t, v in rows if set(items) <= set(t)]
                blocks = holds.count("block")
                if holds and blocks >= settings_.min_support * 120 and blocks / len(holds) >= settings_.min_confidence:
                    every[items] = blocks / len(holds), blocks / 120
        wanted = {}
        for items in sorted(every, key=lambda i: (len(i), -every[i][0], i)):
            if not any(set(k) <= set(items) and wanted[k][0] >= every[items][0] for k in wanted):
                wanted[items] = every[items]
        assert found == {k: (round(v[0], 9), round(v[1], 9)) for k, v in wanted.items()}


def test_query_against_rules(spark, table):
    pages = table("pages")
    judged = urls.judge(pages)
    assert all(plain_rule(r.url)[2:] == (r.rule, r.verdict) for r in judged.join(pages, "page_id").collect() if r.rule)
    assert judged.filter("rule IS NULL").count() > 0


def plain_tokens(url):
    """The tokens of a url, read without Spark."""
    import re

    host, path, *_ = plain_rule(url)
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", url or "")
    labels = [x for x in host.split(".") if x]
    parts = [x for x in re.sub(r"[0-9]+", "0", path).split("/") if x]
    query = re.search(r"\?([^#]*)", url or "")
    keys = [x.split("=")[0] for x in (query[1] if query else "").split("&") if x.split("=")[0]]
    ext = re.search(r"[^/]\.([A-Za-z0-9]+)$", path)
    out = ([f"scheme:{scheme[1].lower()}"] if scheme else []) + [f"host:{host}"] * bool(host) + [f"sub:{x}" for x in labels[:1]] + [f"label:{x}" for x in labels]
    out += [f"suffix:{'.'.join(labels[k:])}" for k in range(len(labels))] + [f"seg:{x}" for x in parts[:1]] + [f"leaf:{x}" for x in parts[1:2]] + [f"part:{x}" for x in parts]
    return set(out + ([f"ext:{ext[1].lower()}"] if ext else []) + [f"key:{k}" for k in keys])


def test_query_against_brute_force(spark):
    """All combinations of up to three tokens are counted on their own; rules of more need none here."""
    hosts = ["a.com", "b.com", "d.net"]
    made = [(f"http://{h}/{'de' if i % 3 else 'fr'}/{'xyz'[i % 7 % 3]}/{i}{'.exe' if i % 5 == 0 else ''}{'?k=1' if i % 4 == 0 else ''}") for i in range(130) for h in hosts]
    made += [f"http://c.org/{'es' if i % 2 else 'de'}/p/{i}" for i in range(30)] + ["nothing", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")
    read = urls.read(pages).withColumn("part", F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5))).collect()
    assert all(set(r.tokens) == plain_tokens(r.url) for r in read)
    settings_ = urls.Settings(min_confidence=0.8)
    labelled = [(frozenset(r.tokens), r.listed.verdict == "block", r.part) for r in read if r.listed]
    train, held = ([(t, b) for t, b, part in labelled if (part == 0) == which] for which in (False, True))
    counts = {}
    for t, b in train:
        for n in (1, 2, 3):
            for items in itertools.combinations(sorted(t), n):
                n_all, n_bad = counts.get(items, (0, 0))
                counts[items] = n_all + 1, n_bad + b
    least = max(settings_.min_urls, settings_.min_support * len(train))
    good = {i: bad / n for i, (n, bad) in counts.items() if bad >= least and bad / n >= settings_.min_confidence}
    rules = []
    for items in sorted(good, key=lambda i: (len(i), -good[i], i)):
        if not any(set(k) <= set(items) and good[k] >= good[items] for k in rules):
            rules.append(items)
    rules = [r for r in rules if (seen := [b for t, b in held if set(r) <= t]) and sum(seen) >= settings_.min_confidence * len(seen)]
    assert rules
    found = {r.page_id: r.verdict for r in urls.judge(pages, settings=settings_).collect()}
    for r in read:
        assert found[r.page_id] == (r.listed.verdict if r.listed else "block" if any(set(k) <= set(r.tokens) for k in rules) else "allow"), r.url
    assert {found[r.page_id] for r in read if not r.listed} == {"allow", "block"}


def test_rules_of_few_urls_fall_out(spark):
    """A block of a few urls, or one that the held out urls don't bear out, makes no rule."""
    few = [f"http://a.com/de/{i}?odd=1" for i in range(15)] + [f"http://a.com/fr/{i}" for i in range(200)] + ["http://a.net/de/1?odd=1"]
    found = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(list(enumerate(few)), "page_id long, url string")).collect()}
    assert found[215] == "allow"
    rule, held = [(["x"], 1.0, 0.5), (["y"], 1.0, 0.5), (["z"], 1.0, 0.5)], [(["x"], "block"), (["x", "y"], "allow"), (["z"], "block")]
    rows = spark.createDataFrame(held, "tokens array<string>, verdict string")
    assert urls.proven(rule, rows, urls.Settings()) == [(["z"], 1.0, 0.5, 1, 1)]


# licences


def test_licenses(spark, docs):
    text = dict((n, t) for n, _, t in licenses.TEXTS)["MIT"]
    mit = "MIT License\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + text.upper().replace("\n", "\r\n  * ")
    rows = [(1, mit), (2, text + " more"), (3, None), (4, "© 2001 X"), (5, "text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.\n"), (5, "no"), (None, "released under the mit license"), (6, "// SPDX-License-Identifier: Zlib")]
    found = {(r.doc_id, r.license, r.notices) for r in licenses.scan(docs(*rows)).collect()}
    assert found == {(1, "MIT", ""), (2, None, ""), (3, None, ""), (4, None, ""), (5, None, "CC-BY-NC-4.0,MIT"), (5, None, ""), (None, "MIT", "MIT"), (6, "Zlib", "Zlib")}
    assert licenses.scan(docs()).count() == 0
    assert licenses.scan(docs((1, "mine alone")), [("own", "MINE, alone.")], []).first().license == "own"
    german = licenses.scan(docs((1, "freie lizenz für alle, überall"), (2, "x\nlicense: grün")), [("frei", "Freie Lizenz FÜR alle: überall!")], [("b", "License GRÜN"), ("a", "license; grün")])
    assert sorted((r.doc_id, r.license, r.notices) for r in german.collect()) == [(1, "frei", ""), (2, None, "a,b")]


def test_every_known_text_is_found(spark, docs):
    """Whole texts, with each title or none, a holder's line, other spelling and wrapping."""
    import textwrap

    rows, wanted = [], {}
    for i, (name, text) in enumerate(licenses.variants(licenses.TEXTS)):
        head, _, rest = text.partition("\n\n")
        rows.append((i, f"{head}\n\nCopyright (c) 1999-2020 Somebody <a@b.c>\nCopyright by nobody\n\n" + textwrap.fill(rest.replace("acknowledgment", "acknowledgement"), 71) if rest else text.upper()))
        wanted[i] = name
    found = {r.doc_id: r.license for r in licenses.scan(docs(*rows)).collect()}
    assert found == wanted and len({n for n, _, _ in licenses.TEXTS}) + len(licenses.DIGESTS) >= 30
    assert licenses.scan(docs((1, "x " * 2_000_000), (2, "Fair License\n\n" + dict((n, t) for n, _, t in licenses.TEXTS)["Fair"] + "\n" * 500_000))).filter("license = 'Fair'").count() == 1


def test_digests_of_long_texts(docs):
    """Where this machine has the texts of common licences."""
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    names = [n for n in sorted(os.listdir(folder)) if not os.path.islink(os.path.join(folder, n))]
    rows = [(i, open(os.path.join(folder, n), encoding="utf-8").read()) for i, n in enumerate(names)]
    found = {names[r.doc_id]: r.license for r in licenses.scan(docs(*rows)).collect()}
    assert found["Apache-2.0"] == "Apache-2.0" and found["GPL-3"] == "GPL-3.0" and sum(v is not None for v in found.values()) >= 12


# sharding


def test_table_by_turns():
    """Each slot belongs to the shard that comes first to it when all walk in turns."""
    names, slots = [f"n{i}" for i in range(7)], 101
    owner, free = {}, [[(sharding.number(f"{n}|offset") + j * (sharding.number(f"{n}|skip") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    for i in itertools.cycle(range(7)):
        slot = next(s for s in free[i] if s not in owner)
        owner[slot] = i
        if len(owner) == slots:
            break
    assert sharding.table(names, slots) == [owner[s] for s in range(slots)]


def test_shares_and_moves():
    names = [f"shard-{i:04d}" for i in range(61)]
    whole = sharding.table(names, 6571)
    assert set(Counter(whole).values()) <= {6571 // 61, 6571 // 61 + 1}
    fewer = sharding.table(names[:-1], 6571)
    moved = sum(a != b for a, b in zip(whole, fewer) if a != 60)
    assert moved < 0.15 * 6571
    with pytest.raises(ValueError):
        sharding.Settings(10, 100)


def test_sharded_documents(spark, docs, tmp_path):
    made = docs((1, "a"), (1, "a"), (2, None), (None, "é"))
    found = sharding.place(made).collect()
    assert sorted(r.n_bytes for r in found) == [0, 1, 1, 2] and len({r.shard for r in found if r.doc_id == 1}) == 1
    assert sharding.place(docs()).count() == 0
    other = made.withColumn("shard", F.lit("mine")).withColumn("__slot", F.lit(-1)).withColumn("__shard", F.lit(-1))
    assert sharding.sharded(other).filter("__slot < 0 OR __shard < 0 OR shard <> 'mine'").count() == 0
    for folder, files in (("out", 2), ("more", None)):
        sharding.write(other, str(tmp_path / folder), files=files)
        back = spark.read.parquet(str(tmp_path / folder))
        assert back.count() == 4 and back.filter("shard = 'mine'").count() == 4
    long = sharding.place(docs((1, "x" * 30_000_000))).first()
    assert long.n_bytes == 30_000_000 and long.shard == [r.shard for r in found if r.doc_id == 1][0]


# media


@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=3000))
def test_clip_holds_its_payload(data):
    payload = media.pad(data)
    pixels, length, _ = media.read_avi(media.write_avi(payload))
    assert pixels.reshape(-1)[:length].tobytes() == payload


def inverse_transform(constant):
    """The 8 x 8 samples of a block that has a constant part alone."""
    u, x = np.arange(8), np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, 1 / np.sqrt(2), 1) / 2
    block = np.zeros((8, 8))
    block[0, 0] = constant
    return np.clip(np.round(basis @ block @ basis.T + 128), 0, 255)


def test_samples_are_the_bytes():
    """A bit-by-bit reading of the picture, as any baseline decoder does it."""
    values = np.arange(512, dtype=np.uint8)
    picture = media.coded(values[None, :])[0].tobytes()
    constant, rest, scale, shape, at = media.tables_of(picture)
    assert shape == (64, 8)
    codes = {(length, code): s for s, (code, length) in media.codes(*constant).items()}
    for k, part in enumerate(picture[at:][i * 4 : i * 4 + 4] for i in range(512)):
        bits = f"{int.from_bytes(part[:2], 'big'):016b}"
        length = next(n for n in range(1, 17) if (n, int(bits[:n], 2)) in codes)
        size = codes[length, int(bits[:length], 2)]
        raw = int(bits[length : length + size] or "0", 2)
        level = raw if size and raw >> (size - 1) else raw - (1 << size) + 1 if size else 0
        assert bits[length + size] == "0" and 0xFF not in part[:2]
        assert (inverse_transform(level * scale) == values[k]).all()


def test_shots():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 60, (10, 512)), rng.integers(150, 250, (6, 512))
    assert media.shots(np.concatenate([a, b]).astype(np.uint8)) == [0, 10]
    assert media.shots(a.astype(np.uint8)) == [0]


def test_no_shot_at_the_filled_up_frame():
    """A last frame that holds few bytes isn't a cut unless these differ."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 512 * 12 + 90, np.uint8))
    for length, cuts in ((len(text), ""), (512 * 5 + 1, "")):
        pixels, n, _ = media.read_avi(media.write_avi(media.pad(text[:length])))
        assert media.features(pixels, n).endswith(f"cuts={cuts}")
    pixels, n, _ = media.read_avi(media.write_avi(media.pad(text[: 512 * 11] + bytes(range(200, 256)) * 8)))
    assert media.features(pixels, n).endswith("cuts=11")


@settings(max_examples=40, deadline=None)
@given(parts=st.lists(st.tuples(st.integers(0, 255), st.integers(1, 1500), st.integers(1, 60)), max_size=6))
def test_features_are_those_of_a_plain_reading(parts):
    rng = np.random.default_rng(0)
    payload = media.pad(b"".join(bytes((a + rng.integers(0, w, n)) % 256) for a, n, w in ((a, n, w) for a, n, w in parts)))
    frames = [payload[i : i + 512] for i in range(0, len(payload), 512)]
    shares = [[sum(1 for b in f if b >> 3 == k) / len(f) for k in range(32)] for f in frames]
    differ = [sum(abs(x - y) for x, y in zip(a, b)) / 2 for a, b in zip(shares, shares[1:])]
    cuts = []
    for i, d in enumerate(differ):
        near = differ[max(0, i - 8) : i + 9]
        mean = sum(near) / len(near)
        deviation = max(sum(x * x for x in near) / len(near) - mean * mean, 0) ** 0.5
        if d - mean - 2 * deviation > 1e-9 and d > 0.25 + (8 / len(frames[i + 1])) ** 0.5 - (8 / 512) ** 0.5:
            cuts.append(i + 1)
    pixels, n, _ = media.read_avi(media.write_avi(payload))
    assert media.features(pixels, n) == f"frames={len(frames)};shots={len(cuts) + 1};sum={sum(payload)};cuts={','.join(map(str, cuts))}"


def camera_picture(planes, steps, scale, restart=0, tables=True):
    """A baseline picture from planes of samples; steps: blocks of each plane in a unit. All coefficients, standard tables."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1) / 2
    coder = {k: media.codes(bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in media.STANDARD.items()}
    high, wide = planes[0].shape
    down, across = high // (8 * steps[0][1]), wide // (8 * steps[0][0])
    out, bits, before = bytearray(), "", [0] * len(planes)

    def number(value):
        size = abs(value).bit_length()
        return size, f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for unit in range(down * across):
        if restart and unit and unit % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, before = "", [0] * len(planes)
        row, column = divmod(unit, across)
        for c, (plane, (sx, sy)) in enumerate(zip(planes, steps)):
            for y in range(row * sy, row * sy + sy):
                for z in range(column * sx, column * sx + sx):
                    made = np.round(basis.T @ (plane[8 * y : 8 * y + 8, 8 * z : 8 * z + 8].astype(float) - 128) @ basis / scale).astype(int)
                    order = [int(made[p]) for p in media.ZIGZAG]
                    size, tail = number(order[0] - before[c])
                    before[c] = order[0]
                    one = lambda t, s: f"{coder[t][s][0]:0{coder[t][s][1]}b}"
                    bits += one(int(c > 0), size) + tail
                    run = 0
                    last = max((k for k in range(1, 64) if order[k]), default=0)
                    for k in range(1, last + 1):
                        if not order[k]:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + one(0x10 | int(c > 0), 0xF0), run - 16
                        size, tail = number(order[k])
                        bits, run = bits + one(0x10 | int(c > 0), run << 4 | size) + tail, 0
                    if last < 63:
                        bits += one(0x10 | int(c > 0), 0)
    out += flush(bits)
    head = b"\xff\xd8" + media.segment(0xE0, b"JFIF") + media.segment(0xDB, bytes([0, *[scale] * 64]))
    head += media.segment(0xC0, b"\x08" + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([c + 1, sx << 4 | sy, 0]) for c, (sx, sy) in enumerate(steps)))
    if tables:
        head += b"".join(media.segment(0xC4, bytes([k]) + bytes.fromhex(a) + bytes.fromhex(b)) for k, (a, b) in media.STANDARD.items())
    if restart:
        head += media.segment(0xDD, restart.to_bytes(2, "big"))
    scan = bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11 * int(c > 0)]) for c in range(len(planes))) + b"\x00\x3f\x00"
    return head + media.segment(0xDA, scan) + bytes(out) + b"\xff\xd9"


def camera_clip(pictures, index=True):
    frames = [media.chunk(b"00dc", p) for p in pictures]
    at = np.cumsum([4, *map(len, frames)])
    avih = media.chunk(b"avih", (40_000).to_bytes(4, "little") + bytes(52))
    body = media.chunk(b"LIST", b"hdrl" + avih) + media.chunk(b"LIST", b"movi" + b"".join(frames))
    if index:
        body += media.chunk(b"idx1", b"".join(b"00dc" + (16).to_bytes(4, "little") + int(a).to_bytes(4, "little") + len(p).to_bytes(4, "little") for a, p in zip(at, pictures)))
    return media.chunk(b"RIFF", b"AVI " + body)


@pytest.mark.parametrize("restart,tables", [(0, True), (3, False)])
def test_pictures_of_cameras(restart, tables):
    """All coefficients, no restarts or some, grey and with colours of half the size."""
    rng = np.random.default_rng(1)
    smooth = lambda h, w: np.clip(128 + 90 * np.sin(np.arange(h)[:, None] / 7) * np.cos(np.arange(w)[None, :] / 5) + rng.normal(0, 9, (h, w)), 0, 255).astype(np.uint8)
    y, cb, cr = smooth(48, 64), smooth(24, 32), smooth(24, 32)
    for planes, steps in (([y], [(1, 1)]), ([y, cb, cr], [(2, 2), (1, 1), (1, 1)]), ([y, smooth(48, 64), smooth(48, 64)], [(1, 1)] * 3)):
        found = media.samples(camera_picture(planes, steps, 2, restart, tables))
        assert found.shape == y.shape and np.abs(found.astype(int) - y).max() <= 6


def test_clips_of_cameras(spark):
    dark, light = np.full((48, 64), 40, np.uint8), np.full((48, 64), 200, np.uint8)
    dark[::3] += 20
    pictures = [camera_picture([p], [(1, 1)], 3) for p in [dark] * 12 + [light] * 9]
    good = camera_clip(pictures)
    rows = [(1, good), (2, camera_clip(pictures, index=False)), (3, good[:900]), (4, b"RIFF"), (5, None), (6, media.write_avi(b"x" * 64)), (7, good.replace(b"\xff\xc0", b"\xff\xc2"))]
    found = media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.first_frame, r.end_frame, r.start_s, r.end_s) for r in found if r.doc_id in (1, 2, 6)] == [
        (i, *t) for i in (1, 2) for t in ((0, 12, 0.0, 0.48), (12, 21, 0.48, 0.84))
    ] + [(6, 0, 1, 0.0, 0.04)]
    assert [(r.doc_id, r.clip) for r in found if r.error] == [(3, None), (4, None), (7, None)]


def test_damaged_clips():
    good = bytearray(media.write_avi(b"x" * 640))
    for at in (2, len(good) // 2):
        bad = good.copy()
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            media.read_avi(bytes(bad))


def test_media_documents(spark, docs):
    rows = [(1, "abc"), (2, None), (3, ""), (1, "abc"), (None, "é" * 5000)]
    found = media.media_columns(docs(*rows)).collect()
    assert len(found) == 5
    for r, text in zip(found, [t for _, t in rows]):
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_columns(docs()).count() == 0
    timed = media.clips(media.encode(docs((1, "a" * 5000 + "\xff" * 5000)))).orderBy("clip").collect()
    assert [r.first_frame for r in timed][0] == 0 and timed[-1].end_s == pytest.approx(timed[-1].end_frame / 25)


# pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, "/root/testdata/sf0.001")
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() and docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.count() == docs.count()
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() == docs.count()


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports, with the library's own queries, when the folders are gone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "declgraph"):
        os.symlink(os.path.join(root, name), tmp_path / name) if name.endswith(".py") else __import__("shutil").copytree(
            os.path.join(root, name), tmp_path / name, ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")]
        )
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') and q[2].isdigit() or q == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr
    assert len(queries.QUERIES) == 10
