"""Byte-level BPE by Aho-Corasick and backtracking.

The vocabulary's byte strings are mapped to Latin-1 and put into an
Aho-Corasick automaton, which tells how far tokens can reach from a place.
Encoding takes the longest token there that is compatible with the token
before it and falls back to shorter ones; if none fits, the token before is
given up, and the place is marked so that it is never tried again.
Two adjacent tokens are compatible if merging their joined bytes gives
exactly these two. This is memoised. A sequence of which all neighbours are
compatible is the sequence that the merges produce, so the result is exact,
and each place is given up at most once, so the time is linear.

Tokens that their own merges don't produce can't occur inside a piece and
stay out of the automaton; as whole pieces they count, as in the tiktoken
library.

Defined cases: a null or empty text has no tokens and the digests of no
bytes; repeated rows give equal rows; other columns are ignored; an empty
table gives an empty result. Memory: the caches are bounded, and a text's
pieces are handled in blocks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import itemgetter

from pyspark.sql import DataFrame

from .common import map_rows

#: Entries after which a cache is emptied.
CACHED = 400_000
#: Pieces of a text that are handled at once.
BLOCK = 1 << 16
#: For the usual pattern, one for texts in Latin-1 without ODD characters,
#: where letters, numbers and spaces are few enough to be listed. It finds the same.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": rf""" ?[{LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"""
}
#: Numbers other than digits, and what Python's own expressions count as spaces.
ODD = b"\x1c\x1d\x1e\x1f\xb2\xb3\xb9\xbc\xbd\xbe"


def merged(data: bytes, ranks: dict[bytes, int], below: int = sys.maxsize) -> list[bytes]:
    """The merges themselves, lowest rank first, of ranks below a given one; for short strings only."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Tokenizer:
    """Encodes and decodes by the ranks of a tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int | None = None):
        import ahocorasick
        import regex

        self.cached = cached or CACHED
        self.ranks, self.longest, self.size = ranks, max(map(len, ranks)), max(ranks.values()) + 1
        self.tokens = {i: t for t, i in ranks.items()}
        self.finditer = regex.compile(pattern).finditer
        self.latin = re.compile(LATIN[pattern]).finditer if pattern in LATIN else None
        self.known: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.inner: dict[str, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}  # what a token's last merge joins
        for token, i in ranks.items():
            parts = merged(token, ranks, i)
            if len(parts) < 3:
                self.inner[token.decode("latin-1")] = i
            if len(parts) == 2:
                self.halves[i] = ranks[parts[0]], ranks[parts[1]]
        automaton = ahocorasick.Automaton()
        for token, i in self.inner.items():
            automaton.add_word(token, i)
        automaton.make_automaton()
        self.reach = automaton.longest_prefix

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens merge to just these two.

        Merges are undone at the border, the latest first. They differ if an
        earlier merge would have crossed the border; of equal ranks, the one
        further left comes first.
        """
        key = left * self.size + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.cached:
                self.pairs.clear()
            ranks, tokens, halves, limit = self.ranks, self.tokens, self.halves, sys.maxsize
            while found is None:
                if ranks.get(tokens[left] + tokens[right], sys.maxsize) < limit:
                    found = False
                elif left in halves and (left > right or right not in halves):
                    limit, left = left, halves[left][1]
                elif right in halves:
                    limit, right = right + 1, halves[right][0]
                else:
                    found = True
            self.pairs[key] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if data in self.ranks:
            return [self.ranks[data]]
        text, n, inner, reach = data.decode("latin-1"), len(data), self.inner, self.reach
        dead = bytearray(n + 1)
        ids: list[int] = []
        starts: list[int] = []  # of the tokens so far
        at, length = 0, reach(text[: self.longest])
        while at < n:
            while length:
                token = inner.get(text[at : at + length])
                if token is not None and not dead[at + length] and (not ids or self.compatible(ids[-1], token)):
                    break
                length -= 1
            if length:
                ids.append(token)
                starts.append(at)
                at += length
                length = reach(text[at : at + self.longest])
            else:
                dead[at] = 1
                ids.pop()
                length = at - starts[-1] - 1
                at = starts.pop()
        return ids

    def split(self, text: str) -> Iterator[re.Match]:
        """Matches of the pattern."""
        if self.latin:
            try:
                data = text.encode("latin-1")
            except UnicodeEncodeError:
                return self.finditer(text)
            if len(data.translate(None, ODD)) == len(data):
                return self.latin(text)
        return self.finditer(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, matches = [], map(itemgetter(0), self.split(text))
        while pieces := list(islice(matches, BLOCK)):
            known, long = self.known, {}
            for piece in set(pieces).difference(known):
                found = self.aged.get(piece)
                if found is None:
                    ids = self.encode_piece(piece.encode())
                    found = struct.pack(f"<{len(ids)}I", *ids)
                (known if len(piece) < 100 else long)[piece] = found
            if long:
                known = known | long if len(long) < len(pieces) else long
            out.append(b"".join(map(known.__getitem__, pieces)))
            if len(self.known) > self.cached:
                self.aged, self.known = self.known, {}
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str, cached: int | None = None) -> Tokenizer:
    """One for each Python worker."""
    with open(path, "rb") as lines:
        return Tokenizer({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}, pattern, cached)


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text as packed little-endian integers: doc_id, ids binary."""

    def run(keys, texts):
        t = tokenizer(path, pattern)
        return [keys, [t.encode(x or "") for x in texts]]

    return map_rows(docs.select(id_col, text_col), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bytes of each row of ids: doc_id, data binary."""

    def run(keys, ids):
        t = tokenizer(path, pattern)
        return [keys, [t.decode(x or b"") for x in ids]]

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cached: int | None = None) -> DataFrame:
    """Encode and decode every text; counts and digests of both sides. cached: pieces that a worker keeps, at most twice."""

    def run(keys, texts):
        t = tokenizer(path, pattern, cached)
        rows = []
        for text in texts:
            packed = t.encode(text or "")
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.decode(packed)).hexdigest()))
        return [keys, *map(list, zip(*rows))] if rows else [[], [], [], []]

    return map_rows(docs.select(id_col, text_col), run, RESULT)
