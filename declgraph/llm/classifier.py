"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on each text. The votes of
all documents are counted by pattern, of which there are at most 3^8, and
expectation-maximisation over these counts estimates the share of good texts
and how each labeller votes on good and on bad ones. The posterior of a text's
pattern is its label. A linear scorer over hashed features (words, word
shapes, style measures) learns these labels from about ``sample`` documents at
most, which are drawn by a hash of doc_id and text, so that each run and each
partitioning draws the same; of equal rows one is drawn, and texts of more than ``longest``
characters aren't learned from, which bounds what reaches the driver. All documents are counted and scored.

Defined cases: a null or empty text has no words; the length labeller votes
it bad and it is rejected; documents without doc_id are scored, too, and drawn like
any other; repeated rows get equal scores; an empty table gives an empty result; other columns are
ignored in ``scores`` and kept in ``accepted``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_rows

#: Frequent words of four languages. Fixed values.
STOP_WORDS = frozenset(
    "the of and to in is that for with was on are by this from or be as at it not have an a "
    "le la les des et en un une du que qui dans pour pas sur au avec est par ce il plus "
    "der die und den das von mit dem im für ist ein eine auf nicht sich zu als auch "
    "el los las de del y por con para se no es al lo como su".split()
)
SYMBOLS = "#*$%&|<>{}^~=@"
PUNCTUATION = SYMBOLS + "!?.,;:()[]\"'-_/+\\"


@dataclass(frozen=True)
class Settings:
    sample: int = 4096  #: documents that the scorer learns from, about
    longest: int = 1 << 17  #: characters of a text that it learns from
    bits: int = 16  #: of the hashed features
    passes: int = 60
    threshold: float = 0.5
    cached: int = 300_000  #: words after which a worker's cache is emptied


class Words(dict):
    """What is asked of a word, packed into one integer: slot of the word, slot of its shape, upper case, stop word."""

    def __init__(self, bits: int, cached: int):
        self.mask, self.cached = (1 << bits) - 1, cached

    def __missing__(self, word: str) -> int:
        core = word.strip(PUNCTUATION)
        case = "A" if core.isupper() else "a" if core.islower() else "Aa" if core.istitle() else "0" if core.isdigit() else "x" if core else ""
        before, _, after = word.partition(core) if core else (word, "", "")
        low = word.lower()
        packed = slot(f"w {low}", self.mask) | slot(f"s {before[:4]} {case} {after[:4]}", self.mask) << 24
        packed |= (len(word) > 1 and word.isupper()) << 48 | (low.strip(".,;:!?") in STOP_WORDS) << 49
        if len(word) < 100:
            if len(self) >= self.cached:
                self.clear()
            self[word] = packed
        return packed


def slot(name: str, mask: int) -> int:
    return zlib.crc32(name.encode()) & mask


#: Labellers on measures 0 to 4: bad from, good up to.
LABELLERS = ((0.1, 0.04), (0.2, 0.05), (0.5, 0.2), (0.1, 0.03), (0.85, 0.75))


class Reader:
    """Measures, votes and hashed features of texts."""

    def __init__(self, bits: int, cached: int = Settings.cached):
        self.words = Words(bits, cached)

    def read(self, text: str | None) -> None:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        self.n, n = len(words), max(len(words), 1)
        self.packed = np.fromiter(map(self.words.__getitem__, counts), np.int64, len(counts))
        self.tf = np.fromiter(counts.values(), float, len(counts))
        self.measures = [
            sum(map(text.count, SYMBOLS)) / n,
            text.count("!") / n,
            float(self.tf @ (self.packed >> 48 & 1)) / n,
            sum(map(eq, words, islice(words, 1, None))) / n,
            1 - len(counts) / n if n >= 30 else 0.0,
            sum(map(len, words)) / n,
            (text.count(".") + text.count(",")) / n,
            float(self.tf @ (self.packed >> 49 & 1)) / n,
        ]

    def votes(self) -> int:
        """0 for bad, 1 for nothing, 2 for good, of each labeller, as digits to the base of 3."""
        out = [0 if x >= bad else 2 if x <= good else 1 for x, (bad, good) in zip(self.measures, LABELLERS)]
        mean, stops = self.measures[5], self.measures[7]
        out.append(0 if not self.n else 2 if self.n >= 10 else 1)
        out.append(1 if self.n < 10 else 0 if mean < 2 or mean > 15 else 2 if 3 <= mean <= 9 else 1)
        out.append(1 if self.n < 30 else 0 if stops < 0.02 else 2 if stops > 0.1 else 1)
        return sum(v * 3**k for k, v in enumerate(reversed(out)))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots (one may come twice) and values."""
        mask, m = self.words.mask, self.measures
        log = np.log1p(self.tf)
        steps = [min(int(x), 20) for x in (10 * m[0], 10 * m[1], 10 * m[2], 20 * m[3], 20 * m[4], m[5], 10 * m[6], 10 * m[7], math.log2(self.n + 1))]
        fixed = [slot(f"m {k} {x}", mask) for k, x in enumerate(steps)]
        slots = np.concatenate([self.packed & 0xFFFFFF, self.packed >> 24 & 0xFFFFFF, fixed])
        values = np.concatenate([log / max(math.sqrt(log @ log), 1e-9), 2 * self.tf / max(self.n, 1), np.ones(len(fixed))])
        return slots, values


def pattern(text: str | None, reader: Reader) -> int:
    reader.read(text)
    return reader.votes()


def fit_labels(counts: dict[int, int], labellers: int = 8, rounds: int = 100) -> dict[int, float]:
    """Expectation-maximisation over counted vote patterns: the posterior that a pattern's texts are good."""
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes], float)
    cast = np.stack([codes // 3**k % 3 for k in range(labellers)][::-1], axis=1)
    good = np.where((cast == 0).any(axis=1), 0.2, 0.9)  # at first, one bad vote is a suspicion
    for _ in range(rounds):
        share = [(weight * (1 - good)).sum() + 1, (weight * good).sum() + 1]
        logs = np.tile(np.log(np.array(share) / sum(share)), (len(codes), 1))
        for y, p in ((0, 1 - good), (1, good)):
            for k in range(labellers):
                seen = np.bincount(cast[:, k], weight * p, 3) + np.array([1.0, 0, 1.0])
                seen[1] = seen[0] + seen[2]  # no vote says nothing
                logs[:, y] += np.log(seen / seen[1])[cast[:, k]]
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(codes.tolist(), good.tolist()))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], settings: Settings) -> np.ndarray:
    """Logistic regression by AdaGrad over all rows at once."""
    w = np.zeros(1 << settings.bits)
    if not rows:
        return w
    slots = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    sizes = np.full(len(w), 1e-6)
    for _ in range(settings.passes):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[slots] * values, len(rows)), -30, 30)))
        g = np.bincount(slots, (p - y)[row] * values, len(w)) / len(rows) + 1e-6 * w
        sizes += g * g
        w -= 0.5 * g / np.sqrt(sizes)
    return w


@dataclass
class Model:
    posterior: dict[int, float]
    weights: np.ndarray
    settings: Settings

    def __post_init__(self) -> None:
        self.reader = None

    def score(self, text: str | None) -> tuple[float, float]:
        """(posterior of the text's votes, score of the linear model)."""
        if self.reader is None:
            self.reader = Reader(self.settings.bits, self.settings.cached)
        self.reader.read(text)
        slots, values = self.reader.features()
        z = float(self.weights[slots] @ values)
        return self.posterior.get(self.reader.votes(), 0.5), 1 / (1 + math.exp(-max(min(z, 30), -30)))

    def keeps(self, text: str | None) -> bool:
        return bool((text or "").split()) and self.score(text)[1] >= self.settings.threshold


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Weak labels from the votes on all documents, and a scorer from a sample of them."""
    bits, cached = settings.bits, settings.cached

    def vote(texts):
        reader = Reader(bits, cached)
        return [[pattern(t, reader) for t in texts]]

    cast = map_rows(docs.select(text_col), vote, "pattern int")
    counts = {r[0]: r[1] for r in cast.groupBy("pattern").count().collect()}  # 3^8 rows at most
    posterior, total = fit_labels(counts), sum(counts.values())
    share = min(1.0, settings.sample / max(total, 1))
    drawn = docs.select(F.xxhash64(id_col, text_col).alias("draw"), text_col).filter(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.filter(F.coalesce(F.length(text_col), F.lit(0)) <= settings.longest)

    def sparse(draws, texts):
        reader, rows = Reader(bits, cached), []
        for draw, text in zip(draws, texts):
            code = pattern(text, reader)
            slots, values = reader.features()
            rows.append((draw, slots.astype(np.int32).tobytes(), values.astype(np.float32).tobytes(), code))
        return [list(x) for x in zip(*rows)] or [[], [], [], []]

    found = map_rows(drawn, sparse, "draw long, slots binary, shares binary, pattern int").dropDuplicates(["draw"]).collect()
    found.sort(key=lambda r: r.draw)
    rows = [(np.frombuffer(r.slots, np.int32), np.frombuffer(r.shares, np.float32), posterior[r.pattern]) for r in found]
    del found
    return Model(posterior, fit_scorer(rows, settings), settings)


def scores(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weak_label (posterior of the votes), quality (score), kept."""
    model = fit(docs, settings, id_col, text_col)

    def run(ids, texts):
        pairs = [model.score(t) for t in texts]
        kept = [bool((t or "").split()) and p[1] >= model.settings.threshold for t, p in zip(texts, pairs)]
        return [ids, [round(p[0], 6) for p in pairs], [round(p[1], 6) for p in pairs], kept]

    return map_rows(docs.select(id_col, text_col), run, "doc_id long, weak_label double, quality double, kept boolean")


def accepted(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    model = fit(docs, settings, id_col, text_col)
    return keep_rows(docs, text_col, lambda texts: list(map(model.keeps, texts)))
