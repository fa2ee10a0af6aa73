"""Quality rules with suffix-array repetition.

Base rules count words, symbols, repeated lines and words in repeated
three-word windows (the spans of repeats of at least three words). The repetition rule builds a suffix array over the words of one
text; its longest-common-prefix values give, for each occurrence, the longest
substring that starts there and occurs elsewhere as well, and these cover the
occurrences of all maximal repeated substrings. Their spans are united. A
text is rejected if the spans of repeats of at least ``min_repeat`` words
cover more than ``max_covered`` of it or one repeat exceeds ``max_repeat``
words.

Defined cases: a null text has no words, as has an empty one (base_failed);
texts without repeats have cover 0; repeated rows are judged alike; an empty
table gives an empty result; other columns are ignored, whatever their names.
Memory is a few arrays over the words of one text, and HELD ranks at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import keep_rows, map_rows

#: Fixed by the query's contract.
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Ranks of prefixes that are kept for the common prefixes; beyond, these are found by a scan.
HELD = 1 << 22


@dataclass(frozen=True)
class Limits:
    """The least rounded bounds that reject none of the texts labelled good (which hold up to 43 % in repeats, of 13 words at most)."""

    min_repeat: int = 10
    max_covered: float = 0.45
    max_repeat: int = 50


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Suffix array by prefix doubling, and the ranks of the prefixes of 1, 2, 4, ... words (None if they are more than HELD).

    A rank is the first place of its group of equal prefixes. Only suffixes in
    groups of two or more are sorted again.
    """
    n = len(ids)
    rank, levels, step = np.zeros(n, np.int64), [], 0
    held = True
    active = np.arange(n)
    behind = ids
    while len(active):
        order = np.lexsort((behind, rank[active])) if step else np.argsort(behind, kind="stable")
        active, behind = active[order], behind[order]
        group = rank[active]
        at = np.arange(len(active))
        opens = np.r_[True, group[1:] != group[:-1]]
        splits = opens | np.r_[True, behind[1:] != behind[:-1]]
        base = np.maximum.accumulate(np.where(opens, at, 0))
        fresh = np.maximum.accumulate(np.where(splits, at, 0))
        held = held and (len(levels) + 1) * n <= HELD
        rank, levels = (rank.copy(), levels) if held else (rank, [])
        rank[active] = group + fresh - base
        if held:
            levels.append(rank)
        alone = splits & np.r_[splits[1:], True]
        active = active[~alone]
        step = 2 * step or 1
        nexts = active + step
        behind = np.full(len(active), -1, np.int64)
        inside = nexts < n
        behind[inside] = rank[nexts[inside]]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels if held else None


def scanned_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """As ``common_prefixes``, by one scan over the text: what the next suffix shares is at most one word less."""
    n, rank, shared, same = len(ids), np.empty(len(ids), np.int64), np.zeros(max(len(ids) - 1, 0), np.int64), 0
    rank[order] = np.arange(n)
    words, places, before = ids.tolist(), rank.tolist(), order.tolist()
    for i, place in enumerate(places):
        if not place:
            same = 0
            continue
        j = before[place - 1]
        most = n - max(i, j)
        while same < most and words[i + same] == words[j + same]:
            same += 1
        shared[place - 1] = same
        same = max(same - 1, 0)
    return shared


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order."""
    n, a, b = len(order), order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        shared[same] += 1 << k
    return shared


def covered(order: np.ndarray, shared: np.ndarray, least: int) -> int:
    """Words in the united spans of the repeats of at least so many words."""
    ends = np.zeros(len(order) + 1, np.int64)
    found = shared >= least
    for starts in (order[:-1][found], order[1:][found]):
        np.add.at(ends, starts, 1)
        np.add.at(ends, starts + shared[found], -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def repetition(ids: np.ndarray, *least: int) -> tuple[int, ...]:
    """Words of the longest repeat, then the words covered by repeats of at least each length."""
    if len(ids) < 2:
        return 0, *(0 for _ in least)
    order, levels = suffix_order(ids)
    shared = scanned_prefixes(ids, order) if levels is None else common_prefixes(order, levels)
    longest = int(shared.max())
    return longest, *(covered(order, shared, x) if x <= longest else 0 for x in least)


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, spans, longest)."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at exactly these six spaces
    n = len(words)
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, i) for i, w in enumerate(words)), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    longest, repeats, spans = repetition(ids, 3, limits.min_repeat)
    failed = n < 50 or 100 * repeats > 50 * n
    kept = not failed and spans <= limits.max_covered * n and longest <= limits.max_repeat
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept, spans, longest


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long"


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and verdicts per document."""

    def judge(ids, texts):
        rows = [measure(t, limits) for t in texts]
        return [ids, *map(list, zip(*(r[:8] for r in rows)))] if rows else [[] for _ in RESULT.split(",")]

    return map_rows(docs.select(id_col, text_col), judge, RESULT)


def accepted(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return keep_rows(docs, text_col, lambda texts: [measure(t, limits)[6] for t in texts])
