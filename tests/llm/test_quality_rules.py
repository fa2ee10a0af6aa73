import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from declgraph.llm import quality_rules as q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)

    def cover(k):
        seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})

    longest = next((k for k in range(n - 1, 0, -1) if max(Counter(tuple(words[i : i + k]) for i in range(n - k + 1)).values()) > 1), 0)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), cover(3), cover(10), longest


@settings(max_examples=150, deadline=None)
@given(words=st.lists(st.sampled_from(["a", "b", "cé", "#d|", "\n", "e\nf", "\x1c", "\xa0", "\t"]), max_size=90))
def test_counts(words):
    text = " ".join(words)
    m = q.measure(text)
    n, chars, symbols, lines, repeats, covered, longest = plain(text)
    assert (m[0], m[1], m[2], m[3], m[4], m[7], m[8]) == (n, chars, symbols, lines, repeats, covered, longest)
    assert m[5] == (n < 50 or 100 * repeats > 50 * n)
    assert m[6] == (not m[5] and covered <= 0.45 * n and longest <= 50)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 200):
        ids = rng.integers(0, 3, n)
        order, levels = q.suffix_order(ids)
        text = ids.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        shared = q.common_prefixes(order, levels)
        assert shared.tolist() == q.scanned_prefixes(ids, order).tolist()
        for k, (a, b) in enumerate(zip(order[:-1], order[1:])):
            common = next((x for x, (u, v) in enumerate(zip(text[a:], text[b:])) if u != v), min(n - a, n - b))
            assert shared[k] == common


def test_long_texts_need_few_arrays(monkeypatch):
    """A text of equal words has many levels of ranks; they aren't kept, and the result is the same."""
    text = "a " * 3000 + " ".join(f"w{i % 700}" for i in range(2100))
    whole = q.measure(text)
    monkeypatch.setattr(q, "HELD", 6000)
    assert q.suffix_order(np.zeros(3000, np.int64))[1] is None and q.measure(text) == whole
    monkeypatch.undo()
    assert q.suffix_order(np.zeros(1 << 19, np.int64))[1] is None


def test_method_rejects_what_the_base_keeps():
    unique = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(51))
    assert q.measure(unique)[6] and q.measure(f"{passage} {unique} {passage}")[5:7] == (False, False)
    short = [" ".join(f"q{k}{i}" for i in range(12)) for k in range(20)]
    for more, kept in ((541, False), (636, True)):  # 480 words in repeats of 12, which are 47 and 43 %
        m = q.measure(" ".join([*short, *short[::-1], *(f"u{i}" for i in range(more))]))
        assert (m[7], m[8]) == (480, 12) and m[5:7] == (False, kept)
    part = " ".join(f"p{i}" for i in range(20))
    assert not q.measure(" ".join(f"{part} u{i} v{i} {part.upper()}" for i in range(2)) + " x" + " ".join(f" y{i}" for i in range(110)))[5]


def test_documents(spark, docs):
    long = " ".join(f"w{i}" for i in range(60))
    rows = q.quality_rules(docs((1, long), (1, long), (2, None), (3, ""), (None, "de " * 3000))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in rows) == sorted(
        [("1", 60, False, True)] * 2 + [("2", 0, True, False), ("3", 0, True, False), ("None", 3000, True, False)]
    )
    assert q.quality_rules(docs()).count() == 0
    kept = q.accepted(docs((1, long), (2, None), (1, long)))
    assert kept.columns == docs().columns and kept.count() == 2


def test_clean_documents_stay(spark, table):
    good = table("documents").join(table("labels").filter("quality = 1"), "doc_id")
    judged = good.select("doc_id").join(q.quality_rules(table("documents")), "doc_id").filter("NOT base_failed")
    assert judged.filter("NOT kept").count() == 0 and judged.count() > 40
