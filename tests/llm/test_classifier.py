import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from declgraph.llm import classifier as c


def test_labellers_of_known_accuracy():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.8
    right = [0.95, 0.9, 0.85, 0.9, 0.8, 0.9, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(5000) < r, truth, ~truth) * 2 for r in right], axis=1)
    votes[rng.random(votes.shape) < 0.3] = 1
    codes = votes @ 3 ** np.arange(7, -1, -1)
    patterns, counts = np.unique(codes, return_counts=True)
    posterior = c.fit_labels(dict(zip(patterns.tolist(), counts.tolist())))
    said = np.array([posterior[x] for x in codes.tolist()]) > 0.5
    assert (said == truth).mean() > 0.95
    assert c.fit_labels({}) == {}


def test_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    found = c.scores(docs).join(labels.withColumnRenamed("quality", "gold"), "doc_id").select("kept", "gold").collect()
    clean = [r.kept for r in found if r.gold == 1]
    poor = [not r.kept for r in found if r.gold == 0]
    assert sum(clean) / len(clean) >= 0.98 and sum(poor) / len(poor) >= 0.85


def test_documents(spark, docs):
    good = "The cat sat on the mat, and it was warm. In the house there is a dog for you. " * 2
    rows = [(i, good + str(i)) for i in range(20)] + [(100 + i, f"BUY!! NOW!! {i}!! " * 20) for i in range(5)] + [(7, good + "7"), (200, None), (201, ""), (None, good)]
    found = c.scores(docs(*rows)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.quality, r.kept))
    assert len(by[7]) == 1 and not any(k for _, k in by[200] | by[201])
    assert all(k for i in range(20) for _, k in by[i]) and not any(k for i in range(100, 105) for _, k in by[i])
    again = c.scores(docs(*rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert c.scores(docs()).count() == 0
    kept = c.accepted(docs(*rows))
    assert kept.columns == docs().columns and kept.count() == 22


def plain_votes(text):
    """The eight votes of a text, -1 bad and 1 good, read without the library's reader."""
    words, n = (text or "").split(), max(len((text or "").split()), 1)
    share = lambda k: k / n
    symbols = share(len(re.findall(r"[#*$%&|<>{}^~=@]", text or "")))
    measures = [
        symbols, share((text or "").count("!")), share(sum(len(w) > 1 and w.isupper() for w in words)),
        share(sum(a == b for a, b in zip(words, words[1:]))), 1 - len(set(words)) / n if n >= 30 else 0.0,
    ]
    bounds = [(0.1, 0.04), (0.2, 0.05), (0.5, 0.2), (0.1, 0.03), (0.85, 0.75)]
    votes = [-1 if m >= bad else 1 if m <= good else 0 for m, (bad, good) in zip(measures, bounds)]
    mean, stops = sum(map(len, words)) / n, share(sum(w.lower().strip(".,;:!?") in c.STOP_WORDS for w in words))
    votes.append(-1 if not words else int(n >= 10))
    votes.append(0 if n < 10 else -1 if mean < 2 or mean > 15 else int(3 <= mean <= 9))
    votes.append(0 if n < 30 else -1 if stops < 0.02 else int(stops > 0.1))
    return tuple(votes)


def plain_posterior(votes, rounds=100):
    """Expectation-maximisation, document by document."""
    good = [0.2 if -1 in v else 0.9 for v in votes]
    for _ in range(rounds):
        logs = []
        for y in (0, 1):
            weight = [p if y else 1 - p for p in good]
            total = sum(weight) + 1
            rates = []
            for k in range(8):
                up, down = (sum(w for w, v in zip(weight, votes) if v[k] == s) + 1 for s in (1, -1))
                rates.append({1: math.log(up / (up + down)), -1: math.log(down / (up + down)), 0: 0.0})
            logs.append([math.log(total / (len(votes) + 2)) + sum(r[s] for r, s in zip(rates, v)) for v in votes])
        new = [1 / (1 + math.exp(max(min(a - b, 700), -700))) for a, b in zip(*logs)]
        done = max(abs(a - b) for a, b in zip(new, good)) < 1e-9
        good = new
        if done:
            break
    return good


def plain_features(text):
    """name -> value, by names rather than slots."""
    words = (text or "").split()
    n, counts, out = len(words), Counter(words), Counter()
    norm = math.sqrt(sum(math.log1p(x) ** 2 for x in counts.values())) or 1e-9
    for w, x in counts.items():
        core = w.strip(c.PUNCTUATION)
        case = "A" if core.isupper() else "a" if core.islower() else "Aa" if core.istitle() else "0" if core.isdigit() else "x" if core else ""
        at = w.find(core) if core else len(w)
        out[f"w {w.lower()}"] += np.float32(math.log1p(x) / norm)
        out[f"s {w[:at][:4]} {case} {w[at + len(core):][:4]}"] += np.float32(2 * x / max(n, 1))
    m = max(n, 1)
    pairs, stops = sum(a == b for a, b in zip(words, words[1:])), sum(w.lower().strip(".,;:!?") in c.STOP_WORDS for w in words)
    steps = [
        10 * len(re.findall(r"[#*$%&|<>{}^~=@]", text or "")) / m, 10 * (text or "").count("!") / m, 10 * sum(len(w) > 1 and w.isupper() for w in words) / m, 20 * pairs / m,
        20 * (1 - len(counts) / m if m >= 30 else 0.0), sum(map(len, words)) / m, 10 * len(re.findall(r"[.,]", text or "")) / m, 10 * stops / m, math.log2(n + 1),
    ]
    for k, x in enumerate(steps):
        out[f"m {k} {min(int(x), 20)}"] += 1
    return out


def test_query_against_brute_force(spark, table):
    """Votes, expectation-maximisation and the scorer, each written out anew over dictionaries."""
    source = table("documents").withColumn("text", F.when(F.col("doc_id") % 41 == 0, F.repeat("text", 3)).otherwise(F.col("text")))
    texts = dict(source.select("doc_id", "text").collect())
    found = {r.doc_id: r for r in c.scores(source).collect()}
    ids = sorted(texts)
    posterior = dict(zip(ids, plain_posterior([plain_votes(texts[i]) for i in ids])))
    assert all(abs(found[i].weak_label - posterior[i]) < 2e-6 for i in ids)
    learned = [i for i in ids if len(texts[i] or "") <= c.Settings().longest]
    rows = [({zlib.crc32(k.encode()) & 0xFFFF: 0 for k in f}, f) for f in (plain_features(texts[i]) for i in learned)]
    for slots, f in rows:
        for k, x in f.items():
            slots[zlib.crc32(k.encode()) & 0xFFFF] += x
    w, sizes = Counter(), {}
    every = sorted({k for slots, _ in rows for k in slots})
    for _ in range(60):
        g = dict.fromkeys(every, 0.0)
        for i, (slots, _) in zip(learned, rows):
            z = max(min(sum(w[k] * x for k, x in slots.items()), 30), -30)
            e = 1 / (1 + math.exp(-z)) - posterior[i]
            for k, x in slots.items():
                g[k] += e * x / len(rows)
        for k in every:
            d = g[k] + 1e-6 * w[k]
            sizes[k] = sizes.get(k, 1e-6) + d * d
            w[k] -= 0.5 * d / math.sqrt(sizes[k])
    for i in ids:
        slots = Counter()
        for k, x in plain_features(texts[i]).items():
            slots[zlib.crc32(k.encode()) & 0xFFFF] += x
        z = sum(w[k] * x for k, x in slots.items())
        score = 1 / (1 + math.exp(-max(min(z, 30), -30)))
        assert abs(found[i].quality - score) < 1e-3
        assert found[i].kept == (bool((texts[i] or "").split()) and score >= 0.5) or abs(score - 0.5) < 1e-3


def test_what_is_drawn_is_bounded(spark, docs):
    """Rows without doc_id are drawn by their texts, and of equal rows one."""
    rows = [(None, f"the cat {i} sat on the mat and was warm") for i in range(3000)] + [(None, "the same text")] * 3000 + [(5, "x " * (1 << 17))]
    drawn = []
    fit = c.fit_scorer
    try:
        c.fit_scorer = lambda found, settings: drawn.append(len(found)) or fit(found, settings)
        assert c.scores(docs(*rows), c.Settings(sample=300)).count() == 6001
    finally:
        c.fit_scorer = fit
    assert 100 <= drawn[0] <= 230


def test_long_words():
    reader = c.Reader(16)
    a, b = "(" * 3 + "a" * 300 + "]" * 3, "(" * 3 + "a" * 300 + "!" * 3
    assert reader.words[a] >> 24 & 0xFFFFFF == c.slot("s ((( a ]]]", 0xFFFF) != reader.words[b] >> 24 & 0xFFFFFF
