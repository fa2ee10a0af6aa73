import random
import re
from collections import defaultdict

import pytest
import xxhash

from declgraph.llm import parts, simhash


def plain_fingerprint(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), seed=42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(numbers):
    """number -> least number it reaches by steps of two bits or fewer."""
    parent = {x: x for x in numbers}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in numbers:
        for b in numbers:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in numbers}


@pytest.mark.parametrize("width", [3, 5])
def test_fingerprints(width):
    random.seed(width)
    for n in (0, 1, 2, 3, 4, 6, 50, 300):
        text = " ".join(random.choice(["The", "a", "É", "b c", "\n", "x y", "dog"]) for _ in range(n))
        assert simhash.fingerprint(text, width) & (1 << 64) - 1 == plain_fingerprint(text, width)
    assert simhash.fingerprint(None, width) == 0


def test_very_long_text(monkeypatch):
    text = " ".join(str(i % 97) for i in range(500))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, 3) == whole


@pytest.mark.parametrize("bucket,spread", [(24, 64), (3, 64), (2, 9), (24, 9)])
def test_components_of_dense_fingerprints(spark, bucket, spread):
    random.seed(bucket + spread)
    numbers = set()
    for _ in range(5):
        x = random.getrandbits(64)
        for _ in range(60):
            for _ in range(random.choice((1, 2, 3))):
                x ^= 1 << random.randrange(spread)
            numbers.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in numbers}
    df = spark.createDataFrame([(signed[x],) for x in numbers], "fp long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # keys go on across batches
    found = dict(simhash.components(simhash.links(df, 2, bucket)).collect())
    groups, wanted = defaultdict(set), defaultdict(set)
    for x, root in roots(sorted(numbers)).items():
        wanted[root].add(x)
        groups[found.get(signed[x], signed[x])].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_one_bit(spark):
    numbers = [0, 1, 3, 7, 1 << 40, (1 << 40) + 6]
    df = spark.createDataFrame([(x,) for x in numbers], "fp long")
    for bucket in (24, 2):
        assert {tuple(sorted(r)) for r in simhash.links(df, 1, bucket).collect()} == {(0, 1), (1, 3), (3, 7), (0, 1 << 40)}


def test_long_chain_and_star(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)], "a long, b long")
    found = dict(simhash.components(chain).collect())
    assert {found[i] for i in range(301)} == {0} and {found[i] for i in range(1000, 1200)} == {1000}


def test_documents(spark, docs):
    text = "one two three four five six seven"
    rows = [(7, text), (3, text.upper()), (3, text), (9, None), (8, ""), (None, "other words here"), (1, "quite another text of its own")]
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(*rows)).collect()]
    assert len(found) == 7
    ids = {(d, c) for d, _, c in found}
    assert {(7, 3), (3, 3), (9, 8), (8, 8), (1, 1), (None, None)} == ids
    assert {f for d, f, _ in found if d in (8, 9)} == {"0" * 16}
    assert simhash.near_duplicates(docs()).count() == 0
    kept = simhash.one_of_each(docs(*rows))
    assert kept.columns == docs().columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "8", "None"]


def test_query_against_brute_force(table):
    source = table("documents")
    texts = dict(source.select("doc_id", "text").collect())
    prints = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
    root = roots(sorted(set(prints.values())))
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(root[p], i)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(source).collect()}
    assert found == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_many_copies(spark, docs, monkeypatch):
    """Salted or not, the same components."""
    rows = [(i, "the same text again") for i in range(40)] + [(100 + i, f"text number {i} of its own") for i in range(5)] + [(None, "the same text again")]
    whole = sorted(map(str, simhash.near_duplicates(docs(*rows)).collect()))
    monkeypatch.setattr(simhash, "COPIES", 3)
    assert sorted(map(str, simhash.near_duplicates(docs(*rows)).collect())) == whole and len(whole) == 46


def shingles(text, width):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_similar_texts(spark, docs):
    """Copies and texts of a similarity of 0.85 or more meet; those below 0.4 don't."""
    random.seed(2)
    rows, base = [], []
    for g in range(12):
        words = [f"{random.choice('abcdefgh')}{random.randrange(5000)}" for _ in range(150)]
        base.append(words)
        rows.append((10 * g, " ".join(words)))
        rows.append((10 * g + 1, " ".join(words)))
        for k in (2, 3):
            other = list(words)
            for i in random.sample(range(150), 2):
                other[i] += "x"
            rows.append((10 * g + k, " ".join(other)))
        far = list(words)
        for i in range(0, 150, 5):
            far[i] += "y"
        rows.append((10 * g + 4, " ".join(far)))
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(docs(*rows)).collect()}
    texts = dict(rows)
    for g in range(12):
        assert found[10 * g + 1] == 10 * g and found[10 * g + 4] == 10 * g + 4
        for k in (2, 3):
            a, b = shingles(texts[10 * g], 5), shingles(texts[10 * g + k], 5)
            assert len(a & b) / len(a | b) >= 0.85 and found[10 * g + k] == 10 * g
    assert {r.doc_id for r in simhash.one_of_each(docs(*rows)).collect()} == {10 * g + k for g in range(12) for k in (0, 4)}


def test_candidates_are_those_of_brute_force():
    """Keys that go on across batches, small and large: the same components within each key."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    key = np.sort(np.r_[np.repeat([5, 9], [70, 40]), rng.integers(10, 60, 150)])
    fp = rng.integers(0, 1 << 12, len(key)) | (rng.integers(0, 2, len(key)) << 40)
    order = np.lexsort((fp, key))
    key, fp = key[order].astype(np.int64), fp[order].astype(np.int64)
    for size in (7, 30, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (key, fp, fp)], names=["key", "node", "fp"]) for i in range(0, len(key), size)]
        links = [p for b in simhash.candidates(iter(batches), 3, 8) for p in zip(*(c.to_pylist() for c in b.columns[:2]))]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        whole = {frozenset(p) for k in set(key.tolist()) for a in fp[key == k].tolist() for b in fp[key == k].tolist() if a < b and (a ^ b).bit_count() <= 3 for p in [(a, b)]}
        assert {frozenset(p) for p in links if p[0] != p[1]} <= whole

        def parts(edges):
            label = {x: x for x in fp.tolist()}
            for _ in range(200):
                before = dict(label)
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
                if before == label:
                    return label

        assert parts(links) == parts([tuple(p) for p in whole])
    assert list(simhash.candidates(iter([]), 3, 8)) == []


def changed_copies(groups, length, changes):
    """(id, text) of texts and of copies with that many words replaced, each in five shingles of its own; and their similarity."""
    rows = []
    for g in range(groups):
        words = [f"{random.choice('abcdefgh')}{random.randrange(50000)}" for _ in range(length)]
        other = list(words)
        for i in random.sample(range(1, length // 5 - 1), changes):
            other[5 * i] += "x"
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(other))]
    a, b = shingles(rows[0][1], 5), shingles(rows[1][1], 5)
    return rows, len(a & b) / len(a | b)


def test_links_are_verified_on_the_shingles(spark, docs):
    """Texts of a similarity of less than 0.8 all stay, near as their fingerprints may be."""
    random.seed(5)
    rows, similarity = changed_copies(60, 150, 4)
    assert 0.75 < similarity < 0.8
    assert simhash.one_of_each(docs(*rows)).count() == 120


@pytest.mark.parametrize("bucket", [8, 2])
def test_components_of_full_keys_are_those_of_all_pairs(spark, docs, bucket):
    """A tree that falls apart when its links are verified doesn't lose pairs that aren't in it."""
    random.seed(6)
    rows = []
    for g in range(4):
        words = [f"{random.choice('abcdefgh')}{random.randrange(50000)}" for _ in range(150)]
        for k in range(40):
            other = list(words)
            for i in random.sample(range(1, 29), random.choice((1, 2, 2, 3))):
                other[5 * i] += f"x{k % 3}"
            rows.append((100 * g + k, " ".join(other)))
    found = {n: {r.doc_id: r.component_id for r in simhash.similar_texts(docs(*rows), simhash.Similar(bucket=n)).collect()} for n in (bucket, 1000)}
    assert found[bucket] == found[1000]
    assert 4 < len(set(found[1000].values())) < 120


def test_similarity_of_little_more_than_the_least(spark, docs):
    """Of pairs of a similarity of 0.80 to 0.85 nearly all are found."""
    random.seed(7)
    for length, changes in ((145, 3), (198, 4), (250, 4)):
        rows, similarity = changed_copies(200, length, changes)
        assert 0.8 <= similarity < 0.85
        found = simhash.similar_texts(docs(*rows)).filter("component_id <> doc_id").count()
        assert 192 <= found <= 200


def test_repeated_ids_of_different_texts(spark, docs):
    """The only copy of a text stays, whatever other rows have its doc_id."""
    one, other, third = ("one two three four five six seven", "quite another text of its own words", "a third text that nobody else has")
    rows = [(3, one), (7, one), (7, other), (7, other), (3, third), (None, other)]
    for part in (rows, rows[::-1]):
        kept = sorted(map(str, ((r.doc_id, r.text) for r in simhash.one_of_each(docs(*part)).collect())))
        assert kept == sorted(map(str, [(3, one), (7, other), (3, third), (None, other)]))


def near_copies(groups, copies, seed):
    """(id, text) of groups whose members differ from each other by more and more words, so that links form chains."""
    random.seed(seed)
    rows = []
    for g in range(groups):
        words = [f"{random.choice('abcdefgh')}{random.randrange(50000)}" for _ in range(150)]
        for k in range(copies):
            other = list(words)
            for i in random.sample(range(1, 29), random.choice((1, 2, 2, 3))):
                other[5 * i] += f"x{k % 3}"
            rows.append((100 * g + k, " ".join(other)))
    return rows


@pytest.mark.parametrize("members", [3, 16])
def test_blocks_give_the_components_of_all_pairs(spark, docs, members):
    """Parts of many blocks, trees apart: as if each part were verified in one task."""
    rows = near_copies(4, 40, 6) + [(1000 + k, " ".join(f"{w}{k // 20}" for w in range(40)) + f" end{k}") for k in range(60)]
    found = {n: {r.doc_id: r.component_id for r in simhash.similar_texts(docs(*rows), simhash.Similar(members=n)).collect()} for n in (members, 10_000)}
    assert found[members] == found[10_000]
    assert 7 < len(set(found[members].values())) < 120


def test_blocks_of_sets(spark):
    """One part of chains, of a large tree and of texts on their own, against all pairs."""
    import numpy as np

    random.seed(9)
    sets = [set(range(100 * c + k, 100 * c + k + 60)) for c in range(6) for k in range(0, 30, 2)] + [set(range(5000, 5050)) | {9000 + k} for k in range(40)] + [{7000 + k} for k in range(9)] + [set()] * 2
    random.shuffle(sets)
    rows = [(1, i, len(x), np.array(sorted(x), np.uint64).tobytes()) for i, x in enumerate(sets)]
    made = spark.createDataFrame(rows + rows[:3], "part long, node long, size long, hashes binary")
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and len(a & b) >= 0.8 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    for members, weight in ((4, 10**6), (1000, 300), (1000, 10**6)):
        links = parts.verified_links(parts.in_blocks(made, members, weight), members, weight)
        assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links.collect())
        found = dict(simhash.components(links).collect())
        assert [found.get(i, i) for i in range(len(sets))] == label


@pytest.mark.parametrize("full", [4, 12])
def test_full_segments_lose_no_pair(spark, docs, full):
    """Values of many members are held against one: the same result as when all are dealt out."""
    rows = near_copies(4, 40, 11)
    found = {n: {r.doc_id: r.component_id for r in simhash.similar_texts(docs(*rows), simhash.Similar(full=n)).collect()} for n in (full, 10_000)}
    assert found[full] == found[10_000]


def test_pairs_that_hang_on_another_text(spark):
    """Sixteen fingerprints of one key, near the first by the first test only; two differ in one bit of all."""
    settings = simhash.Similar(bucket=8)
    random.seed(1)
    hub = [random.getrandbits(63) for _ in range(settings.words)]
    rows = []
    for k in range(16):
        words = [w ^ (random.getrandbits(63) & ~((1 << 20) - 1)) if i == 0 else random.getrandbits(63) for i, w in enumerate(hub)] if k else hub
        rows.append((k, 0, *words))
    rows[15] = (15, 1, *rows[14][2:-1], rows[14][-1] ^ 1)
    nodes = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in ["node", "probe", *settings.names]))
    for other in (settings, simhash.Similar(bucket=64), simhash.Similar(bucket=8, prints=3)):
        assert {tuple(sorted(r)) for r in simhash.bit_links(nodes, other).collect()} == {(14, 15)}


def test_settings_of_a_corpus():
    """The rate at which pairs are found is the same at any size."""
    import math

    for texts in (0, 1, 10**5, 10**7, 10**10):
        s = simhash.Similar.of(texts)
        p = math.acos(1.6 / 1.8) / math.pi
        share = (1 - p) ** s.segment + s.segment * p * (1 - p) ** (s.segment - 1)
        assert 1 - (1 - share) ** (s.words * s.per_word) >= 0.98 and texts / 2 ** (s.segment - 1) <= 2
    assert simhash.Similar.of(10**5) == simhash.Similar()


def test_chunks_of_links(spark, monkeypatch):
    """Contracted in chunks or not, the same components."""
    import numpy as np

    from declgraph.llm import components

    rng = np.random.default_rng(2)
    for edges in ([], [(5, 5)], [(i, i + 1) for i in range(500)][::-1], rng.integers(0, 300, (200, 2)).tolist(), rng.integers(-50, 50, (2000, 2)).tolist()):
        label = {x: x for e in edges for x in e}
        for _ in range(len(label)):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        wanted = {x: r for x, r in label.items() if any(x in e and e[0] != e[1] for e in edges)}
        df = spark.createDataFrame([tuple(e) for e in edges], "a long, b long")
        for chunk in (1 << 20, 50):
            monkeypatch.setattr(components, "CHUNK", chunk)
            assert dict(components.components(df).collect()) == wanted
