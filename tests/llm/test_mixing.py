import random
from collections import defaultdict

from pyspark.sql import functions as F

from declgraph.llm import mixing


def fixpoint(sizes, weights, most):
    """Rounds of resharing."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        share = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * weights[i] / share for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i] * (1 + 1e-12)}
        if not over:
            return target
        full |= over


def test_targets(spark):
    random.seed(3)
    for n in (1, 2, 5, 12):
        sizes = [random.choice((0, 3, 10, 1000, 50_000)) for _ in range(n)]
        if not sum(sizes):
            sizes[0] = 5
        names = [f"s{i:02d}" for i in range(n)]
        found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long"), mixing.Settings()).collect()}
        for name, wanted in zip(names, fixpoint(sizes, [(1, 2, 3)[i % 3] for i in range(n)], 3)):
            assert abs(found[name] - wanted) <= 1e-6 * max(wanted, 1)


def test_seats_are_those_of_the_highest_quotients(spark):
    random.seed(8)
    for votes, seats in (([100.4] + [0.6] * 90, 150), ([5.0, 5.0, 5.0], 7), ([0.0, 1.0], 3), ([random.random() ** 4 for _ in range(40)], 333), ([3.0, 1.0], 1), ([9.0] * 5, 0)):
        rows = [(i, float(v)) for i, v in enumerate(votes)]
        found = dict(mixing.seats(spark.createDataFrame(rows, "i int, v double"), [], "v", F.lit(seats), "n").select("i", "n").collect())
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in rows if v for k in range(seats)))[:seats]
        wanted = defaultdict(int)
        for _, i in quotients:
            wanted[i] += 1
        assert found == {i: wanted[i] for i, _ in rows}


def test_documents(spark, docs):
    rows = [(i, "w " * (i % 37), f"src{i % 4}") for i in range(400)] + [(1000, "x " * 4000, None), (1001, None, "src1"), (7, "same id", "src0"), (7, "same id", "src0"), (None, "no id", "src2")]
    settings = mixing.Settings(shard=700, block=16)
    found = mixing.mix(docs(*rows), settings)
    out = found.collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in out)
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 16 + 0.02 * target[s]
    assert sorted(map(str, mixing.mix(docs(*rows).repartition(7), settings).collect())) == sorted(map(str, out))
    assert mixing.mix(docs()).count() == 0 and mixing.mix(docs((1, None), (2, ""))).agg(F.sum("taken")).first()[0] == 0
    kept = mixing.mixed(docs(*rows), settings)
    assert kept.columns == docs().columns
    # whole documents are kept: their words come near the plan's, to within the documents at the edges of shards
    for s in target:
        words = sum(len((r.text or "").split()) for r in kept.filter(F.col("source").eqNullSafe(F.lit(s))).collect())
        assert abs(words - taken[s]) <= (2000 if s is None else 40)  # half a document


def test_long_documents_are_settled(spark, docs):
    """Documents longer than a shard are all edge: as many are kept as their parts make."""
    rows = [(i, "w " * 900, f"src{i % 3}") for i in range(240)]
    settings = mixing.Settings(shard=700, block=16)
    plan = {r.source: r.words for r in mixing.mix(docs(*rows), settings).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    kept = {r.source: 900 * r["count"] for r in mixing.mixed(docs(*rows), settings).groupBy("source").count().collect()}
    assert all(abs(kept[s] - plan[s]) <= 450 for s in plan) and len(plan) == 3


def test_documents_without_ids(spark, docs):
    """They are dealt out to shards by their sizes, and the sources still come near their targets."""
    rows = [(None, "w " * (1 + i % 97), f"src{i % 2}") for i in range(20_000)] + [(5, "x y", "src0")] * 3000
    out = mixing.mix(docs(*rows), mixing.Settings(shard=5000))
    per = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 64 + 0.01 * r.target for r in per.values()) and out.count() == 23_000


def test_seed_changes_the_choice(spark, table):
    a, b = (mixing.mix(table("documents"), mixing.Settings(seed=s)).select("doc_id", "taken").collect() for s in ("mix", "other"))
    assert sorted(a) != sorted(b)
