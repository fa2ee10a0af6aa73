"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two bits differ in at most
one bit in one of their two halves. So each fingerprint is indexed under 64
keys: one half with one bit taken out. Fingerprints that are near each other
share a key; the rows are dealt out and sorted by key, and the members of a
key are verified by their differing bits.

A key with more than BUCKET members isn't paired out. Its members are indexed
under all points that differ in at most one bit from the whole fingerprint:
two fingerprints share such a point exactly if they differ in two bits at
most, and at most 65 fingerprints lie around a point, so each is linked to
the least one there. Both ways together are exact, and rows stay in
proportion to the fingerprints.

Copies have one fingerprint and are one node. Components are found by
alternating star contractions with a checkpoint each round.

Defined cases: a null or empty text has fingerprint zero and is linked like
any other; rows without doc_id keep their fingerprint and get the smallest
id of their component (null if it has none); repeated rows are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, map_rows, staged
from .components import components
from .parts import hashes_of, in_blocks, verified_links

#: Members of a key that are compared in pairs.
BUCKET = 24
CHUNK = 1 << 16
#: Documents of one fingerprint beyond which they are dealt out by a salt, and the number of salts.
COPIES, SALTS = 500, 64
#: Bits that similar texts carry beside each key.
PROBE = 40
MASK = (1 << 64) - 1


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of the word shingles, as a signed integer."""
    return fingerprint_words(text, width, 1)[0]


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits for each hash: a multiply-xorshift mixer with an offset for each k."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_words(text: str | None, width: int, count: int) -> list[int]:
    """A SimHash of count times 64 bits, as signed integers; the first is of the hashes themselves."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and spaces only
    if not words:
        return [0] * count
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    digest, ones = partial(xxhash.xxh64_intdigest, seed=42), np.zeros((count, 64), np.int64)
    for low in range(0, n, CHUNK):
        size = min(CHUNK, n - low)
        hashes = np.fromiter(map(digest, islice(shingles, size)), np.uint64, size)
        for k in range(count):
            some = remixed(hashes, k) if k else hashes
            ones[k] += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits)."""
    return map_rows(docs.select(id_col, text_col), lambda ids, texts: [ids, [fingerprint(t, width) for t in texts]], "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """The 64 keys of each fingerprint: number of half and bit, and the half without the bit."""
    at = F.col("at")
    half = F.when(at >= 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    taken_out = F.expr("~shiftleft(1L, at % 32)")
    return distinct.select("fp", F.explode(F.array(*map(F.lit, range(64)))).alias("at")).select(
        "fp", F.shiftleft(at.cast("long"), 32).bitwiseOR(half.bitwiseAND(taken_out)).alias("key")
    )


def bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def verify(batches: Iterator[pa.RecordBatch], most: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links (a, b), and (a, null) for the members of full keys.

    A pair is given for the first key it shares only. Of a key that goes on in
    the next batch, at most bucket members are kept.
    """
    key, fp, full = np.empty(0, np.int64), np.empty(0, np.int64), None

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[opens, len(key)])
        large = np.repeat(sizes > bucket, sizes)
        hot, key, fp = fp[large], key[~large], fp[~large]
        links = [(np.empty(0, np.int64),) * 2]
        for d in range(1, bucket):
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                break
            a, b, at = fp[same], fp[same + d], key[same] >> 32
            differ = a ^ b
            low, high = differ & 0xFFFFFFFF, (differ >> 32) & 0xFFFFFFFF
            mine, other = np.where(at < 32, low, high), np.where(at < 32, high, low)
            first = np.where(mine == 0, at % 32 == 0, True) & ((at < 32) | (bits(other) > 1))
            good = first & (bits(differ) <= most)
            links.append((a[good], b[good]))
        a, b = (np.concatenate(x) for x in zip(*links))
        return pa.RecordBatch.from_arrays([pa.array(np.r_[a, hot]), pa.concat_arrays([pa.array(b), pa.nulls(len(hot), pa.int64())])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.r_[key, batch.column(0).to_numpy()]
        fp = np.r_[fp, batch.column(1).to_numpy()]
        if full is not None:  # the rest of a key that has been given out as full
            rest = int(np.searchsorted(key, full, side="right"))
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(fp[:rest]), pa.nulls(rest, pa.int64())], names=["a", "b"])
            if rest == len(key):
                key, fp = key[:0], fp[:0]
                continue
            key, fp, full = key[rest:], fp[rest:], None
        last = int(np.searchsorted(key, key[-1]))
        if len(key) - last > bucket:
            last, full = len(key), key[-1]
        yield found(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
    yield found(key, fp)


def links(distinct: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints: all of them, or as many as keep the components."""
    if most not in (1, 2):
        raise ValueError("two segments of which one differs by at most one bit: most is 1 or 2")
    dealt = variants(distinct).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    with batches_of(distinct.sparkSession, CHUNK):
        found = staged(dealt.mapInArrow(lambda batches: verify(batches, most, bucket), "a long, b long"))
    hot = found.filter("b IS NULL").select("a").distinct()
    if most == 2:
        point = F.when(F.col("at") < 0, F.col("a")).otherwise(F.col("a").bitwiseXOR(F.expr("shiftleft(1L, at)")))
        near = hot.select("a", F.explode(F.array(*map(F.lit, range(-1, 64)))).alias("at")).select("a", point.alias("point"))
        # around a point lie 65 fingerprints at most
        around = near.groupBy("point").agg(F.sort_array(F.collect_list("a")).alias("all")).filter(F.size("all") > 1)
        stars = around.select(F.col("all")[0].alias("a"), F.explode(F.expr("slice(all, 2, size(all))")).alias("b"))
    else:  # bit taken out of the whole: exactly those that differ in it alone
        near = hot.select("a", F.explode(F.array(*map(F.lit, range(64)))).alias("at")).select("a", "at", F.col("a").bitwiseAND(F.expr("~shiftleft(1L, at)")).alias("point"))
        around = near.groupBy("at", "point").agg(F.min("a").alias("a"), F.max("a").alias("b")).filter("a < b")
        stars = around.select("a", "b")
    return found.filter("b IS NOT NULL").unionByName(stars).distinct()


def named(marked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of documents (doc_id, fp), a staged table, by the edges between fingerprints.

    nodes: fp, first_id, copies. If documents have a column shown, it is given as the fingerprint. Documents are joined on their fingerprint,
    but for those with more than COPIES copies, which are joined by a salt as well.
    """
    stars = components(edges)
    linked = stars.join(nodes, stars["node"] == nodes["fp"]).select("node", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "least_id")
    names = staged(nodes.join(linked, "fp", "left").select("fp", "copies", F.coalesce("least_id", "first_id").alias("component_id")))
    # fingerprints of many copies are repeated for each salt, so that their documents are dealt out, whatever their ids:
    # by their places in the written table, which are the same whenever it is read again
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    many = names.filter(F.col("copies") > COPIES).select(F.col("fp").alias("__fp"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"), "component_id")
    few = names.filter(F.col("copies") <= COPIES).select("fp", "component_id")
    salted = marked.withColumn("salt", salt).join(many, (F.col("fp") == F.col("__fp")) & (F.col("salt") == F.col("__salt")), "left")
    shown = "shown" if "shown" in marked.columns else "fp"
    copied = salted.filter("__fp IS NOT NULL").select("doc_id", F.col(shown).alias("print"), "component_id")
    single = salted.filter("__fp IS NULL").select("doc_id", "fp", F.col(shown).alias("print")).join(few, "fp").select("doc_id", "print", "component_id")
    return copied.unionByName(single).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links of at most ``most`` bits)."""
    marked = staged(fingerprints(docs, width, id_col, text_col))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return named(marked, nodes, links(nodes.select("fp"), most, bucket))


# Similar texts: fingerprints that differ in many bits


@dataclass(frozen=True)
class Similar:
    """Settings for a similarity of shingles.

    At a similarity J, fingerprints differ in a share acos(2J / (1 + J)) / pi
    of their bits, 0.15 at 0.8. No few segments can then be sure to
    hold one that differs by a bit at most, so there are more segments than
    that, of which one does so in most cases: 98 % at 0.8, 99.5 % at 0.84.
    The bit bounds lie more than three deviations above what a pair at 0.8 differs in;
    they only spare work, as the shingles decide.
    ``segment`` has to grow with the logarithm of the corpus, as texts by chance
    share a key, and then there are more segments for the same rate: ``of``
    gives both for a number of texts.
    """

    width: int = 5
    words: int = 7  #: of 64 bits, cut into segments
    segment: int = 20  #: bits
    near_first: int = 14  #: bits of the PROBE ones of a further word, which has no segment
    near_all: int = 100  #: bits of all words with segments
    bucket: int = 8  #: members of a key that are compared in pairs; hardly any key has more by chance
    full: int = 2048  #: members of a segment's value beyond which they are held against the least one
    members: int = 256  #: texts that one task verifies together, about
    weight: int = 1 << 20  #: and their shingles
    prints: int = 1024  #: fingerprints that one task holds against each other, about

    @classmethod
    def of(cls, texts: int, recall: float = 0.98, similarity: float = 0.8, **more) -> Similar:
        """Settings for so many texts: a key has two members by chance, at most, and a pair of the similarity
        shares one with the probability ``recall``, at any size."""
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        segment = max(20, math.ceil(math.log2(max(texts, 2))))
        share = (1 - p) ** segment + segment * p * (1 - p) ** (segment - 1)
        words = math.ceil(math.ceil(math.log(1 - recall) / math.log(1 - share)) / (64 // segment))
        above = 4.2 * math.sqrt(64 * words * p * (1 - p))
        return cls(words=words, segment=segment, near_all=math.ceil(64 * words * p + above), **more)

    @property
    def per_word(self) -> int:
        return 64 // self.segment

    @property
    def names(self) -> list[str]:
        return [f"w{k}" for k in range(self.words)]


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each of x with each of y; fingerprints of several words are rows."""
    differ = bits(x[:, None] ^ y[None, :])
    return differ if x.ndim == 1 else differ.sum(axis=2, dtype=np.int32)


def forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that keep the components of fingerprints within ``most`` bits, one fewer than members.

    Each component is walked from a member on; who has been reached isn't compared any more, so a tight group takes
    about one comparison a member.
    """
    parents, children = [], []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            block = front.pop()
            step = max(1, (1 << 18) // len(rest))
            if len(block) > step:
                front.append(block[step:])
                block = block[:step]
            near = distance(fp[block], fp[rest]) <= most
            hit = near.any(axis=0)
            if hit.any():
                parents.append(block[near.argmax(axis=0)[hit]])
                children.append(rest[hit])
                front.append(rest[hit])
                rest = rest[~hit]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *parents]), np.concatenate([empty, *children])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups of rows sorted by their first column."""
    waiting: list[list[np.ndarray]] = []  # of the last group, as long as it goes on
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        new = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        if waiting and waiting[-1][0][-1] != now[0][0]:
            new = np.r_[0, new]
        if not len(new):
            waiting.append(now)
            continue
        last = int(new[-1])
        whole = [np.concatenate(c) for c in zip(*waiting, [c[:last] for c in now])]
        if len(whole[0]):
            yield whole
        waiting = [[c[last:] for c in now]]
    if waiting:
        yield [np.concatenate(c) for c in zip(*waiting)]


def candidates(batches: Iterator[pa.RecordBatch], most: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, fp) sorted by key -> links (a, b, tree) of nodes of one key whose fp are within ``most`` bits.

    All pairs of a key of up to ``bucket`` members; of a larger one a forest, the links of which have ``tree`` set.
    """
    for key, node, fp in groups(batches):
        opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[opens, len(key)])
        a, b = [], []
        for at, n in zip(opens[sizes > bucket], sizes[sizes > bucket]):
            for out, found in zip((a, b), forest(fp[at : at + n], most)):
                out.append(at + found)
        trees = sum(map(len, a))
        small = np.flatnonzero(np.repeat(sizes <= bucket, sizes))
        for d in range(1, bucket):
            x, y = small[:-d], small[d:]
            same = key[x] == key[y]
            if not same.any():
                break
            x, y = x[same], y[same]
            good = bits(fp[x] ^ fp[y]) <= most
            a.append(x[good])
            b.append(y[good])
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        columns = [np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), np.arange(len(a)) < trees]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "b", "tree"])


def own_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs, with all columns and those of keys, by first_id and first_text, the hash of the text."""
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(keys, docs[id_col].eqNullSafe(keys["first_id"]) & (text == keys["first_text"]))


def near_pairs(pairs: DataFrame, nodes: DataFrame, settings: Similar) -> DataFrame:
    """The pairs (a, b) within the bound of all bits."""
    sides = [nodes.select(F.col("node").alias(n), *(F.col(w).alias(f"{n}_{w}") for w in settings.names)) for n in "ab"]
    differ = sum(F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in settings.names)
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(differ <= settings.near_all).select("a", "b")


def segments_of(nodes: DataFrame, settings: Similar) -> DataFrame:
    """Rows (node, probe, no, part): the segments of each fingerprint."""
    s, per = settings.segment, settings.per_word
    parts = [F.shiftrightunsigned(w, s * k).bitwiseAND((1 << s) - 1) for w in settings.names for k in range(per)]
    return nodes.select("node", "probe", F.posexplode(F.array(*parts)).alias("no", "part"))


def full_segments(segments: DataFrame, nodes: DataFrame, settings: Similar) -> tuple[DataFrame, DataFrame | None]:
    """Segments of which no value has more than about ``full`` members, and the links (a, b) that stand for the rest.

    The members of a fuller value are held against its least one, with those of the values
    that differ in a bit: whoever is within twice the bound of all bits is linked to it.
    Members within the bound itself are taken out: what is near one of them is linked, too, by
    the triangle inequality. If more than ``full`` members remain, all are linked and taken out. The links only
    say what has to be verified together. Values are counted before any of it is dealt out.
    """
    hot = staged(segments.groupBy("no", "part").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least")).filter(F.col("members") > settings.full))
    if hot.isEmpty():
        return segments, None
    at = F.explode(F.array(*map(F.lit, range(-1, settings.segment)))).alias("at")
    value = F.when(F.col("at") < 0, F.col("value")).otherwise(F.col("value").bitwiseXOR(F.expr("shiftleft(1L, at)")))
    around = hot.select("no", F.col("part").alias("value"), "least", at).select("no", "value", "least", value.alias("part"), (F.col("at") < 0).alias("own"))
    met = segments.join(around, ["no", "part"]).filter("node <> least").select("no", "value", "least", "node", "own")
    sides = [nodes.select(F.col("node").alias(n), *(F.col(w).alias(f"{n}_{w}") for w in settings.names)) for n in ("node", "least")]
    differ = sum(F.bit_count(F.col(f"node_{w}").bitwiseXOR(F.col(f"least_{w}"))) for w in settings.names)
    met = staged(met.join(sides[0], "node").join(sides[1], "least").select("no", "value", "least", "node", "own", differ.alias("differ")))
    rest = met.filter(F.col("own") & (F.col("differ") > settings.near_all)).groupBy("no", "value").agg(F.count(F.lit(1)).alias("rest"))
    met = met.join(rest, ["no", "value"], "left").withColumn("all", F.coalesce("rest", F.lit(0)) > settings.full)
    linked = met.filter(F.col("all") | (F.col("differ") <= 2 * settings.near_all)).select(F.least("node", "least").alias("a"), F.greatest("node", "least").alias("b"))
    out = met.filter(F.col("own") & (F.col("all") | (F.col("differ") <= settings.near_all))).select("no", "node")
    return segments.join(out, ["no", "node"], "left_anti"), linked.distinct()


def tree_links(trees: DataFrame, nodes: DataFrame, settings: Similar) -> DataFrame:
    """Links within the bound of all bits that keep the components of the nodes of each part of the trees' links."""
    most, names = settings.near_all, settings.names
    parts = components(trees).select("node", F.col("root").alias("part")).join(nodes.select("node", *names), "node")
    packed = F.concat(*(F.unhex(F.lpad(F.hex(w), 16, "0")) for w in names))
    rows = staged(in_blocks(parts.select("part", "node", F.lit(1).alias("size"), packed.alias("hashes")), settings.prints, settings.prints))

    def near(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.stack(prints), most)

    with batches_of(nodes.sparkSession, CHUNK):
        return staged(verified_links(rows, settings.prints, settings.prints, near))


def bit_links(nodes: DataFrame, settings: Similar) -> DataFrame:
    """Links (a, b) that hold together what is near by bits, of nodes (node, probe, w0, w1, ...).

    The pairs of a small key have to be near by all bits. A link of a larger key's tree that isn't near may stand
    between two that are, so trees that meet are one part, and within a part all are held against each other.
    """
    s = settings.segment
    segments, coarse = full_segments(segments_of(nodes, settings), nodes, settings)
    keyed = segments.select("node", "probe", "no", "part", F.explode(F.array(*map(F.lit, range(s)))).alias("at"))
    key = F.shiftleft((F.col("no") * s + F.col("at")).cast("long"), s).bitwiseOR(F.col("part").bitwiseAND(F.expr("~shiftleft(1L, at)")))
    dealt = keyed.select(key.alias("key"), "node", "probe").repartition("key").sortWithinPartitions("key", "node")
    most, bucket = settings.near_first, settings.bucket
    with batches_of(nodes.sparkSession, CHUNK):
        found = staged(dealt.mapInArrow(lambda batches: candidates(batches, most, bucket), "a long, b long, tree boolean"))
    near = near_pairs(found.filter("NOT tree").select("a", "b").distinct(), nodes, settings).unionByName(tree_links(found.filter("tree").select("a", "b"), nodes, settings))
    return near if coarse is None else near.unionByName(coarse)


def similar_links(nodes: DataFrame, docs: DataFrame, settings: Similar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between nodes (node, first_id, first_text, shingles, probe, w0, w1, ...): the exact similarity's,
    or as many of them as keep the components.

    Each text that has a near one is read once.
    """
    parts = components(bit_links(nodes, settings)).select("node", F.col("root").alias("part")).join(nodes, "node")
    parts = in_blocks(parts.select("part", "node", "first_id", "first_text", F.col("shingles").alias("size")), settings.members, settings.weight)
    texts = own_rows(docs.select(id_col, text_col), parts, id_col, text_col).select("part", "node", "size", "blocks", text_col)
    width = settings.width
    sets = map_rows(texts, lambda part, node, size, blocks, text: [part, node, size, blocks, [hashes_of(t, width).tobytes() for t in text]], "part long, node long, size long, blocks long, hashes binary")
    return verified_links(staged(sets), settings.members, settings.weight)


def similar_nodes(docs: DataFrame, settings: Similar, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, node, shingles, fp, probe, w0, ...), and nodes: a set of shingles each."""
    import xxhash

    count, width = settings.words, settings.width
    names = ["probe", *settings.names]

    def run(ids, hashes, texts):
        rows = []
        for t in texts:
            some = hashes_of(t, width)
            node = xxhash.xxh64_intdigest(some.tobytes())
            rows.append([node - (1 << 64) if node >> 63 else node, len(some), *fingerprint_words(t, width, count + 1)])
        columns = list(map(list, zip(*rows))) if rows else [[] for _ in range(count + 3)]
        probes = [x & (1 << PROBE) - 1 for x in columns[-1]]
        return [ids, hashes, *columns[:2], probes, *columns[2:-1]]

    own = docs.select(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), text_col)
    marked = staged(map_rows(own, run, ", ".join(f"{n} long" for n in ["doc_id", "text_hash", "node", "shingles", *names])))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = marked.groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), *(F.min(n).alias(n) for n in ["shingles", *names]))
    return marked, staged(nodes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_text"), "copies", "shingles", *names))


def similar_texts(docs: DataFrame, settings: Similar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id; links are texts whose shingles have a similarity of 0.8 or more.

    As ``near_duplicates``, but for fingerprints that differ in more bits: one-wildcard
    variants of many segments of a longer fingerprint. Which pairs are looked at is a matter of
    chance, at the rates that ``Similar`` states; each is verified on its shingles. Equal
    sets of shingles are one node.
    """
    settings = settings or Similar.of(docs.count())
    marked, nodes = similar_nodes(docs, settings, id_col, text_col)
    links = similar_links(nodes, docs, settings, id_col, text_col)
    return named(marked.select("doc_id", F.col("node").alias("fp"), F.col("w0").alias("shown")), nodes.select(F.col("node").alias("fp"), "first_id", "copies"), links)


def one_of_each(docs: DataFrame, settings: Similar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of similar texts, the one with the least doc_id, with all columns.

    A repeated doc_id stays as often as its texts are first of different components; of
    rows of the same doc_id and text one stays. Rows without doc_id all stay.
    """
    settings = settings or Similar.of(docs.count())
    marked, nodes = similar_nodes(docs, settings, id_col, text_col)
    roots = components(similar_links(nodes, docs, settings, id_col, text_col))
    first = F.min(F.struct("first_id", "first_text")).alias("first")
    grouped = nodes.filter("first_id IS NOT NULL").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(first).select("first.*")
    rows = marked.groupBy(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_text")).agg(F.count(F.lit(1)).alias("copies"))
    chosen = staged(grouped.join(rows, ["first_id", "first_text"]))
    single, many = (own_rows(docs, chosen.filter(c), id_col, text_col).select(docs["*"]) for c in ("copies = 1", "copies > 1"))
    many = many.withColumn("__text", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, "__text"]).drop("__text")
    return single.unionByName(many).unionByName(docs.filter(F.col(id_col).isNull()))
