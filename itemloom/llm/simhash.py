"""SimHash near-dedup: fingerprints, BK-trees over shards of them, and the components of their links."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, named, runs, written

#: Fingerprints of a tree, and bytes of trees that are broadcast at once.
SHARD, TREE_BYTES = 512, 32 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, A-Z lower-cased; fewer words: of the whole sequence; none: nothing."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(42)), np.uint64)


def spread(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes for another 64 bits; lane 0 leaves them."""
    if not lane:
        return h
    x = h + np.uint64(lane) * _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(h: np.ndarray, bits: int = 64) -> bytes:
    """The fingerprint, most significant bit first: a bit is set if it is set in over half of the hashes."""
    out = []
    for lane in range(bits // 64):
        total, x = np.zeros(64, np.int64), spread(h, lane).astype(">u8").view(np.uint8).reshape(-1, 8)
        for i in range(0, len(x), 1 << 16):
            total += np.unpackbits(x[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
        out.append(np.packbits(2 * total > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, text: str = "text", distinct: bool = False) -> DataFrame:
    """docs without the text, with fp (binary of bits / 8 bytes), of all shingles or of the distinct ones. Null text and text
    without words: zero."""
    cols = [c for c in docs.columns if c != text]
    (fp,) = named(docs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                hashes = (shingle_hashes(t, words) for t in b.column(len(cols)).to_pylist())
                got = [simhash(np.unique(h) if distinct else h, bits) for h in hashes]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.binary())], names=[*cols, fp])

    slim = docs.select(*cols, text)
    schema = slim.drop(text).schema.add(fp, "binary")
    return slim.mapInArrow(run, schema)


class Tree:
    """A BK-tree over fingerprints: a child hangs at its parent's edge of their Hamming distance."""

    def __init__(self, points: np.ndarray):
        self.points = points
        rows = [int.from_bytes(p.tobytes(), "big") for p in points]
        children: list[dict[int, int]] = [{} for _ in rows]
        for i in range(1, len(rows)):
            at = 0
            while True:
                d = (rows[at] ^ rows[i]).bit_count()
                nxt = children[at].get(d)
                if nxt is None:
                    children[at][d] = i
                    break
                at = nxt
        edges = sorted((p, d, c) for p, kids in enumerate(children) for d, c in kids.items())
        self.key = np.array([p * 8192 + d for p, d, _ in edges], np.int64)
        self.child = np.array([c for _, _, c in edges], np.int64)
        self.visited = 0

    @classmethod
    def grown(cls, blob: bytes) -> tuple[np.ndarray, Tree]:
        """(ids, tree) as built elsewhere."""
        t = cls.__new__(cls)
        ids, t.points, t.key, t.child = pickle.loads(blob)
        t.key, t.child, t.visited = t.key.astype(np.int64), t.child.astype(np.int64), 0
        return ids, t

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs of at most radius differing bits; all queries go down the tree together, a level at a
        time, and follow only the edges that the triangle inequality leaves."""
        q, at = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_q, found_p = [], []
        while len(q):
            self.visited += len(q)
            d = np.bitwise_count(queries[q] ^ self.points[at]).sum(axis=1, dtype=np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_p.append(at[hit])
            lo = np.searchsorted(self.key, at * 8192 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, at * 8192 + d + radius, side="right")
            n = hi - lo
            q = np.repeat(q, n)
            at = self.child[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(q))] if len(q) else at[:0]
        return (np.concatenate(found_q), np.concatenate(found_p)) if found_q else (q, at)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each of n points the least point that links (a, b) lead to."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def block_keys(points: DataFrame, bits: int, radius: int, blocks: int) -> DataFrame:
    """(id, key) of which two fingerprints share one if at most radius bits differ: of equal blocks, radius at most hold
    a difference, so all choices of blocks - radius of them are taken."""
    hexa, step = F.hex("fp"), bits // 4 // blocks
    part = [hexa.substr(1 + i * step, step if i < blocks - 1 else bits // 4) for i in range(blocks)]
    keys = [F.xxhash64(F.lit(k), *[part[i] for i in c]) for k, c in enumerate(itertools.combinations(range(blocks), blocks - radius))]
    return points.select("id", F.explode(F.array(*keys)).alias("key"))


def near_edges(points: DataFrame, keys: DataFrame, radius: int, shard: int = SHARD, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """(a, b): links that join all points (id, fp) with a common key (id, key) and at most radius differing bits.

    Keys with one point are left out before fingerprints travel. The points of a key form shards of about shard
    fingerprints, each a BK-tree that is built once. A key of one shard is searched where its tree is built. The trees of
    hot keys are broadcast, some tree_bytes at a time, and all points of their keys pass by; after each batch its links are
    written and the broadcast ends, so no machine ever holds more. Of a tree's hits only links of a spanning forest are
    returned, never all pairs.
    """
    spark = points.sparkSession
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "k")
    each = keys.join(sizes, F.col("key") == F.col("k")).drop("k")
    parts = F.ceil(F.col("n") / F.lit(shard)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int")
    each = each.join(points.select(F.col("id").alias("p"), "fp"), F.col("id") == F.col("p"))
    each = each.select("key", own.alias("own"), "id", "fp", (parts > 1).alias("hot"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lone = each.filter("NOT hot").select("key", "own", "id", "fp").repartition(n, "key", "own").sortWithinPartitions("key", "own", "id").mapInArrow(lambda it: _lone(it, radius), "a long, b long")
    hot = cut(each.filter("hot").select("key", "own", "id", "fp"))
    trees = cut(hot.repartition(n, "key", "own").sortWithinPartitions("key", "own", "id").mapInArrow(_planted, "key long, own int, tree binary"))
    size = trees.agg(F.sum(F.octet_length("tree"))).first()[0] or 0
    # A batch is a bucket of a hash: a fifth is left for uneven ones.
    batches = -(-size * 5 // (tree_bytes * 4))
    for i in range(batches):
        held: dict[int, list] = {}
        for r in trees.filter(F.pmod(F.xxhash64("key", "own", F.lit(9)), F.lit(batches)) == i).collect():
            held.setdefault(r.key, []).append((r.own, bytes(r.tree)))
        known = spark.sparkContext.broadcast(held)
        found = written(hot.mapInArrow(_asking(known, radius), "a long, b long"), "tree-links")
        known.destroy()
        lone = lone.unionByName(found)
    return lone


def _rows(t: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), _words(t.column(3).to_pylist())


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def _links(ids: np.ndarray, q: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the hits between some points, by their ids."""
    at, both = np.unique(np.concatenate([q, p]), return_inverse=True)
    top = forest(len(at), both[: len(q)], both[len(q) :])
    pair = [(ids[at[k]], ids[at[r]]) for k, r in enumerate(top) if r != k]
    a, b = zip(*pair, strict=True) if pair else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _lone(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for _, (ids, fps) in runs(batches, 2):
        w = _words(fps)
        if len(ids) > 1:
            yield _links(np.array(ids, np.int64), *Tree(w).within(w, radius))


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key, own), (ids, fps) in runs(batches, 2):
        t = Tree(_words(fps))
        blob = pickle.dumps((np.array(ids, np.int64), t.points, t.key.astype(np.int32), t.child.astype(np.int32)), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([own], pa.int32()), pa.array([blob], pa.binary())], ["key", "own", "tree"])


def _asking(known, radius: int):
    """Points of hot keys ask the trees of their key: of two shards the lower one's points ask the higher one's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown: dict[int, list] = {}
        for b in batches:
            key, own, ids, fp = _rows(b)
            order = np.argsort(key, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                k = int(key[some[0]]) if len(some) else None
                if k not in known.value:
                    continue
                if k not in grown:
                    grown = {k: [(o, *Tree.grown(t)) for o, t in known.value[k]]}
                for o, its, tree in grown[k]:
                    ask = some[own[some] <= o]
                    q, p = tree.within(fp[ask], radius)
                    if len(q):
                        # A point and its copy in the tree are one: both stand under their id.
                        every, at = np.unique(np.concatenate([ids[ask], its]), return_inverse=True)
                        yield _links(every, at[q], at[len(ask) + p])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that links (a, b) lead to, for every node of edges.

    Alternating large-star and small-star rounds: every node's neighbours are tied to its least one, so that links
    turn into stars whatever a component's shape; each round is checkpointed, and the rounds end when one changes nothing.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    last = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if state == last or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        e = cut(small.filter("a <> b").distinct())


def near_components(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 2, blocks: int = 4, shard: int = SHARD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs.

    Rows with one fingerprint are one point, known by its least key. Points with at most radius differing bits are found
    exactly (by blocks). component_id is the least key that links lead to. Null and empty texts have fingerprint zero and link as any
    other; rows of null key take part (their component is null only if it has no key at all). An empty table gives an empty
    result. Extra columns are dropped.
    """
    fps = cut(fingerprints(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), words, bits))
    points = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    keyed = points.filter("id is not null")
    roots = components(near_edges(keyed, block_keys(keyed, bits, radius, blocks), radius, shard))
    named_ = points.join(roots, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("point"), F.coalesce("root", "id").alias("component_id"))
    return fps.join(named_, F.col("fp") == F.col("point"), "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without near copies: of each group the row of least key stays, of a key's rows in it the one whose text has the
    least hash, and of equal rows one.

    Two texts are near if the Jaccard similarity of their sets of shingles is at least that; SimHash fingerprints in BK-trees
    and prefixes of the sets propose pairs, so that all such pairs are found, and no others as each is measured (nearsets.py);
    links join groups. Rows with one key and different texts are different documents.
    Texts of fewer words than a shingle are compared as whole sequences; those without any word, null texts too, are one
    group. Rows of null key stay. An empty table gives an empty result; extra columns pass through.
    """
    from .nearsets import near_roots, text_hash

    c, h, own = named(docs, "nd_root", "nd_root_text", "nd_text")
    roots = cut(near_roots(docs.filter(F.col(key).isNotNull()), similarity, words, text, key).toDF(c, h))
    each = docs.withColumn(own, text_hash(F.col(text)))
    kept = each.join(roots, (F.col(key).cast("long") == F.col(c)) & (F.col(own) == F.col(h)), "left_semi")
    return kept.dropDuplicates([key, own]).drop(own).unionByName(docs.filter(F.col(key).isNull()))
