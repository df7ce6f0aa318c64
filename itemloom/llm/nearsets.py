"""Exact near-dedup: all pairs of texts whose sets of shingles reach a Jaccard similarity, and the components of their links."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, small_batches, written
from .simhash import block_keys, components, fingerprints, near_edges, shingle_hashes

#: Characters of text whose shingles meet in one bucket, and shingles that a task holds before it hands them on.
BUCKET_CHARS, HELD = 6_000_000, 1_000_000
#: A shingle in this many of the sampled texts is ordered last and left out of the count of texts: it is too hot for a bucket.
SAMPLE_TEXTS, HOT = 10_000, 256
_LAST = 1 << 30
#: Keys of up to this many texts propose pairs, which are the same for many keys; larger ones are searched in blocks.
ALL_PAIRS = 64
#: Fingerprints of near texts may differ in this many of their 64 bits; keys are all but RADIUS of these blocks.
RADIUS, BLOCKS = 3, 5
#: Members of a key that are searched for links at once, and about the bytes of their sets.
SHARD, SHARD_BYTES = 512, 16 << 20


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, words))


def prefix(n: np.ndarray, similarity: Fraction) -> np.ndarray:
    """How many of the first shingles of a set of n must hold one of any set that is similar: n - ceil(similarity n) + 1."""
    return n - -(-similarity.numerator * n // similarity.denominator) + 1


def _isin(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _slices(where: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of an ascending array."""
    at = np.flatnonzero(np.diff(where)) + 1
    ends = [*at.tolist(), len(where)] if len(where) else []
    return [(int(where[a]), a, b) for a, b in zip([0, *at.tolist()], ends, strict=False)]


def _grouped(batches: Iterator[pa.RecordBatch], types: list[str]) -> Iterator[list[np.ndarray]]:
    """The joined binary columns of each bucket; rows come ordered by bucket."""
    last, held = None, [[] for _ in types]
    for b in batches:
        for i, k in enumerate(b.column(0).to_pylist()):
            if k != last and held[0]:
                yield [np.concatenate(x) for x in held]
                held = [[] for _ in types]
            last = k
            for x, c, t in zip(held, b.columns[1:], types, strict=True):
                x.append(np.frombuffer(c[i].as_py(), t))
    if held[0]:
        yield [np.concatenate(x) for x in held]


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def hot_shingles(texts: DataFrame, total: int, words: int) -> np.ndarray:
    """Shingles in HOT or more of about SAMPLE_TEXTS texts, ascending; their count is bounded by the sample's words."""
    some = texts.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(max(1, total))) < SAMPLE_TEXTS).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["h"])

    found = some.select("text").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= HOT).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def prefix_keys(texts: DataFrame, similarity: Fraction, words: int) -> DataFrame:
    """(key, node, n, own) of texts (node, text): similar sets share a key, whatever the size of the table.

    Shingles are ordered by the number of texts that hold them, rare ones first, then by value; hot ones come last, by
    value. A set's keys are the shingles of its prefix that another text holds; a set whose prefix is its own has none.
    n is the set's size, own how many of its shingles no other text holds. Shingles travel as packed columns, one row per task and bucket, to be counted; those
    of several texts go back to buckets of texts. A text that occurs again is the same node.
    """
    total, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS + 1)
    hot = hot_shingles(texts, total, words)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                h = shingle_set(t.as_py(), words)
                n, n_hot = len(h), 0
                if len(hot):
                    is_hot = _isin(h, hot)
                    n_hot = int(is_hot.sum())
                    if n_hot:
                        reach = max(0, int(prefix(n, similarity)) - (n - n_hot))
                        h = np.sort(np.concatenate([h[~is_hot], h[is_hot][:reach]]))
                held.append((node, n, n_hot, h))
                size += len(h)
                if size >= HELD:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        node, n, n_hot = (np.array([x[i] for x in held], t) for i, t in enumerate((np.int64, np.int32, np.int32)))
        h = np.concatenate([x[3] for x in held])
        doc = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
        where = _bucket(h, buckets)
        order = np.argsort(where, kind="stable")
        h, doc = h[order], doc[order]
        out: list[list] = [[] for _ in range(6)]
        for k, a, b in _slices(where[order]):
            docs, counts = np.unique(doc[a:b], return_counts=True)
            for x, v in zip(out, (k, h[a:b].tobytes(), node[docs].tobytes(), n[docs].tobytes(), n_hot[docs].tobytes(), counts.astype(np.int32).tobytes()), strict=True):
                x.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["bucket", "h", "node", "n", "n_hot", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, node, n, n_hot, counts in _grouped(batches, ["u8", "i8", "i4", "i4", "i4"]):
            doc = np.repeat(np.arange(len(node), dtype=np.int32), counts)
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            order = order[np.r_[same, False] | np.r_[False, same]]
            order = order[np.lexsort((node[doc[order]], h[order]))]
            s, d = h[order], doc[order]
            if not len(s):
                continue
            new = np.r_[True, (s[1:] != s[:-1]) | (node[d[1:]] != node[d[:-1]])]
            s, d = s[new], d[new]
            _, inverse, df = np.unique(s, return_inverse=True, return_counts=True)
            df = df.astype(np.int32)[inverse]
            many = df > 1
            s, d, df = s[many], d[many], df[many]
            df[_isin(s, hot)] = _LAST
            where = _bucket(node[d].view(np.uint64), buckets)
            order = np.argsort(where, kind="stable")
            s, d, df = s[order], d[order], df[order]
            rows = [(k, s[a:b].tobytes(), df[a:b].tobytes(), node[d[a:b]].tobytes(), n[d[a:b]].tobytes(), n_hot[d[a:b]].tobytes()) for k, a, b in _slices(where[order])]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]], ["bucket", "h", "df", "node", "n", "n_hot"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, df, node, n, n_hot in _grouped(batches, ["u8", "i4", "i8", "i4", "i4"]):
            order = np.lexsort((h, df, node))
            h, df, node, n, n_hot = (x[order] for x in (h, df, node, n, n_hot))
            _, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            shared = np.bincount(inverse, weights=df < _LAST).astype(np.int64)[inverse]
            alone = n.astype(np.int64) - n_hot - shared
            take = np.arange(len(node)) - first[inverse] < prefix(n.astype(np.int64), similarity) - alone
            yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(node[take]), pa.array(n[take]), pa.array(alone[take].astype(np.int32))], ["key", "node", "n", "own"])

    binary = lambda *names: "bucket int, " + ", ".join(f"{x} binary" for x in names)
    out = texts.select("node", "text").mapInArrow(spread, binary("h", "node", "n", "n_hot", "counts"))
    out = _dealt(out, buckets).mapInArrow(counted, binary("h", "df", "node", "n", "n_hot"))
    return _dealt(out, buckets).mapInArrow(chosen, "key long, node long, n int, own int")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, s): the packed set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            nodes, sets = [], []
            for node, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if node not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    nodes.append(node)
                    sets.append(shingle_set(t.as_py(), words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node long, s binary").dropDuplicates(["node"])


def fingerprint_pairs(texts: DataFrame, words: int, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b), a < b: pairs of texts (node, text) that SimHash fingerprints of their sets propose. Texts of one fingerprint
    meet its least node; fingerprints of at most radius differing bits are found by BK-trees, which return the links of a
    spanning forest, so their number is bounded by that of the texts and of the trees that hold them."""
    fps = written(fingerprints(texts.select("node", "text"), words, distinct=True).dropDuplicates(["node"]), "near-prints")
    points = written(fps.groupBy("fp").agg(F.min("node").alias("id")), "near-points")
    equal = fps.join(points.withColumnRenamed("fp", "point"), F.col("fp") == F.col("point")).select(F.col("id").alias("a"), F.col("node").alias("b"))
    links = equal.unionByName(near_edges(points, block_keys(points, 64, radius, blocks), radius))
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity or more."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = common * den >= num * (len(both) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:2]], ["a", "b"])

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, several times as many as its shingles: one per hash value of a shingle."""
    bits = 1 << min(16, max(10, int(np.median([len(x) for x in sets])).bit_length() + 2))
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, x in zip(out, sets, strict=True):
        flags = np.zeros(bits, bool)
        flags[(x & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(flags)
    return out.view(np.uint64)


def _links(sets: list[np.ndarray], roots: np.ndarray, first: np.ndarray, second: np.ndarray, similarity: Fraction) -> list[tuple[int, int]]:
    """Links between sets of first and of second that join different roots and reach the similarity; none that follows
    from others. A bit that only one of two sets has proves a shingle that only it has, which rules most pairs out."""
    num, den = similarity.numerator, similarity.denominator
    n, bitmaps, up, out = np.array([len(x) for x in sets]), _bitmaps(sets), {}, []

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i in first.tolist():
        # Common c of a set of n and one of m must have den * c >= num * (n + m - c).
        j = second[(roots[second] != roots[i]) & (den * np.minimum(n[second], n[i]) >= num * np.maximum(n[second], n[i]))]
        if not len(j):
            continue
        most = np.minimum(n[i] - np.bitwise_count(bitmaps[i] & ~bitmaps[j]).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(bitmaps[j] & ~bitmaps[i]).sum(axis=1, dtype=np.int64))
        for k in j[(den + num) * most >= num * (n[i] + n[j])].tolist():
            a, b = top(int(roots[i])), top(int(roots[k]))
            if a != b:
                both = np.concatenate([sets[i], sets[k]])
                both.sort(kind="stable")
                if (den + num) * int((both[1:] == both[:-1]).sum()) >= num * len(both):
                    up[max(a, b)] = min(a, b)
                    out.append((i, k))
    return out


def links_within(members: DataFrame, similarity: Fraction, shard: int = SHARD) -> DataFrame:
    """(a, b): links that join the components of all members (key, node, root, s) of a key whose sets s are similar.

    A key's members form shards of about that many; each pair of shards is a group of its own, so that no key meets in
    one task. Of a group's similar pairs only links of a spanning forest are returned, never all pairs.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / F.lit(shard), F.sum(F.octet_length("s")) / F.lit(SHARD_BYTES))).cast("int").alias("parts")).withColumnRenamed("key", "k")
    each = members.join(sizes, F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for i, (key, x, y, own, node, root) in enumerate(zip(*cols, strict=True)):
                if (key, x, y) != group:
                    yield from found(group, rows)
                    group, rows = (key, x, y), []
                rows.append((own, node, root, np.frombuffer(b.column(6)[i].as_py(), np.uint64)))
        yield from found(group, rows)

    def found(group: tuple | None, rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        own, node, root = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        links = _links([r[3] for r in rows], root, np.flatnonzero(own == group[1]), np.flatnonzero(own == group[2]), similarity)
        if links:
            a, b = node[np.array(links)].T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def similar_components(texts: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(node, root) of the texts (node, text) that links of at least that similarity join, for every node with a link.

    First the BK-trees of SimHash fingerprints propose pairs, and each key of the sets' prefixes its members with one of
    them, the hub: that with the fewest shingles of its own, as an original has fewer than its edited copies, so that most
    of a group is linked at once; each pair is measured on the sets. Fingerprints miss pairs near the limit, so then the keys
    that still hold several components are searched for all links between these: pairs of the members of small keys, and
    the members of large keys in blocks of bounded size.
    """
    least = Fraction(str(similarity))
    prints = written(fingerprint_pairs(texts, words), "near-proposed")
    keys = written(prefix_keys(texts, least, words), "near-keys")
    hubs = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("own", "node", F.col("n").alias("hn"))).alias("hub")).filter("c > 1")
    keys = written(keys.join(hubs.select(F.col("key").alias("k"), "hub"), F.col("key") == F.col("k")).select("key", "node", "n", "hub"), "near-hubs")
    nodes = written(keys.select(F.col("node").alias("m")).distinct(), "near-nodes")
    sets = written(sets_of(texts.join(nodes, F.col("node") == F.col("m"), "left_semi"), words), "near-sets")
    fits = lambda x, y: least.denominator * F.least(x, y) >= least.numerator * F.greatest(x, y)
    pair = [F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")]
    # Similar texts share a key, so of the pairs that fingerprints propose those of texts without sets can't be similar.
    from_hubs = keys.filter((F.col("node") != F.col("hub.node")) & fits(F.col("n"), F.col("hub.hn"))).select(*pair)
    edges = cut(confirmed(prints.unionByName(from_hubs).distinct(), sets, least))
    roots = components(edges).withColumnRenamed("node", "m")
    known = keys.join(roots, F.col("node") == F.col("m"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    known = written(known, "near-roots")
    open_ = known.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(F.col("key").alias("k"), "c")
    known = written(known.join(open_, F.col("key") == F.col("k")).drop("k"), "near-open")
    small, large = known.filter(F.col("c") <= ALL_PAIRS), known.filter(F.col("c") > ALL_PAIRS)
    other = small.select(*[F.col(c).alias(f"{c}_2") for c in ("key", "node", "n", "root")])
    match = (F.col("key") == F.col("key_2")) & (F.col("node") < F.col("node_2")) & (F.col("root") != F.col("root_2")) & fits(F.col("n"), F.col("n_2"))
    few = small.join(other, match).select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()
    members = large.join(sets.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select("key", "node", "root", "s")
    more = written(confirmed(few, sets, least).unionByName(links_within(members, least)), "near-links")
    return components(edges.unionByName(more))


def near_roots(docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, h): the least row of each group of near texts, by key and then by the hash of its text; those without any word,
    null texts too, are one group. A key's different texts are documents of their own."""
    has = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    nodes = docs.select(F.col(key).cast("long").alias("id"), text_hash(F.col(text)).alias("h"), F.xxhash64(F.lit(7), text).alias("h2"), F.when(has, F.col(text)).alias("text"))
    # Among very many texts some pairs share a hash of 64 bits: those few hashes (n * n / 2 ** 65 of n texts) are told apart
    # by a second one.
    twice = nodes.filter("text is not null").groupBy("h").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("lo <> hi").select(F.col("h").alias("shared"))
    nodes = nodes.join(F.broadcast(cut(twice)), F.col("h") == F.col("shared"), "left")
    node = F.when(F.col("text").isNotNull(), F.when(F.col("shared").isNotNull(), F.xxhash64("h", "h2")).otherwise(F.col("h")))
    nodes = nodes.select("id", "h", node.alias("node"), "text")
    with small_batches(docs.sparkSession):
        roots = similar_components(nodes.filter("node is not null").select("node", "text"), similarity, words)
    ids = nodes.groupBy("node").agg(F.min(F.struct("id", "h")).alias("least"))
    each = ids.join(roots.select(F.col("node").alias("m"), "root"), F.col("node") == F.col("m"), "left")
    return each.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select("least.id", "least.h").distinct()


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
