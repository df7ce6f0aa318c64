"""Hard negatives: candidates in Parquet blocks along a Hilbert curve, whose zone maps tell which blocks an anchor's windows
must read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, written
from .topk import quantised

SCALE = 256
#: Rows of a block, blocks of a task, and anchors of a packet that asks them.
BLOCK, ZONES, ANCHORS = 128, 512, 256
#: Rows that first floors come from.
PROBE = 1024
#: Components that the curve runs through (those that vary most), and bits of each.
CURVE_DIMS, CURVE_BITS = 8, 7
POSITIVES, NEGATIVES = 5, 3
#: 100 times a negative's score lies between these multiples of the positive's.
LOW, HIGH = 50, 95


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each point (rows of integers below 2 ** bits) on a Hilbert curve through all dimensions.

    The coordinates are turned into the curve's transposed index plane by plane from the top, then Gray-decoded and
    interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            up = (x[i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product of each anchor with any vector between low and high of each zone, by
    interval arithmetic: a component contributes between its products with the zone's ends."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def blocks(rows: DataFrame, dims: int, block: int) -> DataFrame:
    """(block, label, ids, vectors, low, high) of rows (vec_id, v, label): a label's rows along the curve, in blocks of block
    rows, with the least and greatest value of each dimension. Written once, in the order of the curve."""
    at = lambda i: F.get("v", F.lit(i))
    seen = rows.agg(*[F.struct(F.stddev_pop(at(i)).alias("s"), F.min(at(i)).alias("lo"), F.max(at(i)).alias("hi")).alias(f"d{i}") for i in range(dims)]).first()
    use = sorted(range(dims), key=lambda i: (-(seen[i].s or 0.0), i))[:CURVE_DIMS]
    low, high = np.array([seen[i].lo or 0.0 for i in use]), np.array([seen[i].hi or 0.0 for i in use])

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((b.num_rows, dims))
            for x, y in zip(v, b.column(1).to_pylist(), strict=True):
                x[: len(y)] = y
            cell = (v[:, use] - low) * ((1 << CURVE_BITS) - 1) // np.maximum(high - low, 1)
            packed = [x.tobytes() for x in v.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(hilbert(cell, CURVE_BITS)), b.column(0), pa.array(packed, pa.binary())], ["label", "place", "vec_id", "vector"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held = None, []

        def made() -> pa.RecordBatch:
            v = _matrix([x for _, x in held])
            row = [[label], [[i for i, _ in held]], [b"".join(x for _, x in held)], [v.min(axis=0).astype("<i4").tobytes()], [v.max(axis=0).astype("<i4").tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["label", "ids", "vectors", "low", "high"])

        for b in batches:
            for k, i, v in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if held and (k != label or len(held) == block):
                    yield made()
                    held = []
                label = k
                held.append((i, v))
        if held:
            yield made()

    placed = cut(rows.select("vec_id", "v", "label").mapInArrow(curve, "label long, place long, vec_id long, vector binary"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The last two order equal vectors, so that a very common one is dealt to several tasks.
    order = ["label", "place", "vec_id", "vector"]
    made = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(gather, "label long, ids array<long>, vectors binary, low binary, high binary")
    return written(made.withColumn("block", F.monotonically_increasing_id()), "hilbert-blocks")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1).astype(np.float64)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """The k highest of the last axis, in any order; at least k, filled with -inf."""
    if score.shape[-1] < k:
        score = np.concatenate([score, np.full((*score.shape[:-1], k - score.shape[-1]), -np.inf)], axis=-1)
    return np.partition(score, -k, axis=-1)[..., -k:]


class Packet:
    """Anchors that ask together, and the windows of scores that each looks for."""

    def __init__(self, row: dict, same: bool, probe: list, k: int):
        self.block, self.place, self.ids, self.label = (np.array(row[c], np.int64) for c in ("blocks", "places", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(len(self.ids), -1).astype(np.float64)
        self.positives, self.k, self.same = row["positives"], k, same
        self.low = np.full((len(self.ids), 1 if same else max([1, *map(len, self.positives)])), -np.inf if same else np.inf)
        self.high = np.full(self.low.shape, np.inf if same else -np.inf)
        for i, some in enumerate(self.positives):
            for j, p in enumerate(some):
                self.low[i, j], self.high[i, j] = -(-LOW * p["score"] // 100), HIGH * p["score"] // 100
        # What a window's k-th best reaches at least.
        self.floor, self.best = self.low.copy(), np.full((*self.low.shape, k), -np.inf)
        if probe:
            block, place, label, vectors = probe
            score = self.vectors @ vectors.T
            score[(self.block[:, None] == block) & (self.place[:, None] == place)] = -np.inf
            score[(self.label[:, None] == label) != same] = -np.inf
            self.floor = np.maximum(self.floor, _top(self._inside(score, np.arange(len(self.ids))), k).min(axis=-1))

    def _inside(self, score: np.ndarray, some: np.ndarray) -> np.ndarray:
        """(anchor, window, row): the scores within each window, else -inf."""
        s = score[:, None, :]
        return np.where((s >= self.low[some][..., None]) & (s <= self.high[some][..., None]), s, -np.inf)

    def needs(self, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the least, the greatest score) of each anchor with the rows of each zone; zones of the wrong label give none."""
        least, most = bounds(self.vectors, low, high)
        wrong = (self.label[:, None] == label) != self.same
        return np.where(wrong, np.inf, least), np.where(wrong, -np.inf, most)

    def read(self, block: int, ids: np.ndarray, vectors: np.ndarray, some: np.ndarray) -> tuple:
        """(anchor, window, score, id) of a block's rows that may be among the k best of some anchors' windows."""
        score = self.vectors[some] @ vectors.T
        mine = np.flatnonzero(self.block[some] == block)
        score[mine, self.place[some][mine]] = -np.inf
        inside = self._inside(score, some)
        self.best[some] = _top(np.concatenate([self.best[some], _top(inside, self.k)], axis=-1), self.k)
        self.floor[some] = np.maximum(self.floor[some], self.best[some].min(axis=-1))
        a, w, r = np.nonzero((inside >= self.floor[some][..., None]) & (inside > -np.inf))
        return some[a], w, inside[a, w, r], ids[r]


def _packets(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors (block, i, vec_id, label, vector, positives) dealt by a hash into packets of at most ANCHORS."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))]
    names = ["blocks", "places", "ids", "labels", "vectors", "positives"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ANCHORS):
                cols = [c.to_pylist() for c in b.slice(at, ANCHORS).columns]
                cols[4] = b"".join(cols[4])
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], names)

    some = anchors.select("block", "i", "vec_id", "label", "vector", "positives").repartition(n, F.xxhash64("block", "i"))
    return some.mapInArrow(run, "blocks array<long>, places array<long>, ids array<long>, labels array<long>, vectors binary, positives array<array<struct<score: long, id: long>>>")


def _search(held: DataFrame, packets: DataFrame, shards: int, same: bool, k: int, probe: list) -> DataFrame:
    """(block, i, anchor_id, positive, score, id): of each anchor's windows the k best rows in each shard of blocks, and ties.

    A shard's blocks stay in a task, packets come by. A packet's anchors look at the zone maps first; blocks are read in
    the order of what they promise, as long as a window's floor and upper end let them hold anything, and only then
    unpacked; what is read lifts the floors.
    """
    place = F.pmod(F.xxhash64("block", F.lit(3)), F.lit(shards)).cast("int")
    asks = packets.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1))
    both = held.withColumn("shard", place).withColumn("kind", F.lit(0)).withColumnRenamed("vectors", "rows").unionByName(asks, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, zones = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}
                if r["shard"].as_py() != shard:
                    shard, own, zones = r["shard"].as_py(), [], None
                if not r["kind"].as_py():
                    own.append((r["block"].as_py(), r["label"].as_py(), r["low"].as_py(), r["high"].as_py(), r["ids"], r["rows"]))
                elif own:
                    if zones is None:
                        zones = (np.array([x[1] for x in own]), _matrix([x[2] for x in own]), _matrix([x[3] for x in own]))
                        unpacked = {}
                    ask = Packet({c: r[c].as_py() for c in ("blocks", "places", "labels", "vectors", "positives")} | {"ids": r["own_ids"].as_py()}, same, probe, k)
                    least, most = ask.needs(*zones)
                    found = []
                    for z in np.argsort(-most.max(axis=0), kind="stable").tolist():
                        some = np.flatnonzero(((most[:, z, None] >= ask.floor) & (least[:, z, None] <= ask.high) & (ask.low <= ask.high)).any(axis=1))
                        if len(some):
                            if z not in unpacked:
                                ids = np.array(own[z][4].as_py(), np.int64)
                                unpacked[z] = (ids, np.frombuffer(own[z][5].as_py(), "<i4").reshape(len(ids), -1).astype(np.float64))
                            found.append(ask.read(own[z][0], *unpacked[z], some))
                    if found:
                        yield best(ask, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def best(ask: Packet, a: np.ndarray, w: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, -score, w, a))
        a, w, score, ids = (x[order] for x in (a, w, score, ids))
        group = a * ask.low.shape[1] + w
        new = np.append(True, group[1:] != group[:-1])[: len(group)]
        rank = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        a, w, score, ids = (x[rank < k] for x in (a, w, score, ids))
        cols = [ask.block[a], ask.place[a], ask.ids[a], w, score.astype(np.int64), ids]
        ask_ = [None if same else ask.positives[i][j] for i, j in zip(a.tolist(), w.tolist(), strict=True)]
        kinds = pa.struct([("score", pa.int64()), ("id", pa.int64())])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(ask_, kinds)], ["block", "i", "anchor_id", "window", "score", "id", "positive"])

    dealt = both.withColumnRenamed("ids", "ids_").withColumn("own_ids", F.when(F.col("kind") == 1, F.col("ids_"))).withColumnRenamed("ids_", "ids")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "block long, i long, anchor_id long, window long, score long, id long, positive struct<score: long, id: long>")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), scores are integer inner products, higher first, ties to the smaller id. An anchor's
    positives are its first other rows of its label; a positive's negatives are the first rows of other labels whose score
    lies between LOW and HIGH hundredths of the positive's. is_anchor is a condition on vec_id. Rows with a null key, label
    or vector, or with a null or non-finite component, take no part. Rows count, not ids: a repeated anchor row has lists of
    its own, and an equal row is a positive like any other. Shorter vectors count as zero beyond their end. Scores are exact
    while sums stay under 2^53 (larger ones raise). An empty table gives an empty result; extra columns are ignored.

    Rows lie in blocks of one label along a Hilbert curve. A block's zone map bounds its scores with an anchor from both
    sides, so only blocks are read that can hold something for one of the anchor's windows and reach what is known already.
    """
    spark = vectors.sparkSession
    (name,) = named(vectors, "hn_label")
    known = vectors.withColumn(name, (F.col(label) if isinstance(label, str) else label).cast("long"))
    rows = cut(quantised(known.filter(F.col(name).isNotNull()), key, column, scale, (F.col(name).alias("label"),)).filter("vec_id is not null"))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    n, dims, most = seen.n, max(seen.d or 0, 1), seen.m or 0.0
    if dims * most**2 >= 2.0**53 or most >= 2.0**31:
        raise ValueError("components are too large for exact scores")
    held = blocks(rows, dims, block)
    tasks, n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), held.count()
    shards = max(1, -(-n_blocks // ZONES), min(tasks, -(-n_blocks // 8)))
    vector = F.substring("vectors", F.col("i") * (4 * dims) + 1, F.lit(4 * dims))
    each = held.select("block", "label", "vectors", F.posexplode("ids").alias("i", "vec_id"))
    each = each.select("block", F.col("i").cast("long").alias("i"), "vec_id", "label", vector.alias("vector"))
    few = each.orderBy(F.xxhash64("block", "i", F.lit(5)), "block", "i").limit(PROBE).collect()
    probe = [np.array([r.block for r in few]), np.array([r.i for r in few]), np.array([r.label for r in few]), _matrix([bytes(r.vector) for r in few])] if few else []
    anchors = written(each.filter(is_anchor), "anchors")
    packets = max(1, -(-anchors.count() // (ANCHORS // 2)))
    none = F.array().cast("array<struct<score: long, id: long>>")
    found = _search(held, _packets(anchors.withColumn("positives", none), packets), shards, True, positives, probe)
    rank = F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("score"), "id"))
    first = found.withColumn("rank", rank).filter(F.col("rank") <= positives).groupBy("block", "i").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("got"))
    first = first.select(F.col("block").alias("b"), F.col("i").alias("j"), F.transform("got", lambda x: F.struct(x.score.alias("score"), x.id.alias("id"))).alias("positives"))
    asked = written(anchors.join(first, (F.col("block") == F.col("b")) & (F.col("i") == F.col("j"))).drop("b", "j"), "anchors-positives")
    found = _search(held, _packets(asked, packets), shards, False, negatives, probe)
    rank = F.row_number().over(Window.partitionBy("block", "i", "window").orderBy(F.desc("score"), "id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
