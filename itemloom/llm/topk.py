"""Exact top-k search by inner product: MaxScore over shards of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 64
#: Vectors of a shard: each is a task's, which answers all queries as they stream by.
SHARD = 1 << 16
#: Vectors that first thresholds come from.
PROBE = 512


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, more: tuple = ()) -> DataFrame:
    """(vec_id, v, more columns): floor(scale * x) of each component as double. Vectors that are null or hold null or
    non-finite components are left out."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.filter(F.col(column).isNotNull()).filter(finite).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"), *more)


class Shard:
    """Postings by term (dimension): each vector's value above the term's least in the shard, and the term's span.

    Whatever a query's sign, a term's contribution above its least possible one is between 0 and |q| * span, as
    MaxScore's bounds must be; the least ones add up to a constant of the query.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.row, self.ids, self.vectors = rows[order], ids[order], np.ascontiguousarray(vectors[order])
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.postings = np.ascontiguousarray(self.vectors.T)

    def search(self, query: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of the k best vectors but row own, by score, then smaller id, of those that reach floor."""
        low, high = np.minimum(query * self.low, query * self.high), np.maximum(query * self.low, query * self.high)
        order = np.argsort(low - high, kind="stable")
        low, high = low[order], high[order]
        # What the terms from each on can add, at most and at least.
        to_come, to_lose = (np.append(np.cumsum(x[::-1])[::-1], 0.0) for x in (high, low))
        # Non-essential terms: at their most they cannot lift a vector that has the essential ones at their least to the floor.
        first = np.cumsum(low) - low
        essential = max(1, int((first + to_come[: len(query)] >= floor).sum()))
        terms = order[:essential]
        part = query[terms] @ self.postings[terms]
        part[self.row == own] = -np.inf
        at, alive, step = essential, None, max(4, (len(query) - essential) // 3)
        while True:
            if len(part) > k:
                floor = max(floor, float(np.partition(part, -k)[-k]) + to_lose[at])
            keep = part + to_come[at] >= floor
            if alive is None:
                alive = np.flatnonzero(keep & (self.row != own))
                part = part[alive]
            else:
                alive, part = alive[keep], part[keep]
            if at == len(query):
                best = np.lexsort((self.ids[alive], -part))[:k]
                return self.ids[alive][best], part[best]
            # The vectors that are still competitive are probed for the next terms.
            terms = order[at : at + step]
            part = part + self.vectors[np.ix_(alive, terms)] @ query[terms]
            at += len(terms)


def top_k(vectors: DataFrame, is_query, k: int = 20, shard: int = SHARD, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best of all other rows, ties to the smaller id.

    is_query is a condition on vec_id. Every row is in one shard; each query goes to every shard with a floor that its
    k-th best must reach anyway (of a bounded sample that is broadcast), and the shards' lists are merged by a ranking
    that Spark limits before its shuffle. Rows are what counts, not ids: a repeated query row gets a list of its own, and
    another row with a query's id is a candidate like any other. Null ids take no part; shorter vectors count as zero
    beyond their end. Scores are exact while sums stay under 2^53 (larger ones raise). An empty table gives an empty
    result; extra columns are ignored.
    """
    rows = cut(quantised(vectors, key, column, scale).filter("vec_id is not null").withColumn("row", F.monotonically_increasing_id()))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    n, dims = seen.n or 0, seen.d or 0
    if dims * (seen.m or 0.0) ** 2 >= 2.0**53:
        raise ValueError("components are too large for exact scores")
    # At least as many shards as tasks, unless they would be small; a shard's memory is bounded in any case.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // shard), min(tasks, -(-n // 2048)), 1)
    few = sorted((r.row, list(r.v)) for r in rows.orderBy(F.xxhash64("row", F.lit(5)), "row").limit(PROBE).select("row", "v").collect())

    def padded(lists: list, width: int) -> np.ndarray:
        out = np.zeros((len(lists), width))
        for x, v in zip(out, lists, strict=True):
            x[: len(v)] = v
        return out

    def dense(v: pa.ListArray) -> np.ndarray:
        lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        out = np.zeros((len(v), dims))
        out[np.arange(dims) < lengths[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        return out

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, probe = np.array([r for r, _ in few], np.int64), padded([v for _, v in few], dims)
        for b in batches:
            score = dense(b.column(2)) @ probe.T
            score[b.column(1).to_numpy()[:, None] == known] = -np.inf
            best = np.partition(score, -k, axis=1)[:, -k] if len(few) >= k else np.full(b.num_rows, -np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], ["vec_id", "row", "v", "floor"])

    queries = rows.filter(is_query).select("vec_id", "row", "v").mapInArrow(floors, "vec_id long, row long, v array<double>, floor double")
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("s"), F.lit(0).alias("asks"), "vec_id", "row", "v", F.lit(0.0).alias("floor"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.lit(1).alias("asks"), "vec_id", "row", "v", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, known = [], None, None
        for b in batches:
            where = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where)) + 1):
                s, asks = divmod(int(where[part[0]]), 2)
                x = b.slice(int(part[0]), len(part))
                ids, row, v = x.column(2).to_numpy(), x.column(3).to_numpy(), dense(x.column(4))
                if not asks:
                    if s != last:
                        held, last, known = [], s, None
                    held.append((row, ids, v))
                    continue
                if s != last:
                    continue
                if known is None:
                    known, held = Shard(*(np.concatenate(y) for y in zip(*held, strict=True))), []
                got = [known.search(q, own, floor, k) for q, own, floor in zip(v, row.tolist(), x.column(5).to_pylist(), strict=True)]
                count = [len(g[0]) for g in got]
                cols = [np.repeat(ids, count), np.repeat(row, count), np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "row", "vec_id", "score"])

    found = dealt.unionByName(asked).repartitionByRange(shards, "s").sortWithinPartitions("s", "asks").mapInArrow(run, "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
