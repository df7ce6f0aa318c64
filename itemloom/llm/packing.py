"""Best-fit-decreasing packing of documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, small_batches, without

CAPACITY = 4096
END_ID = 1


class Capacities:
    """A segment tree over remaining capacities 0..capacity: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.base)

    def set(self, r: int, on: bool) -> None:
        i = self.base + r
        self.some[i] = on
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least least, in logarithmic time."""
        i = self.base + least
        if self.some[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows (length, first, last, bin, per_bin, offset).

    Pieces of a length, by rank from 0: those of ranks first to last - 1 go to bins from bin on, per_bin to each, the
    first of a bin at offset. The outcome is that of placing piece by piece, longest first, each into the tightest open
    bin: a bin that has just taken a piece is the tightest for the next equal one while it fits, so equal pieces fill
    bins of one remaining capacity one after the other, and runs of bins with equal content are handled at once.
    The size of the plan depends on the capacity, not on the number of pieces.
    """
    tree, runs, out, bins = Capacities(capacity), {}, [], 0

    def leave(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            runs.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r, per = capacity, capacity // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                first, n = runs[r].pop()
                if not runs[r]:
                    tree.set(r, False)
                per = r // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, rank + full * per, first, per, capacity - r))
                rank, left = rank + full * per, left - full * per
                leave(r - per * length, first, full)
            part = left if full < n else 0
            if part:
                out.append((length, rank, rank + part, first + full, part, capacity - r))
                rank, left = rank + part, 0
                leave(r - part * length, first + full, 1)
            if r < capacity:
                leave(r, first + full + bool(part), n - full - bool(part))
    return out


PLAN = "p_length int, p_first long, p_last long, p_bin long, p_per long, p_offset int"


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: every piece has a place, and no two places overlap.

    Lengths are 1 to capacity (a piece of null or no length has no place: both null). Only the histogram of lengths,
    of at most capacity rows, comes to the driver, and only the plan over it, whose size the capacity bounds, is
    broadcast. Pieces get their rank among equals from counts by hash bucket: a window only spans one bucket and
    length, so many equal lengths don't meet in one task. pieces should be cut (it is read twice).
    """
    spark = pieces.sparkSession
    pieces = without(pieces, "sequence_id", "offset")
    k, r, o = named(pieces, "pk_bucket", "pk_rank", "pk_before")
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn(k, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cut(keyed.groupBy(length, k).agg(F.count("*").alias(r)))
    histogram = {int(x[0]): x[1] for x in counts.groupBy(length).agg(F.sum(r)).collect() if x[0] and 0 < x[0] <= capacity}
    # By Arrow, as rows of Python objects would start Python workers on the executors.
    schema = pa.schema([(c, pa.int32() if t == "int" else pa.int64()) for c, t in (x.split() for x in PLAN.split(", "))])
    planned = list(zip(*plan(histogram, capacity), strict=True)) or [()] * len(schema)
    rows = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(planned, schema, strict=True)], schema=schema))
    before = counts.withColumn(o, F.sum(r).over(Window.partitionBy(length).orderBy(k)) - F.col(r)).drop(r)
    (l2, k2) = named(keyed, "pk_length2", "pk_bucket2")
    before = before.withColumnsRenamed({length: l2, k: k2})
    ranked = keyed.withColumn(r, F.row_number().over(Window.partitionBy(length, k).orderBy(*order)) - 1)
    ranked = ranked.join(before, F.col(length).eqNullSafe(F.col(l2)) & (F.col(k) == F.col(k2)), "left").withColumn(r, F.col(r) + F.col(o)).drop(o, k, l2, k2)
    on = (F.col(length) == F.col("p_length")) & (F.col(r) >= F.col("p_first")) & (F.col(r) < F.col("p_last"))
    out = ranked.join(F.broadcast(rows), on, "left")
    i = F.col(r) - F.col("p_first")
    out = out.withColumn("sequence_id", F.col("p_bin") + F.floor(i / F.col("p_per"))).withColumn("offset", F.col("p_offset").cast("long") + i % F.col("p_per") * F.col(length))
    return out.drop(r, "p_length", "p_first", "p_last", "p_bin", "p_per", "p_offset")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, path: str, drops_space: bool, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text): doc_id, piece, start, length, ids_crc32, and with keep_ids the ids (binary).

    A document's ids, with end_id at its end, are cut into pieces of capacity; the last may be shorter. Null or empty
    text has the one piece of end_id. ids are little-endian unsigned 32-bit. Extra columns are dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode = encoder(path, drops_space)
        for b in batches:
            at = 0
            for ids, ends in encode.documents(b.column(1), end_id):
                starts = np.append(0, ends[:-1])
                pieces = -(-(ends - starts) // capacity)
                doc = np.repeat(np.arange(len(ends)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lo = starts[doc] + piece * capacity
                hi = np.minimum(lo + capacity, ends[doc])
                parts = [memoryview(ids[i:j]).cast("B") for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                arrays = [b.column(0).take(pa.array(doc + at)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(hi - lo), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                arrays += [pa.array(map(bytes, parts), pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])
                at += len(ends)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def pack_documents(docs: DataFrame, path: str, drops_space: bool = True, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Whole documents as packed pieces. Repeated rows are packed as often as they occur; an empty table gives none."""
    with small_batches(docs.sparkSession):
        pieces = cut(cut_documents(docs, path, drops_space, capacity, end_id))
    return pack(pieces, capacity=capacity)
