"""Repeated substrings across documents: suffix buckets of the texts' bytes, prepared by a difference-cover sample."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, runs, scratch, shared_dir

LENGTH = 400
#: A difference cover of period 73: of any two positions, some shift below 73 takes both to one of these, modulo 73.
COVER, PERIOD = np.cumsum([0, 1, 2, 3, 7, 7, 7, 4, 4, 1]), 73
#: Bytes of a block of texts, and suffixes that a bucket sorts at once.
BLOCK_BYTES, BUCKET = 8 << 20, 2_000_000
#: Suffixes whose fingerprints are computed at once.
_STEP = 1 << 20
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prints:
    """Fingerprints of equally long strings of a text from its prefix sums: 64 bits a lane."""

    def __init__(self, length: int, lane: int = 0):
        self.length, n = length, _STEP + length + 1
        base = _LANES[lane]
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)))

    def __call__(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the strings that begin at these ascending positions; all must end within the text."""
        out = np.empty(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for base in range(0, len(text), _STEP):
                lo, hi = np.searchsorted(at, (base, base + _STEP))
                if lo < hi:
                    part = text[base : base + _STEP + self.length].astype(np.uint64) + np.uint64(1)
                    sums = np.zeros(len(part) + 1, np.uint64)
                    np.cumsum(part * self.power[: len(part)], out=sums[1:])
                    i = at[lo:hi] - base
                    out[lo:hi] = _mix((sums[i + self.length] - sums[i]) * self.inverse[i])
        return out


def blocks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(block, ids, ends, nodes, texts): documents in blocks of some size bytes, in a table bucketed by block, so that
    later joins by block move no text. nodes: 16 bytes that stand for a whole text; texts: zstd, one behind the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def block(name: str) -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64).tolist()
            nodes = [xxhash.xxh3_128_digest(t) for t in texts]
            row = [[int.from_bytes(xxhash.xxh3_64_digest(name), "big", signed=True)], [ids], [ends], [nodes], [zstandard.compress(b"".join(texts), 3)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["block", "ids", "ends", "nodes", "texts"])

        ids, texts, held, made = [], [], 0, 0
        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = (t or "").encode()
                if texts and held + len(t) > size:
                    yield block(f"{part}:{made}")
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield block(f"{part}:{made}")

    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    made = slim.mapInArrow(run, "block long, ids array<long>, ends array<long>, nodes array<binary>, texts binary")
    path = scratch(spark, "suffix-blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "block").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name)


class Names:
    """A block's names, for the buckets that sort them: 48 bits each, and 64 more where they must be exact. Each distinct
    name is sent once, in order, with a mark if the block holds it twice; a bucket answers with a mark for each."""

    def __init__(self, names: np.ndarray, more: np.ndarray | None, buckets: int):
        names = names >> np.uint64(16)
        order = np.argsort(names, kind="stable") if more is None else np.lexsort((more, names))
        same = names[order[1:]] == names[order[:-1]]
        if more is not None:
            same &= more[order[1:]] == more[order[:-1]]
        new = np.append(True, ~same)[: len(order)]
        first = np.flatnonzero(new)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.again = np.diff(np.append(first, len(order))) > 1
        self.names, self.more = names[order[first]], None if more is None else more[order[first]]
        where = ((self.names >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        at = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
        self.parts = [(int(where[lo]), lo, hi) for lo, hi in itertools.pairwise(at) if lo < hi]

    def sent(self, block: int) -> Iterator[pa.RecordBatch]:
        for bucket, lo, hi in self.parts:
            parts = [_packed(self.names[lo:hi]), b"" if self.more is None else self.more[lo:hi].tobytes(), np.packbits(self.again[lo:hi]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block]), *(pa.array([x], pa.binary()) for x in parts)], ["bucket", "block", "names", "more", "again"])

    def marked(self, answers: list[dict] | None) -> np.ndarray:
        """For each name as it was given: whether it stands elsewhere too."""
        found = {a["bucket"]: a["marks"] for a in answers or []}
        out = np.zeros(len(self.names), bool)
        for bucket, lo, hi in self.parts:
            if bucket in found:
                out[lo:hi] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=hi - lo)
        return out[self.which]


def _packed(names: np.ndarray) -> bytes:
    """Ascending names as steps, in 4 bytes each where that is enough."""
    steps = np.diff(names)
    small = not len(steps) or int(steps.max()) < 1 << 32
    return names[:1].tobytes() + bytes([small]) + steps.astype("<u4" if small else "<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u4" if data[8] else "<u8", offset=9)
    return np.cumsum(np.append(np.frombuffer(data, np.uint64, 1), steps.astype(np.uint64)))


_SENT = "bucket int, block long, names binary, more binary, again binary"
_FOUND = "block long, found struct<bucket: int, marks: binary>"


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket at a time and tell each block which of its names stand elsewhere too."""
    for (bucket,), (owner, names, more, again) in runs(batches, 1):
        each = [_unpacked(x) for x in names]
        n = [len(x) for x in each]
        h = np.concatenate(each)
        m = np.frombuffer(b"".join(more), np.uint64) if more[0] else np.zeros(len(h), np.uint64)
        hit = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for x, c in zip(again, n, strict=True)]).astype(bool)
        order = np.lexsort((m, h)) if more[0] else np.argsort(h)
        same = (h[order[1:]] == h[order[:-1]]) & (m[order[1:]] == m[order[:-1]])
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at = np.cumsum([0, *n]).tolist()
        out = [(b, {"bucket": bucket, "marks": np.packbits(hit[lo:hi]).tobytes()}) for b, lo, hi in zip(owner, at[:-1], at[1:], strict=True) if hit[lo:hi].any()]
        if out:
            kind = pa.struct([("bucket", pa.int32()), ("marks", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out]), pa.array([x for _, x in out], kind)], ["block", "found"])


def _within(ends: np.ndarray, at: np.ndarray, length: int, skip: np.ndarray) -> np.ndarray:
    """Those of some positions of a block whose string of this length ends within their document, without skipped documents."""
    doc = np.searchsorted(ends, at, side="right")
    doc, at = doc[doc < len(ends)], at[doc < len(ends)]
    return at[(at + length <= ends[doc]) & ~skip[doc]]


def _samples(size: int, period: int, cover: np.ndarray) -> np.ndarray:
    at = (np.arange(-(-size // period))[:, None] * period + cover).ravel()
    return at[at < size]


def _candidates(size: int, ends: np.ndarray, skip: np.ndarray, samples: np.ndarray, length: int, period: int) -> np.ndarray:
    """The suffixes that reach one of these samples within the period, and are long enough."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, np.maximum(samples - period + 1, 0), 1)
    np.add.at(mark, samples + 1, -1)
    return _within(ends, np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int32) > 0), length, skip)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET, cover: np.ndarray = COVER, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): one row per row of docs.

    removed: maximal runs (start, end exclusive) of bytes of the text that strings of length bytes cover which begin
    somewhere else too, in this or another document; kept: the other bytes. Strings are judged on the input.

    A string of length bytes that stands twice has, within its first period bytes, a position of the difference cover that
    both places sample; from there length - period + 1 bytes are equal. So samples alone (a seventh of the positions) are
    named and ranked first, and only suffixes before a sample whose rank is shared are sorted at all: in buckets, one at a
    time, by fingerprints of 112 bits of their first length bytes. Each block of texts sends a name once and gets a mark
    for it, so a passage in a third of all documents is a name of each block; copies of a whole text are represented by one. Memory is bounded by
    block_bytes and bucket, whatever repeats.

    Null text is empty; null and repeated keys are rows like any other; repeated rows repeat each other; an empty table
    gives an empty result; extra columns are left out.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    held = blocks(docs, key, text, block_bytes)
    nodes = held.select("block", F.posexplode("nodes").alias("i", "node"))
    groups = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("block", "i")).alias("least")).filter("n > 1")
    copies = nodes.join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"))
    # Of each document that has copies: its place in its block, negative (from -1) if another one stands for it.
    is_first = (F.col("least.block") == F.col("block")) & (F.col("least.i") == F.col("i"))
    copies = cut(copies.groupBy("block").agg(F.collect_list(F.when(is_first, F.col("i")).otherwise(-1 - F.col("i"))).alias("copies")))
    seen = held.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    depth = length - period + 1

    def unpacked(b: pa.RecordBatch):
        """(block, text, ends, documents that others stand for, documents with copies, names found so far...) of each row."""
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            ends = np.array(r["ends"], np.int64)
            skip, same = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
            for x in r["copies"] or []:
                same[x if x >= 0 else -1 - x] = True
                if x < 0:
                    skip[-1 - x] = True
            yield r, np.frombuffer(zstandard.decompress(r["texts"]), np.uint8), ends, skip, same

    def sampled(t: np.ndarray, ends: np.ndarray, skip: np.ndarray, prints: Prints) -> tuple[np.ndarray, Names]:
        at = _within(ends, _samples(len(t), period, cover), depth, skip)
        return at, Names(prints(t, at), None, buckets)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(depth)
        for b in batches:
            for r, t, ends, skip, _ in unpacked(b):
                yield from sampled(t, ends, skip, prints)[1].sent(r["block"])

    def reached(r: dict, t: np.ndarray, ends: np.ndarray, skip: np.ndarray, prints: list[Prints]) -> tuple[np.ndarray, Names]:
        at, names = sampled(t, ends, skip, prints[0])
        at = _candidates(len(t), ends, skip, at[names.marked(r["samples"])], length, period)
        return at, Names(prints[1](t, at), prints[2](t, at), buckets)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = [Prints(depth), Prints(length), Prints(length, 1)]
        for b in batches:
            for r, t, ends, skip, _ in unpacked(b):
                if r["samples"]:
                    yield from reached(r, t, ends, skip, prints)[1].sent(r["block"])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = [Prints(depth), Prints(length), Prints(length, 1)]
        for b in batches:
            for r, t, ends, skip, same in unpacked(b):
                at = np.zeros(0, np.int64)
                if r["suffixes"]:
                    at, names = reached(r, t, ends, skip, prints)
                    at = at[names.marked(r["suffixes"])]
                starts = np.concatenate([[0], ends[:-1]])
                mark = np.zeros(len(t) + 1, np.int32)
                mark[at] += 1
                mark[at + length] -= 1
                # A whole text that stands elsewhere goes, if it is long enough.
                full = np.flatnonzero(same & (ends - starts >= length))
                np.add.at(mark, starts[full], 1)
                np.add.at(mark, ends[full], -1)
                gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
                out = []
                for i, lo, hi in zip(r["ids"], starts.tolist(), ends.tolist(), strict=True):
                    g = gone[lo:hi]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).view(np.int8))).tolist()
                    spans = [{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    out.append((i, hi - lo, spans, t[lo:hi][~g].tobytes() if spans else t[lo:hi].tobytes()))
                for k in range(0, len(out), 1000):
                    cols = zip(*out[k : k + 1000], strict=True)
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "removed", "kept"])

    def asked(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("block").agg(F.collect_list("found").alias(name))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("block", "its")
        return left.join(right.hint("shuffle_hash"), F.col("block") == F.col("its"), "left").drop("its")

    buckets = max(-(-seen * len(cover) // period // bucket), int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = joined(held.select("block", "ends", "texts"), copies)
    names = base.mapInArrow(ranked, _SENT)
    samples = cut(asked(names.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted, _FOUND), "samples"))
    names = joined(base, samples).mapInArrow(suffixes, _SENT)
    found = cut(asked(names.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted, _FOUND), "suffixes"))
    every = joined(joined(joined(held.select("block", "ids", "ends", "texts"), copies), samples), found)
    return every.mapInArrow(removed, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
