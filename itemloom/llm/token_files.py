"""Token ids in binary files: canonical length-limited Huffman codes, in blocks that are decoded independently.

A file: blocks one after the other, then its index, then a trailer of 12 bytes. A block: for every STEP ids the bit
offset of their first code (uint32), then the bits, most significant first, padded to bytes. The index: the documents'
ids (int64), null flags (uint8) and lengths (uint32), then for each block its first byte, its ids and its bits (uint64).
The trailer: MAGIC, the index's documents and blocks (uint32). A folder holds a codebook (one length per id, uint8),
the files, and a manifest table that names those that count: files of lost or repeated attempts are not in it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

LIMIT = 18
STEP = 64
BLOCK = 1 << 18
MAGIC = b"ILM1"
END_ID = 2
#: Bytes of text of a part, and ids and documents of a file: bounds of a task's work and memory.
PART_BYTES, FILE_IDS, FILE_DOCS = 128 << 20, 1 << 28, 1 << 22


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (uint8, 0 for ids that don't occur) of an optimal prefix code of at most limit bits, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    depth, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes (uint64): by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for length in np.unique(lengths[order]):
        ids = order[lengths[order] == length]
        code <<= int(length) - last
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, last = code + len(ids), int(length)
    return codes


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int]:
    """A block's bytes and its number of bits."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    bits = int(ends[-1])
    at, shift, code = starts >> 6, 64 - (starts & 63) - n, codes[ids]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    words = np.zeros(-(-bits // 64) + 1, np.uint64)
    whole = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    words[at[first]] = np.bitwise_or.reduceat(whole, first)
    over = np.flatnonzero(shift < 0)
    words[at[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return starts[::STEP].astype("<u4").tobytes() + words.astype(">u8").tobytes()[: -(-bits // 8)], bits


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each pattern of limit bits the id whose code begins it, and the code's length: id << 5 | length."""
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    out = np.zeros(1 << limit, np.uint32)
    full = np.repeat(order.astype(np.uint32) << 5 | lengths[order], spans)
    out[: len(full)] = full
    assert len(order) == 0 or int(codes[order[-1]]) << (limit - int(lengths[order[-1]])) < len(out)
    return out


def decode(block: bytes, n: int, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """A block's n ids. All checkpoints are decoded side by side, one id of each at a time."""
    lanes = -(-n // STEP)
    pos = np.frombuffer(block, "<u4", lanes).astype(np.int64)
    data = block[4 * lanes :] + b"\0" * 8
    peek = np.ndarray((len(data) - 3,), ">u4", buffer=data, strides=(1,))
    out = np.empty((lanes, STEP), np.uint32)
    mask, last = np.uint32((1 << limit) - 1), n - STEP * (lanes - 1)
    for i in range(STEP):
        if i == last:
            lanes, pos = lanes - 1, pos[:-1]
        if not lanes:
            break
        bits = peek[pos >> 3].astype(np.uint32)
        found = table[bits >> (32 - limit - (pos & 7)).astype(np.uint32) & mask]
        out[:lanes, i] = found >> 5
        pos = pos + (found & 31)
    return out.reshape(-1)[:n]


class Writer:
    """One file. It holds a block and the index in memory."""

    def __init__(self, stream, codes: np.ndarray, lengths: np.ndarray):
        self.stream, self.codes, self.lengths = stream, codes, lengths
        self.docs, self.nulls, self.sizes, self.blocks, self.held, self.n, self.at, self.total = [], [], [], [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids))
        self.total += len(ids)
        while len(ids):
            part, ids = ids[: BLOCK - self.n], ids[BLOCK - self.n :]
            self.held.append(part)
            self.n += len(part)
            if self.n == BLOCK:
                self.flush()

    def flush(self) -> None:
        if self.n:
            block, bits = encode(np.concatenate(self.held), self.codes, self.lengths)
            self.blocks.append((self.at, self.n, bits))
            self.stream.write(block)
            self.at, self.held, self.n = self.at + len(block), [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.sizes, "<u4").tobytes() + np.array(self.blocks, "<u8").tobytes()
        self.stream.write(index + MAGIC + struct.pack("<II", len(self.docs), len(self.blocks)))
        self.stream.close()


def read_file(fs: pyarrow.fs.FileSystem, path: str, table: np.ndarray) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of a file's documents, block by block."""
    with fs.open_input_file(path) as f:
        size = f.size()
        magic, docs, blocks = struct.unpack("<4sII", f.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a token file")
        end = size - 12 - 13 * docs - 24 * blocks
        index = f.read_at(size - 12 - end, end)
        ids, nulls = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs)
        sizes = np.frombuffer(index, "<u4", docs, 9 * docs).astype(np.int64)
        places = np.frombuffer(index, "<u8", 3 * blocks, 13 * docs).reshape(-1, 3).astype(np.int64)
        held, have, k, start = [], 0, 0, 0
        for d, null, n in zip(ids.tolist(), nulls.tolist(), sizes.tolist(), strict=True):
            while have < n:
                a, count, bits = places[k].tolist()
                held.append(decode(f.read_at(4 * -(-count // STEP) + -(-bits // 8), a), count, table))
                have, k = have + count, k + 1
            if len(held) > 1:
                held = [np.concatenate(held)]
            yield None if null else d, start, held[0][:n] if n else np.zeros(0, np.uint32)
            if n:
                held = [held[0][n:]]
            have, start = have - n, start + n


def id_counts(spark: SparkSession, folder: str) -> np.ndarray:
    """How often each id occurs, from the tasks' counts; only the vocabulary's sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                n = np.frombuffer(x.as_buffer(), "<i8")
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], ["id", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    rows = files.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r.id for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def tokenize(docs: DataFrame, path: str, drops_space: bool = False, end_id: int = END_ID, counts: str = "", part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, seq, doc_id, ids) of (doc_id, text) in ascending doc_id order, nulls first: part is the range of ids, seq
    the place in it; ids are little-endian unsigned 16-bit (32-bit if the vocabulary has more), with end_id at the end.
    Null text is empty. A part has about part_bytes of text at most, so a task's sort and memory don't grow with the
    table; rows of one doc_id go by a hash of their text and may lie in several parts. counts is a folder that gets a
    file per part with how often each id occurs in it; a repeated task writes the same file again."""
    wide = _wide(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, seq, total, part = encoder(path, drops_space), 0, np.zeros(0, np.int64), None
        for b in batches:
            at = 0
            for ids, ends in encode.documents(b.column(2), end_id):
                n, size = len(ends), 4 if wide else 2
                data = pa.py_buffer(ids.astype(f"<u{size}").tobytes())
                cells = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((np.append(0, ends) * size).astype(np.int64).tobytes()), data])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.arange(seq, seq + n)), b.column(1).slice(at, n), cells.cast(pa.binary())], ["part", "seq", "doc_id", "ids"])
                seq, at = seq + n, at + n
                if counts:
                    some, part = np.bincount(ids), b.column(0)[0].as_py()
                    if len(some) > len(total):
                        some, total = total, some
                    total[: len(some)] += some
        if part is not None:
            fs, root = pyarrow.fs.FileSystem.from_uri(counts)
            name = f"{root}/writing-{uuid.uuid4().hex}"
            with fs.open_output_stream(name) as f:
                f.write(total.astype("<i8").tobytes())
            fs.move(name, f"{root}/part-{part:06d}")

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // part_bytes + 1)
    tie = F.xxhash64("text").alias("tie")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, "part int, seq long, doc_id long, ids binary")


@lru_cache(maxsize=4)
def _wide(path: str) -> bool:
    """Whether ids of a tokenizer need more than 16 bits."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() > 1 << 16


def write_documents(docs: DataFrame, path: str, folder: str, drops_space: bool = False, end_id: int = END_ID, limit: int = LIMIT) -> None:
    """Documents' ids as files in folder. The ids are kept as a table in the shared folder between the two passes: the
    first counts them all, the second codes them. Repeated rows are documents of their own."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/counts", recursive=True)
    tokens = written(tokenize(docs, path, drops_space, end_id, f"{folder}/counts"), "token-ids", "zstd")
    write_files(tokens, folder, id_counts(docs.sparkSession, f"{folder}/counts"), limit, "<u4" if _wide(path) else "<u2")


def write_files(tokens: DataFrame, folder: str, counts: np.ndarray, limit: int = LIMIT, ids: str = "<u4", file_ids: int = FILE_IDS) -> None:
    """Write tokenize()'s rows to files in folder, with codebook and manifest; counts has every id that occurs. A new file
    begins after file_ids ids or FILE_DOCS documents, so that a writer's index stays small."""
    cell = ids
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/files", recursive=True)
    lengths = code_lengths(counts, limit)
    with fs.open_output_stream(f"{root}/codebook") as f:
        f.write(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        codes, writer, known, done = canonical(lengths), None, None, []

        def finish() -> None:
            if writer:
                writer.close()
                done.append((*known, len(writer.docs), writer.total, name))

        for b in batches:
            for part, seq, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if known is None or part != known[0] or seq != known[1] + len(writer.docs) or writer.total >= file_ids or len(writer.docs) >= FILE_DOCS:
                    finish()
                    known, name = (part, seq), f"files/{part:06d}-{seq:012d}-{uuid.uuid4().hex}"
                    writer = Writer(fs.open_output_stream(f"{root}/{name}"), codes, lengths)
                writer.add(d, np.frombuffer(ids.as_buffer(), cell))
        finish()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "seq", "n_docs", "n_tokens", "file"])

    rows = tokens.select("part", "seq", "doc_id", "ids")
    rows.mapInArrow(run, "part int, seq long, n_docs long, n_tokens long, file string").write.parquet(f"{folder}/manifest")


def read_files(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, start, ids) of a folder's documents, one task per file; start counts the ids of all documents before."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/codebook") as f:
        lengths = np.frombuffer(f.read(), np.uint8)
    files = spark.read.parquet(f"{folder}/manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        table = decoding_table(lengths, limit)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for d, start, ids in read_file(fs, f"{root}/{name}", table):
                    held.append((d, before + start, ids.tobytes()))
                    size += ids.nbytes
                    if size > 1 << 22:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    def batch(rows: list) -> pa.RecordBatch:
        d, s, i = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.binary())], ["doc_id", "start", "ids"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, ids binary")
