"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a local session, as in tests, may go
    without and gets a temporary one."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="itemloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """As cut(), but as a Parquet table: smaller for wide or binary rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


#: Bytes of an Arrow batch where tasks hold a batch of whole texts or sets beside their own arrays.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of about that many bytes (one row at least), as each is held
    twice, by the JVM and by Python. The session's setting is put back at the end."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def running(x: Column, op=lambda a, b: a + b) -> Column:
    """Running sums (or another associative op, as F.greatest) of an array: by doubling, so n entries take n log n steps;
    an array that grows in an aggregate would be copied n times."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(2)).cast("double"))).cast("int"))
    back = lambda acc, i, k: F.get(acc, i - F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, x, lambda acc, k: F.transform(acc, lambda v, i: F.when(back(acc, i, k).isNull(), v).otherwise(op(back(acc, i, k), v))))


#: Characters of the blocks that parts of long texts are cut from.
CUT = 4096


def text_blocks(text: Column) -> Column:
    """A text in blocks of CUT code points, for parts_of()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def part_of(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text, of whose blocks only the ones that hold them are looked at: a
    substring of the text itself would walk it from its first character."""
    first = F.floor(start / CUT).cast("int")
    some = F.slice(blocks, first + 1, F.floor((F.greatest(end, start + 1) - 1) / CUT).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), (start - first * CUT + 1).cast("int"), (end - start).cast("int"))


def hash_bits(text: Column, bits: int) -> Column:
    """The first bits (a multiple of 4, at most 60) of the MD5 of a string, as a long: the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def named(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns, none of which df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add: an operator's result wins over an input column of its name."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, the other columns as lists) of each run of rows with equal first columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in itertools.chain(batches, [None]):
        rows = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True)) if b is not None else [None]
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield last, [[x for h in held for x in h.column(c).to_pylist()] for c in range(keys, held[0].num_columns)]
                held, start, last = [], i, key
        if b is not None and start < b.num_rows:
            held.append(b.slice(start))
