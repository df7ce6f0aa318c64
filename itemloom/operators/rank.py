"""Order of chunks for a lesson, and near pairs of vectors."""

from __future__ import annotations

from math import acos, ceil, comb, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from ..tables import cut


def by_relevance(chunks: DataFrame, queries: DataFrame, key: str = "lesson_id") -> DataFrame:
    """Chunks of each key with similarity to its query vector and rank from 1; equal or missing similarities keep
    document order (O1, G14)."""
    out = chunks.join(queries.select(key, F.col("vector").alias("q")), key, "left")
    sim = F.when(F.col("q").isNotNull() & F.col("vector").isNotNull(), cosine(F.col("vector"), F.col("q")))
    out = out.withColumn("similarity", F.coalesce(sim, F.lit(0.0))).drop("q")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "chunk_ord")))


def pool(chunks: DataFrame, lesson_id: str) -> DataFrame:
    """A lesson's own chunks first, then those of its siblings (JN14, U2), with priority 0 and 1."""
    own = chunks.filter(F.col("lesson_id") == lesson_id).withColumn("priority", F.lit(0))
    return own.unionByName(chunks.filter((F.col("lesson_id") != "") & (F.col("lesson_id") != lesson_id)).withColumn("priority", F.lit(1)))


def pools(chunks: DataFrame, lessons: DataFrame) -> DataFrame:
    """The pool of every lesson of a document at once: for_lesson, priority and the chunk."""
    both = lessons.select("doc_id", F.col("lesson_id").alias("for_lesson")).join(chunks.filter("lesson_id <> ''"), "doc_id")
    return both.withColumn("priority", (F.col("lesson_id") != F.col("for_lesson")).cast("int"))


def near_vectors(rows: DataFrame, group: str, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(group, a, b, similarity): pairs a < b of a group with cosine of least or more; groups are runs, of bounded size."""
    left = rows.select(group, F.col(key).alias("a"), F.col(vector).alias("va"))
    right = rows.select(group, F.col(key).alias("b"), F.col(vector).alias("vb"))
    both = left.join(right, group).filter("a < b").withColumn("similarity", cosine(F.col("va"), F.col("vb")))
    return both.filter(F.col("similarity") >= least).select(group, "a", "b", "similarity")


def sign_tables(n: int, least: float, miss: float = 1e-3) -> tuple[int, int]:
    """(tables, bits) for n vectors: the bits grow with the logarithm of n, so that a key's unrelated vectors stay some
    sixteen, and the tables with the bits, so that a pair at least is missed with the same probability at every size."""
    bits = min(30, max(8, n.bit_length() - 4))
    agree = (1 - acos(least) / pi) ** bits
    return ceil(log(miss) / log(1 - agree)), bits


#: Signs of a vector by which pairs of a key are told apart.
SKETCH = 64


def sketch_limit(least: float, miss: float) -> int:
    """In how many of SKETCH signs vectors may differ: those with a cosine of least differ in more with probability miss
    at most."""
    p, tail, k = acos(least) / pi, 1.0, -1
    while tail > miss:
        k += 1
        tail -= comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def near_vectors_blocked(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, seed: int = 5) -> DataFrame:
    """(a, b, similarity) across a corpus: pairs share the signs of some random projections in one of several tables and
    are then checked exactly, so there are no false pairs; a pair at least is missed in one of 1,000 cases, at any
    size. Equal vectors are one class, known by its least id: only classes meet in the tables, so thousands of copies of a
    vector cost what one does, and all their pairs are found. All components count; null vectors take no part, null or
    missing components count as zero in keys only."""
    every = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    classes = cut(every.groupBy("v").agg(F.min("id").alias("c"), F.count("*").alias("n")))
    unit = classes.select(F.col("c").alias("id"), "v")
    n, dims = unit.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tables, bits = sign_tables(n, least, miss=9e-4)
    apart = sketch_limit(least, miss=1e-4)
    planes = np.random.default_rng(seed).standard_normal((max(dims, 1), tables * bits + SKETCH))
    weights = 1 << np.arange(bits)

    @F.pandas_udf("keys array<int>, sketch long")
    def keys_of(v: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(v), max(dims, 1)))
        for i, row in enumerate(v):
            x[i, : len(row)] = np.nan_to_num(np.asarray(row, float))
        signs = x @ planes >= 0
        keys = signs[:, : tables * bits].reshape(len(v), tables, bits) @ weights
        sketch = np.packbits(signs[:, tables * bits :], axis=1).view(np.int64)[:, 0]
        return pd.DataFrame({"keys": list(keys.astype("int32")), "sketch": sketch})

    # Most of what shares a key is unrelated: sketches tell before pairs are sent on.
    keys = unit.select("id", keys_of("v").alias("x")).select("id", "x.sketch", F.posexplode("x.keys").alias("t", "k"))
    side = lambda x: keys.select("t", "k", F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    near = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= apart
    pairs = side("a").join(side("b"), ["t", "k"]).filter("a < b").filter(near).select("a", "b").distinct()
    both = pairs.join(unit.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(unit.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    links = both.select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity")).filter(F.col("similarity") >= least)
    # Members of classes; only classes of several have pairs of their own.
    members = cut(every.join(classes, "v").select("id", "c", "n", "v"))
    of = lambda x: members.select(F.col("c").alias(x), F.col("id").alias(f"{x}_id"))
    across = links.join(of("a"), "a").join(of("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")
    copies = members.filter("n > 1")
    inside = copies.select("c", F.col("id").alias("a"), "v").join(copies.select("c", F.col("id").alias("b")), "c").filter("a < b")
    inside = inside.select("a", "b", cosine(F.col("v"), F.col("v")).alias("similarity")).filter(F.col("similarity") >= least)
    return across.unionByName(inside)
