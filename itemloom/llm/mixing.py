"""Mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, cut, hash_bits, n_words, named, without, written

#: Up to so many sources (some 10 MB) the plan is broadcast; above, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
WEIGHTS = (5.0, 2.0, 1.0)
#: Seeds that are tried for each source.
SEEDS = 64


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with i: their places in code-point order from 0, null last. Ranges are numbered side by side, from the
    number of rows in the ranges before, so no task sees all sources."""
    dealt = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    before = dealt.groupBy(F.col("range").alias("r")).agg(F.count("*").alias("n"))
    before = before.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("i", place).join(F.broadcast(before), F.col("range") == F.col("r")).withColumn("i", F.col("i") + F.col("before")).drop("range", "r", "before")


def source_plan(sizes: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, weigh weights in turn and share the sum of all sizes; a target stops at
    most times the source's size and the excess is reshared by weight until none is above: it is min(cap, weight *
    level), where level is what the sources below their caps share by weight. Each round sums over the sources.
    """
    s = _numbered(sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("source_size")))
    s = cut(s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size")))
    level, capped = -1.0, -1
    while True:
        full = F.col("cap") / F.col("w") <= level
        got = s.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if got.n == capped or not got.w:
            break
        level, capped = (got.total - got.held) / got.w, got.n
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("cap"), F.col("w") * level).alias("target"))


def draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from a key and a seed."""
    return hash_bits(F.concat(seed.cast("string"), F.lit(":"), as_text(key)), 52) / F.lit(2.0**52)


def _taken(rate: Column, key: Column, seed: Column) -> Column:
    return (F.floor(rate) + (draw(key, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_copies(docs: DataFrame, source: str = "source", key: str = "doc_id", size: str | None = None, weights=WEIGHTS, most: int = 3, seeds: int = SEEDS) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    rate = target / source_size; a document is taken floor(rate) times and once more if its hash-seeded draw is under
    the rest. Each source uses that of the seeds from 0 whose words come nearest its target (the smallest, if several do),
    as a few long documents can carry a draw far off. size names a column (else words of text; null: 0). Null sources
    are one source; sources without words have target 0 and are not taken. Rows with one key share the draw; null keys
    draw as the empty string. Input columns with the names of the added ones are replaced; an empty table gives an empty
    result.
    """
    docs = docs.withColumn("size", F.coalesce(F.col(size), F.lit(0)).cast("long") if size else n_words(F.col("text")))
    docs = without(docs, "source_size", "target", "copies")
    name, chosen = named(docs, "plan_source", "plan_seed")
    sizes = written(docs.select(F.col(source).alias("source"), F.col(key).alias("key"), "size"), "mix-sizes")
    plan = cut(source_plan(sizes, weights=weights, most=most)).withColumnRenamed("source", name)
    few = plan.count() <= BROADCAST_SOURCES
    sent = lambda df: F.broadcast(df) if few else df
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    tried = sizes.join(sent(plan), F.col("source").eqNullSafe(F.col(name))).withColumn("rate", rate)
    tried = tried.filter("size > 0").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    tried = tried.groupBy(F.col("source").alias("s"), "seed", "target").agg(F.sum(F.col("size") * _taken(F.col("rate"), F.col("key"), F.col("seed"))).alias("got"))
    best = tried.groupBy("s").agg(F.min(F.struct(F.abs(F.col("got") - F.col("target")).alias("off"), "seed")).alias("best")).select("s", F.col("best.seed").alias(chosen))
    plan = cut(plan.join(best, F.col(name).eqNullSafe(F.col("s")), "left").drop("s").fillna(0, [chosen]))
    out = docs.join(sent(plan), F.col(source).eqNullSafe(F.col(name))).drop(name)
    return out.withColumn("copies", _taken(rate, F.col(key), F.col(chosen)).cast("int")).drop(chosen)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, with copy (from 1)."""
    out = mix_copies(docs, **options)
    return without(out, "copy").filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
