"""Extendible hashing of documents into shards of a byte limit (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut, hash_bits, named, without

BITS = 60


def _prefix(h: str, depth) -> Column:
    """The first depth bits of a 60-bit hash."""
    return F.expr(f"shiftright({h}, {BITS} - {depth})")


def directory(sizes: DataFrame, limit: int, h: str = "h", size: str = "bytes") -> DataFrame:
    """The directory over hash prefixes: columns lo, hi, depth, prefix, shard_bytes, shard_docs; one row per shard.

    sizes has a 60-bit hash and a byte count per document. A bucket splits on its next bit while it is heavier than
    limit and has two documents at least; a lone document or documents with one whole hash stay. Each round sums
    bytes for cells some bits deeper than the open buckets (as many as their weight asks for), rolls the cells up
    their ancestors, and takes for each cell the shallowest ancestor that fits; only cells without one go on.
    lo and hi are the shard's range of hashes.
    """
    found, open_, depth = None, sizes.select(F.col(h).alias("h"), F.coalesce(size, F.lit(0)).alias("b")), 0
    while True:
        total = open_.agg(F.sum("b").alias("b")).first().b or 0
        deeper = min(BITS, depth + max(4, math.ceil(math.log2(max(1, total / limit))) + 3))
        cells = open_.groupBy(_prefix("h", deeper).alias("cell")).agg(F.sum("b").alias("b"), F.count("*").alias("n"))
        up = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deeper)))).withColumn("prefix", F.expr(f"shiftright(cell, {deeper} - depth)"))
        nodes = up.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        done = F.lit(deeper == BITS) & (F.col("depth") == BITS)
        fit = nodes.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | done)
        best = up.select("cell", "depth", "prefix").join(fit, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        entries = cut(cells.select("cell").join(best, "cell", "left").select("cell", "s.*"))
        leaves = entries.filter("depth is not null").select("depth", "prefix", "shard_bytes", "shard_docs").distinct()
        found = leaves if found is None else found.unionByName(leaves)
        rest = entries.filter("depth is null").select("cell")
        if deeper == BITS or rest.isEmpty():
            break
        open_, depth = cut(open_.join(rest, _prefix("h", deeper) == F.col("cell"), "left_semi")), deeper
    return found.select(F.expr(f"shiftleft(prefix, {BITS} - depth)").alias("lo"), F.expr(f"shiftleft(prefix + 1, {BITS} - depth) - 1").alias("hi"), "depth", "prefix", "shard_bytes", "shard_docs")


def assign(docs: DataFrame, shards: DataFrame, h: str) -> DataFrame:
    """docs with their shard's columns, by a join on the entry of the directory.

    Each shard is expanded to its entries at one level, as in an extendible directory; the few deeper ones (lone
    heavy documents) hang below the entry of that level and are told apart by their range of hashes.
    """
    ends = shards.agg(F.min("depth").alias("a"), F.max("depth").alias("z")).first()
    top = 0 if ends.a is None else min(ends.z, ends.a + 12)
    entry = F.when(F.col("depth") <= top, F.expr(f"sequence(shiftright(lo, {BITS} - {top}), shiftright(hi, {BITS} - {top}))")).otherwise(F.array(F.expr(f"shiftright(lo, {BITS} - {top})")))
    entries = shards.withColumn("entry", F.explode(entry))
    return docs.join(entries, (_prefix(h, top) == F.col("entry")) & F.col(h).between(F.col("lo"), F.col("hi"))).drop("entry", "lo", "hi")


def shard_documents(docs: DataFrame, limit: int, key: str = "doc_id", size: str | None = None) -> DataFrame:
    """docs with shard_depth, shard_prefix, shard_copy, shard_bytes, shard_docs.

    The hash is the first 60 bits of the MD5 of the key as text; size names a column of bytes (else the bytes of text).
    Null keys hash as the empty string, null texts weigh nothing, an empty table gives an empty result; input columns
    with the names of the added ones are replaced. A document heavier than the limit has a shard of its own. Rows with
    one key that together outweigh the limit cannot be told apart by the key's bits: they are numbered among equal
    rows (by a count, never in one task) and split again by a hash of the whole row and that number; shard_copy then
    holds that second prefix as bits, else ''.
    """
    docs = without(docs, "shard_depth", "shard_prefix", "shard_copy", "shard_bytes", "shard_docs")
    h, b = named(docs, "h60", "b60")
    weight = F.col(size) if size else F.octet_length("text")
    keyed = docs.withColumn(h, hash_bits(as_text(F.col(key)), BITS)).withColumn(b, F.coalesce(weight, F.lit(0)).cast("long"))
    shards = cut(directory(cut(keyed.select(h, b)), limit, h, b))
    out = assign(keyed, shards, h).withColumnsRenamed({"depth": "shard_depth", "prefix": "shard_prefix"}).withColumn("shard_copy", F.lit(""))
    heavy = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    if shards.filter(heavy).isEmpty():
        return out.drop(h, b)
    n, i = named(out, "n60", "i60")
    cols = docs.columns
    same = out.filter(heavy).groupBy(*cols, h, b, "shard_depth", "shard_prefix").agg(F.count("*").alias(n))
    each = same.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).withColumn(h, hash_bits(F.concat(F.to_json(F.struct(*cols)), F.lit("#"), F.col(i).cast("string")), BITS))
    again = cut(directory(cut(each.select(h, b)), limit, h, b))
    deal = assign(each, again, h).withColumn("shard_copy", F.substring(F.lpad(F.conv(F.expr(f"shiftleft(prefix, {BITS} - depth)").cast("string"), 10, 2), BITS, "0"), F.lit(1), F.col("depth")))
    kept = out.filter(~heavy).drop(h, b)
    return kept.unionByName(deal.select(*kept.columns))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a shard's rows meet in one task, which its byte limit bounds."""
    sharded.repartition("shard_depth", "shard_prefix", "shard_copy").write.partitionBy("shard_depth", "shard_prefix", "shard_copy").parquet(path)
