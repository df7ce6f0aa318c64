"""Quotes and what they are taken from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions.text import collapse, found_in, squeeze, trim_quotes
from ..tables import cut

#: Characters of quotes, in all, that every task gets.
IN_TASKS = 1_000_000


def quotes_in_chunks(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quotes (doc_id, chunk_id, quote) with verbatim; an unknown chunk has none (JN1, JN9)."""
    c = chunks.select("doc_id", "chunk_id", F.col("text").alias("chunk_text"))
    out = quotes.join(c, ["doc_id", "chunk_id"], "left")
    return out.withColumn("verbatim", F.coalesce(found_in(F.col("quote"), F.col("chunk_text")), F.lit(False))).drop("chunk_text")


def quotes_anywhere(quotes: DataFrame, texts: DataFrame, width: int = 12, in_tasks: int = IN_TASKS) -> DataFrame:
    """(item_id, doc_id) of every quote that stands verbatim in a text, white space ignored; null quotes and texts stand
    nowhere.

    Quotes of up to in_tasks characters in all are sent to the tasks, where one automaton finds all of them in one pass
    over each text. More quotes meet the texts by a join: texts are cut into blocks of width characters, end to end, and a
    quote of at least 2 * width - 1 covers whole blocks wherever it stands: for each of the width ways in which blocks can
    fall on it, its block that the fewest texts have is looked up, and the whole quote is then checked. Shorter quotes go
    by smaller blocks; all widths share one pass over the texts.
    """
    q = cut(quotes.select("item_id", squeeze(F.col("text")).alias("q")).filter("q <> ''").distinct())
    t = texts.select("doc_id", squeeze(F.col("text")).alias("t")).filter("t IS NOT NULL")
    if (q.agg(F.sum(F.length("q"))).first()[0] or 0) <= in_tasks:
        return _scanned(q, t)
    w = F.least(F.lit(width), F.floor((F.length("q") + 1) / 2).cast("int"))
    windows = F.transform(F.sequence(F.lit(1), F.length("q") - F.col("w") + 1), lambda i: F.xxhash64("w", F.substring(F.col("q"), i, F.col("w"))))
    own = q.withColumn("w", w).select("item_id", "w", F.posexplode(windows).alias("at", "k")).withColumn("phase", F.col("at") % F.col("w"))
    widths = [r[0] for r in own.select("w").distinct().collect()]
    named = lambda n: lambda x: F.xxhash64(F.lit(n), x)
    blocks = F.flatten(F.array(*[F.transform(F.regexp_extract_all("t", F.lit(f"(?s).{{{n}}}"), F.lit(0)), named(n)) for n in widths]))
    hits = t.select("doc_id", F.explode(F.array_distinct(blocks)).alias("k")).join(own.select("k").distinct(), "k", "left_semi")
    hits = cut(hits)
    seen = own.join(hits.groupBy("k").agg(F.count("*").alias("n")), "k", "left")
    # A way in which some block of the quote stands nowhere is no way.
    rare = seen.groupBy("item_id", "phase").agg(F.count_if(F.col("n").isNull()).alias("none"), F.min_by("k", "n").alias("k")).filter("none = 0")
    pairs = hits.join(rare.select("item_id", "k").distinct(), "k").select("item_id", "doc_id").distinct()
    return pairs.join(q, "item_id").join(t, "doc_id").filter(F.contains("t", F.col("q"))).select("item_id", "doc_id").distinct()


def _scanned(q: DataFrame, t: DataFrame) -> DataFrame:
    known: dict[str, list] = {}
    for r in q.collect():
        known.setdefault(r.q, []).append(r.item_id)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for text, ids in known.items():
            machine.add_word(text, ids)
        if known:
            machine.make_automaton()
        for b in parts:
            docs, items = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some = {i for _, ids in machine.iter(text) for i in ids} if known else ()
                docs += [doc] * len(some)
                items += some
            yield pa.RecordBatch.from_arrays([pa.array(items, item), pa.array(docs, b.schema.field(0).type)], ["item_id", "doc_id"])

    item = to_arrow_type(q.schema["item_id"].dataType)
    schema = StructType([StructField("item_id", q.schema["item_id"].dataType), StructField("doc_id", t.schema["doc_id"].dataType)])
    return t.mapInArrow(find, schema).distinct()


def containing(short: DataFrame, long: DataFrame, by: list[str], width: int = 8) -> DataFrame:
    """(by, s, l): the pairs of distinct texts short.s and long.l of a group where l holds s, none of them empty.

    Each s asks for that of its grams of width characters which the fewest l have; an s with a gram that none has is held
    by none. An s shorter than that asks for itself, so the l are cut at each width that occurs.
    """
    s = cut(short.select(*by, "s").filter("s <> ''").distinct().withColumn("w", F.least(F.lit(width), F.length("s"))))
    l_ = long.select(*by, "l").filter("l <> ''").distinct()
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.xxhash64(n, F.substring(F.col(c), i, n))))
    widths = [r[0] for r in s.select("w").distinct().collect()] or [width]
    have = cut(l_.withColumn("w", F.explode(F.array(*map(F.lit, widths)))).filter(F.length("l") >= F.col("w")).select(*by, "l", F.explode(grams("l", F.col("w"))).alias("k")))
    ask = s.select(*by, "s", F.explode(grams("s", F.col("w"))).alias("k")).join(have.groupBy(*by, "k").agg(F.count("*").alias("n")), [*by, "k"], "left")
    rare = ask.groupBy(*by, "s").agg(F.count_if(F.col("n").isNull()).alias("none"), F.min_by("k", "n").alias("k")).filter("none = 0").drop("none")
    return rare.join(have, [*by, "k"]).filter(F.contains("l", F.col("s"))).select(*by, "s", "l")


def repair_provenance(drafts: DataFrame, atoms: DataFrame, slots: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "run_id")) -> DataFrame:
    """drafts whose quote matches exactly one atom, and that atom exactly one slot which agrees in slot, skill and
    difficulty where both are given, get that slot, atom and chunk (K8, JN10). Quotes match if either holds the other;
    the chunk must hold the draft's quote. Quotes meet by the rarest gram of the shorter one, within their document."""
    k, d = list(keys), [*keys, "draft_ord"]
    q = drafts.filter(collapse(F.col("source_quote")) != "").select(*d, F.col("source_quote").alias("quote"), F.col("skill").alias("q_skill"), F.col("difficulty").alias("q_difficulty"), F.col("coverage_slot_id").alias("q_slot"))
    a = atoms.select("doc_id", "atom_id", F.col("chunk_id").alias("a_chunk"), F.col("quote").alias("a_quote")).join(chunks.select("doc_id", F.col("chunk_id").alias("a_chunk"), F.col("text").alias("a_text")), ["doc_id", "a_chunk"])
    q = q.withColumn("left", collapse(trim_quotes(F.col("quote"))))
    a = a.withColumn("right", collapse(trim_quotes(F.col("a_quote"))))
    one, other = q.select("doc_id", F.col("left").alias("s")), a.select("doc_id", F.col("right").alias("l"))
    meets = containing(one, other, ["doc_id"]).select("doc_id", F.col("s").alias("left"), F.col("l").alias("right"))
    meets = meets.unionByName(containing(other.withColumnRenamed("l", "s"), one.withColumnRenamed("s", "l"), ["doc_id"]).select("doc_id", F.col("l").alias("left"), F.col("s").alias("right"))).distinct()
    hit = q.join(meets, ["doc_id", "left"]).join(a, ["doc_id", "right"]).filter(F.contains(collapse(F.col("a_text")), collapse(F.col("quote"))))
    hit = hit.groupBy(*d, "q_skill", "q_difficulty", "q_slot").agg(F.count("*").alias("n"), F.min(F.struct("atom_id", "a_chunk")).alias("m")).filter("n = 1")
    hit = hit.select(*d, "q_skill", "q_difficulty", "q_slot", "m.atom_id", "m.a_chunk")
    same = lambda x, y: (F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == "") | (F.lower(x) == F.lower(y))
    s = slots.select(*k, "slot_id", "atom_id", "source_chunk_ids", F.col("skill").alias("s_skill"), F.col("difficulty").alias("s_difficulty"))
    fit = hit.join(s, [*k, "atom_id"]).filter(F.expr("array_contains(source_chunk_ids, a_chunk)") & ((F.coalesce("q_slot", F.lit("")) == "") | (F.col("q_slot") == F.col("slot_id"))) & same(F.col("q_skill"), F.col("s_skill")) & same(F.col("q_difficulty"), F.col("s_difficulty")))
    one = fit.groupBy(*d).agg(F.count("*").alias("n"), F.min(F.struct("slot_id", "atom_id", "a_chunk")).alias("m")).filter("n = 1").select(*d, "m")
    out = drafts.join(one, d, "left")
    for c, f in (("coverage_slot_id", "slot_id"), ("evidence_atom_id", "atom_id"), ("evidence_chunk_id", "a_chunk"), ("chunk_id", "a_chunk")):
        if c in drafts.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"m.{f}"), F.col(c)))
    return out.drop("m")
