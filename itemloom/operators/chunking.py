"""Pages to chunks with exact provenance, and checks of what was extracted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_page, source_role, squeeze, trimmed
from ..tables import cut

TARGET, OVERLAP = 1200, 150
# Words that announce a formula.
FORMULA_WORDS = r"(?i)\b(equation|formula|theorem|calculate|derivative|integral|velocity|acceleration)\b|สมการ|สูตร"


def _spans(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """Chunk bounds: a cut goes to the last blank line, line end or sentence end in the last quarter, in that order of
    preference, else to the hard limit; the next chunk begins overlap before a cut, if that advances."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(n, start + target)
        if end < n:
            floor = start + (end - start) * 3 // 4
            for mark in ("\n\n", "\n", ".", "。", "!", "?", ";", ":"):
                i = text.rfind(mark, floor, end) + len(mark) - 1
                if i - len(mark) + 1 >= 0 and i > floor:
                    end = i + 1
                    break
        out.append((start, end))
        if end >= n:
            break
        start = end - overlap if end - overlap > start else end
    return out


def chunk_pages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Pages (doc_id, page, text) as chunks (R1): doc_id, chunk_ord, chunk_id, page, start_off, end_off, text,
    source_role. Chunks never cross a page; ordinals run over the document (G7); blank bodies take none."""
    target = target if target > 0 else TARGET
    overlap = target // 8 if overlap >= target else overlap

    @F.pandas_udf("array<struct<start_off:int,end_off:int>>")
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start_off": a, "end_off": b} for a, b in _spans(t, target, overlap)] if t and t.strip() else [])

    clean = pages.select("doc_id", "page", normalise_page(F.col("text")).alias("clean"))
    cut = clean.select("doc_id", "page", "clean", F.explode(spans("clean")).alias("s"))
    body = trimmed(F.substring("clean", F.col("s.start_off") + 1, F.col("s.end_off") - F.col("s.start_off")))
    cut = cut.select("doc_id", "page", "s.start_off", "s.end_off", body.alias("text")).filter("text <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "start_off")) - 1
    cut = cut.withColumn("chunk_ord", n)
    return cut.select("doc_id", "chunk_ord", F.format_string("p%d-c%d", "page", "chunk_ord").alias("chunk_id"), "page", "start_off", "end_off", "text", source_role(F.col("text")).alias("source_role"))


def sufficiency(pages: DataFrame, least: int = 40) -> DataFrame:
    """Per document: n_pages, n_chars, n_thin, verdict (fail without text; warn if over half the pages are thin; P7)."""
    n = F.length(trimmed(F.col("text")))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(n).alias("n_chars"), F.count_if(n < least).alias("n_thin"))
    return out.withColumn("verdict", F.when(F.coalesce("n_chars", F.lit(0)) == 0, "fail").when(2 * F.col("n_thin") > F.col("n_pages"), "warn").otherwise("ok"))


def native_text(pages: DataFrame, least: int = 40) -> DataFrame:
    """Per document: pages with native text, whether OCR is needed, whether formulas are announced."""
    good = F.length(squeeze(F.col("text"))) >= least
    return pages.groupBy("doc_id").agg(F.count_if(good).alias("n_native"), (F.count_if(good) < F.count("*")).alias("needs_ocr"), F.bool_or(F.col("text").rlike(FORMULA_WORDS)).alias("has_formula"))


def profile(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: pages, characters and chunks."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return p.join(c, "doc_id", "left").fillna(0, ["n_chunks"])


def lesson_profile(lessons: DataFrame, lesson_chunk: DataFrame, lesson_concept: DataFrame) -> DataFrame:
    """Per lesson: its chunks, concepts and budget."""
    count = lambda df, name: df.groupBy("doc_id", "lesson_id").agg(F.count("*").alias(name))
    out = lessons.join(count(lesson_chunk, "n_chunks"), ["doc_id", "lesson_id"], "left").join(count(lesson_concept, "n_concepts"), ["doc_id", "lesson_id"], "left")
    return out.select("doc_id", "lesson_id", "question_budget", "n_chunks", "n_concepts").fillna(0, ["n_chunks", "n_concepts"])


def orphans(chunks: DataFrame) -> DataFrame:
    """Per document: its chunks and those in no lesson (A14); a lesson_id of null or '' is none."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.coalesce("lesson_id", F.lit("")) == "").alias("n_orphans"))


def plan_batches(chunks: DataFrame, most_chunks: int = 32, most_chars: int = 36_000, text: str = "text") -> DataFrame:
    """Chunks with batch (from 0) by next-fit in document order: a batch closes when a chunk would make it too many or
    too long; a row costs its text, its id and 32 (W7).

    The batch that begins at a chunk ends where prefix sums say, so every chunk has a successor: where the next batch would
    begin. Successors are doubled while any stays inside its document, and the true beginnings are those reached from the
    first chunk: a logarithm of the batches of the longest document in rounds of joins, over sizes only.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_ord")
    sizes = chunks.select("doc_id", "chunk_ord", (F.coalesce(F.length(text), F.lit(0)) + F.length("chunk_id") + 32).cast("long").alias("cost"))
    sizes = sizes.withColumn("i", F.row_number().over(w).cast("long")).withColumn("s", F.sum("cost").over(w) - F.col("cost"))
    end = F.max(F.col("s") + F.col("cost")).over(Window.partitionBy("doc_id"))
    # A chunk fits if the next one begins within the limit; the last if the document ends within it.
    inside = F.count("*").over(Window.partitionBy("doc_id").orderBy("s").rangeBetween(0, most_chars)) - 1 + (end - F.col("s") <= most_chars).cast("int")
    sizes = cut(sizes.select("doc_id", "chunk_ord", "i", (F.col("i") + F.greatest(F.lit(1), F.least(F.lit(most_chunks), inside))).alias("next")))
    jumps = [cut(sizes.join(sizes.select("doc_id", F.col("i").alias("next")), ["doc_id", "next"], "left_semi").select("doc_id", "i", "next"))]
    while not jumps[-1].isEmpty():
        far = jumps[-1].select("doc_id", F.col("i").alias("next"), F.col("next").alias("far"))
        jumps.append(cut(jumps[-1].join(far, ["doc_id", "next"]).select("doc_id", "i", F.col("far").alias("next"))))
    starts = sizes.filter("i = 1").select("doc_id", "i")
    for jump in reversed(jumps[:-1]):
        starts = cut(starts.unionByName(starts.join(jump, ["doc_id", "i"]).select("doc_id", F.col("next").alias("i"))))
    put = sizes.join(starts.withColumn("starts", F.lit(1)), ["doc_id", "i"], "left")
    put = put.select("doc_id", "chunk_ord", (F.count("starts").over(w) - 1).cast("int").alias("batch"))
    return chunks.join(put, ["doc_id", "chunk_ord"])


def batch_counts(batches: DataFrame) -> DataFrame:
    """Per document: how many batches are planned."""
    return batches.groupBy("doc_id").agg(F.countDistinct("batch").alias("n_batches"))


def split_failed(batches: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed batches of two chunks or more as two halves, by order, for a retry (R10): with half (0, 1)."""
    again = batches.join(failed.select("doc_id", "batch").distinct(), ["doc_id", "batch"], "left_semi")
    w = Window.partitionBy("doc_id", "batch")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("chunk_ord")) - 1
    return again.withColumn("n", n).withColumn("half", (i >= F.floor(n / 2)).cast("int")).filter("n > 1").drop("n")


def batch_requests(batches: DataFrame) -> DataFrame:
    """One row per batch: its passages, labelled by chunk id, as one text in order."""
    part = F.struct("chunk_ord", F.concat(F.lit("["), F.col("chunk_id"), F.lit("]\n"), F.col("text")).alias("t"))
    rows = batches.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return rows.select("doc_id", "batch", F.size("p").alias("n_chunks"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("request"))
