"""Exported question lists in plain text, as tables: no row is guessed, what is unclear goes to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_export_line
from ..operators import ordered
from ..tables import cut

#: Lines of a file that are parsed together.
BLOCK = 50_000

STYLES = {"latin-upper": "ABCD", "latin-lower": "abcd", "thai": "กขคง", "digit": "1234"}
# How answer lines and question lines begin.
ANSWER_WORDS = r"(?i:answer|ans|correct answer|correct|key|เฉลย|คำตอบ(?:ที่ถูก(?:ต้อง)?)?)\s*(?:คือ\s*)?[:\-–：]\s*"
NUMBERED = r"(?i)^(?:(?:ข้อ(?:ที่)?|คำถาม(?:ที่)?|Question|Q)\s*)?\d+\s*[.):\-–]\s*"
ANSWER = rf"^{ANSWER_WORDS}(.+)$"
HEADER = r"(?i)^(?:question|ข้อ(?:ที่)?)\s+\d+$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, lineno, raw) of text files. A large file is read in parts side by side: lines are counted by where their part
    begins, and numbered within it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    rows = ordered.numbered(cut(rows), ["path"], "part", ["place"], "lineno")
    return rows.select("path", F.col("lineno").cast("int").alias("lineno"), F.when(F.col("lineno") == 1, F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.col("raw")).alias("raw"))


def _option(label: str) -> str:
    gap = r"\s+" if label.isdigit() else r"\s*"
    return rf"^(?:\(\s*{label}\s*\)?\s*[.):\-–]?|{label}\s*(?:\)\s*[.):\-–]?|[.):\-–])){gap}(\S.*)$"


def _inline(labels: str) -> str:
    parts = "".join(rf"\(?{x}\)?\s*[.):]{r'\s+' if x.isdigit() else r'\s*'}(\S.*?)\s+" for x in labels[:3])
    last = labels[3]
    return rf"^(.+?)\s+{parts}\(?{last}\)?\s*[.):]{r'\s+' if last.isdigit() else r'\s*'}(\S.*?)(?:\s({ANSWER_WORDS}.+))?$"


def clean_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, lineno, n, clean): lines that hold something, header-only lines as numbers before the next line (R6), and
    questions on one line as five or six, under their line number (R5)."""
    rows = lines.withColumn("clean", clean_export_line(F.col("raw"))).filter("clean <> ''").select("path", "lineno", "clean", F.floor(F.col("lineno") / block).alias("part"))
    rows = ordered.numbered(cut(rows), ["path"], "part", ["lineno"])
    rows, w = ordered.with_neighbours(rows.withColumn("header", F.col("clean").rlike(HEADER)), ["path"], block, 1)
    rows = rows.withColumn("head", F.lag("clean").over(w)).withColumn("was", F.lag("header").over(w)).filter("_own AND NOT header")
    rows = rows.withColumn("clean", F.when(F.col("was"), F.concat(F.regexp_extract("head", r"(\d+)", 1), F.lit(". "), "clean")).otherwise(F.col("clean")))
    parts = F.lit(None).cast("array<string>")
    for labels in reversed(list(STYLES.values())):
        got = [F.regexp_extract("clean", _inline(labels), k) for k in range(1, 7)]
        many = F.array(got[0], *[F.concat(F.lit(f"{labels[k]}. "), got[k + 1]) for k in range(4)], F.nullif(got[5], F.lit("")))
        parts = F.when(F.col("clean").rlike(_inline(labels)), F.array_compact(many)).otherwise(parts)
    rows = rows.select("path", "lineno", "part", F.posexplode(F.coalesce(parts, F.array("clean"))).alias("k", "clean"))
    return ordered.numbered(cut(rows), ["path"], "part", ["lineno", "k"]).select("path", "lineno", "n", "clean")


def parse(lines: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(questions, quarantine) of exported lists (R5, S10). Files are parsed in blocks of lines side by side: what a line
    means depends on three lines around it, on the file's labelling, and on counts that are carried from block to block.

    questions: path, ordinal, lineno, stem, choices, correct (0 to 3 or null). Per file the labelling with the most runs of
    four option lines counts. quarantine: path, lineno, reason; a file is clean if it has none.
    """
    rows = cut(clean_lines(lines, block))
    marks, w = ordered.with_neighbours(rows, ["path"], block, 3)
    for s, labels in STYLES.items():
        which = F.coalesce(*[F.when(F.col("clean").rlike(_option(x)), F.lit(i)) for i, x in enumerate(labels)])
        marks = marks.withColumn(f"o_{s}", which)
        run = (F.col(f"o_{s}") == 0) & (F.lead(f"o_{s}", 1).over(w) == 1) & (F.lead(f"o_{s}", 2).over(w) == 2) & (F.lead(f"o_{s}", 3).over(w) == 3)
        marks = marks.withColumn(f"q_{s}", F.coalesce(run, F.lit(False)))
    marks = cut(marks.filter("_own").drop("_own", "_block"))
    counts = marks.groupBy("path").agg(*[F.count_if(f"q_{s}").alias(s) for s in STYLES])
    order = list(STYLES)
    best = F.array_max(F.array(*[F.struct(F.col(s).alias("n"), F.lit(-i).alias("i")) for i, s in enumerate(order)]))
    marks = marks.join(counts.select("path", best.alias("b")), "path")
    style = -F.col("b.i")
    pick = lambda p: F.coalesce(*[F.when(style == i, F.col(f"{p}_{s}")) for i, s in enumerate(order)])
    text = F.coalesce(*[F.when((style == i) & (F.col(f"o_{s}") == k), F.regexp_extract("clean", _option(x), 1)) for i, s in enumerate(order) for k, x in enumerate(STYLES[s])])
    rows = marks.withColumn("opt", pick("o")).withColumn("quad", pick("q")).withColumn("body", text).withColumn("answer", F.regexp_extract("clean", ANSWER, 1)).select("path", "lineno", "n", "clean", "opt", "quad", "body", "answer", F.col("b.n").alias("quads"))
    rows, w = ordered.with_neighbours(rows, ["path"], block, 3)
    in_quad = F.max(F.when(F.col("quad"), F.col("n"))).over(w.rowsBetween(-3, 0))
    rows = cut(rows.withColumn("qn", in_quad).filter("_own").drop("_own", "_block").withColumn("in_q", F.col("qn").isNotNull()))
    rows = ordered.running(rows, ["path"], block, {"started": F.col("quad").cast("int")}, {"done": F.when(F.col("in_q"), F.col("n")), "last_other": F.when(~F.col("in_q") & (F.col("answer") == ""), F.col("n"))})
    # An answer line right after options (or another answer line) closes the question before it.
    rows = rows.withColumn("closes", ~F.col("in_q") & (F.col("answer") != "") & F.col("done").isNotNull() & (F.coalesce("last_other", F.lit(0)) < F.col("done")))
    # Lines belong to the next run of options; options and closing answers to the current one.
    rows = rows.withColumn("ordinal", F.when(F.col("in_q") | F.col("closes"), F.col("started")).otherwise(F.col("started") + 1).cast("int"))
    # Each run of options is a question, so their count is the last one's number.
    rows = rows.withColumn("total", F.col("quads"))
    stem_line, numbered = ~F.col("in_q") & ~F.col("closes"), F.col("clean").rlike(NUMBERED + r"\S")
    rows = rows.withColumn("stem_line", stem_line).withColumn("numbered", numbered)
    take = lambda c, k: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", k)))), lambda x: x[k])
    # The stem of lines behind the last question, which may be a whole file, is not gathered.
    q = rows.groupBy("path", "ordinal", "total", "quads").agg(
        F.min("lineno").alias("lineno"), F.min(F.when(F.col("stem_line"), F.col("lineno"))).alias("stem_at"), take(F.col("stem_line") & (F.col("ordinal") <= F.col("total")), "clean").alias("stems"), take(F.col("in_q"), "body").alias("choices"),
        take(F.col("closes"), "answer").alias("answers"), F.count_if(F.col("stem_line") & F.col("numbered")).alias("n_numbered"), F.count_if(F.col("stem_line") & (F.col("answer") != "")).alias("early"),
        F.min_by("numbered", F.when(F.col("stem_line"), F.col("n"))).alias("first_numbered"),
    )
    token = F.regexp_extract(F.get("answers", F.lit(0)), r"^\(?\s*([A-Da-dกขคง1-4])(?:$|[\s.)\]:–,])", 1)
    correct = F.coalesce(*[F.when(token.isin(*[labels[i] for labels in STYLES.values()]), F.lit(i)) for i in range(4)])
    stem = F.trim(F.regexp_replace(F.array_join("stems", " "), NUMBERED, ""))
    why = F.coalesce(
        F.when(F.col("quads") == 0, "no complete group of four options"),
        F.when(F.col("ordinal") > F.col("total"), "lines after the last question"),
        F.when(F.col("early") > 0, "an answer line before the options"),
        F.when(F.size("stems") == 0, "options without a question"),
        F.when((F.size("stems") > 1) & (F.col("n_numbered") != 1), "the stem is ambiguous"),
        F.when((F.size("stems") > 1) & ~F.col("first_numbered"), "lines before the numbered question"),
        F.when(stem == "", "a number without a question"),
        F.when(F.size("answers") > 1, "more than one answer line"),
        F.when((F.size("answers") == 1) & correct.isNull(), "an answer that is no choice"),
    )
    q = q.withColumn("why", why).withColumn("stem", stem).withColumn("correct", correct)
    good = q.filter("why IS NULL").select("path", "ordinal", F.col("stem_at").alias("lineno"), "stem", "choices", "correct")
    return good, q.filter("why IS NOT NULL").select("path", "lineno", F.col("why").alias("reason"))
