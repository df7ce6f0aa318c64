"""Run artifacts, label sheets and relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..operators import ordered
from ..tables import cut

QUESTION = "struct<stem:string,choices:array<struct<content:string,is_correct:boolean>>,explanation:string,source_quote:string,difficulty:string,skill:string,calculation:struct<expression:string,expected:double,unit:string>,chunk_id:string,passed:boolean,gates:array<struct<gate:string,pass:boolean,reason:string>>>"
RUN = f"run_id string, lesson string, budget int, pass_rate double, ceiling boolean, questions array<{QUESTION}>"


def write_runs(report: DataFrame, runs: DataFrame, path: str) -> None:
    """One JSON object per run with its questions, passed or not, and their gates."""
    fields = ["stem", "choices", "explanation", "source_quote", "difficulty", "skill", "calculation", "chunk_id", "passed", "gates"]
    q = report.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("draft_ord", *fields))).alias("q"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
    q = q.withColumn("questions", F.transform("q", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).drop("q")
    runs.join(q, "run_id", "left").write.json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def questions_for_labels(runs: DataFrame, with_failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(questions, violations) of run files (S9): passed ones unless asked; a stem, four choices, one of them correct."""
    q = runs.select("run_id", F.posexplode("questions").alias("ordinal", "q")).select("run_id", "ordinal", "q.*")
    if not with_failed:
        q = q.filter(F.coalesce("passed", F.lit(True)))
    why = F.when(F.coalesce(trimmed(F.col("stem")), F.lit("")) == "", "no stem").when(F.size("choices") != 4, "not four choices").when(F.size(F.filter("choices", lambda c: c["is_correct"])) != 1, "not one correct choice")
    q = q.withColumn("why", why)
    good = q.filter("why IS NULL").select("run_id", "ordinal", "stem", F.transform("choices", lambda c: c["content"]).alias("choices"), F.substring(F.lit("ABCD"), F.array_position(F.transform("choices", lambda c: c["is_correct"]), True).cast("int"), F.lit(1)).alias("correct"))
    return good, q.filter("why IS NOT NULL").select("run_id", "ordinal", F.col("why").alias("rule"))


def write_sheet(sheet: DataFrame, key: DataFrame, path: str) -> None:
    """The sheet as CSV and the key as JSON, apart."""
    sheet.write.option("header", "true").option("escape", '"').csv(f"{path}/sheet")
    key.write.json(f"{path}/key")


SHEET = "id string, stem string, choice_a string, choice_b string, choice_c string, choice_d string, label string"


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A filled sheet (S12): its columns, file, row (the header is row 1, a row of several lines counts once) and bad, the
    raw text of rows whose cells don't fit the header (else null). Rows are numbered by where their part of a file begins
    and by their place in it."""
    rows = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("columnNameOfCorruptRecord", "bad").schema(SHEET + ", bad string").csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place"))
    rows = ordered.numbered(cut(rows), ["file"], "part", ["place"], "row")
    return rows.withColumn("row", (F.col("row") + 1).cast("int")).drop("part", "place")


def sheet_rows_with_problems(rows: DataFrame, key: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(file, row, id, problem) of a sheet as read: every fault of a row, and ids of the key that no row has (row null). The
    later row of an id that stands twice is at fault."""
    rows = rows.withColumn("id", F.coalesce(F.trim("id"), F.lit(""))).withColumn("said", F.coalesce(F.trim("label"), F.lit("")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("file", "row")))
    rows = rows.join(key.select("id", F.lit(True).alias("known")), "id", "left")
    has = F.col("bad").isNull() & (F.col("id") != "")
    faults = F.array_compact(F.array(
        F.when(F.col("bad").isNotNull(), "cells that don't fit the header"), F.when(F.col("bad").isNull() & (F.col("id") == ""), "no id"),
        F.when(has & (F.col("nth") > 1), "id twice"), F.when(has & F.col("known").isNull(), "not in the key"),
        F.when(has & (F.col("said") == ""), "no label"), F.when(has & (F.col("said") != "") & ~F.lower("said").isin(*labels), "unknown label"),
    ))
    gone = key.select("id").join(rows.filter("bad IS NULL").select("id"), "id", "left_anti")
    return rows.select("file", "row", "id", F.explode(faults).alias("problem")).unionByName(gone.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("row"), "id", F.lit("not on the sheet").alias("problem")))


def read_table(spark: SparkSession, url: str, name: str, column: str | None = None, parts: int = 8, buckets: int = 256, **options: str) -> DataFrame:
    """A table over JDBC (S13), in parts along a whole-numbered column where one is given, as the database spells it.

    The database counts rows in equal steps between the column's least and greatest value, which it is asked for first;
    parts are cut where the counts say that a share of the rows is full, so crowded values don't meet in one part. Rows
    without a value are in the first part. Filters on the result reach the database beside the parts' own.
    """
    ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    if column is None:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    low, high = ask(f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {name}").first()
    if low is None:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    step = (int(high) - int(low)) // buckets + 1
    counts = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT ({column} - ({int(low)})) / {step} AS b FROM {name} WHERE {column} IS NOT NULL) AS x GROUP BY b").collect()
    share, full, cuts = sum(r[1] for r in counts) / parts, 0, []
    for b, n in sorted((int(r[0]), r[1]) for r in counts):
        if full >= share * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(int(low) + b * step)
        full += n
    ends = [*cuts, None]
    where = [" AND ".join(filter(None, [f"{column} >= {a}" if a is not None else "", f"{column} < {b}" if b is not None else ""])) or "1 = 1" for a, b in zip([None, *cuts], ends, strict=True)]
    where[0] = f"({where[0]}) OR {column} IS NULL"
    return spark.read.jdbc(url, name, predicates=where, properties=dict(options))
