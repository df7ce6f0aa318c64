"""Extraction bundles: page files, a manifest and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "schema_version int, sha256 string, page_range string, pages array<struct<page:int,text:string,markdown:string>>, assets array<struct<path:string,page:int,kind:string,sha256:string,bbox:array<double>>>"


def page_range(text: str) -> tuple[int, int]:
    """'10-40', '7' or '' as inclusive bounds."""
    if not text.strip():
        return 1, (1 << 31) - 1
    a, _, b = text.partition("-")
    lo, hi = int(a), int(b or a)
    if lo < 1 or hi < lo:
        raise ValueError(f"bad page range {text!r}")
    return lo, hi


def scan_pages(pages: DataFrame, text: str = "") -> DataFrame:
    """Pages in a range; the filter reaches a Parquet scan."""
    return pages.filter(F.col("page").between(*page_range(text)))


def read_pages(spark: SparkSession, folder: str, pattern: str = r"page-0*(\d+)\.(?:md|txt)$") -> DataFrame:
    """(page, text, path) of page files, the page taken from the name."""
    rows = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.withColumn("page", F.regexp_extract("path", pattern, 1)).filter("page <> ''").select(F.col("page").cast("int").alias("page"), "text", "path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, what) for what is wrong with bundles (S3). manifest: doc_id and MANIFEST; files: doc_id, path (relative to the
    bundle), sha256."""
    p = manifest.select("doc_id", F.explode_outer("pages").alias("p")).select("doc_id", "p.*").filter("page IS NOT NULL")
    a = manifest.select("doc_id", F.explode_outer("assets").alias("a")).select("doc_id", "a.*").filter("path IS NOT NULL")
    bad = p.filter("page < 1").select("doc_id", F.lit("page below 1").alias("rule"), F.col("page").cast("string").alias("what"))
    twice = p.groupBy("doc_id", "page").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit("page twice").alias("rule"), F.col("page").cast("string").alias("what"))
    named = p.select("doc_id", F.explode(F.array_compact(F.array("text", "markdown"))).alias("path")).unionByName(a.select("doc_id", "path")).filter("path <> ''").distinct()
    out_ = named.filter(F.col("path").rlike(r"^(?:[\\/]|[A-Za-z]:)|(?:^|[\\/])\.\.(?:[\\/]|$)")).select("doc_id", F.lit("path leaves the bundle").alias("rule"), F.col("path").alias("what"))
    gone = named.join(files, ["doc_id", "path"], "left_anti").select("doc_id", F.lit("file is missing").alias("rule"), F.col("path").alias("what"))
    stray = files.filter(F.col("path").rlike(r"page-\d+\.(?:md|txt)$")).join(named, ["doc_id", "path"], "left_anti").select("doc_id", F.lit("page is not in the manifest").alias("rule"), F.col("path").alias("what"))
    other = a.filter("sha256 <> ''").withColumnRenamed("sha256", "want").join(files, ["doc_id", "path"]).filter("want <> sha256").select("doc_id", F.lit("other content").alias("rule"), F.col("path").alias("what"))
    return bad.unionByName(twice).unionByName(out_).unionByName(gone).unionByName(stray).unionByName(other)


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to folder, sha256) of all files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    return rows.select(F.regexp_replace("path", f"^.*?{root}/", "").alias("path"), F.sha2("content", 256).alias("sha256"))


def attribute_assets(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """Assets without a page get the first page whose markdown names their path."""
    open_ = assets.filter("page = 0").select("doc_id", "path")
    hit = open_.join(pages.select("doc_id", F.col("page").alias("on"), "markdown"), "doc_id").filter(F.contains("markdown", F.col("path"))).groupBy("doc_id", "path").agg(F.min("on").alias("on"))
    return assets.join(hit, ["doc_id", "path"], "left").withColumn("page", F.when(F.col("page") == 0, F.coalesce("on", F.lit(0))).otherwise(F.col("page"))).drop("on")


def align_sections(pages: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with text, documents whose counts differ) (S5): the n-th section belongs to the n-th page with content; empty
    pages get ''. pages: doc_id, page, has_content; sections: doc_id, section_ord (from 0), text."""
    n = F.row_number().over(Window.partitionBy("doc_id", "has_content").orderBy("page")) - 1
    rows = pages.withColumn("section_ord", F.when(F.col("has_content"), n)).join(sections, ["doc_id", "section_ord"], "left")
    a = pages.groupBy("doc_id").agg(F.count_if("has_content").alias("n_pages"))
    b = sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    off = a.join(b, "doc_id", "full_outer").fillna(0).filter("n_pages <> n_sections")
    good = rows.join(off, "doc_id", "left_anti").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    return good, off


def combine(pages: DataFrame, mark: str = "\n\n<!-- page break -->\n\n", header: Column | None = None) -> DataFrame:
    """(doc_id, text): a document's pages in order, with a mark between them, or with headers in a plain dump."""
    text = F.col("text") if header is None else F.concat(header, F.lit("\n"), F.col("text"))
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", text.alias("t")))).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), mark).alias("text"))


def build_manifest(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per document: pages in order, each with its assets."""
    a = assets.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("path", "kind"))).alias("assets"))
    rows = pages.join(a, ["doc_id", "page"], "left").withColumn("assets", F.coalesce("assets", F.array().cast("array<struct<path:string,kind:string>>")))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "assets"))).alias("pages"))
