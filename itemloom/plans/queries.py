"""Registered queries over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import clip, normalise_page, plain_markdown, squeeze, trimmed
from ..operators import chunking, contract, decode, gates, graph, provenance, rank, report
from ..sources import catalog
from ..streaming import calls
from ..tables import parts_for, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(table) -> DataFrame:
    """documents as one page each."""
    return table("documents").select("doc_id", F.lit(1).alias("page"), "text")


def _cut_sql(mark: str) -> str:
    """Where a chunk of w, the last quarter of its reach, ends by its last mark; 0 if it has none behind its first place."""
    n, back = len(mark), f"strpos(reverse(w), '{mark[::-1]}')" if mark.strip() else f"strpos(reverse(w), {' || '.join(['chr(10)'] * len(mark))})"
    return f"CASE WHEN {back} > 0 AND length(w) - {back} + 1 > 1 THEN length(w) - {back} + 1 ELSE 0 END" if n else "0"


_MARKS = ["\n\n", "\n", ".", "。", "!", "?", ";", ":"]
_CHUNKS = rf"""WITH RECURSIVE p AS (SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n FROM p WHERE length(regexp_replace(t, '\s+', '', 'g')) > 0),
r AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS start_off, CAST(NULL AS BIGINT) AS end_off, t, n FROM n
      UNION ALL
      SELECT doc_id, k + 1, CASE WHEN stop - 150 > start_off THEN stop - 150 ELSE stop END, stop, t, n FROM (
        SELECT doc_id, k, start_off, t, n, CASE WHEN hard = n THEN hard ELSE coalesce(low + nullif({_cut_sql(_MARKS[0])}, 0), {', '.join(f'low + nullif({_cut_sql(m)}, 0)' for m in _MARKS[1:])}, hard) END AS stop FROM (
          SELECT *, least(n, start_off + 1200) AS hard, start_off + 900 AS low, substr(t, CAST(start_off + 901 AS BIGINT), 300) AS w FROM r WHERE end_off IS NULL OR end_off < n))),
c AS (SELECT a.doc_id, a.start_off, b.end_off, regexp_replace(substr(a.t, a.start_off + 1, b.end_off - a.start_off), '^\s+|\s+$', '', 'g') AS body FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.k = a.k + 1),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_off) - 1 AS chunk_ord FROM c WHERE body <> '')
SELECT doc_id, CAST(chunk_ord AS INTEGER) AS chunk_ord, 'p1-c' || chunk_ord AS chunk_id, CAST(start_off AS INTEGER) AS start_off, CAST(end_off AS INTEGER) AS end_off, CAST(length(body) AS INTEGER) AS n_chars, 'core' AS source_role FROM o"""


@query(_CHUNKS)
def chunk_corpus(table):
    out = chunking.chunk_pages(_pages(table))
    return out.select("doc_id", "chunk_ord", "chunk_id", "start_off", "end_off", F.length("text").alias("n_chars"), "source_role")


@query("SELECT doc_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY doc_id")
def page_profile(table):
    return chunking.profile(_pages(table), chunking.chunk_pages(_pages(table))).drop("n_chunks")


@query("""SELECT page_id AS doc_id, count(*) AS n_pages, CAST(sum(length(trim(html, chr(32) || chr(9) || chr(10) || chr(13)))) AS BIGINT) AS n_chars,
       CAST(sum(CASE WHEN length(trim(html, chr(32) || chr(9) || chr(10) || chr(13))) < 40 THEN 1 ELSE 0 END) AS BIGINT) AS n_thin,
       CASE WHEN coalesce(sum(length(trim(html, chr(32) || chr(9) || chr(10) || chr(13)))), 0) = 0 THEN 'fail' WHEN 2 * sum(CASE WHEN length(trim(html, chr(32) || chr(9) || chr(10) || chr(13))) < 40 THEN 1 ELSE 0 END) > count(*) THEN 'warn' ELSE 'ok' END AS verdict
FROM pages GROUP BY page_id""")
def page_sufficiency(table):
    return chunking.sufficiency(table("pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.col("html").alias("text")))


@query(rf"""SELECT doc_id, CAST(sum(CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS n_native,
       sum(CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) >= 40 THEN 1 ELSE 0 END) < count(*) AS needs_ocr, bool_or(regexp_matches(text, '{chunking.FORMULA_WORDS}')) AS has_formula
FROM documents GROUP BY doc_id""")
def native_text_pages(table):
    return chunking.native_text(_pages(table))


# Each step of cleaning a page, restated: breaks, dropped elements, pictures, block ends, cells, tags, Markdown, entities, space.
_PLAIN_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<img\b[^>]*?\balt\s*=\s*["'']([^"'']*)["''][^>]*>', '\1', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table|ul|ol|section|article|title)\s*>', chr(10), 'g'), '(?i)</t[dh]\s*>', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS t FROM c),
e AS (SELECT page_id, list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*') OR regexp_matches(x, '^[ \t]*(```|~~~)') THEN ''
        ELSE regexp_replace(regexp_replace(regexp_replace(x, '^[ \t]{0,3}#{1,6}[ \t]+', ''), '^[ \t]*(>[ \t]?)+', ''), '^[ \t]*[-*+•][ \t]+', '') END) AS l FROM d),
f AS (SELECT page_id, list_transform(l, lambda x: regexp_replace(replace(replace(replace(x, '**', ''), '__', ''), '`', ''), '[ \t]*\|[ \t]*', ' ', 'g')) AS l FROM e),
g AS (SELECT page_id, list_transform(l, lambda x: replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), chr(160), ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&')) AS l FROM f),
h AS (SELECT page_id, array_to_string(list_transform(l, lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), chr(10)) AS t FROM g)
SELECT page_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM h"""


@query(_PLAIN_SQL)
def page_clean_text(table):
    return table("pages").select("page_id", plain_markdown(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g') AS text FROM documents""")
def normalised_pages(table):
    return table("documents").select("doc_id", normalise_page(F.col("text")).alias("text"))


@query(r"""WITH q AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS q FROM benchmark), t AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON contains(t, q) WHERE q <> ''""")
def quote_verbatim(table):
    return provenance.quotes_anywhere(table("benchmark"), table("documents"))


@query(r"""WITH q AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS q FROM benchmark), t AS (SELECT doc_id, lang, regexp_replace(text, '\s+', '', 'g') AS t FROM documents),
h AS (SELECT DISTINCT doc_id FROM q JOIN t ON contains(t, q) WHERE q <> '')
SELECT lang, count(*) AS n, count(h.doc_id) AS n_passed, count(h.doc_id) / count(*)::DOUBLE AS pass_rate FROM t LEFT JOIN h USING (doc_id) GROUP BY lang""")
def quote_rate_by_lang(table):
    """Flagship: the share of documents that hold a benchmark passage verbatim, by language."""
    docs = table("documents")
    hit = provenance.quotes_anywhere(table("benchmark"), docs).select("doc_id").distinct().withColumn("passed", F.lit(True))
    return report.pass_rate(docs.select("doc_id", "lang").join(hit, "doc_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False))), "lang")


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in words) + ")"


_STEM_SQL = rf"""CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < {gates.MIN_STEM} THEN 'short'
 WHEN NOT regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[?？]$') AND NOT {_any_sql(gates.QUESTION_WORDS)} THEN 'asks nothing'
 WHEN {_any_sql(gates.UNSEEN_PHRASES)} THEN 'unseen' WHEN {_any_sql(gates.TEACHING_PHRASES)} THEN 'teaching' END"""


def _stems(table) -> DataFrame:
    texts = table("documents").select("doc_id", "lang", trimmed(F.col("text")).alias("s"), F.lower("text").alias("low"))
    return texts.select("doc_id", "lang", gates.stem_fault(F.col("s"), F.col("low")).alias("why"))


@query(f"SELECT lang, count(*) AS n, CAST(sum(CASE WHEN w IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_passed, avg(CASE WHEN w IS NULL THEN 1.0 ELSE 0.0 END) AS pass_rate FROM (SELECT lang, {_STEM_SQL} AS w FROM documents) GROUP BY lang")
def pass_rate_by_lang(table):
    return report.pass_rate(_stems(table).withColumn("passed", F.col("why").isNull()), "lang")


@query(f"SELECT w AS gate, count(*) AS n, false AS deterministic FROM (SELECT {_STEM_SQL} AS w FROM documents) WHERE w IS NOT NULL GROUP BY w")
def failures_by_gate(table):
    return report.failures_by_gate(_stems(table).filter("why IS NOT NULL").select(F.col("why").alias("gate"), F.lit(False).alias("pass")))


_LABEL = "CASE WHEN toxic = 1 THEN 'wrong' WHEN quality = 1 THEN 'good' ELSE 'trivial' END"


def _labelled(table) -> DataFrame:
    return table("labels").join(table("documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", F.expr(_LABEL).alias("label"))


@query(f"SELECT source, l AS label, count(*) AS n FROM (SELECT source, {_LABEL} AS l FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((source, l), (source))")
def label_tally(table):
    return report.label_tally(_labelled(table))


@query(f"""WITH r AS (SELECT source, {_LABEL} AS l FROM labels JOIN documents USING (doc_id)), g AS (SELECT source, count(*) FILTER (l = 'good') AS good FROM r GROUP BY source),
m AS (SELECT (SELECT good FROM g WHERE source = 'src0') AS ours_good, min((SELECT good FROM g WHERE source = 'src0') - good) AS worst_gap FROM g WHERE source <> 'src0'),
w AS (SELECT l AS worst_label FROM r WHERE source = 'src0' AND l <> 'good' GROUP BY l ORDER BY count(*) DESC, l DESC LIMIT 1)
SELECT ours_good, worst_gap, CASE WHEN worst_gap >= 4 THEN 'PASS' WHEN worst_gap <= -4 THEN 'FAILS PREMISE' ELSE 'INCONCLUSIVE' END AS verdict, (SELECT worst_label FROM w) AS worst_label FROM m""")
def label_verdict(table):
    return report.label_verdict(_labelled(table), ours="src0")


@query(r"SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(regexp_replace(text, '\s+', '', 'g'))) AS first_id FROM documents")
def duplicate_texts(table):
    """Exact duplicates by the squeezed text: the first id of each document's class, found by a class table and a join."""
    docs = table("documents").select("doc_id", F.xxhash64(squeeze(F.lower("text"))).alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, docs["k"].eqNullSafe(first["k"])).select("doc_id", "first_id")


def same_stems_sql(rows: str) -> str:
    """Pairs of rows (run, id, stem) by the rule itself, over all pairs of a run."""
    return rf"""WITH s AS (SELECT run, id, regexp_replace(lower(stem), '\s+', '', 'g') AS s FROM {rows}),
p AS (SELECT a.run, a.id AS a, b.id AS b, CASE WHEN length(a.s) <= length(b.s) THEN a.s ELSE b.s END AS x, CASE WHEN length(a.s) <= length(b.s) THEN b.s ELSE a.s END AS y FROM s a JOIN s b ON a.run = b.run AND a.id < b.id WHERE a.s <> '' AND b.s <> ''),
r AS (SELECT *, CAST(ceil(length(x) * 85 / 100.0) AS BIGINT) AS r FROM p)
SELECT run, a, b FROM r WHERE len(list_filter(range(1, length(x) - r + 2), lambda i: contains(y, substr(x, i, r)))) > 0"""


@query("SELECT CAST(run AS INTEGER) AS run_id, a, b FROM (" + same_stems_sql("(SELECT 1 AS run, item_id AS id, text AS stem FROM benchmark)") + ")")
def near_stems(table):
    return gates.same_stems(table("benchmark").select(F.lit(1).alias("run_id"), F.col("item_id").alias("draft_ord"), F.col("text").alias("stem")), ["run_id"])


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9""")
def duplicate_vectors(table):
    return rank.near_vectors_blocked(table("embeddings")).withColumn("similarity", F.round("similarity", 6))


@query("""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
s AS (SELECT label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS similarity FROM embeddings JOIN q USING (label))
SELECT label, vec_id, similarity, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s""")
def rank_by_relevance(table):
    e = table("embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    q = e.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector"))
    out = rank.by_relevance(e.withColumnRenamed("vec_id", "chunk_ord"), q, "label")
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    return out.select("label", F.col("chunk_ord").alias("vec_id"), F.round("similarity", 9).alias("similarity")).withColumn("rank", F.row_number().over(w))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
r AS (SELECT o_custkey, i, d AS last, true AS accepted FROM o WHERE i = 1
      UNION ALL SELECT o.o_custkey, o.i, CASE WHEN o.d >= r.last + INTERVAL 200 DAY THEN o.d ELSE r.last END, o.d >= r.last + INTERVAL 200 DAY FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1)
SELECT o_custkey, o_orderkey, accepted FROM o JOIN r USING (o_custkey, i)""")
def accept_first_wins(table):
    """Orders as drafts of a customer's run; two within 200 days conflict."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table("orders").select("o_custkey", "o_orderkey", "o_orderdate", n.alias("draft_ord"))
    # Orders of one span of 200 days or of the next one meet.
    span = F.floor(F.datediff("o_orderdate", F.lit("1970-01-01")) / 200)
    left = rows.select("o_custkey", F.col("draft_ord").alias("a"), F.col("o_orderdate").alias("da"), F.explode(F.array(span, span + 1)).alias("span"))
    right = rows.select("o_custkey", F.col("draft_ord").alias("b"), F.col("o_orderdate").alias("db"), span.alias("span"))
    pairs = left.join(right, ["o_custkey", "span"]).filter("a < b AND db < da + INTERVAL 200 DAYS").select("o_custkey", "a", "b")
    return gates.accept_first(rows, pairs, ["o_custkey"]).select("o_custkey", "o_orderkey", "accepted")


def _kinds(table) -> DataFrame:
    rows = table("documents").select("doc_id", "source", "lang").join(table("labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", "source", F.when(F.col("quality") == 0, "non_content").otherwise("content").alias("kind"), F.when(F.col("lang") == "en", F.array("lang")).otherwise(F.array().cast("array<string>")).alias("topics"))


@query("""WITH k AS (SELECT doc_id, source, lang, CASE WHEN quality = 0 THEN 'non_content' ELSE 'content' END AS kind FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, row_number() OVER (PARTITION BY source ORDER BY doc_id) - row_number() OVER (PARTITION BY source, kind <> 'content' ORDER BY doc_id) AS isle, count(*) OVER (PARTITION BY source) AS total FROM k),
s AS (SELECT *, count(*) OVER w AS len, min(rn) OVER w AS lo, max(rn) OVER w AS hi FROM r WINDOW w AS (PARTITION BY source, kind <> 'content', isle)),
t AS (SELECT *, kind <> 'content' AND len <= 2 AND lo > 1 AND hi < total AND lang = 'en' AS rescued FROM s)
SELECT doc_id, source, CASE WHEN rescued THEN 'content' ELSE kind END AS kind, rescued FROM t""")
def smooth_runs(table):
    return graph.smooth_runs(_kinds(table), "source", "doc_id").select("doc_id", "source", "kind", "rescued")


@query("SELECT source, count(*) AS n, avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) > 0.5 AS refused FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def drop_share_guard(table):
    return graph.drop_share(_kinds(table), "source")


#: Rows of a task of the graph: it holds them sorted several times, by document, concept and chunk.
GRAPH_ROWS = 100_000


def _graph(table) -> DataFrame:
    """Customers as documents, their orders as chunks, parts as concepts, all placed. What a task holds doesn't grow with
    the tables, and rows are dealt by document once."""
    lines, orders = table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), table("orders").select("o_orderkey", "o_custkey").filter("o_custkey IS NOT NULL")
    n = parts_for(lines.sparkSession, lines.count(), GRAPH_ROWS)
    rows = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("chunk_ord"), F.col("l_partkey").alias("key"), (F.col("l_linenumber") * F.lit(10**10) + F.col("l_partkey")).alias("pos"))
    rows = rows.repartition(n, "doc_id").groupBy("doc_id", "chunk_ord", "key").agg(F.min("pos").alias("pos"))
    seen = rows.select("doc_id", "chunk_ord", F.col("chunk_ord").cast("string").alias("chunk_id"), F.lit(1).alias("page"), F.concat(F.lit("p"), F.col("key").cast("string")).alias("key"), "pos")
    return graph.placed(seen.withColumn("title", F.col("key")), n)


_GRAPH_SQL = """WITH s AS (SELECT o_custkey AS doc_id, l_orderkey AS chunk_ord, l_partkey, min(l_linenumber * 10000000000 + l_partkey) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, l_partkey ORDER BY chunk_ord) AS nth FROM s),
c AS (SELECT doc_id, l_partkey, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_ord, pos) AS n FROM f WHERE nth = 1),
a AS (SELECT s.*, 'C' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS concept_id FROM s JOIN c USING (doc_id, l_partkey))
"""


@query(_GRAPH_SQL + "SELECT doc_id, concept_id, 'p' || l_partkey AS title, count(*) AS n_chunks FROM a GROUP BY ALL")
def concept_nodes(table):
    nodes = graph.concepts_of(_graph(table))
    return nodes.select("doc_id", "concept_id", "title", F.size("chunk_ids").cast("long").alias("n_chunks"))


@query(_GRAPH_SQL + "SELECT x.doc_id, x.concept_id AS src, y.concept_id AS dst, count(*) AS n_chunks FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.chunk_ord = y.chunk_ord AND x.pos < y.pos GROUP BY ALL")
def concept_co_occurs(table):
    return graph.edges_of(_graph(table)).filter("kind = 'co_occurs'").select("doc_id", "src", "dst", F.size("evidence_chunk_ids").cast("long").alias("n_chunks"))


@query(_GRAPH_SQL + """, e AS (SELECT doc_id, chunk_ord, arg_min(concept_id, pos) AS first, arg_max(concept_id, pos) AS last FROM a GROUP BY ALL),
l AS (SELECT doc_id, lag(last) OVER (PARTITION BY doc_id ORDER BY chunk_ord) AS src, first AS dst FROM e)
SELECT doc_id, src, dst, count(*) AS n_chunks FROM l WHERE src <> dst GROUP BY ALL""")
def concept_follows(table):
    return graph.edges_of(_graph(table)).filter("kind = 'follows'").select("doc_id", "src", "dst", F.size("evidence_chunk_ids").cast("long").alias("n_chunks"))


@query("""SELECT s_suppkey AS owner, 'n' || m.n_nationkey AS concept_id FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN nation m ON m.n_regionkey = n.n_regionkey
UNION SELECT s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def two_hop_context(table):
    """From a supplier's nation over its region to the region's nations."""
    links = table("nation").select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    start = table("supplier").select(F.lit(1).alias("doc_id"), F.col("s_suppkey").alias("owner"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("concept_id"))
    return graph.neighbourhood(start, links).select("owner", "concept_id")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER w AS rn, sum(length(text)) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
WHERE rn <= 24 AND (rn = 1 OR used <= 30000)""")
def context_bound(table):
    return contract.bounded(table("documents").select("source", "doc_id", F.length("text").alias("n")), ["source"], "doc_id", size=F.col("n")).select("source", "doc_id")


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
c AS (SELECT doc_id, ord, length(t) + length('p1-c' || ord) + 32 AS cost FROM l),
r AS (SELECT doc_id, ord, 0 AS batch, 1 AS n, cost AS used FROM c WHERE ord = 0
      UNION ALL SELECT c.doc_id, c.ord, CASE WHEN r.n >= 4 OR r.used + c.cost > 8000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 4 OR r.used + c.cost > 8000 THEN 1 ELSE r.n + 1 END,
             CASE WHEN r.n >= 4 OR r.used + c.cost > 8000 THEN c.cost ELSE r.used + c.cost END FROM r JOIN c ON c.doc_id = r.doc_id AND c.ord = r.ord + 1)
SELECT doc_id, CAST(ord AS INTEGER) AS chunk_ord, batch FROM r""")
def batch_packing(table):
    """Lines of documents as chunks, in the smaller batches of evidence."""
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_ord", "text")).withColumn("chunk_id", F.format_string("p1-c%d", "chunk_ord"))
    return chunking.plan_batches(lines, 4, 8000).select("doc_id", "chunk_ord", "batch")


@query(r"""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CAST(age AS INTEGER) AS age, CASE WHEN length(t) > 239 THEN substr(t, 1, 239) || '…' ELSE t END AS stem FROM r WHERE age <= 4""")
def rejection_memory(table):
    rows = table("conversations").select("conv_id", F.col("turn").alias("draft_ord"), F.lit(False).alias("passed"), F.col("text").alias("stem"), F.array().cast("array<struct<content:string>>").alias("choices"), F.array().cast("array<struct<gate:string,pass:boolean,reason:string>>").alias("gates"))
    return report.rejection_memory(rows, "conv_id").select("conv_id", F.col("draft_ord").alias("turn"), "age", "stem")


#: Drafts of a task of the sets, which holds each with its four values.
SET_ROWS = 150_000


def _sets(table) -> DataFrame:
    """Customers as sets, orders as candidates, lines as drafts. Lines and orders are dealt by order once, into tasks whose
    share doesn't grow with the tables; scores need no other shuffle."""
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    n = parts_for(lines.sparkSession, lines.count(), SET_ROWS)
    orders = table("orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition(n, "o_orderkey")
    rows = lines.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    total = F.col("o_totalprice").cast("long") % 61
    return rows.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("candidate"), (F.col("l_returnflag") != "R").alias("passed"), (F.col("l_returnflag") == "R").cast("int").alias("failing_gates"), F.col("l_partkey").cast("string").alias("atom_id"), F.col("l_linestatus").alias("skill"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").cast("string").alias("chunk_id"), total.alias("quality_total"), F.lit(60).cast("long").alias("quality_max"))


_SETS_SQL = """WITH s AS (SELECT o_custkey AS set_id, o_orderkey AS candidate, count(*) FILTER (l_returnflag <> 'R') * 1000000 + max((CAST(trunc(o_totalprice) AS BIGINT) % 61) * 1000 // 60) * 1000
 + count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') * 500 + count(DISTINCT l_linestatus) FILTER (l_returnflag <> 'R') * 100 + count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'R') * 75
 + count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R') * 25 - count(*) FILTER (l_returnflag = 'R') * 10 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
"""


@query(_SETS_SQL + "SELECT set_id, candidate, CAST(score AS BIGINT) AS score FROM s")
def set_scores(table):
    return report.set_scores(_sets(table), ["set_id", "candidate"]).select("set_id", "candidate", "score")


@query(_SETS_SQL + "SELECT set_id, candidate, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, candidate) AS rn FROM s) WHERE rn = 1")
def best_candidate(table):
    return report.best_sets(report.set_scores(_sets(table), ["set_id", "candidate"]), ["set_id"]).select("set_id", "candidate", "score")


@query("SELECT event_type AS \"case\", count(*) AS n, count(*) FILTER (value >= 50) AS accepted, count(*) FILTER (user_id % 2 = 0) AS on_target FROM events GROUP BY event_type")
def benchmark_tallies(table):
    return report.tallies(table("events").withColumnRenamed("event_type", "case"), "case", accepted=F.col("value") >= 50, on_target=F.col("user_id") % 2 == 0)


def _calls(events: DataFrame) -> DataFrame:
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.floor(F.col("value") * 1000))
    n = F.col("event_id")
    return events.select(F.col("event_type").alias("label"), start.alias("start_ts"), end.alias("end_ts"), F.lit(0).cast("long").alias("load_ms"), F.lit(0).cast("long").alias("prompt_ms"), F.floor("value").alias("eval_ms"), (n % 100).alias("prompt_tokens"), (n % 50).alias("eval_tokens"))


@query("""WITH c AS (SELECT event_type AS label, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 1000) AS BIGINT) AS b, CAST(floor(value) AS BIGINT) AS eval_ms, event_id % 100 AS p, event_id % 50 AS e FROM events),
s AS (SELECT label, count(*) AS calls, sum((b - a) / 1000.0::DOUBLE) AS total_ms, CAST(sum(eval_ms) AS BIGINT) AS eval_ms, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(e) AS BIGINT) AS eval_tokens FROM c GROUP BY ROLLUP (label)),
w AS (SELECT (max(b) - min(a)) / 1000.0::DOUBLE AS wall FROM c)
SELECT label, calls, round(total_ms, 3) AS total_ms, eval_ms, prompt_tokens, eval_tokens, round(total_ms / wall, 6) AS share, round(eval_tokens / (eval_ms / 1000.0::DOUBLE), 6) AS tokens_per_s FROM s, w""")
def call_stats(table):
    out = report.call_stats(_calls(table("events")))
    return out.select("label", "calls", F.round("total_ms", 3).alias("total_ms"), "eval_ms", "prompt_tokens", "eval_tokens", F.round("share", 6).alias("share"), F.round("tokens_per_s", 6).alias("tokens_per_s"))


def call_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running statistics of all events as a stream that ends when it has read them."""
    import uuid

    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be a file or a folder
    top = f"{scratch(spark)}/calls-{uuid.uuid4().hex}"
    calls.start(_calls(rows), f"{top}/stats", f"{top}/checkpoint", availableNow=True).awaitTermination()
    return calls.current(spark, f"{top}/stats").select("label", "calls", F.round("total_ms", 3).alias("total_ms"), "eval_tokens")


QUERIES["call_stats_stream"] = call_stats_stream
SQL["call_stats_stream"] = "SELECT event_type AS label, count(*) AS calls, round(sum(floor(value * 1000) / 1000.0::DOUBLE), 3) AS total_ms, CAST(sum(event_id % 50) AS BIGINT) AS eval_tokens FROM events GROUP BY event_type"


@query("SELECT r_regionkey AS course, n_nationkey AS lesson, c_custkey AS exam FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey")
def nested_tree(table):
    """Regions as courses, nations as lessons, customers as exams; the tree is flattened again for comparison."""
    tree = catalog.course_tree(
        table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title")),
        table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("course_id")),
        table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(False).alias("has_taken"), F.col("c_nationkey").alias("lesson_id")),
    )
    flat = tree.select(F.col("id").alias("course"), F.explode_outer("lessons").alias("l"))
    return flat.select("course", F.col("l.id").alias("lesson"), F.explode_outer("l.exams").alias("e")).select("course", "lesson", F.col("e.id").alias("exam"))


def _exam(table) -> tuple[DataFrame, DataFrame]:
    q = table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("exam_id"))
    c = table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("question_id"), (F.col("l_returnflag") == "R").alias("is_correct"))
    return q, c


@query("SELECT o_custkey AS exam_id, o_orderkey AS question_id, min(l_orderkey * 10 + l_linenumber) AS choice_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL")
def answer_key(table):
    return catalog.answer_key(*_exam(table))[0]


@query("SELECT o_custkey AS exam_id, o_orderkey AS question_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def questions_without_key(table):
    return catalog.answer_key(*_exam(table))[1]


@query("SELECT doc_id, 'no label' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown label' FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)")
def sheet_problems(table):
    """labels as a filled sheet against documents as the key."""
    key = table("documents").select(F.col("doc_id").alias("id"))
    sheet = key.join(table("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("odd").alias("label")), "id", "left")
    return report.sheet_problems(sheet, key).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ids_to_ask_again(table):
    return decode.reconcile(table("documents").select("doc_id"), table("labels").select("doc_id", F.lit(1).alias("reply_ord")), ("doc_id",))[1]


@query("""WITH r AS (SELECT source, doc_id, text, md5('1:' || coalesce(source, '') || ':' || doc_id) AS h FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY h, source, doc_id) AS n, CAST(length(CAST(count(*) OVER () AS VARCHAR)) AS INTEGER) AS w FROM r)
SELECT 'Q' || lpad(CAST(n AS VARCHAR), w, '0') AS id, source, doc_id AS original_index, 'A' AS correct_choice, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS INTEGER) AS n_chars FROM n""")
def blind_sheet(table):
    rows = table("documents").select("source", F.col("doc_id").alias("ordinal"), F.col("text").alias("stem"), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("choices"), F.lit("A").alias("correct"))
    sheet, key = report.blind_sheet(rows)
    return sheet.select("id", F.length("stem").alias("n_chars")).join(key, "id")


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_taken FROM customer")
def has_taken(table):
    return catalog.with_taken(table("customer").select(F.col("c_custkey").alias("id")), table("orders").select(F.col("o_custkey").alias("exam_id")))


@query("""WITH u AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT o_orderkey AS id FROM orders JOIN u ON o_custkey = u.id),
l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + 1 AS first FROM lineitem JOIN o ON l_orderkey = o.id), q AS (SELECT id FROM l WHERE first IN (SELECT id FROM l))
SELECT 'users' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM u UNION ALL SELECT 'courses', count(*), CAST(sum(id) AS BIGINT) FROM o UNION ALL SELECT 'exams', count(*), CAST(sum(id) AS BIGINT) FROM l WHERE id = first
UNION ALL SELECT 'lessons', count(*), CAST(sum(id) AS BIGINT) FROM l UNION ALL SELECT t, count(*), CAST(sum(id) AS BIGINT) FROM q, (VALUES ('questions'), ('choices')) x(t) GROUP BY t""")
def cascade_survivors(table):
    """What is left of each table when the customers of one segment are deleted: orders as courses, their lines as lessons,
    questions and choices, first lines as exams."""
    lines = table("lineitem").select(F.col("l_orderkey").alias("course_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), (F.col("l_orderkey") * 10 + 1).cast("long").alias("first"))
    tables = {
        "users": table("customer").select(F.col("c_custkey").cast("long").alias("id")),
        "courses": table("orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").alias("user_id")),
        "lessons": lines.select("id", "course_id"),
        "exams": lines.filter("id = first").select("id", F.col("id").alias("lesson_id")),
        "questions": lines.select("id", F.col("first").alias("exam_id")),
        "choices": lines.select("id", F.col("id").alias("question_id")),
    }
    gone = table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    left = catalog.cascade_delete(tables, gone)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("name"), "n", "ids") for name, df in left.items()])


@query("SELECT doc_id, source, CASE WHEN source = 'src0' THEN 0 ELSE 1 END AS priority FROM documents WHERE source <> ''")
def topup_pool(table):
    return rank.pool(table("documents").select("doc_id", "source", F.col("source").alias("lesson_id")), "src0").select("doc_id", "source", "priority")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount) / 2, 6) AS value FROM lineitem""")
def answer_key_audit(table):
    """Expressions over lineitem as text, evaluated as answer keys are: distinct ones once, joined back."""
    e = F.concat(F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.lit(" * (1 - "), F.col("l_discount").cast("decimal(12,2)").cast("string"), F.lit(") / 2"))
    return numbers.with_values(table("lineitem").select("l_orderkey", "l_linenumber", e.alias("expression"))).select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"))


@query(r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '\d+(?:\.\d+)?') AS x FROM documents)
SELECT doc_id, len(x) >= 3 AND len(list_filter(x, lambda y: contains(y, '.') OR length(regexp_replace(y, '^0+|0+$', '', 'g')) >= 3)) > 0 AS worth FROM n""")
def worth_calculating(table):
    return table("documents").select("doc_id", numbers.worth_calculating(F.col("text")).alias("worth"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def excerpts(table):
    return table("documents").select("doc_id", clip(F.col("text"), 80).alias("excerpt"))


@query("SELECT source, count(*) AS n, count(*) FILTER (lang IS NULL) AS unanswered, count(*) = (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY source)) AND (SELECT min(c) = max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY source)) AS equal_n FROM documents GROUP BY source")
def source_sizes(table):
    return report.source_sizes(table("documents").select("source", F.col("lang").alias("correct")))


@query(r"""SELECT conv_id, CAST(count(*) AS INTEGER) AS n_chunks, string_agg('[' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS request FROM conversations GROUP BY conv_id""")
def batch_requests(table):
    rows = table("conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("batch"), F.col("turn").alias("chunk_ord"), F.col("turn").cast("string").alias("chunk_id"), "text")
    return chunking.batch_requests(rows).select(F.col("doc_id").alias("conv_id"), "n_chunks", "request")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value >= 50) AS accepted FROM events GROUP BY user_id")
def acceptance_by_source(table):
    return report.tallies(table("events"), "user_id", accepted=F.col("value") >= 50)


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_nationkey = 7")
def courses_of_user(table):
    return catalog.courses_of(table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(True).alias("is_public"), F.col("c_nationkey").alias("user_id")), 7).select("id", "title")
