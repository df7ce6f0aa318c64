"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, mixing, negatives, packing, phrases, pii, quality, sharding, simhash, suffixes, token_files, topk
from .common import scratch, table
from .tokens import tokenizer_path

SHARD_BYTES = 1 << 20

_MD5_60 = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"
_WORD = r"[^\x20\x09-\x0D]+"


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    out = sharding.shard_documents(docs, SHARD_BYTES, size="n_bytes")
    return out.select("doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "shard_depth", "shard_prefix", "shard_bytes", "shard_docs")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, {_MD5_60} AS h FROM documents),
lv AS (SELECT d.*, lvl, h >> (60 - lvl) AS prefix FROM d, (SELECT unnest(generate_series(0, 60)) AS lvl)),
node AS (SELECT lvl, prefix, sum(n_bytes) AS b, count(*) AS n FROM lv GROUP BY ALL),
leaf AS (SELECT doc_id, min(lvl) AS depth FROM lv JOIN node USING (lvl, prefix) WHERE b <= {SHARD_BYTES} OR n = 1 OR lvl = 60 GROUP BY doc_id)
SELECT lv.doc_id, lv.n_bytes, CAST(lv.lvl AS INTEGER) AS shard_depth, lv.prefix AS shard_prefix, CAST(node.b AS BIGINT) AS shard_bytes, node.n AS shard_docs
FROM leaf JOIN lv ON lv.doc_id = leaf.doc_id AND lv.lvl = leaf.depth JOIN node ON node.lvl = lv.lvl AND node.prefix = lv.prefix
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix_copies(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
p AS (SELECT *, max(CASE WHEN cap / w > level THEN level END) OVER () AS shared FROM l),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN cap / w <= level THEN cap ELSE least(cap, w * shared) END AS target FROM p),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5(seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
      FROM r, range({mixing.SEEDS}) seeds(seed)),
b AS (SELECT source, arg_min(seed, (abs(got - target), seed)) AS seed FROM (SELECT source, seed, target, sum(taken) AS got FROM k GROUP BY ALL) GROUP BY source)
SELECT doc_id, size, source_size, target, taken FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.seed = b.seed
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


_NORMAL = rf"trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'))"
_QUALITY = rf"""
d AS (SELECT doc_id, source, coalesce(text, '') AS t, text IS NULL AS gone, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d WHERE NOT gone),
ow AS (SELECT doc_id, source, t, l, {_NORMAL} AS line FROM ln WHERE regexp_matches(l, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ow GROUP BY doc_id),
bad AS (SELECT source, line FROM ow GROUP BY source, line HAVING count(DISTINCT doc_id) > {quality.MAX_DOCS}),
cutw AS (SELECT doc_id, sum(len(regexp_extract_all(l, '{_WORD}'))) AS n FROM ow JOIN bad ON ow.source IS NOT DISTINCT FROM bad.source AND ow.line = bad.line GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cutw.n, 0) AS BIGINT) AS removed_words
         FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN cutw USING (doc_id)),
verdict AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - removed_words >= {quality.MIN_LEFT}::DOUBLE * n_words AS full_enough FROM base)
"""
OP5_SQL = f"WITH {_QUALITY} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND full_enough AS kept, removed_words FROM verdict"


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "token-files")
    token_files.write_documents(docs, tokenizer_path("byte_bpe_50k.json"), folder)
    read = token_files.read_files(spark, folder)
    return read.select("doc_id", "start", F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.i <> q.i),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.digest(F.col("spans"), pii.BASE), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    read = chat.read_back(chat.format_conversations(rows.unionByName(more)))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned_text").cast("long").alias("loss_chars"), F.sha2("learned_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?TURN\]|TEXT\]|/?INST\])', '\1\2\\\3', 'g')"
OP10_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(6 + 6 + 7 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k AS size, w[i : i + k - 1] AS g FROM w, (VALUES (1), (2), (3)) ks(k), unnest(generate_series(1, len(w) - k + 1)) u(i) WHERE len(w) >= k),
f AS (SELECT lang, size, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, g, f AS a FROM f WHERE size > 1 AND f >= 10),
s AS (SELECT c.*, k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM c, unnest(generate_series(1, size - 1)) u(k)
      JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT lang, g[1:2] AS g, a FROM c WHERE size = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE size = 3),
most AS (SELECT lang, g, max(a) AS longer FROM held GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, n, score FROM b JOIN n ON n.lang = b.lang LEFT JOIN most ON most.lang = b.lang AND most.g = b.g WHERE coalesce(100 * longer < 50 * b.a, true)),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM e, unnest(range(n - 399)) u(i) WHERE n >= 400),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM c)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM s),
k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
p AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY r, run),
l AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS gone FROM p GROUP BY r),
o AS (SELECT doc_id, n, h, coalesce(spans, 0) AS spans, coalesce(gone, 0) AS gone, list_prepend(0, coalesce(b, [])) AS f, list_append(coalesce(a, []), n) AS t FROM e LEFT JOIN l ON l.r = e.r)
SELECT doc_id, n AS n_bytes, gone AS n_removed, spans AS n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(f) + 1), lambda j: substr(h, 2 * f[j] + 1, 2 * (t[j] - f[j]))), ''))) AS kept_sha256 FROM o
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS i, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a, v c WHERE a.vec_id % 50 = 0 AND c.i <> a.i),
p AS (SELECT i, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5),
r AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.i, k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.i = p.i AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM r WHERE rank <= 3
"""

QUERIES = {
    "op1_extendible_shards": op1_extendible_shards,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_simhash_components": op7_simhash_components,
    "op8_exact_topk": op8_exact_topk,
    "op9_personal_data": op9_personal_data,
    "op10_chat_format": op10_chat_format,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {
    "op1_extendible_shards": OP1_SQL,
    "op4_mix_sources": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_exact_topk": OP8_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_suffix_dedup": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
