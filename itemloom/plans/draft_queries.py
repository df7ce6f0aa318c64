"""Registered queries over drafted questions, which are made from the given tables, and over their evidence and reports.
Each SQL states the rule anew; only the making of the drafts is shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import chunking, contract, decode, gates, graph, provenance, rank, report
from .queries import query, same_stems_sql


def _made(w, arr) -> tuple[str, str, str]:
    """Stem, choices and which of them are right, as SQL over doc_id, k (what is wrong with the draft) and words w."""
    o = [w(6, 3), w(9, 3), w(12, 3), w(15, 3)]
    said = "'It is said further down in this part of the text that '"
    stem = f"""CASE k WHEN 0 THEN 'What?' WHEN 1 THEN 'Name ' || {w(1, 6)} WHEN 2 THEN 'According to the passage, what is ' || {w(1, 4)} || '?'
      WHEN 3 THEN 'What is the learning objective of ' || {w(1, 4)} || '?' ELSE 'Which of these is said about ' || {w(1, 5)} || '?' END"""
    choices = f"""CASE k WHEN 4 THEN {arr(o[0], o[0] + " || ' '", o[1], o[2])} WHEN 5 THEN {arr(*o[:3], "' '")} WHEN 6 THEN {arr(o[0], o[1] + " || '�'", o[2], o[3])}
      WHEN 7 THEN {arr(w(1, 5), *o[1:])} WHEN 8 THEN {arr(w(6, 20), w(2, 1), w(3, 1), w(4, 1))} WHEN 9 THEN {arr(*[f"{said} || {x}" for x in o])}
      WHEN 11 THEN {arr(*[f"{w(1, 5)} || ' and ' || {x}" for x in o])} ELSE {arr(*o)} END"""
    right = f"CASE k WHEN 10 THEN {arr('true', 'true', 'false', 'false')} ELSE {arr(*[f'doc_id % 4 = {i}' for i in range(4)])} END"
    return stem, choices, right


def _drafts(table) -> DataFrame:
    """A draft for each document, with its text as the chunk."""
    stem, choices, right = _made(lambda i, n: f"array_join(slice(w, {i}, {n}), ' ')", lambda *x: f"array({', '.join(x)})")
    rows = table("documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 12).alias("k"))
    rows = rows.withColumn("w", F.split(text.collapse(F.col("text")), " "))
    rows = rows.withColumns({"stem": F.expr(stem), "choices": F.expr(f"zip_with({choices}, {right}, (c, r) -> struct(c AS content, r AS is_correct))")})
    return rows.drop("w")


_DRAFTS = """WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, doc_id % 12 AS k, string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
d AS (SELECT doc_id, source, lang, text, k, {} AS stem, {} AS c, {} AS r FROM t)
""".format(*_made(lambda i, n: f"array_to_string(w[{i}:{i + n - 1}], ' ')", lambda *x: f"[{', '.join(x)}]"))


def _run_sql(a: str, b: str) -> str:
    """The length of the longest text that stands in both."""
    return f"coalesce(list_max(list_transform(range(1, length({b}) + 1), lambda i: list_max(list_transform(range(0, length({b}) - i + 2), lambda n: CASE WHEN contains({a}, substr({b}, i, n)) THEN n ELSE 0 END)))), 0)"


def _shared_sql(a: str, b: str, n: str) -> str:
    """The first text of length n in a that stands in b."""
    return f"coalesce(list_filter(list_transform(range(1, length({a}) - {n} + 2), lambda i: substr({a}, i, {n})), lambda x: contains({b}, x))[1], '')"


_SQUEEZED = r"regexp_replace(lower({}), '\s+', '', 'g')"


@query(_DRAFTS + rf""", e AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS x, {_SQUEEZED.format("stem")} AS s FROM d),
f AS (SELECT doc_id, i, s, {_SQUEEZED.format("x")} AS q, length(trim(x)) AS size FROM e),
g AS (SELECT doc_id, s, list(q ORDER BY i) AS q, list({_run_sql("s", "q")} ORDER BY i) AS runs, max(size) AS big, min(size) AS small, bool_and(size >= 40) AS long FROM f GROUP BY doc_id, s),
h1 AS (SELECT doc_id, q, q[1] AS a, {_run_sql("q[1]", "q[2]")} AS n FROM g WHERE long), s1 AS (SELECT doc_id, q, {_shared_sql("a", "q[2]", "n")} AS a FROM h1),
h2 AS (SELECT doc_id, q, a, {_run_sql("a", "q[3]")} AS n FROM s1), s2 AS (SELECT doc_id, q, {_shared_sql("a", "q[3]", "n")} AS a FROM h2),
h3 AS (SELECT doc_id, {_run_sql("a", "q[4]")} AS common FROM s2)
SELECT doc_id, CASE WHEN length(trim(stem)) < 15 THEN 'stem is only ' || length(trim(stem)) || ' characters'
 WHEN NOT regexp_matches(trim(stem), '[?？]$') AND NOT regexp_matches(lower(stem), 'what|which|how|why|when|who|where|calculate|find the|simplify|solve|evaluate|convert|write the answer|determine|reduce')
  THEN 'stem asks nothing: ' || CASE WHEN length(trim(stem)) > 80 THEN substr(trim(stem), 1, 80) || '…' ELSE trim(stem) END
 WHEN contains(lower(stem), 'according to the passage') THEN 'stem points at unseen material: according to the passage'
 WHEN contains(lower(stem), 'learning objective') THEN 'stem asks about teaching: learning objective'
 WHEN small = 0 THEN 'a choice is empty' WHEN len(list_filter(r, lambda x: x)) <> 1 THEN 'not exactly one choice is correct'
 WHEN contains(stem, '�') OR contains(array_to_string(c, ''), '�') THEN 'unreadable characters'
 WHEN len(list_distinct(q)) < 4 THEN 'two choices are the same'
 WHEN list_max(runs) >= 0.6 * length(s) THEN 'a choice repeats the stem'
 WHEN length(s) >= 30 AND list_min(runs) >= 20 THEN 'every choice restates the question'
 WHEN big >= 25 AND big / small > 2.5 THEN 'choices are not parallel'
 WHEN long AND common >= 40 THEN 'choices are formulaic' END AS malformed
FROM d JOIN g USING (doc_id) LEFT JOIN h3 USING (doc_id)""")
def malformed_drafts(table):
    """The first thing wrong with each draft (Q1, Q1a to Q1j)."""
    return gates.well_formed(_drafts(table)).select("doc_id", "malformed")


_HEADING = "ตรวจสอบความรู้ก่อนเรียน"
_QUOTED = "CASE WHEN doc_id % 5 = 0 THEN {0} WHEN doc_id % 5 = 1 THEN 'never ' || {1} ELSE '“' || {2} || '”' END"


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM documents),
q AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN '{_HEADING[:12]} {_HEADING[12:]}' || chr(10) ELSE '' END || text AS chunk, CASE WHEN doc_id % 5 = 0 THEN w[2] WHEN doc_id % 5 = 1 THEN 'never ' || array_to_string(w[3:9], ' ') ELSE array_to_string(w[3:9], ' ') END AS quote FROM t),
v AS (SELECT doc_id, doc_id % 17 = 4 AS unknown, chunk, coalesce(trim(quote), '') AS quote FROM q)
SELECT doc_id, CASE WHEN unknown THEN 'the cited chunk is unknown' WHEN contains(regexp_replace(chunk, '\s+', '', 'g'), '{_HEADING}') THEN 'the chunk is a pre-learning check' ELSE '' END AS source_role,
 CASE WHEN length(quote) < 12 THEN 'the quote is too short' WHEN unknown OR NOT contains(regexp_replace(chunk, '\s+', '', 'g'), regexp_replace(quote, '\s+', '', 'g')) THEN 'the quote is not in the chunk' ELSE '' END AS quote_verbatim FROM v""")
def source_gates(table):
    """Whether a draft's chunk may be cited and has its quote (Q2, Q3, JN1, F3, F5, F15)."""
    slot = lambda i, n: f"array_join(slice(split(w, ' '), {i}, {n}), ' ')"
    rows = _drafts(table).withColumn("w", text.collapse(F.col("text")))
    chunks = rows.filter("doc_id % 17 <> 4").select("doc_id", F.lit("p1-c0").alias("chunk_id"), F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit(f"{_HEADING[:12]} {_HEADING[12:]}\n"), "text")).otherwise(F.col("text")).alias("text"), F.lit("").alias("source_role"))
    quote = F.expr(_QUOTED.format(slot(2, 1), slot(3, 7), slot(3, 7)))
    drafts = rows.select("doc_id", F.lit("p1-c0").alias("chunk_id"), "stem", "choices", quote.alias("source_quote"), F.lit("recall").alias("skill"), F.lit(None).cast("struct<expression:string,expected:double,unit:string>").alias("calculation"))
    long_ = gates.gate_rows(gates.cheap_gates(drafts, chunks), ["doc_id"])
    return long_.groupBy("doc_id").pivot("gate", ["source_role", "quote_verbatim"]).agg(F.first("reason"))


_SUM = """CASE WHEN p_partkey % 7 = 0 THEN 'a lot' WHEN p_partkey % 7 = 1 THEN concat(CAST(p_size * 1000 AS {s}), ',', '000 kg') WHEN p_partkey % 7 = 2 THEN concat(CAST(v AS {s}), ' newton')
 WHEN p_partkey % 7 = 3 THEN concat(CAST(v AS {s}), ' kg m') WHEN p_partkey % 7 = 4 THEN concat('about ', CAST(v AS {s}), ' m/s²') WHEN p_partkey % 7 = 5 THEN concat(CAST(v + 1 AS {s}), ' kg') ELSE concat('x^', CAST(p_size AS {s}), '/2 kg') END"""
_CALC = """(SELECT p_partkey, p_name, p_size, p_size * (p_partkey % 9 + 1) AS v FROM {part})"""


@query(f"""WITH p AS {_CALC.format(part="part")}, c AS (SELECT *, {_SUM.format(s="VARCHAR")} AS choice, p_partkey % 5 = 0 AS off, CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'm/s^2' WHEN 2 THEN 'kg**' ELSE '' END AS unit, p_partkey % 11 = 2 AS broken FROM p),
m AS (SELECT *, contains(replace(choice, ',', ''), CAST(v AS VARCHAR)) OR v <= 20 AND contains(choice, ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty'][least(v, 20) + 1])
 OR regexp_matches(choice, '^x') AS shown FROM c)
SELECT p_partkey, CASE WHEN broken THEN 'the expression has no value' WHEN off THEN 'the value is not the expected one' WHEN NOT shown THEN 'the correct choice shows another value' ELSE '' END AS arithmetic,
 CASE WHEN unit = '' THEN '' WHEN unit = 'kg**' THEN 'the unit is malformed' WHEN contains(replace(replace(choice, '²', '^2'), ' ', ''), unit) THEN '' ELSE 'the unit is not in the correct choice' END AS unit_check FROM m""")
def calculation_gates(table):
    """Whether a calculation holds and its answer shows value and unit."""
    rows = table("part").selectExpr("p_partkey", "p_name", "p_size", "p_size * (p_partkey % 9 + 1) AS v").withColumn("right", F.expr(_SUM.format(s="STRING")))
    calc = """struct(CASE WHEN p_partkey % 11 = 2 THEN concat(p_size, ' * (') ELSE concat('(', p_size, ' + 0) × ', p_partkey % 9 + 1) END AS expression,
        CAST(v + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS expected, CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'm/s^2' WHEN 2 THEN 'kg**' ELSE '' END AS unit)"""
    choice = "array(struct('none of it' AS content, false AS is_correct), struct(right AS content, true AS is_correct))"
    drafts = rows.select("p_partkey", F.col("p_partkey").alias("doc_id"), F.lit("p1-c0").alias("chunk_id"), F.concat(F.lit("Calculate the load of every "), "p_name").alias("stem"), F.expr(choice).alias("choices"), F.lit("").alias("source_quote"), F.lit("calculation").alias("skill"), F.expr(calc).alias("calculation"))
    chunks = rows.select(F.col("p_partkey").alias("doc_id"), F.lit("p1-c0").alias("chunk_id"), F.col("p_name").alias("text"), F.lit("core").alias("source_role"))
    long_ = gates.gate_rows(gates.cheap_gates(drafts, chunks), ["p_partkey"])
    return long_.groupBy("p_partkey").pivot("gate", ["arithmetic", "unit_check"]).agg(F.first("reason"))


def _lines(table) -> DataFrame:
    """lineitem with n, which numbers the lines of an order; lines equal in all that is used here are alike."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return table("lineitem").withColumn("i", F.row_number().over(w)).withColumn("n", F.col("i").cast("string"))


_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS n FROM lineitem)"


@query("""SELECT l_orderkey, CAST(n AS INTEGER) AS n, CASE WHEN l_partkey % 13 = 0 THEN 'unknown slot' WHEN l_partkey % 11 = 0 THEN 'another atom than the slot''s' WHEN l_partkey % 7 = 0 THEN 'the chunk does not support the atom'
 WHEN l_suppkey % 5 = 0 THEN 'the chunk is outside the context' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'the calculation is missing' WHEN l_returnflag = 'N' AND l_partkey % 3 = 0 THEN 'another difficulty'
 WHEN l_linestatus = 'O' AND l_partkey % 2 = 0 THEN 'another skill' WHEN l_partkey % 17 = 3 THEN 'the quote does not cover the evidence' END AS off_contract FROM """ + _LINES)
def contract_gate(table):
    """Lines as drafts, each for its own slot (Q6)."""
    line = _lines(table).withColumns({"doc_id": F.col("l_orderkey"), "lesson_id": F.lit("L01")})
    chunk = "concat('c', n)"
    skill = "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Calculation' WHEN l_linestatus = 'O' THEN 'recall' ELSE '' END"
    slots = line.filter("l_partkey % 13 <> 0").selectExpr("doc_id", "lesson_id", "concat('S', n) AS slot_id", "concat('A', n) AS atom_id", f"array({chunk}) AS source_chunk_ids", f"{skill} AS skill", "CASE WHEN l_returnflag = 'N' THEN 'easy' ELSE '' END AS difficulty", "'mass of  two' AS evidence_quote")
    context = line.filter("l_suppkey % 5 <> 0").selectExpr("doc_id", "lesson_id", f"{chunk} AS chunk_id")
    drafts = line.selectExpr("l_orderkey", "i", "doc_id", "lesson_id", "concat('S', n) AS coverage_slot_id", "CASE WHEN l_partkey % 11 = 0 THEN 'A0' ELSE concat('A', n) END AS evidence_atom_id",
        f"CASE WHEN l_partkey % 7 = 0 THEN 'c0' ELSE {chunk} END AS evidence_chunk_id", "CASE WHEN l_partkey % 3 = 0 THEN 'hard' ELSE ' Easy' END AS difficulty", "CASE WHEN l_partkey % 2 = 0 THEN 'application' ELSE 'recall ' END AS skill",
        "CASE WHEN l_partkey % 17 = 3 THEN 'another thing' ELSE 'a mass of two kilograms' END AS source_quote", "CAST(NULL AS struct<expression:string>) AS calculation")
    return gates.coverage_gate(drafts, slots, context).select("l_orderkey", F.col("i").alias("n"), "off_contract")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
v AS (SELECT *, n // 3 AS visit FROM o), c AS (SELECT o_custkey, visit, count(*) FILTER (p LIKE '1%' OR p LIKE '2%') AS ok FROM v GROUP BY ALL),
b AS (SELECT *, coalesce(sum(ok) OVER (PARTITION BY o_custkey ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY visit) AS nth FROM c)
SELECT o_custkey, o_orderkey FROM v JOIN b USING (o_custkey, visit) WHERE before < 2 AND nth <= 4""")
def within_budget(table):
    """Orders as drafts, three to a chunk: those a run would have come to."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table("orders").select("o_custkey", "o_orderkey", F.floor(n / 3).alias("visit"), F.col("o_orderpriority").rlike("^[12]").alias("passed"))
    return gates.within_budget(rows, ["o_custkey"], 2, 4).select("o_custkey", "o_orderkey")


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS one FROM conversations),
a AS (SELECT conv_id, turn, one, CASE WHEN turn % 3 = 2 THEN '' ELSE substr(one, 1, 12) END AS claim, CASE WHEN conv_id % 6 = 1 THEN 'no such words' ELSE trim(substr(one, 4, 20)) END AS quote, CASE WHEN turn % 2 = 0 THEN 'Causal' ELSE 'definition' END AS relation FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY turn) AS rn FROM a WHERE trim(claim) <> '' AND quote <> '' AND contains(one, quote))
SELECT conv_id, turn, 'A' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS atom_id, trim(claim) AS claim, CASE WHEN turn % 2 = 0 THEN 'C001' ELSE '' END AS concepts FROM b WHERE rn = 1""")
def evidence_atoms(table):
    """Turns as chunks with two atoms each, the second equal to the first but for case (K2, JN9, U5, W5)."""
    chunks = table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("chunk_id"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"), "turn", "conv_id").withColumn("one", text.collapse(F.col("text")))
    nodes = chunks.select("doc_id", F.lit("C001").alias("concept_id")).distinct()
    made = chunks.selectExpr("doc_id", "conv_id", "turn", "chunk_id", "CASE WHEN turn % 3 = 2 THEN '' ELSE substr(one, 1, 12) END AS claim", "CASE WHEN conv_id % 6 = 1 THEN 'no such words' ELSE substr(one, 4, 20) END AS quote",
        "CASE WHEN turn % 2 = 0 THEN 'Causal' ELSE 'definition' END AS relation", "CASE WHEN turn % 2 = 0 THEN array('C009', 'C001', 'C001') ELSE array('C009') END AS concept_ids", "array('recall') AS question_forms")
    atoms = made.withColumn("atom_ord", 2 * F.col("turn")).unionByName(made.withColumn("atom_ord", 2 * F.col("turn") + 1).withColumn("relation", F.lower("relation")))
    return graph.source_bound_atoms(atoms, chunks.select("doc_id", "chunk_id", "page", "text"), nodes).select("conv_id", "turn", "atom_id", "claim", F.array_join("concept_ids", ",").alias("concepts"))


@query(r"""WITH b AS (SELECT conv_id, count(*) FILTER (conv_id % 6 <> 1 AND turn % 3 <> 2 AND length(trim(substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 4, 20))) > 0) AS n FROM conversations GROUP BY conv_id) SELECT conv_id FROM b WHERE n = 0""")
def evidence_refused(table):
    """Conversations of which no atom holds (K2)."""
    chunks = table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("chunk_id"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"), "turn", "conv_id")
    atoms = chunks.withColumn("one", text.collapse(F.col("text"))).selectExpr("doc_id", "chunk_id", "CASE WHEN turn % 3 = 2 THEN '' ELSE 'it is so' END AS claim", "CASE WHEN conv_id % 6 = 1 THEN 'no such words' ELSE substr(one, 4, 20) END AS quote", "'causal' AS relation", "array('C001') AS concept_ids", "turn AS atom_ord")
    good = graph.source_bound_atoms(atoms, chunks, chunks.select("doc_id", F.lit("C001").alias("concept_id")).distinct())
    return graph.without_evidence(chunks, good).select(F.col("doc_id").alias("conv_id"))


@query(f"WITH s AS (SELECT l_orderkey, n, l_partkey, CASE WHEN l_partkey % 9 = 0 THEN 'unknown' WHEN l_suppkey % 8 = 0 THEN 'outside' END AS bad FROM {_LINES})," + """
t AS (SELECT *, CASE WHEN bad = 'unknown' THEN 'drop: unknown atom A' || n WHEN bad = 'outside' THEN 'drop: atom A' || n || ' is outside the context' END AS why FROM s)
SELECT l_orderkey, 'S' || n AS slot_id, why AS change FROM t WHERE why IS NOT NULL
UNION ALL SELECT l_orderkey, 'S' || n, 'repair: the atom''s quote' FROM t WHERE why IS NULL AND l_partkey % 4 = 0
UNION ALL SELECT l_orderkey, 'S' || n, 'downgrade: calculation to recall' FROM t WHERE why IS NULL AND l_partkey % 3 = 0
UNION ALL SELECT l_orderkey, 'T' || n, CASE WHEN why IS NULL THEN 'drop: atom A' || n || ' is taken' ELSE why END FROM t WHERE l_partkey % 5 = 0""")
def preflight_changes(table):
    """Slots for the lines of an order, some twice: what preflight changes (K7, JN11, F8, F22)."""
    line = _lines(table).selectExpr("l_orderkey AS doc_id", "i", "l_partkey", "l_suppkey", "n")
    atoms = line.filter("l_partkey % 9 <> 0").selectExpr("doc_id", "concat('A', n) AS atom_id", "concat('c', n) AS chunk_id", "'what force is' AS claim", "'a push or pull' AS quote", "CASE WHEN l_partkey % 3 = 0 THEN 'Definition' ELSE 'causal' END AS relation", "array('recall') AS question_forms")
    context = line.filter("l_suppkey % 8 <> 0").selectExpr("doc_id", "'L01' AS lesson_id", "concat('c', n) AS chunk_id", "'force is a push  or pull on a body' AS text")
    one = line.selectExpr("doc_id", "'L01' AS lesson_id", "concat('S', n) AS slot_id", "i AS slot_ord", "concat('A', n) AS atom_id", "array('') AS source_chunk_ids", "'Calculation' AS skill", "CASE WHEN l_partkey % 4 = 0 THEN 'a pull or push' ELSE 'a push or pull' END AS evidence_quote", "'' AS operation", "l_partkey")
    slots = one.unionByName(one.filter("l_partkey % 5 = 0").withColumns({"slot_id": F.regexp_replace("slot_id", "S", "T"), "slot_ord": F.col("slot_ord") + 1_000_000})).drop("l_partkey")
    _, changes = contract.preflight(slots, atoms, context)
    return changes.select(F.col("doc_id").alias("l_orderkey"), "slot_id", "change")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' WHEN conv_id % 5 = 0 THEN '' ELSE 'S' || turn END AS coverage_slot_id FROM conversations WHERE length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) > 0""")
def repaired_provenance(table):
    """Turns as chunks with one atom and one slot each; drafts that quote it get the slot, where skills agree (K8, JN10)."""
    t = table("conversations").selectExpr("conv_id AS doc_id", "conv_id", "turn", "CAST(turn AS STRING) AS n", "concat('[', turn, '] ', text) AS text").filter(text.squeeze(F.regexp_replace("text", r"^\[\d+\]", "")) != "")
    chunks = t.selectExpr("doc_id", "n AS chunk_id", "text")
    atoms = t.selectExpr("doc_id", "concat('A', n) AS atom_id", "n AS chunk_id", "substr(text, 1, 30) AS quote")
    slots = t.selectExpr("doc_id", "1 AS run_id", "concat('S', n) AS slot_id", "concat('A', n) AS atom_id", "array(n) AS source_chunk_ids", "CASE WHEN conv_id % 5 = 0 THEN 'recall' ELSE '' END AS skill", "'' AS difficulty")
    drafts = t.selectExpr("doc_id", "conv_id", "turn", "1 AS run_id", "turn AS draft_ord", "CASE WHEN turn % 4 = 0 THEN 'nobody said so' ELSE substr(text, 1, 20) END AS source_quote", "'application' AS skill", "'' AS difficulty", "'' AS coverage_slot_id", "'' AS evidence_atom_id", "'' AS evidence_chunk_id", "'' AS chunk_id")
    return provenance.repair_provenance(drafts, atoms, slots, chunks).select("conv_id", "turn", "coverage_slot_id")


@query("""WITH q AS (SELECT l_orderkey, list(l_linenumber - 1 ORDER BY l_linenumber) AS i, list(l_partkey % 6 ORDER BY l_linenumber) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n AS n_questions, CAST(list_sum(s) AS BIGINT) AS total, 4 * n AS most, list_max(s) <= 4 AND list_max(i) < n AND len(list_distinct(i)) = n AS whole FROM q""")
def quality_reports(table):
    """Orders as sets, lines as verdicts; a score of five is out of range (A5)."""
    line = table("lineitem")
    verdicts = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("question_index"), (F.col("l_partkey") % 6).alias("score"))
    return report.quality_reports(verdicts, line.groupBy("l_orderkey").agg(F.count("*").alias("n_questions")), "l_orderkey")


@query("SELECT source, count(DISTINCT lang) FILTER (quality = 0) AS apparatus, count(DISTINCT lang) FILTER (quality = 1) AS non_content FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en' GROUP BY source")
def dropped_topics(table):
    """Languages as topics: those of low quality as apparatus."""
    rows = table("documents").join(table("labels"), "doc_id").filter("lang <> 'en'")
    topics = F.array(F.concat(F.lit(" "), F.col("lang")), F.col("lang"))
    return graph.dropped_topics(rows.select(F.col("source").alias("doc_id"), F.when(F.col("quality") == 0, "apparatus").otherwise("non_content").alias("kind"), topics.alias("topics"))).withColumnRenamed("doc_id", "source")


@query("""SELECT conv_id, turn, CAST(age AS INTEGER) AS age FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE role = 'assistant') WHERE age <= 6""")
def last_accepted(table):
    """The last six answers of each conversation."""
    rows = table("conversations").select("conv_id", F.col("turn").alias("draft_ord"), (F.col("role") == "assistant").alias("passed"), F.col("text").alias("stem"))
    return report.last_accepted(rows.filter("passed"), "conv_id").select("conv_id", F.col("draft_ord").alias("turn"), "age")


@query("""WITH d AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS done FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN turn < done THEN 'completed' WHEN turn = done THEN 'CURRENT' ELSE 'upcoming' END AS status FROM conversations JOIN d USING (conv_id)""")
def slot_status(table):
    """Turns as plan slots, answers as what is done."""
    c = table("conversations")
    return report.slot_status(c.select("conv_id", "turn", F.col("turn").alias("position")), c.filter("role = 'assistant'"), ["conv_id"]).select("conv_id", "turn", "status")


@query("SELECT lang, min(doc_id) AS doc_id FROM documents WHERE contains(lower(source), 'c1') GROUP BY lang")
def pick_lesson(table):
    """The first document of each language whose source has a fragment (JN19)."""
    rows = table("documents").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("lesson_id"), F.col("doc_id").alias("lesson_pos"), F.col("source").alias("title"))
    return report.pick_lesson(rows, "C1").select(F.col("doc_id").alias("lang"), F.col("lesson_id").alias("doc_id"))


@query("SELECT item_id FROM benchmark WHERE contains(lower(text), 'there')")
def search_items(table):
    """Items in which a text stands."""
    return report.search(table("benchmark").select("item_id", "text"), "There").select("item_id")


@query("""WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'wrong' WHEN quality = 1 THEN 'good' ELSE 'trivial' END AS l FROM labels)
SELECT l AS label, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1 FROM l JOIN documents USING (doc_id) GROUP BY l HAVING count(*) FILTER (source IN ('src0', 'src1')) > 0""")
def label_matrix(table):
    """Labels by two sources, side by side."""
    rows = table("labels").join(table("documents").select("doc_id", "source"), "doc_id").filter("source IN ('src0', 'src1')")
    return report.label_matrix(rows.selectExpr("source", "CASE WHEN toxic = 1 THEN 'wrong' WHEN quality = 1 THEN 'good' ELSE 'trivial' END AS label"), ["src0", "src1"])


@query("""WITH i AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IN ('src0', 'src1', 'src2'))
SELECT CAST(i AS INTEGER) AS i, min(doc_id) FILTER (source = 'src0') AS src0, min(doc_id) FILTER (source = 'src1') AS src1, min(doc_id) FILTER (source = 'src2') AS src2, CAST(least((i - 1) // 5, 2) AS BIGINT) AS category FROM i GROUP BY i""")
def comparison(table):
    """Documents of three sources side by side (JN18, R9, W11)."""
    rows = table("documents").filter("source IN ('src0', 'src1', 'src2')").select("source", F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("stem"))
    return report.comparison(rows, ["src0", "src1", "src2"])


@query("""SELECT event_type AS "case", count(*) AS n, count(*) FILTER (value >= 50) AS accepted, count(*) FILTER (user_id % 4 = 0) AS calculations, count(*) FILTER (event_id % 3 = 1) AS on_skill,
 count(*) FILTER (event_id % 3 = 1 AND (user_id % 2 = 0 OR event_id % 5 = 0)) AS on_target, count(*) FILTER (event_id % 3 = 1 AND (user_id % 2 = 0 OR event_id % 5 = 0) AND value >= 50) AS accepted_on_target FROM events GROUP BY event_type""")
def case_tallies(table):
    """Events as drafts of a benchmark suite whose cases are their types."""
    rows = table("events").selectExpr("event_type AS `case`", "value >= 50 AS passed", "IF(user_id % 4 = 0, 1, NULL) AS calculation", "event_id % 3 AS skill", "1 AS target_skill", "IF(user_id % 2 = 0, NULL, 'easy') AS target_difficulty", "IF(event_id % 5 = 0, 'easy', 'hard') AS difficulty")
    return report.case_tallies(rows)


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 85 WHEN 'SMALL' THEN 45 ELSE 40 END AS worth, CASE WHEN p_size % 3 = 0 THEN 'application' WHEN p_size % 3 = 1 THEN 'recall' ELSE 'understanding' END AS skill FROM part""")
def relation_worth(table):
    """What a relation is worth, and the skill that an atom falls back on."""
    rows = table("part").selectExpr("p_partkey", "CASE p_type WHEN 'ECONOMY' THEN ' Causal' WHEN 'SMALL' THEN 'definition' ELSE p_type END AS relation", "CASE WHEN p_size % 3 = 0 THEN array('recall', 'Application') WHEN p_size % 3 = 1 THEN array('recall') ELSE array('calculation') END AS forms")
    return rows.select("p_partkey", contract.relation_worth(F.col("relation")).alias("worth"), contract.fallback_skill(F.col("forms")).alias("skill"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_partkey % 6 = 0 THEN 'calculation' WHEN p_size % 4 = 1 THEN 'application' END AS skill, CASE WHEN p_partkey % 3 = 0 THEN 'hard' WHEN p_partkey % 3 = 1 THEN 'easy' END AS difficulty FROM part""")
def directive_targets(table):
    """The skill and the difficulty that a directive asks for."""
    ask = "concat(CASE p_size % 4 WHEN 0 THEN 'Set skill to Calculation' WHEN 1 THEN 'Write application questions' ELSE 'Write about ' || p_name END, CASE p_partkey % 3 WHEN 0 THEN ' at hard level' WHEN 1 THEN ', difficulty to EASY' ELSE '' END)"
    skill, level = contract.directive_targets(F.col("ask"), F.col("only"))
    rows = table("part").select("p_partkey", F.expr(ask).alias("ask"), (F.col("p_partkey") % 6 == 0).alias("only"))
    return rows.select("p_partkey", skill.alias("skill"), level.alias("difficulty"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality IS DISTINCT FROM 0) AS n_teaching FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def content_only(table):
    """Documents as labelled chunks: all of them kept, and content only."""
    rows = table("documents").select("doc_id", "source").join(table("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("kind", F.when(F.col("quality") == 0, "apparatus").otherwise("content"))
    kept = decode.keep_everything(rows).filter("kind = 'content'").groupBy("source").agg(F.count("*").alias("n"))
    return kept.join(decode.teaching(rows).groupBy("source").agg(F.count("*").alias("n_teaching")), "source", "left").fillna(0, ["n_teaching"])


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS INTEGER) AS nth, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)""")
def lesson_chunks(table):
    """Orders as lessons that list parts; those in the table in the order of the list (JN2)."""
    order = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"])
    lessons = table("lineitem").groupBy(F.col("l_orderkey").alias("lesson_id")).agg(order.alias("chunk_ids")).withColumn("doc_id", F.lit(1))
    chunks = table("part").filter("p_size % 2 = 0").select(F.lit(1).alias("doc_id"), F.col("p_partkey").alias("chunk_id"))
    return graph.listed_chunks(lessons, chunks).select(F.col("lesson_id").alias("l_orderkey"), "nth", F.col("chunk_id").alias("l_partkey"))


@query("""SELECT source, count(*) AS n_chunks, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS n_orphans FROM documents GROUP BY source""")
def orphan_chunks(table):
    """Documents as chunks of their source, labels as lessons."""
    rows = table("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id")).join(table("labels").select(F.col("doc_id").alias("chunk_id"), F.lit("L01").alias("lesson_id")), "chunk_id", "left")
    return chunking.orphans(rows).withColumnRenamed("doc_id", "source")


@query(r"""WITH RECURSIVE o AS (SELECT source, doc_id, length(coalesce(text, '')) + length('p1-c' || doc_id) + 32 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, i, 1 AS batches, 1 AS n, cost AS used FROM o WHERE i = 1
 UNION ALL SELECT o.source, o.i, r.batches + CASE WHEN r.n >= 32 OR r.used + o.cost > 36000 THEN 1 ELSE 0 END, CASE WHEN r.n >= 32 OR r.used + o.cost > 36000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 32 OR r.used + o.cost > 36000 THEN o.cost ELSE r.used + o.cost END
 FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1) SELECT source, CAST(max(batches) AS BIGINT) AS n_batches FROM r GROUP BY source""")
def planned_batches(table):
    """How many batches the documents of a source make."""
    rows = table("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_ord"), F.format_string("p1-c%d", "doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.batch_counts(chunking.plan_batches(rows)).withColumnRenamed("doc_id", "source")


@query(r"""SELECT p_partkey, 'Q ' || p_name AS line, p_name LIKE '%a%' AS has_a, CAST(p_size AS VARCHAR) || '.5e' || (p_partkey % 8) AS plain FROM part""")
def cleaned_lines(table):
    """Lines of an exported list without marks, and scientific notation as plain signs."""
    up = F.translate((F.col("p_partkey") % 8).cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    line = F.concat(F.lit("> * **Q** `"), "p_name", F.lit("`​ "))
    return table("part").select("p_partkey", text.clean_export_line(line).alias("line"), F.contains("p_name", F.lit("a")).alias("has_a"), numbers.plain_scientific(F.concat(F.col("p_size").cast("string"), F.lit(".5 × 10"), up)).alias("plain"))


@query("WITH RECURSIVE " + _DRAFTS.removeprefix("WITH ") + ", o AS (" + same_stems_sql("(SELECT lang AS run, doc_id AS id, stem FROM d)") + ") SELECT run AS lang, a, b FROM o")
def same_stem_drafts(table):
    """Drafts of one language that ask the same."""
    return gates.same_stems(_drafts(table), ["lang"], "doc_id")


_TWINS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
v AS (SELECT vec_id, v FROM e UNION ALL SELECT vec_id + 100000000, list_transform(v, lambda x: x * 2 + 0.01) FROM e WHERE vec_id % 3 = 0)
"""


@query(_TWINS + """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9""")
def twin_vectors(table):
    """Pairs of near vectors among the embeddings and altered copies of every third (Q7 across a corpus)."""
    e = table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    twins = e.filter("vec_id % 3 = 0").select((F.col("vec_id") + 100_000_000).alias("vec_id"), F.transform("embedding", lambda x: x * 2 + 0.01).alias("embedding"))
    return rank.near_vectors_blocked(e.unionByName(twins)).withColumn("similarity", F.round("similarity", 6))
