"""Reports over gated drafts, candidate sets, labels and calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import clip, trimmed
from ..tables import cut
from .ordered import numbered, numbered_ranges

DETERMINISTIC = ("well_formed", "source_role", "quote_verbatim", "arithmetic", "unit_check", "coverage_contract", "not_a_duplicate")
LABELS = ("good", "wrong", "not-in-source", "trivial", "unclear")
MARGIN = 4
# Names shown for gates, skills and levels.
GATE_NAMES = {"well_formed": "Well-formed", "source_role": "Source section", "quote_verbatim": "Verbatim quote", "arithmetic": "Arithmetic", "unit_check": "Unit", "coverage_contract": "Coverage contract", "not_a_duplicate": "Distinct"}
SKILL_NAMES = {"understanding": "Understanding", "calculation": "Calculation", "application": "Application", "recall": "Recall"}
LEVEL_NAMES = {"easy": "Easy", "medium": "Medium", "hard": "Hard"}
REASONS = {"structurally sound": "Nothing is wrong with its form", "no arithmetic in this question": "Nothing is calculated", "distinct from the questions already accepted": "No earlier question is like it"}
REASON_STARTS = {"verbatim in ": "Stands in the source, in ", "chunk ": "Taken from chunk ", "slot ": "Fills coverage slot "}


def pass_rate(rows: DataFrame, *by: str, passed: str = "passed") -> DataFrame:
    """Drafts, passes and the rate of passes, 0 without drafts (A1)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"), F.coalesce(F.avg(F.col(passed).cast("int")), F.lit(0.0)).alias("pass_rate"))


def failures_by_gate(gates: DataFrame, *by: str) -> DataFrame:
    """Failures per gate, most first, and whether the gate is deterministic (A2)."""
    out = gates.filter("NOT pass").groupBy(*by, "gate").agg(F.count("*").alias("n"))
    return out.withColumn("deterministic", F.col("gate").isin(*DETERMINISTIC)).orderBy(F.desc("n"), "gate")


def tallies(rows: DataFrame, by: str, **conditions: Column) -> DataFrame:
    """Per case: how many rows meet each condition, all in one pass."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def case_tallies(rows: DataFrame) -> DataFrame:
    """Per benchmark case: accepted, calculations, and drafts that hit the target skill and difficulty."""
    hit = F.col("skill") == F.col("target_skill")
    both = hit & ((F.coalesce("target_difficulty", F.lit("")) == "") | (F.col("difficulty") == F.col("target_difficulty")))
    ok = F.col("passed")
    return tallies(rows, "case", accepted=ok, calculations=F.col("calculation").isNotNull(), on_skill=hit, on_target=both, accepted_on_target=both & ok)


def set_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """The score of each candidate set (A4): passes, quality, and distinct atoms, skills, relations and chunks among the
    passes ('' counts as a value but for relations, G17), less the failing gates."""
    ok = F.col("passed")
    # Each distinct value is a group of its own, whatever its set's size. Unlike distinct counts of several columns this leaves
    # rows that are dealt by a column of by where they are.
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    whole, among = item(0, F.lit(None)), [item(i, F.coalesce(F.col(c).cast("string"), F.lit(""))) for i, c in enumerate(("atom_id", "skill", "chunk_id", "relation"), 1)]
    items = F.when(ok, F.array(whole, *among)).otherwise(F.array(whole))
    each = rows.select(*by, F.explode(items).alias("item"), "passed", "failing_gates", "quality_total", "quality_max").select(*by, "item.kind", "item.value", "passed", "failing_gates", "quality_total", "quality_max")
    row = lambda c: F.when(F.col("kind") == 0, F.col(c))
    each = each.groupBy(*by, "kind", "value").agg(F.count_if(row("passed")).alias("passed"), F.sum(row("failing_gates")).alias("failing"), F.max(row("quality_total")).alias("total"), F.max(row("quality_max")).alias("most"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    s = each.groupBy(*by).agg(F.sum("passed").alias("passed"), F.sum("failing").alias("failing"), n(1).alias("atoms"), n(2).alias("skills"), F.count_if((F.col("kind") == 4) & (F.col("value") != "")).alias("relations"), n(3).alias("chunks"), F.max("total").alias("total"), F.max("most").alias("most"))
    semantic = F.coalesce(F.expr("CASE WHEN most > 0 THEN total * 1000 div most END"), F.lit(0))
    score = F.col("passed") * 1_000_000 + semantic * 1_000 + F.col("atoms") * 500 + F.col("skills") * 100 + F.col("relations") * 75 + F.col("chunks") * 25 - F.col("failing") * 10
    return s.withColumn("score", score.cast("long"))


def best_sets(scores: DataFrame, by: list[str], candidate: str = "candidate") -> DataFrame:
    """The candidate of the highest score in each group; the first wins ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), candidate)
    return scores.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def quality_reports(verdicts: DataFrame, sizes: DataFrame, by: str = "set_id") -> DataFrame:
    """Per set: total, most and whether the verdicts are whole: one per question, indices in range, scores 0 to 4 (A5)."""
    g = verdicts.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("question_index").alias("d"), F.min("question_index").alias("lo"), F.max("question_index").alias("hi"), F.min("score").alias("least"), F.max("score").alias("top"), F.sum("score").alias("total"))
    out = sizes.join(g, by, "left")
    whole = (F.col("n") == F.col("n_questions")) & (F.col("d") == F.col("n")) & (F.col("lo") >= 0) & (F.col("hi") < F.col("n_questions")) & F.col("least").between(0, 4) & F.col("top").between(0, 4)
    return out.select(by, "n_questions", F.coalesce("total", F.lit(0)).alias("total"), (4 * F.col("n_questions")).alias("most"), F.coalesce(whole, F.lit(False)).alias("whole"))


def review_excerpts(drafts: DataFrame, chunks: DataFrame, by: str = "run_id") -> DataFrame:
    """The chunks that a review of a run reads: those cited, or all of the document if none is (JN15)."""
    cited = drafts.select(by, "doc_id", F.coalesce(F.nullif("evidence_chunk_id", F.lit("")), F.nullif("chunk_id", F.lit(""))).alias("chunk_id"))
    hit = cited.filter("chunk_id IS NOT NULL").distinct().join(chunks, ["doc_id", "chunk_id"])
    bare = cited.select(by, "doc_id").distinct().join(hit.select(by, "doc_id").distinct(), [by, "doc_id"], "left_anti").join(chunks, "doc_id")
    return hit.unionByName(bare.select(*hit.columns))


def call_stats(events: DataFrame) -> DataFrame:
    """Per label and in total (label null): calls, durations, share of wall clock, tokens, tokens a second (A10). Wall is
    last end less first start, or the sum of durations where starts are missing."""
    events = events.withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")})
    ms = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000.0
    rows = events.withColumn("ms", F.coalesce(ms, F.col("load_ms") + F.col("prompt_ms") + F.col("eval_ms"), F.lit(0.0)))
    out = rows.rollup("label").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.sum("load_ms").alias("load_ms"), F.sum("prompt_ms").alias("prompt_ms"), F.sum("eval_ms").alias("eval_ms"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("eval_tokens").alias("eval_tokens"), (F.unix_micros(F.max("end_ts")) - F.unix_micros(F.min("start_ts"))).alias("span"), F.grouping("label").alias("g"))
    whole = Window.partitionBy()
    wall = F.coalesce(F.max(F.when(F.col("g") == 1, F.col("span") / 1000.0)).over(whole), F.max(F.when(F.col("g") == 1, F.col("total_ms"))).over(whole))
    out = out.withColumn("share", F.col("total_ms") / F.nullif(wall, F.lit(0.0))).withColumn("tokens_per_s", F.col("eval_tokens") / F.nullif(F.col("eval_ms") / 1000.0, F.lit(0.0)))
    return out.drop("span").withColumn("is_total", F.col("g") == 1).drop("g").orderBy("is_total", F.desc("total_ms"), "label")


def rejection_memory(rows: DataFrame, by: str = "run_id", most: int = 4) -> DataFrame:
    """The newest failures of each run, texts clipped."""
    w = Window.partitionBy(by).orderBy(F.desc("draft_ord"))
    out = rows.filter("NOT passed").withColumn("age", F.row_number().over(w)).filter(F.col("age") <= most)
    return out.select(by, "draft_ord", "age", clip(F.col("stem"), 239).alias("stem"), F.transform("choices", lambda c: clip(c["content"], 179)).alias("choices"), F.transform(F.filter("gates", lambda g: ~g["pass"]), lambda g: F.concat(g["gate"], F.lit(": "), clip(g["reason"], 159))).alias("failures"))


def last_accepted(rows: DataFrame, by: str = "run_id", most: int = 6) -> DataFrame:
    """The stems accepted last in each run."""
    w = Window.partitionBy(by).orderBy(F.desc("draft_ord"))
    return rows.filter("passed").withColumn("age", F.row_number().over(w)).filter(F.col("age") <= most).select(by, "draft_ord", "age", "stem")


def slot_status(slots: DataFrame, accepted: DataFrame, by: list[str]) -> DataFrame:
    """Plan slots with status: as many as are accepted are completed, the next is CURRENT, the rest upcoming."""
    n = accepted.groupBy(*by).agg(F.count("*").alias("done"))
    out = slots.join(n, by, "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.withColumn("status", F.when(F.col("position") < F.col("done"), "completed").when(F.col("position") == F.col("done"), "CURRENT").otherwise("upcoming")).drop("done")


def repair_requests(missing: DataFrame, memory: DataFrame, by: str = "run_id") -> DataFrame:
    """One row per run with open slots: the slots and the newest failures (K9)."""
    m = missing.groupBy(by).agg(F.array_sort(F.collect_list("slot_id")).alias("slots"))
    f = memory.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("age", "stem", "failures"))), lambda x: F.concat(x["stem"], F.lit(" — "), F.array_join(x["failures"], "; "))).alias("failures"))
    return m.join(f, by, "left")


def topped_up_from(rows: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run: the other lessons that accepted drafts came from, first come first."""
    first = rows.filter("passed AND priority = 1").groupBy(by, "lesson_id").agg(F.min("draft_ord").alias("o"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "lesson_id"))), lambda x: x["lesson_id"]).alias("lessons"))


def ceiling(rows: DataFrame, budgets: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run: accepted, budget and whether the source gave fewer than asked (K11); the budget is the run's, else the
    lesson's, else 5."""
    n = rows.groupBy(by).agg(F.count_if("passed").alias("accepted"), F.countDistinct("visit").alias("visits"))
    b = F.coalesce(F.nullif("budget", F.lit(0)), F.nullif("lesson_budget", F.lit(0)), F.lit(5))
    return budgets.withColumn("budget", b).join(n, by, "left").select(by, "budget", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("visits", F.lit(0)).alias("visits"), (F.coalesce("accepted", F.lit(0)) < F.col("budget")).alias("below_budget"))


def blind_sheet(questions: DataFrame, seed: int = 1, *others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheet, key) of the union of questions (source, ordinal, stem, choices, correct) with those of other sources; what a
    source lacks is null. Ids follow the MD5 of seed, source and ordinal, whatever the partitions; the sheet has no source and no
    answer (R7, U1). Rows are dealt into sampled ranges of it, which are numbered side by side from where the ranges before
    end, so no range grows with the others; ids are as wide as the count asks for."""
    names = ["source", "ordinal", "stem", "choices", "correct"]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.select(*[c for c in names if c in s.columns]) for s in (questions, *others)]).select(*names)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("ordinal").cast("string")))
    rows = cut(rows.withColumn("h", h).repartitionByRange("h", "source", "ordinal").withColumn("part", F.spark_partition_id()))
    rows = numbered(rows, [], "part", ["h", "source", "ordinal"], "nth")
    width = len(str(max(1, rows.count())))
    rows = rows.withColumn("id", F.format_string(f"Q%0{max(width, 2)}d", "nth"))
    cell = lambda i: F.regexp_replace(trimmed(F.get("choices", F.lit(i))), r"\s+", " ")
    sheet = rows.select("id", trimmed(F.col("stem")).alias("stem"), *[cell(i).alias(f"choice_{c}") for i, c in enumerate("abcd")], F.lit("").alias("label"))
    return sheet, rows.select("id", "source", F.col("ordinal").alias("original_index"), F.col("correct").alias("correct_choice"))


def sheet_problems(sheet: DataFrame, key: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(id, problem) of a filled sheet: ids missing on either side, ids twice, labels empty or unknown (JN16)."""
    s = sheet.groupBy("id").agg(F.count("*").alias("n"), F.first("label").alias("label"))
    both = s.join(key.select("id", F.lit(True).alias("known")), "id", "full_outer")
    said = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    why = F.coalesce(F.when(F.col("n").isNull(), "not on the sheet"), F.when(F.col("known").isNull(), "not in the key"), F.when(F.col("n") > 1, "twice on the sheet"), F.when(said == "", "no label"), F.when(~said.isin(*labels), "unknown label"))
    return both.select("id", why.alias("problem")).filter("problem IS NOT NULL")


def label_tally(rows: DataFrame, label: str = "label", source: str = "source") -> DataFrame:
    """Rows per label and source, with totals per source (label null)."""
    return rows.withColumn("l", F.lower(F.trim(label))).rollup(source, "l").agg(F.count("*").alias("n")).filter(F.col(source).isNotNull()).select(source, F.col("l").alias("label"), "n")


def label_matrix(rows: DataFrame, sources: list[str]) -> DataFrame:
    """One row per label, one column per source."""
    return rows.groupBy(F.lower(F.trim("label")).alias("label")).pivot("source", sources).count().fillna(0)


def label_verdict(rows: DataFrame, ours: str = "ours", good: str = "good", margin: int = MARGIN) -> DataFrame:
    """One row: PASS if ours has margin more good labels than every rival, FAILS PREMISE if margin fewer than any, else
    INCONCLUSIVE; and the label that ours lost most to (by count, then name) (A12)."""
    label = F.lower(F.trim("label"))
    per = rows.groupBy("source").agg(F.count_if(label == good).alias("good"))
    lost = rows.filter(F.col("source") == ours).filter(label != good).groupBy(label.alias("l")).agg(F.count("*").alias("n")).agg(F.max_by("l", F.struct("n", "l")).alias("worst_label"))
    mine = per.filter(F.col("source") == ours).select(F.col("good").alias("ours_good"))
    gap = per.filter(F.col("source") != ours).join(F.broadcast(mine)).agg(F.min(F.col("ours_good") - F.col("good")).alias("worst_gap"), F.max("ours_good").alias("ours_good"))
    verdict = F.when(F.col("worst_gap") >= margin, "PASS").when(F.col("worst_gap") <= -margin, "FAILS PREMISE").otherwise("INCONCLUSIVE")
    return gap.select("ours_good", "worst_gap", verdict.alias("verdict")).join(F.broadcast(lost))


def source_sizes(rows: DataFrame) -> DataFrame:
    """Per source: questions, those without an answer, and whether all sources are of one size."""
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("correct").isNull()).alias("unanswered"))
    all_ = Window.partitionBy()
    return out.withColumn("equal_n", F.min("n").over(all_) == F.max("n").over(all_))


QUESTIONS = "source string, ordinal int, stem string, choices array<string>, correct int, passed boolean, skill string, difficulty string, explanation string, source_quote string, coverage_slot_id string, evidence_atom_id string, evidence_chunk_id string, gates array<struct<gate:string,pass:boolean,reason:string>>"


def united(*sources: DataFrame) -> DataFrame:
    """Questions of ours and of other sources as one table of QUESTIONS (U7): texts that a source lacks are empty, gates
    none, correct and passed null; numbered per source in the order of ordinal (i), in categories of five (W11)."""
    kinds = dict(x.split(" ", 1) for x in QUESTIONS.split(", "))

    def full(df: DataFrame) -> DataFrame:
        empty = {"string": F.lit("")}
        have = lambda c, k: F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k)
        return df.select(*[(F.coalesce(have(c, k), empty.get(k, F.array().cast(k))) if k == "string" or k.startswith("array") else have(c, k)).alias(c) for c, k in kinds.items()])

    rows = reduce(lambda a, b: a.unionByName(b), map(full, sources))
    rows = numbered_ranges(rows, ["source"], ["ordinal"], "i")
    return rows.withColumn("category", F.least(F.floor((F.col("i") - 1) / 5), F.lit(2)))


def comparison(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Side by side: the i-th question of every source, in five-question categories (JN18, R9, U7, W11)."""
    # The answers of other sources may be letters, which united() has no place for; they are not shown here.
    rows = united(rows.select("source", "ordinal", "stem"))
    return rows.groupBy("i", "category").pivot("source", sources).agg(F.first("stem")).select("i", *sources, "category").orderBy("i")


def search(rows: DataFrame, q: str) -> DataFrame:
    """Rows in which a text stands anywhere, whatever the case."""
    return rows.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(q.lower())))


def failing(rows: DataFrame) -> DataFrame:
    """Failed drafts in order."""
    return rows.filter("NOT passed").orderBy("run_id", "draft_ord")


def _named(c: str, names: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(m[F.col(c)], F.col(c))


def shown_gates(gates: DataFrame) -> DataFrame:
    """gates with the names and reasons that reports show (F24): a reason with a known beginning is said again in the
    report's words, with what follows it."""
    reason = F.col("reason")
    shown = F.coalesce(
        *[F.when(reason == k, v) for k, v in REASONS.items()],
        *[F.when(F.startswith(reason, F.lit(k)), F.concat(F.lit(v), F.substr(reason, F.lit(len(k) + 1)))) for k, v in REASON_STARTS.items()],
        F.replace(reason, F.lit(", matches the correct choice"), F.lit(" and equals the correct choice")),
    )
    return gates.withColumn("name", _named("gate", GATE_NAMES)).withColumn("shown_reason", shown)


def shown_questions(rows: DataFrame) -> DataFrame:
    """Questions with the names of skill and difficulty that reports show."""
    return rows.withColumn("skill", _named("skill", SKILL_NAMES)).withColumn("difficulty", _named("difficulty", LEVEL_NAMES))


def pick_lesson(lessons: DataFrame, fragment: str) -> DataFrame:
    """Per document the first lesson whose title has a fragment (JN19)."""
    return lessons.filter(F.contains(F.lower("title"), F.lit(fragment.lower()))).groupBy("doc_id").agg(F.min_by("lesson_id", "lesson_pos").alias("lesson_id"))


def concept_focus(lesson_concept: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, lesson_id, chunk_id, concepts): the concepts that a lesson and a chunk share (JN17). With parts, both inputs
    and their rows are dealt into that many partitions, so that a task's share needn't grow with the input."""
    dealt = lambda df, *by: df if parts is None else df.repartition(parts, *by)
    at = nodes.select("doc_id", "concept_id", "title", "chunk_ids")
    rows = dealt(lesson_concept, "doc_id", "concept_id").join(dealt(at, "doc_id", "concept_id"), ["doc_id", "concept_id"])
    rows = rows.select("doc_id", "lesson_id", "title", F.explode("chunk_ids").alias("chunk_id"))
    return dealt(rows, "doc_id", "lesson_id", "chunk_id").groupBy("doc_id", "lesson_id", "chunk_id").agg(F.array_sort(F.collect_set("title")).alias("concepts"))


def progress(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """(rows, observation): drafts and accepted ones, counted while rows are written anyway. A task that runs again after a
    lost executor may count twice, so these figures are for watching a run, not for reports."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("drafts"), F.count_if("passed").alias("accepted")), seen
