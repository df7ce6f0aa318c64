"""Model output in JSON, decoded tolerantly; what cannot be read goes to a table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fences, trimmed

SENTINEL = "NON_CONTENT"
KINDS = ("content", "apparatus", "non_content")


def topics(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with kind and topics, from an object or a bare array; unknown kinds are content, only sentinels non_content."""
    j = strip_fences(F.col(column))
    obj = F.from_json(j, "kind string, topics array<string>")
    names = F.coalesce(F.when(j.startswith("["), F.from_json(j, "array<string>")), obj["topics"], F.array().cast("array<string>"))
    names = F.filter(F.transform(names, trimmed), lambda t: t.isNotNull() & (t != ""))
    real = F.filter(names, lambda t: F.upper(t) != SENTINEL)
    said = F.lower(F.trim(obj["kind"]))
    kind = F.when(F.exists(names, lambda t: F.upper(t) == SENTINEL) & (F.size(real) == 0), "non_content").when(said.isin(*KINDS), said).otherwise("content")
    return rows.withColumn("kind", kind).withColumn("topics", real)


def keep_everything(labelled: DataFrame) -> DataFrame:
    """Every chunk as content."""
    return labelled.withColumn("kind", F.lit("content"))


def teaching(labelled: DataFrame) -> DataFrame:
    """Content only."""
    return labelled.filter("kind = 'content'")


def calculation(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with calculation (expression, expected, unit; null if there is none) and problem. expected is a number or a
    quoted number; anything else is a problem. The unit is kept (G4)."""
    c = F.from_json(strip_fences(F.col(column)), "expression string, expected string, unit string")
    number = F.expr("try_cast(c.expected AS double)")
    out = rows.withColumn("c", c)
    some = F.coalesce(trimmed(F.col("c.expression")), F.lit("")) != ""
    good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    made = F.struct(F.col("c.expression").alias("expression"), number.alias("expected"), F.coalesce(F.col("c.unit"), F.lit("")).alias("unit"))
    return out.withColumn("calculation", F.when(some & good, made)).withColumn("problem", F.when(some & ~F.coalesce(good, F.lit(False)), "expected is no number")).drop("c")


def string_list(v: Column) -> Column:
    """A variant as a list: lists as they are, a text by commas, semicolons or bars, an object as 'key: value'."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    split = F.filter(F.transform(F.split(text, "[,;|]"), trimmed), lambda x: x != "")
    pairs = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).when(kind.startswith("OBJECT"), pairs).when(text.isNotNull(), split)


# Texts that mean no.
NO = ("", "no", "false", "0", "ไม่", "ไม่ใช่")


def boolish(v: Column) -> Column:
    """A variant as a boolean: yes and no as text, Thai too; other text that is not empty is true."""
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.try_variant_get(v, "$", "boolean"), ~F.lower(F.trim(text)).isin(*NO), F.lit(False))


def sourced_verdict(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with best_index, also_defensible, choice_verdicts, dependency, dependency_kind, evidence, counterfactual.

    dependency is a text or an object, under either of two names; choice_verdicts a list, or a map by index whose values
    are a status or an object.
    """
    v = F.try_parse_json(strip_fences(F.col(column)))
    out = rows.withColumn("v", v)
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    dep = F.coalesce(get("$.dependency", "variant"), get("$.source_dependency", "variant"))
    out = out.withColumn("d", dep)
    nested = F.schema_of_variant("d").startswith("OBJECT")
    inner = lambda path, kind: F.when(nested, F.try_variant_get("d", path, kind))
    kind = inner("$.dependency_kind", "string")
    grades = ("specific", "generic", "unclear")
    choices = get("$.choice_verdicts", "variant")
    listed = F.try_variant_get(choices, "$", "array<struct<index:int,status:string,reason:string>>")
    by_index = F.transform(F.map_entries(F.try_variant_get(choices, "$", "map<string,variant>")), lambda e: F.struct(e["key"].cast("int").alias("index"), F.coalesce(F.try_variant_get(e["value"], "$.status", "string"), F.try_variant_get(e["value"], "$", "string")).alias("status"), F.try_variant_get(e["value"], "$.reason", "string").alias("reason")))
    is_list = F.schema_of_variant(choices).startswith("ARRAY")
    return out.withColumns({
        "best_index": get("$.best_index", "int"),
        "also_defensible": F.coalesce(get("$.also_defensible", "array<int>"), F.array().cast("array<int>")),
        "choice_verdicts": F.coalesce(F.when(is_list, listed).otherwise(F.array_sort(by_index)), F.array().cast("array<struct<index:int,status:string,reason:string>>")),
        "dependency": F.coalesce(F.when(nested, F.when(kind.isin(*grades), kind)).otherwise(F.try_variant_get("d", "$", "string")), F.lit("")),
        "dependency_kind": F.coalesce(get("$.dependency_kind", "string"), F.when(~kind.isin(*grades), kind), F.lit("")),
        "evidence": F.coalesce(string_list(get("$.evidence", "variant")), string_list(inner("$.evidence", "variant")), F.array().cast("array<string>")),
        "counterfactual": boolish(F.coalesce(get("$.counterfactual", "variant"), inner("$.counterfactual", "variant"))),
    }).drop("v", "d")


def quality_verdicts(rows: DataFrame, column: str = "json") -> DataFrame:
    """One row per verdict of a reply; the list stands under questions, else under verdicts."""
    one = "question_index int, score int, source_dependency string, correctness string, distractor_quality string, skill_difficulty_fit string, reason string"
    j = F.from_json(strip_fences(F.col(column)), f"questions array<struct<{one.replace(' int', ':int').replace(' string', ':string')}>>, verdicts array<struct<{one.replace(' int', ':int').replace(' string', ':string')}>>")
    rows = rows.withColumn("j", j)
    chosen = F.when(F.size("j.questions") > 0, F.col("j.questions")).otherwise(F.col("j.verdicts"))
    return rows.withColumn("q", F.explode(chosen)).select(*[c for c in rows.columns if c not in ("j", column)], "q.*")


def atom_chunk(*names: str) -> Column:
    """The first of an atom's chunk-id columns that is not empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


#: Constraints of model replies by entity: a name and an SQL predicate that must hold.
CONSTRAINTS = {
    "topics": {"kind": "kind IN ('content','apparatus','non_content')", "n_topics": "kind <> 'content' OR size(topics) BETWEEN 1 AND 3"},
    "lesson": {"budget": "question_budget BETWEEN 1 AND 20", "title": "trim(title) <> ''"},
    "draft": {"n_choices": "size(choices) = 4", "difficulty": "difficulty IN ('easy','medium','hard')", "skill": "skill IN ('recall','understanding','application','calculation')"},
    "atom": {"n_forms": "size(question_forms) BETWEEN 1 AND 4", "claim": "trim(claim) <> ''"},
    "atoms": {"n_atoms": "size(atoms) BETWEEN 1 AND 80"},
    "quality": {"score": "score BETWEEN 0 AND 4"},
}


def violations(rows: DataFrame, entity: str, key: Column, limits: dict[str, str] | None = None) -> DataFrame:
    """(entity, key, rule) of every rule that a row breaks; null counts as broken."""
    rules = CONSTRAINTS[entity] if limits is None else limits
    broken = F.array(*[F.when(~F.coalesce(F.expr(x), F.lit(False)), F.lit(n)) for n, x in rules.items()])
    return rows.select(F.lit(entity).alias("entity"), key.cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("rule"))


def reconcile(asked: DataFrame, replies: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id"), order: str = "reply_ord") -> tuple[DataFrame, DataFrame]:
    """Replies to what was asked: (first reply of each asked key, keys to ask again); invented keys are dropped (JN8)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    known = replies.join(asked.select(*keys).distinct(), list(keys), "left_semi")
    first = known.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return first, asked.join(first.select(*keys), list(keys), "left_anti")
