"""Lesson context and coverage contracts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, has_digit
from ..tables import cut
from .graph import neighbourhood

MOST_CHUNKS, MOST_CHARS = 24, 30_000
#: A lesson of more atoms goes through pickable() first, so no task holds them all.
MOST_ATOMS = 20_000
# What a relation is worth when slots are picked; others are worth 40.
RELATION_WORTH = {"direction": 90, "causal": 85, "comparison": 80, "condition": 75, "sequence": 70, "equation": 65, "example": 60, "observation": 55, "definition": 45}
SKILLS = ("understanding", "calculation", "application", "recall")


def supports(forms: Column, skill: Column | str) -> Column:
    skill = F.lit(skill) if isinstance(skill, str) else skill
    return F.coalesce(F.exists(forms, lambda x: F.lower(F.trim(x)) == F.lower(skill)), F.lit(False))


def fallback_skill(forms: Column) -> Column:
    """The first form an atom supports of application, understanding, recall; else understanding."""
    return F.coalesce(*[F.when(supports(forms, s), s) for s in ("application", "understanding", "recall")], F.lit("understanding"))


def relation_worth(relation: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in RELATION_WORTH.items() for x in kv])
    return F.coalesce(m[F.lower(F.trim(relation))], F.lit(40))


def bounded(chunks: DataFrame, group: list[str], order: str = "chunk_ord", most: int = MOST_CHUNKS, chars: int = MOST_CHARS, size: Column | None = None) -> DataFrame:
    """The first chunks of each group, at most most, while their characters stay in the bound; the first stays anyway."""
    w = Window.partitionBy(*group).orderBy(order)
    n = F.length("text") if size is None else size
    out = chunks.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    out = out.withColumn("used", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter((F.col("rn") == 1) | (F.col("used") <= chars)).drop("rn", "used")


def lesson_context(lesson_chunk: DataFrame, lesson_concept: DataFrame, chunks: DataFrame, nodes: DataFrame, links: DataFrame, atoms: DataFrame) -> DataFrame:
    """(doc_id, lesson_id, chunk columns): a lesson's chunks, those of concepts within two hops and those of their atoms,
    in document order, bounded (K5, JN12, JN13)."""
    near = neighbourhood(lesson_concept.select("doc_id", F.col("lesson_id").alias("owner"), "concept_id"), links)
    of_nodes = near.join(nodes, ["doc_id", "concept_id"]).select("doc_id", "owner", F.explode("chunk_ids").alias("chunk_id"))
    of_atoms = near.join(atoms.select("doc_id", "chunk_id", F.explode("concept_ids").alias("concept_id")), ["doc_id", "concept_id"]).select("doc_id", "owner", "chunk_id")
    ids = lesson_chunk.select("doc_id", F.col("lesson_id").alias("owner"), "chunk_id").unionByName(of_nodes).unionByName(of_atoms).distinct()
    rows = ids.join(chunks.drop("lesson_id"), ["doc_id", "chunk_id"]).withColumnRenamed("owner", "lesson_id")
    return bounded(rows, ["doc_id", "lesson_id"])


def directive_targets(directive: Column, calculation_only: Column) -> tuple[Column, Column]:
    """(skill, difficulty) that a directive asks for; null where it says nothing."""
    d = F.lower(F.trim(directive))
    skill = F.when(calculation_only | d.contains("skill to calculation") | d.contains("calculation questions only"), "calculation").when(d.contains("skill to application") | d.contains("application questions"), "application")
    level = F.when(d.contains("difficulty to hard") | d.contains("at hard level"), "hard").when(d.contains("difficulty to easy") | d.contains("at easy level"), "easy")
    return skill, level


SLOTS = "slot_id string, slot_ord int, atom_id string, source_chunk_ids array<string>, concept_ids array<string>, skill string, difficulty string, operation string, target string, evidence_quote string"


def pickable(rows: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """The atoms of each lesson that picks of budget slots can ever reach, an exact choice: rows need key, budget, forms,
    relation, claim, chunk_id, atom_id and concept_ids.

    Atoms with equal forms and relation are always worth the same, but for a fresh concept, and go by chunk and atom. So
    among those with one concept (or any, where none is fresh) the first of each claim stands for the claim, and the
    first budget claims are enough: fewer can be taken before. Of one claim, atoms that bring a concept of their own go on
    until more concepts have come than slots can use up. What is left of a class is bounded by the budget and an atom's
    concepts. Rows are dealt by lesson, forms and relation once; all limits are ranks inside such a class.
    """
    same, order = [*key, "forms", "kind"], ["chunk_id", "atom_id"]
    rows = rows.join(rows.groupBy(*key).agg(F.max(F.size("concept_ids")).alias("widest")), key)
    dealt = [*key, "forms", "kind"]
    rows = rows.withColumn("kind", F.lower("relation"))
    rows = rows.repartition(*dealt) if parts is None else rows.repartition(parts, *dealt)
    rows = rows.withColumn("most", (F.col("budget") - 1) * F.col("widest") + 1).drop("widest")
    each = rows.withColumn("concept", F.explode(F.concat(F.array(F.lit(None).cast("string")), "concept_ids"))).withColumn("says", F.lower("claim"))
    first = each.withColumn("rn", F.row_number().over(Window.partitionBy(*same, "says", "concept").orderBy(*order))).filter("rn = 1")
    few = first.withColumn("rn", F.row_number().over(Window.partitionBy(*same, "concept").orderBy(*order))).filter("rn <= budget")
    new = few.withColumn("rn", F.row_number().over(Window.partitionBy(*same, "says").orderBy(*order))).filter("concept IS NULL OR rn <= most + 1")
    return new.drop("concept", "says", "rn", "most").distinct().drop("kind")


KEY = ["doc_id", "lesson_id"]


def lesson_atoms(lessons: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, atoms that have lesson_id, with what picks look at, and with what their lesson asks for. Lessons are looked up by a
    hash table, so rows that are dealt by doc_id, as lessons, stay where they are."""
    forms = F.array_sort(F.array_distinct(F.transform(F.coalesce("question_forms", F.array()), lambda x: F.lower(F.trim(x)))))
    rows = rows.select(*KEY, "chunk_id", "atom_id", "claim", "relation", F.coalesce("concept_ids", F.array()).alias("concept_ids"), forms.alias("forms"), "quote", relation_worth(F.col("relation")).alias("worth"))
    asked = lessons.select(*KEY, F.col("question_budget").alias("budget"), F.coalesce("required_skill", F.lit("")).alias("need"), F.coalesce("required_difficulty", F.lit("")).alias("level"))
    return rows.join(asked.hint("shuffle_hash"), KEY)


def build_contract(lessons: DataFrame, context: DataFrame, atoms: DataFrame, parts: int | None = None, most: int = MOST_ATOMS) -> DataFrame:
    """Slots of each lesson (K6, O4): budget slots, cycling through the skills or all of the required one; each takes the
    atom of the best score, given what was taken before; ties go to the smaller chunk id, then atom id, as strings (G6).

    lessons: doc_id, lesson_id, question_budget, required_skill, required_difficulty. Chunks are counted first: of lessons
    that have more than most atoms, those that no sequence of picks can reach are left out (pickable). parts: partitions,
    where the size of the atoms is known.
    """
    context = context.select(*KEY, "chunk_id").distinct()
    sizes = context.join(atoms.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n")), ["doc_id", "chunk_id"]).groupBy(*KEY).agg(F.sum("n").alias("n"))
    heavy = cut(sizes.filter(F.col("n") > most).select(*KEY))
    rows = lesson_atoms(lessons, context.join(atoms, ["doc_id", "chunk_id"]))
    if heavy.isEmpty():
        return pick_slots(dealt(rows, parts))
    few = pickable(rows.join(F.broadcast(heavy), KEY, "left_semi"), KEY, parts)
    return pick_slots(dealt(rows.join(F.broadcast(heavy), KEY, "left_anti").unionByName(few), parts))


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows dealt by lesson."""
    return rows.repartition(*KEY) if parts is None else rows.repartition(parts, *KEY)


def pick_slots(rows: DataFrame) -> DataFrame:
    """Slots of lesson_atoms() rows whose lessons are in one partition each. Rows are sorted there and handled as columns, all
    lessons of a batch side by side."""
    # Batches and the rest of the lesson that a batch ends in are all that a task holds in Python.
    rows = rows.withColumns({"says": F.coalesce(F.lower("claim"), F.lit("")), "kind": F.coalesce(F.lower("relation"), F.lit(""))}).sortWithinPartitions(*KEY, "chunk_id", "atom_id")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lesson_id {rows.schema['lesson_id'].dataType.simpleString()}, {SLOTS}"
    return rows.mapInArrow(_pick_batches, schema)


def _pick_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _first_rows(batch)
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in KEY):
            new = np.append(0, new)
        if len(new):
            yield from _picked(pa.Table.from_batches([*held, batch.slice(0, new[-1])]))
            held, batch = [], batch.slice(new[-1])
        held.append(batch)
    if held:
        yield from _picked(pa.Table.from_batches(held))


def _first_rows(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The places from 1 on where another lesson begins."""
    differs = [pc.not_equal(rows[k].slice(1), rows[k].slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False) for k in KEY]
    return np.flatnonzero(differs[0] | differs[1]) + 1


def _picked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Slots of whole lessons, sorted by chunk and atom in each. Round t picks the slot t of every lesson that is open."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return
    col = lambda k: rows.column(k).chunk(0)
    first = np.append(0, _first_rows(rows))
    lesson = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))

    def ids(values: pa.Array, of: np.ndarray) -> np.ndarray:
        """A number for each (lesson, value), without gaps."""
        codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return np.unique(of * np.int64(len(codes) + 1) + codes, return_inverse=True)[1]

    def ends(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Flat values of lists, where each row's begin and end, and whose each value is."""
        at = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))
        return lists.flatten(), at, np.repeat(np.arange(len(lists)), np.diff(at))

    claim, kind, atom = ids(col("says"), lesson), ids(col("kind"), lesson), ids(col("atom_id"), lesson)
    concepts, at, whose = ends(col("concept_ids"))
    concept = ids(concepts.fill_null(""), lesson[whose]) if len(concepts) else np.zeros(0, np.int64)
    forms, _, has = ends(col("forms"))
    mask = np.zeros(rows.num_rows, np.int64)
    for i, s in enumerate(SKILLS):
        mask[has[pc.equal(forms, s).fill_null(False).to_numpy(zero_copy_only=False)]] |= 1 << i
    need = col("need")
    asked = pc.not_equal(need, "").to_numpy(zero_copy_only=False)
    able = ~asked
    able[has[pc.equal(forms, need.take(pa.array(has))).fill_null(False).to_numpy(zero_copy_only=False)]] = True
    worth, budget = col("worth").to_numpy().astype(np.int64), col("budget").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    taken = {"claim": np.zeros(len(claim), bool), "kind": np.zeros(len(kind), bool), "atom": np.zeros(len(atom), bool), "concept": np.zeros(len(concept), bool)}
    used, live, t, out = np.zeros(len(first), np.int64), np.flatnonzero(able & (budget > 0)), 0, []
    while len(live):
        want = t % len(SKILLS)
        new = np.append(0, np.cumsum(~taken["concept"][concept]))
        fits = asked[live] | (mask[live] >> want & 1).astype(bool)
        score = worth[live] + 100 * fits + np.where(taken["kind"][kind[live]], -25, 55) + 20 * (new[at[live + 1]] > new[at[live]])
        # The best score of a lesson, and of equal ones the first row.
        begins = np.flatnonzero(np.append(True, np.diff(lesson[live]) > 0))
        best = np.maximum.reduceat(score * (1 << 32) + ((1 << 32) - 1 - live), begins)
        pick = (1 << 32) - 1 - (best & ((1 << 32) - 1))
        its = lesson[pick]
        taken["claim"][claim[pick]] = taken["kind"][kind[pick]] = taken["atom"][atom[pick]] = True
        taken["concept"][concept[np.isin(whose, pick)]] = True
        # A skill that was used makes way for the first other one that the atom supports.
        other = mask[pick] & ~used[its]
        skill = np.where((used[its] >> want & 1).astype(bool) & (other > 0), np.log2(np.maximum(other & -other, 1)).astype(np.int64), want)
        used[its] |= 1 << skill
        t += 1
        out.append((pick, np.full(len(pick), t), skill))
        live = live[(budget[live] > t) & ~taken["claim"][claim[live]] & ~taken["atom"][atom[live]]]
    if not out:
        return
    pick, nth, skill = (np.concatenate(x) for x in zip(*out, strict=True))
    got = rows.take(pa.array(pick))
    own, names = asked[pick], np.array(SKILLS, object)[skill]
    level = np.where(own, "", np.where(np.isin(names, ("application", "calculation")), "medium", "easy")).astype(object)
    said = got.column("level").to_pylist()
    columns = [
        got.column("doc_id"), got.column("lesson_id"), pa.array([f"S{n:02d}" for n in nth]), pa.array(nth, pa.int32()), got.column("atom_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1), pa.int32()), got.column("chunk_id").combine_chunks()),
        got.column("concept_ids"), pc.if_else(pa.array(own), got.column("need"), pa.array(names, pa.string())), pa.array([s or x for s, x in zip(said, level, strict=True)], pa.string()), got.column("relation"), got.column("claim"), got.column("quote"),
    ]
    yield from pa.table(columns, names=[*KEY, *[x.split()[0] for x in SLOTS.split(", ")]]).combine_chunks().to_batches()


def preflight(slots: DataFrame, atoms: DataFrame, context: DataFrame, required_skill: str = "") -> tuple[DataFrame, DataFrame]:
    """(clean slots, changes) (K7, JN11): slots whose atom is unknown, outside the context or taken are dropped; quotes that
    the chunk doesn't hold become the atom's; calculation on a definition without a number becomes another skill, or is
    dropped where calculation is required; an empty operation becomes the relation."""
    key = ["doc_id", "lesson_id"]
    a = atoms.select("doc_id", "atom_id", F.col("chunk_id").alias("a_chunk"), F.col("claim").alias("a_claim"), F.col("quote").alias("a_quote"), F.col("relation").alias("a_relation"), F.col("question_forms").alias("a_forms"))
    c = context.select(*key, F.col("chunk_id").alias("a_chunk"), F.col("text").alias("c_text"))
    rows = slots.join(a, ["doc_id", "atom_id"], "left").join(c, [*key, "a_chunk"], "left")
    base = F.when(F.col("a_chunk").isNull(), F.concat(F.lit("unknown atom "), "atom_id")).when(F.col("c_text").isNull(), F.concat(F.lit("atom "), "atom_id", F.lit(" is outside the context")))
    rows = rows.withColumn("why", base)
    nth = F.row_number().over(Window.partitionBy(*key, "atom_id", F.col("why").isNull()).orderBy("slot_ord"))
    rows = rows.withColumn("why", F.coalesce("why", F.when(nth > 1, F.concat(F.lit("atom "), "atom_id", F.lit(" is taken")))))
    skill = F.lower(F.trim("skill"))
    bare = (skill == "calculation") & (F.lower(F.trim("a_relation")) == "definition") & ~has_digit(F.col("a_claim")) & ~has_digit(F.col("a_quote"))
    if required_skill == "calculation":
        rows = rows.withColumn("why", F.coalesce("why", F.when(bare, "calculation without a number")))
    wrong = (F.coalesce(F.trim("evidence_quote"), F.lit("")) == "") | ~F.contains(collapse(F.col("c_text")), collapse(F.col("evidence_quote")))
    rows = rows.withColumns({"bare": bare, "wrong": F.coalesce(wrong, F.lit(True))})
    what = F.array_compact(F.array(F.when(F.col("why").isNotNull(), F.concat(F.lit("drop: "), "why")), F.when(F.col("why").isNull() & F.col("wrong"), "repair: the atom's quote"), F.when(F.col("why").isNull() & F.col("bare"), F.concat(F.lit("downgrade: calculation to "), fallback_skill(F.col("a_forms"))))))
    changes = rows.select(*key, "slot_id", F.explode(what).alias("change"))
    clean = rows.filter("why IS NULL").withColumns({
        "source_chunk_ids": F.array("a_chunk"),
        "evidence_quote": F.when(F.col("wrong"), F.col("a_quote")).otherwise(F.col("evidence_quote")),
        "skill": F.when(F.col("bare"), fallback_skill(F.col("a_forms"))).otherwise(skill),
        "operation": F.when(F.coalesce("operation", F.lit("")) == "", F.col("a_relation")).otherwise(F.col("operation")),
    })
    return clean.select(*slots.columns), changes


def missing_slots(slots: DataFrame, accepted: DataFrame, keys: tuple[str, ...] = ("doc_id", "lesson_id")) -> DataFrame:
    """Slots that no accepted draft has filled."""
    return slots.join(accepted.select(*keys, F.col("coverage_slot_id").alias("slot_id")), [*keys, "slot_id"], "left_anti")


def contract_requests(slots: DataFrame) -> DataFrame:
    """One text per lesson: its slots in order."""
    line = F.concat_ws(" | ", "slot_id", "skill", "difficulty", "operation", "target", "evidence_quote")
    rows = slots.groupBy("doc_id", "lesson_id").agg(F.array_sort(F.collect_list(F.struct("slot_ord", line.alias("t")))).alias("p"))
    return rows.select("doc_id", "lesson_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("request"))
