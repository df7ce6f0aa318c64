"""From pages and model outputs to a gated question bank. Tables that several steps read are cut where they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, contract, decode, gates, graph, provenance, rank, report
from ..tables import cut


def build_outline(pages: DataFrame, replies: DataFrame, lessons: DataFrame, keep_everything: bool = False) -> dict[str, DataFrame]:
    """Stages 3 to 9 of a run: chunks, labels (smoothed), concepts, edges, lessons and what belongs to them. replies has
    (doc_id, chunk_id, json, reply_ord); documents of which more than half is no content are refused, not guessed at."""
    chunks = cut(chunking.chunk_pages(pages))
    first, again = decode.reconcile(chunks.select("doc_id", "chunk_id"), replies)
    labels = decode.topics(first).select("doc_id", "chunk_id", "kind", "topics").join(chunks.select("doc_id", "chunk_id", "chunk_ord"), ["doc_id", "chunk_id"])
    if keep_everything:
        labels = decode.keep_everything(labels)
    labels = cut(graph.smooth_runs(labels))
    refused = graph.drop_share(labels).filter("refused")
    labels = labels.join(refused.select("doc_id"), "doc_id", "left_anti")
    nodes, links = map(cut, graph.evidence_graph(chunks, labels))
    kept, concepts, at = map(cut, graph.outline(lessons, nodes, links))
    placed = cut(chunks.drop("lesson_id").join(at, ["doc_id", "chunk_id"], "left").withColumn("lesson_id", F.coalesce("lesson_id", F.lit(""))))
    return {"chunks": placed, "ask_again": again, "labels": labels, "refused": refused, "concepts": nodes, "edges": links, "lessons": kept, "lesson_concept": concepts, "lesson_chunk": at}


def contracts(tables: dict[str, DataFrame], atoms: DataFrame, lessons: DataFrame) -> dict[str, DataFrame]:
    """Evidence that holds, each lesson's context and its contract after preflight. lessons has the budget and targets."""
    good = cut(graph.source_bound_atoms(atoms, tables["chunks"], tables["concepts"]))
    context = cut(contract.lesson_context(tables["lesson_chunk"], tables["lesson_concept"], tables["chunks"], tables["concepts"], tables["edges"], good))
    slots, changes = map(cut, contract.preflight(contract.build_contract(lessons, context, good), good, context))
    return {"atoms": good, "context": context, "slots": slots, "changes": changes}


def visit_order(chunks: DataFrame, lessons: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
    """(for_lesson, chunk, visit): a lesson's own chunks first, by relevance where vectors are given, then its siblings' (O1, U2)."""
    from pyspark.sql import Window

    both = rank.pools(chunks, lessons)
    if query_vectors is not None:
        near = rank.by_relevance(chunks.filter("lesson_id <> ''"), query_vectors).select("doc_id", "chunk_id", "similarity")
        both = both.join(near, ["doc_id", "chunk_id"], "left").withColumn("similarity", F.when(F.col("priority") == 0, F.col("similarity")))
    else:
        both = both.withColumn("similarity", F.lit(0.0))
    w = Window.partitionBy("doc_id", "for_lesson").orderBy("priority", F.desc_nulls_last("similarity"), "chunk_ord")
    return both.withColumn("visit", F.row_number().over(w))


def exam_run(drafts: DataFrame, chunks: DataFrame, visits: DataFrame, budgets: DataFrame, group: list[str], budget: int = 5, most_visits: int = 24) -> dict[str, DataFrame]:
    """A run over logged drafts, chunk by chunk (K11): gates, acceptance, the cut at the budget, and the reports."""
    rows = drafts.join(visits.select("doc_id", F.col("for_lesson").alias("lesson_id"), "chunk_id", "visit", "priority", F.col("lesson_id").alias("chunk_lesson")), ["doc_id", "lesson_id", "chunk_id"])
    gated = cut(gates.within_budget(gates.full_report(rows, chunks, group), group, budget, most_visits))
    long_ = gates.gate_rows(gated, [*group, "draft_ord"])
    return {
        "drafts": gated, "pass_rate": report.pass_rate(gated, *group), "failures": report.failures_by_gate(long_), "ceiling": report.ceiling(gated, budgets, group[-1]),
        "topped_up": report.topped_up_from(gated.withColumn("lesson_id", F.col("chunk_lesson")), group[-1]), "memory": report.rejection_memory(gated, group[-1]),
    }


def set_run(candidates: DataFrame, atoms: DataFrame, slots: DataFrame, context: DataFrame, chunks: DataFrame, quality: DataFrame, repairs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidate sets of a lesson (K10): provenance repaired, gated with the contract, scored; the best set and the slots it
    leaves open. candidates has run_id (the set's) and candidate. repairs are drafts for slots that an earlier run left
    open; they follow their candidate's own and all are gated together (U4)."""
    group = ["doc_id", "lesson_id", "run_id", "candidate"]
    if repairs is not None:
        last = candidates.groupBy(*group).agg(F.max("draft_ord").alias("last"))
        after = repairs.join(last, group, "left").withColumn("draft_ord", F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("draft_ord")).drop("last")
        candidates = candidates.unionByName(after, allowMissingColumns=True)
    one = slots.join(candidates.select("doc_id", "lesson_id", "run_id", "candidate").distinct(), ["doc_id", "lesson_id"])
    fixed = provenance.repair_provenance(candidates, atoms, one, chunks, ("doc_id", "run_id", "candidate"))
    gated = cut(gates.full_report(fixed, chunks, group, slots, context))
    relation = atoms.select("doc_id", F.col("atom_id").alias("evidence_atom_id"), "relation")
    rows = gated.join(relation, ["doc_id", "evidence_atom_id"], "left").join(quality, ["run_id", "candidate"], "left")
    rows = rows.withColumn("failing_gates", F.size(F.filter("gates", lambda g: ~g["pass"]))).withColumn("atom_id", F.col("evidence_atom_id"))
    scores = cut(report.set_scores(rows, group))
    best = report.best_sets(scores, group[:3])
    kept = gated.join(best.select(*group), group, "left_semi").filter("passed")
    return {"drafts": gated, "scores": scores, "best": best, "open_slots": contract.missing_slots(slots, kept)}
