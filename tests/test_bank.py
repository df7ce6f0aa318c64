"""A small bank from pages to reports."""

from itemloom.plans import bank
from pyspark.sql import functions as F

from test_operators import DRAFT, draft

TEXT = "A net force of 10 newtons acts on a mass of two kilograms so the acceleration is 5 metres per second squared."


def test_bank(spark):
    pages = spark.createDataFrame([("d", 1, TEXT), ("d", 2, "Energy is conserved in closed systems of this kind."), ("e", 1, "Answer sheet only.")], "doc_id string, page int, text string")
    replies = spark.createDataFrame([("d", "p1-c0", '["Force","Mass"]', 0), ("d", "p2-c1", '{"kind":"content","topics":["Energy"]}', 1), ("e", "p1-c0", '{"kind":"non_content","topics":[]}', 0), ("e", "zz", "[]", 1)], "doc_id string, chunk_id string, json string, reply_ord int")
    lessons = spark.createDataFrame([("d", "L01", 0, ["C001"]), ("d", "L02", 1, ["C003"])], "doc_id string, lesson_id string, lesson_pos int, concept_ids array<string>")
    t = bank.build_outline(pages, replies, lessons)
    assert [r.doc_id for r in t["refused"].collect()] == ["e"] and t["ask_again"].count() == 0
    assert {r.chunk_id: r.lesson_id for r in t["chunks"].filter("doc_id = 'd'").collect()} == {"p1-c0": "L01", "p2-c1": "L02"}
    atoms = spark.createDataFrame([("d", "p1-c0", 0, ["C001"], "Acceleration is five", "the acceleration is 5 metres per second squared", "causal", ["recall"])], "doc_id string, chunk_id string, atom_ord int, concept_ids array<string>, claim string, quote string, relation string, question_forms array<string>")
    need = spark.createDataFrame([("d", "L01", 2, "recall", "easy")], "doc_id string, lesson_id string, question_budget int, required_skill string, required_difficulty string")
    c = bank.contracts(t, atoms, need)
    assert [(r.slot_id, r.atom_id, r.skill) for r in c["slots"].collect()] == [("S01", "A001", "recall")] and c["changes"].count() == 0
    visits = bank.visit_order(t["chunks"], t["lessons"])
    assert {(r.for_lesson, r.chunk_id): r.visit for r in visits.collect()} == {("L01", "p1-c0"): 1, ("L01", "p2-c1"): 2, ("L02", "p2-c1"): 1, ("L02", "p1-c0"): 2}
    rows = [draft(0), draft(1, stem="What kind of system conserves its energy here?", chunk="p2-c1", quote="Energy is conserved in closed systems"), draft(2, quote="absent from the text")]
    out = bank.exam_run(spark.createDataFrame(rows, DRAFT), t["chunks"], visits, spark.createDataFrame([("r", 0, 3)], "run_id string, budget int, lesson_budget int"), ["doc_id", "run_id"])
    assert {r.draft_ord: r.passed for r in out["drafts"].collect()} == {0: True, 1: True, 2: False}
    assert out["pass_rate"].first().n_passed == 2 and [r.gate for r in out["failures"].collect()] == ["quote_verbatim"]
    assert out["ceiling"].first().below_budget and out["topped_up"].first().lessons == ["L02"] and out["memory"].count() == 1
    sets = spark.createDataFrame([draft(0, quote="the acceleration is 5 metres per second squared")], DRAFT).withColumn("candidate", F.lit(1))
    sets = sets.unionByName(spark.createDataFrame([draft(0, quote="no such quote at all")], DRAFT).withColumn("candidate", F.lit(2)))
    quality = spark.createDataFrame([("r", 1, 3, 4), ("r", 2, 4, 4)], "run_id string, candidate int, quality_total long, quality_max long")
    got = bank.set_run(sets, c["atoms"], c["slots"], c["context"], t["chunks"], quality)
    assert [r.candidate for r in got["best"].collect()] == [1] and got["open_slots"].count() == 0
    assert got["drafts"].filter("candidate = 1").first().coverage_slot_id == "S01"
    # A repair for the second candidate takes the slot that its own draft left open, and comes after it.
    repairs = spark.createDataFrame([draft(0, quote="the acceleration is 5 metres per second squared")], DRAFT).withColumn("candidate", F.lit(2))
    again = bank.set_run(sets, c["atoms"], c["slots"], c["context"], t["chunks"], quality, repairs)
    assert {(r.candidate, r.draft_ord): r.passed for r in again["drafts"].collect()} == {(1, 0): True, (2, 0): False, (2, 1): True}
