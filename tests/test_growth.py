"""What must not grow faster than the input."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from itemloom.operators import graph
from itemloom.tables import cut, parts_for, scratch


def shuffles(df) -> int:
    """Exchanges by key in a plan; reused ones don't count."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange hashpartitioning", plan))


def test_a_cut_is_a_compressed_table(spark):
    top = Path(scratch(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in top.rglob("*") if p.is_file())
    before = size()
    df = cut(spark.range(200_000, numPartitions=1).select("id", F.lit("C001").alias("concept_id"), F.lit("a title").alias("title")))
    assert df.count() == 200_000 and size() - before < 2_000_000
    assert cut(spark.range(3).select("id", F.lit(None).alias("nothing"))).count() == 3


def test_a_graph_is_dealt_by_document_once(spark):
    rows = [(d, c, str(c), 1, f"k{(d + c * i) % 5}", f"t{i}", i) for d in range(5) for c in range(4) for i in range(3)]
    seen = spark.createDataFrame(rows, "doc_id long, chunk_ord int, chunk_id string, page int, key string, title string, pos int").dropDuplicates(["doc_id", "chunk_ord", "key"])
    seen = spark.createDataFrame(seen.collect(), seen.schema)
    at = graph.placed(seen, 7)
    assert shuffles(graph.edges_of(at)) == 1 and shuffles(graph.concepts_of(at)) == 1 and at.rdd.getNumPartitions() == 7
    old = graph.edges(seen, graph.concepts(seen))
    assert sorted(map(str, graph.edges_of(at).collect())) == sorted(map(str, old.collect()))


def test_partitions_follow_the_rows(spark):
    assert parts_for(spark, 50_000_000, 100_000) == 500 and parts_for(spark, 0) >= 1


def test_numbers_of_one_large_source_come_from_several_ranges(spark):
    from itemloom.operators.ordered import numbered_ranges

    rows = spark.range(5_000).selectExpr("IF(id < 4500, 'a', 'b') AS source", "hash(id) AS ordinal", "id")
    got = numbered_ranges(rows, ["source"], ["ordinal"], "i", each=500)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    for s in "ab":
        mine = [r.i for r in got.filter(F.col("source") == s).orderBy("ordinal").collect()]
        assert mine == list(range(1, len(mine) + 1)) and len(mine) == (4500 if s == "a" else 500)


def test_sketches_rule_unrelated_pairs_out(spark):
    from math import acos, comb, pi

    from itemloom.operators import rank

    k, p = rank.sketch_limit(0.9, 1e-4), acos(0.9) / pi
    over = lambda p: sum(comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(k + 1, 65))
    assert over(p) <= 1e-4 and over(0.5) > 0.98


def test_many_drafts_of_one_stem_meet_in_blocks(spark):
    from itemloom.operators import gates

    rows = [("r", i, "What is it that we see?") for i in range(23)] + [("r", 99, "Another one altogether"), ("r", 3, "What else is there")]
    got = gates.same_stems(spark.createDataFrame(rows, "run string, draft_ord int, stem string"), ["run"], block=4)
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a in range(23) for b in range(a + 1, 23)]


def test_pairs_are_settled_as_in_the_scan(spark):
    import random

    from itemloom.operators import gates

    rnd = random.Random(3)
    pairs = [(g, *sorted(rnd.sample(range(12), 2))) for g in range(6) for _ in range(14)]
    rows = [(g, i) for g in range(6) for i in range(12)]
    got = {(r.g, r.draft_ord): r.accepted for r in gates.accept_first(spark.createDataFrame(rows, "g int, draft_ord int"), spark.createDataFrame(pairs, "g int, a int, b int"), ["g"]).collect()}
    want: dict = {}
    for g, i in rows:
        want[g, i] = not any(want.get((g, a)) for h, a, b in pairs if h == g and b == i)
    assert got == want


def test_runs_are_measured_only_where_they_count(spark):
    from itemloom.operators import gates

    df = spark.createDataFrame([(1, "Which of these is said about the moon and the tides?", [("one", True), ("two", False)])], "id int, stem string, choices array<struct<content:string,is_correct:boolean>>")
    out = gates.well_formed(df)
    assert "asked" in out._jdf.queryExecution().analyzed().toString() and out.first().malformed is None


def test_a_task_of_the_graph_has_a_bounded_share(spark, monkeypatch):
    from itemloom.plans import bank_queries, queries

    lines = [(o, 1 + (7 * o + i) % 40, i) for o in range(300) for i in range(4)]
    tables = {"lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int"), "orders": spark.createDataFrame([(o, o % 30) for o in range(300)], "o_orderkey long, o_custkey long")}
    wide = sorted(map(str, queries._graph(tables.get).collect()))
    monkeypatch.setattr(queries, "GRAPH_ROWS", 100)
    at = queries._graph(tables.get)
    assert at.rdd.getNumPartitions() == 12 and sorted(map(str, at.collect())) == wide
    # What joins concepts with lessons is dealt as finely, and gives what it gives undealt.
    nodes = graph.concepts_of(at)
    from itemloom.operators import report

    claimed = bank_queries._claimed(nodes)
    got = report.concept_focus(claimed, nodes, 12)
    assert got.rdd.getNumPartitions() == 12
    assert sorted(map(str, got.collect())) == sorted(map(str, report.concept_focus(claimed, nodes).collect())) != []


def test_the_graph_queries_have_small_tasks():
    from itemloom.plans import queries

    assert queries.GRAPH_ROWS <= 100_000


def test_scores_of_sets_leave_rows_where_they_are(spark):
    from itemloom.operators import report

    cols = "run int, candidate int, passed boolean, failing_gates int, atom_id string, skill string, relation string, chunk_id string, quality_total long, quality_max long"
    rows = [
        (1, 1, True, 0, "a", "s", "r", "c", 30, 60), (1, 1, True, 1, "a", None, "", "c", 30, 60), (1, 1, True, 0, None, "t", None, "d", 30, 60), (1, 1, True, 0, "", "t", "q", "d", 30, 60),
        (1, 1, False, 3, "x", "x", "x", "x", 30, 60), (1, 1, None, 2, "y", "y", "y", "y", 30, 60), (1, 2, False, 4, "a", "s", "r", "c", None, None), (2, 3, True, 0, "a", "s", "r", "c", 5, 0),
    ]
    df = spark.createDataFrame(rows, cols)
    out = report.set_scores(df.repartition(3, "candidate"), ["run", "candidate"])
    assert shuffles(out) == 1
    got = {(r.run, r.candidate): (r.passed, r.failing, r.atoms, r.skills, r.relations, r.chunks, r.total, r.most, r.score) for r in out.collect()}
    assert got == {
        (1, 1): (4, 6, 2, 3, 2, 2, 30, 60, 4_000_000 + 500_000 + 1_000 + 300 + 150 + 50 - 60),
        (1, 2): (0, 4, 0, 0, 0, 0, None, None, -40),
        (2, 3): (1, 0, 1, 1, 1, 1, 5, 0, 1_000_000 + 500 + 100 + 75 + 25),
    }


def test_atoms_of_a_contract_are_dealt_once_and_large_lessons_by_class(spark, monkeypatch):
    from itemloom.plans import bank_queries, queries

    sf = "/root/testdata/sf0.001"
    # Lines and orders by order, lines and lessons by customer; atoms with their texts are dealt nowhere.
    df = queries.QUERIES["contract_slots"](spark, sf)
    assert shuffles(df) == 4
    whole = sorted(map(str, df.collect()))
    monkeypatch.setattr(bank_queries, "MOST_ORDERS", 12)
    assert sorted(map(str, queries.QUERIES["contract_slots"](spark, sf).collect())) == whole != []


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_contracts_across_batches(spark, most):
    import random

    from itemloom.operators import contract
    from test_blocks import brute_contract

    rng, atoms, lessons, want = random.Random(4), [], [], {}
    for d in range(20):
        budget, need = rng.randrange(7), rng.choice(["", "", "calculation", "recall"])
        lessons.append((d, "L1", budget, need or None, None))
        own = [
            {"doc_id": d, "chunk_id": f"c{rng.randrange(3)}", "atom_id": f"A{i:03}", "claim": f"Claim {rng.randrange(rng.choice([3, 60]))}", "relation": rng.choice(["causal", "Causal", "example", "odd", "direction"]),
             "concept_ids": [f"C{x}" for x in rng.sample(range(9), rng.randrange(3))], "question_forms": rng.sample(list(contract.SKILLS), rng.randrange(4)), "quote": "q"}
            for i in range(rng.choice([1, 3, 30, 150]))
        ]
        atoms += own
        want[d] = brute_contract(own, budget, need)
    df = spark.createDataFrame([tuple(a.values()) for a in atoms], "doc_id long, chunk_id string, atom_id string, claim string, relation string, concept_ids array<string>, question_forms array<string>, quote string")
    lessons = spark.createDataFrame(lessons, "doc_id long, lesson_id string, question_budget int, required_skill string, required_difficulty string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        rows = contract.build_contract(lessons, df.select("doc_id", F.lit("L1").alias("lesson_id"), "chunk_id"), df, most=most).orderBy("doc_id", "slot_ord").collect()
    finally:
        spark.conf.set(name, before)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.atom_id)
        assert r.slot_ord == len(got[r.doc_id]) and r.slot_id == f"S{r.slot_ord:02d}"
    assert got == {d: x for d, x in want.items() if x}


def test_open_slots_deal_atoms_once(spark, monkeypatch):
    from itemloom.plans import bank_queries, queries

    # What is written between the steps has the slots; the atoms behind them are dealt as numbers, without texts.
    seen = []
    monkeypatch.setattr(bank_queries, "cut", lambda df: seen.append(df) or cut(df))
    got = queries.QUERIES["open_slots"](spark, "/root/testdata/sf0.001").count()
    (slots,) = [df for df in seen if "slot_id" in df.columns]
    assert shuffles(slots) == 4 and got == slots.filter("slot_ord % 2 = 1").count()


def test_stems_that_compress_well_do_not_go_through_the_driver(spark):
    from itemloom.operators import gates

    rows = spark.range(400).selectExpr("'r' AS run", "id AS draft_ord", "concat('Which of these is said about the moon and the tides of ', id % 90, '?') AS stem")
    got = gates.same_stems(rows, ["run"], block=3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == got.distinct().count() == 400 * 399 // 2
    # Near stems are as large as the grams of their texts: these plans are run and written on the way.
    near = gates.near_stems(rows.selectExpr("run", "lower(stem) AS s"), ["run"])
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 90 * 89 // 2


def test_a_hot_stem_is_returned_by_several_tasks(spark, monkeypatch):
    from itemloom.operators import gates

    monkeypatch.setattr(gates, "PAIRS", 5_000)
    rows = spark.range(300).selectExpr("'r' AS run", "id AS draft_ord", "'What is it that we see?' AS stem")
    got = gates.same_stems(rows, ["run"], block=20)
    share = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in share) == 300 * 299 // 2 and len(share) > 4 and max(r["count"] for r in share) < 300 * 299 // 4


def test_orphans_are_found_where_the_graph_is(spark, monkeypatch):
    from itemloom.plans import bank_queries, queries

    # Lines and orders by order, concepts by document, for concepts and for edges: the scan needs no exchange and no table.
    with monkeypatch.context() as m:
        m.delattr(graph, "cut")
        df = queries.QUERIES["recovered_concepts"](spark, "/root/testdata/sf0.001")
        assert shuffles(df) == 2 * 3
        whole = sorted(map(str, df.collect()))
    monkeypatch.setattr(bank_queries, "MOST_ORDERS", 12)
    assert sorted(map(str, queries.QUERIES["recovered_concepts"](spark, "/root/testdata/sf0.001").collect())) == whole != []


def test_scans_and_joins_find_the_same_orphans(spark):
    import random

    rng, nodes, links, claimed = random.Random(9), [], [], []
    for d in range(30):
        n = rng.randrange(1, 30)
        ids = [f"C{i:03}" for i in range(n)]
        nodes += [(d, i, c) for i, c in enumerate(ids)]
        claimed += [(d, c, f"L{rng.randrange(3)}") for c in ids if d % 7 and rng.random() < 0.2]
        # Ends that are no concept, loops, and edges twice.
        links += [(d, k, rng.choice(["co_occurs", "follows", "other"]), rng.choice([*ids, "C999"]), rng.choice(ids)) for k in range(rng.randrange(40))]
    nodes = spark.createDataFrame(nodes, "doc_id long, concept_ord int, concept_id string").repartition(3)
    links = spark.createDataFrame(links, "doc_id long, edge_ord int, kind string, src string, dst string").repartition(5)
    claimed = spark.createDataFrame(claimed, "doc_id long, concept_id string, lesson_id string")
    got = [sorted(map(tuple, graph.recover_orphans(nodes, links, claimed, most=k).collect())) for k in (0, 15, 10**6)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} >= {1, 2, 3}
    none = links.limit(0)
    assert sorted(map(tuple, graph.recover_orphans(nodes, none, claimed, most=0).collect())) == sorted(map(tuple, graph.recover_orphans(nodes, none, claimed).collect())) != []
