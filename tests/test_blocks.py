"""Operators that work in rounds or blocks, against the sequential rules they stand for."""

import random

import pytest
from itemloom.operators import chunking, contract, graph, ordered, provenance, report
from itemloom.sources import mcq, runs
from itemloom.streaming import calls
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(4))
def test_orphans_as_the_scan_in_order(spark, seed):
    rng = random.Random(seed)
    nodes, links, claimed, want = [], [], [], set()
    for d in range(25):
        n = rng.randrange(1, 14)
        ids = [f"C{i:03}" for i in range(n)]
        nodes += [(d, i, c) for i, c in enumerate(ids)]
        own = {c: f"L{rng.randrange(3)}" for c in ids if rng.random() < 0.25}
        claimed += [(d, c, x) for c, x in own.items()]
        edges = [(k, rng.choice(["co_occurs", "follows"]), rng.choice(ids), rng.choice(ids)) for k in range(rng.randrange(16))]
        links += [(d, *e) for e in edges]
        lesson = dict(own)
        for c in ids:
            if c not in lesson:
                near = [x for kind in ("co_occurs", "follows") for _, k, a, b in edges if k == kind and c in (a, b) for x in ((b if a == c else a),) if x in lesson]
                if near:
                    lesson[c] = lesson[near[0]]
        for i, c in enumerate(ids):
            if c not in lesson:
                near = [ids[j] for k in range(1, n) for j in (i - k, i + k) if 0 <= j < n and ids[j] in lesson]
                if near:
                    lesson[c] = lesson[near[0]]
        want |= {(d, c, x) for c, x in lesson.items()}
    nodes = spark.createDataFrame(nodes, "doc_id long, concept_ord int, concept_id string")
    links = spark.createDataFrame(links, "doc_id long, edge_ord int, kind string, src string, dst string")
    claimed = spark.createDataFrame(claimed, "doc_id long, concept_id string, lesson_id string")
    got = graph.recover_orphans(nodes, links, claimed).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_batches_as_next_fit(spark):
    rng, rows, want = random.Random(2), [], {}
    for d in range(30):
        b = n = used = 0
        for i in range(rng.choice([1, 2, 40, 300])):
            t = "x" * rng.choice([0, 3, 50, 400, 2000])
            rows.append((d, 2 * i, f"c{i}", t))
            cost = len(t) + len(f"c{i}") + 32
            if n and (n >= 4 or used + cost > 1500):
                b, n, used = b + 1, 0, 0
            n, used = n + 1, used + cost
            want[d, 2 * i] = b
    df = spark.createDataFrame(rows, "doc_id long, chunk_ord int, chunk_id string, text string").repartition(3)
    got = chunking.plan_batches(df, 4, 1500).collect()
    assert {(r.doc_id, r.chunk_ord): r.batch for r in got} == want and len(got) == len(want)


def brute_contract(atoms, budget, need):
    left, slots = sorted(atoms, key=lambda a: (a["chunk_id"], a["atom_id"])), []
    relations, concepts, claims = set(), set(), set()
    while len(slots) < budget:
        want = need or contract.SKILLS[len(slots) % 4]
        able = [a for a in left if a["claim"].lower() not in claims and (not need or want in a["question_forms"])]
        if not able:
            break
        worth = lambda a: contract.RELATION_WORTH.get(a["relation"].lower(), 40) + 100 * (want in a["question_forms"]) + (55 if a["relation"].lower() not in relations else -25) + 20 * any(c not in concepts for c in a["concept_ids"])  # noqa: B023, E731
        a = max(able, key=worth)
        left.remove(a)
        claims.add(a["claim"].lower())
        relations.add(a["relation"].lower())
        concepts.update(a["concept_ids"])
        slots.append(a["atom_id"])
    return slots


@pytest.mark.parametrize("seed", range(3))
def test_pruned_contracts_pick_as_if_nothing_was_pruned(spark, seed):
    rng, atoms, lessons, want = random.Random(seed), [], [], {}
    for d in range(12):
        budget, need = rng.randrange(1, 7), rng.choice(["", "", "calculation"])
        lessons.append((d, "L1", budget, need, ""))
        own = [
            {"doc_id": d, "chunk_id": f"c{rng.randrange(3)}", "atom_id": f"A{i:03}", "claim": f"Claim {rng.randrange(rng.choice([3, 60]))}", "relation": rng.choice(["causal", "Causal", "example", "odd", "direction"]),
             "concept_ids": [f"C{x}" for x in rng.sample(range(9), rng.randrange(3))], "question_forms": rng.sample(list(contract.SKILLS), rng.randrange(4)), "quote": "q"}
            for i in range(rng.choice([3, 30, 150]))
        ]
        atoms += own
        want[d] = brute_contract(own, budget, need)
    df = spark.createDataFrame([tuple(a.values()) for a in atoms], "doc_id long, chunk_id string, atom_id string, claim string, relation string, concept_ids array<string>, question_forms array<string>, quote string")
    lessons = spark.createDataFrame(lessons, "doc_id long, lesson_id string, question_budget int, required_skill string, required_difficulty string")
    context = df.select("doc_id", F.lit("L1").alias("lesson_id"), "chunk_id")
    got = {}
    for r in contract.build_contract(lessons, context, df).orderBy("doc_id", "slot_ord").collect():
        got.setdefault(r.doc_id, []).append(r.atom_id)
    assert got == {d: x for d, x in want.items() if x}


def test_quotes_by_both_ways(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(i, word(rng.choice([0, 5, 90]))) for i in range(80)] + [(99, None)]
    quotes = [(i, word(rng.choice([1, 2, 3, 6, 12, 20]))) for i in range(60)] + [(70, None), (71, " "), (72, texts[3][1]), (73, texts[5][1])]
    squeeze = lambda x: "".join((x or "").split())
    want = {(i, d) for i, q in quotes for d, t in texts if squeeze(q) and squeeze(q) in squeeze(t)}
    q, t = spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    for width in (4, 12):
        for most in (0, 1 << 20):
            got = provenance.quotes_anywhere(q, t, width, most).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_containing(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 9, 14])))
    short, long = [(rng.randrange(3), word()) for _ in range(90)], [(rng.randrange(3), word() + word()) for _ in range(90)]
    got = provenance.containing(spark.createDataFrame(short, "g int, s string"), spark.createDataFrame(long, "g int, l string"), ["g"], 4).collect()
    assert sorted(map(tuple, got)) == sorted({(g, s, x) for g, s in short for h, x in long if g == h and s and s in x})


def test_running_values_and_numbers_across_blocks(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(5)) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn("part", F.floor(F.col("i") / 7))
    out = ordered.numbered(df.repartition(3), ["g"], "part", ["i"])
    out = ordered.running(out, ["g"], 4, {"total": F.col("v")}, {"last": F.when(F.col("v") == 0, F.col("n"))})
    got = {(r.g, r.i): (r.n, r.total, r.last) for r in out.collect()}
    for g in "ab":
        total, last = 0, None
        for i, v in [(i, v) for h, i, v in rows if h == g]:
            total, last = total + v, i + 1 if v == 0 else last
            assert got[g, i] == (i + 1, total, last)


def test_lists_in_blocks_as_in_one(spark, tmp_path):
    rng, lines = random.Random(4), ["﻿ข้อ 1"]
    for i in range(120):
        kind = rng.randrange(9)
        lines += [f"{i}. What is {i}?"] if kind != 1 else []
        lines += ["Answer: B"] if kind == 2 else []
        lines += ["more of it"] if kind == 3 else []
        lines += [f"{x}. option {x}{i}" for x in "ABCD"[: 3 if kind == 4 else 4]]
        lines += ["Answer: C", ""] if kind != 5 else [""]
        lines += ["Answer: D"] if kind == 6 else []
        lines += [f"{i}. Inline {i}? A. one B. two C. three D. four Answer: A"] if kind == 7 else []
    lines.append("the end")
    (tmp_path / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.txt").write_text("nothing here\r\nA. one\r\n", encoding="utf-8")
    read = mcq.read_lines(spark, str(tmp_path))
    assert {r.lineno: r.raw for r in read.collect() if r.path.endswith("a.txt")} == {i + 1: x.removeprefix("﻿") for i, x in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        parts = mcq.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, parts)) == sorted(map(tuple, read.collect()))
    whole = [sorted(map(repr, x.collect())) for x in mcq.parse(read, 10_000)]
    assert whole[0] and whole[1]
    for block in (4, 37):
        assert [sorted(map(repr, x.collect())) for x in mcq.parse(read, block)] == whole


def test_sheet_rows_are_named(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('id,stem,choice_a,choice_b,choice_c,choice_d,label\nQ1,"two\nlines",a,b,c,d,good\nQ2,s,a,b,c,d,\nQ1,s,a,b,c,d,odd\n,s,a,b,c,d,good\nQ9,s,a,b,c,d,good\nQ3,s,a,b,c,d,good,more\n', encoding="utf-8")
    rows = runs.read_sheet(spark, str(tmp_path / "sheet.csv"))
    key = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "id string")
    got = {(r.row, r.id, r.problem) for r in runs.sheet_rows_with_problems(rows, key, report.LABELS).collect()}
    assert got == {(3, "Q2", "no label"), (4, "Q1", "id twice"), (4, "Q1", "unknown label"), (5, "", "no id"), (6, "Q9", "not in the key"), (7, "Q3", "cells that don't fit the header"), (None, "Q3", "not on the sheet")}


def test_table_over_jdbc_in_parts(spark):
    url, driver = "jdbc:derby:memory:itemloom;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(i % 7 if i < 900 else i * 1000, f"v{i}") for i in range(1000)] + [(None, "none")]
    spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("overwrite").jdbc(url, "items", properties={"driver": driver, "createTableColumnTypes": "v VARCHAR(20)"})
    df = runs.read_table(spark, url, "items", '"id"', parts=4, driver=driver)
    assert sorted(map(repr, df.collect())) == sorted(f"Row(id={a!r}, v={b!r})" for a, b in rows)
    assert df.rdd.getNumPartitions() > 1
    few = df.filter("v = 'v950'")
    assert "EqualTo(v,v950)" in few._jdf.queryExecution().toString()
    assert [r.id for r in few.collect()] == [950000]
    assert runs.read_table(spark, url, "items", driver=driver).count() == 1001


def test_stream_survives_a_repeated_batch_and_a_restart(spark, tmp_path):
    kind = "label string, start_ts timestamp, end_ts timestamp, eval_tokens long"
    add = lambda n, label, k: spark.sql(f"SELECT '{label}' AS label, timestamp'2024-01-01 00:00:00' AS start_ts, timestamp'2024-01-01 00:00:01' AS end_ts, {k}L AS eval_tokens FROM range({n})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder, at = str(tmp_path / "stats"), str(tmp_path / "checkpoint")

    def run():
        calls.start(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), folder, at, availableNow=True).awaitTermination()
        return {r.label: (r.calls, r.total_ms, r.eval_tokens) for r in calls.current(spark, folder).collect()}

    add(3, "a", 5)
    assert run() == {"a": (3, 3000.0, 15)}
    add(2, "b", 1)
    add(1, "a", 5)
    want = {"a": (4, 4000.0, 20), "b": (2, 2000.0, 2)}
    assert run() == want
    last = spark.read.parquet(folder).agg(F.max("batch")).first()[0]
    again = spark.createDataFrame(spark.read.parquet(f"{folder}/batch={last}").collect())
    calls.upsert(again, last, folder)
    assert {r.label: (r.calls, r.total_ms, r.eval_tokens) for r in calls.current(spark, folder).collect()} == want
    assert run() == want


def test_sources_meet_on_one_sheet(spark):
    ours = spark.createDataFrame([("ours", i, f"s{i}", ["a", "b", "c", "d"], "A") for i in range(30)], "source string, ordinal int, stem string, choices array<string>, correct string")
    other = spark.createDataFrame([("other", i, f"t{i}", ["a", "b", "c", "d"]) for i in range(9)], "source string, ordinal int, stem string, choices array<string>")
    sheet, key = report.blind_sheet(ours.repartition(5), 3, other)
    again, _ = report.blind_sheet(ours, 3, other.repartition(2))
    rows = sorted(map(tuple, sheet.collect()))
    assert rows == sorted(map(tuple, again.collect())) and [r[0] for r in rows] == [f"Q{i:02}" for i in range(1, 40)]
    assert key.filter("source = 'other' AND correct_choice IS NULL").count() == 9
    both = report.united(ours.drop("correct"), other).collect()
    assert len(both) == 39 and all(r.gates == [] and r.skill == "" and r.correct is None and r.category == min((r.i - 1) // 5, 2) for r in both)


@pytest.mark.parametrize("seed", range(3))
def test_acceptance_over_classes_as_the_scan(spark, seed):
    """Slots, atoms, equal and near stems and near vectors at once, many drafts in one class."""
    from itemloom.operators import gates

    rng, rows = random.Random(seed), []
    base = ["what is the mass of a falling body here", "which of these planets is the largest one", "ab", "abc", ""]
    for g in range(4):
        for i in range(30):
            stem = rng.choice(base)
            stem = stem + "x" if rng.random() < 0.3 else stem if rng.random() < 0.5 else f"{stem} {rng.getrandbits(30)} {rng.getrandbits(40)}"
            rows.append((g, i, stem, rng.choice(["", None, *[f"S{k}" for k in range(9)]]), rng.choice(["", *[f"A{k}" for k in range(12)]]), [rng.choice([-1.0, 1.0]), rng.random() * 3, rng.choice([0.0, 2.0])]))
    df = spark.createDataFrame(rows, "run_id int, draft_ord int, stem string, coverage_slot_id string, evidence_atom_id string, vector array<double>")

    def near(a, b):
        a, b = sorted(("".join(a.split()).lower(), "".join(b.split()).lower()), key=len)
        r = -(-len(a) * 85 // 100)
        return bool(a) and any(a[i : i + r] in b for i in range(len(a) - r + 1))

    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    clash = lambda a, b: near(a[2], b[2]) or (a[3] and a[3] == b[3]) or (a[4] and a[4] == b[4]) or cosine(a[5], b[5]) >= 0.9
    want, kept = {}, []
    for r in sorted(rows, key=lambda r: r[:2]):
        want[r[:2]] = not any(k[0] == r[0] and clash(k, r) for k in kept)
        if want[r[:2]]:
            kept.append(r)
    got = {(r.run_id, r.draft_ord): r.accepted for r in gates.accept_first(df, gates.conflicts(df, ["run_id"]), ["run_id"]).collect()}
    assert got == want and 4 < len(kept) < 60


def test_near_vectors_around_the_limit(spark):
    """Pairs planted at cosines of 0.88 to 0.92 and copies: none below the limit, all copies, next to all at or above it."""
    import numpy as np
    from itemloom.operators import rank

    rng, rows = np.random.default_rng(4), []
    for i in range(0, 800, 2):
        x, y = rng.standard_normal((2, 24))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        c = rng.uniform(0.88, 0.92)
        rows += [(i, x.tolist()), (i + 1, (c * x + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)).tolist())]
    rows += [(1000 + k, rows[7][1]) for k in range(20)] + [(2000, None), (2001, [0.0] * 24)]
    v = {i: np.array(x) for i, x in rows if x and any(x)}
    want = {(a, b) for a in v for b in v if a < b and v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= 0.9}
    got = [(r.a, r.b) for r in rank.near_vectors_blocked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    assert {(a, b) for a, b in want if a in (7, *range(1000, 1020)) and b >= 1000} <= set(got)
