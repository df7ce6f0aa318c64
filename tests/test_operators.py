import random

from itemloom.operators import chunking, contract, decode, gates, graph, provenance, rank, report
from pyspark.sql import functions as F

CHOICES = "array<struct<content:string,is_correct:boolean>>"
DRAFT = f"doc_id string, run_id string, lesson_id string, draft_ord int, chunk_id string, stem string, choices {CHOICES}, source_quote string, difficulty string, skill string, calculation struct<expression:string,expected:double,unit:string>, coverage_slot_id string, evidence_atom_id string, evidence_chunk_id string"
SOURCE = "A net force of 10 newtons acts on a mass of two kilograms so the acceleration is 5 metres per second squared."


def draft(i, stem="What is the acceleration of the body in this experiment?", right="5 metres per second squared", chunk="p1-c0", quote="acts on a mass of two kilograms", calc=None, skill="recall", level="easy", slot="", atom="", others=("3 metres per second squared", "7 metres per second squared", "9 metres per second squared")):
    return ("d", "r", "L01", i, chunk, stem, [(right, True), *[(o, False) for o in others]], quote, level, skill, calc, slot, atom, chunk)


def chunks(spark):
    rows = [("d", 0, "p1-c0", 1, SOURCE, "core", "L01"), ("d", 1, "p1-c1", 1, "Other text about a cat that sleeps.", "core", "L02"), ("d", 2, "p2-c2", 2, "ตรวจสอบความรู้ก่อนเรียน " + SOURCE, "", "L02")]
    return spark.createDataFrame(rows, "doc_id string, chunk_ord int, chunk_id string, page int, text string, source_role string, lesson_id string")


def test_chunks_cover_pages(spark):
    rng = random.Random(0)
    texts = ["", "  \n", "สวัสดี" * 500, "x" * 3000, *["".join(rng.choice("ab .\n?") for _ in range(rng.randint(1, 4000))) for _ in range(8)]]
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page int, text string")
    rows = chunking.chunk_pages(pages, 300, 40).orderBy("chunk_ord").collect()
    assert [r.chunk_ord for r in rows] == list(range(len(rows))) and all(r.chunk_id == f"p{r.page}-c{r.chunk_ord}" for r in rows)
    for p in {r.page for r in rows}:
        mine = [r for r in rows if r.page == p]
        assert mine[0].start_off == 0 and all(b.start_off <= a.end_off and b.end_off > a.end_off and a.end_off - a.start_off <= 300 for a, b in zip(mine, mine[1:]))
    assert {r.page for r in rows} == {i + 1 for i, t in enumerate(texts) if t.strip()}


def test_boundaries():
    assert chunking._spans("a" * 80 + ".\n\n" + "b" * 100, 100, 10)[0] == (0, 83)
    assert chunking._spans("a" * 80 + "." + "b" * 100, 100, 10)[0] == (0, 81)
    assert chunking._spans("a" * 10 + "." + "b" * 100, 100, 10)[0] == (0, 100)
    assert chunking._spans("", 10, 2) == [] and chunking._spans("abc", 10, 2) == [(0, 3)]


def test_batches(spark):
    rng = random.Random(2)
    sizes = {d: [rng.randint(1, 400) for _ in range(60)] for d in "ab"}
    df = spark.createDataFrame([(d, i, f"c{i}", "x" * n) for d, s in sizes.items() for i, n in enumerate(s)], "doc_id string, chunk_ord int, chunk_id string, text string")
    got = {(r.doc_id, r.chunk_ord): r.batch for r in chunking.plan_batches(df, 5, 1200).collect()}
    for d, s in sizes.items():
        b = n = used = 0
        for i, x in enumerate(s):
            cost = x + len(f"c{i}") + 32
            if n and (n >= 5 or used + cost > 1200):
                b, n, used = b + 1, 0, 0
            n, used = n + 1, used + cost
            assert got[d, i] == b
    again = chunking.split_failed(chunking.plan_batches(df, 5, 1200), spark.createDataFrame([("a", 0)], "doc_id string, batch int"))
    assert {r.half for r in again.collect()} == {0, 1}


def test_topics(spark):
    rows = ['{"kind":"content","topics":[" Force "]}', '["A","B"]', '["NON_CONTENT"]', '{"kind":"odd","topics":[]}', '{"kind":"Apparatus","topics":["x","NON_CONTENT"]}', '```json\n["Q"]\n```']
    got = [(r.kind, r.topics) for r in decode.topics(spark.createDataFrame([(x,) for x in rows], "json string")).collect()]
    assert got == [("content", ["Force"]), ("content", ["A", "B"]), ("non_content", []), ("content", []), ("apparatus", ["x"]), ("content", ["Q"])]


def test_tolerant_json(spark):
    rows = ['{"expression":"2+2","expected":"4","unit":"m"}', '{"expression":"2+2","expected":4}', '{"expression":"2+2","expected":"4 m"}', '{"expression":"","expected":1}']
    got = decode.calculation(spark.createDataFrame([(x,) for x in rows], "json string")).collect()
    assert [(r.calculation and (r.calculation.expected, r.calculation.unit), r.problem is not None) for r in got] == [((4.0, "m"), False), ((4.0, ""), False), (None, True), (None, False)]
    rows = [
        '{"best_index":1,"choice_verdicts":[{"index":0,"status":"unsupported","reason":"r"}],"dependency":"specific","evidence":["a"],"counterfactual":"yes"}',
        '{"best_index":0,"choice_verdicts":{"1":"unsupported","0":{"status":"supported"}},"source_dependency":{"dependency_kind":"specific","evidence":"a; b","counterfactual":"ไม่"}}',
    ]
    a, b = decode.sourced_verdict(spark.createDataFrame([(x,) for x in rows], "json string")).collect()
    assert (a.best_index, a.dependency, a.evidence, a.counterfactual, a.choice_verdicts[0].status) == (1, "specific", ["a"], True, "unsupported")
    assert (b.dependency, b.evidence, b.counterfactual, [(c["index"], c.status) for c in b.choice_verdicts]) == ("specific", ["a", "b"], False, [(0, "supported"), (1, "unsupported")])
    q = decode.quality_verdicts(spark.createDataFrame([('{"verdicts":[{"question_index":0,"score":3}]}',)], "json string")).collect()
    assert [(r.question_index, r.score) for r in q] == [(0, 3)]
    bad = decode.violations(spark.createDataFrame([(5, 0), (4, 1)], "score int, question_index int"), "quality", F.col("question_index"))
    assert [tuple(r) for r in bad.collect()] == [("quality", "0", "score")]


def test_reconcile(spark):
    asked = spark.createDataFrame([("d", "a"), ("d", "b")], "doc_id string, chunk_id string")
    replies = spark.createDataFrame([("d", "x", 0, "k0"), ("d", "a", 2, "k2"), ("d", "a", 1, "k1")], "doc_id string, chunk_id string, reply_ord int, kind string")
    first, again = decode.reconcile(asked, replies)
    assert [(r.chunk_id, r.kind) for r in first.collect()] == [("a", "k1")] and [r.chunk_id for r in again.collect()] == ["b"]


def labelled(spark, kinds, topics=None):
    topics = topics or [["t"]] * len(kinds)
    return spark.createDataFrame([("d", i, f"p1-c{i}", k, t) for i, (k, t) in enumerate(zip(kinds, topics))], "doc_id string, chunk_ord int, chunk_id string, kind string, topics array<string>")


def test_smoothing(spark):
    kinds = ["non_content", "content", "apparatus", "content", "non_content", "non_content", "non_content", "content", "apparatus"]
    once = graph.smooth_runs(labelled(spark, kinds))
    got = [r.kind for r in once.orderBy("chunk_ord").collect()]
    assert got == ["non_content", "content", "content", "content", "non_content", "non_content", "non_content", "content", "apparatus"]
    assert [r.kind for r in graph.smooth_runs(once.drop("rescued")).orderBy("chunk_ord").collect()] == got
    for kinds, refused in ((["content"] * 4 + ["apparatus"] * 2, False), (["content"] * 3 + ["apparatus"] * 3, False), (["content"] * 7 + ["apparatus"] * 11, True)):
        assert graph.drop_share(labelled(spark, kinds)).first().refused is refused
    dropped = graph.dropped_topics(labelled(spark, ["apparatus", "non_content", "content"], [["A", "a "], ["b"], ["c"]])).first()
    assert (dropped.apparatus, dropped.non_content) == (1, 1)


def test_graph_and_outline(spark):
    c = spark.createDataFrame([("d", i, f"p1-c{i}", 1 + i // 2) for i in range(5)], "doc_id string, chunk_ord int, chunk_id string, page int")
    lab = labelled(spark, ["content"] * 3 + ["apparatus", "content"], [["Force", "mass "], [], ["force", "Energy"], ["x"], ["Heat"]])
    nodes, edges = graph.evidence_graph(c, lab)
    n = {r.concept_id: r for r in nodes.collect()}
    assert {k: (r.title, r.chunk_ids, r.pages) for k, r in n.items()} == {"C001": ("Force", ["p1-c0", "p1-c2"], [1, 2]), "C002": ("mass", ["p1-c0"], [1]), "C003": ("Energy", ["p1-c2"], [2]), "C004": ("Heat", ["p1-c4"], [3])}
    assert [(r.kind, r.src, r.dst) for r in edges.orderBy("edge_ord").collect()] == [("co_occurs", "C001", "C002"), ("co_occurs", "C001", "C003"), ("follows", "C002", "C001"), ("follows", "C003", "C004")]
    lessons = spark.createDataFrame([("d", "L01", 0, ["C002", "C999"]), ("d", "L02", 1, ["C002"]), ("d", "L03", 2, [])], "doc_id string, lesson_id string, lesson_pos int, concept_ids array<string>")
    left, concepts, at = graph.outline(lessons, nodes, edges)
    assert {r.concept_id: r.lesson_id for r in concepts.collect()} == dict.fromkeys(n, "L01")
    assert {r.chunk_id for r in at.collect()} == {"p1-c0", "p1-c2", "p1-c4"} and [r.lesson_id for r in left.collect()] == ["L01"]
    start = spark.createDataFrame([("d", "L", "C002")], "doc_id string, owner string, concept_id string")
    assert {r.concept_id for r in graph.neighbourhood(start, edges).collect()} == {"C001", "C002", "C003"}


def atoms(spark):
    rows = [("d", "p1-c0", 1, ["C001", "C009"], "Force is ten", "A net force of 10 newtons", "causal", ["calculation", "recall"]), ("d", "p1-c0", 2, ["C001"], "force is TEN", "net  force", "Causal", ["recall"]), ("d", "zz", 3, [], "x", "y", "z", ["recall"]), ("d", "p1-c1", 4, ["C002"], "Cats sleep", "a cat that sleeps", "definition", ["Understanding"]), ("d", "p1-c0", 5, [], "mass", "not there", "example", [])]
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, atom_ord int, concept_ids array<string>, claim string, quote string, relation string, question_forms array<string>")


def test_atoms_contract_preflight(spark):
    nodes = spark.createDataFrame([("d", 0, "C001", ["p1-c0"]), ("d", 1, "C002", ["p1-c1"])], "doc_id string, concept_ord int, concept_id string, chunk_ids array<string>")
    good = graph.source_bound_atoms(atoms(spark), chunks(spark), nodes)
    assert {r.atom_id: (r.chunk_id, r.concept_ids, r.page) for r in good.collect()} == {"A001": ("p1-c0", ["C001"], 1), "A002": ("p1-c1", ["C002"], 1)}
    links = spark.createDataFrame([("d", "C001", "C002")], "doc_id string, src string, dst string")
    context = contract.lesson_context(spark.createDataFrame([("d", "L01", "p1-c0")], "doc_id string, lesson_id string, chunk_id string"), spark.createDataFrame([("d", "L01", "C001")], "doc_id string, lesson_id string, concept_id string"), chunks(spark), nodes, links, good)
    assert {r.chunk_id for r in context.collect()} == {"p1-c0", "p1-c1"}
    lessons = spark.createDataFrame([("d", "L01", 5, "", "")], "doc_id string, lesson_id string, question_budget int, required_skill string, required_difficulty string")
    slots = contract.build_contract(lessons, context, good)
    assert [(r.slot_id, r.atom_id, r.skill, r.difficulty) for r in slots.orderBy("slot_ord").collect()] == [("S01", "A002", "understanding", "easy"), ("S02", "A001", "calculation", "medium")]
    need = contract.build_contract(lessons.withColumn("required_skill", F.lit("calculation")), context, good).collect()
    assert [(r.atom_id, r.skill, r.difficulty) for r in need] == [("A001", "calculation", "")]
    extra = slots.limit(0).unionByName(slots).unionByName(slots.filter("slot_ord = 1").withColumn("slot_id", F.lit("S03")).withColumn("slot_ord", F.lit(3))).unionByName(slots.filter("slot_ord = 1").withColumns({"slot_id": F.lit("S04"), "slot_ord": F.lit(4), "atom_id": F.lit("A999")}))
    extra = extra.withColumn("skill", F.when(F.col("slot_id") == "S01", "Calculation").otherwise(F.col("skill"))).withColumn("evidence_quote", F.when(F.col("slot_id") == "S02", "gone").otherwise(F.col("evidence_quote")))
    clean, changes = contract.preflight(extra, good, context)
    assert {r.slot_id: (r.skill, r.evidence_quote) for r in clean.collect()} == {"S01": ("understanding", "a cat that sleeps"), "S02": ("calculation", "A net force of 10 newtons")}
    assert {(r.slot_id, r.change.split(":")[0]) for r in changes.collect()} == {("S01", "downgrade"), ("S02", "repair"), ("S03", "drop"), ("S04", "drop")}
    drafts = spark.createDataFrame([draft(0, quote="A net force of 10", skill="calculation", level="medium"), draft(1, quote="nothing")], DRAFT)
    fixed = provenance.repair_provenance(drafts, good, clean, chunks(spark), ("doc_id", "lesson_id")).orderBy("draft_ord").collect()
    assert (fixed[0].coverage_slot_id, fixed[0].evidence_atom_id, fixed[1].coverage_slot_id) == ("S02", "A001", "")
    off = {r.draft_ord: r.off_contract for r in gates.coverage_gate(spark.createDataFrame([draft(0, slot="S02", atom="A001", quote="A net force of 10 newtons acts", skill="calculation", level="medium", calc=("2*5", 10.0, "")), draft(1, slot="S09"), draft(2, slot="S02", atom="A002"), draft(3, slot="S02", atom="A001", quote="A net force of 10 newtons", skill="calculation", level="hard", calc=("2*5", 10.0, ""))], DRAFT), clean, context).collect()}
    assert off[0] is None and off[1] == "unknown slot" and off[2] == "another atom than the slot's" and off[3] == "another difficulty"
    assert [r.slot_id for r in contract.missing_slots(clean, fixed and spark.createDataFrame([("d", "L01", "S02")], "doc_id string, lesson_id string, coverage_slot_id string")).collect()] == ["S01"]


def verdicts(spark, *rows):
    out = gates.cheap_gates(spark.createDataFrame(list(rows), DRAFT), chunks(spark)).collect()
    return {r.draft_ord: {g.gate: g["pass"] for g in r.gates} for r in out}, {r.draft_ord: {g.gate: g.reason for g in r.gates} for r in out}


def test_gates(spark):
    long_ = "the acceleration of the body which moves along the straight track with value "
    got, why = verdicts(
        spark,
        draft(0), draft(1, stem="The acceleration of the body is high"), draft(2, stem="According to the passage, what is said?"), draft(3, stem="Which learning objective is this one for?"),
        draft(4, others=("5 metres  PER second squared",) * 3), draft(5, right=""), draft(6, stem="What is wrong with กขabcคง here?"), draft(7, right="5 m" + " long" * 30),
        draft(8, quote="too short"), draft(9, quote="“acts on a mass of  two kilograms”"), draft(10, chunk="p2-c2"), draft(11, chunk="gone"),
        draft(12, calc=("10/2", 5.0, "")), draft(13, calc=("10/2", 6.0, "")), draft(14, calc=("10/0", 5.0, "")), draft(15, calc=("10/4", 2.5, "")), draft(16, calc=("10/2", 5.0, "m/s^2")), draft(17, calc=("10/2", 5.0, "??"), right="5 m/s² or so"), draft(18, calc=("10/2", 5.0, "m/s²"), right="5 m/s² or so"),
        draft(19, right="What is the acceleration of the body in this exp"), draft(20, right=long_ + "5", others=(long_ + "6", long_ + "7", long_ + "8")),
    )
    assert all(got[0].values()) and all(got[9].values()) and all(got[12].values())
    for i, part in ((1, "asks nothing"), (2, "unseen"), (3, "teaching"), (4, "the same"), (5, "empty"), (6, "unreadable"), (7, "parallel"), (19, "repeats the stem"), (20, "restates the question")):
        assert not got[i]["well_formed"] and part in why[i]["well_formed"], (i, why[i])
    assert not got[8]["quote_verbatim"] and not got[10]["source_role"] and not got[11]["quote_verbatim"]
    assert [got[i]["arithmetic"] for i in (13, 14, 15)] == [False] * 3 and [got[i]["unit_check"] for i in (16, 17, 18)] == [False, False, True]


def test_report_and_acceptance(spark):
    rows = [draft(0), draft(1, stem="What is the acceleration of the body in this experiment ?"), draft(2, stem="How large is the mass of the trolley used?"), draft(3, quote="nothing like this is there")]
    out = gates.full_report(spark.createDataFrame(rows, DRAFT), chunks(spark), ["doc_id", "run_id"])
    assert {r.draft_ord: r.passed for r in out.collect()} == {0: True, 1: False, 2: True, 3: False}
    assert report.pass_rate(out).first().pass_rate == 0.5
    fails = {r.gate: r.n for r in report.failures_by_gate(gates.gate_rows(out, ["run_id", "draft_ord"])).collect()}
    assert fails == {"quote_verbatim": 1, "not_a_duplicate": 1}


def test_rounds_equal_a_scan(spark):
    rng = random.Random(5)
    nodes, pairs, want = [], [], {}
    for g in range(25):
        n = rng.randint(1, 25)
        near = {(a, b) for b in range(n) for a in range(b) if rng.random() < 0.15}
        nodes += [(g, i) for i in range(n)]
        pairs += [(g, a, b) for a, b in near]
        kept = set()
        for i in range(n):
            want[g, i] = not any((a, i) in near for a in kept)
            kept |= {i} if want[g, i] else set()
    got = gates.accept_first(spark.createDataFrame(nodes, "g int, draft_ord int"), spark.createDataFrame(pairs, "g int, a int, b int"), ["g"])
    assert {(r.g, r.draft_ord): r.accepted for r in got.collect()} == want


def test_advisory(spark):
    d = spark.createDataFrame([draft(0), draft(1)], DRAFT)
    blind = spark.createDataFrame([("r", 0, True)], "run_id string, draft_ord int, interpretable boolean")
    kind = "run_id string, draft_ord int, best_index int, also_defensible array<int>, choice_verdicts array<struct<index:int,status:string,reason:string>>, dependency string, evidence array<string>"
    ok = [(i, "supported" if i == 0 else "unsupported", "") for i in range(4)]
    src = spark.createDataFrame([("r", 0, 0, [0], ok, "specific", ["two kilograms"]), ("r", 1, 0, [2], ok[:3], "specific", ["absent words"])], kind)
    got = {r.draft_ord: (r.answerable_blind, r.source_specific, r.single_defensible) for r in gates.advisory(d, chunks(spark), blind, src, ["run_id", "draft_ord"]).collect()}
    assert got == {0: (True, True, True), 1: (False, False, False)}


def test_budget(spark):
    rows = [("r", v, i, p) for v, ps in enumerate([[1, 1, 1], [0], [1, 1, 1], [1]]) for i, p in enumerate(ps)]
    df = spark.createDataFrame([(r, v, i, bool(p)) for r, v, i, p in rows], "run_id string, visit int, i int, passed boolean")
    assert {r.visit for r in gates.within_budget(df, ["run_id"], 5).collect()} == {0, 1, 2}
    assert {r.visit for r in gates.within_budget(df, ["run_id"], 5, visits=2).collect()} == {0, 1}


def test_quotes_anywhere(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c") for _ in range(200)) for _ in range(30)]
    quotes = [texts[i % 30][s : s + n] for i, (s, n) in enumerate((rng.randint(0, 150), rng.randint(1, 50)) for _ in range(60))] + ["zzz"]
    q, t = spark.createDataFrame(list(enumerate(quotes)), "item_id int, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    squeeze = lambda x: "".join(x.split())
    want = {(i, j) for i, a in enumerate(quotes) for j, b in enumerate(texts) if squeeze(a) and squeeze(a) in squeeze(b)}
    assert {tuple(r) for r in provenance.quotes_anywhere(q, t).collect()} == want


def test_ranking_and_pools(spark):
    c = spark.createDataFrame([("L", 0, [0.0, 1.0]), ("L", 1, [1.0, 0.0]), ("L", 2, None), ("L", 3, [1.0, 0.0])], "lesson_id string, chunk_ord int, vector array<float>")
    q = spark.createDataFrame([("L", [1.0, 0.0])], "lesson_id string, vector array<float>")
    assert [r.chunk_ord for r in rank.by_relevance(c, q).orderBy("rank").collect()] == [1, 3, 0, 2]
    assert {(r.chunk_id, r.priority) for r in rank.pool(chunks(spark), "L01").collect()} == {("p1-c0", 0), ("p1-c1", 1), ("p2-c2", 1)}
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    rows = [(2 * i + k, [x + k * 0.02 * rng.gauss(0, 1) for x in v]) for i, v in enumerate(base) for k in (0, 1)]
    got = {(r.a, r.b) for r in rank.near_vectors_blocked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(40)}
    grouped = spark.createDataFrame([(1, *r) for r in rows], "g int, vec_id long, embedding array<double>")
    assert {(r.a, r.b) for r in rank.near_vectors(grouped, "g").collect()} == got


def test_reports(spark):
    ev = spark.sql("SELECT 'a' AS label, timestamp '2024-01-01 00:00:00' AS start_ts, timestamp '2024-01-01 00:00:00.08' AS end_ts, 1L AS load_ms, 2L AS prompt_ms, 77L AS eval_ms, 3L AS prompt_tokens, 4L AS eval_tokens UNION ALL SELECT 'b', timestamp '2024-01-01 00:00:00.02', timestamp '2024-01-01 00:00:00.1', 1L, 2L, 77L, 3L, 4L")
    s = {r.label: r for r in report.call_stats(ev).collect()}
    assert abs(s["a"].share - 0.8) < 1e-9 and abs(s["b"].share - 0.8) < 1e-9 and s[None].calls == 2
    rows = [("r", i, False, "s" * 400, [("c" * 300, True)], [("well_formed", False, "w" * 300)]) for i in range(6)]
    mem = report.rejection_memory(spark.createDataFrame(rows, f"run_id string, draft_ord int, passed boolean, stem string, choices {CHOICES}, gates array<struct<gate:string,pass:boolean,reason:string>>")).collect()
    assert sorted(r.draft_ord for r in mem) == [2, 3, 4, 5] and len(mem[0].stem) == 240 and len(mem[0].choices[0]) == 180
    labels = spark.createDataFrame([("ours", "Good ")] * 9 + [("ours", "trivial")] * 2 + [("x", "good")] * 5 + [("y", "good")] * 4, "source string, label string")
    v = report.label_verdict(labels).first()
    assert (v.verdict, v.worst_gap, v.worst_label) == ("PASS", 4, "trivial")
    assert {r["label"]: (r.ours, r.x) for r in report.label_matrix(labels, ["ours", "x", "y"]).collect()} == {"good": (9, 5), "trivial": (2, 0)}
    qv = spark.createDataFrame([("a", 0, 4), ("a", 1, 2), ("b", 0, 4), ("b", 0, 4), ("c", 0, 5)], "set_id string, question_index int, score int")
    sizes = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 1)], "set_id string, n_questions int")
    assert {r.set_id: (r.total, r.whole) for r in report.quality_reports(qv, sizes).collect()} == {"a": (6, True), "b": (8, False), "c": (5, False), "d": (0, False)}


def test_blind_sheet(spark):
    q = spark.createDataFrame([(s, i, f" stem  {i}", ["a", "b", "c", "d"], "A") for s in ("ours", "x") for i in range(6)], "source string, ordinal int, stem string, choices array<string>, correct string")
    one, key = report.blind_sheet(q, 7)
    two, key2 = report.blind_sheet(q.repartition(5), 7)
    order = lambda k: {r.id: (r.source, r.original_index) for r in k.collect()}
    assert order(key) == order(key2) and len(order(key)) == 12 and "source" not in one.columns and sorted(order(key)) == [f"Q{i:02d}" for i in range(1, 13)]
    filled = one.withColumn("label", F.when(F.col("id") == "Q01", "odd").when(F.col("id") == "Q02", "").otherwise("GOOD")).filter("id <> 'Q03'")
    assert {r.id: r.problem for r in report.sheet_problems(filled, key).collect()} == {"Q01": "unknown label", "Q02": "no label", "Q03": "not on the sheet"}
    side = report.comparison(q, ["ours", "x"]).orderBy("i").collect()
    assert len(side) == 6 and [r.category for r in side] == [0] * 5 + [1]


def test_progress_counts_while_rows_pass(spark):
    rows = spark.createDataFrame([(True,), (False,), (True,)], "passed boolean")
    out, seen = report.progress(rows, "drafts_of_a_test")
    assert out.count() == 3 and seen.get == {"drafts": 3, "accepted": 2}


def test_evidence_limits(spark):
    df = spark.createDataFrame([("a", [1]), ("b", [])], "id string, atoms array<int>")
    assert [r.key for r in decode.violations(df, "atoms", F.col("id")).collect()] == ["b"]


def test_same_stems_are_those_of_all_pairs(spark):
    from itemloom.functions.similarity import shared_run

    assert gates._gram_floor(8, 0.85) == 10
    rng = random.Random(7)
    stems = ["", "what?", "what?", "whatforce"]
    while len(stems) < 120:
        body = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 40)))
        stems += [body, body[rng.randint(0, 4) :], "What is said of " + body, body[: len(body) // 2] + "Z" + body[len(body) // 2 :], body[:-1] + " Q"]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(stems)], "run_id string, draft_ord int, stem string")
    got = sorted((r.a, r.b) for r in gates.same_stems(df, ["run_id"]).collect())
    low = ["".join(s.lower().split()) for s in stems]
    want = [(a, b) for a in range(len(low)) for b in range(a + 1, len(low)) if low[a] and low[b] and shared_run(low[a], low[b]) >= 0.85 * min(len(low[a]), len(low[b]))]
    assert got == want and len(want) > 30


def test_keys_of_vectors_grow_with_their_tables():
    sizes = [rank.sign_tables(n, 0.9) for n in (10, 5_000, 10**6, 10**9)]
    assert sizes[0][1] == sizes[1][1] - 1 == 8
    for tables, bits in sizes:
        assert (1 - 0.8563**bits) ** tables < 1.2e-3
    assert [b for _, b in sizes] == sorted(b for _, b in sizes) and sizes[2][1] == 16


def test_vectors_of_any_length(spark):
    far = [0.0] * 64 + [1.0] * 30
    rows = [(1, far), (2, [x * 3 for x in far]), (3, None), (4, [1.0] * 64 + [0.0] * 30)]
    got = rank.near_vectors_blocked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]
    assert rank.near_vectors_blocked(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_scratch_must_be_shared_on_a_cluster():
    import pytest
    from itemloom.tables import scratch

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        scratch(Session())
