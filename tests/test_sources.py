from itemloom.sources import bundle, catalog, mcq, runs
from pyspark.sql import functions as F


def parse(spark, text):
    lines = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(text.split("\n"))], "path string, lineno int, raw string")
    good, bad = mcq.parse(lines)
    return [(r.stem, r.choices, r.correct) for r in good.orderBy("ordinal").collect()], [r.reason for r in bad.orderBy("lineno").collect()]


def test_export_lists(spark):
    abcd = "A. one\nB) two\n(C) three\nD: four"
    assert parse(spark, f"**1. What is it?**\n\n{abcd}\nAnswer: B\n\n2) And\nthis one?\n{abcd}") == ([("What is it?", ["one", "two", "three", "four"], 1), ("And this one?", ["one", "two", "three", "four"], None)], [])
    assert parse(spark, "ข้อ 1. อะไร\nก. หนึ่ง\nข. สอง\nค. สาม\nง. สี่\nเฉลย: ค") == ([("อะไร", ["หนึ่ง", "สอง", "สาม", "สี่"], 2)], [])
    assert parse(spark, "1. Which? A. x B. y C. z D. w Answer: D") == ([("Which?", ["x", "y", "z", "w"], 3)], [])
    assert parse(spark, f"Question 1\nWhat now?\n{abcd}\nCorrect answer: A\nQuestion 2\nAnd then?\n{abcd}")[0] == [("What now?", ["one", "two", "three", "four"], 0), ("And then?", ["one", "two", "three", "four"], None)]
    assert parse(spark, f"Intro text\n1. What?\n{abcd}")[1] == ["lines before the numbered question"]
    assert parse(spark, f"1. What?\n{abcd}\nAnswer: Z")[1] == ["an answer that is no choice"]
    assert parse(spark, f"1. What?\n{abcd}\nAnswer: A\nAnswer: B")[1] == ["more than one answer line"]
    assert parse(spark, f"{abcd}")[1] == ["options without a question"]
    assert parse(spark, "1. What?\nA. one\nB. two\nC. three")[1] == ["no complete group of four options"]
    assert parse(spark, f"1. What?\n{abcd}\nThanks for reading")[1] == ["lines after the last question"]


def test_bundle(spark, tmp_path):
    (tmp_path / "page-001.md").write_text("one")
    (tmp_path / "page-002.md").write_text("two")
    assert {(r.page, r.text) for r in bundle.read_pages(spark, str(tmp_path)).collect()} == {(1, "one"), (2, "two")}
    files = bundle.hashed_files(spark, str(tmp_path)).withColumn("doc_id", F.lit("d"))
    assert {r.path for r in files.collect()} == {"page-001.md", "page-002.md"}
    m = spark.createDataFrame([("d", [(1, "page-001.md", ""), (1, "gone.md", ""), (0, "/etc/x", "../y")], [("page-001.md", 1, "img", "00")])], "doc_id string, pages array<struct<page:int,text:string,markdown:string>>, assets array<struct<path:string,page:int,kind:string,sha256:string>>")
    assert {r.rule for r in bundle.audit(m, files).collect()} == {"page below 1", "page twice", "path leaves the bundle", "file is missing", "page is not in the manifest", "other content"}
    assert bundle.page_range("10-40") == (10, 40) and bundle.page_range("7") == (7, 7) and bundle.page_range("")[0] == 1


def test_pages_and_assets(spark):
    pages = spark.createDataFrame([("d", 1, True), ("d", 2, False), ("d", 3, True), ("e", 1, True)], "doc_id string, page int, has_content boolean")
    sections = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "doc_id string, section_ord int, text string")
    good, off = bundle.align_sections(pages, sections)
    assert {(r.page, r.text) for r in good.collect()} == {(1, "a"), (2, ""), (3, "b")} and [r.doc_id for r in off.collect()] == ["e"]
    assert bundle.combine(good, "|").first().text == "a||b"
    assets = spark.createDataFrame([("d", "i.png", 0, "img"), ("d", "j.png", 3, "img"), ("d", "k.png", 0, "img")], "doc_id string, path string, page int, kind string")
    md = spark.createDataFrame([("d", 2, "![x](i.png)"), ("d", 3, "i.png")], "doc_id string, page int, markdown string")
    put = bundle.attribute_assets(assets, md)
    assert {r.path: r.page for r in put.collect()} == {"i.png": 2, "j.png": 3, "k.png": 0}
    made = bundle.build_manifest(good, put).first().pages
    assert [len(p.assets) for p in made] == [0, 1, 1]


def test_runs(spark, tmp_path):
    kind = "run_id string, draft_ord int, stem string, choices array<struct<content:string,is_correct:boolean>>, explanation string, source_quote string, difficulty string, skill string, calculation struct<expression:string,expected:double,unit:string>, chunk_id string, passed boolean, gates array<struct<gate:string,pass:boolean,reason:string>>"
    four = [("a", False), ("b", True), ("c", False), ("d", False)]
    rows = [("r", 0, "s0", four, "", "", "easy", "recall", None, "c", True, []), ("r", 1, "s1", four, "", "", "easy", "recall", None, "c", False, []), ("r", 2, "s2", four[:2], "", "", "easy", "recall", None, "c", True, [])]
    runs.write_runs(spark.createDataFrame(rows, kind), spark.createDataFrame([("r", "L", 5, False)], "run_id string, lesson string, budget int, ceiling boolean"), str(tmp_path / "r"))
    back = runs.read_runs(spark, str(tmp_path / "r"))
    good, bad = runs.questions_for_labels(back)
    assert [(r.stem, r.correct) for r in good.collect()] == [("s0", "B")] and [r.rule for r in bad.collect()] == ["not four choices"]
    sheet = spark.createDataFrame([("Q1", 'st"em, x', "a", "b", "c", "d", "")], "id string, stem string, choice_a string, choice_b string, choice_c string, choice_d string, label string")
    runs.write_sheet(sheet, sheet.select("id"), str(tmp_path / "s"))
    assert runs.read_sheet(spark, str(tmp_path / "s/sheet")).first().stem == 'st"em, x'


def test_catalogue(spark):
    t = {
        "users": spark.createDataFrame([("u1",), ("u2",)], "id string"),
        "courses": spark.createDataFrame([("c1", "C", True, "u1"), ("c2", "D", True, "u2")], "id string, title string, is_public boolean, user_id string"),
        "lessons": spark.createDataFrame([("l1", "L", "c1"), ("l2", "M", "c1")], "id string, title string, course_id string"),
        "exams": spark.createDataFrame([("e1", "E", False, "l1")], "id string, title string, has_taken boolean, lesson_id string"),
        "questions": spark.createDataFrame([("q1", "?", "e1"), ("q2", "?", "e1"), ("q3", "?", "e1")], "id string, content string, exam_id string"),
        "choices": spark.createDataFrame([("x2", "a", True, "q1"), ("x1", "b", True, "q1"), ("x3", "c", False, "q2"), ("x4", "d", True, "q3")], "id string, content string, is_correct boolean, question_id string"),
    }
    tree = {r.id: r.lessons for r in catalog.course_tree(t["courses"], t["lessons"], t["exams"]).collect()}
    assert tree["c2"] == [] and [len(x.exams) for x in tree["c1"]] == [1, 0]
    exam = catalog.exam_questions(t["exams"], t["questions"], t["choices"]).first()
    assert [len(q.choices) for q in exam.questions] == [2, 1, 1] and "is_correct" not in exam.questions[0].choices[0]
    key, none = catalog.answer_key(t["questions"], t["choices"])
    assert {r.question_id: r.choice_id for r in key.collect()} == {"q1": "x1", "q3": "x4"} and [r.question_id for r in none.collect()] == ["q2"]
    assert catalog.with_taken(t["exams"], spark.createDataFrame([("e1",)], "exam_id string")).first().has_taken
    left = catalog.cascade_delete(t, spark.createDataFrame([("u1",)], "id string"))
    assert {k: v.count() for k, v in left.items()} == {"users": 1, "courses": 1, "lessons": 0, "exams": 0, "questions": 0, "choices": 0}
    assert catalog.courses_of(t["courses"], "u2").first().id == "c2"
    assert catalog.orphans(t["choices"].withColumn("question_id", F.lit("zz")), "question_id", t["questions"]).count() == 4
