import random

import pytest
from itemloom.functions import numbers, similarity, text
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("expression", "want"), [
    ("sin(30*pi/180)", 0.5), ("sqrt(3^2 + 4^2)", 5), ("abs(-7.5)", 7.5), ("ln(exp(2))", 2), ("-2^2", -4), ("2^3^2", 512), ("1,000*2", 2000), ("2*-3", -6), ("2^-1", 0.5),
    ("3 × 4 ÷ 2", 6), ("- -2", 2), ("2**3", 8), ("(1+2)*3-4/2", 7), ("pow(2, 3)", None), ("answer + 1", None), ("sqrt(-1)", None), ("", None), ("1/0", None), ("2 3", None), ("(2", None),
    ("2)", None), ("2+", None), ("sin 3", None), ("()", None), (None, None), ("exp(1000)", None),
])
def test_arithmetic(expression, want):
    assert numbers.value(expression) == (pytest.approx(want) if want is not None else None)


def test_values_join_back(spark):
    df = spark.createDataFrame([(1, "2*3"), (2, "2*3"), (3, "x"), (4, None)], "id int, expression string")
    assert {r.id: r.value for r in numbers.with_values(df).collect()} == {1: 6.0, 2: 6.0, 3: None, 4: None}
    assert numbers.facts(df).count() == 1


@pytest.mark.parametrize(("choice", "value", "want"), [
    ("1.04 × 10⁵", 103550.0, True), ("1.03 × 10⁵", 103550.0, False), ("there are four", 4.0, True), ("five", 4.0, False), ("184 baht", 84.0, True), ("1,050 N", 1050.0, True), ("12.5", 12.5, True), ("12.6", 12.5, False), ("1.5 x 10^-3", 0.0015, True),
])
def test_mentions(spark, choice, value, want):
    df = spark.createDataFrame([(choice, value)], "c string, v double")
    assert df.select(numbers.mentions(F.col("c"), F.col("v"))).first()[0] is want


def test_units(spark):
    assert [one(spark, u, numbers.plain_unit) for u in ("m/s²", "kg·m/s^2", "%", "**m", "m//s", "")] == ["m/s^2", "kg*m/s^2", None, None, None, ""]
    df = spark.createDataFrame([("5 m/s²", "m/s^2", True), ("5 newtons", "n", True), ("5 kg", "m", False), ("5 N", "kg*m/s^2", True)], "c string, u string, w boolean")
    assert all(r[0] == r.w for r in df.select(numbers.shows_unit(F.col("c"), F.col("u")), "w").collect())


def test_text(spark):
    assert one(spark, "a\r\nb\rc d\n\n\n\ne  \t f", text.normalise_page) == "a\nb\nc d\n\ne f"
    assert one(spark, " a　b\n c ", text.squeeze) == "abc" and one(spark, " a　b\n c ", text.collapse) == "a b c"
    assert one(spark, "“ 'quoted' ”", text.peel_quotes) == "quoted" and one(spark, "\"'`a' ", text.trim_quotes) == "a"
    assert one(spark, "ตรวจสอบ ความรู้ ก่อนเรียน 1", text.source_role) == "prelearning_check" and one(spark, "x", text.source_role) == "core"
    assert one(spark, "abcdef", lambda c: text.excerpt(c, 3)) == "abc…" and one(spark, "Hello, World 2!", text.slug) == "hello-world-2"
    assert one(spark, "- **x** `y`", text.clean_export_line) == "x y" and one(spark, "```json\n{}\n```", text.strip_fences) == "{}"
    md = "# Head\n\n![alt](a.png) [link](b) $x^2$\n\n| a | b |\n|---|---|\n| 1 | 2 |\n<table><tr><td>p</td><td>q</td></tr></table>\n> quote\n* item &amp; more"
    assert one(spark, md, text.plain_markdown) == "Head\n\nalt link $x^2$\n\na b\n\n1 2\np q\n\nquote\nitem & more"


def test_shared_runs(spark):
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in "xy")
        want = max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
        assert similarity.shared_run(a, b) == want and len(similarity.shared_text(a, b)) == want
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 0.0], 0.0), ([0.0], [1.0], 0.0)], "a array<float>, b array<float>, w double")
    assert all(r[0] == pytest.approx(r.w) for r in df.select(similarity.cosine(F.col("a"), F.col("b")), "w").collect())


def test_shortest_form(spark):
    from itemloom.functions.numbers import mentions, shortest

    want = {1.99999999: "1.99999999", 10.0: "10", 0.5: "0.5", -2.25: "-2.25", 12345678.0: "12345678", 0.0: "0", 1e30: "1E30", 1e-7: "0.0000001"}
    df = spark.createDataFrame([(v,) for v in want], "v double")
    assert {r.v: r.s for r in df.select("v", shortest(F.col("v")).alias("s")).collect()} == want
    assert spark.createDataFrame([(1.99999999, "it is 1.99999999")], "v double, c string").select(mentions(F.col("c"), F.col("v")).alias("m")).first().m
    assert spark.createDataFrame([(None, "it is")], "v double, c string").select(mentions(F.col("c"), F.col("v")).alias("m")).first().m is None
