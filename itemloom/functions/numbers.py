"""Numbers in text: arithmetic of answer keys, mentions of a value, units."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Number words 0 to 20.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)
SUPERSCRIPTS, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-"


def without_thousands(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d),(?=\d{3}(?!\d))", "")


_NAMES = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "sqrt": math.sqrt, "abs": abs, "exp": math.exp, "ln": math.log}
_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[A-Za-z]+|\*\*|[-+*/×÷^()])")
#: Precedence: a sign binds looser than a power and tighter than a product; a power binds to the right.
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "sign": 3, "^": 4}


def value(expression: str | None) -> float | None:
    """The value of an arithmetic expression, or None where it has none (F12). Operators wait on a stack by rank."""
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", expression or "")
    numbers: list[float] = []
    waiting: list[str] = []

    def settle(rank: float) -> None:
        while waiting and _RANK.get(waiting[-1], 0) >= rank:
            op = waiting.pop()
            b = numbers.pop()
            if op == "sign":
                numbers.append(-b)
                continue
            a = numbers.pop()
            numbers.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if op == "/" else math.pow(a, b))

    at, after_value = 0, False
    try:
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                return None
            t, at = m[1], m.end()
            t = {"×": "*", "÷": "/", "**": "^"}.get(t, t)
            if t[0].isdigit() or t[0] == ".":
                if after_value:
                    return None
                numbers.append(float(t))
                after_value = True
            elif t[0].isalpha():
                if after_value:
                    return None
                if t.lower() == "pi":
                    numbers.append(math.pi)
                    after_value = True
                elif t.lower() in _NAMES and text[at:].lstrip().startswith("("):
                    waiting.append(t.lower())
                else:
                    return None
            elif t == "(":
                if after_value:
                    return None
                waiting.append("(")
            elif t == ")":
                if not after_value:
                    return None
                settle(1)
                if not waiting or waiting.pop() != "(":
                    return None
                if waiting and waiting[-1] in _NAMES:
                    numbers.append(float(_NAMES[waiting.pop()](numbers.pop())))
            elif after_value:
                settle(_RANK[t] + (t == "^"))
                waiting.append(t)
                after_value = False
            elif t == "-":
                waiting.append("sign")
            elif t != "+":
                return None
        if not after_value:
            return None
        settle(1)
        out = numbers[0] if len(numbers) == 1 and not waiting else math.nan
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    return out if math.isfinite(out) else None


@F.pandas_udf(DoubleType())
def _values(s: pd.Series) -> pd.Series:
    return s.map(value).astype("float64")


def with_values(rows: DataFrame, expression: str = "expression", out: str = "value") -> DataFrame:
    """rows with the value of each expression (null if it has none): distinct expressions are evaluated once and joined
    back, so a bank that repeats them pays once (R2)."""
    facts = rows.select(F.col(expression).alias("__e")).filter("__e is not null").distinct().withColumn(out, F.nanvl(_values("__e"), F.lit(None)))
    return rows.join(facts, F.col(expression) == F.col("__e"), "left").drop("__e")


def facts(expressions: DataFrame, expression: str = "expression") -> DataFrame:
    """Distinct supplied expressions that evaluate, by chunk and first place."""
    keep = [c for c in ("doc_id", "chunk_id") if c in expressions.columns]
    return with_values(expressions.dropDuplicates([*keep, expression]), expression).filter("value is not null")


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b))
    return (a == b) | (F.abs(a - b) / F.nullif(scale, F.lit(0.0)) < tolerance)


def plain_scientific(c: Column) -> Column:
    """1.04 × 10⁵ and the like as 1.04e5."""
    c = F.translate(c, SUPERSCRIPTS, PLAIN)
    c = F.regexp_replace(c, r"(?<=\d),(?=\d{3}(?!\d))", "")
    return F.regexp_replace(c, r"([-+]?(?:\d+(?:\.\d*)?|\.\d+))\s*[×xX·*]\s*10\s*(?:\^\s*)?\+?(-?)0*(\d+)", "$1e$2$3")


def _fixed(v: Column, digits: int) -> Column:
    s = F.format_string(f"%.{digits}f", v)
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "") if digits else s


def _scientific(v: Column, digits: int) -> Column:
    s = F.format_string(f"%.{digits}e", v)
    return F.regexp_replace(F.regexp_replace(s, r"e\+?(-?)0*(\d+)$", "e$1$2"), r"\+", "")


def shortest(v: Column) -> Column:
    """A value by the fewest digits that give it back, without an exponent where 18 places on either side will do."""
    wide = v.try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(wide.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exact = plain.try_cast("double") == v
    return F.coalesce(F.when(exact, plain), F.regexp_replace(v.cast("string"), r"\.0(?=E|$)", ""))


def mentions(choice: Column, v: Column) -> Column:
    """Whether a choice shows a value: in full, in one of several roundings, in scientific notation, or as a word for 0 to 20
    (F11; all as substrings, G10). Null without a value."""
    bare = F.regexp_replace(choice, ",", "")
    sci = plain_scientific(choice)
    forms = [shortest(v), *[_fixed(v, d) for d in (6, 4, 3, 2, 1, 0)]]
    powers = [_scientific(v, d) for d in range(5)]
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    whole = v.between(0, 20) & (F.abs(v - F.round(v)) < 1e-9)
    said = F.when(whole, F.contains(F.lower(choice), F.element_at(words, F.least(F.greatest(F.round(v), F.lit(0)), F.lit(20)).cast("int") + 1)))
    out = F.coalesce(said, F.lit(False))
    for f in forms:
        out = out | F.contains(bare, f)
    for p in powers:
        out = out | F.contains(bare, p) | F.contains(sci, p)
    return F.when(v.isNotNull(), out)


def symbolic(choice: Column) -> Column:
    return choice.rlike(r"[\^/]") & choice.rlike(r"\p{L}")


def _unit_text(c: Column) -> Column:
    c = F.lower(c)
    for a, b in (("²", "^2"), ("³", "^3"), ("·", "*"), ("×", "*"), (" ", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain_unit(unit: Column) -> Column:
    """A unit in plain signs; null if it has others or loose operators."""
    u = F.replace(_unit_text(F.trim(unit)), F.lit("⁻"), F.lit("-"))
    return F.when(u.rlike(r"^[a-z0-9*/^.-]*$") & ~u.rlike(r"^\*|\*$|\*\*|//"), u)


def shows_unit(choice: Column, unit: Column) -> Column:
    """Whether a choice carries a unit (G11: newtons by the letter n)."""
    c = _unit_text(choice)
    named = F.when(unit == "n", F.contains(c, F.lit("newton"))).when(unit == "kg*m/s^2", F.contains(c, F.lit("n"))).when(unit == "m/s^2", F.contains(c, F.lit("m*s^-2")))
    return F.contains(c, unit) | F.coalesce(named, F.lit(False))


def worth_calculating(c: Column) -> Column:
    """Three numbers or more, of which one has a point or three significant digits (P10)."""
    found = F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    rich = F.exists(found, lambda x: x.contains(".") | (F.length(F.regexp_replace(x, "^0+|0+$", "")) >= 3))
    return (F.size(found) >= 3) & rich
