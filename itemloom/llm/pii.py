"""Personal data: regular expressions propose spans, checksums confirm, context words adjust (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, part_of, running, text_blocks, without

#: Kinds in the order of the digest. The first four are kept whenever their check passes; the others need THRESHOLD.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.7
#: Context words within NEAR characters before a span raise its score.
NEAR = 40
CONTEXT = {
    "email": "e-?mail|contact|write to",
    "ip": "ip|address|host|server",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security|tax id",
}
#: Score of a span whose check passes, before context.
START = {"email": 0.9, "ip": 0.75, "card": 0.9, "phone": 0.75, "iban": 0.9, "ssn": 0.5}
BONUS = 0.25

# Each pattern is linear on long runs: possessive, and a match may begin only where a run begins or the last match ended.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Texts without this cannot hold the kind; it is cheaper than the pattern.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), mod97(m)).otherwise(False)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """array<struct<m, g>>: all matches and the gap before each."""
    found = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    return F.arrays_zip(found.alias("m"), F.slice(F.split(text, PATTERN[kind], -1), 1, F.size(found)).alias("g"))


def _placed(found: Column, kind: str) -> Column:
    """array<struct<kind, start, end, hit, before>>: a match's end is the sum of gaps and matches up to it."""
    ends = running(F.transform(found, lambda x: F.length(x["g"]) + F.length(x["m"])))
    span = lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("hit"), F.right(x["g"], F.lit(NEAR)).alias("before"))
    return F.zip_with(found, ends, span)


def find_spans(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with spans: array<struct<kind, start, end, score>>, ordered by kind as in KINDS, then start.

    Code points, end exclusive. Null or empty text: no spans. Matches of a kind don't overlap; kinds may. A match that
    fails its check is dropped. A base kind keeps its span whatever the score; an added kind needs the threshold,
    which for ssn takes a context word. An input column spans is replaced; an empty table gives an empty result.
    """
    docs = without(docs, "spans")
    t = F.coalesce(F.col(text), F.lit(""))
    parts = dict(zip(KINDS, named(docs, *[f"pii_{k}" for k in KINDS]), strict=True))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    out = docs.withColumns({c: F.when(t.rlike(HINT[k]), _found(t, k)) for k, c in parts.items()})
    out = out.withColumns({c: F.when(F.size(c) > 0, _placed(F.col(c), k)) for k, c in parts.items()})

    def scored(kind: str, c: str) -> Column:
        near = lambda x: F.lower(x["before"]).rlike(rf"(?:^|[^a-z])(?:{CONTEXT[kind]})(?:[^a-z]|$)")
        score = lambda x: F.least(F.lit(1.0), F.lit(START[kind]) + F.when(near(x), BONUS).otherwise(0.0))
        good = F.filter(F.col(c), lambda x: _passes(kind, x["hit"]))
        spans = F.transform(good, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
        return F.coalesce(spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= threshold), none)

    return out.withColumn("spans", F.concat(*[scored(k, c) for k, c in parts.items()])).drop(*parts.values())


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (with spans) whose text has [KIND] in place of each span; overlapping spans are one, named by
    the first (then longest).

    Null text stays null, a null array of spans counts as none; an empty table gives an empty result.
    """
    o, e, b = named(docs, "rd_spans", "rd_ends", "rd_blocks")
    order = F.array_sort(F.transform(F.col("spans"), lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x["kind"].alias("k"))))
    out = docs.withColumn(o, F.when(F.size("spans") > 0, order))
    # How far the spans up to each reach; a span that begins before that is part of the one before.
    out = out.withColumn(e, running(F.transform(F.col(o), lambda x: -x["e"]), F.greatest)).withColumn(b, F.when(F.col(o).isNotNull(), text_blocks(F.col(text))))
    reach = lambda i: F.coalesce(F.get(F.col(e), i - 1), F.lit(0))
    put = F.transform(F.col(o), lambda x, i: F.when(x["s"] >= reach(i), F.concat(part_of(F.col(b), reach(i), x["s"]), F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise(F.lit("")))
    masked = F.concat(F.array_join(put, ""), part_of(F.col(b), F.element_at(e, -1), F.length(text)))
    return out.withColumn(text, F.when(F.col(o).isNull(), F.col(text)).otherwise(masked)).drop(o, e, b)
