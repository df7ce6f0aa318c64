"""Column expressions on text. Lengths and offsets are code points; white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings of sections whose statements are no evidence.
PRELEARNING_HEADINGS = ("ตรวจสอบความรู้ก่อนเรียน",)


def squeeze(c: Column) -> Column:
    """All white space gone (F2)."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends (F2)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_page(c: Column) -> Column:
    """Line ends as LF, no-break spaces as spaces, at most one blank line, runs of spaces and tabs as one space (F1)."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, " ", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, "[ \t]+", " ")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def peel_quotes(c: Column, depth: int = 4) -> Column:
    """Without wrapping quote marks, pair by pair, up to a nesting of depth (gates; F3)."""
    c = trimmed(c)
    for _ in range(depth):
        c = F.regexp_replace(c, r"(?Us)^[\"'“”‘’«»「」]\s*(.*?)\s*[\"'“”‘’«»「」]$", "$1")
    return c


def trim_quotes(c: Column) -> Column:
    """Without any quote marks or white space at the ends (provenance; F3)."""
    return F.regexp_replace(c, "^[ \t\r\n\"'“”‘’`]+|[ \t\r\n\"'“”‘’`]+$", "")


def source_role(c: Column, headings: tuple[str, ...] = PRELEARNING_HEADINGS) -> Column:
    """prelearning_check if a heading phrase stands in the text, spaces ignored; else core."""
    tight = squeeze(c)
    hit = F.lit(False)
    for h in headings:
        hit = hit | tight.contains(h)
    return F.when(hit, "prelearning_check").otherwise("core")


def concept_key(c: Column) -> Column:
    return F.lower(collapse(c))


def has_digit(c: Column) -> Column:
    """A decimal digit of any script (F8)."""
    return c.rlike(r"\p{Nd}")


def excerpt(c: Column, n: int) -> Column:
    """At most n code points, then an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def clip(c: Column, n: int) -> Column:
    """White space collapsed, then at most n code points and an ellipsis."""
    return excerpt(collapse(c), n)


def quote_floor(c: Column) -> Column:
    """The least length of a quote: equal for prose and for quotes with two digits or more."""
    return F.when(F.regexp_count(c, F.lit("[0-9]")) >= 2, 12).otherwise(12)


def found_in(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text, white space ignored (Q3)."""
    return F.contains(squeeze(text), squeeze(quote))


#: How Markdown and HTML become plain text, in order: pattern and replacement.
PLAIN_RULES = (
    ("\r\n?", "\n"),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<img\b[^>]*?\balt\s*=\s*[\"']([^\"']*)[\"'][^>]*>", "$1"),
    (r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|table|ul|ol|section|article|title)\s*>", "\n"),
    (r"(?i)</t[dh]\s*>", " "),
    (r"<[^>]*>", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", ""),
    (r"(?m)^[ \t]*(?:`{3,}|~{3,}).*$", ""),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*(?:>[ \t]?)+", ""),
    (r"(?m)^[ \t]*[-*+•][ \t]+", ""),
    (r"\*\*|__|`", ""),
    (r"[ \t]*\|[ \t]*", " "),
    ("&nbsp;| ", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;|&apos;", "'"),
    ("&amp;", "&"),
    ("[ \t]+", " "),
    (r"(?m)^ +| +$", ""),
    ("\n{3,}", "\n\n"),
)


def plain_markdown(c: Column) -> Column:
    """Markdown or HTML as plain text: keeps equations, link texts and alternative texts; drops tags, table rules and
    markers; cells are set apart by spaces (F7)."""
    for pattern, to in PLAIN_RULES:
        c = F.regexp_replace(c, pattern, to)
    return trimmed(c)


# Characters that an exported line may hold besides its words.
NO_BREAK, INVISIBLE = "\u00a0", "\u200b\u200c\u200d\ufeff"
BULLETS = "*+•‣●○·-"
_LEADING = rf"(?U)^(?:[>\s]|[{BULLETS}](?=\s))+"


def clean_export_line(c: Column) -> Column:
    """A line of an exported question list without Markdown marks; words stay as they are (F23): any run of quote and
    bullet marks before them goes, marks of emphasis and code go, and so does a star at both ends."""
    words = F.regexp_replace(F.translate(c, NO_BREAK + INVISIBLE, " "), _LEADING, "")
    words = collapse(F.regexp_replace(words, "`|[*]{2}|_{2}", ""))
    starred = words.startswith("*") & words.endswith("*") & (F.length(words) > 2)
    return F.when(starred, F.substring(words, F.lit(2), F.length(words) - 2)).otherwise(words)


def strip_fences(c: Column) -> Column:
    """Model output without the code fence around it."""
    return F.regexp_replace(c, r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", "")


def slug(c: Column, n: int = 40) -> Column:
    """ASCII letters and digits, spaces as dashes."""
    c = F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9 -]", ""), "[ -]+", "-")
    return F.substring(F.regexp_replace(c, "^-|-$", ""), 1, n)


def run_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of run settings joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def is_uuid(c: Column) -> Column:
    return c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
