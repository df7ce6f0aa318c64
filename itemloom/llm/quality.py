"""Quality rules: word statistics of a text, and lines that too many documents of a host share (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, n_words, named, without, words_of

#: A line in more distinct documents of one host than this is boilerplate.
MAX_DOCS = 20
#: A document is depleted if the lines left hold less than this share of its words.
MIN_LEFT = 0.2
#: Up to so many (host, line) pairs, 8 bytes each, the removed lines are broadcast; above, they are joined by shuffle.
BROADCAST_LINES = 200_000
_SLOTS = 64
SYMBOLS = "[#*$%&|<>]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normal_lines(text: Column) -> Column:
    """The lines of a text, lower-cased, white space as single spaces, none at the ends."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(F.lower(one), "\n"), lambda x: F.trim(x))


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null text: no words. A window of three words is known by its 64-bit hash; hashes are sorted with their positions
    within the row, and only windows that meet an equal neighbour are looked at further.
    """
    docs = without(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    h, s, w = named(docs, "h_words", "h_sorted", "h_text")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(_lines(t), _has_word)
    out = docs.withColumn(w, words_of(t))
    out = out.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x))).withColumn("n_words", F.size(w).cast("long")).withColumn("word_chars", F.length(F.array_join(w, "")).cast("long")).drop(w)
    n = F.size(h)
    tri = F.zip_with(F.zip_with(F.slice(F.col(h), 1, n - 2), F.slice(F.col(h), 2, n - 2), lambda a, b: F.xxhash64(a, b)), F.slice(F.col(h), 3, n - 2), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn(s, F.when(n >= 3, tri).otherwise(F.array().cast("array<bigint>"))).drop(h)
    at = F.sort_array(F.transform(F.col(s), lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(s)) < F.size(s), at))
    m = F.size(s)
    pairs = F.filter(F.zip_with(F.slice(F.col(s), 1, m - 1), F.slice(F.col(s), 2, m - 1), lambda a, b: F.when(a.h == b.h, F.array(a.p, b.p))), lambda x: x.isNotNull())
    touched = F.array_distinct(F.flatten(F.transform(F.flatten(pairs), lambda p: F.array(p, p + 1, p + 2))))
    out = out.withColumns({
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.col(s).isNull(), F.lit(0)).otherwise(F.size(touched)).cast("long"),
    }).drop(s)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def common_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, key: str = "doc_id", document: Column | None = None) -> DataFrame:
    """(host, line): hashes of normalised lines that more than max_docs distinct documents of the host hold.

    Documents are told apart by their key (rows of null key by their text), or by document where it is given: repeated rows
    of a key are one document, copies under keys of their own are several. Each document's lines are made distinct before
    they are counted, and counts are summed per task before the shuffle, so neither a hot host nor a hot line meets in one
    task. A null host is a host; null texts have no lines; an empty table gives none.
    """
    lines = F.array_distinct(F.transform(F.filter(normal_lines(F.col(text)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    doc = F.coalesce(F.col(key).cast("long"), F.xxhash64(text)) if document is None else document
    # What is known of a document is computed before its lines are spread, else it would be computed for each of them.
    each = docs.filter(F.col(text).isNotNull()).select(F.col(host).alias("host"), doc.alias("t"), lines.alias("lines"))
    once = each.select("host", "t", F.explode("lines").alias("line")).distinct()
    return once.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("host", "line")


def quality(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES, key: str = "doc_id", document: Column | None = None) -> DataFrame:
    """docs with the base rules' columns, removed_words, clean_text and kept.

    clean_text is the text without the lines above the limits (null stays null). kept is false if the base rules fail
    or if clean_text holds under min_left of the words. Documents are counted by key, or by document where it is given
    (a hash of the text: copies count once): more than max_docs copies on a host lose the lines they share, and are
    rejected if little else is left. A null host is a host. Repeated rows get the same result and
    are all returned; an empty table gives an empty result; input columns with the names of the added ones are replaced.
    """
    docs = without(base_rules(docs, text), "removed_words", "clean_text", "kept")
    found = cut(common_lines(docs, text, host, max_docs, key, document))
    g, gh, keep = named(docs, "gone_lines", "gone_host", "line_kept")
    keys = F.transform(normal_lines(F.col(text)), lambda x: F.xxhash64(x))
    if found.count() <= broadcast_lines:
        slot = lambda x: (F.pmod(x, F.lit(_SLOTS)) + 1).cast("int")
        per = found.groupBy("host").agg(F.collect_list("line").alias(g))
        per = per.select(F.col("host").alias(gh), F.transform(F.sequence(F.lit(1), F.lit(_SLOTS)), lambda k: F.filter(F.col(g), lambda x: slot(x) == k)).alias(g))
        out = docs.join(F.broadcast(per), F.col(host).eqNullSafe(F.col(gh)), "left").drop(gh)
        flags = F.transform(keys, lambda x: ~F.array_contains(F.element_at(F.col(g), slot(x)), x))
    else:
        # A document's removed lines are joined back by its text's hash, so that no row needs an id of its own.
        k, kh = named(docs, "gone_text", "gone_key")
        each = docs.filter(F.col(text).isNotNull()).select(F.col(host).alias(kh), F.xxhash64(text).alias(k), F.array_distinct(keys).alias("lines")).select(kh, k, F.explode("lines").alias("line")).distinct()
        hit = each.join(found, each[kh].eqNullSafe(found["host"]) & (each["line"] == found["line"])).groupBy(kh, k).agg(F.collect_list(found["line"]).alias(g))
        out = docs.join(hit, F.col(host).eqNullSafe(F.col(kh)) & (F.xxhash64(text) == F.col(k)), "left").drop(k, kh)
        flags = F.transform(keys, lambda x: ~F.array_contains(F.col(g), x))
    out = out.withColumn(keep, F.when(F.col(g).isNotNull() & F.col(text).isNotNull(), flags)).drop(g)
    some = F.exists(keep, lambda x: ~x)
    lines = _lines(F.col(text))
    clean = F.array_join(F.filter(lines, lambda x, i: F.element_at(F.col(keep), i + 1)), "\n")
    gone = F.aggregate(F.filter(lines, lambda x, i: ~F.element_at(F.col(keep), i + 1)), F.lit(0).cast("long"), lambda a, x: a + n_words(x))
    out = out.withColumns({"clean_text": F.when(some, clean).otherwise(F.col(text)), "removed_words": F.when(some, gone).otherwise(F.lit(0).cast("long"))}).drop(keep)
    left = F.col("n_words") - F.col("removed_words") >= F.lit(min_left) * F.col("n_words")
    # A filter on kept must not be pushed below the columns it is made of: they would be computed for it once more, with
    # every use of an inner column apart. An id that is not deterministic holds it back.
    (row,) = named(out, "row_number_here")
    out = out.withColumn(row, F.monotonically_increasing_id())
    return out.withColumn("kept", ~F.col("base_failed") & left & (F.col(row) >= 0)).drop(row)
