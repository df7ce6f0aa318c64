"""Quality gates on drafted questions, and acceptance: first come, first kept, in rounds of joins."""

from __future__ import annotations

import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mentions, nearly_equal, plain_unit, shows_unit, symbolic, with_values
from ..functions.similarity import choice_runs, cosine, shared_run_length
from ..functions.text import collapse, excerpt, found_in, peel_quotes, quote_floor, source_role, squeeze, trimmed
from ..tables import cut, parts_for

# Words that make a stem a question.
QUESTION_WORDS = (
    "อะไร", "ใด", "ไหน", "ทำไม", "อย่างไร", "เท่าใด", "เท่าไร", "กี่", "เพราะเหตุใด", "ข้อใด",
    "what", "which", "how", "why", "when", "who", "where", "calculate", "find the",
    "simplify", "solve", "evaluate", "convert", "write the answer", "determine", "reduce",
)
# Phrases that point at material the reader cannot see.
UNSEEN_PHRASES = (
    "ตามข้อความในหนังสือ", "ในข้อความต้นฉบับ", "ตามข้อความข้างต้น", "จากข้อความข้างต้น",
    "ตามเนื้อหาข้างต้น", "ในเนื้อหาข้างต้น", "ตามที่กล่าวไว้ข้างต้น", "ในบทความนี้",
    "according to the passage", "in the passage above", "in the text above",
    "the passage states", "as mentioned in the text", "based on the passage",
    "from the text above", "according to the text",
    "in the passage", "in this passage", "the passage describes",
    "described in the text", "in the given text", "mentioned above",
)
# Phrases about teaching instead of the subject.
TEACHING_PHRASES = (
    "จุดประสงค์การเรียนรู้", "แนวการวัดและประเมินผล", "การประเมินด้านความรู้",
    "ประเมินจากอะไร", "กิจกรรมและแบบทดสอบ", "การศึกษาวีดิทัศน์",
    "learning objective", "assessment guideline", "assessment criteria",
    "teaching activity", "video and discussion",
)
SANDWICH = r"[฀-๿][\p{L}&&[\u0000-ɏ]]{2,}[฀-๿]"
MIN_STEM, MAX_SKEW, STEM_SHARE, CHOICE_SHARE, ECHO = 15, 2.5, 0.6, 40, 20
SAME_TEXT, SAME_VECTOR = 0.85, 0.90
GATES = ("well_formed", "source_role", "quote_verbatim", "arithmetic", "unit_check", "coverage_contract", "not_a_duplicate")


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """The first phrase that stands in a lower-cased text; null if none does."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p.lower())), F.lit(p)) for p in phrases])


def holds(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases stands in a lower-cased text: one pattern that looks on only where one of them may begin."""
    by: dict[str, list[str]] = {}
    for p in sorted({x.lower() for x in phrases}):
        by.setdefault(p[0], []).append(re.escape(p[1:]))
    return text.rlike(f"(?=[{''.join(map(re.escape, by))}])(?:{'|'.join(f'{re.escape(k)}(?:{"|".join(v)})' for k, v in by.items())})")


def stem_fault(s: Column, low: Column, words=QUESTION_WORDS, unseen=UNSEEN_PHRASES, teaching=TEACHING_PHRASES) -> Column:
    """The kind of a stem's problem (as stem_problem), of its trimmed and its lower-cased text. Both should be columns:
    an expression would be computed for each phrase."""
    asks = s.rlike("[?？]$") | holds(low, words)
    return F.when(F.length(s) < MIN_STEM, "short").when(~asks, "asks nothing").when(holds(low, unseen), "unseen").when(holds(low, teaching), "teaching")


def stem_problem(stem: Column, words=QUESTION_WORDS, unseen=UNSEEN_PHRASES, teaching=TEACHING_PHRASES) -> Column:
    """Why a stem is no good question (Q1a to Q1c); null if it is. Phrase lists are parameters."""
    s, low = trimmed(stem), F.lower(stem)
    return F.coalesce(
        F.when(F.length(s) < MIN_STEM, F.concat(F.lit("stem is only "), F.length(s).cast("string"), F.lit(" characters"))),
        F.when(~s.rlike("[?？]$") & any_of(low, words).isNull(), F.concat(F.lit("stem asks nothing: "), excerpt(s, 80))),
        F.concat(F.lit("stem points at unseen material: "), any_of(low, unseen)),
        F.concat(F.lit("stem asks about teaching: "), any_of(low, teaching)),
    )


def correct_index(choices: Column) -> Column:
    """From 0; -1 unless exactly one choice is correct (F16)."""
    return F.when(F.size(F.filter(choices, lambda c: c["is_correct"])) == 1, F.array_position(F.transform(choices, lambda c: c["is_correct"]), True).cast("int") - 1).otherwise(-1)


def _choice_problem() -> Column:
    texts = F.transform("choices", lambda c: F.coalesce(c["content"], F.lit("")))
    bad = lambda t: t.contains("�") | t.rlike(SANDWICH)
    folded = F.transform(texts, lambda t: squeeze(F.lower(t)))
    sizes = F.transform(texts, lambda t: F.length(trimmed(t)))
    return F.coalesce(
        F.when(F.coalesce(F.size("choices"), F.lit(0)) < 2, "fewer than two choices"),
        F.when(F.exists(texts, lambda t: trimmed(t) == ""), "a choice is empty"),
        F.when(correct_index(F.col("choices")) < 0, "not exactly one choice is correct"),
        F.when(bad(F.col("stem")) | F.exists(texts, bad), "unreadable characters"),
        F.when(F.size(F.array_distinct(folded)) < F.size(folded), "two choices are the same"),
    ), F.when((F.array_max(sizes) >= 25) & (F.array_max(sizes) / F.array_min(sizes) > MAX_SKEW), "choices are not parallel")


def well_formed(drafts: DataFrame) -> DataFrame:
    """drafts with malformed: the first reason of Q1, or null. Runs shared with the stem are only measured for drafts that
    pass the checks before: a Python function in a coalesce would run for all."""
    early, skew = _choice_problem()
    out = drafts.withColumn("early", F.coalesce(stem_problem(F.col("stem")), early))
    stem = squeeze(F.lower("stem"))
    folded = F.transform("choices", lambda c: squeeze(F.lower(c["content"])))
    ok = F.col("early").isNull()
    # Runs are measured where one can be as long as a check asks for.
    n = F.length(stem)
    may_echo = F.exists(folded, lambda c: F.length(c) >= STEM_SHARE * n)
    may_restate = (F.size("choices") >= 3) & (n >= 30) & F.forall(folded, lambda c: F.length(c) >= ECHO)
    may_repeat = (F.size("choices") >= 3) & F.forall("choices", lambda c: F.length(trimmed(c["content"])) >= CHOICE_SHARE)
    out = out.withColumn("asked", ok & F.coalesce(may_echo | may_restate | may_repeat, F.lit(True)))
    out = out.withColumn("runs", choice_runs(F.when(F.col("asked"), stem), F.when(F.col("asked"), folded)))
    each, shared = F.slice("runs", 1, F.size("runs") - 1), F.element_at("runs", -1)
    echo = F.exists(each, lambda r: r >= STEM_SHARE * F.length(stem))
    all_echo = (F.size("choices") >= 3) & (F.length(stem) >= 30) & F.forall(each, lambda r: r >= ECHO)
    long_ = F.forall("choices", lambda c: F.length(trimmed(c["content"])) >= CHOICE_SHARE)
    late = F.coalesce(
        F.when(echo, "a choice repeats the stem"),
        F.when(all_echo, "every choice restates the question"),
        skew,
        F.when((F.size("choices") >= 3) & long_ & (shared >= CHOICE_SHARE), "choices are formulaic"),
    )
    return out.withColumn("malformed", F.coalesce("early", F.when(F.col("asked"), late), F.when(ok, skew))).drop("early", "runs", "asked")


def cheap_gates(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """drafts (doc_id, chunk_id, stem, choices, source_quote, skill, calculation) with gates: an array of (gate, pass,
    reason) for the gates that need no other draft (Q1 to Q5). A missing chunk fails what needs it."""
    rows = well_formed(drafts)
    c = chunks.select("doc_id", "chunk_id", F.col("text").alias("c_text"), F.col("source_role").alias("c_role"))
    rows = rows.join(c, ["doc_id", "chunk_id"], "left")
    rows = with_values(rows.withColumn("expr", F.col("calculation.expression")), "expr", "got")
    role = F.when(F.coalesce("c_role", F.lit("")) == "", source_role(F.col("c_text"))).otherwise(F.col("c_role"))
    quote = peel_quotes(F.coalesce("source_quote", F.lit("")))
    calc, right = F.col("calculation").isNotNull(), F.when(correct_index(F.col("choices")) >= 0, F.get("choices", correct_index(F.col("choices")))["content"])
    shown = mentions(right, F.col("got")) | ((F.col("skill") == "calculation") & symbolic(right))
    unit = F.trim(F.coalesce(F.col("calculation.unit"), F.lit("")))
    why = {
        "well_formed": F.col("malformed"),
        "source_role": F.when(F.col("c_text").isNull(), "the cited chunk is unknown").when(role == "prelearning_check", "the chunk is a pre-learning check"),
        "quote_verbatim": F.when(F.length(collapse(quote)) < quote_floor(quote), "the quote is too short").when(~F.coalesce(found_in(quote, F.col("c_text")), F.lit(False)), "the quote is not in the chunk"),
        "arithmetic": F.when(calc & F.col("got").isNull(), "the expression has no value").when(calc & ~F.coalesce(nearly_equal(F.col("got"), F.col("calculation.expected")), F.lit(False)), "the value is not the expected one").when(calc & right.isNull(), "not exactly one choice is correct").when(calc & ~F.coalesce(shown, F.lit(False)), "the correct choice shows another value"),
        "unit_check": F.when(calc & (unit != ""), F.when(plain_unit(unit).isNull(), "the unit is malformed").when(right.isNull(), "not exactly one choice is correct").when(~F.coalesce(shows_unit(right, plain_unit(unit)), F.lit(False)), "the unit is not in the correct choice")),
    }
    rows = rows.withColumns({f"why_{k}": v for k, v in why.items()})
    gates = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(f"why_{k}").isNull().alias("pass"), F.coalesce(f"why_{k}", F.lit("")).alias("reason")) for k in why])
    return rows.withColumn("gates", gates).drop("malformed", "c_text", "c_role", "expr", "got", *[f"why_{k}" for k in why])


def coverage_gate(drafts: DataFrame, slots: DataFrame, context: DataFrame, keys: tuple[str, ...] = ("doc_id", "lesson_id")) -> DataFrame:
    """drafts with off_contract: the first reason of Q6 that needs no other draft, or null. Slots and atoms used twice are
    conflicts, see conflicts()."""
    k = list(keys)
    s = slots.select(*k, F.col("slot_id").alias("coverage_slot_id"), F.col("atom_id").alias("s_atom"), F.col("source_chunk_ids").alias("s_chunks"), F.lower("skill").alias("s_skill"), F.lower("difficulty").alias("s_level"), F.col("evidence_quote").alias("s_quote"))
    c = context.select(*k, F.col("chunk_id").alias("evidence_chunk_id"), F.lit(True).alias("in_context")).distinct()
    rows = drafts.join(s, [*k, "coverage_slot_id"], "left").join(c, [*k, "evidence_chunk_id"], "left")
    said = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit(""))
    mine, atom = collapse(F.coalesce("source_quote", F.lit(""))), collapse(F.col("s_quote"))
    why = F.coalesce(
        F.when(F.col("s_atom").isNull(), "unknown slot"),
        F.when(F.coalesce("evidence_atom_id", F.lit("")) != F.col("s_atom"), "another atom than the slot's"),
        F.when(~F.coalesce(F.expr("array_contains(s_chunks, evidence_chunk_id)"), F.lit(False)), "the chunk does not support the atom"),
        F.when(F.col("in_context").isNull(), "the chunk is outside the context"),
        F.when((F.col("s_skill") == "calculation") & F.col("calculation").isNull(), "the calculation is missing"),
        F.when((F.col("s_level") != "") & (said("difficulty") != F.col("s_level")), "another difficulty"),
        F.when((F.col("s_skill") != "") & (said("skill") != F.col("s_skill")), "another skill"),
        F.when((F.coalesce("s_quote", F.lit("")) != "") & ~F.contains(mine, atom) & ~F.contains(atom, mine), "the quote does not cover the evidence"),
    )
    return rows.withColumn("off_contract", why).drop("s_atom", "s_chunks", "s_skill", "s_level", "s_quote", "in_context")


#: Stems whose grams a task makes.
STEMS = 5_000


def _gram_floor(gram: int, share: float) -> int:
    """The least length from which on a run of share of a stem always covers gram characters in the stem's middle."""
    short = [n for n in range(1, int(gram / max(2 * share - 1, 0.01)) + 2) if 2 * ceil(share * n) - n < gram]
    return max(short, default=0) + 1


def near_stems(stems: DataFrame, group: list[str], gram: int = 8, share: float = SAME_TEXT) -> DataFrame:
    """(group, a, b): pairs a < b of different stems (group, s) of which a run of share of the shorter one or more is in both
    (Q7). share is above a half.

    Wherever such a run begins, it covers the middle of the shorter stem. So any one gram of that middle stands in the
    longer stem too, and each stem asks for the rarest it has there: a phrase that many stems begin with brings no
    pairs. Exact for stems of _gram_floor() characters or more; shorter ones meet, by each of their characters, stems that
    hold it.
    """
    s = cut(stems.select(*group, "s").filter("s <> ''").distinct())
    s = s.repartition(parts_for(s.sparkSession, s.count(), STEMS))
    least = _gram_floor(gram, share)
    long_ = s.filter(F.length("s") >= least).withColumn("len", F.length("s"))
    at = F.transform(F.sequence(F.lit(1), F.col("len") - gram + 1), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.substring(F.col("s"), i, F.lit(gram))).alias("g")))
    g = long_.select(*group, "s", "len", F.explode(at).alias("x")).select(*group, "s", "len", "x.pos", "x.g")
    # Stems are distinct, so grams that are distinct in each need no exchange to be so.
    held = long_.select(*group, "s", "len", F.explode(F.array_distinct(F.transform(at, lambda x: x["g"]))).alias("g"))
    common = held.groupBy(*group, "g").agg(F.count("*").alias("n")).filter("n > 1")
    run = F.ceil(F.lit(share) * F.col("len"))
    middle = g.filter(F.col("pos").between(F.col("len") - run + 1, run - gram + 1))
    # A gram that no other stem has settles it: its stem is the shorter one of no pair.
    # Texts make grams many times their number, which no estimate sees: none of these tables may go through the driver.
    asked = middle.join(common.hint("merge"), [*group, "g"], "left").groupBy(*group, "s", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "g")).alias("m"))
    asked = asked.filter("m.n > 1").select(*group, F.col("s").alias("x"), F.col("len").alias("xlen"), F.col("m.g").alias("g"))
    ordered = [*group, F.least("s", "x").alias("a"), F.greatest("s", "x").alias("b")]
    # The run that both share holds that middle, so the longer stem holds all of it.
    inside = F.contains("s", F.expr(f"substring(x, CAST(xlen - ceil({share} * xlen) + 1 AS INT), CAST(2 * ceil({share} * xlen) - xlen AS INT))"))
    pairs = asked.join(held.hint("merge"), [*group, "g"]).filter("s <> x AND len >= xlen").filter(inside).select(*ordered)
    # A stem that is too short for a gram shares a run of share of itself, so the character in its middle, with the other.
    few = s.filter(F.length("s") < least).select(*group, F.col("s").alias("x"), F.expr("substring(s, CAST(ceil(length(s) / 2) AS INT), 1)").alias("c"))
    have = s.select(*group, "s", F.explode(F.array_distinct(F.split("s", ""))).alias("c"))
    short = few.join(have.hint("merge"), [*group, "c"]).filter("s <> x AND length(s) >= length(x)").select(*ordered)
    both = pairs.unionByName(short).distinct().withColumn("n", shared_run_length("a", "b"))
    return both.filter(F.col("n") >= share * F.least(F.length("a"), F.length("b"))).select(*group, "a", "b")


#: Pairs of drafts that a task returns, and places to which a block's partners are dealt.
PAIRS, PLACES = 5_000_000, 16


def same_stems(drafts: DataFrame, group: list[str], order: str = "draft_ord", gram: int = 8, share: float = SAME_TEXT, block: int = 2_000) -> DataFrame:
    """(group, a, b): pairs a < b of drafts whose stems are equal or near, white space and case ignored; empty stems have
    none. Near stems are found once for each text; drafts of one text all pair here, so use conflicts() to accept.

    Drafts of a text are dealt into blocks, and pairs of blocks meet: the smaller text's blocks travel as arrays to the
    larger one's. Tables between the steps are small as files and large as rows, so all joins are merged, not broadcast."""
    d = drafts.select(*group, F.col(order).alias("o"), squeeze(F.lower("stem")).alias("s")).filter("s <> ''").distinct()
    # A text is known by its number; its drafts are dealt into blocks, and pairs of blocks meet.
    d = cut(d.withColumn("texts", F.count("*").over(Window.partitionBy(*group, "o"))))
    number = d.groupBy(*group, "s").agg(F.count("*").alias("n"), F.min("o").alias("c")).withColumn("c", F.xxhash64("s", "c")).withColumn("c", F.struct("c", F.xxhash64(F.lit(7), "s").alias("c2")))
    number = cut(number.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    its = F.struct("o", (F.col("texts") > 1).alias("more"))
    blocks = d.join(number.hint("merge"), [*group, "s"]).withColumn("block", F.pmod(F.xxhash64("o"), F.col("blocks")).cast("int"))
    blocks = cut(blocks.groupBy(*group, "c", "block").agg(F.collect_list(its).alias("l")))
    near = near_stems(number.select(*group, "s"), group, gram, share)
    text = lambda c: F.struct(F.col("n").alias("n"), "c", "blocks").alias(c)
    ends = lambda x: number.select(*group, F.col("s").alias(x), text(f"t{x}")).hint("merge")
    near = near.join(ends("a"), [*group, "a"]).join(ends("b"), [*group, "b"]).select(*group, F.least("ta", "tb").alias("x"), F.greatest("ta", "tb").alias("y"))
    met = cut(near.unionByName(number.select(*group, text("x"), text("y"))))
    n = parts_for(met.sparkSession, met.agg(F.sum(F.col("x.n") * F.col("y.n"))).first()[0] or 0, PAIRS)
    of = lambda t: F.explode(F.sequence(F.lit(0), F.col(f"{t}.blocks") - 1))
    met = met.select(*group, F.col("x.c").alias("cx"), F.col("y.c").alias("cy"), "y", of("x").alias("bx")).select(*group, "cx", "cy", "bx", of("y").alias("by")).filter("cx <> cy OR bx <= by")
    member = lambda t: blocks.select(*group, F.col("c").alias(f"c{t}"), F.col("block").alias(f"b{t}"), F.col("l").alias(f"l{t}"))
    left = met.join(member("x").hint("merge"), [*group, "cx", "bx"]).select(*group, "cy", "by", "lx", ((F.col("cx") == F.col("cy")) & (F.col("bx") == F.col("by"))).alias("same"), F.pmod(F.xxhash64("cx", "bx"), F.lit(PLACES)).alias("place"))
    at = [*group, "cy", "by", "place"]
    right = member("y").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLACES - 1).cast("long"))))
    both = left.repartition(n, *at).join(right.repartition(n, *at).hint("merge"), at)
    both = both.select(*group, "same", "ly", F.explode("lx").alias("x")).select(*group, "same", "x", F.explode("ly").alias("y")).filter("x.o <> y.o AND (NOT same OR x.o < y.o)")
    pair = [*group, F.least("x.o", "y.o").alias("a"), F.greatest("x.o", "y.o").alias("b")]
    # Only drafts of several texts can meet more than once.
    if d.filter("texts > 1").isEmpty():
        return both.select(*pair)
    more = F.col("x.more") | F.col("y.more")
    return both.filter(~more).select(*pair).unionByName(both.filter(more).select(*pair).distinct())


def same_vectors(drafts: DataFrame, group: list[str], order: str = "draft_ord", least: float = SAME_VECTOR) -> DataFrame:
    """(group, a, b): pairs a < b of a run whose vectors have a cosine of least or more (Q7)."""
    v = drafts.filter(F.size("vector") > 0).select(*group, F.col(order).alias("a"), F.col("vector").alias("va"))
    both = v.join(v.withColumnsRenamed({"a": "b", "va": "vb"}), group).filter("a < b")
    return both.filter(cosine(F.col("va"), F.col("vb")) >= least).select(*group, "a", "b")


def conflicts(drafts: DataFrame, group: list[str], order: str = "draft_ord") -> tuple[DataFrame, DataFrame]:
    """(members, links) of what cannot be kept together: members (group, o, c) say that draft o is of class c, links
    (group, c, d) that a draft of c and another one of d conflict. A slot, an atom and a stem are classes that are linked
    to themselves, so a thousand drafts of one slot are a thousand rows; near stems link their classes, and drafts of
    near vectors are classes of their own."""
    said = drafts.select(*group, F.col(order).alias("o"), squeeze(F.lower("stem")).alias("s")).filter("s <> ''")
    stem = lambda c: F.concat(F.lit("stem "), F.col(c))
    members = [said.select(*group, "o", stem("s").alias("c"))]
    for name in ("coverage_slot_id", "evidence_atom_id"):
        if name in drafts.columns:
            members.append(drafts.filter(F.coalesce(name, F.lit("")) != "").select(*group, F.col(order).alias("o"), F.concat(F.lit(f"{name} "), F.col(name)).alias("c")))
    every = reduce(DataFrame.unionByName, members)
    links = [every.select(*group, "c", F.col("c").alias("d")).distinct()]
    near = near_stems(said, group).select(*group, stem("a").alias("c"), stem("b").alias("d"))
    links += [near, near.select(*group, F.col("d").alias("c"), F.col("c").alias("d"))]
    if "vector" in drafts.columns:
        own, more = _as_classes(same_vectors(drafts, group, order), group)
        every, links = every.unionByName(own), [*links, more]
    return every, reduce(DataFrame.unionByName, links)


def _as_classes(pairs: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, links) of pairs of drafts."""
    name = lambda c: F.concat(F.lit("draft "), F.col(c).cast("string"))
    both = pairs.select(*group, "a", "b").unionByName(pairs.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
    return both.select(*group, F.col("a").alias("o"), name("a").alias("c")).distinct(), both.select(*group, name("a").alias("c"), name("b").alias("d")).distinct()


def accept_first(rows: DataFrame, found: DataFrame | tuple[DataFrame, DataFrame], group: list[str], order: str = "draft_ord") -> DataFrame:
    """rows with accepted: a row is kept unless an earlier kept row of its group conflicts with it. found: pairs (group, a, b)
    that conflict, or what conflicts() returns.

    That is the lexicographically first maximal independent set, found in rounds (Blelloch, Fineman, Shun, SPAA 2012): of the
    undecided, those without an undecided earlier neighbour are kept, and their later neighbours go. A class knows its
    first undecided draft, so a round looks at members and links, never at pairs; only what is undecided is carried on,
    and what a round drops is written once. Rounds end when none is undecided.
    """
    if not isinstance(found, tuple):
        return _without(rows, _gone_of_pairs(found, group), group, order)
    members, links = found
    members, links, gone = cut(members.select(*group, "o", "c").distinct()), cut(links.select(*group, "c", "d").distinct()), []
    while not members.isEmpty():
        least = members.groupBy(*group, F.col("c").alias("d")).agg(F.min("o").alias("first"))
        first = links.join(least, [*group, "d"]).groupBy(*group, "c").agg(F.min("first").alias("first"))
        blocked = members.join(first, [*group, "c"], "left").groupBy(*group, "o").agg(F.max(F.coalesce(F.col("first") < F.col("o"), F.lit(False))).alias("blocked"))
        kept = blocked.filter("NOT blocked").select(*group, F.col("o").alias("k"))
        hit = members.withColumnRenamed("o", "k").join(kept, [*group, "k"], "left_semi").join(links, [*group, "c"]).select(*group, F.col("d").alias("c"), "k")
        hit = hit.groupBy(*group, "c").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        # A kept draft that hits its own class is not hit itself; another one of the class would have kept it back.
        out = cut(members.join(hit, [*group, "c"]).filter("o <> lo OR o <> hi").select(*group, "o").distinct().join(kept.withColumnRenamed("k", "o"), [*group, "o"], "left_anti"))
        gone.append(out)
        decided = out.unionByName(kept.select(*group, F.col("k").alias("o")))
        members = cut(members.join(decided, [*group, "o"], "left_anti"))
    return _without(rows, gone, group, order)


def _gone_of_pairs(pairs: DataFrame, group: list[str]) -> list[DataFrame]:
    """(group, o) of what accept_first drops, by rounds over pairs that are undecided on both sides: firsts that are second
    in none are kept, and their seconds go with all their pairs."""
    pairs, gone = cut(pairs.filter("a <> b").select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    while not pairs.isEmpty():
        seconds = pairs.select(*group, F.col("b").alias("a")).distinct()
        judged = pairs.join(seconds.withColumn("open", F.lit(True)), [*group, "a"], "left")
        # A second goes by any kept first; what is left of its pairs goes with it.
        judged = cut(judged.withColumn("goes", F.max(F.col("open").isNull()).over(Window.partitionBy(*group, "b"))))
        out = judged.filter("goes").select(*group, F.col("b").alias("o")).distinct()
        gone.append(out)
        pairs = cut(judged.filter("NOT goes").select(*group, "a", "b").join(out.withColumnRenamed("o", "a"), [*group, "a"], "left_anti"))
    return gone


def _without(rows: DataFrame, gone: list[DataFrame], group: list[str], order: str) -> DataFrame:
    """rows with accepted, false for what is gone."""
    if not gone:
        return rows.withColumn("accepted", F.lit(True))
    away = reduce(DataFrame.unionByName, gone).select(*group, F.col("o").alias(order), F.lit(False).alias("accepted"))
    return rows.join(away, [*group, order], "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def full_report(drafts: DataFrame, chunks: DataFrame, group: list[str], slots: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """drafts with gates (all of them) and passed (Q11): cheap gates first, similarity only among their survivors."""
    rows = cheap_gates(drafts, chunks)
    if slots is not None:
        rows = coverage_gate(rows, slots, context)
        one = F.struct(F.lit("coverage_contract").alias("gate"), F.col("off_contract").isNull().alias("pass"), F.coalesce("off_contract", F.lit("")).alias("reason"))
        rows = rows.withColumn("gates", F.concat("gates", F.array(one))).drop("off_contract")
    good = F.forall("gates", lambda g: g["pass"])
    # The rows are used three times from here; without the cut their functions would run as often.
    rows = cut(rows.withColumn("good", good))
    alive = rows.filter("good")
    verdict = accept_first(alive.select(*group, "draft_ord"), conflicts(alive, group), group)
    rows = rows.join(verdict, [*group, "draft_ord"], "left")
    last = F.struct(F.lit("not_a_duplicate").alias("gate"), F.coalesce("accepted", F.lit(False)).alias("pass"), F.when(F.col("accepted"), "").otherwise("an earlier accepted draft asks the same").alias("reason"))
    gates = F.when(F.col("good"), F.concat("gates", F.array(last))).otherwise(F.col("gates"))
    return rows.withColumn("gates", gates).withColumn("passed", F.coalesce("accepted", F.lit(False))).drop("good", "accepted")


def gate_rows(report: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gate, pass, reason): the long table of a report."""
    return report.select(*keys, F.explode("gates").alias("g")).select(*keys, "g.*")


def advisory(drafts: DataFrame, chunks: DataFrame, blind: DataFrame, sourced: DataFrame, keys: list[str]) -> DataFrame:
    """keys with answerable_blind, source_specific and single_defensible (Q8 to Q10): advice, never acceptance."""
    b = blind.select(*keys, F.col("interpretable").alias("answerable_blind"))
    rows = drafts.join(chunks.select("doc_id", "chunk_id", F.col("text").alias("c_text")), ["doc_id", "chunk_id"], "left").join(b, keys, "left").join(sourced, keys, "left")
    spans = F.transform("evidence", lambda e: peel_quotes(e))
    specific = (F.col("dependency") == "specific") & (F.size("evidence") > 0) & F.forall(spans, lambda e: (e != "") & found_in(e, F.col("c_text")))
    i = correct_index(F.col("choices"))
    seen = F.transform("choice_verdicts", lambda v: v["index"])
    right = F.forall("choice_verdicts", lambda v: F.when(v["index"] == i, v["status"] == "supported").otherwise(v["status"] == "unsupported") & v["index"].between(0, F.size("choices") - 1))
    audited = (F.size("choice_verdicts") == 0) | ((F.size(F.array_distinct(seen)) == F.size("choices")) & (F.size(seen) == F.size("choices")) & right)
    single = (i >= 0) & (F.col("best_index") == i) & (F.size(F.filter("also_defensible", lambda x: x != i)) == 0) & audited
    return rows.select(*keys, F.coalesce("answerable_blind", F.lit(False)).alias("answerable_blind"), F.coalesce(specific, F.lit(False)).alias("source_specific"), F.coalesce(single, F.lit(False)).alias("single_defensible"))


def within_budget(report: DataFrame, group: list[str], budget: int = 5, visits: int = 24) -> DataFrame:
    """The drafts of a replayed log that a run would have come to: chunks are visited in order while fewer than budget
    drafts were accepted before the chunk, and at most visits chunks; a chunk's drafts are never split (W9, G13)."""
    per = report.groupBy(*group, "visit").agg(F.sum(F.col("passed").cast("int")).alias("ok"))
    w = Window.partitionBy(*group).orderBy("visit")
    before = F.coalesce(F.sum("ok").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    come = per.withColumn("before", before).withColumn("nth", F.row_number().over(w)).filter((F.col("before") < budget) & (F.col("nth") <= visits))
    return report.join(come.select(*group, "visit"), [*group, "visit"], "left_semi")
