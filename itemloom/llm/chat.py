"""Chat formatting of reply trees (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, part_of, running, text_blocks

#: The template's marks; OTHERS are foreign control strings that a text must not smuggle in either.
BOS, EOS, TURN, BODY, END = "<s>", "</s>", "[TURN]", "[TEXT]", "[/TURN]"
OTHERS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
_TAILS = r"(?:/?s>|<SYS>>|</SYS>>|/?TURN\]|TEXT\]|/?INST\])"


def escape(text: Column) -> Column:
    """A backslash goes after the first character of every control string; those that have some get one more."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_TAILS})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={_TAILS})", "$1$2")


def choose_paths(messages: DataFrame, tree: str = "tree_id", node: str = "node", parent: str = "parent", score: str = "score", best: int = 1) -> DataFrame:
    """The best root-to-leaf paths of reply trees: tree, path (rank from 1), step (from 0 at the root), node.

    messages has one row per node; parent is null (or not in the tree) at a root. Paths are enumerated by self-joins
    that double the distance each round, so a chain of n turns takes log2(n) rounds; each round is checkpointed, and
    each knows for every node the ancestor 2^k above and the score between. A path's score is the sum of its nodes';
    ties go to the smaller leaf. Null scores count 0. Nodes on a cycle have no root and are on no path; rows of null
    node neither. Of rows that repeat a node the least (parent, score) counts, so that no path is multiplied; extra
    columns are ignored, and an empty table gives no path.
    """
    known = messages.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("up"), F.coalesce(F.col(score), F.lit(0.0)).cast("double").alias("s"))
    known = known.filter("n is not null").groupBy("t", "n").agg(F.min(F.struct("up", "s")).alias("x")).select("t", "n", "x.*")
    ids = known.select(F.col("t").alias("it"), F.col("n").alias("in_"))
    first = cut(known.join(ids, F.col("t").eqNullSafe(F.col("it")) & (F.col("up") == F.col("in_")), "left").select("t", "n", F.col("in_").alias("up"), "s", F.lit(1).cast("long").alias("d")))
    open_, done = first.filter("up is not null"), first.filter("up is null")
    parents = open_.select("t", F.col("up").alias("n")).distinct()
    leaves = first.select("t", "n").join(parents.withColumnsRenamed({"t": "pt", "n": "pn"}), F.col("t").eqNullSafe(F.col("pt")) & (F.col("n") == F.col("pn")), "left_anti")
    rounds, nodes = [open_], first.count()
    # A node that knows its root is done; only the others take part in the next round.
    while 2 ** (len(rounds) - 1) <= nodes and not open_.isEmpty():
        top = open_.unionByName(done).select(F.col("t").alias("tt"), F.col("n").alias("tn"), F.col("up").alias("tu"), F.col("s").alias("ts"), F.col("d").alias("td"))
        both = open_.join(top, F.col("t").eqNullSafe(F.col("tt")) & (F.col("up") == F.col("tn")))
        new = cut(both.select("t", "n", F.col("tu").alias("up"), (F.col("s") + F.col("ts")).alias("s"), (F.col("d") + F.col("td")).alias("d")))
        open_, done = new.filter("up is not null"), done.unionByName(new.filter("up is null"))
        rounds.append(open_)
    # done has for each node the score and the number of nodes from itself to its root.
    whole = leaves.join(done.drop("up").withColumnsRenamed({"t": "jt", "n": "jn"}), F.col("t").eqNullSafe(F.col("jt")) & (F.col("n") == F.col("jn")))
    ranked = whole.select("t", F.col("n").alias("leaf"), F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "n")).alias("path"), "d").filter(F.col("path") <= best)
    on = cut(ranked.select("t", "path", F.col("leaf").alias("n"), (F.col("d") - 1).alias("step")))
    for k in reversed(range(len(rounds) - 1)):
        up = rounds[k].select(F.col("t").alias("jt"), F.col("n").alias("jn"), F.col("up").alias("ju"))
        both = on.join(up, F.col("t").eqNullSafe(F.col("jt")) & (F.col("n") == F.col("jn")), "left")
        # Each node stays and brings its ancestor; one join, not a union of on with itself, whose plan would double.
        pair = F.array(F.struct(F.col("n"), F.col("step")), F.struct(F.col("ju").alias("n"), (F.col("step") - 2**k).alias("step")))
        on = both.select("t", "path", F.explode(pair).alias("x")).filter("x.n is not null").select("t", "path", "x.n", "x.step")
    return on.select(F.col("t").alias(tree), "path", "step", F.col("n").alias(node))


def as_chain(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as a reply tree of one branch: tree_id, node, parent, score, role, text. Ties go by role, then text."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    n = F.row_number().over(w).cast("long")
    return conversations.select(F.col(conv).alias("tree_id"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), F.lit(0.0).alias("score"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def format_paths(messages: DataFrame, paths: DataFrame, tree: str = "tree_id", node: str = "node", learned: str = LEARNED) -> DataFrame:
    """One row per chosen path: tree, path, n_turns, formatted, loss: array<struct<start, end>>.

    formatted is <s>, then [TURN]role[TEXT]text[/TURN] for each turn, then </s>; control strings in roles and texts are
    escaped. loss has the code points (end exclusive) of the learned role's texts. Null roles and texts are empty; of
    rows that repeat a node the least (role, text) counts. Paths of no known node have no row; an empty table gives none.
    """
    turn = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("turn")
    rows = paths.join(messages.withColumnsRenamed({tree: "mt", node: "mn"}), F.col(tree).eqNullSafe(F.col("mt")) & (F.col(node) == F.col("mn")))
    rows = rows.groupBy(tree, "path", "step").agg(turn)
    part = F.struct("step", F.concat(F.lit(TURN), escape(F.col("turn.role")), F.lit(BODY)).alias("head"), escape(F.col("turn.text")).alias("body"), (F.col("turn.role") == learned).alias("learned"))
    out = rows.groupBy(tree, "path").agg(F.array_sort(F.collect_list(part)).alias("p"))
    out = out.withColumn("ends", running(F.transform("p", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END))))
    text = F.concat(F.lit(BOS), F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""), F.lit(EOS))
    end = lambda e: e + (len(BOS) - len(END))
    span = lambda x, e: F.when(x["learned"], F.struct((end(e) - F.length(x["body"])).alias("start"), end(e).alias("end")))
    loss = F.filter(F.zip_with("p", "ends", span), lambda x: x.isNotNull())
    return out.select(tree, "path", F.size("p").cast("long").alias("n_turns"), text.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns: array<struct<role, text>> and learned_text, both read from the string and its loss spans.
    Repeated rows are read each; an empty table gives an empty result."""
    inner = F.col("formatted").substr(F.lit(len(BOS) + 1), F.length("formatted") - len(BOS) - len(EOS))
    turns = F.transform(F.filter(F.split(inner, r"\[/TURN\]"), lambda x: x != ""), lambda x: F.split(F.substring(x, F.lit(len(TURN) + 1), F.length(x)), r"\[TEXT\]", 2))
    turns = F.transform(turns, lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")))
    (b,) = named(formatted, "rb_blocks")
    learned = F.array_join(F.transform("loss", lambda s: unescape(part_of(F.col(b), s["start"], s["end"]))), "")
    return formatted.withColumn("turns", turns).withColumn(b, text_blocks(F.col("formatted"))).withColumn("learned_text", learned).drop(b)


def format_conversations(conversations: DataFrame, **names: str) -> DataFrame:
    """Conversations in rows by turn, formatted: tree_id, path, n_turns, formatted, loss.

    An empty table gives an empty result; repeated rows are turns of their own; extra columns are ignored.
    """
    messages = as_chain(conversations, **names)
    return format_paths(messages, choose_paths(messages))
