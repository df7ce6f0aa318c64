"""Concepts of labelled chunks: smoothing, guard, graph, outline."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concept_key, trimmed
from ..tables import cut

FLICKER = 2
MOST_DROPPED = 0.5
#: Concepts, or edges, of a document from which on its orphans are settled by joins instead of a scan.
MOST_SCANNED = 100_000


def smooth_runs(labelled: DataFrame, group: str = "doc_id", order: str = "chunk_ord", most: int = FLICKER) -> DataFrame:
    """Runs of at most most chunks that are no content, with content on both sides, become content where they have
    topics (W2). A run is an island of equal differences of two row numbers."""
    w = Window.partitionBy(group).orderBy(order)
    off = F.col("kind") != "content"
    out = labelled.withColumn("rn", F.row_number().over(w)).withColumn("isle", F.col("rn") - F.row_number().over(Window.partitionBy(group, off).orderBy(order)))
    run = Window.partitionBy(group, off, "isle")
    inside = (F.min("rn").over(run) > 1) & (F.max("rn").over(run) < F.count("*").over(Window.partitionBy(group)))
    rescued = off & (F.count("*").over(run) <= most) & inside & (F.size("topics") > 0)
    return out.withColumn("rescued", rescued).withColumn("kind", F.when(F.col("rescued"), "content").otherwise(F.col("kind"))).drop("rn", "isle")


def drop_share(labelled: DataFrame, group: str = "doc_id", most: float = MOST_DROPPED) -> DataFrame:
    """Per document: the share that is no content, and whether the document is refused for it."""
    share = F.avg((F.col("kind") != "content").cast("int"))
    return labelled.groupBy(group).agg(F.count("*").alias("n"), share.alias("share")).withColumn("refused", F.col("share") > most)


def dropped_topics(labelled: DataFrame) -> DataFrame:
    """Per document: distinct dropped concept keys of apparatus and of the rest."""
    rows = labelled.filter("kind <> 'content'").select("doc_id", "kind", F.explode("topics").alias("t")).withColumn("k", concept_key(F.col("t"))).filter("k <> ''")
    return rows.groupBy("doc_id").agg(F.countDistinct(F.when(F.col("kind") == "apparatus", F.col("k"))).alias("apparatus"), F.countDistinct(F.when(F.col("kind") != "apparatus", F.col("k"))).alias("non_content"))


def _ordered(value: str, order: str = "chunk_ord") -> Column:
    """Distinct values in order of first sight."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct(order, value))), lambda x: x[value]))


def mentions(chunks: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, chunk_ord, chunk_id, page, key, title, pos): the concepts of content chunks, each once per chunk."""
    rows = chunks.select("doc_id", "chunk_ord", "chunk_id", "page").join(labelled.filter("kind = 'content'").select("doc_id", "chunk_id", "topics"), ["doc_id", "chunk_id"])
    rows = rows.select("doc_id", "chunk_ord", "chunk_id", "page", F.posexplode("topics").alias("pos", "title"))
    rows = rows.withColumn("title", trimmed(F.col("title"))).filter("title <> ''").withColumn("key", concept_key(F.col("title")))
    return rows.groupBy("doc_id", "chunk_ord", "chunk_id", "page", "key").agg(F.min(F.struct("pos", "title")).alias("m")).select("doc_id", "chunk_ord", "chunk_id", "page", "key", "m.title", "m.pos")


def concept_name(ord_: Column) -> Column:
    """C001 on, of a number from 0."""
    n = (ord_ + 1).cast("string")
    return F.concat(F.lit("C"), F.when(ord_ < 999, F.lpad(n, 3, "0")).otherwise(n))


def placed(seen: DataFrame, parts: int | None = None) -> DataFrame:
    """seen with concept_ord, a concept's number by first sight in its document (W4), and its title of then. Rows are dealt
    by document once, into parts partitions; concepts and edges of the result need no other shuffle."""
    rows = seen.repartition("doc_id") if parts is None else seen.repartition(parts, "doc_id")
    first = F.min(F.struct("chunk_ord", "pos", "title")).over(Window.partitionBy("doc_id", "key"))
    rows = rows.withColumn("first", first)
    n = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first.chunk_ord", "first.pos", "key"))
    return rows.withColumn("concept_ord", n - 1).withColumn("title", F.col("first.title")).drop("first")


def concepts_of(at: DataFrame) -> DataFrame:
    """Nodes of placed() rows (A8, W4): doc_id, concept_ord, concept_id, key, title, chunk_ids, pages."""
    nodes = at.groupBy("doc_id", "concept_ord", "key", "title").agg(_ordered("chunk_id").alias("chunk_ids"), _ordered("page").alias("pages"))
    return nodes.select("doc_id", "concept_ord", concept_name(F.col("concept_ord")).alias("concept_id"), "key", "title", "chunk_ids", "pages")


def concepts(seen: DataFrame) -> DataFrame:
    """Nodes (A8, W4): doc_id, concept_ord, concept_id, key, title, chunk_ids, pages; numbered by first sight."""
    return concepts_of(placed(seen))


def edges_of(at: DataFrame) -> DataFrame:
    """Edges of placed() rows (A9, W3): doc_id, edge_ord, kind, src, dst, evidence_chunk_ids. co_occurs goes from the earlier
    concept of a chunk to the later (G8); follows joins the last concept of a chunk to the first of the next that has any (G9)."""
    chunk = at.groupBy("doc_id", "chunk_ord", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("concept_ord").alias("c")))).alias("l"))
    chunk = chunk.withColumn("before", F.lag(F.element_at("l", -1)["c"]).over(Window.partitionBy("doc_id").orderBy("chunk_ord")))
    each = chunk.select("doc_id", "chunk_ord", "chunk_id", "before", "l", F.posexplode("l").alias("i", "x"))
    # The first concept of a chunk also meets the last one of the chunk before.
    link = lambda follows, src, dst, pos, rpos: F.struct(F.lit(follows).alias("follows"), src.alias("src"), dst.alias("dst"), pos.cast("long").alias("pos"), rpos.cast("long").alias("rpos"))
    later = F.transform(F.slice("l", F.col("i") + 2, F.size("l")), lambda y: link(False, F.col("x.c"), y["c"], F.col("x.pos"), y["pos"]))
    follows = F.array(link(True, F.col("before"), F.col("x.c"), F.lit(1 << 20), F.lit(0)))
    its = F.when((F.col("i") == 0) & (F.col("before") != F.col("x.c")), F.concat(later, follows)).otherwise(later)
    both = each.select("doc_id", "chunk_ord", "chunk_id", F.explode(its).alias("e")).select("doc_id", "chunk_ord", "chunk_id", "e.*").filter("follows OR pos < rpos")
    out = both.groupBy("doc_id", "follows", "src", "dst").agg(F.min(F.struct("chunk_ord", "pos", "rpos")).alias("first"), _ordered("chunk_id").alias("evidence_chunk_ids"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    kind = F.when(F.col("follows"), "follows").otherwise("co_occurs")
    return out.select("doc_id", n.alias("edge_ord"), kind.alias("kind"), concept_name(F.col("src")).alias("src"), concept_name(F.col("dst")).alias("dst"), "evidence_chunk_ids")


def edges(seen: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, as edges_of(), of mentions and their nodes."""
    return edges_of(seen.join(nodes.select("doc_id", "key", "concept_ord"), ["doc_id", "key"]).repartition("doc_id"))


def evidence_graph(chunks: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts, edges) (K1)."""
    at = placed(mentions(chunks, labelled))
    return concepts_of(at), edges_of(at)


def neighbourhood(start: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """(doc_id, owner, concept_id) within hops of an owner's concepts, edges both ways (JN12). A true breadth-first
    search: see the README on G5."""
    both = links.select("doc_id", F.col("src").alias("concept_id"), F.col("dst").alias("next")).unionByName(links.select("doc_id", F.col("dst").alias("concept_id"), F.col("src").alias("next"))).distinct()
    found = start.select("doc_id", "owner", "concept_id").distinct()
    for _ in range(hops):
        found = found.join(both, ["doc_id", "concept_id"], "left").select("doc_id", "owner", F.explode(F.array_distinct(F.array("concept_id", F.coalesce("next", "concept_id")))).alias("concept_id")).distinct()
    return found


def claimed_concepts(lessons: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, concept_id, lesson_id): a concept goes to the first lesson that lists it; unknown ids don't count (JN6)."""
    rows = lessons.select("doc_id", "lesson_id", "lesson_pos", F.posexplode("concept_ids").alias("pos", "concept_id"))
    rows = rows.join(nodes.select("doc_id", "concept_id"), ["doc_id", "concept_id"], "left_semi")
    return rows.groupBy("doc_id", "concept_id").agg(F.min_by("lesson_id", F.struct("lesson_pos", "pos")).alias("lesson_id"))


def recover_orphans(nodes: DataFrame, links: DataFrame, claimed: DataFrame, most: int = MOST_SCANNED) -> DataFrame:
    """claimed with a lesson for every concept of a document that has one (K3): by a co_occurs neighbour, then by one of
    follows, in the order of edges, then by the nearest concept in order, left first.

    Documents are scanned side by side, each where its concepts and edges are; those of more than most concepts or edges
    are settled by rounds of joins.
    """
    every = nodes.select("doc_id", "concept_ord", "concept_id").join(claimed, ["doc_id", "concept_id"], "left")
    sizes = nodes.groupBy("doc_id").count().unionByName(links.groupBy("doc_id").count())
    heavy = cut(sizes.filter(F.col("count") > most).select("doc_id").distinct())
    if heavy.isEmpty():
        return scan_orphans(every, links)
    light, large = (lambda df: df.join(F.broadcast(heavy), "doc_id", "left_anti")), (lambda df: df.join(F.broadcast(heavy), "doc_id", "left_semi"))
    return scan_orphans(light(every), light(links)).unionByName(join_orphans(large(every), large(links)))


def _turn() -> Column:
    return F.when(F.col("kind") == "co_occurs", 0).otherwise(1 << 40) + F.col("edge_ord")


def scan_orphans(every: DataFrame, links: DataFrame) -> DataFrame:
    """recover_orphans() of every (doc_id, concept_ord, concept_id, lesson_id or null) by a scan of each document. Rows that are
    dealt by doc_id stay where they are; a document is a row, so very large ones go to join_orphans()."""
    c = every.groupBy("doc_id").agg(F.collect_list(F.struct("concept_ord", "concept_id", "lesson_id")).alias("c"))
    e = links.filter(F.col("kind").isin("co_occurs", "follows")).groupBy("doc_id").agg(F.collect_list(F.struct(_turn().alias("turn"), "src", "dst")).alias("e"))
    return c.join(e.hint("merge"), "doc_id", "left").mapInArrow(_scanned, f"doc_id {every.schema['doc_id'].dataType.simpleString()}, concept_id string, lesson_id string")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scan of whole documents: concepts in order look at their neighbours, in the order of edges, and see claimed ones and
    those before them. Concepts of all documents of a batch are numbered through, so one pass settles them."""

    def flat(batch: pa.RecordBatch, name: str, order: str) -> tuple[pa.StructArray, np.ndarray]:
        """The entries of all lists, each list in order, and whose they are."""
        size = pc.list_value_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
        values, whose = batch.column(name).flatten(), np.repeat(np.arange(len(size)), size)
        return values.take(pa.array(np.lexsort((values.field(order).to_numpy(zero_copy_only=False), whose)))), whose

    for batch in batches:
        (nodes, doc), (links, of) = flat(batch, "c", "concept_ord"), flat(batch, "e", "turn")
        ids, n, m = nodes.field("concept_id"), len(nodes), len(links)
        if not n:
            continue
        names = pa.concat_arrays([ids, links.field("src"), links.field("dst")]).dictionary_encode()
        key = np.concatenate([doc, of, of]).astype(np.int64) * (len(names.dictionary) + 1) + names.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(key[:n])
        found = by[np.minimum(np.searchsorted(key[:n], key[n:], sorter=by), n - 1)]
        known = (key[found] == key[n:]).reshape(2, m).all(axis=0)
        ends = found.reshape(2, m)[:, known]
        codes = nodes.field("lesson_id").dictionary_encode()
        lesson = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        me, to, turn = np.concatenate(ends), np.concatenate(ends[::-1]), np.tile(np.arange(ends.shape[1]), 2)
        sees = (lesson[me] < 0) & ((lesson[to] >= 0) | (to < me))
        me, to, turn = me[sees], to[sees], turn[sees]
        by = np.lexsort((turn, me))
        got = lesson.tolist()
        for i, j in zip(me[by].tolist(), to[by].tolist(), strict=True):
            if got[i] < 0:
                got[i] = got[j]
        lesson = np.array(got, np.int64)
        # What is left takes the last lesson before it in its document, or else the first behind.
        at, first = np.arange(n), np.searchsorted(doc, doc)
        before = np.maximum.accumulate(np.where(lesson >= 0, at, -1))
        behind = np.minimum.accumulate(np.where(lesson >= 0, at, n)[::-1])[::-1]
        its = np.where(before >= first, before, behind)
        has = (its < n) & (doc[np.minimum(its, n - 1)] == doc)
        rows = [batch.column("doc_id").take(pa.array(doc[has])), ids.filter(pa.array(has)), codes.dictionary.take(pa.array(lesson[its[has]]))]
        yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "concept_id", "lesson_id"])


def join_orphans(every: DataFrame, links: DataFrame) -> DataFrame:
    """recover_orphans() for documents of any size, as scan_orphans().

    The rule goes through the concepts in order, so a concept only sees claimed neighbours and those before it. That is a
    graph of dependencies: rounds of joins find which concepts it reaches from the claimed ones; each of these points to
    its first neighbour that has a lesson, and pointers are doubled until they end at a claimed concept. What is left
    takes the last lesson before it, or else the first behind. Rounds are checkpointed; no document meets in one row.
    """
    every = cut(every)
    its = lambda end, n: every.select("doc_id", F.col("concept_id").alias(end), F.col("concept_ord").alias(n), F.col("lesson_id").isNotNull().alias(f"{n}_claimed"))
    ends = links.filter(F.col("kind").isin("co_occurs", "follows")).select("doc_id", "src", "dst", _turn().alias("turn"))
    ends = ends.join(its("src", "a"), ["doc_id", "src"]).join(its("dst", "b"), ["doc_id", "dst"])
    way = lambda x, y: F.when(~F.col(f"{x}_claimed") & (F.col(f"{y}_claimed") | (F.col(y) < F.col(x))), F.struct(F.col(x).alias("c"), F.col(y).alias("to"), F.col(f"{y}_claimed").alias("ends"), "turn"))
    sees = cut(ends.select("doc_id", F.explode(F.array_compact(F.array(way("a", "b"), way("b", "a")))).alias("w")).groupBy("doc_id", "w.c", "w.to", "w.ends").agg(F.min("w.turn").alias("turn")))
    # Rounds carry on only what is not reached yet: rows whose end was reached have said so, rows of reached ones are done.
    fresh = cut(sees.filter("ends").select("doc_id", "c").distinct())
    reached, rest = fresh, cut(sees.filter("NOT ends").select("doc_id", "c", "to").join(fresh, ["doc_id", "c"], "left_anti"))
    while not fresh.isEmpty() and not rest.isEmpty():
        hit = rest.join(fresh.select("doc_id", F.col("c").alias("to"), F.lit(True).alias("hit")), ["doc_id", "to"], "left")
        hit = cut(hit.withColumn("hit", F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy("doc_id", "c"))))
        fresh, rest = hit.filter("hit").select("doc_id", "c").distinct(), hit.filter("NOT hit").drop("hit")
        reached = reached.unionByName(fresh)
    # Of ends that have a lesson the first counts: all that are claimed, and the reached ones.
    open_ = sees.filter("NOT ends").join(reached.withColumnRenamed("c", "to"), ["doc_id", "to"], "left_semi")
    at = sees.filter("ends").unionByName(open_.select(*sees.columns)).groupBy("doc_id", "c").agg(F.min_by(F.struct("to", "ends"), "turn").alias("p"))
    at = cut(at.select("doc_id", "c", "p.to", "p.ends"))
    done, at = [at.filter("ends")], at.filter("NOT ends")
    while not at.isEmpty():
        on = reduce(DataFrame.unionByName, [*done, at]).select("doc_id", F.col("c").alias("to"), F.col("to").alias("further"), F.col("ends").alias("its_end"))
        at = cut(at.join(on, ["doc_id", "to"]).select("doc_id", "c", F.col("further").alias("to"), F.col("its_end").alias("ends")))
        done, at = [*done, at.filter("ends")], at.filter("NOT ends")
    lessons = every.filter("lesson_id IS NOT NULL").select("doc_id", F.col("concept_ord").alias("to"), F.col("lesson_id").alias("found"))
    found = reduce(DataFrame.unionByName, done).join(lessons, ["doc_id", "to"]).select("doc_id", F.col("c").alias("concept_ord"), "found")
    w = Window.partitionBy("doc_id").orderBy("concept_ord")
    own = every.join(found, ["doc_id", "concept_ord"], "left").withColumn("own", F.coalesce("lesson_id", "found"))
    before, behind = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("own", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return own.select("doc_id", "concept_id", F.coalesce(before, behind).alias("lesson_id")).filter("lesson_id IS NOT NULL")


def chunk_lessons(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, lesson_id): the lesson of the chunk's first concept in graph order (JN7)."""
    rows = nodes.join(assigned, ["doc_id", "concept_id"]).select("doc_id", "lesson_id", "concept_ord", F.explode("chunk_ids").alias("chunk_id"))
    return rows.groupBy("doc_id", "chunk_id").agg(F.min_by("lesson_id", "concept_ord").alias("lesson_id"))


def listed_chunks(lessons: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, lesson_id, nth, chunk columns): the chunks that a lesson's chunk_ids list, in the list's order from 1; ids
    of no chunk are left out, an id listed twice stays twice, a lesson without any has no row (JN2)."""
    rows = lessons.select("doc_id", "lesson_id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).join(chunks.drop("lesson_id"), ["doc_id", "chunk_id"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "lesson_id").orderBy("pos"))
    return rows.withColumn("nth", nth).drop("pos")


def outline(lessons: DataFrame, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lessons that keep a chunk, concept to lesson, chunk to lesson) (K4)."""
    assigned = recover_orphans(nodes, links, claimed_concepts(lessons, nodes))
    chunks = chunk_lessons(nodes, assigned)
    return lessons.join(chunks.select("doc_id", "lesson_id").distinct(), ["doc_id", "lesson_id"], "left_semi"), assigned, chunks


def numbered_lessons(lessons: DataFrame) -> DataFrame:
    """lessons with lesson_id L01 on by lesson_pos, in each document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("lesson_pos"))
    return lessons.withColumn("lesson_id", F.format_string("L%02d", n))


def listing(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, request): a document's concepts with their pages and its edges, each on a line, in order."""
    node = F.concat(F.lit("- "), "concept_id", F.lit(" | "), "title", F.lit(" | pages "), F.array_join(F.transform("pages", lambda x: x.cast("string")), " "))
    link = F.concat(F.lit("- "), "src", F.lit(" -> "), "dst", F.lit(" | "), "kind")
    rows = nodes.select("doc_id", F.lit(0).alias("part"), F.col("concept_ord").cast("long").alias("ord"), node.alias("t")).unionByName(links.select("doc_id", F.lit(1).alias("part"), F.col("edge_ord").cast("long").alias("ord"), link.alias("t")))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "t"))).alias("p"))
    of = lambda k: F.array_join(F.transform(F.filter("p", lambda x: x["part"] == k), lambda x: x["t"]), "\n")
    return rows.select("doc_id", F.concat(F.lit("Concepts, in the order of their first evidence:\n"), of(0), F.lit("\n\nEdges:\n"), of(1)).alias("request"))


def source_bound_atoms(atoms: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence atoms that hold (K2): a claim, quote, relation and known chunk that has the quote verbatim; known concepts
    once each; the first of equal (chunk, relation, claim), numbered A001 on in input order (atom_ord)."""
    a = atoms.withColumns({c: trimmed(F.col(c)) for c in ("claim", "quote", "relation")})
    a = a.filter("claim <> '' AND quote <> '' AND relation <> '' AND chunk_id <> ''")
    a = a.drop("page").join(chunks.select("doc_id", "chunk_id", "page", F.col("text").alias("chunk_text")), ["doc_id", "chunk_id"])
    one = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    a = a.filter(F.contains(one(F.col("chunk_text")), one(F.col("quote")))).drop("chunk_text")
    known = nodes.groupBy("doc_id").agg(F.collect_set("concept_id").alias("known"))
    a = a.join(known, "doc_id", "left").withColumn("concept_ids", F.array_distinct(F.filter("concept_ids", lambda x: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), x)))).drop("known")
    first = Window.partitionBy("doc_id", "chunk_id", F.lower("relation"), F.lower("claim")).orderBy("atom_ord")
    a = a.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return a.withColumn("atom_id", F.format_string("A%03d", F.row_number().over(Window.partitionBy("doc_id").orderBy("atom_ord"))))


def without_evidence(chunks: DataFrame, good: DataFrame) -> DataFrame:
    """Documents none of whose atoms holds: refused, as nothing could be asked about them (K2)."""
    return chunks.select("doc_id").distinct().join(good.select("doc_id"), "doc_id", "left_anti")
