"""Phrase collocations: n-grams counted in weighted acyclic automata, built per shard, united by ranges of prefixes, and
composed with requests for the counts of phrases' parts."""

from __future__ import annotations

import bisect
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, written

#: Bytes of texts that a task counts at once, and n-grams of a range of prefixes (bounds its task's memory).
SHARD_BYTES, RANGE_GRAMS = 16 << 20, 5_000_000
#: N-grams that the bounds of ranges are drawn from, and bytes of a word that a bound keeps.
SAMPLE_GRAMS, BOUND_BYTES = 20_000, 32
MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: Parts of a language that are ranked on their own before the language is.
SALTS = 16
#: Bytes that end a word and stay in the piece, and those that end a piece.
BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"
_MOST_WORDS = (1 << 63 // MAX_WORDS) - MAX_WORDS

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Transducer:
    """A minimal acyclic automaton over words whose states carry weights: a phrase's weight is that of the state it leads to
    (0: not accepted). States with one weight and the same arcs are one state.

    words: the symbols in byte order. State s has arcs first[s] to first[s + 1], by symbol; the last state is the root.
    """

    def __init__(self, words: pa.Array, weight: np.ndarray, first: np.ndarray, symbol: np.ndarray, target: np.ndarray):
        self.words, self.weight, self.first, self.symbol, self.target = words, weight, first, symbol, target

    @classmethod
    def build(cls, words: pa.Array, paths: np.ndarray, weights: np.ndarray) -> Transducer:
        """paths: distinct rows of symbols in order, filled with -1 behind their end. States are registered from the ends of
        paths to the root: all nodes of one depth are complete when it is their turn, and equal ones become one."""
        n, depth = paths.shape
        fresh = np.ones((n, depth + 1), bool)
        fresh[1:, 0] = False
        if n:
            fresh[1:, 1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        weight, count, symbol, target, total = [], [], [], [], 0
        state = rows = np.zeros(0, np.int64)
        for d in range(depth, -1, -1):
            at = np.flatnonzero(fresh[:, d] & (paths[:, d - 1] >= 0)) if d else np.zeros(1, np.int64)
            ends = np.ones(len(at), bool) if d == depth else paths[at, d] < 0 if n else np.zeros(1, bool)
            w = np.where(ends, weights[at], 0) if n else np.zeros(1, np.int64)
            # rows: where the nodes one deeper begin; their parent is the last node of this depth at or before.
            arcs = np.bincount(np.searchsorted(at, rows, side="right") - 1, minlength=len(at)) if len(rows) else np.zeros(len(at), np.int64)
            start = np.cumsum(arcs) - arcs
            sym = paths[rows, d] if len(rows) else np.zeros(0, np.int32)
            reps, which = cls._register(w, arcs, start, sym, state)
            weight.append(w[reps])
            count.append(arcs[reps])
            pick = np.repeat(start[reps] - (np.cumsum(arcs[reps]) - arcs[reps]), arcs[reps]) + np.arange(int(arcs[reps].sum()))
            symbol.append(sym[pick])
            target.append(state[pick])
            state, rows, total = which + total, at, total + len(reps)
        first = np.concatenate([[0], np.cumsum(np.concatenate(count))])
        return cls(words, np.concatenate(weight).astype(np.int64), first.astype(np.int64), np.concatenate(symbol).astype(np.int32), np.concatenate(target).astype(np.int64))

    @staticmethod
    def _register(w: np.ndarray, arcs: np.ndarray, start: np.ndarray, sym: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first node of each class of equal nodes, the class of each node). Equal hashes are compared in full; should
        two nodes differ in spite of them, all are hashed anew."""
        for seed in itertools.count():
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(_mix(sym, seed) ^ state.astype(np.uint64), seed + 1))])
            h = _mix(sums[start + arcs] - sums[start], seed + 2) ^ _mix(w, seed + 3) ^ (arcs.astype(np.uint64) << np.uint64(32))
            _, reps, which = np.unique(h, return_index=True, return_inverse=True)
            other = reps[which]
            if (w != w[other]).any() or (arcs != arcs[other]).any():
                continue
            own = np.repeat(start, arcs) + np.arange(len(sym)) - np.repeat(np.cumsum(arcs) - arcs, arcs)
            its = np.repeat(start[other], arcs) + np.arange(len(sym)) - np.repeat(np.cumsum(arcs) - arcs, arcs)
            if (sym[own] == sym[its]).all() and (state[own] == state[its]).all():
                return reps, which

    def __len__(self) -> int:
        return len(self.weight)

    def paths(self, depth: int = MAX_WORDS, in_order: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(paths, weights) of the accepted phrases, as build() takes them if in order."""
        state, path = np.array([len(self.weight) - 1]), np.full((1, depth), -1, np.int32)
        found = []
        for d in range(depth + 1):
            on = self.weight[state] > 0
            found.append((path[on], self.weight[state[on]]))
            if d == depth:
                break
            n = self.first[state + 1] - self.first[state]
            arc = np.repeat(self.first[state] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            path = np.repeat(path, n, axis=0)
            path[:, d] = self.symbol[arc]
            state = self.target[arc]
        path, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = _order(path, len(self.words)) if in_order else slice(None)
        return path[order], weight[order]

    def compose(self, paths: np.ndarray, words: pa.Array) -> np.ndarray:
        """The weights here of another automaton's phrases: both are walked together, a word of all phrases at a time."""
        here = _positions(self.words, words)
        arcs = np.repeat(np.arange(len(self)), np.diff(self.first)) * (len(self.words) + 1) + self.symbol
        state = np.full(len(paths), len(self) - 1)
        for d in range(paths.shape[1]):
            more = paths[:, d] >= 0
            s = here[paths[more, d]]
            key = np.where((s < 0) | (state[more] < 0), -1, state[more] * (len(self.words) + 1) + s)
            i = np.minimum(np.searchsorted(arcs, key), max(0, len(arcs) - 1))
            state[more] = np.where(arcs[i] == key, self.target[i], -1) if len(arcs) else -1
        return np.where(state < 0, 0, self.weight[state])

    def dumps(self) -> bytes:
        small = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in (self.weight, np.diff(self.first), self.symbol, self.target)]
        at, text = _buffers(self.words)
        lengths = np.diff(at)
        return zstandard.compress(pickle.dumps((text, lengths.astype(np.min_scalar_type(int(lengths.max()) if len(lengths) else 0)), *small), protocol=5), 1)

    @classmethod
    def loads(cls, blob: bytes) -> Transducer:
        text, lengths, weight, arcs, symbol, target = pickle.loads(zstandard.decompress(blob))
        at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(text)])
        first = np.concatenate([[0], np.cumsum(arcs, dtype=np.int64)])
        return cls(words, weight.astype(np.int64), first, symbol.astype(np.int32), target.astype(np.int64))


def _buffers(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of an array of words."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return at - at[0], words.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes() if at[-1] > at[0] else b""


def _positions(known: pa.Array, asked: pa.Array) -> np.ndarray:
    """Where each asked word stands among the known ones; -1: nowhere."""
    return pc.fill_null(pc.index_in(asked, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _order(paths: np.ndarray, size: int) -> np.ndarray:
    """The order of paths over size words: as one number each where they fit."""
    if (size + 1) ** paths.shape[1] >= 1 << 63:
        return np.lexsort(paths.T[::-1])
    key = np.zeros(len(paths), np.int64)
    for d in range(paths.shape[1]):
        key = key * (size + 1) + paths[:, d] + 1
    return np.argsort(key, kind="stable")


def _compact(words: pa.Array, paths: np.ndarray, weights: np.ndarray) -> Transducer:
    """A transducer of some paths, with only their words."""
    used = np.unique(paths)
    used = used[used >= 0]
    small = np.where(paths >= 0, np.searchsorted(used, paths), -1).astype(np.int32)
    return Transducer.build(words.take(pa.array(used)), small, weights)


def merged(parts: list[Transducer], combine=np.add) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, paths, weights) of the union of transducers; weights of one phrase are summed (or combined otherwise)."""
    words = pc.unique(pa.concat_arrays([p.words for p in parts]))
    words = words.take(pc.array_sort_indices(words))
    paths, weights = [], []
    for p in parts:
        path, weight = p.paths(in_order=False)
        paths.append(np.append(_positions(words, p.words), -1).astype(np.int32)[path])
        weights.append(weight)
    path, weight = np.concatenate(paths), np.concatenate(weights)
    order = _order(path, len(words))
    path, weight = path[order], weight[order]
    new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]).any(axis=1))[: len(path)])
    return words, path[new], combine.reduceat(weight, new) if len(new) else weight


def united(parts: list[Transducer], combine=np.add) -> Transducer:
    return parts[0] if len(parts) == 1 else Transducer.build(*merged(parts, combine))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word ids, words in byte order, piece of each word) of some texts; A-Z are lower-cased."""
    b = np.frombuffer(("\n".join(x or "" for x in texts) + "\n").encode().lower(), np.uint8)
    kind = _KIND[b]
    on = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2)[start]
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(b[on])]).dictionary_encode()
    order = pc.array_sort_indices(got.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[got.indices.to_numpy()], got.dictionary.take(order).cast(pa.binary()), piece


def grams(ids: np.ndarray, piece: np.ndarray, size: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """(paths, counts) of the n-grams of up to MAX_WORDS words within pieces that begin at one of the first starts words, as
    Transducer.build() takes them. size: of the words."""
    paths, counts, key = [], [], ids
    for n in range(1, MAX_WORDS + 1):
        m = max(0, min(starts, len(ids) - n + 1))
        key = key[:m] * size + ids[n - 1 : n - 1 + m] if n > 1 else key[:m]
        got, c = np.unique(key[piece[:m] == piece[n - 1 : n - 1 + m]], return_counts=True)
        path = np.full((len(got), MAX_WORDS), -1, np.int32)
        for d in range(n - 1, -1, -1):
            got, path[:, d] = np.divmod(got, max(1, size))
        paths.append(path)
        counts.append(c)
    path, count = np.concatenate(paths), np.concatenate(counts).astype(np.int64)
    order = _order(path, size)
    return path[order], count[order]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) of some SHARD_BYTES at a time."""
    held, size = {}, 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(UNKNOWN if lang is None else lang, []).append(text)
            size += len(text or "")
            if size >= SHARD_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def counted(lang: str, texts: list[str], bounds: list[tuple]) -> Iterator[tuple[int, Transducer]]:
    """(range, transducer) of some texts' n-grams: bounds cut the order of (lang, words...) into ranges."""
    ids, words, piece = tokens(texts)
    # Of more words than this, three would not fit in 63 bits: then n-grams are counted by parts, each in the part it begins in.
    step = max(1, len(ids) if len(words) < _MOST_WORDS else _MOST_WORDS)
    for a in range(0, len(ids), step):
        used, small = np.unique(ids[a : a + step + MAX_WORDS - 1], return_inverse=True)
        w = words.take(pa.array(used))
        path, count = grams(small, piece[a : a + step + MAX_WORDS - 1], len(used), step)
        text = w.to_pylist()
        row = lambda r: (lang.encode(), *(text[x] for x in path[r].tolist() if x >= 0))  # noqa: B023, E731
        cuts = [0]
        lo = bisect.bisect_right(bounds, (lang.encode(),))
        hi = bisect.bisect_right(bounds, (lang.encode() + b"\x00",))
        for k in range(lo, hi):
            cuts.append(bisect.bisect_left(range(len(path)), bounds[k], lo=cuts[-1], key=row))
        for k, (x, y) in enumerate(itertools.pairwise([*cuts, len(path)])):
            if x < y:
                yield lo + k, _compact(w, path[x:y], count[x:y])


def range_bounds(docs: DataFrame, text: str, lang: str) -> list[tuple]:
    """Bounds (lang, words...) that cut the n-grams into ranges of some RANGE_GRAMS, from a sample of SAMPLE_GRAMS at most
    three times over; the driver gets nothing else. Few n-grams make at least a range for each shuffle partition."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    grams_, spark = size // 2, docs.sparkSession
    n = max(-(-grams_ // RANGE_GRAMS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLE_GRAMS * 6 / max(1, size))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for l, texts in _shards(batches):
            ids, words, piece = tokens(texts)
            pick = np.flatnonzero(_mix(np.arange(len(ids)) ^ (len(ids) << 20), 7) < np.uint64(share * (2**64 - 2049)))
            w = words.to_pylist()
            out = [[l.encode(), *(w[ids[j]][:BOUND_BYTES] for j in range(i, min(i + MAX_WORDS, len(ids))) if piece[j] == piece[i])] for i in pick.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["g"])

    got = sorted(tuple(bytes(x) for x in r.g) for r in docs.select(lang, text).mapInArrow(draw, "g array<binary>").limit(3 * SAMPLE_GRAMS).collect())
    return sorted({got[len(got) * k // n] for k in range(1, n)}) if got else []


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two and three words by score.

    Words stand between blanks within pieces between BREAKS, A-Z lower-cased. a counts a phrase (overlaps included), l and r
    its parts at the cut that gives the lowest score, floor(1000000 a a / (l r)), ties to the smaller cut; n all words of the
    language. A phrase goes if a longer one of at least min_count holds it in half of its occurrences or more. Ranked by
    score, then a, descending, then the phrase by bytes; top limits each language's list (None: all).

    Shards of texts count their n-grams in transducers, cut at bounds of prefix ranges; a task unites a range's transducers
    and keeps what occurs min_count times; parts' counts come from composing requests with the ranges that hold them. A hot
    phrase is one path of each shard. Null text is empty, null lang is und; repeated rows count each; an empty table gives
    an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    bounds = range_bounds(docs, "text", "lang")
    n_ranges = len(bounds) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for l, texts in _shards(batches):
            for k, t in counted(l, texts, bounds):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([l]), pa.array([t.dumps()], pa.binary())], ["range", "lang", "part"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, l), rows in runs(batches, 2):
            words, path, weight = merged([Transducer.loads(b) for b in rows[0]])
            n = int(weight[path[:, 1] < 0].sum())
            path, weight = path[weight >= min_count], weight[weight >= min_count]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([l]), pa.array([n]), pa.array([_compact(words, path, weight).dumps()], pa.binary())], ["range", "lang", "words", "part"])

    shards = docs.mapInArrow(count, "range int, lang string, part binary")
    known = written(shards.repartition(n_ranges, "range").sortWithinPartitions("range", "lang").mapInArrow(unite, "range int, lang string, words long, part binary"), "phrase-ranges")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests for parts, sent to the ranges that hold them; a request of two words carries the highest count of the
        phrases that ask for it."""
        for (k, l), (part,) in runs(batches, 2):
            t = Transducer.loads(part[0])
            path, weight = t.paths()
            path, weight = path[path[:, 1] >= 0], weight[path[:, 1] >= 0]
            want: dict[tuple, int] = {}
            for row, a in zip(path.tolist(), weight.tolist(), strict=True):
                row = tuple(x for x in row if x >= 0)
                for i in range(1, len(row)):
                    for x in (row[:i], row[i:]):
                        want[x] = max(a, want.get(x, 0))
            text_ = t.words.to_pylist()
            to: dict[int, list] = {}
            for x in sorted(want):
                to.setdefault(bisect.bisect_right(bounds, (l.encode(), *(text_[i] for i in x))), []).append(x)
            for at, xs in to.items():
                p = np.array([[*x, *[-1] * (MAX_WORDS - len(x))] for x in xs], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([l]), pa.array([k], pa.int32()), pa.array([_compact(t.words, p, np.array([want[x] for x in xs])).dumps()], pa.binary())], ["range", "lang", "asks", "part"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests composed with the range that they are sent to; and, for the range itself, the highest count of a phrase
        that holds each of its phrases."""
        for (k, l), (asks, part) in runs(batches, 2):
            own = [Transducer.loads(b) for a, b in zip(asks, part, strict=True) if a < 0]
            asked = [(a, Transducer.loads(b)) for a, b in zip(asks, part, strict=True) if a >= 0]
            out = [(a, Transducer.build(t.words, p, own[0].compose(p, t.words))) for a, t in asked for p in [t.paths()[0]]] if own else []
            if asked:
                out.append((-1 - k, united([t for _, t in asked], np.maximum)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k if a < 0 else a for a, _ in out], pa.int32()), pa.array([l] * len(out)), pa.array([1 if a < 0 else 2 for a, _ in out], pa.int32()), pa.array([t.dumps() for _, t in out], pa.binary())], ["range", "lang", "kind", "part"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, l), (kinds, part) in runs(batches, 2):
            by = {k: [Transducer.loads(b) for x, b in zip(kinds, part, strict=True) if x == k] for k in (0, 1, 2)}
            if not by[0]:
                continue
            t = by[0][0]
            path, weight = t.paths()
            path, weight = path[path[:, 1] >= 0], weight[path[:, 1] >= 0]
            inside = by[1][0].compose(path, t.words) if by[1] else np.zeros(len(path), np.int64)
            text_ = t.words.to_pylist()
            parts = united(by[2]) if by[2] else None
            of = {w: i for i, w in enumerate(parts.words.to_pylist())} if parts else {}
            ids = [[of[text_[x]] for x in row if x >= 0] for row in path.tolist()]
            p = [q for row in ids for i in range(1, len(row)) for q in (row[:i], row[i:])]
            f = parts.compose(np.array([[*q, *[-1] * (MAX_WORDS - len(q))] for q in p], np.int32), parts.words).tolist() if p else []
            out, at = [], 0
            for row, a, b in zip(path.tolist(), weight.tolist(), inside.tolist(), strict=True):
                row = [x for x in row if x >= 0]
                cuts = [(1_000_000 * a * a // (f[i] * f[i + 1]), f[i], f[i + 1]) for i in range(at, at + 2 * len(row) - 2, 2)]
                at += 2 * len(row) - 2
                if 2 * b < a:
                    s, left, right = min(cuts, key=lambda x: x[0])
                    out.append((l, b" ".join(text_[x] for x in row).decode(), a, left, right, s))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), kinds_of, strict=True)] if out else [pa.array([], kind) for kind in kinds_of], ["lang", "phrase", "a", "l", "r", "score"])

    kinds_of = [pa.string(), pa.string(), *[pa.int64()] * 4]
    parts = known.select("range", "lang", "part")
    requests = parts.mapInArrow(ask, "range int, lang string, asks int, part binary")
    both = requests.unionByName(parts.withColumn("asks", F.lit(-1)))
    answers = both.repartition(n_ranges, "range").sortWithinPartitions("range", "lang", "asks").mapInArrow(answer, "range int, lang string, kind int, part binary")
    both = written(answers, "phrase-answers").unionByName(parts.withColumn("kind", F.lit(0)))
    scored = both.repartition(n_ranges, "range").sortWithinPartitions("range", "lang", "kind").mapInArrow(score, "lang string, phrase string, a long, l long, r long, score long")
    totals = known.groupBy("lang").agg(F.sum("words").alias("n"))
    scored = scored.join(totals.withColumnRenamed("lang", "its"), F.col("lang") == F.col("its")).drop("its")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # First the best of each of SALTS parts of a language, so that its last task gets a bounded number of phrases.
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return (out if top is None else out.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
