"""Phrases, repeated substrings and hard negatives against brute force, on planted, odd and empty tables."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from itemloom.llm import negatives, phrases, queries, suffixes
from pyspark.sql import functions as F

from .conftest import SF

VECTORS = "vec_id long, label long, embedding array<float>"


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, at = [], 0
        for g, part in itertools.groupby(gone):
            n = len(list(part))
            if g:
                spans.append((at, at + n))
            at += n
        out.append((spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def spans(rows):
    return sorted((repr(r.doc_id), r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in rows)


def test_op12(spark, texts):
    raw = [(t or "").encode() for _, t, *_ in texts]
    want = {d: (len(t), sum(e - s for s, e in x), len(x), hashlib.sha256(k).hexdigest()) for (d, *_), t, (x, k) in zip(texts, raw, brute_removed(raw, 400), strict=True)}
    got = queries.QUERIES["op12_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(want)
    assert any(0 < n < full for full, n, *_ in want.values())


def test_cover_takes_any_two_positions_to_samples():
    inside = set(suffixes.COVER.tolist())
    assert all(any((i + k) % suffixes.PERIOD in inside and (j + k) % suffixes.PERIOD in inside for k in range(suffixes.PERIOD)) for i in range(suffixes.PERIOD) for j in range(suffixes.PERIOD))


@pytest.mark.parametrize(("block", "bucket"), [(1 << 20, 1000), (1500, 50)])
def test_repeats_at_the_length_and_one_below(spark, block, bucket):
    """Passages of 399 and 400 bytes, within and across documents, runs of one letter, overlaps, and copies of whole texts."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    ascii_ = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p400, p399, p900 = ascii_(400), ascii_(399), ascii_(900)
    docs = [word(50) + p400 + word(70), word(333) + p400, p399 + "x", "y" + p399 + "z", "a" * 1200, "b" * 401, "c" * 400, p900, p900, word(3) + p900[:650] + word(9) + p900[200:],
            p900[1:], "", None, p400 + p400, *[ascii_(20) + p900 + ascii_(20) for _ in range(12)], word(2000)]
    raw = [(t or "").encode() for t in docs]
    want = sorted((repr(i), len(t), x, k) for i, (t, (x, k)) in enumerate(zip(raw, brute_removed(raw, 400), strict=True)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(4)
    assert spans(suffixes.repeated_bytes(df, block_bytes=block, bucket=bucket).collect()) == want


def test_repeats_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    want = sorted((repr(i), len(t), x, k) for (i, t), (x, k) in zip(rows, brute_removed([t for _, t in rows], 400), strict=True))
    got = suffixes.repeated_bytes(odd)
    assert got.columns == ["doc_id", "n_bytes", "removed", "kept"] and spans(got.collect()) == want
    assert suffixes.repeated_bytes(none).collect() == []


def brute_phrases(rows, least, top):
    split = str.maketrans({c: "\n" for c in ".,;:!?\n\x0b\x0c\r"})
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in (text or "").translate(low).translate(split).split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rest = []
        for g, a in found.items():
            if any(100 * b >= 50 * a for h, b in found.items() if len(h) > len(g) and g in (h[:2], h[1:])):
                continue
            s, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rest.append((-s, -a, " ".join(g).encode(), a, c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), a, x, y, n[lang], -s) for i, (s, _, p, a, x, y) in enumerate(sorted(rest)[:top])]
    return sorted(out)


def test_phrases_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(3)
    words = ["New", "york", "City", "é", "of", "the", "a-b", "x" * 50, " "]
    rows = [(rng.choice(["en", "de", None, "en\x00"]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ", ", "\n", "  "]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = phrases.collocations(df, min_count=3, top=7)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, 3, 7)
    got = sorted(tuple(r) for r in phrases.collocations(odd, min_count=2).collect())
    assert got == brute_phrases([(r.lang, r.text) for r in odd.collect()], 2, 2000)
    assert phrases.collocations(none).collect() == []


def test_transducer_is_minimal_and_composes():
    import pyarrow as pa

    ids, words, piece = phrases.tokens(["a b c a b d. a b c x b c"])
    path, count = phrases.grams(ids, piece, len(words), len(ids))
    t = phrases.Transducer.loads(phrases.Transducer.build(words, path, count).dumps())
    again, weight = t.paths()
    assert (again == path).all() and (weight == count).all()
    text = t.words.to_pylist()
    got = {b" ".join(text[i] for i in p if i >= 0): c for p, c in zip(path.tolist(), count.tolist(), strict=True)}
    assert got[b"a b"] == 3 and got[b"b c"] == 3 and got[b"a b c"] == 2 and b"d a" not in got
    # b and c after different words lead to one state.
    assert len(t) < len(path) + 1
    asked = pa.array([b"b", b"c", b"zz"], pa.binary())
    assert t.compose(np.array([[0, 1, -1], [1, 0, -1], [2, -1, -1], [0, 1, 2]], np.int32), asked).tolist() == [3, 0, 0, 0]
    both = phrases.united([t, t])
    assert (both.paths()[1] == 2 * count).all()


def test_parts_of_a_shard_count_each_gram_once(monkeypatch):
    text = ["one two three four five six seven one two three"]
    whole = dict(_grams(phrases.counted("en", text, [])))
    monkeypatch.setattr(phrases, "MAX_WORDS", 3)
    monkeypatch.setattr(phrases, "_MOST_WORDS", 2)
    parts = Counter()
    for k, c in _grams(phrases.counted("en", text, [])):
        parts[k] += c
    assert parts == whole


def _grams(parts):
    for _, t in parts:
        w = t.words.to_pylist()
        for p, c in zip(*(x.tolist() for x in t.paths()), strict=True):
            yield tuple(w[i] for i in p if i >= 0), c


def brute_negatives(rows):
    v = [(i, l, np.floor(256 * np.array(x, np.float32).astype(float))) for i, l, x in rows if i is not None and l is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    width = max((len(x) for *_, x in v), default=0)
    v = [(i, l, np.pad(x, (0, width - len(x)))) for i, l, x in v]
    out = []
    for k, (a, l, x) in enumerate(v):
        if a % 50:
            continue
        s = sorted((-int(x @ y), j, m == l) for n, (j, m, y) in enumerate(v) if n != k)
        for p, i in [(-p, i) for p, i, same in s if same][:5]:
            some = [(-q, j) for q, j, same in s if not same and 50 * p <= -100 * q <= 95 * p][:3]
            out += [(a, i, r + 1, j, p, q) for r, (q, j) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 128])
def test_negatives_with_ties_repeats_and_odd_rows(spark, block):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(3)), (rng.integers(-3, 4, 6) / 8).tolist()) for i in range(260)]
    rows += [(50, 1, [0.5] * 6), (50, 1, [0.5] * 6), (50, 2, [0.25] * 6), *[(300 + i, 1, [0.5] * 6) for i in range(9)], *[(400 + i, 0, [0.375] * 6) for i in range(9)]]
    rows += [(None, 1, [0.5] * 6), (1000, None, [0.5] * 6), (1001, 1, None), (1002, 1, [0.5, None]), (1003, 2, [float("nan")] * 6), (1004, 2, [float("inf")] * 6), (1050, 1, []), (1051, 1, [0.5])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS + ", block string").repartition(4)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, block=block)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_hilbert_steps_to_a_neighbour():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = negatives.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_zone_bounds_hold():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-9, 9, (40, 5)).astype(float), rng.integers(-9, 9, (8, 5)).astype(float)
    least, most = negatives.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    assert (least[:, 0] <= (anchors @ rows.T).min(axis=1)).all() and (most[:, 0] >= (anchors @ rows.T).max(axis=1)).all()
