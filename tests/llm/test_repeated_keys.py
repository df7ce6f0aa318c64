"""Keys that repeat, and rows without any."""

import random

import numpy as np
import pytest
from itemloom.llm import langid, simhash


def text(rng, n=40):
    return " ".join(f"w{rng.getrandbits(40):x}" for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_of_one_key_with_two_texts(spark, seed):
    rng = random.Random(seed)
    a, b, c, d = (text(rng) for _ in range(4))
    near = a + " one more word"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, c), (4, near), (None, a), (None, a), (5, ""), (5, None), (6, " ")]
    rng.shuffle(rows)
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a), (2, b), (3, c), (3, d), (None, a), (None, a), *[tuple(r) for r in got if r.doc_id == 5]], key=repr)
    assert sum(r.doc_id == 5 for r in got) == 1


def test_sample_is_bounded_where_keys_repeat_or_are_missing(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 50)
    monkeypatch.setattr(langid, "SAMPLE_WINDOWS", 300)
    seen = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, x, y, **k: seen.append(np.bincount(y, minlength=2).tolist()))
    rng = random.Random(1)
    rows = [(7, "en", text(rng)) for _ in range(1500)] + [(i, "de", text(rng)) for i in range(500)]
    langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    rows = [(None, "en", text(rng, 200)) for _ in range(1500)] + [(None, "de", "ein kurzer Satz")] * 500
    langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert seen == [[150, 150], [50, 150]]


def test_trees_of_hot_keys_are_broadcast_in_batches(spark):
    """Equal to comparing all points, whatever fits in a batch; a tree is searched in part only."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60)
    fps = sorted({int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in rng.integers(0, 62, (12, 2))})
    points = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in enumerate(fps)], "id long, fp binary")
    keys = spark.createDataFrame([(i, i % 2) for i in range(len(fps))] + [(i, 2 + i) for i in range(len(fps))], "id long, key long")
    up = list(range(len(fps)))
    for i, x in enumerate(fps):
        for j in range(i):
            if i % 2 == j % 2 and (x ^ fps[j]).bit_count() <= 2:
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    for shard, size in ((16, 1 << 20), (16, 4000), (1000, 1)):
        roots = {r.node: r.root for r in simhash.components(simhash.near_edges(points, keys, 2, shard, size)).collect()}
        assert {i: r for i, r in enumerate(up) if up.count(r) > 1} == roots
    tree = simhash.Tree(np.array(fps, np.uint64)[:, None])
    tree.within(tree.points, 2)
    assert len(fps) < tree.visited < len(fps) ** 2 / 2
