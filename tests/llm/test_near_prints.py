"""Near-dedup goes by fingerprints in BK-trees: what they propose, and that the stage asks them."""

import random

import numpy as np
from itemloom.llm import nearsets, simhash

from .test_near_sets import chain, kept


def edited(rng):
    """Texts of 600 words, each with three copies of one more edit at their end; a line repeated often counts once."""
    line = " ".join(chain(rng, 8))
    rows = []
    for _ in range(12):
        w = chain(rng, 600)
        for k in range(4):
            rows.append(" ".join(w[: 600 - k]) + f"\n{line}" * 30)
    return rows


def test_trees_propose_what_differs_in_few_bits(spark):
    texts = edited(random.Random(4))
    fps = [int.from_bytes(simhash.simhash(nearsets.shingle_set(t, 5)), "big") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    got = [(r.a, r.b) for r in nearsets.fingerprint_pairs(df, 5).collect()]
    near = np.array([(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= nearsets.RADIUS])
    top = lambda pairs: simhash.forest(len(fps), *np.array(pairs).T)
    assert len(near) > 12 and top(got) == top(near) and all(a < b for a, b in got)


def test_near_dedup_asks_the_trees(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(nearsets, "near_edges", lambda points, *a: asked.append(points.count()) or simhash.near_edges(points, *a))
    texts = edited(random.Random(4))
    assert kept(spark, list(enumerate(texts))) == set(range(0, 48, 4)) and asked and asked[0] > 12
