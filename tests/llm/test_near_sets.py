"""Near-dedup against brute force: every near pair is linked, by every path."""

import random
from fractions import Fraction

import numpy as np
import pytest
from itemloom.llm import nearsets, simhash


def chain(rng, n):
    """n words, no two alike."""
    return [f"w{rng.getrandbits(60):x}" for _ in range(n)]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.near_dedup(df).collect()}


@pytest.mark.parametrize("hot", [256, 8])
def test_random_sets_against_brute_force(spark, monkeypatch, hot):
    # Hot shingles, keys of several shards and chains of links: small limits bring every path into play.
    monkeypatch.setattr(nearsets, "HOT", hot)
    monkeypatch.setattr(nearsets, "ALL_PAIRS", 6)
    monkeypatch.setattr(nearsets.links_within, "__defaults__", (16,))
    rng, texts = random.Random(5), []
    for _ in range(6):
        w = chain(rng, 80)
        for _ in range(40):
            v = list(w)
            for _ in range(rng.randrange(1, 5)):
                v[rng.randrange(80)] = f"e{rng.randrange(3)}"
            texts.append(" ".join(v))
    sets = [nearsets.shingle_set(t, 5) for t in texts]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if Fraction(both, len(sets[a]) + len(sets[b]) - both) >= Fraction(4, 5) and up[a] != up[b]:
                lo, hi = sorted((up[a], up[b]))
                up = [lo if x == hi else x for x in up]
    assert kept(spark, list(enumerate(texts))) == set(up)
