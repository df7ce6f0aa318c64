"""Near-dedup at its limit: every pair of similarity 0.8 is linked, none below."""

import random

from .test_near_sets import chain, kept


def overlapping(rng, total, common):
    """Two texts of total shingles each that share common of them."""
    first = chain(rng, total + 4)
    return " ".join(first), " ".join(first[: common + 4] + chain(rng, total - common))


def test_both_sides_of_the_limit(spark):
    # 180 shingles, 160 of them common: 160 / 200 = 0.8 exactly; one fewer is below.
    rng, rows = random.Random(1), []
    for i in range(40):
        rows += zip((4 * i, 4 * i + 1), overlapping(rng, 180, 160), strict=True)
        rows += zip((4 * i + 2, 4 * i + 3), overlapping(rng, 180, 159), strict=True)
    assert kept(spark, rows) == {d for d, _ in rows if d % 4 != 1}
