"""Near-dedup measures sets: repeated lines count once."""

import random

from .test_near_sets import chain, kept


def test_repeated_line_does_not_merge(spark):
    # A line that fills 40 % of two texts without another common shingle weighs as one line.
    rng, line, rows = random.Random(2), " ".join(chain(random.Random(9), 10)), []
    for i in range(20):
        rows.append((i, "\n".join([" ".join(chain(rng, 600)), *[line] * 40])))
    assert kept(spark, rows) == set(range(20))
