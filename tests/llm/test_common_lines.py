"""A line in more than twenty distinct documents of one host is boilerplate, whatever the documents are like."""

import random

from itemloom.llm import quality
from pyspark.sql import functions as F


def words(rng, n):
    return [f"w{rng.getrandbits(60):x}" for _ in range(n)]


def test_pages_of_one_length(spark):
    rng, rows = random.Random(4), []
    base = words(rng, 90)
    for i in range(30):
        rows.append((i, " ".join(words(rng, 90)) + "\nall rights reserved by us", "host"))
    for i in range(30, 60):
        w = list(base)
        w[rng.randrange(90)] = f"edit{i}"
        rows.append((i, " ".join(w) + "\na line that the copies share", "copies"))
    rows += [(60 + i, " ".join(words(rng, 90)) + "\nin twenty texts", None) for i in range(20)]
    rows += [(80 + i, " ".join(words(rng, 90)) + "\nin more than twenty", None) for i in range(21)]
    # Repeated rows are one document, exact copies under their own ids are not, unless texts are what counts.
    rows += [(101, rows[60][1].replace("twenty", "copies"), "same")] * 30
    rows += [(102 + i, rows[61][1], "equal") for i in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r.doc_id, r.removed_words, r.kept) for r in quality.quality(df).collect()]
    assert len(got) == len(rows) and set(got) == {(i, 93 if i > 101 else 5 if i < 30 else 6 if i < 60 else 4 if 80 <= i < 101 else 0, i <= 101) for i in range(123)}
    got = {(r.doc_id, r.removed_words) for r in quality.quality(df, document=F.xxhash64("text")).collect() if r.doc_id > 100}
    assert got == {(i, 0) for i in range(101, 123)}
