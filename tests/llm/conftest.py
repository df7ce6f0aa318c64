import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t ", "en", "a"), (4, "one two three", "de", "b"), (4, "one two three", "de", "b"),
    (None, "no id here", "en", "a"), (6, "x", "fr", None), (7, "same line\nsame line\nother\n", "en", "c"), (8, "Wörter ßind hier, señor 'quoted' it's don't", "de", "b"),
    (9, "word " * 30000, "en", "a"), (10, "a@b.co, +1 (234) 555-1234; 4111 1111 1111 1111, 1.2.3.4", "en", "a"), (11, "0123456789" * 3000, None, "z"),
    (12, "tab\there  two  spaces\r\nand\x0bmore\x1cfs nbsp　wide <|endoftext|>", "en", "é"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and an extra column with a clashing name."""
    rows = [(*r, 5, "clash") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def texts(duck):
    return duck.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()
