import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies int, size int, key string, norm string, uid long, length long, rank int, component string"
EXTRA = (1, 2, "k", "n", 3, 4, 5, "c")  # other columns, under names that the operators use themselves


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(3)
    words = [f"word{k}" for k in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(60))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1),
        (3, base + " more", "en", "b", None), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n", "de", None, 3),
        (7, long, "en", "a", len(long)), (8, long + " x", "en", None, 1), (9, "x" * 50_000, "fr", "c", 50_000),
        (None, base, "en", "a", 1), (None, None, None, None, None), (None, "only without id", "en", "a", 2),
        (10, "Ein  Satz\nmit\tRaum", "de", "c", 5), (11, "Ein Satz mit Raum", "de", "c", 5), (12, "9 8 7 !!", None, "c", 4), (13, "A b É", "fr", "a", 3),
    ]
    return spark.createDataFrame([r + EXTRA for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
