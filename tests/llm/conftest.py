import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return documents.collect()


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source)."""

    def build(rows):
        full = [(*row, None, None)[:4] for row in rows]
        return spark.createDataFrame([(*row, len(row[1] or "")) for row in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns
    that are named like columns of the operators."""
    long_text = "\n".join(f"Line {i} of a very long text, with words." for i in range(6000))
    copy = "The same words again, in the same order.\nOn two lines, as it happens."
    rows = [
        (1, "Plain words in a row.", "en", "a", 21),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, copy, "en", None, 60),
        (5, copy, "de", "b", 60),
        (5, copy, "de", "b", 60),
        (6, long_text, "en", "b", len(long_text)),
        (None, "No id here.", "en", "a", 11),
        (None, None, None, None, None),
        (7, "   \n\t \n\n", "en", "c", 8),
        (8, "1234 5678 !!! ###", "en", "c", 17),
        (9, "É <|endoftext|> ΑΣ \x1c 😊", "fr", "c", 22),
        (10, copy.upper(), "de", "b", 60),
    ]
    names = "key print place part row run size member members digest keep_id kept lang_pred score line_dedup kept_id doc text_ rank turn label"
    extra = ", ".join(f"{name} string" for name in names.split())
    filler = tuple("x" for _ in names.split())
    return spark.createDataFrame([row + filler for row in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
