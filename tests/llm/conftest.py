import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, a clashing extra column."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    prose = " ".join(f"word{i * 7 % 31}a{i}" for i in range(160))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 3), (4, prose, "en", "a", 1), (5, prose, "en", None, 1),
            (5, prose, "en", None, 1), (None, prose + " end", "de", "b", 1), (6, long, "de", "b", 1), (7, long + " tail", "de", "b", 1),
            (8, "one two", "fr", "b", 1), (9, "one two", "fr", "c", 1), (10, "é ü + 12 @ #", "fr", "c", 1), (11, "line one\nline one\nline one", None, "c", 1)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCUMENTS).withColumns({"kept": F.lit("mine"), "slot": F.lit(1), "size": F.lit("s"), "spans": F.lit(0), "digest": F.lit("d")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
