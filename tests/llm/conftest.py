import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, bucket int, name string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns that clash with inner names."""

    def f(rows):
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 1, "n") for i, t in rows], SCHEMA)

    return f


PASSAGE = " ".join(f"word{i}" for i in range(70))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a very long text, copies, near copies, shared passages, odd spaces."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b\tc"), (5, "abc"), (6, "a  bc"), (7, "a b c "),
        (8, PASSAGE), (9, "Start here. " + PASSAGE + " and an end"), (10, PASSAGE.upper()), (11, "é" * 150), (12, "x" + "é" * 150),
        (13, long), (14, long[: len(long) // 2]), (15, "ab" * 400), (16, "ab " * 400), (17, PASSAGE + " " + PASSAGE), (18, "tail " + PASSAGE[50:]), (19, "\x1c   x"),
    ]
