import random

import pytest

BASE = "doc_id long, text string, lang string, n_tokens string, score string, spans string, n_lines string, ids string, kept string, media string, bin string, v string"
CLASH = ("n_tokens", "score", "spans", "n_lines", "ids", "kept", "media", "bin", "v")


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text), with columns whose names clash with those of the operators."""

    def make(rows, partitions=3):
        full = [(i, t, "en", *CLASH) for i, t in rows]
        return spark.createDataFrame(full, BASE).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd():
    """Rows with nulls, empty, blank, very long, repeated and tied texts."""
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "é", "中文字", "x1", "don't"]
    long_ = " ".join(r.choice(words) for _ in range(60_000))
    prose = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(9))
    return [(1, None), (2, ""), (3, " \t\n "), (4, long_), (5, prose), (5, prose), (6, prose), (None, "lonely text of a row without an id"), (None, None), (7, "a" * 5000), (8, "😀   line\r\nline\r\nline\r\nline"), (9, "one two")]
