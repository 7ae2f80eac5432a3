import re

import pytest

#: Columns of the documents table, and some that clash with names inside the operators.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, norm string, fp int, block string, _place string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (id, text) pairs, with further columns."""

    def make(*rows, partitions=3):
        data = [(i, t, "en", "src", 7, "n", 1, "b", "p") for i, t in rows]
        return spark.createDataFrame(data, SCHEMA).repartition(partitions)

    return make


def long_text(seed, n, vocabulary=50_000):
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{(state >> 33) % vocabulary}")
    return " ".join(out)
