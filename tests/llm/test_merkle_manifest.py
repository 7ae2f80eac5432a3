import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from llm.conftest import long_text
from ticketlens.llm.merkle_manifest import folded, hashed, merkle_manifest

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def plain_leaf(row):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    return hashed("".join(map(field, row)))


def climb(hashes):
    """All levels of a tree."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashed("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def steps_of(levels, at):
    """(neighbour or none, whether it comes first) level by level."""
    out = []
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        out.append((run[1 - at % 2], at % 2 == 1) if len(run) == 2 else (None, False))
        at //= 2
    return out


def brute(rows, is_tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((own, climb([plain_leaf(r) for r in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    out = []
    for number, (own, levels) in enumerate(trees):
        for at, row in enumerate(own):
            steps = steps_of(levels, at) + steps_of(top, number)
            changed = (*row[:3], row[3] + 1 if row[3] is not None and is_tampered(row[0]) else row[3], row[4])
            node = plain_leaf(changed)
            for other, first in steps:
                node = hashed((other + node if first else node + other) if other else node)
            proof = hashed("".join(o for o, _ in steps if o))
            out.append((row[0], plain_leaf(row), levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def is_tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def run(spark, rows, bits=2, partitions=3):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(partitions)
    return sorted(map(tuple, merkle_manifest(docs, tampered(), bits).collect()), key=repr)


def sample(n, langs=("en", "de", None, "é", "zz")):
    return [(k * 37 % 1_000_003 - 5, f"s{k % 3}", langs[(k * k) % len(langs)], k if k % 5 else None, f"text é {k}") for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 70])
@pytest.mark.parametrize("bits", [1, 2, 12])
def test_like_a_tree_built_in_one_place(spark, n, bits):
    assert run(spark, sample(n), bits) == brute(sample(n), is_tampered)


def test_one_language_of_many_rounds(spark):
    rows = sample(65, ("en",)) + [(-9, None, "fr", None, None)]
    assert run(spark, rows, 1, 7) == brute(rows, is_tampered)


def test_the_same_for_any_partitioning(spark):
    rows = sample(50)
    assert run(spark, rows, 2, 1) == run(spark, rows, 3, 16)


def test_nulls_repeats_empty_and_long_texts(spark):
    rows = [
        (None, None, None, None, None), (None, "s", "en", 3, ""), (7, "s", "en", 3, ""), (7, "s", "en", 3, ""), (7, "s", "en", 4, "b"),
        (7, "", "", 0, "x"), (2**62 + 1, "s", "en", 2**63 - 1, long_text(1, 60_000)), (2**62 + 2, "s", "en", 1, "é😀"),
    ]
    assert run(spark, rows) == brute(rows, is_tampered)


def test_many_languages(spark):
    rows = [(k, "s", f"l{k:03d}", k, "x") for k in range(40)]
    assert run(spark, rows) == brute(rows, is_tampered)


def test_a_changed_row_is_told_from_all_others(spark):
    docs = spark.createDataFrame(sample(40), COLUMNS)
    bad = {r.doc_id for r in merkle_manifest(docs, F.col("doc_id") == 32).where("NOT verified").collect()}
    assert bad == {32}
    assert merkle_manifest(docs).where("NOT verified").count() == 0


def test_folding_uses_sides():
    a, b = hashed("a"), hashed("b")
    assert folded(a, ["R" + b]) == folded(b, ["L" + a]) == sha256((a + b).encode()).hexdigest()
    assert folded(a, [""]) == hashed(a) and folded(a, []) == a


def test_other_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "s", "en", 2, "x", "t", 3, "l")], COLUMNS + ", tree string, pos int, leaf string")
    assert tuple(merkle_manifest(docs).head())[1:4] == (plain_leaf((1, "s", "en", 2, "x")),) * 3
    assert merkle_manifest(docs.limit(0)).count() == 0
