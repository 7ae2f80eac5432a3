import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.conftest import long_text, words
from ticketlens.llm import filter_audit as audit

DOCS = "doc_id bigint, source string, text string, part string, mask int, least int, n int"
LABELS = "doc_id bigint, quality int, toxic int, n int, part string"


def fails(rows):
    out = []
    for doc_id, _, text in rows:
        text = text or ""
        w = words(text)
        bad = set()
        if len(w) < 200:
            bad.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            bad.add("C")
        if re.search(r"[#$%&*|]", text):
            bad.add("D")
        if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, _, t in rows):
            bad.add("E")
        out.append(bad)
    return out


def brute(rows, labels):
    bad = fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, s, _ in rows}:
        own = [(i, b) for (i, s, _), b in zip(rows, bad) if (s or "") == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, b) for i, b in left if letter in b]
                left = [(i, b) for i, b in left if letter not in b]
                failing = sum(letter in b for _, b in own)
                shares[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(b == {letter} for _, b in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shares[row[-1]]
    return out


def run(spark, rows, labels, partitions=3):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS).repartition(partitions)
    marked = spark.createDataFrame([(*r, 9, "y") for r in labels], LABELS)
    return {(r[0], r[1], r[2]): list(r[3:]) for r in audit.filter_audit(docs, marked).collect()}


LONG = long_text(3, 400)
TEXTS = [None, "", "few words", LONG, LONG + " # mark", LONG + " ABCDEFGH" * 20, "ab cd " * 150, "AB # " * 150, LONG + "\n", long_text(5, 20_000)]


def corpus(n=60):
    return [(k, [f"s{k % 3}", None, ""][k % 3 if k % 7 else 1], TEXTS[(k * k + k // 7) % len(TEXTS)]) for k in range(n)]


def test_like_running_every_order(spark):
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 60, 2)] + [(3, 0, 1), (3, 1, 0), (9, None, None), (None, 1, 1), (999, 1, 1)]
    assert run(spark, corpus(), labels) == brute(corpus(), labels)


def test_null_and_repeated_ids_and_equal_rows(spark):
    rows = [(None, "s", LONG), (None, "s", LONG), (1, "s", LONG), (1, "s", LONG), (1, "s", "x"), (2, "t", LONG), (2, "t", None), (2, "t", "")]
    labels = [(1, 1, 0), (None, 1, 1), (2, 0, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_no_rows_no_labels_and_rows_of_zeros(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    got = run(spark, [(1, "s", long_text(1, 300))], [])
    assert len(got) == 600 and all(row == [1, 0, 0, 0, 0, 0, 0] for row in got.values())


def test_hot_and_rare_texts_are_marked_alike(spark, monkeypatch):
    rows = [(k, "s", LONG if k % 3 == 0 else f"w{k // 2}") for k in range(90)]
    want = brute(rows, [])
    for share in (1, 4, 10**6):
        monkeypatch.setattr(audit, "HOT_SHARE", share)
        assert run(spark, rows, []) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.integers(0, 50), min_size=1 << n, max_size=1 << n)))
def test_least_squares_give_the_mean_over_all_orders(counts):
    removals = audit.coalition_removals(counts)
    n = len(counts).bit_length() - 1
    mean = [Fraction(0)] * n
    orders = list(permutations(range(n)))
    for order in orders:
        before = 0
        for bit in order:
            mean[bit] += Fraction(removals[before | 1 << bit] - removals[before], len(orders))
            before |= 1 << bit
    assert audit.shapley_values(removals) == mean


@pytest.mark.parametrize("filters", [{"X": "length(text) > 3"}, {}])
def test_filters_of_ones_own(spark, filters):
    docs = spark.createDataFrame([(1, "s", "abcd"), (2, "s", "ab"), (3, "s", "ab")], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([], LABELS)
    got = {(r.filter_order, r.step): r.removed for r in audit.filter_audit(docs, labels, filters).collect()}
    assert got == ({("XE", 1): 1, ("XE", 2): 1, ("EX", 1): 1, ("EX", 2): 1} if filters else {("E", 1): 1})
