import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlens.llm.exact_dedup import QuotientFilter, drop_copies, exact_dedup

SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in SPACES)].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0]))
        left = 1
        for i, n in sorted(members):
            kept = (i, n) == keep and left > 0
            left -= kept
            out.append((i, keep[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 9)), max_size=200), st.integers(0, 3))
@settings(max_examples=50, deadline=None)
def test_quotient_filter_keeps_every_fingerprint_and_count(pairs, bits):
    segment = (1 << bits) - 1
    inside = [((x >> bits) | (segment << (64 - bits)), c) for x, c in pairs] if bits else pairs
    want = defaultdict(int)
    for x, c in inside:
        want[x] += c
    made = QuotientFilter.of(np.array([x for x, _ in inside], np.uint64), np.array([c for _, c in inside], np.int64))
    back = QuotientFilter.from_bytes(made.to_bytes(bits), segment)
    assert dict(zip(back.fingerprints.tolist(), back.counts.tolist())) == dict(want)


def test_filters_merge_like_counters():
    a = QuotientFilter.of(np.array([1, 5, 5, 9], np.uint64))
    b = QuotientFilter.of(np.array([5, 9, 2**64 - 1], np.uint64))
    m = a.merge(b)
    assert dict(zip(m.fingerprints.tolist(), m.counts.tolist())) == {1: 1, 5: 3, 9: 2, 2**64 - 1: 1}


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\r"), (7, "x" * 300_000), (8, "x " * 300_000),
    (9, "ü "), (10, "ü"), (11, "A b"), (3, "a  b"), (12, "ab"), (13, "solo"),
]


def test_agrees_with_brute_force(documents):
    got = sorted(tuple(r) for r in exact_dedup(documents(*ROWS)).collect())
    assert got == brute(ROWS)


@pytest.mark.parametrize("copies", [600])
def test_hot_group_keeps_one(documents, copies):
    rows = [(i, "same text") for i in range(copies)] + [(copies + i, f"other {i}") for i in range(copies)]
    got = exact_dedup(documents(*rows, partitions=5)).where("kept").collect()
    assert sorted(r.doc_id for r in got) == [0, *range(copies, 2 * copies)]


def test_kept_rows_keep_their_columns(documents):
    docs = documents(*ROWS)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, _, _, k, _ in brute(ROWS) if k)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_null_ids_and_no_rows(documents):
    got = exact_dedup(documents((None, "a"), (2, "a"), (None, "b"))).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 2, False), (2, 2, True)]
    assert exact_dedup(documents((1, "a")).limit(0)).count() == 0
    assert drop_copies(documents((1, "a")).limit(0)).count() == 0
