from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.conftest import LOWER, long_text, words
from ticketlens.llm.components import components
from ticketlens.llm.ngram_join import keep_one_of_each, ngram_jaccard_join, parity_sketch


def sets_of(rows, size):
    out = {}
    for i, text in rows:
        w = words((text or "").translate(LOWER))
        k = min(size, len(w))
        out[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if w else set()
    return out


def brute(rows, size=4, percent=85):
    sets = sets_of(rows, size)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in having[s])
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            having[s].append(i)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def changed(text, every, seed):
    w = text.split()
    for k in range(seed % every, len(w), every):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


def corpus():
    rows = [(i, long_text(i, 30 + 7 * i)) for i in range(1, 20)]
    rows += [(100 + i, changed(long_text(5, 400), 60 + 9 * i, i)) for i in range(30)]
    rows += [(200 + i, changed(long_text(6, 120), 80, i)) for i in range(25)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one  TWO"), (305, "one two three")]
    rows += [(306, long_text(5, 400).upper()), (307, long_text(9, 20_000)), (308, long_text(9, 20_000) + " more")]
    # Chains: neighbours link, ends don't.
    base = long_text(77, 200).split()
    return rows + [(400 + i, " ".join(base[6 * i : 6 * i + 100])) for i in range(12)]


@pytest.mark.parametrize("block_bytes", [20_000, 1 << 20])
def test_agrees_with_brute_force(documents, block_bytes):
    rows = corpus()
    got = ngram_jaccard_join(documents(*rows), block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (2, 100), (1, 50)])
def test_other_sizes_and_thresholds(documents, size, percent):
    rows = corpus()
    got = ngram_jaccard_join(documents(*rows), size, percent).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, size, percent)


def test_one_of_each_group_stays(documents):
    rows = corpus()
    docs = documents(*rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root for _, _, root in brute(rows, 5, 80)})


def test_null_and_repeated_ids_and_no_rows(documents):
    docs = documents((None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "z y x"), (None, None))
    got = sorted((tuple(r) for r in ngram_jaccard_join(docs).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)], key=str)
    assert ngram_jaccard_join(docs.limit(0)).count() == 0


def test_one_id_with_several_texts(documents):
    one, two, three = long_text(1, 200), long_text(2, 200), long_text(3, 200)
    near = f"{one} more"
    rows = [(3, one), (7, two), (7, near), (7, three), (9, f"{three} more"), (9, long_text(4, 50)), (3, f"{one} again")]
    docs = documents(*rows)
    got = sorted(tuple(r) for r in ngram_jaccard_join(docs).collect())
    assert got == sorted([(3, 197, 3), (7, 197, 7), (7, 198, 3), (7, 197, 7), (9, 198, 7), (9, 47, 9), (3, 198, 3)])
    kept = sorted((r.doc_id, r.text) for r in keep_one_of_each(docs).collect())
    left = [r for r in kept if r[0] != 3]
    assert left == sorted([(7, two), (7, three), (9, long_text(4, 50))])
    assert len(kept) == len(left) + 1


@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=60, deadline=None)
def test_sketches_differ_no_more_than_sets(a, b):
    x, y = (parity_sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
    apart = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y))
    assert apart <= len(a ^ b)


@pytest.mark.parametrize("short_list", [0, 10**6])
def test_components_in_rounds_and_in_one_task(spark, short_list):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(30)] + [(7, 7), (205, 201), (201, 203)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), short_list).collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {205: 201, 201: 201, 203: 201}
    assert got == want


def test_each_pair_is_verified_once(documents, monkeypatch):
    """Near copies that mostly do not link, so that all pairs are left for the last round."""
    import ticketlens.llm.ngram_join as join

    seen = []
    verified = join._verified

    def counting(pairs, sets, percent):
        seen.append([tuple(r) for r in pairs.select("a", "b").collect()])
        return verified(pairs, sets, percent)

    monkeypatch.setattr(join, "_verified", counting)
    # A common part of 270 words and an end of one's own, just too long to link.
    rows = [(i, long_text(11, 270) + " " + " ".join(f"own{i}x{k}" for k in range(26 - i % 7 // 6 * 20))) for i in range(40)]
    got = ngram_jaccard_join(documents(*rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    pairs = [p for turn in seen for p in turn]
    assert len(seen) > 1 and all(a < b for a, b in pairs), [len(turn) for turn in seen]
    assert len(pairs) == len(set(pairs))


def test_pairs_across_components_meet_hardly_more_than_once(documents, monkeypatch):
    """Near copies that do not link share most frequent shingles of their prefixes, and few rare ones."""
    import ticketlens.llm.ngram_join as join

    entries = []
    open_pairs = join._open_pairs

    def seen(rows, percent):
        entries.append(rows)
        return open_pairs(rows, percent)

    monkeypatch.setattr(join, "_open_pairs", seen)
    # A common part, some words of one's own, and a passage that is in one other text: the rarest shared shingles.
    passages = [" ".join(f"rare{i}x{k}" for k in range(12)) for i in range(20)]
    rows = [(i, f"{long_text(11, 270)} {' '.join(f'own{i}x{k}' for k in range(14))} {passages[i]}") for i in range(20)]
    rows += [(100 + i, f"{passages[i]} {long_text(500 + i, 50)}") for i in range(20)]
    got = ngram_jaccard_join(documents(*rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    left, right = entries[0].alias("a"), entries[0].alias("b")
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a.doc") < F.col("b.doc")) & (F.col("a.root") != F.col("b.root"))
    met = left.join(right, same).select(
        F.col("a.doc").alias("a"), F.col("b.doc").alias("b"), F.arrays_overlap("a.earlier", "b.earlier").alias("passed")
    )
    by_pair = met.groupBy("a", "b").agg(F.count("*").alias("tokens"), F.count_if(~F.col("passed")).alias("meetings"))
    tokens, meetings, least, pairs = by_pair.agg(F.sum("tokens"), F.sum("meetings"), F.min("meetings"), F.count("*")).head()
    assert tokens > 4 * pairs and least >= 1 and meetings < 2 * pairs
