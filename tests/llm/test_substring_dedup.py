import pytest

from llm.conftest import long_text, words
from ticketlens.llm.substring_dedup import substring_dedup


def brute(rows, window):
    seen, out = set(), []
    for i, text in rows:
        w = words(text)
        covered = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                covered[s : s + window] = [True] * window
            seen.add(key)
        spans, start = [], None
        for k, c in enumerate([*covered, False]):
            if c and start is None:
                start = k
            elif not c and start is not None:
                spans.append((start, k))
                start = None
        out.append((i, len(w), sum(covered), spans, " ".join(x for x, c in zip(w, covered) if not c)))
    return out


def result(df):
    rows = [(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept_text) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def corpus():
    shared, copy = long_text(99, 60), long_text(98, 300)
    rows = [(i, f"{long_text(i, 40)} {shared if i % 3 == 0 else ''} {long_text(i + 500, 50)}") for i in range(40)]
    rows += [(40, None), (41, ""), (42, "short text"), (43, copy), (44, copy), (45, "x " * 90), (46, "x y x\x1cy " * 30)]
    return rows + [(47, f"\t{shared}\n\n{shared}"), (48, long_text(7, 30_000))]


@pytest.mark.parametrize("block_bytes", [2_000, 1 << 20])
def test_agrees_with_brute_force(documents, block_bytes):
    rows = corpus()
    assert result(substring_dedup(documents(*rows), block_bytes=block_bytes)) == brute(rows, 20)


def test_other_windows(documents):
    rows = [(3, "a b c d"), (1, "b c d e"), (2, "c d e f a b c d")]
    assert result(substring_dedup(documents(*rows), window=3)) == brute(sorted(rows), 3)


def test_order_is_by_id_not_by_row(documents):
    text = long_text(1, 25)
    got = {r.doc_id: r.n_removed for r in substring_dedup(documents((9, text), (2, text), (5, text))).collect()}
    assert got == {2: 0, 5: 25, 9: 25}


def test_null_and_repeated_ids_and_no_rows(documents):
    text = long_text(2, 25)
    got = [(r.doc_id, r.n_removed) for r in substring_dedup(documents((None, text), (1, text), (1, text))).collect()]
    assert sorted(got, key=str) == [(1, 25), (1, 25), (None, 0)]
    assert substring_dedup(documents((1, text)).limit(0)).count() == 0
    assert substring_dedup(documents((1, None))).head().n_words == 0
