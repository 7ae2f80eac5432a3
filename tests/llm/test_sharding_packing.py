import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm.conftest import long_text
from ticketlens.llm import packing, sharding
from ticketlens.llm.registry import word_vocabulary


@given(st.integers(1, 5_000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_feistel_permutes_every_domain(rows, seed):
    got = sharding.permute(np.arange(rows), rows, seed)
    assert sorted(got.tolist()) == list(range(rows))


def shard_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shards_are_even_gapless_and_repeatable(documents):
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(1_000)] + [(None, None), (5, "text 5"), (5, "text 5")]
    got = shard_rows(sharding.assign_shards(documents(*rows, partitions=7), 24))
    assert got == shard_rows(sharding.assign_shards(documents(*rows, partitions=2), 24))
    slots = defaultdict(list)
    for doc_id, size, crc, law, shard, slot, grown in got:
        assert law == "rows" and grown is None
        slots[shard].append(slot)
    assert set(slots) == set(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    facts = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted((r[:3] for r in got), key=str) == facts


def test_few_and_no_rows(documents):
    assert sharding.assign_shards(documents((1, "a")).limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.assign_shards(documents((1, "a"))).collect()] == [(0, 0)]


def test_written_shards_hold_all_columns(spark, documents, tmp_path):
    docs = documents(*[(i, f"t{i}") for i in range(50)])
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r.document.doc_id for r in back.collect()) == list(range(50))
    assert back.select("document.*").columns == docs.columns


# -- packing -------------------------------------------------------------------------


def bins_of(lengths, bins):
    out = defaultdict(int)
    for length, b in zip(lengths, bins):
        out[b] += length
    return out


@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_bound_never_exceeds_the_optimum(lengths):
    lengths = np.array(lengths)

    def fits(bins):
        def place(k, left):
            if k == len(lengths):
                return True
            tried = set()
            for b in range(bins):
                if left[b] >= lengths[k] and left[b] not in tried:
                    tried.add(left[b])
                    left[b] -= lengths[k]
                    if place(k + 1, left):
                        return True
                    left[b] += lengths[k]
            return False

        return place(0, [60] * bins)

    optimum = next(b for b in range(1, 10) if fits(b))
    assert packing.lower_bound(lengths, 60) <= optimum
    found = bins_of(lengths, packing.best_fit_decreasing(lengths, 60))
    assert max(found.values()) <= 60 and len(found) >= optimum


def test_bound_sees_more_than_the_sum():
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    assert packing.lower_bound(np.array([]), 100) == 0


def test_ids_are_those_of_whole_texts():
    whole, words = Tokenizer.from_file(word_vocabulary()), packing.WordTokenizer(word_vocabulary())
    draw = random.Random(3)
    alphabet = "abcXYZé  \n\x01\x00́,.;!?'#$%&*<|>-_09ßİſΣ\xa0\x85\x1c日本🙂‍\"()="
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(2_000)]
    texts += ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>.", "don't can't I'll, ,'s a.'s b;'ll", "\x01 \x01\x01 a\x01", ""]
    ids, begins = words.encode(pa.array(texts))
    for a, b, text in zip(begins[:-1], begins[1:], texts):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.fixture
def small_partitions(monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 40)


def test_packing_is_an_exact_round_trip(documents, small_partitions):
    whole = Tokenizer.from_file(word_vocabulary())
    rows = [(i, long_text(i, 5 + 37 * (i % 23))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, long_text(1, 9_000)), (None, "no id"), (3, "again"), (3, "again")]
    packed = packing.best_fit_packing(documents(*rows), word_vocabulary()).collect()
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(whole.encode(text or "", add_special_tokens=False).ids + [1])
    for i, texts in want.items():
        expected = [
            (number, start, len(ids[start : start + 4096]), zlib.crc32(np.array(ids[start : start + 4096], "<u4").tobytes()))
            for ids in texts
            for number, start in enumerate(range(0, len(ids), 4096))
        ]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == sorted(expected)
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = np.array([r.length for r in packed])
    in_one_partition = int(packing.best_fit_decreasing(lengths).max()) + 1
    assert packing.lower_bound(lengths) <= len(by_sequence) <= in_one_partition + 2
    assert packing.best_fit_packing(documents((1, "a")).limit(0), word_vocabulary()).count() == 0


@pytest.fixture
def pieces(spark):
    return lambda lengths: spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECES)


def test_a_gap_to_the_bound_triggers_packing_again(pieces):
    lengths = [4, 4, 3, 3, 3, 3]
    assert max(packing.best_fit_decreasing(np.array(lengths), 10)) + 1 == 3
    got = packing.pack_pieces(pieces(lengths), 10).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    assert len({r.sequence_id for r in got}) == 2
    assert all(r.certified and r.gap == 0 for r in got)


def test_certified_partitions_stay_as_they_are(pieces, small_partitions):
    # Half empty sequences, but no packing has fewer.
    got = packing.pack_pieces(pieces([51] * 200), 100).collect()
    assert len({r.sequence_id for r in got}) == 200
    assert {r.sequence_id >> 50 for r in got} == {1}
    assert all(r.certified for r in got)


def test_a_gap_that_stays_is_told(pieces):
    # Three sequences are the optimum, the bound says two.
    got = packing.pack_pieces(pieces([3, 3, 3, 3, 3]), 8).collect()
    opened, bound = len({r.sequence_id for r in got}), packing.lower_bound(np.array([3] * 5), 8)
    assert {(r.certified, r.gap) for r in got} == {(opened == bound, opened - bound)}
