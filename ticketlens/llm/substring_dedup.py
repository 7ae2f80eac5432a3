"""Substring dedup by Rabin-Karp hashes of all fixed-length word windows.

Blocks hold ranges of ids in order, so of all places of a window the first one is in the
lowest block that has it; the blocks above learn from the bucket that it was seen before.
Inside a block the order of the words decides. Repeated windows of a document merge into
maximal intervals of words to remove.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ticketlens.llm import blocks as B
from ticketlens.llm.common import give_back, mix64, split_words, whole_text, word_hashes

WINDOW = 20
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """Rolling polynomial hashes modulo 2**64 of all windows of a word sequence, from prefix sums."""
    n = len(hashes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
    back = _powers(pow(_BASE, -1, 1 << 64), n - window + 1)
    return mix64((sums[window:] - sums[:-window]) * back)


class _Block:
    """Windows of a block's documents, in order of id, sorted by hash."""

    def __init__(self, docs: pa.Table, window: int):
        tie = docs.append_column("_tie", pa.array([hash_of(t) for t in docs.column("text").to_pylist()], pa.int64()))
        order = pc.sort_indices(
            tie, sort_keys=[("doc_id", "ascending"), ("_tie", "ascending")], null_placement="at_start"
        )
        docs = docs.take(order)
        self.doc_id = docs.column("doc_id").combine_chunks()
        self.words, self.starts = split_words(docs.column("text"))
        self.window = window
        counts = np.diff(self.starts)
        n = len(self.words)
        if n >= window:
            place = np.arange(n - window + 1)
            end = np.repeat(self.starts[1:], counts)[: n - window + 1]
            self.place = place[place + window <= end]
        else:
            self.place = np.zeros(0, np.int64)
        if len(self.place):
            main = window_hashes(word_hashes(self.words), window)[self.place]
            tail = (window_hashes(word_hashes(self.words, 1), window)[self.place] >> np.uint64(48)).astype(np.uint16)
        else:
            main, tail = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        self.order, self.first = _grouped(main, tail, None)
        begin = np.flatnonzero(self.first)
        self.main, self.tail = main[self.order][begin], tail[self.order][begin]


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def _grouped(main: np.ndarray, tail: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and which places of it begin a new key.

    ``rank`` must not fall along the input; equal keys keep its order.
    """
    order = np.argsort(main, kind="stable")
    m, t = main[order], tail[order]
    same = m[1:] == m[:-1]
    if np.any(same & (t[1:] != t[:-1])):
        order = np.lexsort((tail, main))
        m, t = main[order], tail[order]
        same = m[1:] == m[:-1]
    first = np.ones(len(order), bool)
    first[1:] = ~(same & (t[1:] == t[:-1]))
    return order, first


def _packets(window: int, buckets: int):
    def send(key: tuple, batches: pa.Table) -> pa.Table:
        block = _Block(batches, window)
        cuts = B.bucket_cuts(block.main, buckets)
        rows = [
            (b, key[0].as_py(), int(e - a), B.squeeze_sorted(block.main[a:e]), block.tail[a:e].tobytes())
            for b, (a, e) in enumerate(zip(cuts[:-1], cuts[1:]))
            if e > a
        ]
        del block
        give_back()
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "block", "n", "main", "tail"]
        )

    return send


def _answer(key: tuple, batches: pa.Table) -> pa.Table:
    """For each packet, one bit per key: whether a lower block has the key."""
    packets = batches.sort_by("block")
    size = packets.column("n").to_numpy()
    main = np.concatenate([B.unsqueeze_sorted(x.as_py()) for x in packets.column("main")])
    tail = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in packets.column("tail")])
    order, first = _grouped(main, tail, None)
    seen = np.zeros(len(main), bool)
    seen[order] = ~first
    ends = np.cumsum(size)
    bits = [np.packbits(seen[e - n : e]).tobytes() for n, e in zip(size, ends)]
    return pa.table(
        [packets.column("block"), packets.column("bucket"), packets.column("n"), pa.array(bits, pa.binary())],
        names=["block", "bucket", "n", "seen"],
    )


def _remove(window: int):
    def cut(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, window)
        answers = answers.sort_by("bucket")
        seen = np.concatenate(
            [
                np.zeros(0, bool),
                *(
                    np.unpackbits(np.frombuffer(s.as_py(), np.uint8))[: n.as_py()].astype(bool)
                    for s, n in zip(answers.column("seen"), answers.column("n"))
                ),
            ]
        )
        # A window goes if a lower block has it, or if it isn't the first of its key here.
        group = np.cumsum(block.first) - 1
        gone = np.zeros(len(block.place), bool)
        gone[block.order] = seen[group] | ~block.first
        n = len(block.words)
        change = np.zeros(n + 1, np.int64)
        start = block.place[gone]
        np.add.at(change, start, 1)
        np.add.at(change, start + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        words = block.words.filter(pa.array(~covered)).to_pylist()
        kept = np.concatenate([[0], np.cumsum(~covered)])[block.starts]
        texts = [" ".join(words[a:b]) for a, b in zip(kept[:-1], kept[1:])]
        # Intervals end at the edge of a document, so that they never join two of them.
        edge = np.zeros(n + 1, bool)
        edge[block.starts] = True
        before = np.concatenate([[False], covered])
        after = np.concatenate([covered, [False]])
        begins = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        doc = np.searchsorted(block.starts, begins, side="right") - 1
        per_doc = np.searchsorted(doc, np.arange(len(block.doc_id) + 1))
        offset = block.starts[doc]
        spans = pa.StructArray.from_arrays(
            [pa.array(begins - offset), pa.array(ends - offset)], names=["start", "end"]
        )
        counts = np.diff(block.starts)
        return pa.table(
            [
                block.doc_id,
                pa.array(counts),
                pa.array(counts - np.diff(kept)),
                pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), spans),
                pa.array(texts, pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
        )

    return cut


def substring_dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed intervals, kept_text.

    A window is ``window`` consecutive words; a word goes if a window over it has the words
    of an earlier window, by id and then place. Intervals are word numbers, end exclusive,
    and maximal. Kept words are joined by one space. Null and empty texts have no words,
    texts shorter than a window lose none. Rows with null id come first; rows with the same
    id follow each other by a hash of their text, so all but one of equal rows lose what
    windows cover. An empty table gives no rows.

    Keys are 80 bits of two rolling hashes: with n windows the chance that any two
    different ones meet is about n * n / 2**81.
    """
    blocks = B.block_count(docs, block_bytes)
    placed = docs.select("doc_id", whole_text().alias("text")).withColumn("block", B.ordered_block(docs, blocks))
    packets = placed.groupBy("block").applyInArrow(
        _packets(window, B.bucket_count(blocks)), "bucket bigint, block bigint, n bigint, main binary, tail binary"
    )
    answers = packets.groupBy("bucket").applyInArrow(_answer, "block bigint, bucket bigint, n bigint, seen binary")
    return (
        placed.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _remove(window),
            "doc_id bigint, n_words bigint, n_removed bigint, "
            "removed array<struct<start: bigint, end: bigint>>, kept_text string",
        )
    )
