"""Benchmark decontamination by size-partitioned containment MinHash.

Test items are short and documents long, so the MinHash of a whole document says little
about an item inside it. Only items are sketched: an item's sketch is its smallest shingle
hashes, and the share of them that a document has estimates containment, whatever the
document's length. Items are partitioned by size; a partition's sketch size follows from its
sizes. Documents that hit a sketch are verified by exact shingle containment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import in_pieces, keep, lower_ascii, packed, shingle_hashes, split_words, unpacked, whole_text, word_hashes
from ticketlens.session import stage

SHINGLE = 5
CONTAINMENT = 0.8
#: Chance that a contained item of a large partition hits no hash of its sketch.
MISS = 1e-9
#: Bytes of item text up to which the items go to every task; beyond it sketches are joined.
BROADCAST_BYTES = 8 << 20


def sketch_size(shingles: int, containment: float = CONTAINMENT) -> int:
    """Hashes of an item's sketch, by the largest size of its partition (a power of two).

    A document that contains the item lacks at most its share beyond ``containment``, so
    one hash more than that certainly hits; for large items a few suffice but for ``MISS``.
    """
    largest = 1 << max(0, math.ceil(math.log2(max(1, shingles))))
    certain = largest - math.ceil(containment * largest - 1e-9) + 1
    return min(certain, math.ceil(math.log(MISS) / math.log(1 - containment)))


def _word_lists(texts: pa.Array) -> list[list[str]]:
    words, starts = split_words(lower_ascii(texts))
    words = words.to_pylist()
    return [words[a:b] for a, b in zip(starts[:-1], starts[1:])]


def _shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def item_sketch(words: list[str], size: int, containment: float) -> tuple[int, set[tuple[str, ...]], np.ndarray]:
    """Shingle length (shorter for an item of fewer words), shingles and sketch of an item."""
    size = min(size, len(words))
    if not words:
        return 0, set(), np.zeros(0, np.uint64)
    hashes, _ = shingle_hashes(word_hashes(pa.array(words)), np.array([0, len(words)]), size)
    hashes = np.unique(hashes)
    return size, _shingles(words, size), hashes[: sketch_size(len(hashes), containment)]


@dataclass
class _Items:
    """Items of a task, by the shingle length they need."""

    ids: list
    sizes: list[int]
    shingles: list[set[tuple[str, ...]]]
    sketches: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: pa.Array, size: int, containment: float) -> _Items:
        parts = [item_sketch(words, size, containment) for words in _word_lists(texts)]
        return cls(ids, *map(list, zip(*parts))) if parts else cls([], [], [], [])

    def lookup(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per shingle length, the sorted sketch hashes and the item of each."""
        out = {}
        for size in set(self.sizes) - {0}:
            own = [i for i, s in enumerate(self.sizes) if s == size]
            hashes = np.concatenate([self.sketches[i] for i in own])
            item = np.repeat(own, [len(self.sketches[i]) for i in own])
            order = np.argsort(hashes, kind="stable")
            out[size] = hashes[order], item[order]
        return out


def _long_shingles(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and document numbers, without documents that are shorter than a shingle."""
    found, begins = shingle_hashes(hashes, starts, size)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(begins))
    enough = (np.diff(starts) >= size)[doc]
    return found[enough], doc[enough]


def _matches(items: _Items, lookup: dict, texts: pa.Array, containment: float) -> list[tuple[int, int, int, int]]:
    """(document, item, shared, all) of the texts' verified matches."""
    words, starts = split_words(lower_ascii(texts))
    hashes = word_hashes(words)
    candidates = set()
    for size, (sketch, item) in lookup.items():
        found, doc = _long_shingles(hashes, starts, size)
        a, b = np.searchsorted(sketch, found, "left"), np.searchsorted(sketch, found, "right")
        for k in np.flatnonzero(b > a):
            candidates.update((int(doc[k]), int(i)) for i in item[a[k] : b[k]])
    out, sets = [], {}
    for doc, i in sorted(candidates):
        size = items.sizes[i]
        if (doc, size) not in sets:
            own = words.slice(starts[doc], starts[doc + 1] - starts[doc]).to_pylist()
            sets = {(doc, size): _shingles(own, size), **{k: v for k, v in sets.items() if k[0] == doc}}
        shared, total = len(items.shingles[i] & sets[doc, size]), len(items.shingles[i])
        if shared >= containment * total - 1e-9:
            out.append((doc, i, shared, total))
    return out


FOUND = "doc_id bigint, item_id bigint, shared bigint, item_shingles bigint, containment double"


def _small(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0) <= BROADCAST_BYTES


def _in_tasks(items: DataFrame, size: int, containment: float):
    """All items as one broadcast value, and what reads it in a task; only if ``_small``."""
    table = items.select("item_id", "text").toArrow()
    sent = items.sparkSession.sparkContext.broadcast((table.column("item_id").to_pylist(), table.column("text").to_pylist()))

    def load() -> tuple[_Items, dict]:
        ids, texts = sent.value
        own = _Items.of(ids, pa.array(texts, pa.string()), size, containment)
        return own, own.lookup()

    return load


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[]] * 4
    doc, item, shared, total = (pa.array(c, pa.int64()) for c in columns)
    ratio = pa.array([s / t for s, t in zip(columns[2], columns[3])], pa.float64())
    return pa.RecordBatch.from_arrays([doc, item, shared, total, ratio], ["doc_id", "item_id", "shared", "item_shingles", "containment"])


def find_contaminated(
    docs: DataFrame, items: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT, joined: bool | None = None
) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, shared, item_shingles, containment.

    A document contains an item if it has at least ``containment`` of the item's distinct
    ``size``-word shingles (A-Z in lower case, words are runs without white space). An item
    of fewer words has its whole word sequence as its only shingle. Null and empty items are
    contained in nothing, null and empty documents contain nothing. Null ids are carried
    along, repeated rows give repeated results, no rows on either side give none.

    ``joined`` forces (or forbids) the search by joins that a large item table takes.
    """
    if joined is None:
        joined = not _small(items)
    if joined:
        return _find_by_joins(docs, items, size, containment)
    load = _in_tasks(items, size, containment)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lookup = load()
        for batch in in_pieces(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            found = _matches(own, lookup, batch.column("text"), containment)
            yield _rows([(ids[doc], own.ids[i], shared, total) for doc, i, shared, total in found])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(search, FOUND)


def _find_by_joins(docs: DataFrame, items: DataFrame, size: int, containment: float) -> DataFrame:
    """The same search, with sketches and documents joined on shingle hashes."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Items.of(batch.column("item").to_pylist(), batch.column("text"), size, containment)
            rows = [(i, s, h) for i, s, hs in zip(own.ids, own.sizes, own.sketches) for h in hs.view(np.int64).tolist()]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], ["item", "size", "hash"]
            )

    numbered = stage(
        items.select(F.monotonically_increasing_id().alias("item"), "item_id", whole_text().alias("text")), "items"
    )
    sketches = keep(numbered.select("item", "text").mapInArrow(sketched, "item bigint, size int, hash bigint"), "sketches")
    # At most ``size`` rows, one per shingle length.
    sizes = [r[0] for r in sketches.select("size").distinct().collect()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text"):
            words, starts = split_words(lower_ascii(batch.column("text")))
            hashes, ids = word_hashes(words), batch.column("doc").to_numpy()
            for s in sizes:
                found, doc = _long_shingles(hashes, starts, s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(np.full(len(doc), s, np.int32)), pa.array(found.view(np.int64))],
                    ["doc", "size", "hash"],
                )

    texts = stage(docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", whole_text().alias("text")), "texts")
    shingles = texts.select("doc", "text").mapInArrow(hashed, "doc bigint, size int, hash bigint")
    pairs = shingles.join(sketches, ["size", "hash"]).select("doc", "item").distinct()
    full = pairs.join(texts, "doc").join(numbered.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text"):
            documents, tests = _word_lists(batch.column("text")), _word_lists(batch.column("item_text"))
            found = []
            for doc_id, item_id, words, test in zip(
                batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), documents, tests
            ):
                own = _shingles(test, min(size, len(test)))
                shared = len(own & _shingles(words, min(size, len(test))))
                if shared >= containment * len(own) - 1e-9:
                    found.append((doc_id, item_id, shared, len(own)))
            yield _rows(found)

    return full.select("doc_id", "item_id", "text", "item_text").mapInArrow(verified, FOUND)


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    if not _small(items):
        rows = stage(packed(docs.withColumn("_number", F.monotonically_increasing_id()), "_number", "text"), "numbered")
        found = find_contaminated(rows.select(F.col("_number").alias("doc_id"), "text"), items, size, containment, True)
        gone = found.select(F.col("doc_id").alias("_number")).distinct()
        return unpacked(rows.join(gone, "_number", "left_anti")).select(*docs.columns)
    load = _in_tasks(items, size, containment)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, lookup = load()
        for batch in texts:
            stays = np.ones(len(batch), bool)
            stays[[doc for doc, *_ in _matches(own, lookup, batch, containment)]] = False
            yield pa.array(stays)

    return docs.where(clean(whole_text()))
