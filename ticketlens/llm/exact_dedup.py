"""Exact dedup: per-partition counting quotient filters, merged, then byte verification.

Each partition builds a counting quotient filter of its fingerprints. A filter keeps
the low bits of a fingerprint (the remainder) in the run of its high bits (the quotient):
two bit vectors say which quotients occur and where runs end, so no fingerprint is lost.
Filters are cut by leading bits into segments; the filters of a segment merge by their
sorted remainders and add their counts. Only texts whose fingerprint counts above one
are shuffled, and compared byte by byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import ROW, SPACES, keep, packed, power_of_two, whole_text

#: Fingerprints per filter segment, about; bounds what one merge task holds.
SEGMENT_FINGERPRINTS = 500_000


class QuotientFilter:
    """A counting quotient filter over one segment of 64-bit fingerprints, kept sorted."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        """``fingerprints``: sorted and distinct; ``counts``: their occurrences."""
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order]
        weights = np.ones(len(ordered), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else []
        if not len(first):
            return cls(ordered, weights)
        return cls(ordered[first], np.add.reduceat(weights, first))

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        return QuotientFilter.of(
            np.concatenate([self.fingerprints, other.fingerprints]),
            np.concatenate([self.counts, other.counts]),
        )

    def to_bytes(self, segment_bits: int) -> bytes:
        """Occupied quotients, run ends, remainders of 32 bits or more, counters."""
        n = len(self.fingerprints)
        quotient_bits = min(24, max(1, int(np.ceil(np.log2(max(2, n))))))
        remainder_bits = 64 - segment_bits - quotient_bits
        inside = self.fingerprints & np.uint64((1 << (64 - segment_bits)) - 1)
        quotient = (inside >> np.uint64(remainder_bits)).astype(np.int64)
        remainder = inside & np.uint64((1 << remainder_bits) - 1)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotient] = True
        run_end = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if n else np.zeros(0, bool)
        width = (remainder_bits + 7) // 8
        slots = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        many = np.flatnonzero(self.counts > 1)
        head = struct.pack("<BBqq", segment_bits, quotient_bits, n, len(many))
        return b"".join(
            [
                head,
                np.packbits(occupied).tobytes(),
                np.packbits(run_end).tobytes(),
                slots.tobytes(),
                many.astype("<u4").tobytes(),
                self.counts[many].astype("<u8").tobytes(),
            ]
        )

    @classmethod
    def from_bytes(cls, data: bytes, segment: int) -> QuotientFilter:
        segment_bits, quotient_bits, n, n_many = struct.unpack_from("<BBqq", data)
        at = struct.calcsize("<BBqq")
        remainder_bits = 64 - segment_bits - quotient_bits
        width = (remainder_bits + 7) // 8

        def take(size: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, np.uint8, size, at)
            at += size
            return part

        occupied = np.flatnonzero(np.unpackbits(take(((1 << quotient_bits) + 7) // 8))[: 1 << quotient_bits])
        run_end = np.unpackbits(take((n + 7) // 8))[:n]
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = take(n * width).reshape(n, width)
        many, above = take(4 * n_many).copy().view("<u4"), take(8 * n_many).copy().view("<u8")
        run = np.concatenate([[0], np.cumsum(run_end)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        quotient = occupied[run].astype(np.uint64)
        fingerprints = (quotient << np.uint64(remainder_bits)) | slots.view("<u8").reshape(n)
        if segment_bits:
            fingerprints |= np.uint64(segment << (64 - segment_bits))
        counts = np.ones(n, np.int64)
        counts[many] = above.astype(np.int64)
        return cls(fingerprints, counts)


def repeated_fingerprints(fingerprints: DataFrame, segments: int) -> DataFrame:
    """Fingerprints (column ``fp``) that occur more than once, each in one row."""
    bits = segments.bit_length() - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = QuotientFilter.of(np.zeros(0, np.uint64))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            whole = whole.merge(QuotientFilter.of(fp))
        if not len(whole.fingerprints):
            return
        top = whole.fingerprints >> np.uint64(64 - bits) if bits else np.zeros(len(whole.fingerprints), np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(top.astype(np.int64))) + 1, [len(top)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = QuotientFilter(whole.fingerprints[a:b], whole.counts[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(top[a])], pa.int64()), pa.array([part.to_bytes(bits)], pa.binary())],
                ["segment", "filter"],
            )

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = key[0].as_py()
        parts = [
            QuotientFilter.from_bytes(data.as_py(), segment) for batch in batches for data in batch.column("filter")
        ]
        while len(parts) > 1:
            parts = [
                parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
            ]
        found = parts[0].fingerprints[parts[0].counts > 1]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64), pa.int64())], ["fp"])

    filters = fingerprints.select("fp").mapInArrow(build, "segment bigint, filter binary")
    return filters.groupBy("segment").applyInArrow(merged, "fp bigint")


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """Rows with normalised text, fingerprint and length; ``docs`` is packed."""
    norm = F.translate(whole_text(), SPACES, "")
    return docs.select("doc_id", ROW, F.length(whole_text()).alias("n_chars"), norm.alias("norm")).withColumn(
        "fp", F.xxhash64("norm")
    )


def _segments(docs: DataFrame) -> int:
    return power_of_two(docs.count() / SEGMENT_FINGERPRINTS)


def _better() -> F.Column:
    """Greater for the row to keep: more code points, then the smaller id (null last)."""
    return F.struct(
        F.col("n_chars"), F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("minus_id")
    )


def _routed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprinted rows; those of repeated fingerprints; groups of byte-equal texts of those."""
    rows = _fingerprinted(packed(docs, "doc_id", "text"))
    repeated = keep(repeated_fingerprints(rows, _segments(docs)), "repeated")
    routed = rows.join(repeated, "fp", "left_semi")
    groups = routed.groupBy("norm").agg(
        F.max(_better()).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(repeated, "fp", "left_anti"), routed, groups


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after white space is deleted; null counts
    as empty, so all empty texts are one group. The row with most code points, then the
    smallest id stays. Of rows that repeat with the same id, text and length one is kept
    and the others are not. A row with null id is kept only if its group has no other
    of its length; its keep_id is null then. An empty table gives no rows.
    """
    alone, routed, groups = _routed(docs)
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    one = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    # Rows that are the same in all that counts are told apart by number only.
    same = (
        routed.join(groups, "norm")
        .select(
            "doc_id",
            (-F.col("best.minus_id")).alias("keep_id"),
            "group_size",
            _better().eqNullSafe(F.col("best")).alias("best"),
            sha,
        )
        .groupBy("doc_id", "keep_id", "group_size", "best", "text_sha256")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    many = same.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )
    return one.unionByName(many)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The kept rows of ``exact_dedup``, with all columns of ``docs``."""
    alone, routed, groups = _routed(docs)
    best = routed.join(groups.where("group_size > 1").withColumnRenamed("norm", "same"), F.expr("norm = same"))
    first = best.where(_better().eqNullSafe(F.col("best"))).groupBy("norm").agg(F.first(ROW).alias(ROW))
    # Fingerprints that met by chance: their texts differ, so all of them stay.
    chance = routed.join(groups.where("group_size = 1"), "norm", "left_semi")
    kept = alone.select(ROW).unionByName(first.select(ROW)).unionByName(chance.select(ROW))
    return kept.select(f"{ROW}.*")
