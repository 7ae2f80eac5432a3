"""Repeated keys, without shuffling the keys that are unique.

A plain count shuffles every key to find the few that repeat. Here each task sorts the
fingerprints of its keys and sends them in segments, as compressed differences: some two
bytes per key. What meets a second time in a segment is a suspect, and only rows with
suspect fingerprints are shuffled and compared by their whole keys, so the result is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FINGERPRINT = "_fingerprint"
#: Suspects up to this number (8 bytes each) are broadcast. Unequal keys make at most some
#: 130,000 of them at any size; with more, the keys repeat so often that a plain count is best.
MOST_SUSPECTS = 1_000_000
#: Fingerprints that one segment is expected to hold.
_SEGMENT_ROWS = 1 << 22


def fingerprint_bits(rows: int) -> tuple[int, int]:
    """Bits of a fingerprint, and how many of them number its segment.

    A unique key is a suspect by chance in one of 1,000 cases at most, and beyond some 130
    million rows so rarely that the suspects' number stays the same.
    """
    size = log2(max(2, rows))
    bits = min(64, ceil(max(size + 10, 2 * size - 17)))
    return bits, max(3, ceil(log2(max(1, rows / _SEGMENT_ROWS))))


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col(FINGERPRINT), 64 - bits) if bits < 64 else F.col(FINGERPRINT)


def _encode(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, all lowest bytes first, then the next ones."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _decode(packet: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packet, 8 * count, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(planes.reshape(8, count).T.copy().view("<u8").ravel(), dtype=np.uint64)


def fingerprint_packets(rows: DataFrame, bits: int, segment_bits: int) -> DataFrame:
    """segment, count, packet: the fingerprints of each task; one it has repeatedly is sent twice.

    A task holds eight bytes per row of its split.
    """
    low = bits - segment_bits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not held:
            return
        values, times = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
        values = np.repeat(values, np.minimum(times, 2))
        segment = (values >> np.uint64(low)).astype(np.int64)
        inside = values & np.uint64((1 << low) - 1)
        cuts = np.flatnonzero(np.diff(segment, prepend=-1))
        ends = np.append(cuts[1:], len(values))
        for a in range(0, len(cuts), 256):
            some = list(zip(cuts[a : a + 256], ends[a : a + 256]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(segment[i]) for i, _ in some], pa.int64()),
                    pa.array([int(j - i) for i, j in some], pa.int64()),
                    pa.array([_encode(inside[i:j]) for i, j in some], pa.binary()),
                ],
                ["segment", "count", "packet"],
            )

    return rows.select(FINGERPRINT).mapInArrow(pack, "segment bigint, count bigint, packet binary")


def repeated_fingerprints(packets: DataFrame, bits: int, segment_bits: int) -> DataFrame:
    """_prefix: the fingerprints that some segment holds more than once."""
    low = bits - segment_bits

    def meet(table: pa.Table) -> pa.Table:
        rows = zip(table.column("packet").to_pylist(), table.column("count").to_pylist())
        values = np.sort(np.concatenate([_decode(packet, n) for packet, n in rows]))
        again = np.unique(values[1:][values[1:] == values[:-1]])
        found = again | np.uint64(table.column("segment")[0].as_py() << low)
        return pa.table({"_prefix": pa.array(found.view(np.int64), pa.int64())})

    return packets.groupBy("segment").applyInArrow(meet, "_prefix bigint")


def repeated_keys(df: DataFrame, keys: list[str], most_suspects: int = MOST_SUSPECTS) -> DataFrame:
    """``keys`` and ``_copies``: the combinations of keys that more than one row holds.

    Null is a value. The keys are stored once with their fingerprints, so ``df`` is read once.
    """
    rows = stage(df.select(*keys, F.xxhash64(*keys).alias(FINGERPRINT)), "keys")
    bits, segment_bits = fingerprint_bits(rows.count())
    packets = fingerprint_packets(rows, bits, segment_bits)
    suspects = stage(repeated_fingerprints(packets, bits, segment_bits), "suspects")
    if suspects.count() <= most_suspects:
        rows = rows.withColumn("_prefix", _prefix(bits)).join(F.broadcast(suspects), "_prefix", "left_semi")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
