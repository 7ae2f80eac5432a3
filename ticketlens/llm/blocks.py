"""Counting every hash of the corpus through blocks of documents and buckets of hashes.

Documents are dealt to blocks. A block sends one packet per bucket: its distinct hashes of
that bucket, sorted and stored as compressed differences. A bucket answers each packet in
the packet's order, so an answer needs no hashes. No hash is ever a row, a hash occurs once
per packet however often it repeats, and no key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import power_of_two

#: Bytes of text per block, about: bounds what a task holds.
BLOCK_BYTES = 8 << 20
#: Bounds of id ranges that the driver holds at most; ranges are halved evenly beyond.
MOST_BOUNDS = 1024


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-text_bytes(docs) // block_bytes))


def ordered_block(docs: DataFrame, blocks: int) -> Column:
    """A block number that never falls as the id grows; null ids come first."""
    cells = min(blocks, MOST_BOUNDS)
    marks = [i / cells for i in range(1, cells)]
    bounds = docs.approxQuantile("doc_id", [0.0, *marks, 1.0], 0.1 / cells) if blocks > 1 else []
    inner = sorted({int(b) for b in bounds[1:-1]}) if bounds else []
    if not inner:
        return F.lit(0).cast("bigint")
    edges = F.array(*[F.lit(b).cast("bigint") for b in inner])
    cell = F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))).cast("bigint")
    parts = -(-blocks // cells)
    if parts == 1:
        return F.coalesce(F.when(F.col("doc_id").isNotNull(), cell), F.lit(0).cast("bigint"))
    lows = F.array(*[F.lit(b).cast("bigint") for b in [int(bounds[0]), *inner, int(bounds[-1]) + 1]])
    low, high = F.element_at(lows, cell.cast("int") + 1), F.element_at(lows, cell.cast("int") + 2)
    inside = F.floor((F.col("doc_id") - low) / (high - low) * parts)
    place = F.greatest(F.lit(0).cast("bigint"), F.least(inside, F.lit(parts - 1).cast("bigint")))
    return F.coalesce(cell * parts + place, F.lit(0).cast("bigint"))


def bucket_count(blocks: int) -> int:
    return power_of_two(blocks)


# -- arrays as bytes -----------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Compress an array, byte plane by byte plane."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    data = np.ascontiguousarray(planes).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of leading bits begins in sorted 64-bit keys, and the end."""
    if buckets == 1:
        return np.array([0, len(keys)])
    width = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.arange(1, buckets, dtype=np.uint64) << width
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
