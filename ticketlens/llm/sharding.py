"""Shards from a Feistel permutation of global row numbers.

Rows are numbered in id order. A keyed Feistel network permutes a power-of-four domain
that covers all numbers; a number that lands outside walks its cycle until it is back
inside. Shard and slot are remainder and quotient of the permuted number, so they can be
computed for any row number without looking at other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import mix64, whole_text
from ticketlens.operators.batching import number_rows

ROUNDS = 6


def _network(x: np.ndarray, half: int, seed: int) -> np.ndarray:
    """One pass of the Feistel network over ``2 * half`` bits."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for i in range(ROUNDS):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03 + 1) % (1 << 64))
        left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """A permutation of 0..rows-1, the same for the same ``rows`` and ``seed``."""
    half = max(1, (max(1, rows - 1).bit_length() + 1) // 2)
    out = _network(numbers.astype(np.uint64), half, seed)
    outside = np.flatnonzero(out >= np.uint64(rows))
    while len(outside):
        out[outside] = _network(out[outside], half, seed)
        outside = outside[out[outside] >= np.uint64(rows)]
    return out.astype(np.int64)


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard counts differ by one at most, slots run from 0 without a
    gap, and equal inputs give equal shards whatever the partitioning. Size is the UTF-8
    length plus 8; a null text has no bytes. Rows are numbered by id (null first), then by
    size and checksum; rows equal in all of these are interchangeable. Equal texts may
    fall into different shards: no group, however large, makes a shard uneven.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(whole_text()).cast("bigint") + 8).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    numbered = number_rows(narrow.withColumn("_place_of", F.struct("doc_id", "size", "text_crc32")), "_place_of", "_no")
    total = docs.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_no").to_numpy(zero_copy_only=False)
            moved = permute(number, total, seed)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("size"),
                    batch.column("text_crc32"),
                    pa.array(["rows"] * batch.num_rows, pa.string()),
                    pa.array((moved % shards).astype(np.int32)),
                    pa.array(moved // shards),
                    pa.nulls(batch.num_rows, pa.int32()),
                ],
                ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    schema = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"
    return numbered.select("doc_id", "size", "text_crc32", "_no").mapInArrow(place, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 2024, files: int = 1) -> None:
    """Write the documents below ``path`` in one folder per shard, sorted by slot.

    Each shard is written as ``files`` runs of slots. Document ids must be unique.
    """
    placed = assign_shards(docs, shards, seed).select(F.col("doc_id").alias("_id"), "shard", "slot")
    rows = docs.select("doc_id", F.struct("*").alias("document"))
    joined = rows.join(placed, F.col("doc_id").eqNullSafe(F.col("_id"))).select("shard", "slot", "document")
    run = F.expr(f"slot DIV {-(-docs.count() // (shards * files)) or 1}")
    (
        joined.repartition(shards * files, "shard", run)
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
