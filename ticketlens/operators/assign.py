"""Weighted assignment, fan-out and shuffling of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.batching import number_in_order


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _case(bucket: str, weights: dict[str, int]) -> str:
    branches, hi = "", 0
    for value, weight in weights.items():
        hi += weight
        branches += f" WHEN {bucket} < {hi} THEN {_text(value)}"
    return f"CASE{branches} END"


def hash_bucket(*key: Column, seed: int = 0, buckets: int = 100) -> Column:
    """Repeatable bucket of a key, whatever the order or partitioning of the rows."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(buckets))


def weighted_pick(bucket: str, weights: dict[str, int]) -> Column:
    """The value whose cumulative weight range ``[lo, hi)`` holds ``bucket``, a column.

    Weights are integers, and buckets run from 0 to their sum. A CASE in
    generated code, so no join with a weights table is needed.
    """
    return F.expr(_case(bucket, weights))


def weighted_pick_by(group: str, bucket: str, weights: dict[str, dict[str, int]]) -> Column:
    """``weighted_pick`` with the weights of the row's group; null for an unknown group."""
    branches = " ".join(f"WHEN {_text(name)} THEN {_case(bucket, by)}" for name, by in weights.items())
    return F.expr(f"CASE {group} {branches} END")


def pick_from(bucket: str, values: list[str]) -> Column:
    """Unweighted pick by a bucket from 0 to ``len(values) - 1``."""
    return F.expr(f"get(array({', '.join(map(_text, values))}), cast({bucket} AS INT))")


def fan_out(df: DataFrame, copies: Column, number: str = "copy_no") -> DataFrame:
    """Each row ``copies`` times, numbered from 1; none for a count below 1."""
    return df.where(copies >= 1).select("*", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(number))


def shuffle_rows(df: DataFrame, *key: str, seed: int = 42) -> DataFrame:
    """Rows in a random-looking order that the key and the seed fix.

    Whole rows move once and are sorted once: where the ranges of ``shuffle_key`` begin is
    found from the keys alone. Rows of one key follow each other and may fill several ranges.
    """
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    keyed = df.withColumn("shuffle_key", mixed)
    return number_in_order(keyed, "shuffle_key", "_row_no").drop("_row_no")
