import uuid
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketlens.operators import quality as Q
from ticketlens.operators import unique_keys as U


def repeated(df, keys, **options):
    return {tuple(r)[:-1]: r["_copies"] for r in U.repeated_keys(df, keys, **options).collect()}


def brute(rows):
    return {k: n for k, n in Counter(rows).items() if n > 1}


ROWS = [(f"T{k % 700}", k % 3) for k in range(900)] + [("hot", 1)] * 400 + [(None, 1), (None, 1), ("x", None), ("x", None), ("y", None), (None, None)]


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("most", [U.MOST_SUSPECTS, 0])
def test_repeated_keys_are_exact(spark, partitions, most):
    df = spark.createDataFrame(ROWS, "id STRING, n INT").repartition(partitions)
    assert repeated(df, ["id", "n"], most_suspects=most) == brute(ROWS)
    assert repeated(df, ["id"], most_suspects=most) == brute([(i,) for i, _ in ROWS])


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame(ROWS[:1], "id STRING, n INT")
    assert repeated(df, ["id"]) == {} == repeated(df.where("false"), ["id"])
    assert Q.unique_key(df.where("false"), ["id"]).first()["failing_rows"] == 0


def test_equal_fingerprints_of_unequal_keys_are_told_apart(spark):
    # Null columns are left out of the hash: these two differ, but not in their fingerprints.
    df = spark.createDataFrame([(None, "a"), ("a", None), ("b", "b")], "x STRING, y STRING")
    assert df.select(F.xxhash64("x", "y")).distinct().count() == 2
    assert repeated(df, ["x", "y"]) == {}


def test_unique_ids_are_hardly_shuffled(spark):
    """99 % unique ids: packets and suspects together stay below a tenth of the ids' bytes."""
    n = 200_000
    ids = [(str(uuid.UUID(int=k * 0x9E3779B97F4A7C15F39CC0605CEDC835 % (1 << 128))),) for k in range(n)]
    ids += ids[: n // 100]
    df = spark.createDataFrame(ids, "id STRING").repartition(8)
    rows = df.select("id", F.xxhash64("id").alias(U.FINGERPRINT))
    bits, segment_bits = U.fingerprint_bits(len(ids))
    packets = U.fingerprint_packets(rows, bits, segment_bits).cache()
    sent = packets.agg(F.sum(F.length("packet") + 24)).first()[0]
    suspects = U.repeated_fingerprints(packets, bits, segment_bits).count()
    packets.unpersist()
    assert n // 100 <= suspects <= n // 100 + 3 * n / 1000
    assert sent + 2 * suspects * 36 < 36 * len(ids) / 10
    found = U.repeated_keys(df, ["id"])
    assert found.count() == n // 100 and {r["_copies"] for r in found.collect()} == {2}


def test_unique_keys_meet_a_broadcast_before_their_exchange(spark):
    df = spark.createDataFrame(ROWS, "id STRING, n INT")
    plan = U.repeated_keys(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")


def test_bits_bound_the_suspects_of_any_size():
    for rows in (0, 1, 10**3, 10**6, 10**9, 10**12):
        bits, segment_bits = U.fingerprint_bits(rows)
        assert segment_bits < bits <= 64
        by_chance = rows * rows / 2 / 2.0**bits
        assert by_chance <= max(rows / 1000, 1 << 17)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300))
def test_packets_give_back_their_numbers(values):
    values = np.sort(np.array(values, np.uint64))
    assert U._decode(U._encode(values), len(values)).tolist() == values.tolist()
