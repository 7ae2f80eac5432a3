from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketlens.operators.toplists import local_counts, top_keys


def plain(rows, k):
    counts = Counter(r for r in rows if None not in r)
    return sorted(((n, key) for key, n in counts.items()), key=lambda x: (-x[0], x[1]))[:k]


def run(df, k):
    return [(r["count"], (r["a"], r["b"])) for r in top_keys(df, ["a", "b"], k).collect()]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(st.tuples(st.sampled_from(["x", "y", None, "z"]), st.integers(0, 6)), max_size=60),
    k=st.integers(1, 6),
    parts=st.integers(1, 5),
)
def test_like_a_count_of_everything(spark, rows, k, parts):
    df = spark.createDataFrame(rows, "a string, b int").repartition(parts)
    assert run(df, k) == plain(rows, k)


def test_a_key_that_leads_nowhere_but_wins(spark):
    """Second in every task, first in sum."""
    rows = [(f"t{t}", 0) for t in range(8) for _ in range(10)] + [("all", 0) for _ in range(72)]
    parts = [[r for r in rows[:80] if r[0] == f"t{t}"] + [("all", 0)] * 9 for t in range(8)]
    df = spark.sparkContext.parallelize(parts, 8).flatMap(list).toDF("a string, b int")
    assert run(df, 1) == [(72, ("all", 0))]


def test_a_long_tail_stays_where_it_is(spark):
    """A third of the rows has one key; of the others few repeat."""
    rows = spark.range(0, 90_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "warm").otherwise(F.concat(F.lit("k"), "id")).alias("a"),
        F.lit(1).alias("b"),
    )
    assert [n for n, _ in run(rows, 2)] == [30_000, 8_572]
    counts = local_counts(rows, ["a", "b"], 2)
    assert counts.where("_top").count() == 12
    assert counts.count() == 90_000 - 30_000 - 8_572 + 12
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    # A task's share of the last place's bound leaves two keys a task.
    assert counts.where(f"_n >= {8_572 // 6}").count() == 12


@pytest.mark.parametrize("rows", [[], [(None, 1)]])
def test_nothing_to_count(spark, rows):
    assert run(spark.createDataFrame(rows, "a string, b int"), 3) == []
