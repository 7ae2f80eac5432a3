from collections import Counter

from conftest import dicts, final_plan
from pyspark.sql import functions as F

from ticketlens.functions import expressions as X
from ticketlens.operators import assign as A
from ticketlens.samples.tickets import SENTIMENT_WEIGHTS
from ticketlens.session import session_conf

PLAN_WEIGHTS = {"Basic": 40, "Standard": 35, "Premium": 25}
STATUS_WEIGHTS = {"Open": 15, "In Progress": 20, "Resolved": 55, "Escalated": 10}


def test_weights_fill_their_ranges(spark):
    rows = spark.range(100).select("id", A.weighted_pick("id", STATUS_WEIGHTS).alias("v")).orderBy("id").collect()
    assert Counter(r["v"] for r in rows) == STATUS_WEIGHTS
    assert [rows[i]["v"] for i in (0, 14, 15, 34, 35, 89, 90, 99)] == [
        "Open", "Open", "In Progress", "In Progress", "Resolved", "Resolved", "Escalated", "Escalated",
    ]


def test_all_weights_add_up_to_a_hundred():
    for weights in [PLAN_WEIGHTS, STATUS_WEIGHTS, *SENTIMENT_WEIGHTS.values()]:
        assert sum(weights.values()) == 100


def test_weights_by_group(spark):
    labels = spark.createDataFrame([(p,) for p in [*SENTIMENT_WEIGHTS, "Other"]], "label STRING")
    buckets = spark.range(100).withColumnRenamed("id", "bucket")
    joined = labels.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(99))))
    rows = joined.select("label", A.weighted_pick_by("label", "bucket", SENTIMENT_WEIGHTS).alias("v")).collect()
    for label, weights in SENTIMENT_WEIGHTS.items():
        assert Counter(r["v"] for r in rows if r["label"] == label) == weights
    assert {r["v"] for r in rows if r["label"] == "Other"} == {None}
    assert buckets.count() == 100


def test_hash_buckets_do_not_depend_on_partitioning(spark):
    ids = spark.range(10_000)
    picks = lambda df: sorted(df.select("id", A.hash_bucket(F.col("id"), seed=3).alias("b")).collect())
    rows = picks(ids)
    assert rows == picks(ids.repartition(3))
    sizes = Counter(r["b"] for r in rows)
    assert min(sizes) == 0 and max(sizes) == 99 and max(sizes.values()) < 200


def test_words_with_quotes(spark):
    got = spark.range(2).select(A.pick_from("id", ["it's", "a\\b"]).alias("v")).collect()
    assert [r["v"] for r in got] == ["it's", "a\\b"]


def test_fan_out(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 0), ("c", 1), ("d", None)], "k STRING, n INT")
    got = [(r["k"], r["copy_no"]) for r in A.fan_out(rows, F.col("n")).collect()]
    assert got == [("a", 1), ("a", 2), ("a", 3), ("c", 1)]


def test_shuffle_is_repeatable_and_whole(spark):
    ids = spark.range(500)
    order = [r["id"] for r in A.shuffle_rows(ids, "id").collect()]
    assert order == [r["id"] for r in A.shuffle_rows(ids.repartition(5), "id").collect()]
    assert sorted(order) == list(range(500)) != order
    assert order != [r["id"] for r in A.shuffle_rows(ids, "id", seed=7).collect()]


def test_shuffle_splits_a_hot_key(spark):
    rows = spark.range(0, 30_000, 1, 6).selectExpr("if(id % 3 = 0, 'hot', cast(id AS STRING)) AS k")
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        spread = A.shuffle_rows(rows, "k").select("k", F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in spread.groupBy("p").count().collect()]
        assert spread.where("k = 'hot'").select("p").distinct().count() >= 3
    assert sum(sizes) == 30_000 and max(sizes) < 10_000


def test_rows_move_and_are_sorted_once(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id AS STRING) AS k", "repeat('x', 20) AS text").write.parquet(str(tmp_path / "rows"))
    plan = final_plan(A.shuffle_rows(spark.read.parquet(str(tmp_path / "rows")), "k")).split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_ids_dates_and_text(spark):
    row = dicts(
        spark.range(1).select(
            X.numbered_id("USR-", F.lit(42), 5).alias("short"),
            X.numbered_id("USR-", F.lit(1234567), 5).alias("long"),
            X.hashed_id("TKT-", F.lit("a"), F.lit("1")).alias("hashed"),
            X.days_before(F.lit("2024-03-01").cast("date"), F.lit(1)).alias("day"),
            X.strip(F.lit(" \t\nx y\r\n ")).alias("text"),
            X.thousands(F.lit(1234567)).alias("number"),
            X.batches_needed(F.lit(660), 20).alias("even"),
            X.batches_needed(F.lit(661), 20).alias("odd"),
            X.percent_half_even(F.lit(1), F.lit(80)).alias("tie_even"),
            X.percent(F.lit(1), F.lit(80)).alias("tie_up"),
        )
    )[0]
    assert row.pop("hashed").startswith("TKT-")
    assert row == {
        "short": "USR-00042",
        "long": "USR-1234567",
        "day": "2024-02-29",
        "text": "x y",
        "number": "1,234,567",
        "even": 33,
        "odd": 34,
        "tie_even": 1.2,
        "tie_up": 1.3,
    }
