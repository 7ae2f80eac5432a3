import time

import pytest
from pyspark.sql import functions as F

from ticketlens.sources import versions as V


def frame(spark, **months):
    """Rows of (month, value); ``none`` stands for the null month."""
    rows = [(None if m == "none" else f"2024-{m[1:]}-01", v) for m, values in months.items() for v in values]
    return spark.createDataFrame(rows, "m string, v int").select(F.col("v"), F.col("m").cast("date").alias("m"))


def held(df):
    return sorted((str(r.m), r.v) for r in df.collect())


@pytest.fixture()
def name(spark):
    table = f"versioned_{time.time_ns()}"
    yield table
    spark.sql(f"DROP VIEW IF EXISTS {table}")
    for version in V.versions_of(spark, table):
        spark.sql(f"DROP TABLE {version}")


def test_a_reader_sees_the_old_or_the_new_rows_whole(spark, name, tmp_path):
    place = str(tmp_path)
    before = V.publish(frame(spark, m01=[1, 2], m02=[3], none=[4]), name, place, partition="m")
    old = held(before)
    version = V.write_version(frame(spark, m01=[9]), name, place, partition="m")
    assert held(spark.table(name)) == old, "not switched yet"
    V.switch(version)
    assert held(spark.table(name)) == [("2024-01-01", 9)]
    # A frame from before the switch still reads its own files.
    assert held(before) == old
    V.expire(spark, name, place)
    assert held(before) == old


def test_replaced_partitions_only(spark, name, tmp_path):
    place = str(tmp_path)
    V.publish(frame(spark, m01=[1], m02=[2], m03=[3], none=[4]), name, place, partition="m")
    files = set(spark.table(name).where("m = date'2024-03-01'").inputFiles())
    import datetime

    gone = [datetime.date(2024, 1, 1), datetime.date(2024, 2, 1), None]
    got = V.publish(frame(spark, m01=[7], m04=[8]), name, place, partition="m", replaced=gone)
    assert held(got) == [("2024-01-01", 7), ("2024-03-01", 3), ("2024-04-01", 8)]
    assert set(spark.table(name).where("m = date'2024-03-01'").inputFiles()) == files


def test_old_files_go_unless_they_are_used_or_leased(spark, name, tmp_path):
    place = str(tmp_path)

    def folders():
        return {p.name for p in (tmp_path / name).iterdir()}

    V.publish(frame(spark, m01=[1], m02=[2]), name, place, partition="m")
    first = V.current_version(spark, name).rsplit("__v", 1)[1]
    with V.leased(spark, name) as rows:
        for k in range(4):
            V.publish(frame(spark, m01=[k]), name, place, partition="m")
        assert held(rows) == [("2024-01-01", 1), ("2024-02-01", 2)]
        assert first in folders() and len(folders()) == 3
    V.publish(frame(spark, m01=[5]), name, place, partition="m")
    assert first not in folders() and len(folders()) == V.KEPT_VERSIONS
    assert held(spark.table(name)) == [("2024-01-01", 5)]


def test_partitions_of_old_versions_stay_while_they_are_part_of_a_new_one(spark, name, tmp_path):
    import datetime

    place = str(tmp_path)
    V.publish(frame(spark, m01=[1], m02=[2]), name, place, partition="m")
    for k in range(5):
        V.publish(frame(spark, m01=[10 + k]), name, place, partition="m", replaced=[datetime.date(2024, 1, 1)])
    assert held(spark.table(name)) == [("2024-01-01", 14), ("2024-02-01", 2)]
    assert len(list((tmp_path / name).glob("*/m=2024-02-01"))) == 1
    assert len(list((tmp_path / name).glob("*/m=2024-01-01"))) == V.KEPT_VERSIONS


def test_leases_end(spark, name, tmp_path):
    V.publish(frame(spark, m01=[1]), name, str(tmp_path))
    first = V.current_version(spark, name)
    with V.leased(spark, name, seconds=-1):
        for k in range(3):
            V.publish(frame(spark, m01=[k]), name, str(tmp_path))
        assert first not in V.versions_of(spark, name)


def test_hidden_columns_no_rows_and_a_table_of_that_name(spark, name, tmp_path):
    spark.sql(f"CREATE TABLE {name} (x INT) USING parquet LOCATION '{tmp_path}/plain'")
    got = V.publish(frame(spark, m01=[1]).limit(0), name, str(tmp_path / "v"), partition="m", shown=["v"])
    assert got.columns == ["v"] and got.count() == 0 and V.current_version(spark, name)
    assert V.current_version(spark, "no_such_name") is None


def test_files_of_texts_are_smaller_than_by_default(spark, name, tmp_path):
    words = F.expr("concat_ws(' ', transform(sequence(1, 400), k -> concat('w', abs(hash(id, k)) % 3000)))")
    rows = spark.range(0, 4000, 1, 1).select("id", words.alias("text"))
    version = V.write_version(rows, name, str(tmp_path / "tables"))
    rows.write.option("compression", "zstd").parquet(str(tmp_path / "plain"))
    sizes = [sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (tmp_path / "tables", tmp_path / "plain")]
    assert sizes[0] < 0.96 * sizes[1], sizes
    assert version.rows().exceptAll(rows).isEmpty() and version.rows().count() == 4000
