"""Warehouse tables: raw, fact, insights and the stored narratives."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.schemas import NARRATIVE_SCHEMA, NARRATIVE_TABLE
from ticketlens.session import one_row, shuffles_dropped


def replace_table(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Drop-and-create ``name`` from ``df`` and return a scan of the stored rows."""
    writer = df.write.mode("overwrite").format("parquet")
    if location:
        writer = writer.option("path", f"{location.rstrip('/')}/{name}")
    with shuffles_dropped(df.sparkSession):
        writer.saveAsTable(name)
    return df.sparkSession.table(name)


def append_table(df: DataFrame, name: str) -> None:
    """Add rows to a stored table, by column name."""
    table = df.sparkSession.table(name)
    with shuffles_dropped(df.sparkSession):
        df.select(*table.columns).write.mode("append").format("parquet").saveAsTable(name)


def publish_view(df: DataFrame, name: str, sql: str | None = None) -> DataFrame:
    """Register ``df`` as a view of this session, or ``sql`` as one that the catalog keeps.

    Which sessions see a kept view depends on the catalog; Spark's own ends with the
    application, a metastore's does not.
    """
    spark = df.sparkSession
    if sql is None:
        df.createOrReplaceTempView(name)
    else:
        spark.catalog.dropTempView(name)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS {sql}")
    return spark.table(name)


def row_count(spark: SparkSession, name: str) -> int:
    return spark.table(name).count()


# -- narratives ----------------------------------------------------------------------


def reset_narratives(spark: SparkSession, name: str = NARRATIVE_TABLE, location: str | None = None) -> DataFrame:
    """Replace the narrative table by an empty one with its fixed schema."""
    return replace_table(spark.createDataFrame([], NARRATIVE_SCHEMA), name, location)


def append_narrative(spark: SparkSession, text: str, name: str = NARRATIVE_TABLE) -> None:
    """Add one narrative, stamped with the current time."""
    row = one_row(spark).select(
        F.current_timestamp().alias("generated_at"), F.lit(text).cast("string").alias("narrative")
    )
    row.write.mode("append").format("parquet").saveAsTable(name)


def latest_narrative(spark: SparkSession, name: str = NARRATIVE_TABLE) -> DataFrame:
    """The newest narrative: one row, or none if the table is empty or missing."""
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], NARRATIVE_SCHEMA).select("narrative")
    # Of equal stamps the greater text, so that the answer does not depend on the files.
    return spark.table(name).orderBy(F.desc("generated_at"), F.desc("narrative")).limit(1).select("narrative")


# -- cached snapshot -----------------------------------------------------------------


class Snapshot:
    """A table-derived frame kept in executor memory or disk, refreshed after ``ttl`` seconds.

    ``derive`` should reduce the table (the summary cells of ``plans.overview``),
    so that what is cached does not grow with the ticket count.
    """

    def __init__(self, spark: SparkSession, name: str, derive=lambda df: df, ttl: float = 60.0, clock=time.monotonic):
        self._spark, self._name, self._derive = spark, name, derive
        self._ttl, self._clock = ttl, clock
        self._frame: DataFrame | None = None
        self._loaded_at = 0.0

    def get(self) -> DataFrame:
        if self._frame is not None and self._clock() - self._loaded_at < self._ttl:
            return self._frame
        self.drop()
        self._spark.catalog.refreshTable(self._name)
        self._frame = self._derive(self._spark.table(self._name)).persist(StorageLevel.MEMORY_AND_DISK)
        self._loaded_at = self._clock()
        return self._frame

    def drop(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
            self._frame = None
