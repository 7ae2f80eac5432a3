"""Stored tables built from the sample tickets, for queries and tests."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.plans.warehouse import Warehouse
from ticketlens.samples.labeler import CONTEXT, careful_labeler, sample_labeler, sample_writer
from ticketlens.samples.tickets import raw_tickets, source_tickets
from ticketlens.schemas import CSV_COLUMNS, LABEL_COLUMNS
from ticketlens.session import scratch_path, shuffles_dropped
from ticketlens.sources.ticket_csv import DIALECT, read_ticket_csv

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_built: dict[tuple[str, str], Warehouse] = {}
_changed: dict[tuple[str, str], Warehouse] = {}


def sample_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """All tables of the sample tickets, built once per session and input."""
    key = (spark.conf.get("spark.app.id"), sf_dir)
    if key not in _built:
        house = Warehouse(spark, scratch_path(spark, "tables"))
        house.load_labelled(source_tickets(spark, sf_dir), sample_labeler, context=CONTEXT, stable_batches=True)
        house.tell(sample_writer)
        house.build_models()
        # The tables have fixed names: only the last build is there.
        _built.clear()
        _built[key] = house
    return _built[key]


def resumed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a run over some tickets that a second one, over all, took up."""
    _built.clear()
    house = Warehouse(spark, scratch_path(spark, "tables"))
    tickets = source_tickets(spark, sf_dir)
    house.load_labelled(tickets.where("channel <> 'Chat'"), careful_labeler, context=CONTEXT, steps=2)
    house.load_labelled(tickets, careful_labeler, context=CONTEXT, resume=True)
    return house.labels.select("ticket_id", *LABEL_COLUMNS, "is_fallback")


def changed_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Models of raw tickets of which some were changed, added and removed after the build.

    All of them are of 1995: other months are left as they were built. Built once per session and input.
    """
    key = (spark.conf.get("spark.app.id"), sf_dir)
    if key in _changed:
        return _changed[key]
    _changed.clear()
    house = Warehouse(spark, scratch_path(spark, "tables"), prefix="changed_")
    raw = raw_tickets(spark, sf_dir, body=False)
    house.load_raw(raw)
    house.build_models()
    number = F.substring("ticket_id", 5, 18).cast("bigint")
    year = raw.where("created_at LIKE '1995-%'")
    moved = year.where(number % 13 == 0).withColumns(
        {
            "sentiment": F.lit("Positive"),
            "plan_type": F.lit("Premium"),
            "created_at": F.date_add(F.col("created_at").cast("date"), 40).cast("string"),
        }
    )
    added = year.where(number % 19 == 0).withColumn("ticket_id", F.concat(F.lit("NEW-"), F.substring("ticket_id", 5, 18)))
    removed = year.where((number % 17 == 0) & (number % 13 != 0)).select("ticket_id")
    house.apply_changes(moved.unionByName(added), removed)
    _changed[key] = house
    return house


def faulty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tickets of which some can't be cast, and some lack churn, status or urgency."""
    raw = raw_tickets(spark, sf_dir, body=False)
    number = F.coalesce(F.substring("ticket_id", 5, 18).cast("bigint"), F.lit(1))
    return raw.withColumns(
        {
            "urgency": F.when(number % 37 == 0, "high").when(number % 41 != 0, F.col("urgency")),
            "is_churned": F.when(number % 43 == 0, "maybe").when(number % 47 != 0, F.col("is_churned")),
            "created_at": F.when(number % 53 == 0, "soon").otherwise(F.col("created_at")),
            "status": F.when(number % 59 != 0, F.col("status")),
        }
    )


# -- files of other layouts ----------------------------------------------------------

#: A file is read by one task.
ROWS_PER_FILE = 5_000


def reread(spark: SparkSession, tickets: DataFrame) -> DataFrame:
    """Tickets written with the columns as they come, and read again."""
    path = scratch_path(spark, "tickets-csv")
    with shuffles_dropped(spark):
        tickets.write.options(**DIALECT).options(maxRecordsPerFile=ROWS_PER_FILE, compression="gzip").csv(path)
    return read_ticket_csv(spark, path)


def reread_short_rows(spark: SparkSession, tickets: DataFrame) -> DataFrame:
    """Tickets written without the last field, though the header names it, and read again."""
    path = scratch_path(spark, "tickets-csv")
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = tickets.select(F.to_csv(F.struct(*CSV_COLUMNS[:-1]), options).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.RecordBatch.from_arrays([pa.array([",".join(CSV_COLUMNS)])], ["value"])
        yield head
        left = ROWS_PER_FILE
        for batch in batches:
            while batch.num_rows:
                if not left:
                    yield head
                    left = ROWS_PER_FILE
                some = batch.slice(0, left)
                yield some
                left -= some.num_rows
                batch = batch.slice(some.num_rows)

    # A file has a header and as many rows, so that each begins with its header.
    files = lines.mapInArrow(headed, "value string").write
    with shuffles_dropped(spark):
        files.options(maxRecordsPerFile=ROWS_PER_FILE + 1, compression="gzip").text(path)
    return read_ticket_csv(spark, path)
