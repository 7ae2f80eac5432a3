"""Ticket files dropped into a folder, labelled and modelled as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketlens.operators.labeling import Labeler, attach_labels, label_tickets, labels_of
from ticketlens.plans.models import fact, quarantine, staging
from ticketlens.session import scratch_folder, stage
from ticketlens.sources.ticket_csv import parse_files, well_formed


def ticket_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Well-formed tickets of new files of a folder, at most ``max_files`` per micro-batch.

    Each file is read whole and by the names of its own header, as ``read_ticket_csv`` does.
    """
    return well_formed(ticket_row_stream(spark, folder, max_files))


def ticket_row_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """As ``ticket_stream``, malformed rows included (``malformed`` tells them apart)."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files)
    files = reader.schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return parse_files(files)


def first_arrivals(tickets: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop a ticket id that arrives again within ``delay`` of its first arrival.

    Time is that of arrival, so a ticket is never late, however old: a backlog may come in
    any order. State is kept for the delay only.
    """
    stamped = tickets.withColumn("arrived_at", F.current_timestamp())
    return (
        stamped.withWatermark("arrived_at", delay)
        .dropDuplicatesWithinWatermark(["ticket_id"])
        .transform(with_creation_time)
    )


def with_creation_time(tickets: DataFrame) -> DataFrame:
    """Tickets with the text of their date as a timestamp."""
    return tickets.withColumn("created_ts", F.to_timestamp("created_at"))


def daily_trend(arrivals: DataFrame) -> DataFrame:
    """Tickets per creation day and primary label so far; for update or complete output."""
    return (
        arrivals.where(F.col("primary_label").isNotNull())
        .groupBy(F.to_date("created_ts").alias("day"), "primary_label")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )


def start_fact_stream(
    tickets: DataFrame,
    labeler: Labeler,
    target: str,
    checkpoint: str,
    context: tuple[str, ...] = (),
    lenient: bool = False,
    **trigger,
) -> StreamingQuery:
    """Label each micro-batch and add its fact rows below ``target``.

    A micro-batch owns one folder and replaces it when it is replayed, so a
    restart neither loses nor repeats tickets. It is read once, and what it stages goes
    when its rows are written. With ``lenient``, rows that cannot be cast are stored below
    ``target``-quarantine instead of failing the batch.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_folder(spark, "micro-batch") as folder:
            rows = stage(batch, "tickets", folder)
            if rows.isEmpty():
                return
            labels = labels_of(label_tickets(rows, labeler, context=context, folder=folder))
            raw = attach_labels(rows, labels, folder)
            if lenient:
                raw = stage(raw, "raw", folder)
                quarantine(raw).write.mode("overwrite").parquet(f"{target}-quarantine/load={batch_id}")
            fact(staging(raw, lenient)).write.mode("overwrite").parquet(f"{target}/load={batch_id}")

    writer = tickets.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
