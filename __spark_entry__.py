
from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent)
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

import ticket_oracle  # noqa: E402
from ticketlens.functions import expressions as X  # noqa: E402
from ticketlens.operators import assign, quality, summaries  # noqa: E402
from ticketlens.operators.batching import BATCH_SIZE, assign_batches, assign_batches_apart  # noqa: E402
from ticketlens.operators.filters import apply_filters, filter_choices  # noqa: E402
from ticketlens.operators.labeling import (  # noqa: E402
    attach_labels,
    label_tickets,
    labels_of,
    prompt_lines,
    render_prompts,
    unlabelled,
)
from ticketlens.operators.packed_texts import without_text  # noqa: E402
from ticketlens.operators.toplists import top_keys  # noqa: E402
from ticketlens.plans.overview import all_summaries, context_table, dashboard, pick_summary, summary_cells  # noqa: E402
from ticketlens.plans.models import INSIGHT_KEYS, fact, insights, quarantine, staging  # noqa: E402
from ticketlens.plans.narrative import write_narrative  # noqa: E402
from ticketlens.plans.warehouse import Warehouse  # noqa: E402
from ticketlens.samples.labeler import CONTEXT, careful_labeler, sample_labeler, sample_writer  # noqa: E402
from ticketlens.samples.tickets import raw_tickets, source_tickets  # noqa: E402
from ticketlens.samples.warehouse import (  # noqa: E402
    changed_warehouse,
    faulty_raw,
    reread,
    reread_short_rows,
    resumed_labels,
    sample_warehouse,
)
from ticketlens.schemas import CSV_COLUMNS, RAW_COLUMNS, REPLACED_COLUMNS  # noqa: E402
from ticketlens.session import DEFAULT_CONF, scratch_path  # noqa: E402
from ticketlens.sources.tables import append_table, latest_narrative, reset_narratives  # noqa: E402
from ticketlens.sources.ticket_csv import read_ticket_csv, write_ticket_csv  # noqa: E402
from ticketlens.streaming.live_tickets import daily_trend, with_creation_time  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

TESTDATA = "/root/testdata"


def _prepare(spark: SparkSession) -> None:
    # Month buckets and casts of dates depend on it.
    spark.conf.set("spark.sql.session.timeZone", DEFAULT_CONF["spark.sql.session.timeZone"])


def _fact(spark: SparkSession, sf_dir: str, body: bool = False) -> DataFrame:
    return fact(staging(raw_tickets(spark, sf_dir, body)))


def _on_fact(query: Callable[[DataFrame], DataFrame], **filters: str) -> Query:
    return lambda spark, sf_dir: query(apply_filters(_fact(spark, sf_dir), **filters))


def _on_cells(query: Callable[[DataFrame], DataFrame], **filters: str) -> Query:
    return lambda spark, sf_dir: query(apply_filters(summary_cells(_fact(spark, sf_dir)), **filters))


def _filtered(**filters: str) -> Query:
    return lambda spark, sf_dir: apply_filters(_fact(spark, sf_dir, body=True), **filters)


# -- labelling -----------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_tickets(source_tickets(spark, sf_dir), sample_labeler, context=CONTEXT, stable_batches=True)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(_answers(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str, body: bool) -> DataFrame:
    tickets, labels = source_tickets(spark, sf_dir, body), _labels(spark, sf_dir)
    joined = without_text(tickets, lambda rows: attach_labels(rows, labels), "ticket_body") if body else attach_labels(tickets, labels)
    return joined.select(*RAW_COLUMNS)


def _checked(check: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: check(fact(staging(_enriched(spark, sf_dir, body=False))))


def _label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_batches(source_tickets(spark, sf_dir, body=False).select("ticket_id"))


def _label_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = source_tickets(spark, sf_dir).select("ticket_id", "ticket_body")
    return prompt_lines(assign_batches_apart(tickets, "ticket_body"))


def _label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = list(dict.fromkeys(["ticket_id", *REPLACED_COLUMNS, *CONTEXT, "ticket_body"]))
    prompts = render_prompts(assign_batches(source_tickets(spark, sf_dir), columns=asked), CONTEXT)
    return prompts.select("batch_id", F.size("tickets").alias("tickets"), "prompt")


def _label_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    tickets = F.sum("tickets")
    return answers.agg(
        tickets.alias("tickets"),
        X.batches_needed(tickets, BATCH_SIZE).alias("batches_needed"),
        X.row_total().alias("batches"),
        F.count_if("is_fallback").alias("failed_batches"),
        F.sum(F.size("labels")).cast("bigint").alias("labels"),
    )


def _labels_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).drop("label_pos").withColumn("urgency", X.to_whole_number(F.col("urgency")))


def _labels_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = label_tickets(source_tickets(spark, sf_dir), careful_labeler, context=CONTEXT)
    return labels_of(answers).drop("batch_id", "label_pos").withColumn("urgency", X.to_whole_number(F.col("urgency")))


def _labels_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = source_tickets(spark, sf_dir, body=False).where(F.col("ticket_id").isNotNull())
    return unlabelled(tickets, _labels(spark, sf_dir)).select("ticket_id")


def _join_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.label_join_accounting(source_tickets(spark, sf_dir, body=False), _labels(spark, sf_dir))


def _dq_unique_ids(fct: DataFrame) -> DataFrame:
    return quality.unique_key(fct, ["ticket_id"]).unionByName(
        quality.unique_group_key(insights(fct), INSIGHT_KEYS)
    )


def _dq_not_null(fct: DataFrame) -> DataFrame:
    columns = ["ticket_id", "user_id", "is_churned", "primary_label", "secondary_label", "sentiment", "urgency"]
    return quality.run_checks(fct, quality.not_null(columns))


def _dq_taxonomy(fct: DataFrame) -> DataFrame:
    return quality.run_checks(quality.with_taxonomy_marks(fct), quality.taxonomy_checks())


def _pair_violations(fct: DataFrame) -> DataFrame:
    return quality.pair_violations(fct).select("ticket_id", "primary_label", "secondary_label", "urgency")


# -- sources, sinks, narrative -------------------------------------------------------


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tickets-csv")
    write_ticket_csv(source_tickets(spark, sf_dir).select(*CSV_COLUMNS), path, compression="gzip")
    return read_ticket_csv(spark, path)


def _latest_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = write_narrative(sample_warehouse(spark, sf_dir).raw, sample_writer)
    # Under another name than the warehouse's own table, which keeps its narrative.
    table = "sample_narratives"
    reset_narratives(spark, table, scratch_path(spark, "narratives"))
    stamps = [("an early one", "2024-01-01 00:00:00"), ("Also late", "2024-03-01 00:00:00"), (text, "2024-03-01 00:00:00")]
    stored = spark.createDataFrame(stamps, "narrative STRING, at STRING")
    append_table(stored.select(F.col("at").cast("timestamp").alias("generated_at"), "narrative"), table)
    return latest_narrative(spark, table)


def _top_free_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label pairs where a third of the labels are free text with a long tail."""
    raw = raw_tickets(spark, sf_dir, body=False)
    number = F.substring("ticket_id", 5, 18).cast("bigint")
    free = F.concat(F.col("secondary_label"), F.lit(" / case "), (number % 5003).cast("string"))
    labelled = raw.withColumn("secondary_label", F.when(number % 3 == 0, free).otherwise(F.col("secondary_label")))
    return top_keys(labelled, summaries.PAIR, 20)


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = sample_warehouse(spark, sf_dir)
    filters = {"plan": "Standard", "churn": "Churned Only"}
    return context_table(apply_filters(house.cells, **filters), house.narrative, **filters)


def _dashboard_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = sample_warehouse(spark, sf_dir)
    parts = dashboard(house.cells, house.fact, plan="Standard", churn="Churned Only")
    shown = {
        "kpi_cards": ("card", "value"),
        "volume_by_primary": ("primary_label", "tickets"),
        "churn_risk_by_primary": ("primary_label", "churn_signals"),
        "ticket_explorer": ("ticket_id", "created_at"),
    }
    rows = [
        parts[name].select(F.lit(name).alias("part"), F.col(k).alias("item"), F.col(v).cast("string").alias("value"))
        for name, (k, v) in shown.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _cached_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI cards from cells that are kept in memory until they are a minute old."""
    return summaries.kpi_cards(sample_warehouse(spark, sf_dir).cached_cells(ttl=60).get())


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = sample_warehouse(spark, sf_dir)
    counts = [t.select(F.lit(n).alias("model"), F.lit(1).alias("one")) for n, t in house.models.items()]
    return reduce(DataFrame.unionByName, counts).groupBy("model").agg(F.count("one").alias("rows"))


def _stored(pick: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: pick(sample_warehouse(spark, sf_dir))


def _csv_of(*columns: str) -> Query:
    return lambda spark, sf_dir: reread(spark, source_tickets(spark, sf_dir).selectExpr(*columns))


# -- assignment ----------------------------------------------------------------------


#: Review desks and the share of tickets, in percent, that each can take.
_DESKS = {"first line": 60, "second line": 30, "specialist": 10}
#: By urgency, who answers: urgent tickets go to more experienced desks.
_DESKS_BY_URGENCY = {
    "1": _DESKS,
    "2": {"first line": 40, "second line": 40, "specialist": 20},
    "3": {"first line": 10, "second line": 40, "specialist": 50},
}


def _weighted_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tickets(spark, sf_dir, body=False).where("ticket_id IS NOT NULL")
    number = "cast(substring(ticket_id, 5) AS BIGINT)"
    dealt = raw.selectExpr("ticket_id", "urgency", f"({number} * 31 + 7) % 100 AS bucket")
    return dealt.select(
        "ticket_id",
        "urgency",
        assign.weighted_pick("bucket", _DESKS).alias("desk"),
        assign.weighted_pick_by("urgency", "bucket", _DESKS_BY_URGENCY).alias("urgent_desk"),
    )


def _ticket_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders for tickets that are not resolved: one per week of their urgency."""
    stg = staging(raw_tickets(spark, sf_dir, body=False)).where("status <> 'Resolved'")
    n = F.col("reminder_no")
    return assign.fan_out(stg.select("ticket_id", "urgency", "created_at"), F.col("urgency"), "reminder_no").select(
        "ticket_id",
        "reminder_no",
        X.hashed_id("REM-", F.col("ticket_id"), n.cast("string")).alias("reminder_id"),
        X.days_before(F.col("created_at"), -7 * n).alias("due_on"),
    )


def _shuffled_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = source_tickets(spark, sf_dir, body=False).select("ticket_id", "user_id")
    return assign.shuffle_rows(ids.dropna(), "ticket_id")


_FLAGS = ["ticket_id", "status", "is_negative_sentiment", "is_high_urgency", "is_churn_risk_signal", "ticket_month"]

_QUERIES: dict[str, Query] = {
    # models
    "raw_support_tickets": lambda spark, d: raw_tickets(spark, d),
    "stg_support_tickets": lambda spark, d: staging(raw_tickets(spark, d)),
    "fct_support_tickets": lambda spark, d: _fact(spark, d, body=True),
    "support_insights": _on_fact(insights),
    # filters
    "filtered_tickets_standard_churned": _filtered(plan="Standard", churn="Churned Only"),
    "filtered_tickets_billing_active": _filtered(primary="Billing", churn="Active Only"),
    "filter_choices": _on_fact(filter_choices),
    # dashboard
    "kpis": _on_fact(summaries.kpis),
    "kpi_cards": _on_fact(summaries.kpi_cards),
    "kpi_cards_empty_filter": _on_fact(summaries.kpi_cards, plan="Enterprise"),
    "volume_by_primary": _on_fact(summaries.volume_by_primary),
    "sentiment_distribution": _on_fact(summaries.sentiment_distribution),
    "churn_risk_by_primary": _on_fact(summaries.churn_risk_by_primary),
    "churned_by_primary": _on_fact(summaries.churned_by_primary),
    "monthly_trend": _on_fact(summaries.monthly_trend),
    "secondary_breakdown": _on_fact(summaries.secondary_breakdown),
    "top20_label_pairs": _on_fact(lambda df: summaries.top_pairs(df, 20)),
    "top10_label_pairs": _on_fact(lambda df: summaries.top_pairs(df, 10), plan="Premium"),
    "top20_free_pairs": _top_free_pairs,
    "ticket_explorer": _on_fact(summaries.ticket_explorer),
    "summary_cells": _on_fact(summary_cells),
    "dashboard_onepass": _on_cells(all_summaries),
    "dashboard_onepass_churn_risk": _on_cells(
        lambda cells: pick_summary(all_summaries(cells), "by_primary", "churn_signals"), plan="Basic"
    ),
    "volume_by_primary_from_cells": _on_cells(summaries.volume_by_primary, churn="Active Only"),
    "context_table": _context,
    "latest_narrative": _latest_narrative,
    # rows that can't be cast
    "stg_lenient": lambda spark, d: staging(faulty_raw(spark, d), lenient=True).drop("ticket_body"),
    "stg_quarantine": lambda spark, d: quarantine(faulty_raw(spark, d)).drop("ticket_body"),
    "fct_null_inputs": lambda spark, d: fact(staging(faulty_raw(spark, d), lenient=True)).select(*_FLAGS),
    "kpis_null_inputs": lambda spark, d: summaries.kpis(fact(staging(faulty_raw(spark, d), lenient=True))),
    # stored tables, as a user builds and reads them
    "stored_raw": _stored(lambda house: house.raw),
    "stored_staging": _stored(lambda house: house.staging),
    "stored_fact": _stored(lambda house: house.fact),
    "stored_insights": _stored(lambda house: house.insights),
    "stored_cells": _stored(lambda house: house.cells),
    "stored_row_counts": _row_counts,
    "quality_report": _stored(lambda house: house.quality),
    "dashboard_parts": _dashboard_parts,
    "top20_labelled_pairs": _stored(lambda house: summaries.top_pairs(house.raw, 20)),
    "stored_explorer": _stored(lambda house: house.newest_tickets()),
    "stored_explorer_filtered": _stored(lambda house: house.newest_tickets(plan="Basic", primary="Billing", churn="Churned Only")),
    "cached_snapshot": _cached_snapshot,
    "labels_resumed": resumed_labels,
    # after changes to some tickets
    "insights_after_change": lambda spark, d: changed_warehouse(spark, d).insights,
    "fact_after_change": lambda spark, d: changed_warehouse(spark, d).fact.drop("ticket_body"),
    "cells_after_change": lambda spark, d: changed_warehouse(spark, d).cells,
    # taxonomy
    "daily_trend": lambda spark, d: daily_trend(with_creation_time(source_tickets(spark, d, body=False))),
    "taxonomy_pairs": _on_fact(lambda df: quality.taxonomy_volume(df, quality.PAIR)),
    "taxonomy_leaves": _on_fact(lambda df: quality.taxonomy_volume(df, quality.LEAF)),
    # labelling
    "label_batches": _label_batches,
    "label_prompt_lines": _label_prompt_lines,
    "label_prompts": _label_prompts,
    "label_batch_report": _label_batch_report,
    "labels_parsed": _labels_parsed,
    "labels_in_place": _labels_in_place,
    "labels_remaining": _labels_remaining,
    "enriched_tickets": lambda spark, d: _enriched(spark, d, body=True),
    "label_join_accounting": _join_accounting,
    # quality checks, on tickets with the labeller's faults
    "dq_unique_ids": _checked(_dq_unique_ids),
    "dq_not_null": _checked(_dq_not_null),
    "dq_accepted_values": _checked(lambda df: quality.run_checks(df, quality.label_checks())),
    "dq_taxonomy_violations": _checked(_dq_taxonomy),
    "dq_pair_violation_rows": _checked(_pair_violations),
    "dq_ranges": _checked(lambda df: quality.run_checks(df, quality.range_checks())),
    # files and rows
    "csv_roundtrip": _csv_roundtrip,
    "csv_reordered_columns": _csv_of(*reversed(CSV_COLUMNS)),
    "csv_extra_columns": _csv_of("priority", *CSV_COLUMNS[6:], "priority AS other", *CSV_COLUMNS[:6]),
    "csv_short_rows": lambda spark, d: reread_short_rows(spark, source_tickets(spark, d)),
    "weighted_assignment": _weighted_assignment,
    "ticket_fanout": _ticket_fanout,
    "shuffled_tickets": _shuffled_tickets,
}


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _prepare(spark)
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the insights model on the smallest tables."""
    return queries()["support_insights"](spark, f"{TESTDATA}/sf0.001")


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the corpus operators, which may be left out of an installation."""
    if importlib.util.find_spec("ticketlens.llm") is None:
        return {}, {}
    from ticketlens.llm import registry

    found, sql = registry.queries(), registry.oracle_sql()
    if importlib.util.find_spec("corpus_pipeline") is not None:
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Query]:
    return {name: _registered(query) for name, query in {**_QUERIES, **_corpus()[0]}.items()}


def oracle_sql() -> dict[str, str]:
    return {**ticket_oracle.build(), **_corpus()[1]}
