"""The dashboard's summaries from one pass over the fact table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import expressions as X
from ticketlens.operators.filters import ALL, apply_filters, filter_choices
from ticketlens.operators.summaries import (
    MEASURES,
    churn_risk_by_primary,
    churned_by_primary,
    is_cells,
    kpi_cards,
    kpis,
    monthly_trend,
    newest_months,
    secondary_breakdown,
    sentiment_counts,
    sentiment_distribution,
    ticket_explorer,
    top_pairs,
    volume_by_primary,
)
from ticketlens.session import one_row, stage

#: Filter columns and group columns of all summaries.
CELL_KEYS = ["plan_type", "is_churned", "primary_label", "secondary_label", "sentiment", "ticket_month"]

#: summary -> its group columns
SUMMARIES: dict[str, list[str]] = {
    "total": [],
    "by_primary": ["primary_label"],
    "by_pair": ["primary_label", "secondary_label"],
    "by_sentiment": ["sentiment"],
    "by_month": ["primary_label", "ticket_month"],
}

_GROUP_COLUMNS = ["primary_label", "secondary_label", "sentiment", "ticket_month"]


def summary_cells(fct: DataFrame) -> DataFrame:
    """Fact rows reduced to counts per combination of filter and group columns.

    All dashboard summaries, under any filter, are sums over these cells, so one
    scan of the fact table serves every interaction until the next refresh.
    """
    return fct.groupBy(*CELL_KEYS).agg(
        X.row_total().alias("tickets"),
        *[F.count_if(condition()).alias(measure) for measure, condition in MEASURES.items()],
    )


def signed_cells(cells: DataFrame, sign: int) -> DataFrame:
    """Cells with all counts times ``sign``: -1 turns them into what has to be taken away."""
    return cells.select(*CELL_KEYS, *[(F.col(c) * sign).alias(c) for c in ["tickets", *MEASURES]])


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells with equal keys summed up; those that hold no ticket any more are left out."""
    summed = cells.groupBy(*CELL_KEYS).agg(*[F.sum(c).alias(c) for c in ["tickets", *MEASURES]])
    return summed.where("tickets <> 0")


def all_summaries(cells: DataFrame) -> DataFrame:
    """Every summary in one aggregation, in long form.

    The rows that grouping sets multiply are cells, not tickets. A null in a
    column that a summary groups by is a null key, and dropped; a null in another
    column only says that the summary does not use it.
    """
    measures = ["tickets", *MEASURES]
    sets = [[F.col(c) for c in keys] for keys in SUMMARIES.values()]
    grouped = cells.groupingSets(sets, *_GROUP_COLUMNS).agg(
        *[F.coalesce(F.sum(m), F.lit(0).cast("bigint")).alias(m) for m in measures],
        *[F.grouping(c).alias(f"_no_{c}") for c in _GROUP_COLUMNS],
    )
    name = F.lit(None).cast("string")
    for summary, keys in SUMMARIES.items():
        match = F.lit(True)
        for c in _GROUP_COLUMNS:
            match = match & (F.col(f"_no_{c}") == F.lit(0 if c in keys else 1))
        name = F.when(match, F.lit(summary)).otherwise(name)
    null_key = F.lit(False)
    for c in _GROUP_COLUMNS:
        null_key = null_key | ((F.col(f"_no_{c}") == 0) & F.col(c).isNull())
    return grouped.where(~null_key).select(name.alias("summary"), *_GROUP_COLUMNS, *measures)


def pick_summary(summaries: DataFrame, name: str, measure: str = "tickets") -> DataFrame:
    """One summary out of ``all_summaries``; groups with nothing to count are left out."""
    rows = summaries.where(F.col("summary") == name)
    if name != "total":
        rows = rows.where(F.col(measure) > 0)
    return rows.select(*SUMMARIES[name], measure)


def stored_slices(df: DataFrame) -> Callable[[str], DataFrame]:
    """Every summary of fact rows or cells, from one aggregation that is stored.

    The returned function gives a summary by name, with all its measures: rows that the
    summary functions take like cells. What is stored has one row per group.
    """
    cells = df if is_cells(df) else summary_cells(df)
    stored = stage(all_summaries(cells), "summaries")
    return lambda name: stored.where(F.col("summary") == name).select(*SUMMARIES[name], "tickets", *MEASURES)


def dashboard(
    cells: DataFrame, fct: DataFrame, plan: str = ALL, primary: str = ALL, churn: str = ALL
) -> dict[str, DataFrame]:
    """Every part of the dashboard under a filter, by name.

    The cells are aggregated once for all parts but the choices, which no filter concerns. Only
    the explorer reads fact rows, of the newest months that are enough.
    """
    shown = stored_slices(apply_filters(cells, plan, primary, churn))
    tickets = apply_filters(fct, plan, primary, churn)
    # A month of tickets without a primary label is in no summary, so the cells are asked.
    months = apply_filters(cells, plan, primary, churn)
    return {
        "filter_choices": filter_choices(cells),
        "kpi_cards": kpi_cards(shown("total")),
        "volume_by_primary": volume_by_primary(shown("by_primary")),
        "sentiment_distribution": sentiment_distribution(shown("by_sentiment")),
        "churn_risk_by_primary": churn_risk_by_primary(shown("by_primary")),
        "monthly_trend": monthly_trend(shown("by_month")),
        "secondary_breakdown": secondary_breakdown(shown("by_pair")),
        "ticket_explorer": ticket_explorer(newest_months(tickets, months)),
    }


def context_table(
    df: DataFrame,
    narrative: DataFrame | None = None,
    plan: str = ALL,
    primary: str = ALL,
    churn: str = ALL,
) -> DataFrame:
    """What an analyst is told about the current view, in long form.

    ``df`` holds the filtered fact rows or cells, which are aggregated once for all sections;
    the other arguments say which filter was used. Columns ``(section_no, section, rank, key1, key2, value)``;
    only the top list is ranked, the others order by key.
    """
    spark, shown = df.sparkSession, stored_slices(df)
    no_rank = F.lit(None).cast("int")
    no_key = F.lit(None).cast("string")

    def rows(frame, number, section, rank, key1, key2, value):
        return frame.select(
            F.lit(number).alias("section_no"),
            F.lit(section).alias("section"),
            rank.cast("int").alias("rank"),
            key1.alias("key1"),
            key2.alias("key2"),
            value.cast("string").alias("value"),
        )

    def spread(frame, number, section, items):
        pairs = F.array(
            *[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in items.items()]
        )
        exploded = frame.select(F.explode(pairs).alias("p"))
        return rows(exploded, number, section, no_rank, F.col("p.k"), no_key, F.col("p.v"))

    filters = spread(
        one_row(spark), 1, "filter", {"Plan": F.lit(plan), "Primary": F.lit(primary), "Churn": F.lit(churn)}
    )
    totals = spread(
        kpis(shown("total")),
        2,
        "total",
        {
            "Total tickets": F.col("total_tickets"),
            "Churn risk signals": F.col("churn_signals"),
            "Negative sentiment tickets": F.col("negative_tickets"),
            "High urgency tickets": F.col("high_urgency_tickets"),
        },
    )
    # At most ten rows reach this array, so ranking them needs no window.
    ranked = (
        top_pairs(shown("by_pair"), 10)
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.col("count")).alias("n"), "primary_label", "secondary_label"))
            ).alias("top")
        )
        .select(F.posexplode("top").alias("pos", "t"))
    )
    top = rows(
        ranked,
        3,
        "top_categories",
        F.col("pos") + 1,
        F.col("t.primary_label"),
        F.col("t.secondary_label"),
        -F.col("t.n"),
    )
    churned = rows(
        churned_by_primary(shown("by_primary")), 4, "churned_tickets", no_rank, F.col("primary_label"), no_key, F.col("churned_tickets")
    )
    moods = rows(sentiment_counts(shown("by_sentiment")), 5, "sentiment", no_rank, F.col("sentiment"), no_key, F.col("count"))
    text = narrative if narrative is not None else one_row(spark).where("false").select(no_key.alias("narrative"))
    # The aggregate gives a row, and so the default text, even without a narrative.
    told = rows(
        text.agg(F.coalesce(F.first("narrative"), F.lit("Not available")).alias("narrative")),
        6,
        "narrative",
        no_rank,
        no_key,
        no_key,
        F.col("narrative"),
    )
    parts = [filters, totals, top, churned, moods, told]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.orderBy("section_no", "rank", "key1")
