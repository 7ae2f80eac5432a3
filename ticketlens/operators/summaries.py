"""KPI cards, group counts and ranked lists.

Every function takes fact rows, or the summary cells of ``plans.overview``,
which stand for many tickets each. Rows with a null group key are left out, as
a pandas group-by does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import expressions as X
from ticketlens.operators.filters import pick_columns
from ticketlens.schemas import EXPLORER_COLUMNS

PAIR = ["primary_label", "secondary_label"]

#: measure -> the condition that counts a fact row towards it
MEASURES = {
    "churned_tickets": lambda: F.coalesce(F.col("is_churned"), F.lit(False)),
    "churn_signals": lambda: F.col("is_churn_risk_signal"),
    "negative_tickets": lambda: F.col("is_negative_sentiment"),
    "high_urgency_tickets": lambda: F.col("is_high_urgency"),
    "escalated_tickets": lambda: X.escalated(F.col("status")),
}


def is_cells(df: DataFrame) -> bool:
    """Whether rows are counts (a column for all tickets, and for some measure) or tickets."""
    return "tickets" in df.columns and not set(MEASURES).isdisjoint(df.columns)


def total_tickets(df: DataFrame) -> Column:
    if is_cells(df):
        return F.coalesce(F.sum("tickets"), F.lit(0).cast("bigint"))
    return X.row_total()


def total_of(df: DataFrame, measure: str) -> Column:
    """Tickets counted by a measure; 0, not null, over no rows."""
    if is_cells(df):
        return F.coalesce(F.sum(measure), F.lit(0).cast("bigint"))
    return F.count_if(MEASURES[measure]())


def count_by(df: DataFrame, keys: list[str], name: str = "tickets") -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(total_tickets(df).alias(name))


def measure_by(df: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """Tickets with a property per key; keys without any do not appear."""
    if is_cells(df):
        hits = df.where(F.col(measure) > 0)
        value = F.sum(measure)
    else:
        hits = df.where(MEASURES[measure]())
        value = X.row_total()
    return hits.dropna(subset=keys).groupBy(*keys).agg(value.alias(measure))


# -- KPI cards -----------------------------------------------------------------------


def kpis(df: DataFrame) -> DataFrame:
    """One row of totals, also over no tickets."""
    totals = df.agg(
        total_tickets(df).alias("total_tickets"),
        *[
            total_of(df, m).alias(m)
            for m in ("churn_signals", "negative_tickets", "high_urgency_tickets", "escalated_tickets")
        ],
    )
    return totals.withColumn(
        "negative_pct", X.percent_half_even(F.col("negative_tickets"), F.col("total_tickets"))
    )


def kpi_cards(df: DataFrame) -> DataFrame:
    """The five cards as display text: ``(card_no, card, value, delta)``."""
    delta = F.when(
        F.col("total_tickets") > 0, F.concat(F.col("negative_pct").cast("string"), F.lit("%"))
    ).otherwise(F.lit("0%"))
    none = F.lit(None).cast("string")
    # Card titles, in display order.
    cards = [
        ("Total Tickets", "total_tickets", none),
        ("Churn Risk Signals", "churn_signals", none),
        ("Negative Sentiment", "negative_tickets", delta),
        ("High Urgency", "high_urgency_tickets", none),
        ("Escalated", "escalated_tickets", none),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("card_no"),
                F.lit(title).alias("card"),
                X.thousands(F.col(column)).alias("value"),
                extra.alias("delta"),
            )
            for i, (title, column, extra) in enumerate(cards, 1)
        ]
    )
    return kpis(df).select(F.explode(rows).alias("c")).select("c.*").orderBy("card_no")


# -- charts --------------------------------------------------------------------------


def volume_by_primary(df: DataFrame) -> DataFrame:
    return count_by(df, ["primary_label"]).orderBy(F.asc("tickets"), "primary_label")


def sentiment_counts(df: DataFrame) -> DataFrame:
    return count_by(df, ["sentiment"], "count")


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """Counts and their share. The total is a scalar subquery over the same aggregate,
    whose shuffle both uses share; no window pulls the groups into one task."""
    counts = sentiment_counts(df)
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share_pct", X.percent(F.col("count"), total)).orderBy("sentiment")


def churn_risk_by_primary(df: DataFrame) -> DataFrame:
    return measure_by(df, "churn_signals", ["primary_label"]).orderBy(F.asc("churn_signals"), "primary_label")


def churned_by_primary(df: DataFrame) -> DataFrame:
    return measure_by(df, "churned_tickets", ["primary_label"]).orderBy(
        F.desc("churned_tickets"), "primary_label"
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    return count_by(df, ["ticket_month", "primary_label"]).orderBy("ticket_month", "primary_label")


def secondary_breakdown(df: DataFrame) -> DataFrame:
    return count_by(df, PAIR).orderBy("primary_label", F.desc("tickets"), "secondary_label")


def top_pairs(df: DataFrame, n: int) -> DataFrame:
    """The n most frequent label pairs; labels break ties, so the list is repeatable."""
    return count_by(df, PAIR, "count").orderBy(F.desc("count"), *PAIR).limit(n)


def ticket_explorer(df: DataFrame, n: int = 100) -> DataFrame:
    """The newest tickets: each task keeps its own n newest, one merges them.

    Of one day they go by id; rows of one id, which differ in their labels, by urgency.
    """
    newest_first = [F.desc_nulls_last("created_at"), F.asc("ticket_id"), F.asc_nulls_first("urgency")]
    return pick_columns(df, EXPLORER_COLUMNS).orderBy(*newest_first).limit(n)


def newest_months(fct: DataFrame, counted: DataFrame, n: int = 100) -> DataFrame:
    """The fact rows of the newest months that hold ``n`` tickets together.

    ``counted`` says how many tickets a month has: cells, or fact rows, under the filter that
    ``fct`` has, and of the same build. The months are walked from the newest on, n of them at
    most, and the walk ends as soon as they hold enough; a fact table stored by month is read
    in these only. Tickets without a date come last, so they are left out unless all dated ones are
    too few.
    """
    dated = counted.where(F.col("ticket_month").isNotNull()).groupBy("ticket_month").agg(total_tickets(counted).alias("_n"))
    held = 0
    for row in dated.where("_n > 0").orderBy(F.desc("ticket_month")).limit(n).collect():
        held += row["_n"]
        if held >= n:
            return fct.where(F.col("ticket_month") >= F.lit(row["ticket_month"]))
    return fct
