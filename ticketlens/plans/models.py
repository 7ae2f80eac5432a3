"""Staging, fact and insight models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import expressions as X
from ticketlens.operators.summaries import total_of, total_tickets

INSIGHT_KEYS = ["primary_label", "secondary_label", "plan_type", "ticket_month"]

_CASTS = {"is_churned": X.to_boolean, "urgency": X.to_whole_number, "created_at": X.to_day}

# Columns of the staging model, in order.
STAGING_COLUMNS = [
    "ticket_id",
    "user_id",
    "plan_type",
    "channel",
    "status",
    "is_churned",
    "primary_label",
    "secondary_label",
    "tertiary_label",
    "sentiment",
    "urgency",
    "one_line_summary",
    "ticket_body",
    "created_at",
]


def _identified(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("ticket_id").isNotNull() & F.col("user_id").isNotNull())


def staging(raw: DataFrame, lenient: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Typed tickets with both ids. A value that cannot be cast fails the job.

    With ``lenient`` such rows are left out instead; ``quarantine`` returns them. ``carried`` are
    further columns of ``raw`` to keep as they are.
    """
    rows = _identified(raw)
    if lenient:
        rows = rows.where(~_has_bad_cast())
    return rows.select(
        [_CASTS[c](F.col(c), lenient).alias(c) if c in _CASTS else F.col(c) for c in [*STAGING_COLUMNS, *carried]]
    )


def staging_sql(source: str, lenient: bool = False) -> str:
    """``staging`` of a stored table as SQL, for a view that the catalog keeps."""
    cast = "TRY_CAST" if lenient else "CAST"
    casts = {
        "is_churned": f"{cast}(is_churned AS BOOLEAN)",
        "urgency": f"{cast}(BROUND({cast}(urgency AS DOUBLE)) AS INT)",
        "created_at": f"{cast}(created_at AS DATE)",
    }
    columns = ", ".join(f"{casts[c]} AS {c}" if c in casts else c for c in STAGING_COLUMNS)
    good = "".join(f" AND ({c} IS NULL OR {x} IS NOT NULL)" for c, x in casts.items()) if lenient else ""
    return f"SELECT {columns} FROM {source} WHERE ticket_id IS NOT NULL AND user_id IS NOT NULL{good}"


def quarantine(raw: DataFrame) -> DataFrame:
    """The identified raw rows that a lenient ``staging`` leaves out."""
    return _identified(raw).where(_has_bad_cast())


def _has_bad_cast():
    bad = F.lit(False)
    for name, cast in _CASTS.items():
        bad = bad | (F.col(name).isNotNull() & cast(F.col(name), True).isNull())
    return bad


def fact(stg: DataFrame) -> DataFrame:
    """Staging plus three flags and the month. One narrow pass, no shuffle."""
    return stg.select(
        "*",
        X.negative_sentiment(F.col("sentiment")).alias("is_negative_sentiment"),
        X.high_urgency(F.col("urgency")).alias("is_high_urgency"),
        X.churn_risk(F.col("is_churned"), F.col("sentiment")).alias("is_churn_risk_signal"),
        X.month_start(F.col("created_at")).alias("ticket_month"),
    )


def insights(tickets: DataFrame) -> DataFrame:
    """Counts and shares per label pair, plan and month, of fact rows or summary cells.

    Each task first reduces its rows to one per group, so a group with a large
    part of all tickets costs the shuffle no more than any other.
    """
    total = total_tickets(tickets)
    churned = total_of(tickets, "churned_tickets")
    negative = total_of(tickets, "negative_tickets")
    return tickets.groupBy(*INSIGHT_KEYS).agg(
        total.alias("total_tickets"),
        churned.alias("churned_customer_tickets"),
        negative.alias("negative_sentiment_tickets"),
        total_of(tickets, "high_urgency_tickets").alias("high_urgency_tickets"),
        total_of(tickets, "churn_signals").alias("churn_risk_signals"),
        total_of(tickets, "escalated_tickets").alias("escalated_tickets"),
        X.percent(churned, total).alias("pct_from_churned_customers"),
        X.percent(negative, total).alias("pct_negative_sentiment"),
    )
