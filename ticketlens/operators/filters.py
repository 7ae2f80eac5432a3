"""The dashboard's filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import one_row

# The choices of the filters.
ALL = "All"
CHURNED_ONLY = "Churned Only"
ACTIVE_ONLY = "Active Only"


def apply_filters(df: DataFrame, plan: str = ALL, primary: str = ALL, churn: str = ALL) -> DataFrame:
    """Keep the rows that match; ``All`` leaves a column unfiltered.

    Works on fact rows and on summary cells. A row with an unknown churn state
    belongs to neither churn choice.
    """
    if churn not in (ALL, CHURNED_ONLY, ACTIVE_ONLY):
        raise ValueError(f"unknown churn filter: {churn}")
    if plan != ALL:
        df = df.where(F.col("plan_type") == plan)
    if primary != ALL:
        df = df.where(F.col("primary_label") == primary)
    if churn != ALL:
        df = df.where(F.col("is_churned") if churn == CHURNED_ONLY else ~F.col("is_churned"))
    return df


def pick_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select([name for name in wanted if name in df.columns])


def filter_choices(df: DataFrame, columns: tuple[str, ...] = ("plan_type", "primary_label")) -> DataFrame:
    """``(filter, is_value, choice)``: "All" first, then the distinct non-null values.

    Order by ``filter, is_value, choice`` to list them. All columns are read in one pass.
    """
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).alias("choice")) for c in columns])
    values = (
        df.select(F.explode(pairs).alias("pair"))
        .select("pair.filter", F.lit(1).alias("is_value"), "pair.choice")
        .where(F.col("choice").isNotNull())
        .distinct()
    )
    alls = one_row(spark).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("filter"),
        F.lit(0).alias("is_value"),
        F.lit(ALL).alias("choice"),
    )
    return alls.unionByName(values).orderBy("filter", "is_value", "choice")
