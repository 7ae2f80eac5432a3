"""Data-quality checks; each gives ``(check_name, column_name, failing_rows)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import expressions as X
from ticketlens.operators.unique_keys import repeated_keys
from ticketlens.schemas import SENTIMENTS, SUMMARY_MAX_WORDS, URGENCY_RANGE
from ticketlens.taxonomy import PRIMARY_LABELS, TAXONOMY, taxonomy_leaves, taxonomy_pairs

PAIR = ["primary_label", "secondary_label"]
LEAF = ["primary_label", "secondary_label", "tertiary_label"]


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row; null keys are not tested.

    Keys are compared by fingerprints first, so unique ones are not shuffled (``repeated_keys``).
    """
    repeated = repeated_keys(df.dropna(subset=keys), keys)
    return repeated.agg(X.row_total().alias("failing_rows")).select(
        F.lit("unique").alias("check_name"), F.lit(",".join(keys)).alias("column_name"), "failing_rows"
    )


def unique_group_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """As ``unique_key``, for a model grouped by ``keys``, where null is a value too."""
    repeated = df.groupBy(*keys).agg(X.row_total().alias("n")).where("n > 1")
    return repeated.agg(X.row_total().alias("failing_rows")).select(
        F.lit("unique").alias("check_name"), F.lit(",".join(keys)).alias("column_name"), "failing_rows"
    )


# -- row checks: a condition each, all counted in one pass ---------------------------

Check = tuple[str, str, Column]


def not_null(columns: list[str]) -> list[Check]:
    return [("not_null", c, F.col(c).isNull()) for c in columns]


def accepted_values(column: str, values: list[str]) -> Check:
    """Null is not a wrong value."""
    return ("accepted_values", column, F.col(column).isNotNull() & ~F.col(column).isin(values))


def accepted_range(column: str, low: int, high: int) -> Check:
    return ("accepted_range", column, F.col(column).isNotNull() & ~F.col(column).between(low, high))


def max_words(column: str, words: int) -> Check:
    text = X.strip(F.col(column))
    count = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    return ("max_words", column, F.col(column).isNotNull() & (count > words))


def label_checks() -> list[Check]:
    return [accepted_values("primary_label", PRIMARY_LABELS), accepted_values("sentiment", SENTIMENTS)]


def range_checks() -> list[Check]:
    return [accepted_range("urgency", *URGENCY_RANGE), max_words("one_line_summary", SUMMARY_MAX_WORDS)]


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Count the failing rows of all checks in one scan."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    report = F.array(
        *[
            F.struct(
                F.lit(check).alias("check_name"),
                F.lit(column).alias("column_name"),
                F.col(f"c{i}").alias("failing_rows"),
            )
            for i, (check, column, _) in enumerate(checks)
        ]
    )
    return counts.select(F.explode(report).alias("r")).select("r.*")


# -- taxonomy ------------------------------------------------------------------------


def pair_violations(df: DataFrame) -> DataFrame:
    """Rows whose secondary label does not belong to their primary label.

    The taxonomy has 24 (72 below) fixed rows, so broadcasting it is safe at any scale.
    """
    return df.dropna(subset=PAIR).join(F.broadcast(taxonomy_pairs(df.sparkSession)), PAIR, "left_anti")


def leaf_violations(df: DataFrame) -> DataFrame:
    """Rows whose tertiary label does not belong to their label pair."""
    return df.dropna(subset=LEAF).join(F.broadcast(taxonomy_leaves(df.sparkSession)), LEAF, "left_anti")


def with_taxonomy_marks(df: DataFrame) -> DataFrame:
    """Add ``pair_known`` and ``leaf_known`` (null where a label is null), by lookup in literal maps."""

    def known(columns: list[str], entries: list[tuple[str, ...]]) -> Column:
        table = F.create_map(*[x for e in entries for x in (F.lit("\x1f".join(e)), F.lit(True))])
        complete = F.lit(True)
        for c in columns:
            complete = complete & F.col(c).isNotNull()
        return F.when(complete, F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *columns)), F.lit(False)))

    pairs = [(p, s) for p in TAXONOMY for s in TAXONOMY[p]]
    leaves = [(p, s, t) for p, s in pairs for t in TAXONOMY[p][s]]
    return df.select("*", known(PAIR, pairs).alias("pair_known"), known(LEAF, leaves).alias("leaf_known"))


def taxonomy_checks() -> list[Check]:
    """Checks for a frame from ``with_taxonomy_marks``."""
    return [
        ("relationship", "secondary_label", ~F.col("pair_known")),
        ("relationship", "tertiary_label", ~F.col("leaf_known")),
    ]


def quality_report(fct: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """All checks of a fact table: one scan for the row checks, one more per key check."""
    checks = not_null(["ticket_id", "user_id", "is_churned", "primary_label", "secondary_label", "sentiment"])
    checks += label_checks() + range_checks() + taxonomy_checks()
    report = run_checks(with_taxonomy_marks(fct), checks).unionByName(unique_key(fct, ["ticket_id"]))
    if insights is not None:
        keys = ["primary_label", "secondary_label", "plan_type", "ticket_month"]
        report = report.unionByName(unique_group_key(insights, keys))
    return report


def build_report(raw: DataFrame, stg: DataFrame, fct: DataFrame, insights: DataFrame) -> DataFrame:
    """The checks of every model of a build, with the model's name as ``model``."""
    ids = ["ticket_id", "user_id"]
    parts = {
        "raw_support_tickets": [run_checks(raw, not_null(ids)), unique_key(raw, ["ticket_id"])],
        "stg_support_tickets": [run_checks(stg, not_null(ids)), unique_key(stg, ["ticket_id"])],
        "fct_support_tickets": [quality_report(fct)],
        "support_insights": [unique_group_key(insights, ["primary_label", "secondary_label", "plan_type", "ticket_month"])],
    }
    named = [part.select(F.lit(model).alias("model"), "*") for model, found in parts.items() for part in found]
    return reduce(DataFrame.unionByName, named)


# -- label coverage ------------------------------------------------------------------


def taxonomy_volume(df: DataFrame, level: list[str]) -> DataFrame:
    """Every taxonomy entry of a level with its ticket count, 0 included.

    Tickets are reduced to one row per entry before they meet the taxonomy.
    """
    spark = df.sparkSession
    entries = taxonomy_pairs(spark) if level == PAIR else taxonomy_leaves(spark)
    counts = df.dropna(subset=level).groupBy(*level).agg(X.row_total().alias("tickets"))
    known = counts.join(F.broadcast(entries), level, "left_semi")
    return (
        entries.withColumn("tickets", F.lit(0).cast("bigint"))
        .unionByName(known)
        .groupBy(*level)
        .agg(F.sum("tickets").alias("tickets"))
    )


# -- join accounting -----------------------------------------------------------------


def label_join_accounting(tickets: DataFrame, labels: DataFrame) -> DataFrame:
    """What the join of tickets with labels keeps, loses and multiplies.

    Both sides are reduced to counts per id in one shuffle; nothing is joined, so
    the size of a runaway join is known before it is run.
    """
    side = tickets.select("ticket_id", F.lit(1).alias("t"), F.lit(0).alias("l")).unionByName(
        labels.select("ticket_id", F.lit(0).alias("t"), F.lit(1).alias("l"))
    )
    per_id = side.groupBy("ticket_id").agg(F.sum("t").alias("t"), F.sum("l").alias("l"))
    # A null id matches nothing: its labels are as good as absent.
    has_id = F.col("ticket_id").isNotNull()
    t = F.col("t")
    matched = F.when(has_id, F.col("l")).otherwise(F.lit(0))
    measures = {
        "tickets": F.sum("t"),
        "labels": F.sum("l"),
        "tickets_without_label": F.sum(F.when(matched == 0, t).otherwise(0)),
        "ids_labelled_more_than_once": F.count_if((t > 0) & (matched > 1)),
        "labels_of_unknown_ids": F.sum(F.when((t == 0) | ~has_id, F.col("l")).otherwise(0)),
        "most_labels_of_one_id": F.max("l"),
        "joined_rows": F.sum(t * F.greatest(matched, F.lit(1))),
    }
    totals = per_id.agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in measures.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in measures])
    return totals.select(F.explode(rows).alias("r")).select("r.*")
