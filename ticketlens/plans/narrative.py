"""The product-gap narrative: two ranked summaries handed to a writer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import expressions as X
from ticketlens.operators.summaries import MEASURES, PAIR, churned_by_primary, top_pairs
from ticketlens.session import stage
from ticketlens.taxonomy import PRIMARY_LABELS

#: A writer turns the prompt into the narrative.
NarrativeWriter = Callable[[str], str]

TOP_PAIRS = 20

#: The closing request of the prompt; a caller may pass another.
REQUEST = (
    "In a short paragraph, say which product gaps are largest, which issues go with churn,\n"
    "and what should be done about them first."
)
OTHER_LABELS = "Other labels"


def narrative_inputs(raw: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """The most frequent label pairs and the churned tickets per primary label.

    They count all raw tickets, also those without ids. Both come from one stored
    row per label pair, so tickets are scanned once.
    """
    labelled = raw.select(*PAIR, X.to_boolean(F.col("is_churned"), lenient).alias("is_churned"))
    pairs = labelled.groupBy(*PAIR).agg(
        X.row_total().alias("tickets"), F.count_if(MEASURES["churned_tickets"]()).alias("churned_tickets")
    )
    stored = stage(pairs, "narrative-inputs")
    return top_pairs(stored, TOP_PAIRS), churned_by_primary(stored)


def narrative_prompt(raw: DataFrame, lenient: bool = False, request: str = REQUEST) -> str:
    """The writer's prompt. Only bounded summaries, never tickets, reach the driver.

    Labels of the taxonomy have a line each; all others, of which an unchecked labeller may
    make up any number, share one with the sum of their counts.
    """
    top, churned = narrative_inputs(raw, lenient)
    known = F.when(F.col("primary_label").isin(PRIMARY_LABELS), F.col("primary_label")).otherwise(F.lit(OTHER_LABELS))
    by_primary = churned.groupBy(known.alias("primary_label")).agg(F.sum("churned_tickets").alias("churned_tickets"))
    by_primary = by_primary.orderBy(F.col("primary_label") == OTHER_LABELS, F.desc("churned_tickets"), "primary_label")
    lines = ["Most frequent ticket categories:"]
    lines += [f"* {r['primary_label']} / {r['secondary_label']}: {r['count']}" for r in top.collect()]
    lines += ["", "Tickets of churned customers by category:"]
    lines += [f"* {r['primary_label']}: {r['churned_tickets']}" for r in by_primary.collect()]
    return "\n".join([*lines, "", request])


def write_narrative(raw: DataFrame, writer: NarrativeWriter, lenient: bool = False) -> str:
    return writer(narrative_prompt(raw, lenient)).strip()
