"""Tickets derived from the orders, customer and documents tables.

Integer arithmetic only, so that any SQL engine can restate the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions import expressions as X
from ticketlens.operators.assign import pick_from, weighted_pick_by
from ticketlens.schemas import CHANNELS, CSV_COLUMNS, RAW_COLUMNS
from ticketlens.taxonomy import PRIMARY_LABELS, TAXONOMY

# Weights in percent, of our own choice: every mood occurs under every label.
SENTIMENT_WEIGHTS = {
    "Billing": {"Positive": 10, "Neutral": 25, "Frustrated": 35, "Angry": 30},
    "Online Ordering": {"Positive": 12, "Neutral": 28, "Frustrated": 34, "Angry": 26},
    "Marketing / SEO": {"Positive": 20, "Neutral": 30, "Frustrated": 30, "Angry": 20},
    "Product / Feature": {"Positive": 18, "Neutral": 32, "Frustrated": 28, "Angry": 22},
    "Account Access": {"Positive": 8, "Neutral": 22, "Frustrated": 42, "Angry": 28},
    "Onboarding": {"Positive": 25, "Neutral": 35, "Frustrated": 22, "Angry": 18},
}

_SECONDARY = [s for p in TAXONOMY for s in TAXONOMY[p]]
_TERTIARY = [t for p in TAXONOMY for s in TAXONOMY[p] for t in TAXONOMY[p][s]]
_MOODS = {str(p): SENTIMENT_WEIGHTS[name] for p, name in enumerate(PRIMARY_LABELS)}


# Columns read from the order tables; stated, so that no job is run to look them up.
_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def source_tickets(spark: SparkSession, sf_dir: str, body: bool = True) -> DataFrame:
    """Tickets in the file's columns, plus ``priority`` (1-3, as text).

    Every order is a ticket and every document is used as a body, in full. A query
    that does not read bodies asks for ``body=False`` and so saves the join with
    the documents, which neither adds nor drops tickets.
    """
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    if body:
        documents = read_table(spark, sf_dir, "documents")
        count = documents.agg(F.count(F.lit(1))).scalar()
        rows = rows.withColumn("_doc", F.col("o_orderkey") % count)
        rows = rows.join(documents, F.col("_doc") == F.col("doc_id"), "left")
    keyed = rows.selectExpr(
        "o_orderkey AS k",
        "o_custkey AS u",
        "c_mktsegment AS segment",
        "o_orderstatus AS order_status",
        "o_orderpriority AS order_priority",
        "o_orderdate AS order_date",
        "(o_orderkey * 7 + o_custkey) % 6 AS p",
        # (key mod 1009) squared: key squared would overflow for large keys
        "((o_orderkey % 1009) * (o_orderkey % 1009) % 1009 + o_custkey) % 4 AS s",
        "(o_orderkey * 31 % 1013 + o_custkey) % 3 AS t",
        "(o_orderkey * 17 + o_custkey * 5) % 100 AS b",
        "text" if body else "CAST(NULL AS STRING) AS text",
    )
    k, u = F.col("k"), F.col("u")
    columns = {
        "ticket_id": F.when(k % 97 != 0, X.numbered_id("TKT-", k, 8)),
        "user_id": F.when(k % 89 != 0, X.numbered_id("USR-", u, 5)),
        "plan_type": F.expr(
            "CASE WHEN segment IN ('MACHINERY', 'BUILDING') THEN 'Basic' "
            "WHEN segment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'Standard' ELSE 'Premium' END"
        ),
        "is_churned": F.expr("if(u % 10 < 3, 'True', 'False')"),
        "channel": pick_from("k % 3", CHANNELS),
        "status": F.expr(
            "CASE WHEN order_status = 'F' THEN 'Resolved' WHEN order_status = 'O' THEN 'Open' "
            "WHEN k % 4 = 0 THEN 'Escalated' ELSE 'In Progress' END"
        ),
        "sentiment": F.when(k % 101 != 0, weighted_pick_by("p", "b", _MOODS)),
        "primary_label": F.when(k % 103 != 0, pick_from("p", PRIMARY_LABELS)),
        "secondary_label": pick_from("p * 4 + s", _SECONDARY),
        "tertiary_label": pick_from("(p * 4 + s) * 3 + t", _TERTIARY),
        "ticket_body": F.col("text"),
        "created_at": F.expr("CAST(CAST(order_date AS DATE) AS STRING)"),
        "priority": F.expr(
            "CASE WHEN order_priority = '1-URGENT' THEN '3' "
            "WHEN order_priority IN ('2-HIGH', '3-MEDIUM') THEN '2' ELSE '1' END"
        ),
    }
    return keyed.select(*[columns[c].alias(c) for c in [*CSV_COLUMNS, "priority"]])


def raw_tickets(spark: SparkSession, sf_dir: str, body: bool = True) -> DataFrame:
    """The raw table as a labeller that keeps every label would leave it."""
    labelled = {
        "urgency": F.col("priority"),
        "one_line_summary": F.concat(F.col("secondary_label"), F.lit(" reported by "), F.col("channel")),
    }
    tickets = source_tickets(spark, sf_dir, body)
    return tickets.select(*[labelled[c].alias(c) if c in labelled else c for c in RAW_COLUMNS])
