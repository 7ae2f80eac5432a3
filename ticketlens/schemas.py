"""Column lists, types and accepted values of the ticket tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Table names a user of the warehouse queries by.
RAW_TABLE = "raw_support_tickets"
STAGING_VIEW = "stg_support_tickets"
FACT_TABLE = "fct_support_tickets"
INSIGHTS_TABLE = "support_insights"
NARRATIVE_TABLE = "product_gap_narrative"

#: The labels as answered, before they are joined to tickets.
LABELS_TABLE = "support_ticket_labels"

#: Ticket texts that several raw and fact rows name, each stored once.
TEXTS_TABLE = "support_ticket_texts"

#: Rows of ticket files with too many fields, raw rows that a lenient build can't cast, and
#: the result of the build's checks.
MALFORMED_TABLE = "malformed_ticket_rows"
QUARANTINE_TABLE = "quarantined_support_tickets"
QUALITY_TABLE = "support_quality_report"

#: Fact rows reduced to counts, for the dashboard.
CELLS_TABLE = "support_summary_cells"

# Columns of the ticket file, in file order.
CSV_COLUMNS = [
    "ticket_id",
    "user_id",
    "plan_type",
    "is_churned",
    "channel",
    "status",
    "sentiment",
    "primary_label",
    "secondary_label",
    "tertiary_label",
    "ticket_body",
    "created_at",
]

# The columns the labeller owns; the first three replace the file's own.
REPLACED_COLUMNS = ["primary_label", "secondary_label", "sentiment"]
LABEL_COLUMNS = REPLACED_COLUMNS + ["urgency", "one_line_summary"]

RAW_COLUMNS = [c for c in CSV_COLUMNS if c not in REPLACED_COLUMNS] + LABEL_COLUMNS

# Columns of the ticket explorer, in display order.
EXPLORER_COLUMNS = [
    "ticket_id",
    "user_id",
    "plan_type",
    "primary_label",
    "secondary_label",
    "tertiary_label",
    "sentiment",
    "urgency",
    "status",
    "is_churned",
    "one_line_summary",
    "created_at",
]

# Accepted words.
PLANS = ["Basic", "Standard", "Premium"]
CHANNELS = ["Email", "Chat", "Phone"]
STATUSES = ["Open", "In Progress", "Resolved", "Escalated"]
SENTIMENTS = ["Positive", "Neutral", "Frustrated", "Angry"]
NEGATIVE_SENTIMENTS = ["Frustrated", "Angry"]
ESCALATED = "Escalated"
HIGH_URGENCY = 3
URGENCY_RANGE = (1, 3)
SUMMARY_MAX_WORDS = 10

# What a ticket gets when its batch could not be labelled.
FALLBACK_URGENCY = "2"
FALLBACK_SUMMARY = "Label validation unavailable"

# Words a pandas CSV reader takes for a missing value (pandas user guide).
NULL_WORDS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

#: Every field of the file is read as text; staging owns the casts.
CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])

#: One answered label. Urgency stays text until staging casts it.
LABEL_FIELDS = T.StructType(
    [T.StructField("ticket_id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in LABEL_COLUMNS]
)

NARRATIVE_SCHEMA = T.StructType(
    [
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("narrative", T.StringType()),
    ]
)
