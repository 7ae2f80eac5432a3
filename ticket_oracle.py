"""What each registered query must return, as SQL for DuckDB.

Rules and fixed values are restated here by hand, so that an error in the package's own
can't pass.
"""

from __future__ import annotations

import json

# Accepted words, the label taxonomy and the words for a missing value.
SENTIMENTS = ["Positive", "Neutral", "Frustrated", "Angry"]
TAXONOMY = {
    "Billing": {
        "Duplicate Charge": ["Subscription Upgrade Flow", "Payment Method Update", "Promo Code Applied"],
        "Failed Payment": ["Credit Card Expired", "Insufficient Funds", "Bank Decline"],
        "Refund Request": ["Cancellation Refund", "Overcharge Refund", "Trial Extension"],
        "Invoice Question": ["Monthly Summary", "Annual Billing", "Tax Documentation"],
    },
    "Online Ordering": {
        "Page Not Loading": ["Checkout Flow", "Menu Display", "Mobile Browser"],
        "Menu Not Updating": ["Item Availability", "Price Sync", "Category Order"],
        "Order Not Received": ["Third-Party Integration", "Notification Failure", "POS Sync"],
        "Ordering Disabled": ["Account Suspension", "Setup Incomplete", "Integration Error"],
    },
    "Marketing / SEO": {
        "Google Listing Issue": ["GMB Sync", "Address Incorrect", "Hours Not Updating"],
        "Website Not Updating": ["Content Change", "Image Upload", "Domain Issue"],
        "SEO Performance": ["Ranking Drop", "Review Response", "Keyword Targeting"],
        "Campaign Not Running": ["Email Campaign", "SMS Campaign", "Ad Integration"],
    },
    "Product / Feature": {
        "Feature Not Working": ["Dashboard", "Notifications", "Reporting"],
        "Feature Request": ["Custom Branding", "Multi-Location", "API Access"],
        "Performance Issue": ["Slow Load Time", "Timeout Error", "Data Lag"],
        "Integration Issue": ["POS Integration", "Payment Gateway", "Third-Party App"],
    },
    "Account Access": {
        "Login Issue": ["SSO Failure", "Password Reset", "2FA Problem"],
        "Permissions Error": ["Staff Access", "Admin Role", "Read-Only Mode"],
        "Account Locked": ["Too Many Attempts", "Suspicious Activity", "Billing Hold"],
        "Account Setup": ["New User Invite", "Profile Incomplete", "Timezone Setting"],
    },
    "Onboarding": {
        "Setup Confusion": ["POS Connection", "Domain Setup", "Menu Import"],
        "Integration Help": ["Square Integration", "Toast Integration", "Clover Integration"],
        "Training Request": ["Dashboard Walkthrough", "Reporting Tutorial", "Campaign Setup"],
        "Go-Live Issue": ["Site Not Published", "Ordering Not Active", "Listing Not Live"],
    },
}
PRIMARY_LABELS = list(TAXONOMY)
NULL_WORDS = (
    " #N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null"
).strip().split("|") + [""]


def prompt_head() -> str:
    pairs = json.dumps({p: list(s) for p, s in TAXONOMY.items()}, indent=2)
    return (
        "Check and complete the labels of customer support tickets.\n\n"
        f"Allowed secondary labels under each primary label:\n{pairs}\n\n"
        "Allowed sentiments: Positive, Neutral, Frustrated, Angry\n\n"
        "Answer with one JSON array and nothing else. It holds one object per ticket, with\n"
        "the keys ticket_id, primary_label, secondary_label, sentiment, urgency (1 low, 2 medium,\n"
        "3 high) and one_line_summary (ten words at most).\n\nTickets:\n"
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


_PAIRS = [(p, s) for p in TAXONOMY for s in TAXONOMY[p]]
_LEAVES = [(p, s, t) for p, s in _PAIRS for t in TAXONOMY[p][s]]
_PAIR_TABLE = ", ".join(f"({_text(p)}, {_text(s)})" for p, s in _PAIRS)
_LEAF_TABLE = ", ".join(f"({_text(p)}, {_text(s)}, {_text(t)})" for p, s, t in _LEAVES)

# Cumulative sentiment weights of the six primary labels.
_MOOD = """
    CASE WHEN b < [10, 12, 20, 18, 8, 25][p + 1] THEN 'Positive'
         WHEN b < [35, 40, 50, 50, 30, 60][p + 1] THEN 'Neutral'
         WHEN b < [70, 74, 80, 78, 72, 82][p + 1] THEN 'Frustrated'
         ELSE 'Angry' END"""

_SOURCE = f"""
orders_in AS (
    SELECT o_orderkey AS k, o_custkey AS u, o_orderstatus AS os, o_orderpriority AS op,
           o_orderdate AS od, c_mktsegment AS seg, d.text AS body,
           (o_orderkey * 7 + o_custkey) % 6 AS p,
           (o_orderkey * o_orderkey % 1009 + o_custkey) % 4 AS s,
           (o_orderkey * 31 % 1013 + o_custkey) % 3 AS t,
           (o_orderkey * 17 + o_custkey * 5) % 100 AS b
    FROM orders
    JOIN customer ON c_custkey = o_custkey
    LEFT JOIN documents d ON d.doc_id = o_orderkey % (SELECT count(*) FROM documents)
),
tickets AS (
    SELECT CASE WHEN k % 97 <> 0 THEN 'TKT-' || lpad(k::VARCHAR, greatest(8, length(k::VARCHAR))::INT, '0') END AS ticket_id,
           CASE WHEN k % 89 <> 0 THEN 'USR-' || lpad(u::VARCHAR, greatest(5, length(u::VARCHAR))::INT, '0') END AS user_id,
           CASE WHEN seg IN ('MACHINERY', 'BUILDING') THEN 'Basic'
                WHEN seg IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'Standard' ELSE 'Premium' END AS plan_type,
           CASE WHEN u % 10 < 3 THEN 'True' ELSE 'False' END AS is_churned,
           ['Email', 'Chat', 'Phone'][k % 3 + 1] AS channel,
           CASE WHEN os = 'F' THEN 'Resolved' WHEN os = 'O' THEN 'Open'
                WHEN k % 4 = 0 THEN 'Escalated' ELSE 'In Progress' END AS status,
           CASE WHEN k % 101 <> 0 THEN {_MOOD} END AS sentiment,
           CASE WHEN k % 103 <> 0 THEN {_list(PRIMARY_LABELS)}[p + 1] END AS primary_label,
           {_list(s for _, s in _PAIRS)}[p * 4 + s + 1] AS secondary_label,
           {_list(t for _, _, t in _LEAVES)}[(p * 4 + s) * 3 + t + 1] AS tertiary_label,
           body AS ticket_body,
           od::DATE::VARCHAR AS created_at,
           CASE WHEN op = '1-URGENT' THEN '3' WHEN op IN ('2-HIGH', '3-MEDIUM') THEN '2' ELSE '1' END AS priority
    FROM orders_in
)"""

_RAW = (
    _SOURCE
    + """,
raw AS (
    SELECT ticket_id, user_id, plan_type, is_churned, channel, status, tertiary_label, ticket_body,
           created_at, primary_label, secondary_label, sentiment, priority AS urgency,
           secondary_label || ' reported by ' || channel AS one_line_summary
    FROM tickets
)"""
)

_STG_FCT = """,
stg AS (
    SELECT ticket_id, user_id, plan_type, channel, status, is_churned::BOOLEAN AS is_churned,
           primary_label, secondary_label, tertiary_label, sentiment, urgency::INTEGER AS urgency,
           one_line_summary, ticket_body, created_at::DATE AS created_at
    FROM raw
    WHERE ticket_id IS NOT NULL AND user_id IS NOT NULL
),
fct AS (
    SELECT stg.*,
           coalesce(sentiment IN ('Frustrated', 'Angry'), false) AS is_negative_sentiment,
           coalesce(urgency = 3, false) AS is_high_urgency,
           coalesce(is_churned AND sentiment IN ('Frustrated', 'Angry'), false) AS is_churn_risk_signal,
           date_trunc('month', created_at)::DATE AS ticket_month
    FROM stg
)"""

_FCT = _RAW + _STG_FCT

# Raw tickets of which some of 1995 were changed, added and removed after a build.
_CHANGED = (
    _RAW.replace("raw AS (", "raw_before AS (")
    + """,
dated AS (
    SELECT *, substr(ticket_id, 5)::BIGINT AS n, coalesce(created_at LIKE '1995-%' AND ticket_id IS NOT NULL, false) AS is_open
    FROM raw_before
),
raw AS (
    SELECT * EXCLUDE (n, is_open) FROM dated WHERE NOT is_open OR (n % 13 <> 0 AND n % 17 <> 0)
    UNION ALL
    SELECT * EXCLUDE (n, is_open) REPLACE ('Positive' AS sentiment, 'Premium' AS plan_type,
           (created_at::DATE + 40)::DATE::VARCHAR AS created_at)
    FROM dated WHERE is_open AND n % 13 = 0
    UNION ALL
    SELECT * EXCLUDE (n, is_open) REPLACE ('NEW-' || substr(ticket_id, 5) AS ticket_id) FROM dated WHERE is_open AND n % 19 = 0
)"""
    + _STG_FCT
)

_INSIGHTS = """,
insights AS (
    SELECT primary_label, secondary_label, plan_type, ticket_month,
           count(*) AS total_tickets,
           count(*) FILTER (WHERE is_churned) AS churned_customer_tickets,
           count(*) FILTER (WHERE is_negative_sentiment) AS negative_sentiment_tickets,
           count(*) FILTER (WHERE is_high_urgency) AS high_urgency_tickets,
           count(*) FILTER (WHERE is_churn_risk_signal) AS churn_risk_signals,
           count(*) FILTER (WHERE status = 'Escalated') AS escalated_tickets,
           round(100.0 * count(*) FILTER (WHERE is_churned) / count(*), 1)::DOUBLE AS pct_from_churned_customers,
           round(100.0 * count(*) FILTER (WHERE is_negative_sentiment) / count(*), 1)::DOUBLE AS pct_negative_sentiment
    FROM fct
    GROUP BY ALL
)"""

# The sample labeller's reply rules, restated.
_LABELS = (
    _SOURCE
    + """,
numbered AS (
    SELECT *, substr(ticket_id, 5)::BIGINT AS k, row_number() OVER (ORDER BY ticket_id) - 1 AS n
    FROM tickets WHERE ticket_id IS NOT NULL
),
batched AS (
    SELECT * EXCLUDE (n), n // 20 AS batch_id, (n % 20)::INTEGER AS batch_pos FROM numbered
),
replied AS (
    SELECT batch_id, ticket_id,
           CASE WHEN k % 61 = 0 THEN 'Other' ELSE primary_label END AS primary_label,
           secondary_label, sentiment,
           CASE WHEN k % 71 = 0 THEN '2' WHEN k % 67 = 0 THEN '9' ELSE priority END AS urgency,
           secondary_label || ' reported by ' || channel AS one_line_summary, k
    FROM batched
    WHERE k % 53 <> 0
),
parsed AS (SELECT * FROM replied WHERE batch_id % 11 NOT IN (5, 6, 7)),
labels AS (
    SELECT * EXCLUDE (k), false AS is_fallback FROM parsed
    UNION ALL
    SELECT * EXCLUDE (k) REPLACE ('1' AS urgency), false FROM parsed WHERE k % 59 = 0
    UNION ALL
    SELECT DISTINCT batch_id, 'TKT-UNKNOWN-' || batch_id, 'Billing', 'Failed Payment', 'Neutral', '1',
           'Unknown ticket', false
    FROM batched WHERE batch_id % 11 NOT IN (5, 6, 7) AND batch_id % 17 = 3
    UNION ALL
    SELECT batch_id, ticket_id, primary_label, secondary_label, sentiment, '2',
           'Label validation unavailable', true
    FROM batched WHERE batch_id % 11 IN (5, 6, 7)
)"""
)

_ENRICHED = (
    _LABELS
    + """,
raw AS (
    SELECT t.ticket_id, user_id, plan_type, is_churned, channel, status, tertiary_label, ticket_body,
           created_at, l.primary_label, l.secondary_label, l.sentiment, l.urgency, l.one_line_summary
    FROM tickets t LEFT JOIN labels l ON l.ticket_id = t.ticket_id
)"""
)

_CHECKED = _ENRICHED + _STG_FCT

_CELLS = """,
cells AS (
    SELECT plan_type, is_churned, primary_label, secondary_label, sentiment, ticket_month,
           count(*) AS tickets,
           count(*) FILTER (WHERE is_churned) AS churned_tickets,
           count(*) FILTER (WHERE is_churn_risk_signal) AS churn_signals,
           count(*) FILTER (WHERE is_negative_sentiment) AS negative_tickets,
           count(*) FILTER (WHERE is_high_urgency) AS high_urgency_tickets,
           count(*) FILTER (WHERE status = 'Escalated') AS escalated_tickets
    FROM fct GROUP BY ALL
)"""


def _kpis(where: str = "true") -> str:
    return f""",
kpis AS (
    SELECT count(*) AS total_tickets,
           count(*) FILTER (WHERE is_churn_risk_signal) AS churn_signals,
           count(*) FILTER (WHERE is_negative_sentiment) AS negative_tickets,
           count(*) FILTER (WHERE is_high_urgency) AS high_urgency_tickets,
           count(*) FILTER (WHERE status = 'Escalated') AS escalated_tickets,
           CASE WHEN count(*) = 0 THEN 0.0
                ELSE round_even(100.0 * count(*) FILTER (WHERE is_negative_sentiment) / count(*), 1)
           END::DOUBLE AS negative_pct
    FROM fct WHERE {where}
)"""


_CARDS = """
SELECT 1 AS card_no, 'Total Tickets' AS card, format('{:,}', total_tickets) AS value, NULL::VARCHAR AS delta FROM kpis
UNION ALL SELECT 2, 'Churn Risk Signals', format('{:,}', churn_signals), NULL FROM kpis
UNION ALL SELECT 3, 'Negative Sentiment', format('{:,}', negative_tickets),
       CASE WHEN total_tickets = 0 THEN '0%' ELSE negative_pct::VARCHAR || '%' END FROM kpis
UNION ALL SELECT 4, 'High Urgency', format('{:,}', high_urgency_tickets), NULL FROM kpis
UNION ALL SELECT 5, 'Escalated', format('{:,}', escalated_tickets), NULL FROM kpis
"""


def _count_by(keys: str, name: str = "tickets", where: str = "true") -> str:
    present = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"SELECT {keys}, count(*) AS {name} FROM fct WHERE ({where}) AND {present} GROUP BY ALL"


def _failing(*checks: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {_text(check)} AS check_name, {_text(column)} AS column_name, "
        f"count(*) FILTER (WHERE {bad}) AS failing_rows FROM fct"
        for check, column, bad in checks
    )


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _onepass() -> str:
    measures = ["tickets", "churned_tickets", "churn_signals", "negative_tickets", "high_urgency_tickets", "escalated_tickets"]
    columns = ["primary_label", "secondary_label", "sentiment", "ticket_month"]
    types = {"ticket_month": "DATE"}
    sets = {
        "total": [],
        "by_primary": ["primary_label"],
        "by_pair": ["primary_label", "secondary_label"],
        "by_sentiment": ["sentiment"],
        "by_month": ["primary_label", "ticket_month"],
    }
    parts = []
    for name, keys in sets.items():
        shown = [c if c in keys else f"NULL::{types.get(c, 'VARCHAR')} AS {c}" for c in columns]
        sums = [f"sum({m})::BIGINT AS {m}" for m in measures]
        where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"
        group = f" GROUP BY {', '.join(keys)}" if keys else ""
        parts.append(
            f"SELECT {_text(name)} AS summary, {', '.join(shown + sums)} FROM cells WHERE {where}{group}"
        )
    return "\nUNION ALL ".join(parts)


_CONTEXT = """,
f AS (SELECT * FROM fct WHERE plan_type = 'Standard' AND is_churned),
top AS (
    SELECT primary_label, secondary_label, count(*) AS n FROM f
    WHERE primary_label IS NOT NULL AND secondary_label IS NOT NULL
    GROUP BY ALL ORDER BY n DESC, primary_label, secondary_label LIMIT 10
)"""

_CONTEXT_ROWS = """
SELECT 1 AS section_no, 'filter' AS section, NULL::INTEGER AS rank, 'Plan' AS key1, NULL::VARCHAR AS key2, 'Standard' AS value
UNION ALL SELECT 1, 'filter', NULL, 'Primary', NULL, 'All'
UNION ALL SELECT 1, 'filter', NULL, 'Churn', NULL, 'Churned Only'
UNION ALL SELECT 2, 'total', NULL, 'Total tickets', NULL, count(*)::VARCHAR FROM f
UNION ALL SELECT 2, 'total', NULL, 'Churn risk signals', NULL, (count(*) FILTER (WHERE is_churn_risk_signal))::VARCHAR FROM f
UNION ALL SELECT 2, 'total', NULL, 'Negative sentiment tickets', NULL, (count(*) FILTER (WHERE is_negative_sentiment))::VARCHAR FROM f
UNION ALL SELECT 2, 'total', NULL, 'High urgency tickets', NULL, (count(*) FILTER (WHERE is_high_urgency))::VARCHAR FROM f
UNION ALL SELECT 3, 'top_categories', (row_number() OVER (ORDER BY n DESC, primary_label, secondary_label))::INTEGER,
       primary_label, secondary_label, n::VARCHAR FROM top
UNION ALL SELECT 4, 'churned_tickets', NULL, primary_label, NULL, count(*)::VARCHAR FROM f
       WHERE is_churned AND primary_label IS NOT NULL GROUP BY primary_label
UNION ALL SELECT 5, 'sentiment', NULL, sentiment, NULL, count(*)::VARCHAR FROM f
       WHERE sentiment IS NOT NULL GROUP BY sentiment
UNION ALL SELECT 6, 'narrative', NULL, NULL, NULL, narrative FROM told
"""

_NARRATIVE = """,
top AS (
    SELECT primary_label, secondary_label, count(*) AS n FROM raw
    WHERE primary_label IS NOT NULL AND secondary_label IS NOT NULL
    GROUP BY ALL ORDER BY n DESC, primary_label, secondary_label LIMIT 20
),
churned AS (
    SELECT CASE WHEN primary_label IN ('Billing', 'Online Ordering', 'Marketing / SEO', 'Product / Feature',
                                       'Account Access', 'Onboarding') THEN primary_label ELSE 'Other labels' END AS label,
           count(*) AS n
    FROM raw WHERE is_churned::BOOLEAN AND primary_label IS NOT NULL GROUP BY ALL
)
SELECT (SELECT string_agg(primary_label || ' / ' || secondary_label || ': ' || n, '; '
                          ORDER BY n DESC, primary_label, secondary_label) FROM top)
       || '; ' ||
       (SELECT string_agg(label || ': ' || n, '; ' ORDER BY label = 'Other labels', n DESC, label) FROM churned) AS narrative
"""



def _told() -> str:
    """The narrative of the labelled tickets as a table ``told``."""
    ctes, _, select = _NARRATIVE.rpartition(")\nSELECT (SELECT")
    return f"{ctes.replace('top AS', 'told_top AS').replace('churned AS', 'told_churned AS')}),\ntold AS (SELECT (SELECT{select.replace('FROM top', 'FROM told_top').replace('FROM churned', 'FROM told_churned')})"


_FAULTY = """,
faulty AS (
    SELECT * EXCLUDE (ticket_body, n) REPLACE (
        CASE WHEN n % 37 = 0 THEN 'high' WHEN n % 41 <> 0 THEN urgency END AS urgency,
        CASE WHEN n % 43 = 0 THEN 'maybe' WHEN n % 47 <> 0 THEN is_churned END AS is_churned,
        CASE WHEN n % 53 = 0 THEN 'soon' ELSE created_at END AS created_at,
        CASE WHEN n % 59 <> 0 THEN status END AS status)
    FROM (SELECT *, coalesce(substr(ticket_id, 5)::BIGINT, 1) AS n FROM raw)
    WHERE ticket_id IS NOT NULL AND user_id IS NOT NULL
),
good AS (
    SELECT ticket_id, user_id, plan_type, channel, status, is_churned::BOOLEAN AS is_churned, primary_label,
           secondary_label, tertiary_label, sentiment, urgency::INTEGER AS urgency, one_line_summary,
           created_at::DATE AS created_at
    FROM faulty
    WHERE coalesce(urgency, '') <> 'high' AND coalesce(is_churned, '') <> 'maybe' AND created_at <> 'soon'
),
fct AS (
    SELECT *, coalesce(sentiment IN ('Frustrated', 'Angry'), false) AS is_negative_sentiment,
           coalesce(urgency = 3, false) AS is_high_urgency,
           coalesce(is_churned AND sentiment IN ('Frustrated', 'Angry'), false) AS is_churn_risk_signal,
           date_trunc('month', created_at)::DATE AS ticket_month
    FROM good
)"""

_LINE = "'- ticket_id: ' || ticket_id || ' | body: ' || ticket_body"

_WORDS = r"len(regexp_split_to_array(regexp_replace(one_line_summary, '^\s+|\s+$', '', 'g'), '\s+'))"


def _unnulled(columns: list[str]) -> str:
    return ", ".join(f"CASE WHEN {c} NOT IN {_in(NULL_WORDS)} THEN {c} END AS {c}" for c in columns)


def _taxonomy_volume(table: str, columns: str) -> str:
    join = " AND ".join(f"f.{c.strip()} = x.{c.strip()}" for c in columns.split(","))
    shown = ", ".join(f"x.{c.strip()}" for c in columns.split(","))
    return (
        f"SELECT {shown}, count(f.ticket_id) AS tickets FROM (VALUES {table}) x({columns}) "
        f"LEFT JOIN fct f ON {join} GROUP BY ALL"
    )


def _quality(pair_unknown: str, leaf_unknown: str) -> str:
    def counted(model: str, table: str, checks: list[tuple[str, str, str]]) -> list[str]:
        return [
            f"SELECT {_text(model)} AS model, {_text(check)} AS check_name, {_text(column)} AS column_name, "
            f"count(*) FILTER (WHERE {bad}) AS failing_rows FROM {table}"
            for check, column, bad in checks
        ]

    def repeated(model: str, table: str, keys: str, where: str) -> str:
        return (
            f"SELECT {_text(model)}, 'unique', {_text(keys.replace(' ', ''))}, count(*) FROM "
            f"(SELECT 1 FROM {table} WHERE {where} GROUP BY {keys} HAVING count(*) > 1)"
        )

    ids = [("not_null", c, f"{c} IS NULL") for c in ("ticket_id", "user_id")]
    fct = [
        ("not_null", c, f"{c} IS NULL")
        for c in ("ticket_id", "user_id", "is_churned", "primary_label", "secondary_label", "sentiment")
    ]
    fct += [
        ("accepted_values", "primary_label", f"primary_label NOT IN {_in(PRIMARY_LABELS)}"),
        ("accepted_values", "sentiment", f"sentiment NOT IN {_in(SENTIMENTS)}"),
        ("accepted_range", "urgency", "urgency NOT BETWEEN 1 AND 3"),
        ("max_words", "one_line_summary", f"one_line_summary IS NOT NULL AND {_WORDS} > 10"),
        ("relationship", "secondary_label", pair_unknown),
        ("relationship", "tertiary_label", leaf_unknown),
    ]
    parts = counted("raw_support_tickets", "raw", ids) + counted("stg_support_tickets", "stg", ids)
    parts += counted("fct_support_tickets", "fct", fct)
    for model, table in (("raw_support_tickets", "raw"), ("stg_support_tickets", "stg"), ("fct_support_tickets", "fct")):
        parts.append(repeated(model, table, "ticket_id", "ticket_id IS NOT NULL"))
    parts.append(repeated("support_insights", "insights", "primary_label, secondary_label, plan_type, ticket_month", "true"))
    return " UNION ALL ".join(parts)


def build() -> dict[str, str]:
    csv = [
        "ticket_id", "user_id", "plan_type", "is_churned", "channel", "status", "sentiment",
        "primary_label", "secondary_label", "tertiary_label", "ticket_body", "created_at",
    ]
    explorer = (
        "ticket_id, user_id, plan_type, primary_label, secondary_label, tertiary_label, sentiment, "
        "urgency, status, is_churned, one_line_summary, created_at"
    )
    newest = "ORDER BY created_at DESC NULLS LAST, ticket_id, urgency NULLS FIRST LIMIT 100"
    pair = "primary_label, secondary_label"
    leaf = "primary_label, secondary_label, tertiary_label"
    pair_unknown = (
        f"primary_label IS NOT NULL AND secondary_label IS NOT NULL AND ({pair}) NOT IN (VALUES {_PAIR_TABLE})"
    )
    leaf_unknown = (
        "primary_label IS NOT NULL AND secondary_label IS NOT NULL AND tertiary_label IS NOT NULL "
        f"AND ({leaf}) NOT IN (VALUES {_LEAF_TABLE})"
    )
    return {
        "raw_support_tickets": _q(_RAW, "SELECT * FROM raw"),
        "stg_support_tickets": _q(_FCT, "SELECT * FROM stg"),
        "fct_support_tickets": _q(_FCT, "SELECT * FROM fct"),
        "support_insights": _q(_FCT + _INSIGHTS, "SELECT * FROM insights"),
        "filtered_tickets_standard_churned": _q(_FCT, "SELECT * FROM fct WHERE plan_type = 'Standard' AND is_churned"),
        "filtered_tickets_billing_active": _q(
            _FCT, "SELECT * FROM fct WHERE primary_label = 'Billing' AND NOT is_churned"
        ),
        "filter_choices": _q(
            _FCT,
            """
SELECT 'plan_type' AS filter, 0 AS is_value, 'All' AS choice
UNION ALL SELECT 'primary_label', 0, 'All'
UNION ALL SELECT DISTINCT 'plan_type', 1, plan_type FROM fct WHERE plan_type IS NOT NULL
UNION ALL SELECT DISTINCT 'primary_label', 1, primary_label FROM fct WHERE primary_label IS NOT NULL""",
        ),
        "kpis": _q(_FCT + _kpis(), "SELECT * FROM kpis"),
        "kpi_cards": _q(_FCT + _kpis(), _CARDS),
        "kpi_cards_empty_filter": _q(_FCT + _kpis("plan_type = 'Enterprise'"), _CARDS),
        "volume_by_primary": _q(_FCT, _count_by("primary_label")),
        "sentiment_distribution": _q(
            _FCT + ", c AS (" + _count_by("sentiment", "count") + ")",
            'SELECT sentiment, "count", round(100.0 * "count" / sum("count") OVER (), 1)::DOUBLE AS share_pct FROM c',
        ),
        "churn_risk_by_primary": _q(_FCT, _count_by("primary_label", "churn_signals", "is_churn_risk_signal")),
        "churned_by_primary": _q(_FCT, _count_by("primary_label", "churned_tickets", "is_churned")),
        "monthly_trend": _q(_FCT, _count_by("ticket_month, primary_label")),
        "secondary_breakdown": _q(_FCT, _count_by(pair)),
        "top20_label_pairs": _q(
            _FCT, _count_by(pair, '"count"') + f' ORDER BY "count" DESC, {pair} LIMIT 20'
        ),
        "top10_label_pairs": _q(
            _FCT, _count_by(pair, '"count"', "plan_type = 'Premium'") + f' ORDER BY "count" DESC, {pair} LIMIT 10'
        ),
        "top20_free_pairs": _q(
            _RAW,
            """
SELECT primary_label, CASE WHEN n % 3 = 0 THEN secondary_label || ' / case ' || n % 5003 ELSE secondary_label END AS secondary_label,
       count(*) AS "count"
FROM (SELECT *, substr(ticket_id, 5)::BIGINT AS n FROM raw)
WHERE primary_label IS NOT NULL AND secondary_label IS NOT NULL
GROUP BY ALL ORDER BY "count" DESC, 1, 2 LIMIT 20""",
        ),
        "ticket_explorer": _q(
            _FCT, f"SELECT {explorer} FROM fct {newest}"
        ),
        "summary_cells": _q(_FCT + _CELLS, "SELECT * FROM cells"),
        "dashboard_onepass": _q(_FCT + _CELLS, _onepass()),
        "dashboard_onepass_churn_risk": _q(
            _FCT, _count_by("primary_label", "churn_signals", "is_churn_risk_signal AND plan_type = 'Basic'")
        ),
        "volume_by_primary_from_cells": _q(_FCT, _count_by("primary_label", "tickets", "NOT is_churned")),
        "context_table": _q(_CHECKED + _told() + _CONTEXT, _CONTEXT_ROWS),
        "latest_narrative": "WITH " + (_ENRICHED + _NARRATIVE).strip(),
        "daily_trend": _q(
            _SOURCE,
            """
SELECT created_at::TIMESTAMP::DATE AS day, primary_label, count(*) AS tickets
FROM tickets WHERE primary_label IS NOT NULL GROUP BY ALL""",
        ),
        "taxonomy_pairs": _q(_FCT, _taxonomy_volume(_PAIR_TABLE, pair)),
        "taxonomy_leaves": _q(_FCT, _taxonomy_volume(_LEAF_TABLE, leaf)),
        "label_batches": _q(_LABELS, "SELECT ticket_id, batch_id, batch_pos FROM batched"),
        "label_prompt_lines": _q(_LABELS, f"SELECT batch_id, batch_pos, ticket_id, {_LINE} AS line FROM batched"),
        "label_prompts": _q(
            _LABELS,
            f"""
SELECT batch_id, count(*)::INTEGER AS tickets,
       {_text(prompt_head())} || string_agg({_LINE}, chr(10) ORDER BY batch_pos) AS prompt
FROM batched GROUP BY batch_id""",
        ),
        "label_batch_report": _q(
            _LABELS,
            """
SELECT count(*) AS tickets, ceil(count(*) / 20.0)::BIGINT AS batches_needed,
       count(DISTINCT batch_id) AS batches,
       count(DISTINCT batch_id) FILTER (WHERE batch_id % 11 IN (5, 6, 7)) AS failed_batches,
       (SELECT count(*) FROM labels) AS labels
FROM batched""",
        ),
        "labels_parsed": _q(_LABELS, "SELECT * REPLACE (urgency::INTEGER AS urgency) FROM labels"),
        "labels_in_place": _q(
            _LABELS,
            """
SELECT * EXCLUDE (k, batch_id) REPLACE (urgency::INTEGER AS urgency), false AS is_fallback FROM replied
UNION ALL SELECT * EXCLUDE (k, batch_id) REPLACE (1 AS urgency), false FROM replied WHERE k % 59 = 0""",
        ),
        "labels_remaining": _q(
            _LABELS,
            """
SELECT ticket_id FROM tickets
WHERE ticket_id IS NOT NULL AND ticket_id NOT IN (SELECT ticket_id FROM labels WHERE NOT is_fallback)""",
        ),
        "enriched_tickets": _q(_ENRICHED, "SELECT * FROM raw"),
        "label_join_accounting": _q(
            _LABELS,
            """
SELECT 'tickets' AS measure, count(*) AS value FROM tickets
UNION ALL SELECT 'labels', count(*) FROM labels
UNION ALL SELECT 'tickets_without_label', count(*) FROM tickets t
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.ticket_id = t.ticket_id)
UNION ALL SELECT 'ids_labelled_more_than_once', count(*) FROM (
    SELECT ticket_id FROM labels WHERE ticket_id IN (SELECT ticket_id FROM tickets)
    GROUP BY ticket_id HAVING count(*) > 1)
UNION ALL SELECT 'labels_of_unknown_ids', count(*) FROM labels l
    WHERE NOT EXISTS (SELECT 1 FROM tickets t WHERE t.ticket_id = l.ticket_id)
UNION ALL SELECT 'most_labels_of_one_id', max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY ticket_id)
UNION ALL SELECT 'joined_rows', count(*) FROM tickets t LEFT JOIN labels l ON l.ticket_id = t.ticket_id""",
        ),
        "dq_unique_ids": _q(
            _CHECKED + _INSIGHTS,
            """
SELECT 'unique' AS check_name, 'ticket_id' AS column_name, count(*) AS failing_rows
FROM (SELECT ticket_id FROM fct GROUP BY ticket_id HAVING count(*) > 1)
UNION ALL
SELECT 'unique', 'primary_label,secondary_label,plan_type,ticket_month', count(*)
FROM (SELECT 1 FROM insights GROUP BY primary_label, secondary_label, plan_type, ticket_month HAVING count(*) > 1)""",
        ),
        "dq_not_null": _q(
            _CHECKED,
            _failing(
                *[
                    ("not_null", c, f"{c} IS NULL")
                    for c in [
                        "ticket_id", "user_id", "is_churned", "primary_label", "secondary_label", "sentiment", "urgency",
                    ]
                ]
            ),
        ),
        "dq_accepted_values": _q(
            _CHECKED,
            _failing(
                ("accepted_values", "primary_label", f"primary_label NOT IN {_in(PRIMARY_LABELS)}"),
                ("accepted_values", "sentiment", f"sentiment NOT IN {_in(SENTIMENTS)}"),
            ),
        ),
        "dq_taxonomy_violations": _q(
            _CHECKED,
            f"""
SELECT 'relationship' AS check_name, 'secondary_label' AS column_name, count(*) AS failing_rows
FROM fct WHERE {pair_unknown}
UNION ALL SELECT 'relationship', 'tertiary_label', count(*) FROM fct WHERE {leaf_unknown}""",
        ),
        "dq_pair_violation_rows": _q(
            _CHECKED, f"SELECT ticket_id, primary_label, secondary_label, urgency FROM fct WHERE {pair_unknown}"
        ),
        "dq_ranges": _q(
            _CHECKED,
            _failing(
                ("accepted_range", "urgency", "urgency NOT BETWEEN 1 AND 3"),
                ("max_words", "one_line_summary", f"{_WORDS} > 10"),
            ),
        ),
        "csv_roundtrip": _q(_SOURCE, f"SELECT {_unnulled(csv)} FROM tickets"),
        "csv_reordered_columns": _q(_SOURCE, f"SELECT {_unnulled(csv)} FROM tickets"),
        "csv_extra_columns": _q(_SOURCE, f"SELECT {_unnulled(csv)} FROM tickets"),
        "csv_short_rows": _q(_SOURCE, f"SELECT {_unnulled(csv[:-1])}, NULL::VARCHAR AS created_at FROM tickets"),
        "stg_lenient": _q(_RAW + _FAULTY, "SELECT * FROM good"),
        "stg_quarantine": _q(
            _RAW + _FAULTY,
            "SELECT * FROM faulty WHERE urgency = 'high' OR is_churned = 'maybe' OR created_at = 'soon'",
        ),
        "fct_null_inputs": _q(
            _RAW + _FAULTY,
            "SELECT ticket_id, status, is_negative_sentiment, is_high_urgency, is_churn_risk_signal, ticket_month FROM fct",
        ),
        "kpis_null_inputs": _q(_RAW + _FAULTY + _kpis(), "SELECT * FROM kpis"),
        "stored_raw": _q(_ENRICHED, "SELECT * FROM raw"),
        "stored_staging": _q(_CHECKED, "SELECT * FROM stg"),
        "stored_fact": _q(_CHECKED, "SELECT * FROM fct"),
        "stored_insights": _q(_CHECKED + _INSIGHTS, "SELECT * FROM insights"),
        "stored_cells": _q(_CHECKED + _CELLS, "SELECT * FROM cells"),
        "stored_row_counts": _q(
            _CHECKED + _INSIGHTS,
            """
SELECT 'raw_support_tickets' AS model, count(*) AS rows FROM raw
UNION ALL SELECT 'stg_support_tickets', count(*) FROM stg
UNION ALL SELECT 'fct_support_tickets', count(*) FROM fct
UNION ALL SELECT 'support_insights', count(*) FROM insights""",
        ),
        "quality_report": _q(_CHECKED + _INSIGHTS, _quality(pair_unknown, leaf_unknown)),
        "dashboard_parts": _q(
            _CHECKED + _kpis("plan_type = 'Standard' AND is_churned") + f", cards AS ({_CARDS})"
            ", shown AS (SELECT * FROM fct WHERE plan_type = 'Standard' AND is_churned)",
            """
SELECT 'kpi_cards' AS part, card AS item, value FROM cards
UNION ALL SELECT 'volume_by_primary', primary_label, count(*)::VARCHAR FROM shown
       WHERE primary_label IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'churn_risk_by_primary', primary_label, count(*)::VARCHAR FROM shown
       WHERE primary_label IS NOT NULL AND is_churn_risk_signal GROUP BY ALL
UNION ALL (SELECT 'ticket_explorer', ticket_id, created_at::VARCHAR FROM shown
       ORDER BY created_at DESC NULLS LAST, ticket_id LIMIT 100)""",
        ),
        "top20_labelled_pairs": _q(
            _ENRICHED,
            """
SELECT primary_label, secondary_label, count(*) AS count FROM raw
WHERE primary_label IS NOT NULL AND secondary_label IS NOT NULL
GROUP BY ALL ORDER BY count DESC, primary_label, secondary_label LIMIT 20""",
        ),
        "stored_explorer": _q(_CHECKED, f"SELECT {explorer} FROM fct {newest}"),
        "stored_explorer_filtered": _q(
            _CHECKED,
            f"SELECT {explorer} FROM fct WHERE plan_type = 'Basic' AND primary_label = 'Billing' AND is_churned {newest}",
        ),
        "cached_snapshot": _q(_CHECKED + _kpis(), _CARDS),
        "insights_after_change": _q(_CHANGED + _INSIGHTS, "SELECT * FROM insights"),
        "fact_after_change": _q(_CHANGED, "SELECT * EXCLUDE (ticket_body) FROM fct"),
        "cells_after_change": _q(_CHANGED + _CELLS, "SELECT * FROM cells"),
        "labels_resumed": _q(
            _LABELS,
            """
SELECT * EXCLUDE (k, batch_id), false AS is_fallback FROM replied
UNION ALL
SELECT * EXCLUDE (k, batch_id) REPLACE ('1' AS urgency), false FROM replied WHERE k % 59 = 0""",
        ),
        "weighted_assignment": _q(
            _RAW,
            """
SELECT ticket_id, urgency,
       CASE WHEN b < 60 THEN 'first line' WHEN b < 90 THEN 'second line' ELSE 'specialist' END AS desk,
       CASE WHEN b < CASE urgency WHEN '1' THEN 60 WHEN '2' THEN 40 ELSE 10 END THEN 'first line'
            WHEN b < CASE urgency WHEN '1' THEN 90 WHEN '2' THEN 80 ELSE 50 END THEN 'second line'
            ELSE 'specialist' END AS urgent_desk
FROM (SELECT *, (substr(ticket_id, 5)::BIGINT * 31 + 7) % 100 AS b FROM raw WHERE ticket_id IS NOT NULL)""",
        ),
        "ticket_fanout": _q(
            _FCT,
            """
SELECT ticket_id, n::INTEGER AS reminder_no, 'REM-' || upper(substr(md5(ticket_id || '|' || n), 1, 16)) AS reminder_id,
       strftime(created_at + (7 * n)::INTEGER, '%Y-%m-%d') AS due_on
FROM (SELECT *, unnest(range(1, urgency + 1)) AS n FROM stg WHERE status <> 'Resolved')""",
        ),
        "shuffled_tickets": _q(
            _SOURCE,
            """
SELECT ticket_id, user_id, md5('42|' || ticket_id) AS shuffle_key
FROM tickets WHERE ticket_id IS NOT NULL AND user_id IS NOT NULL""",
        ),
    }
