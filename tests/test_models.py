import datetime as dt

import pytest
from conftest import dicts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticketlens.plans.models import STAGING_COLUMNS, fact, insights, quarantine, staging
from ticketlens.schemas import SENTIMENTS


def test_staging_types_and_null_ids(raw_rows):
    raw = raw_rows({}, {"ticket_id": None}, {"user_id": None})
    stg = staging(raw)
    assert stg.columns == STAGING_COLUMNS
    types = dict(stg.dtypes)
    assert (types["is_churned"], types["urgency"], types["created_at"]) == ("boolean", "int", "date")
    assert stg.count() == 1


def test_null_filter_reaches_the_files(spark, raw_rows, tmp_path):
    raw_rows({}).write.parquet(str(tmp_path / "raw"))
    plan = staging(spark.read.parquet(str(tmp_path / "raw")))._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(ticket_id)" in plan and "IsNotNull(user_id)" in plan
    assert "Exchange" not in plan


@pytest.mark.parametrize("text,value", [("2", 2), ("3.0", 3), ("2.5", 2), ("3.5", 4), (None, None)])
def test_urgency_rounds_half_to_even(raw_rows, text, value):
    assert staging(raw_rows({"urgency": text})).first()["urgency"] == value


@pytest.mark.parametrize("bad", [{"is_churned": "maybe"}, {"urgency": "high"}, {"created_at": "2024-13-01"}])
def test_bad_values_fail_or_are_quarantined(raw_rows, bad):
    raw = raw_rows({}, {**bad, "ticket_id": "TKT-BAD"})
    with pytest.raises(Exception):
        staging(raw).collect()
    assert [r["ticket_id"] for r in staging(raw, lenient=True).collect()] == ["TKT-00000001"]
    assert [r["ticket_id"] for r in quarantine(raw).collect()] == ["TKT-BAD"]


def test_flags_are_never_null(fact_rows):
    rows = dicts(
        fact_rows(
            {"sentiment": None, "is_churned": "True"},
            {"urgency": None},
            {"is_churned": None, "sentiment": "Angry"},
            {"is_churned": "True", "sentiment": "Frustrated", "urgency": "3"},
        )
    )
    flags = [(r["is_negative_sentiment"], r["is_high_urgency"], r["is_churn_risk_signal"]) for r in rows]
    assert flags == [(False, False, False), (False, False, False), (True, False, False), (True, True, True)]


def test_month_bucket(fact_rows):
    rows = fact_rows({"created_at": "2024-02-29"}, {"created_at": "2024-12-31"}, {"created_at": "2025-01-01"})
    months = [r["ticket_month"] for r in rows.collect()]
    assert months == [dt.date(2024, 2, 1), dt.date(2024, 12, 1), dt.date(2025, 1, 1)]


def test_insights_keep_null_groups(fact_rows):
    got = insights(fact_rows({"primary_label": None}, {"primary_label": None}, {"secondary_label": None}))
    assert sorted((str(r["primary_label"]), r["total_tickets"]) for r in got.collect()) == [("Billing", 1), ("None", 2)]


def test_insight_percent_rounds_half_up(fact_rows):
    row = insights(fact_rows({"is_churned": "True"}, *[{}] * 79)).first()
    assert row["pct_from_churned_customers"] == 1.3
    assert row["pct_negative_sentiment"] == 0.0


def test_insights_plan_reduces_before_the_shuffle(fact_rows):
    plan = insights(fact_rows({}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1


ticket = st.fixed_dictionaries(
    {
        "is_churned": st.sampled_from(["True", "False", None]),
        "sentiment": st.sampled_from([*SENTIMENTS, None]),
        "urgency": st.sampled_from(["1", "2", "3", None]),
        "status": st.sampled_from(["Open", "Escalated"]),
        "primary_label": st.sampled_from(["Billing", "Onboarding", None]),
    }
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(ticket, max_size=25))
def test_insight_counts_add_up(raw_rows, rows):
    got = dicts(insights(fact(staging(raw_rows(*rows)))))
    assert sum(r["total_tickets"] for r in got) == len(rows)
    for r in got:
        parts = [v for k, v in r.items() if k.endswith("_tickets") or k == "churn_risk_signals"]
        assert all(0 <= v <= r["total_tickets"] for v in parts)
        assert r["churn_risk_signals"] <= min(r["churned_customer_tickets"], r["negative_sentiment_tickets"])
        assert 0 <= r["pct_from_churned_customers"] <= 100 and 0 <= r["pct_negative_sentiment"] <= 100
