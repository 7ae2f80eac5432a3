import pytest
from conftest import SMALL, dicts, final_plan

from ticketlens.operators import summaries as S
from ticketlens.operators.filters import apply_filters, filter_choices, pick_columns
from ticketlens.plans.overview import all_summaries, context_table, pick_summary, summary_cells
from ticketlens.plans.models import fact, insights, staging
from ticketlens.samples.tickets import raw_tickets
from ticketlens.schemas import EXPLORER_COLUMNS


@pytest.fixture(scope="module")
def fct(spark):
    return fact(staging(raw_tickets(spark, SMALL, body=False))).persist()


@pytest.fixture(scope="module")
def cells(fct):
    return summary_cells(fct).persist()


def test_filters(fact_rows):
    rows = fact_rows(
        {"plan_type": "Premium"}, {"is_churned": "True"}, {"is_churned": None}, {"primary_label": "Onboarding"}
    )
    assert apply_filters(rows).count() == 4
    assert apply_filters(rows, plan="Premium").count() == 1
    assert apply_filters(rows, primary="Onboarding").count() == 1
    assert apply_filters(rows, churn="Churned Only").count() == 1
    assert apply_filters(rows, churn="Active Only").count() == 2
    with pytest.raises(ValueError):
        apply_filters(rows, churn="Sometimes")


def test_filter_choices(fact_rows):
    rows = filter_choices(fact_rows({"plan_type": "Standard"}, {"plan_type": None}, {}))
    assert [(r["filter"], r["choice"]) for r in rows.collect()] == [
        ("plan_type", "All"),
        ("plan_type", "Basic"),
        ("plan_type", "Standard"),
        ("primary_label", "All"),
        ("primary_label", "Billing"),
    ]


def test_pick_columns_skips_missing(fact_rows):
    assert pick_columns(fact_rows({}), ["status", "nope", "ticket_id"]).columns == ["status", "ticket_id"]


def test_kpis_half_even_and_empty(fact_rows):
    rows = fact_rows({"sentiment": "Angry"}, *[{}] * 15)
    assert S.kpis(rows).first()["negative_pct"] == 6.2
    empty = S.kpis(rows.where("false")).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, 0.0)
    assert S.kpis(summary_cells(rows.where("false"))).first() == empty
    assert [r["delta"] for r in S.kpi_cards(rows.where("false")).collect()] == [None, None, "0%", None, None]


def test_card_text(spark):
    cells = spark.sql(
        "SELECT 1234567L AS tickets, 0L AS churn_signals, 617283L AS negative_tickets, "
        "1000L AS high_urgency_tickets, 999L AS escalated_tickets"
    )
    assert [(r["value"], r["delta"]) for r in S.kpi_cards(cells).collect()] == [
        ("1,234,567", None),
        ("0", None),
        ("617,283", "50.0%"),
        ("1,000", None),
        ("999", None),
    ]


def test_null_keys_are_left_out(fact_rows):
    rows = fact_rows({"primary_label": None}, {"secondary_label": None}, {})
    assert dicts(S.volume_by_primary(rows)) == [{"primary_label": "Billing", "tickets": 2}]
    assert [r["tickets"] for r in dicts(S.secondary_breakdown(rows))] == [1]


SUMMARIES = [
    S.kpis,
    S.kpi_cards,
    S.volume_by_primary,
    S.sentiment_distribution,
    S.churn_risk_by_primary,
    S.churned_by_primary,
    S.monthly_trend,
    S.secondary_breakdown,
    lambda df: S.top_pairs(df, 20),
]


@pytest.mark.parametrize("filters", [{}, {"plan": "Basic", "churn": "Active Only"}, {"primary": "Billing"}])
def test_cells_answer_like_fact_rows(fct, cells, filters):
    for summary in SUMMARIES:
        on_fact = summary(apply_filters(fct, **filters)).collect()
        assert summary(apply_filters(cells, **filters)).collect() == on_fact


def test_insights_from_cells(fct, cells):
    assert sorted(map(str, insights(cells).collect())) == sorted(map(str, insights(fct).collect()))


def test_one_pass_equals_single_summaries(fct, cells):
    summaries = all_summaries(cells).persist()

    def same(picked, single):
        assert sorted(map(str, picked.collect())) == sorted(map(str, single.select(*picked.columns).collect()))

    same(pick_summary(summaries, "by_primary"), S.volume_by_primary(fct))
    same(pick_summary(summaries, "by_primary", "churn_signals"), S.churn_risk_by_primary(fct))
    same(pick_summary(summaries, "by_primary", "churned_tickets"), S.churned_by_primary(fct))
    same(pick_summary(summaries, "by_pair"), S.secondary_breakdown(fct))
    same(pick_summary(summaries, "by_month"), S.monthly_trend(fct))
    assert pick_summary(summaries, "total").first()["tickets"] == fct.count()


def test_one_pass_scans_the_fact_table_once(spark, fct, tmp_path):
    fct.write.parquet(str(tmp_path / "fct"))
    plan = final_plan(all_summaries(summary_cells(spark.read.parquet(str(tmp_path / "fct")))))
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan") == 1
    # Rows are multiplied for the grouping sets only after they became cells.
    assert final.index("Expand") < final.index("FileScan")
    assert final[final.index("Expand") :].count("HashAggregate") == 2
    assert "ticket_id" not in final[final.index("ReadSchema") :]


def test_top_lists_are_repeatable(fact_rows):
    rows = [{"secondary_label": f"Label {i:02d}"} for i in range(25)]
    first = [r["secondary_label"] for r in S.top_pairs(fact_rows(*rows), 20).collect()]
    assert first == [f"Label {i:02d}" for i in range(20)]
    assert first == [r["secondary_label"] for r in S.top_pairs(fact_rows(*rows[::-1]).repartition(5), 20).collect()]


def test_top_lists_and_explorer_need_no_full_sort(fct):
    for df in (S.top_pairs(fct, 20), S.ticket_explorer(fct)):
        assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_explorer(fact_rows):
    rows = fact_rows(
        {"created_at": None, "ticket_id": "TKT-C"},
        {"ticket_id": "TKT-B"},
        {"created_at": "2024-03-01"},
        {"ticket_id": "TKT-A"},
    )
    got = S.ticket_explorer(rows)
    assert got.columns == EXPLORER_COLUMNS
    assert [r["ticket_id"] for r in got.collect()] == ["TKT-00000001", "TKT-A", "TKT-B", "TKT-C"]
    assert S.ticket_explorer(rows, 2).count() == 2


def test_no_window_in_summaries(fct):
    for summary in SUMMARIES:
        assert "Window" not in summary(fct)._jdf.queryExecution().executedPlan().toString()


def test_context_with_and_without_narrative(spark, fact_rows):
    rows = fact_rows({"is_churned": "True", "sentiment": "Angry"}, {})
    got = dicts(context_table(rows, plan="Basic"))
    assert got[0]["key1"] == "Churn" and got[1]["value"] == "Basic"
    assert [r["value"] for r in got if r["section"] == "narrative"] == ["Not available"]
    top = [(r["rank"], r["key1"], r["value"]) for r in got if r["section"] == "top_categories"]
    assert top == [(1, "Billing", "2")]
    told = context_table(rows, spark.createDataFrame([("All is well.",)], "narrative STRING"))
    assert [r["value"] for r in dicts(told) if r["section"] == "narrative"] == ["All is well."]
    nothing = dicts(context_table(rows.where("false")))
    assert [r["value"] for r in nothing if r["section"] == "total"] == ["0"] * 4
