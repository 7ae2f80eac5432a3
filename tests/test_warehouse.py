import json
import os
import sys

import pytest
from conftest import SMALL, dicts
from test_sources import write_rows

from pyspark import cloudpickle

from ticketlens.operators.filters import apply_filters
from ticketlens.operators.summaries import kpis, newest_months, ticket_explorer
from ticketlens.plans import narrative as N
from ticketlens.plans.models import insights
from ticketlens.plans.overview import dashboard
from ticketlens.plans.warehouse import Warehouse
from ticketlens.run import main
from ticketlens.samples.labeler import CONTEXT, sample_labeler, sample_writer
from ticketlens.samples.tickets import source_tickets
from ticketlens.schemas import INSIGHTS_TABLE, RAW_COLUMNS, RAW_TABLE


cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("tables")))
    house.load_labelled(source_tickets(spark, SMALL), sample_labeler, context=CONTEXT)
    house.tell(sample_writer)
    house.build_models()
    return house


def test_tables(spark, house):
    assert spark.table(RAW_TABLE).columns == RAW_COLUMNS
    stg = spark.table("stg_support_tickets")
    assert house.fact.count() == stg.count() and len(house.fact.columns) == 18
    assert spark.catalog.getTable("stg_support_tickets").tableType == "VIEW"
    assert spark.newSession().table("stg_support_tickets").count() == stg.count()
    assert sorted(map(str, house.insights.collect())) == sorted(map(str, insights(house.fact).collect()))
    assert len(spark.table(INSIGHTS_TABLE).columns) == 12


def test_dashboard_reads_the_cells(house):
    filters = {"plan": "Premium", "churn": "Churned Only"}
    assert kpis(apply_filters(house.cells, **filters)).collect() == kpis(apply_filters(house.fact, **filters)).collect()


def test_dashboard_parts(house):
    filters = {"primary": "Onboarding", "churn": "Active Only"}
    snapshot = house.cached_cells()
    parts = dashboard(snapshot.get(), house.fact, **filters)
    on_fact = dashboard(house.fact, house.fact, **filters)
    assert parts.keys() == on_fact.keys()
    for name, df in parts.items():
        assert df.collect() == on_fact[name].collect(), name
    assert {r["primary_label"] for r in parts["ticket_explorer"].collect()} == {"Onboarding"}
    snapshot.drop()


def test_narrative_is_stored(house):
    text = dicts(house.narrative)[0]["narrative"]
    assert text.count("; ") >= 20 and "Billing / " in text


def test_rebuilding_replaces(spark, house):
    before = house.insights.count()
    house.build_models()
    house.tell(lambda prompt: "  short ")
    assert house.insights.count() == before
    assert dicts(house.narrative) == [{"narrative": "short"}]


def test_narrative_prompt(raw_rows):
    rows = raw_rows(
        {"is_churned": "True", "ticket_id": None},
        {"is_churned": "True", "secondary_label": None},
        {"primary_label": "Onboarding"},
        *[{"primary_label": f"Made up {i}", "secondary_label": None, "is_churned": "True"} for i in range(1500)],
    )
    lines = N.narrative_prompt(rows).splitlines()
    assert [line for line in lines if line.startswith("*")] == [
        "* Billing / Failed Payment: 1",
        "* Onboarding / Failed Payment: 1",
        "* Billing: 2",
        "* Other labels: 1500",
    ]
    assert N.narrative_prompt(rows, request="Say it.").endswith("\n\nSay it.")


def test_runner_builds_from_files(spark, tmp_path):
    rows = [{"ticket_id": f"TKT-{i}", "ticket_body": "two\nlines"} for i in range(30)]
    write_rows(tmp_path / "t.csv", *rows, {"ticket_id": "TKT-BAD", "created_at": "soon"})
    main(
        [str(tmp_path), "--labeler", "plain_labeler:label", "--writer", "plain_labeler:write"]
        + ["--location", str(tmp_path / "tables"), "--concurrency", "3", "--lenient"]
    )
    fct = spark.table("fct_support_tickets")
    assert fct.count() == 30 and fct.where("is_high_urgency AND is_negative_sentiment").count() == 30
    assert spark.table(RAW_TABLE).count() == 31
    assert [r["ticket_id"] for r in spark.table("quarantined_support_tickets").collect()] == ["TKT-BAD"]
    assert spark.table("support_insights").agg({"total_tickets": "sum"}).first()[0] == 30
    assert spark.table("product_gap_narrative").first()["narrative"].endswith(" lines")


def test_a_rerun_asks_only_for_what_is_missing(spark, csv_tickets, tmp_path):
    house = Warehouse(spark, str(tmp_path / "tables"))
    tickets = csv_tickets(*[{"ticket_id": f"T{i:02d}"} for i in range(10)])

    def run(healthy, tickets):
        asked = tmp_path / f"asked-{len(list(tmp_path.iterdir()))}"
        asked.mkdir()
        folder = str(asked)

        def labeler(request):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(t["ticket_id"] for t in request.tickets))
            if not healthy and any(t["ticket_id"] < "T05" for t in request.tickets):
                raise TimeoutError
            return json.dumps([{**t, "urgency": 1} for t in request.tickets])

        options = {"stable_batches": True, "batch_size": 5, "resume": True}
        house.load_labelled(tickets, labeler, **options)
        return spark.table(RAW_TABLE), sorted(line for f in asked.iterdir() for line in f.read_text().splitlines())

    spark.sql("DROP TABLE IF EXISTS support_ticket_labels")
    raw, asked = run(False, tickets)
    assert len(asked) == 10 and raw.where("urgency = '2'").count() == 5
    raw, asked = run(True, tickets.unionByName(csv_tickets({"ticket_id": "T99"})))
    assert asked == ["T00", "T01", "T02", "T03", "T04", "T99"]
    assert raw.count() == 11 and raw.where("urgency = '1'").count() == 11
    assert run(True, tickets)[1] == []


def echo(request):
    return json.dumps([{**t, "urgency": 1} for t in request.tickets])


def test_runaway_joins_are_refused_on_request(spark, csv_tickets, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.load_labelled(csv_tickets({"ticket_id": "before"}), echo)
    same = csv_tickets(*[{}] * 30)
    with pytest.raises(ValueError, match="not unique"):
        house.load_labelled(same, echo, max_growth=10)
    assert [r["ticket_id"] for r in spark.table(RAW_TABLE).collect()] == ["before"]
    report = house.load_labelled(same, echo)
    assert (report.tickets, report.labels, report.failed_batches, report.raw_rows) == (30, 30, 0, 900)


def test_a_failed_run_keeps_the_labels_of_its_steps(spark, csv_tickets, tmp_path):
    house = Warehouse(spark, str(tmp_path / "tables"))
    tickets = csv_tickets(*[{"ticket_id": f"T{i:02d}"} for i in range(40)])
    asked = tmp_path / "asked"
    asked.mkdir()

    def labeler(allowed):
        folder = str(asked)

        def run(request):
            import os
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(t["ticket_id"] for t in request.tickets))
            if len(os.listdir(folder)) > allowed:
                os._exit(1)
            return echo(request)

        return run

    def known():
        return sorted(r["ticket_id"] for r in house.labels.collect())

    with pytest.raises(Exception):
        house.load_labelled(tickets.coalesce(1), labeler(2), steps=4, batch_size=40)
    first = known()
    assert 0 < len(first) < 40
    before = set(os.listdir(asked))
    house.load_labelled(tickets.coalesce(1), labeler(10**6), steps=4, batch_size=40, resume=True)
    again = [line for f in asked.iterdir() if f.name not in before for line in f.read_text().splitlines()]
    assert not set(again) & set(first) and known() == sorted(f"T{i:02d}" for i in range(40))


def test_malformed_rows_and_checks_are_stored(spark, tmp_path):
    write_rows(tmp_path / "t.csv", *[{"ticket_id": f"T{i}"} for i in range(5)], {"ticket_id": "T1"}, {"ticket_id": ""})
    with open(tmp_path / "t.csv", "a") as f:
        f.write("T9,U9,Basic,False,Email,Open,Neutral,Billing,Failed Payment,Bank Decline,body,2024-01-01,too,many\r\n")
    house = Warehouse(spark, str(tmp_path / "tables"))
    house.load_labelled(house.read_tickets(str(tmp_path / "t.csv")), echo)
    counts = house.build_models()
    assert counts["malformed_ticket_rows"] == 1 and counts["raw_support_tickets"] == counts["fct_support_tickets"] + 1
    failing = {(r["model"], r["check_name"], r["column_name"]): r["failing_rows"] for r in house.quality.collect()}
    assert failing["raw_support_tickets", "not_null", "ticket_id"] == 1
    assert failing["stg_support_tickets", "not_null", "ticket_id"] == 0
    assert failing["fct_support_tickets", "unique", "ticket_id"] == 1
    assert {m for m, *_ in failing} == {"raw_support_tickets", "stg_support_tickets", "fct_support_tickets", "support_insights"}


# -- changes -------------------------------------------------------------------------

CHANGES = [
    {"ticket_id": "T1", "created_at": "2024-01-05"},
    {"ticket_id": "T2", "created_at": "2024-01-06", "sentiment": "Angry", "is_churned": "True"},
    {"ticket_id": "T2", "created_at": "2024-02-06", "urgency": "3"},
    {"ticket_id": "T3", "created_at": "2024-03-07", "plan_type": "Premium"},
    {"ticket_id": "T4", "created_at": None},
    {"ticket_id": None, "created_at": "2024-03-01"},
    {"ticket_id": "T5", "created_at": "2024-04-01", "user_id": None},
]


def models_of(house):
    return [sorted(map(str, t.collect())) for t in (house.raw, house.fact, house.cells, house.insights)]


def built(spark, path, rows, prefix, lenient=False):
    house = Warehouse(spark, str(path), prefix=prefix)
    house.load_raw(rows)
    house.build_models(lenient)
    return house


@pytest.mark.parametrize(
    ("changed", "removed"),
    [
        ([{"ticket_id": "T2", "created_at": "2024-01-06"}, {"ticket_id": "T9", "created_at": "2025-01-01"}], ["T3"]),
        ([{"ticket_id": "T4", "created_at": "2024-03-31"}], ["T1", "T2", "T5", "unknown"]),
        ([{"ticket_id": None, "created_at": None}, {"ticket_id": "T1", "created_at": None}], [None]),
        ([], ["T1", "T2", "T3", "T4", "T5"]),
        ([], []),
    ],
)
def test_changes_leave_what_a_full_build_would(spark, raw_rows, tmp_path, changed, removed):
    lenient = bool(removed)
    house = built(spark, tmp_path / "a", raw_rows(*CHANGES), "a_", lenient)
    new = raw_rows(*changed) if changed else None
    gone = spark.createDataFrame([(i,) for i in removed], "ticket_id string") if removed else None
    house.apply_changes(new, gone, lenient)
    ids = {r["ticket_id"] for r in changed} | set(removed)
    after = [r for r in CHANGES if r["ticket_id"] is None or r["ticket_id"] not in ids] + changed
    rows = raw_rows(*after) if after else raw_rows(*CHANGES).limit(0)
    full = built(spark, tmp_path / "b", rows, "b_", lenient)
    assert models_of(house) == models_of(full)


def test_rows_that_cannot_be_cast_move_between_models_and_quarantine(spark, raw_rows, tmp_path):
    house = built(spark, tmp_path, raw_rows({"ticket_id": "T1"}, {"ticket_id": "T2", "created_at": "soon"}), "q_", True)
    house.apply_changes(raw_rows({"ticket_id": "T1", "urgency": "high"}, {"ticket_id": "T2"}), lenient=True)
    assert [r.ticket_id for r in house.fact.collect()] == ["T2"]
    assert [r.ticket_id for r in spark.table("q_quarantined_support_tickets").collect()] == ["T1"]


def test_a_change_leaves_other_months_alone(spark, raw_rows, tmp_path):
    rows = raw_rows(*[{"ticket_id": f"T{k}", "created_at": f"2024-{k % 12 + 1:02d}-03"} for k in range(48)])
    house = built(spark, tmp_path, rows, "m_")

    def files(month):
        return sorted(house.fact.where(f"ticket_month = date'{month}'").inputFiles())

    before = {m: files(f"2024-{m:02d}-01") for m in range(1, 13)}
    reader = house.fact
    old = reader.count()
    months = house.apply_changes(raw_rows({"ticket_id": "T1", "created_at": "2024-05-01"}))
    assert [str(m) for m in months] == ["2024-02-01", "2024-05-01"]
    after = {m: files(f"2024-{m:02d}-01") for m in range(1, 13)}
    assert {m for m in before if before[m] != after[m]} == {2, 5}
    # A frame from before the change reads what it has read all along.
    assert reader.count() == old


def test_fact_rows_are_sorted_file_by_file(spark, raw_rows, tmp_path, monkeypatch):
    """A task that reads many small files at once would sort, and spill, the texts of them all."""
    import ticketlens.plans.warehouse as plans

    tasks, write = [], plans.write_version

    def counted(df, name, *args, **options):
        if options.get("partition") == "ticket_month":
            tasks.append((len(df.inputFiles()), df.rdd.getNumPartitions()))
        return write(df, name, *args, **options)

    monkeypatch.setattr(plans, "write_version", counted)
    # More files than cores: small ones would share a task.
    rows = raw_rows(*[{"ticket_id": f"T{k}", "created_at": f"20{k // 12 + 10}-{k % 12 + 1:02d}-03"} for k in range(60)])
    house = built(spark, tmp_path, rows.repartition(1), "s_")
    house.apply_changes(removed=spark.range(36).selectExpr("concat('T', id) AS ticket_id"), changed=raw_rows({"ticket_id": "T59"}))
    assert tasks[0][0] >= 60 and tasks[0][0] == tasks[0][1] and len(tasks) == 2
    assert house.fact.count() == 24


def test_readers_see_the_old_models_while_a_build_runs(spark, raw_rows, tmp_path, monkeypatch):
    import ticketlens.plans.warehouse as plans

    house = built(spark, tmp_path, raw_rows({"ticket_id": "T1"}, {"ticket_id": "T2"}), "r_")
    seen = []
    write = plans.write_version

    def watched(*args, **options):
        found = write(*args, **options)
        seen.append([house.fact.count(), house.cells.agg({"tickets": "sum"}).head()[0], house.insights.count()])
        return found

    monkeypatch.setattr(plans, "write_version", watched)
    house.load_raw(raw_rows({"ticket_id": "T1"}))
    house.build_models()
    assert seen == [[2, 2, 1]] * 3 and house.fact.count() == 1


# -- the explorer --------------------------------------------------------------------


def test_the_explorer_reads_the_newest_months_only(spark, raw_rows, tmp_path):
    rows = [{"ticket_id": f"T{k:03d}", "created_at": f"2024-{k % 12 + 1:02d}-{k % 28 + 1:02d}", "plan_type": "Basic" if k % 2 else "Premium"} for k in range(120)]
    house = built(spark, tmp_path, raw_rows(*rows, {"ticket_id": "T999", "created_at": None}), "e_")
    for n, filters in ((5, {}), (10, {}), (11, {}), (30, {"plan": "Basic"}), (500, {}), (7, {"plan": "Premium", "churn": "Active Only"})):
        got = house.newest_tickets(n, **filters)
        assert got.collect() == ticket_explorer(apply_filters(house.fact, **filters), n).collect()
    # December holds ten tickets.
    for n, months in ((10, 1), (11, 2), (120, 12)):
        plan = house.newest_tickets(n)._jdf.queryExecution().executedPlan()
        assert "PartitionFilters: [isnotnull(ticket_month" in plan.toString()
        found = {f.split("ticket_month=")[1][:10] for f in newest_months(house.fact, house.cells, n).inputFiles()}
        assert len(found) == months and "2024-12-01" in found
    assert house.newest_tickets(121).count() == 121


def test_the_explorer_of_unlisted_plans_is_empty(spark, raw_rows, tmp_path):
    house = built(spark, tmp_path, raw_rows({"ticket_id": "T1"}), "u_")
    assert house.newest_tickets(plan="Enterprise").count() == 0


def test_no_tickets(spark, csv_tickets, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.load_labelled(csv_tickets({}).where("false"), sample_labeler, context=["channel"], stable_batches=True)
    house.build_models()
    assert house.fact.count() == house.insights.count() == house.cells.count() == 0
    assert kpis(house.cells).first()["total_tickets"] == 0
