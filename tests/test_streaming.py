import json
from pathlib import Path

from conftest import TICKET, dicts
from test_sources import write_rows

from ticketlens.operators.labeling import LabelRequest
from ticketlens.plans.models import fact, staging
from ticketlens.samples.labeler import careful_labeler
from ticketlens.session import shared_dir
from ticketlens.sources.ticket_csv import read_ticket_csv
from ticketlens.streaming.live_tickets import daily_trend, first_arrivals, start_fact_stream, ticket_stream


def test_fact_rows_arrive_once(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "fct")
    inbox.mkdir()

    def labeler(request):
        known = [{**t, "channel": "Chat", "priority": "1"} for t in request.tickets]
        return careful_labeler(LabelRequest(request.batch_id, request.prompt, known))

    write_rows(inbox / "1.csv", {"ticket_id": "TKT-1"}, {"ticket_id": "TKT-2", "user_id": ""})

    def run():
        stream = ticket_stream(spark, str(inbox))
        start_fact_stream(stream, labeler, target, str(tmp_path / "check")).awaitTermination()
        return spark.read.parquet(target)

    assert [r["ticket_id"] for r in run().collect()] == ["TKT-1"]
    write_rows(inbox / "2.csv", {"ticket_id": "TKT-3", "sentiment": "Angry", "is_churned": "True"})
    got = run()
    assert sorted(r["ticket_id"] for r in got.collect()) == ["TKT-1", "TKT-3"]
    assert got.where("is_churn_risk_signal").count() == 1
    expected = fact(staging(read_ticket_csv(spark, str(inbox)).selectExpr("*", "'1' AS urgency", "'' AS one_line_summary")))
    assert set(expected.columns) == set(got.columns) - {"load"}


def test_a_stream_leaves_no_scratch_behind_and_keeps_bad_rows(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "fct")
    inbox.mkdir()

    def labeler(request):
        return json.dumps([{**t, "urgency": "high" if t["ticket_id"] == "T2" else 1} for t in request.tickets])

    before = set(Path(shared_dir(spark)).glob("*")) if Path(shared_dir(spark)).exists() else set()
    for n in range(3):
        write_rows(inbox / f"{n}.csv", {"ticket_id": f"T{n}"})
        stream = ticket_stream(spark, str(inbox))
        start_fact_stream(stream, labeler, target, str(tmp_path / "check"), lenient=True).awaitTermination()
    assert set(Path(shared_dir(spark)).glob("*")) == before
    assert sorted(r["ticket_id"] for r in spark.read.parquet(target).collect()) == ["T0", "T1"]
    assert [r["ticket_id"] for r in spark.read.parquet(f"{target}-quarantine").collect()] == ["T2"]


def test_repeats_are_dropped_and_late_tickets_kept(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    arrivals = daily_trend(first_arrivals(ticket_stream(spark, str(inbox))))
    query = (
        arrivals.writeStream.format("memory").queryName("trend").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "check")).start()
    )
    try:
        for n, rows in enumerate(
            [
                [("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01")],
                [("b", "2024-01-01"), ("c", "2024-01-05")],
                [("late", "2024-01-01"), ("d", "2024-01-09")],
            ]
        ):
            write_rows(inbox / f"{n}.csv", *[{"ticket_id": i, "created_at": day} for i, day in rows])
            query.processAllAvailable()
        got = {(str(r["day"]), r["tickets"]) for r in dicts(spark.table("trend"))}
    finally:
        query.stop()
    assert got == {("2024-01-01", 3), ("2024-01-05", 1), ("2024-01-09", 1)}
    assert TICKET["primary_label"] in {r["primary_label"] for r in dicts(spark.table("trend"))}
