from conftest import SMALL, dicts

from ticketlens.operators import quality as Q
from ticketlens.plans.models import insights
from ticketlens.taxonomy import TAXONOMY, taxonomy_leaves, taxonomy_pairs


def test_taxonomy_tables(spark):
    pairs = [tuple(r) for r in taxonomy_pairs(spark).collect()]
    assert pairs == [(p, s) for p in TAXONOMY for s in TAXONOMY[p]] and len(pairs) == 24
    leaves = [tuple(r) for r in taxonomy_leaves(spark).collect()]
    assert leaves == [(p, s, t) for p in TAXONOMY for s in TAXONOMY[p] for t in TAXONOMY[p][s]] and len(leaves) == 72


def failing(report):
    return {(r["check_name"], r["column_name"]): r["failing_rows"] for r in dicts(report)}


def test_clean_tickets_pass(fact_rows):
    fct = fact_rows({}, {"ticket_id": "TKT-2", "sentiment": "Angry"})
    assert set(failing(Q.quality_report(fct, insights(fct))).values()) == {0}


def test_broken_tickets_are_counted(fact_rows):
    fct = fact_rows(
        {},
        {},
        {"ticket_id": "b", "primary_label": "Other"},
        {"ticket_id": "c", "secondary_label": "Go-Live Issue"},
        {"ticket_id": "d", "tertiary_label": "Dashboard"},
        {"ticket_id": "e", "urgency": "9", "sentiment": "Bored"},
        {"ticket_id": "f", "one_line_summary": "  one two three four five six seven eight nine\tten eleven "},
        {"ticket_id": "g", "one_line_summary": "1 2 3 4 5 6 7 8 9 10", "primary_label": None},
    )
    got = failing(Q.quality_report(fct))
    assert got[("unique", "ticket_id")] == 1
    assert got[("not_null", "primary_label")] == 1 and got[("not_null", "ticket_id")] == 0
    assert got[("accepted_values", "primary_label")] == 1
    assert got[("accepted_values", "sentiment")] == 1
    assert got[("accepted_range", "urgency")] == 1
    assert got[("max_words", "one_line_summary")] == 1
    # "Other" and the wrong secondary; their tertiary labels belong to no known pair either
    assert got[("relationship", "secondary_label")] == 2
    assert got[("relationship", "tertiary_label")] == 3
    assert Q.pair_violations(fct).count() == 2 and Q.leaf_violations(fct).count() == 3


def test_group_keys_treat_null_as_a_value(fact_rows):
    rows = fact_rows({"primary_label": None}, {"primary_label": None})
    assert Q.unique_group_key(rows, ["primary_label"]).first()["failing_rows"] == 1
    assert Q.unique_key(rows, ["primary_label"]).first()["failing_rows"] == 0


def test_taxonomy_is_broadcast_and_rows_are_scanned_once(spark, fact_rows, tmp_path):
    fact_rows({}).write.parquet(str(tmp_path / "fct"))
    fct = spark.read.parquet(str(tmp_path / "fct"))
    plan = Q.pair_violations(fct)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    checks = Q.label_checks() + Q.range_checks() + Q.taxonomy_checks()
    plan = Q.run_checks(Q.with_taxonomy_marks(fct), checks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_taxonomy_volume_lists_empty_entries(fact_rows):
    rows = dicts(Q.taxonomy_volume(fact_rows({}, {}, {"primary_label": "Other"}), Q.LEAF))
    assert len(rows) == 72 and sum(r["tickets"] for r in rows) == 2
    assert {r["tertiary_label"]: r["tickets"] for r in rows}["Bank Decline"] == 2


def test_join_accounting(spark):
    tickets = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "ticket_id STRING")
    labels = spark.createDataFrame([("a",), ("a",), ("b",), ("x",), (None,)], "ticket_id STRING")
    got = {r["measure"]: r["value"] for r in dicts(Q.label_join_accounting(tickets, labels))}
    assert got == {
        "tickets": 5,
        "labels": 5,
        "tickets_without_label": 2,
        "ids_labelled_more_than_once": 1,
        "labels_of_unknown_ids": 2,
        "most_labels_of_one_id": 2,
        "joined_rows": tickets.join(labels, "ticket_id", "left").count(),
    }
    nothing = Q.label_join_accounting(tickets.where("false"), labels.where("false"))
    assert {r["value"] for r in dicts(nothing)} == {0}


def test_accounting_agrees_with_the_join(spark):
    from ticketlens.operators.labeling import attach_labels, label_tickets, labels_of
    from ticketlens.samples.labeler import CONTEXT, sample_labeler
    from ticketlens.samples.tickets import source_tickets

    tickets = source_tickets(spark, SMALL, body=False)
    labels = labels_of(label_tickets(tickets, sample_labeler, context=CONTEXT))
    got = {r["measure"]: r["value"] for r in dicts(Q.label_join_accounting(tickets, labels))}
    assert got["joined_rows"] == attach_labels(tickets, labels).count()
    assert got["tickets"] == tickets.count() and got["labels"] == labels.count()
