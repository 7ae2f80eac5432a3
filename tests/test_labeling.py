from collections import Counter
import json
import os
import uuid

import pandas as pd
import pytest
from conftest import SMALL, TICKET, final_plan
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ticketlens.operators.batching import assign_batches, number_in_order, number_rows, place_rows
from ticketlens.operators.labeling import (
    LabelRequest,
    answer,
    attach_labels,
    label_tickets,
    labels_of,
    parse_reply,
    prompt_head,
    render_prompts,
    unlabelled,
)
from ticketlens.samples.labeler import CONTEXT, careful_labeler, sample_labeler
from ticketlens.samples.tickets import source_tickets
from ticketlens.schemas import FALLBACK_SUMMARY, LABEL_COLUMNS, RAW_COLUMNS, REPLACED_COLUMNS
from ticketlens.session import session_conf

LABEL = {
    "primary_label": "Onboarding",
    "secondary_label": "Go-Live Issue",
    "sentiment": "Angry",
    "urgency": 3,
    "one_line_summary": "Site is down",
}


# -- numbering -----------------------------------------------------------------------


def test_numbers_follow_the_order(spark):
    ids = spark.range(5000).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("ticket_id"))
    got = number_rows(ids.repartition(7), "ticket_id").orderBy("row_no").collect()
    assert [(r["ticket_id"], r["row_no"]) for r in got] == [(f"T{i:06d}", i) for i in range(5000)]


def test_no_window_pulls_the_rows_together(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("ticket_id"))
    plan = number_rows(rows, "ticket_id")._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "HashAggregate" in window and "BroadcastExchange" in plan[: plan.index("Window")]


@pytest.mark.parametrize("copies", [False, True])
def test_a_hot_id_is_split_over_ranges(spark, copies):
    """A third of all rows share an id; with ``copies`` they are equal in every column."""
    n = 30_000
    body = F.lit("same") if copies else F.col("id").cast("string")
    hot = F.col("id") % 3 == 0
    rows = spark.range(0, n, 1, 6).select(
        F.when(hot, F.lit("T5")).otherwise(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("ticket_id"),
        F.when(hot, body).otherwise(F.col("id").cast("string")).alias("ticket_body"),
    )
    # Keep the small ranges apart; a big run would not merge ranges of this share.
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        placed = place_rows(rows, "ticket_id").persist()
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 4
    assert placed.where("ticket_id = 'T5'").select("_range").distinct().count() >= 3
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        numbered = number_rows(rows, "ticket_id")
    assert numbered.select("row_no").distinct().count() == n


def test_batches(spark):
    ids = spark.range(45).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("ticket_id"))
    with_null = ids.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS ticket_id"))
    got = assign_batches(with_null).orderBy("ticket_id").collect()
    assert [(r["batch_id"], r["batch_pos"]) for r in got] == [(i // 20, i % 20) for i in range(45)]


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
@pytest.mark.parametrize("unit", [1, 3])
def test_numbers_in_order_with_ties_and_copies(spark, parts, unit):
    """Unique keys, one key with many rows, and equal rows that reach over several parts."""
    rows = [(f"k{i:03d}", i) for i in range(50)] + [("k010", i) for i in range(20)] + [("k025", -1)] * 33
    got = number_in_order(spark.createDataFrame(rows, "k string, v int").repartition(6), "k", unit=unit, parts=parts)
    with_part = got.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.k, r.v) for r in with_part) == sorted(rows)
    ordered = sorted(with_part, key=lambda r: r.row_no)
    assert [r.row_no for r in ordered] == list(range(len(rows)))
    assert [r.k for r in ordered] == sorted(k for k, _ in rows)
    # Rows lie in order in their partitions, and no unit is split.
    assert with_part == sorted(with_part, key=lambda r: (r.part, r.row_no))
    assert len({(r.row_no // unit, r.part) for r in with_part}) == len({r.row_no // unit for r in with_part})
    most = -(-len(rows) // (parts * unit)) * unit
    assert max(Counter(r.part for r in with_part).values()) <= most


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(keys=st.lists(st.sampled_from("abcdef"), max_size=40), parts=st.integers(1, 9), unit=st.integers(1, 5))
def test_numbers_in_order_of_any_rows(spark, keys, parts, unit):
    rows = [(k, i % 3) for i, k in enumerate(keys)]
    got = number_in_order(spark.createDataFrame(rows, "k string, v int"), "k", unit=unit, parts=parts).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.row_no)] == sorted(keys)
    assert sorted((r.k, r.v) for r in got) == sorted(rows)
    assert sorted(r.row_no for r in got) == list(range(len(rows)))


def test_texts_move_once_to_be_batched(spark, csv_tickets, tmp_path):
    path = str(tmp_path / "tickets")
    csv_tickets(*[{"ticket_id": f"T{i:03d}"} for i in range(90)]).write.parquet(path)
    with session_conf(spark, spark__sql__shuffle__partitions="3"):
        prompts = render_prompts(assign_batches(spark.read.parquet(path)))
        plan = final_plan(prompts).split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert [len(r.tickets) for r in prompts.orderBy("batch_id").collect()] == [20, 20, 20, 20, 10]


# -- prompts and replies -------------------------------------------------------------


def test_prompt_holds_whole_texts_in_order(csv_tickets):
    bodies = ["short", "x" * 200_000, 'quote " and\nnewline']
    tickets = csv_tickets(*[{"ticket_id": f"T{i}", "ticket_body": b} for i, b in enumerate(bodies)])
    row = render_prompts(assign_batches(tickets)).first()
    lines = "\n".join(f"- ticket_id: T{i} | body: {b}" for i, b in enumerate(bodies))
    assert row["prompt"] == prompt_head() + lines
    assert [t["ticket_id"] for t in row["tickets"]] == ["T0", "T1", "T2"]


@pytest.mark.parametrize(
    "reply",
    ["", "no", '{"ticket_id": "a"}', '[{"ticket_id": "a"}] done', "[1]", "null", '"text"', "[{}"]
    + ['[{"a": 1}, null]', '[{"ticket_id": "\\ud800"}]'],
)
def test_unusable_replies(reply):
    with pytest.raises(ValueError):
        parse_reply(reply)


def test_usable_replies():
    item = {"ticket_id": "a", **LABEL, "urgency": "2", "extra": [1]}
    for reply in (json.dumps([item]), f"```json\n{json.dumps([item])}\n```", f"  ```{json.dumps([item])}``` \n"):
        assert parse_reply(reply) == [{"ticket_id": "a", **LABEL, "urgency": "2"}]
    assert parse_reply("[]") == []
    assert parse_reply("[{}]") == [dict.fromkeys(["ticket_id", *LABEL_COLUMNS])]
    assert parse_reply('[{"urgency": 2.7}]')[0]["urgency"] == "2.7"


@settings(max_examples=300, deadline=None)
@given(reply=st.one_of(st.text(), st.from_regex(r"(```json)?[\[\]{}\",:a-z0-9 ]*(```)?", fullmatch=True)))
def test_answer_never_raises(reply):
    tickets = [{"ticket_id": i, **{k: LABEL[k] for k in LABEL_COLUMNS[:3]}} for i in "abc"]
    row = answer(lambda request: reply, LabelRequest(0, "", tickets))
    if row["is_fallback"]:
        assert [r["ticket_id"] for r in row["labels"]] == list("abc")
        assert {r["one_line_summary"] for r in row["labels"]} == {FALLBACK_SUMMARY}
        assert row["error"]
    else:
        assert row["error"] is None


# -- the job -------------------------------------------------------------------------


def test_a_failing_batch_keeps_its_own_labels(csv_tickets):
    def labeler(request):
        if request.batch_id == 1:
            raise TimeoutError("no answer")
        return json.dumps([{"ticket_id": t["ticket_id"], **LABEL} for t in request.tickets])

    tickets = csv_tickets(*[{"ticket_id": f"T{i:02d}"} for i in range(45)])
    seen = Observation("run")
    answers = label_tickets(tickets, labeler, stable_batches=True, observation=seen)
    assert seen.get == {"batches": 3, "failed_batches": 1, "tickets": 45, "labels": 45}
    assert answers.where("is_fallback").first()["error"] == "TimeoutError: no answer"
    rows = {r["ticket_id"]: r for r in labels_of(answers).collect()}
    assert rows["T00"]["primary_label"] == "Onboarding" and rows["T00"]["urgency"] == "3"
    assert rows["T25"]["primary_label"] == TICKET["primary_label"] and rows["T25"]["urgency"] == "2"
    assert sum(r["is_fallback"] for r in rows.values()) == 20


@pytest.mark.parametrize("stable", [False, True])
def test_each_ticket_is_asked_once(spark, tmp_path, stable):
    calls = str(tmp_path)

    def labeler(request):
        with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(t["ticket_id"] for t in request.tickets))
        return json.dumps([{"ticket_id": t["ticket_id"], **LABEL} for t in request.tickets])

    tickets = source_tickets(spark, SMALL, body=False)
    answers = label_tickets(tickets, labeler, stable_batches=stable, concurrency=4)
    # Using the answers again and again must not ask again.
    enriched = attach_labels(tickets, labels_of(answers))
    enriched.count(), enriched.count(), answers.count()
    asked = [line for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    want = [r["ticket_id"] for r in tickets.where("ticket_id IS NOT NULL").collect()]
    assert sorted(asked) == sorted(want)


def test_in_place_needs_no_shuffle_of_texts(spark, csv_tickets, tmp_path):
    from ticketlens.operators.labeling import answers_in_place

    csv_tickets({}).write.parquet(str(tmp_path / "t"))
    plan = answers_in_place(spark.read.parquet(str(tmp_path / "t")), careful_labeler)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_in_place_batches_give_the_same_labels(spark):
    tickets = source_tickets(spark, SMALL).repartition(5)

    def rows(**options):
        answers = label_tickets(tickets, careful_labeler, context=CONTEXT, **options)
        assert answers.where("tickets > 7").isEmpty()
        assert answers.select("batch_id").distinct().count() == answers.count()
        return sorted(map(str, labels_of(answers).drop("batch_id", "label_pos").collect()))

    assert rows(batch_size=7) == rows(batch_size=7, stable_batches=True)


# -- joining back --------------------------------------------------------------------


@pytest.fixture()
def label_rows(spark):
    schema = "ticket_id STRING, " + ", ".join(f"{c} STRING" for c in LABEL_COLUMNS) + ", is_fallback BOOLEAN"

    def make(*ids, fallback=False):
        return spark.createDataFrame([(i, *[str(LABEL[c]) for c in LABEL_COLUMNS], fallback) for i in ids], schema)

    return make


def test_left_join_loses_and_multiplies(csv_tickets, label_rows):
    tickets = csv_tickets(
        {"ticket_id": "once"}, {"ticket_id": "twice"}, {"ticket_id": "never"}, {"ticket_id": None}, {"ticket_id": None}
    )
    got = attach_labels(tickets, label_rows("once", "twice", "twice", "unknown"))
    assert got.columns == RAW_COLUMNS
    rows = sorted((str(r["ticket_id"]), r["primary_label"]) for r in got.collect())
    assert rows == [
        ("None", None),
        ("None", None),
        ("never", None),
        ("once", "Onboarding"),
        ("twice", "Onboarding"),
        ("twice", "Onboarding"),
    ]


def test_duplicate_ids_on_both_sides(csv_tickets, label_rows):
    tickets = csv_tickets({"ticket_id": "a"}, {"ticket_id": "a"})
    assert attach_labels(tickets, label_rows("a", "a")).count() == 4


def test_null_ids_match_nothing(csv_tickets, label_rows):
    got = attach_labels(csv_tickets({"ticket_id": None}, {"ticket_id": "a"}), label_rows(None, "a"))
    assert sorted(str(r["primary_label"]) for r in got.collect()) == ["None", "Onboarding"]


def test_labels_that_pile_up_are_dealt_to_parts(csv_tickets, label_rows, monkeypatch):
    monkeypatch.setattr("ticketlens.operators.labeling.LABELS_PER_PART", 3)
    tickets = csv_tickets({"ticket_id": "a"}, {"ticket_id": "a"}, {"ticket_id": "b"}, {"ticket_id": "c"}, {"ticket_id": None})
    got = attach_labels(tickets, label_rows(*["a"] * 10, "b", *["made up"] * 20, None))
    counts = Counter((r["ticket_id"], r["primary_label"] is None) for r in got.collect())
    assert counts == {("a", False): 20, ("b", False): 1, ("c", True): 1, (None, True): 1}


def test_labels_are_dealt_alike_however_they_lie(spark, csv_tickets, monkeypatch):
    """A task that runs again may read its labels in another order; the deal must not change."""
    monkeypatch.setattr("ticketlens.operators.labeling.LABELS_PER_PART", 4)
    replies = [(k // 10, k % 10, "a", *[str(LABEL[c]) for c in LABEL_COLUMNS], False) for k in range(60)]
    schema = "batch_id BIGINT, label_pos INT, ticket_id STRING, " + ", ".join(f"{c} STRING" for c in LABEL_COLUMNS)
    labels = spark.createDataFrame(replies, schema + ", is_fallback BOOLEAN")
    joined = attach_labels(csv_tickets({"ticket_id": "a"}), labels)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically" not in plan and "xxhash64(batch_id" in plan
    for n in (1, 5, 13):
        assert attach_labels(csv_tickets({"ticket_id": "a"}), labels.repartition(n)).count() == 60


def test_like_a_left_join(spark, label_rows):
    tickets = source_tickets(spark, SMALL, body=False)
    labels = labels_of(label_tickets(tickets, sample_labeler, context=CONTEXT))
    got = attach_labels(tickets.drop("priority"), labels)
    plain = tickets.drop("priority", "primary_label", "secondary_label", "sentiment").join(
        labels.drop("batch_id", "label_pos", "is_fallback"), "ticket_id", "left"
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.select(*got.columns).collect()))


@pytest.mark.parametrize("hot_side", ["tickets", "labels", "unknown labels"])
def test_a_hot_id_is_split_by_the_join(spark, hot_side, monkeypatch):
    """A third of one side has one id; with "unknown labels" it is that of no ticket."""
    n = 60_000

    def ids(hot):
        plain = F.col("id").cast("string")
        return spark.range(0, n, 1, 12).select(
            (F.when(F.col("id") % 3 == 0, "0") if hot else F.when(F.col("id") < 0, "")).otherwise(plain).alias("ticket_id"),
            F.sha2(plain, 256).alias("text"),
        )

    constant = {**TICKET, **{c: str(v) for c, v in LABEL.items()}}
    tickets = ids(hot_side == "tickets").select(
        "ticket_id",
        *[F.lit(constant[c]).alias(c) for c in RAW_COLUMNS if c not in ["ticket_id", "ticket_body", *LABEL_COLUMNS]],
        F.col("text").alias("ticket_body"),
    )
    labels = ids(hot_side != "tickets").select(
        "ticket_id",
        *[F.lit(constant[c]).alias(c) for c in LABEL_COLUMNS if c != "one_line_summary"],
        F.col("text").alias("one_line_summary"),
    )
    if hot_side == "unknown labels":
        tickets = tickets.where("ticket_id <> '0'")
    with session_conf(
        spark,
        # The few ids with many labels are broadcast, tickets and labels are not.
        spark__sql__autoBroadcastJoinThreshold="1KB",
        spark__sql__adaptive__autoBroadcastJoinThreshold="1KB",
        spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold="0",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100KB",
    ):
        monkeypatch.setattr("ticketlens.operators.labeling.LABELS_PER_PART", 500)
        joined = attach_labels(tickets, labels)
        final = final_plan(joined).split("Initial Plan")[0]
        if hot_side == "tickets":
            assert "skew=true" in final
        rows = joined.count()
        missing = joined.where("primary_label IS NULL").count()
    if hot_side == "tickets":
        assert (rows, missing) == (n, 0)
    elif hot_side == "labels":
        assert (rows, missing) == (n + n // 3 - 1, n // 3 - 1)
    else:
        assert (rows, missing) == (n - 1, n // 3 - 1)


@pytest.mark.parametrize("piled", [False, True])
def test_both_sides_of_the_join_are_shuffled_once(spark, csv_tickets, label_rows, tmp_path, monkeypatch, piled):
    """Too large to broadcast, neither goes through a shuffle of its own to meet the ids with many labels."""
    if piled:
        monkeypatch.setattr("ticketlens.operators.labeling.LABELS_PER_PART", 2)
    csv_tickets({"ticket_id": "a"}, {"ticket_id": "b"}, {"ticket_id": None}).write.parquet(str(tmp_path / "tickets"))
    label_rows(*["a"] * 5, "b").write.parquet(str(tmp_path / "labels"))
    tickets, labels = (spark.read.parquet(str(tmp_path / name)) for name in ("tickets", "labels"))
    with session_conf(
        spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"
    ):
        joined = attach_labels(tickets, labels)
        plan = final_plan(joined).split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 2
        assert Counter(r["ticket_id"] for r in joined.collect()) == {"a": 5, "b": 1, None: 1}


def test_tickets_are_read_once(spark, csv_tickets, label_rows, tmp_path):
    path = str(tmp_path / "tickets")
    csv_tickets({}, {"ticket_id": None}).write.parquet(path)
    joined = attach_labels(spark.read.parquet(path), label_rows("a", "TKT-00000001"))
    plan = final_plan(joined).split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1


ids = st.lists(st.sampled_from(["a", "b", "c", None]), max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ticket_ids=ids, label_ids=ids)
def test_the_join_is_a_pandas_merge_without_null_labels(csv_tickets, label_rows, ticket_ids, label_ids):
    left = pd.DataFrame({"ticket_id": pd.Series(ticket_ids, dtype=object)})
    right = pd.DataFrame({"ticket_id": pd.Series(label_ids, dtype=object), "urgency": "3"})
    tickets, labels = csv_tickets(*[{"ticket_id": i} for i in ticket_ids]), label_rows(*label_ids)

    def bag(rows):
        return sorted((str(i), u == "3") for i, u in rows)

    without_null = left.merge(right.dropna(), on="ticket_id", how="left")
    got = attach_labels(tickets, labels).select("ticket_id", "urgency")
    assert bag(got.collect()) == bag(zip(without_null["ticket_id"], without_null["urgency"], strict=True))


def test_unlabelled(csv_tickets, label_rows):
    tickets = csv_tickets(*[{"ticket_id": i} for i in ("a", "b", "c", None)])
    labels = label_rows("a", "a").unionByName(label_rows("b", fallback=True))
    assert sorted(r["ticket_id"] for r in unlabelled(tickets, labels).collect()) == ["b", "c"]
    assert [r["ticket_id"] for r in unlabelled(tickets, labels, retry_fallbacks=False).collect()] == ["c"]


def test_only_the_columns_of_a_request_are_moved(spark, csv_tickets, tmp_path):
    """Rows of repeated ids keep the order that all their columns give, equal ones included."""
    rows = [{"ticket_id": f"T{k % 7}", "user_id": f"U{k % 30}", "ticket_body": f"body {k % 30}"} for k in range(90)]
    csv_tickets(*rows).write.parquet(str(tmp_path / "t"))
    tickets = spark.read.parquet(str(tmp_path / "t"))
    few = ["ticket_id", "channel", "ticket_body"]
    for parts in (1, 4):
        whole = assign_batches(tickets, parts=parts).select(*few, "batch_id", "batch_pos")
        got = assign_batches(tickets, parts=parts, columns=few)
        assert got.columns == whole.columns and sorted(got.collect()) == sorted(whole.collect())


def test_a_labeller_run_moves_no_other_columns(spark, csv_tickets, tmp_path, monkeypatch):
    from ticketlens.operators import batching

    moved, send = [], batching.sent_to_parts
    monkeypatch.setattr(batching, "sent_to_parts", lambda rows, parts: moved.append(rows.columns) or send(rows, parts))
    tickets = csv_tickets(*[{"ticket_id": f"T{k:02d}"} for k in range(30)])

    def labeler(request):
        return json.dumps([{"ticket_id": t["ticket_id"]} for t in request.tickets])

    answers = label_tickets(tickets, labeler, context=["channel"], stable_batches=True)
    assert answers.agg(F.sum("tickets")).head()[0] == 30
    assert sorted(moved[0]) == sorted(["ticket_id", *REPLACED_COLUMNS, "channel", "ticket_body", "_part"])
