import datetime
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ticketlens.operators import packed_texts as P
from ticketlens.operators.batching import assign_batches, assign_batches_apart
from ticketlens.plans.warehouse import Warehouse
from ticketlens.schemas import FACT_TABLE, RAW_TABLE, TEXTS_TABLE
from ticketlens.sources.versions import current_version, leased, texts_of, versions_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def echo(request):
    return json.dumps([{**t, "urgency": 1} for t in request.tickets])


def rows_of(df):
    return sorted(map(str, df.collect()))


def tickets_of(csv_tickets, count, texts, **more):
    """Tickets of three months, of which every tenth has no text, with ``texts`` texts."""
    return csv_tickets(
        *[
            {
                "ticket_id": f"T{k:03d}",
                "created_at": None if k % 11 == 5 else f"2024-{k % 3 + 1:02d}-05",
                "ticket_body": None if k % 10 == 9 else f"text {k % texts} é, line\n{'word ' * 40}",
                **more,
            }
            for k in range(count)
        ]
    )


@pytest.fixture()
def house(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "tables"), prefix="shared_")
    yield house
    for name in (RAW_TABLE, FACT_TABLE, TEXTS_TABLE, "support_summary_cells", "support_insights"):
        spark.sql(f"DROP VIEW IF EXISTS shared_{name}")
        for version in versions_of(spark, f"shared_{name}"):
            spark.sql(f"DROP TABLE {version}")


def texts_version(house):
    return texts_of(house.spark, current_version(house.spark, house.named(RAW_TABLE)))


# -- the operator --------------------------------------------------------------------


@pytest.mark.parametrize("per_key", [100_000, 4])
def test_rows_name_texts_that_are_there_once(spark, monkeypatch, tmp_path, per_key):
    monkeypatch.setattr(P, "ROWS_PER_KEY", per_key)
    rows = [(k, f"2024-{k % 3 + 1:02d}-01", None if k % 7 == 6 else f"text {k % 4 if k < 30 else 0}") for k in range(60)]
    df = spark.createDataFrame(rows, "k int, m string, t string").withColumn("m", F.col("m").cast("date")).repartition(5)
    named, texts = P.text_apart(df, lambda kept: kept.where("k <> 3"), "t", F.col("m"), str(tmp_path / "scratch"))
    assert named.where("t IS NOT NULL").isEmpty() and named.columns == ["k", "m", "t", P.TEXT_KEY]
    held = texts.collect()
    assert len({r[P.TEXT_KEY] for r in held}) == len(held) and {r.t for r in held} == {f"text {i}" for i in range(4)}
    assert len(held) == (4 if per_key > 4 else sum(-(-n // 4) for n in (26 + 7, 6, 6, 7))), held
    found = named.drop("t").join(texts.select(P.TEXT_KEY, "t"), P.TEXT_KEY, "left").select("k", "m", "t")
    assert rows_of(found) == rows_of(df.where("k <> 3"))
    newest = {r.t: r[P.TEXT_GROUP] for r in held}
    assert newest["text 1"] == max(r[1] for r in df.where("t = 'text 1'").select("t", "m").collect())
    # No key has many more rows than it should.
    assert named.where(f"{P.TEXT_KEY} IS NOT NULL").groupBy(P.TEXT_KEY).count().agg(F.max("count")).head()[0] <= max(33 if per_key > 4 else 12, 0)


def test_rows_keep_texts_that_hardly_repeat(spark, tmp_path):
    rows = [(k, "2024-01-01", f"text {min(k, 50)}") for k in range(55)]
    df = spark.createDataFrame(rows, "k int, m string, t string").withColumn("m", F.col("m").cast("date"))
    kept, texts = P.text_apart(df, lambda rows: rows, "t", F.col("m"), str(tmp_path / "scratch"))
    assert texts is None and kept.columns == df.columns and rows_of(kept) == rows_of(df)


# -- the tables ----------------------------------------------------------------------


def test_raw_and_fact_rows_share_one_copy_of_a_text(spark, csv_tickets, house, tmp_path):
    tickets = tickets_of(csv_tickets, 120, 7)
    house.load_labelled(tickets, echo)
    house.build_models()
    bodies = rows_of(tickets.select("ticket_id", "ticket_body"))
    for table in (house.raw, house.staging, house.fact):
        assert rows_of(table.select("ticket_id", "ticket_body")) == bodies
    for name in (RAW_TABLE, FACT_TABLE):
        stored = spark.table(current_version(spark, house.named(name)))
        assert stored.where("ticket_body IS NOT NULL").isEmpty() and stored.count() == 120
    assert spark.table(texts_version(house).table).count() == 7
    with leased(spark, house.named(FACT_TABLE)) as rows:
        assert rows_of(rows.select("ticket_id", "ticket_body")) == bodies
    # Readers of other columns read no texts, and count without a join.
    for df in (house.fact.select("ticket_id", "urgency"), house.raw.groupBy("status").count(), house.fact.where("urgency = 1").groupBy().count()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "ticket_body" not in plan.split("Relation")[0], plan


def test_texts_that_hardly_repeat_stay_in_the_rows(spark, csv_tickets, house):
    tickets = tickets_of(csv_tickets, 40, 1000)
    house.load_labelled(tickets, echo)
    house.build_models()
    assert texts_version(house) is None and not versions_of(spark, house.named(TEXTS_TABLE))
    assert rows_of(house.fact.select("ticket_id", "ticket_body")) == rows_of(tickets.select("ticket_id", "ticket_body"))


def test_older_models_keep_their_texts_while_loads_go_on(spark, csv_tickets, house, tmp_path):
    first = tickets_of(csv_tickets, 30, 4)
    house.load_labelled(first, echo)
    house.build_models()
    reader, held = house.fact, rows_of(house.fact)
    for k in range(4):
        house.load_labelled(tickets_of(csv_tickets, 30 + k, 3, user_id=f"U{k}"), echo)
    assert rows_of(house.fact) == held == rows_of(reader)
    house.build_models()
    house.build_models()
    # Versions that no rows name any more go, but for the newest.
    names = versions_of(spark, house.named(TEXTS_TABLE))
    used = {texts_of(spark, v).table for t in (RAW_TABLE, FACT_TABLE) for v in versions_of(spark, house.named(t))}
    assert used <= set(names) and len(names) == 2
    assert len(list((tmp_path / "tables" / house.named(TEXTS_TABLE)).iterdir())) == 2
    assert house.fact.where("ticket_body LIKE 'text%'").count() == 30


def test_changes_to_rows_that_name_their_texts(spark, csv_tickets, raw_rows, house, tmp_path):
    tickets = tickets_of(csv_tickets, 60, 6)
    # Two more texts, of tickets of one month each.
    more = csv_tickets(
        *[{"ticket_id": f"A{k}", "ticket_body": "leaves" * 20, "created_at": "2023-05-01"} for k in range(3)],
        *[{"ticket_id": f"B{k}", "ticket_body": "stays" * 20, "created_at": "2023-07-01"} for k in range(3)],
    )
    house.load_labelled(tickets.unionByName(more), echo)
    house.build_models()
    before, reader, held = texts_version(house), house.fact, rows_of(house.fact)

    def files(month):
        return set(spark.table(texts_version(house).table).where(F.col(P.TEXT_GROUP) == F.lit(month)).inputFiles())

    july = files(datetime.date(2023, 7, 1))
    new = raw_rows(
        {"ticket_id": "T001", "ticket_body": "a new text", "created_at": "2024-03-09"},
        {"ticket_id": "N1", "ticket_body": None, "created_at": None},
    )
    gone = [f"A{k}" for k in range(3)] + ["B0", "T002"]
    expected = [r for r in house.raw.collect() if r.ticket_id not in [*gone, "T001", "N1"]] + new.collect()
    house.apply_changes(new, spark.createDataFrame([(i,) for i in gone], "ticket_id string"))
    assert sorted(map(str, expected)) == rows_of(house.raw)
    bodies = sorted((r.ticket_id, str(r.ticket_body)) for r in expected)
    assert sorted((r.ticket_id, str(r.ticket_body)) for r in house.fact.collect()) == bodies
    # The text that no row names is gone, from its month alone; readers from before still have it.
    after = texts_version(house)
    stored = {r.ticket_body[:5] for r in spark.table(after.table).collect()}
    assert after != before and "leave" not in stored and {"stays", "text "} <= stored
    assert files(datetime.date(2023, 7, 1)) == july
    assert rows_of(reader) == held
    house.apply_changes(removed=spark.createDataFrame([("T004",)], "ticket_id string"))
    assert texts_version(house) == after, "all its texts are still in use"


# -- batches of single tickets -------------------------------------------------------


def most_places(df, text):
    held = df.where("ticket_id IS NOT NULL").select(text.alias("t"), F.spark_partition_id().alias("p")).where("t <> ''")
    return held.groupBy("t").agg(F.count_distinct("p").alias("n")).agg(F.max("n")).head()[0]


def test_batches_apart_are_the_same_and_equal_texts_lie_together(spark, csv_tickets, monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 4096)
    tickets = tickets_of(csv_tickets, 150, 6).unionByName(
        csv_tickets(
            # One id many times, with unequal rows and with equal ones, across the parts' bounds; and no id.
            *[{"ticket_id": "T070", "ticket_body": f"text {k % 4}"} for k in range(60)],
            *[{"ticket_id": None}] * 5,
        )
    )
    tickets = tickets.select("ticket_id", "ticket_body").repartition(6)
    got = assign_batches_apart(tickets, "ticket_body", batch_size=5)
    want = assign_batches(tickets, batch_size=5)
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and got.count() == 210
    assert most_places(got, F.col("ticket_body")) == 1 < most_places(want, F.col("ticket_body"))
    assert got.select(F.spark_partition_id()).distinct().count() > 2


def test_prompt_lines_of_equal_texts_lie_together(spark, csv_tickets, monkeypatch):
    import __spark_entry__ as entry

    tickets = tickets_of(csv_tickets, 200, 5).repartition(6)
    monkeypatch.setattr(P, "PART_BYTES", 4096)
    monkeypatch.setattr(entry, "source_tickets", lambda *args, **options: tickets)
    lines = entry.queries()["label_prompt_lines"](spark, "")
    assert lines.columns == ["batch_id", "batch_pos", "ticket_id", "line"] and lines.count() == 200
    assert most_places(lines, F.split_part("line", F.lit("body: "), F.lit(2))) == 1
