import csv
import datetime as dt
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from conftest import SMALL, TICKET, dicts

from ticketlens.samples.tickets import source_tickets
from ticketlens.schemas import CSV_COLUMNS, NARRATIVE_TABLE
from ticketlens.session import scratch_folder, session_conf, shared_dir, stage
from ticketlens.sources.tables import (
    Snapshot,
    append_narrative,
    append_table,
    latest_narrative,
    replace_table,
    reset_narratives,
    row_count,
)
from ticketlens.sources.ticket_csv import (
    file_headers,
    malformed,
    parse_file,
    read_ticket_csv,
    read_ticket_rows,
    well_formed,
    write_ticket_csv,
)
from ticketlens.sources.versions import write_version


def write_rows(path, *rows):
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, fieldnames=CSV_COLUMNS)
        out.writeheader()
        out.writerows([{c: {**TICKET, **r}[c] for c in CSV_COLUMNS} for r in rows])


def test_quoting_and_line_breaks(spark, tmp_path):
    bodies = ['She said "no", twice', "one, two", "line\nbreak", "line\r\nbreak", "  padded  "]
    bodies += ['back\\slash \\" x', "é😀"]
    write_rows(tmp_path / "t.csv", *[{"ticket_body": b} for b in bodies])
    assert [r["ticket_body"] for r in read_ticket_csv(spark, str(tmp_path / "t.csv")).collect()] == bodies


def test_ids_stay_text_and_null_words_become_null(spark, tmp_path):
    write_rows(
        tmp_path / "t.csv",
        {"ticket_id": "T1", "ticket_body": "NA"},
        {"ticket_id": "007", "user_id": ""},
        {"user_id": "null"},
    )
    df = read_ticket_csv(spark, str(tmp_path / "t.csv"))
    assert set(dict(df.dtypes).values()) == {"string"}
    rows = df.collect()
    assert [r["ticket_id"] for r in rows] == ["T1", "007", "TKT-00000001"]
    assert rows[0]["ticket_body"] is None and rows[1]["user_id"] is None and rows[2]["user_id"] is None


def test_large_files_can_be_shared_by_tasks(spark, tmp_path):
    write_rows(tmp_path / "t.csv", *[{"ticket_id": f"T{i}", "ticket_body": 'a "b", c'} for i in range(5000)])
    with session_conf(spark, spark__sql__files__maxPartitionBytes="100KB"):
        df = read_ticket_csv(spark, str(tmp_path / "t.csv"), multi_line=False)
        assert df.rdd.getNumPartitions() > 3
        assert df.count() == 5000 and df.where("created_at = '2024-02-29'").count() == 5000
        assert df.where(r"""ticket_body = 'a "b", c'""").count() == 5000


def test_columns_go_by_name_in_each_file(spark, tmp_path):
    other = ["user_id", "extra", *[c for c in CSV_COLUMNS if c not in ("user_id", "channel")]]
    write_rows(tmp_path / "a b.csv", {"ticket_id": "T1", "user_id": "U1"})
    (tmp_path / "b.csv").write_text(",".join(other) + "\nU2,x," + ",".join(f"v{i}" if c != "ticket_id" else "T2" for i, c in enumerate(other[2:])) + "\n")
    (tmp_path / "empty.csv").write_text("")
    rows = {r["ticket_id"]: r for r in read_ticket_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"T1", "T2"}
    assert (rows["T1"]["user_id"], rows["T2"]["user_id"], rows["T2"]["channel"]) == ("U1", "U2", None)
    assert rows["T2"]["created_at"] == f"v{len(other) - 3}"
    assert [f for files in file_headers(spark, str(tmp_path)).values() for f in files]


def test_short_rows_are_padded_and_long_ones_kept_apart(spark, tmp_path):
    head = ",".join(CSV_COLUMNS)
    (tmp_path / "t.csv").write_text(f'{head}\r\nT1,U1\r\nT2,"U,2",{",".join("x" * 10)}\r\nT3,U3,{",".join("y" * 12)}\r\n')
    rows = read_ticket_rows(spark, str(tmp_path / "t.csv"), True)
    good = {r["ticket_id"]: r for r in well_formed(rows).collect()}
    assert set(good) == {"T1", "T2"} and good["T1"]["created_at"] is None
    assert (good["T2"]["user_id"], good["T2"]["created_at"]) == ("U,2", "x")
    (bad,) = malformed(rows).collect()
    assert (bad["ticket_id"], bad["surplus_field"]) == ("T3", "y") and bad["source_file"].endswith("t.csv")
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="none.csv"):
        read_ticket_csv(spark, str(tmp_path))


def test_whole_files_parse_as_tasks_do(spark, tmp_path):
    write_rows(tmp_path / "t.csv", {"ticket_body": 'a "b"\nc'}, {"ticket_id": "NA"}, {"created_at": "x"})
    with open(tmp_path / "t.csv", "a") as f:
        f.write("short,row\r\n" + ",".join("z" * 14) + "\r\n")
    rows = list(parse_file((tmp_path / "t.csv").read_bytes()))
    want = read_ticket_rows(spark, str(tmp_path / "t.csv"), True).drop("source_file")
    assert sorted(map(str, rows)) == sorted(str({c: r[c] for c in want.columns}) for r in want.collect())


def test_round_trip_of_whole_documents_in_small_files(spark, tmp_path):
    tickets = source_tickets(spark, SMALL).select(*CSV_COLUMNS)
    write_ticket_csv(tickets, str(tmp_path / "out"), max_rows_per_file=100)
    assert len(list((tmp_path / "out").glob("*.csv"))) >= 15
    back = read_ticket_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, tickets.collect()))


def test_replace_table(spark, tmp_path):
    replace_table(spark.range(3), "some_table", str(tmp_path))
    replace_table(spark.range(5).selectExpr("id AS other"), "some_table", str(tmp_path))
    assert row_count(spark, "some_table") == 5 and spark.table("some_table").columns == ["other"]
    assert (tmp_path / "some_table").is_dir()


def test_narratives(spark, tmp_path):
    spark.sql(f"DROP TABLE IF EXISTS {NARRATIVE_TABLE}")
    assert latest_narrative(spark).collect() == []
    reset_narratives(spark, location=str(tmp_path))
    assert latest_narrative(spark).collect() == []
    append_narrative(spark, "it's new")
    assert dicts(latest_narrative(spark)) == [{"narrative": "it's new"}]
    old = [(dt.datetime(2020, 1, 1), "old"), (dt.datetime(2021, 1, 1), "older")]
    spark.createDataFrame(old, spark.table(NARRATIVE_TABLE).schema).write.mode("append").saveAsTable(NARRATIVE_TABLE)
    assert dicts(latest_narrative(spark)) == [{"narrative": "it's new"}]
    assert spark.table(NARRATIVE_TABLE).columns == ["generated_at", "narrative"]
    reset_narratives(spark, location=str(tmp_path))
    assert row_count(spark, NARRATIVE_TABLE) == 0


def test_snapshot_refreshes_after_its_time(spark):
    now = [0.0]
    replace_table(spark.range(2), "snapshot_source")
    snapshot = Snapshot(spark, "snapshot_source", ttl=60, clock=lambda: now[0])
    assert snapshot.get().count() == 2
    replace_table(spark.range(7), "snapshot_source")
    now[0] = 59.0
    assert snapshot.get() is snapshot.get()
    now[0] = 60.0
    assert snapshot.get().count() == 7
    snapshot.drop()


def test_a_cluster_must_name_a_shared_folder():
    def session(**conf):
        settings = {"spark.app.id": "app", "spark.master": "yarn", **conf}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session())
    assert shared_dir(session(**{"spark.checkpoint.dir": "hdfs:///tmp/"})) == "hdfs:///tmp/ticketlens/app"
    for local in ("/tmp", "file:/tmp/", "file:///var/tmp"):
        with pytest.raises(ValueError, match="shared"):
            shared_dir(session(**{"spark.checkpoint.dir": local}))
    with pytest.raises(ValueError):
        shared_dir(session(**{"spark.master": "local-cluster[2,1,1024]"}))
    assert shared_dir(session(**{"spark.master": "local[2]"})).startswith("/")


def test_stage_uses_the_session_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(root)
    assert stage(spark.range(3), "x").inputFiles()[0].startswith(f"file://{root}")


def test_scratch_folder_goes_with_its_files(spark):
    with scratch_folder(spark, "gone") as folder:
        path = Path(stage(spark.range(3), "x", folder).inputFiles()[0].removeprefix("file://"))
        assert path.exists() and path.is_relative_to(folder)
    assert not Path(folder).exists() and Path(shared_dir(spark)).exists()
    with scratch_folder(spark, "never-used"):
        pass


def test_session_conf_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(KeyError):
        with session_conf(spark, spark__sql__execution__arrow__maxBytesPerBatch="1000"):
            assert spark.conf.get(key) == "1000"
            raise KeyError
    assert spark.conf.get(key) == before


def test_headers_by_bytes_and_by_scan_agree(spark, tmp_path):
    from ticketlens.sources import ticket_csv as C

    write_rows(tmp_path / "a b+c.csv", {"ticket_id": "T1"}, {"ticket_id": "T2", "ticket_body": "two\nlines"})
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf\r\nuser_id,ticket_id\r\nU,T\r\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    found = C.file_headers(spark, str(tmp_path))
    assert sorted(len(files) for files in found.values()) == [1, 1] and ("user_id", "ticket_id") in found
    scanned = {r["path"].rsplit("/", 1)[1]: C._names(r["head"]) for r in C._heads_by_scan(spark, str(tmp_path)).collect()}
    assert scanned == {f.rsplit("/", 1)[1]: list(names) for names, files in found.items() for f in files}


# -- what writes leave behind --------------------------------------------------------


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for folder in disk.localDirsString() for f in Path(folder).rglob("shuffle_*")}


def test_a_write_leaves_no_shuffle_files(spark, csv_tickets, tmp_path):
    tickets = csv_tickets(*[{"ticket_id": f"T{k}"} for k in range(40)]).repartition(7, "ticket_id")
    empty = tickets.limit(0).select("ticket_id")
    writes = {
        "stage": lambda: stage(tickets, "rows", str(tmp_path)),
        "replace": lambda: replace_table(tickets, "shuffled_rows", str(tmp_path)),
        "append": lambda: append_table(tickets.select("ticket_id"), "shuffled_ids"),
        "version": lambda: write_version(tickets, "shuffled_version", str(tmp_path)),
        "csv": lambda: write_ticket_csv(tickets, str(tmp_path / "csv")),
    }
    replace_table(empty, "shuffled_ids", str(tmp_path))
    kept = tickets.groupBy("status").count()
    assert kept.collect()[0]["count"] == 40
    for name, write in writes.items():
        before = shuffle_files(spark)
        write()
        for _ in range(50):
            if shuffle_files(spark) <= before:
                break
            time.sleep(0.2)
        assert shuffle_files(spark) <= before, name
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    # Rows that were written from the same frame are there, and the frame still gives them.
    assert spark.table("shuffled_rows").count() == spark.table("shuffled_ids").count() == tickets.count() == 40
    assert kept.collect()[0]["count"] == 40
