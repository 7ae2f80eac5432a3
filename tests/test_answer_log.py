import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from ticketlens.operators.answer_log import AnswerLog, TaskAnswers, content_key
from ticketlens.operators.labeling import LabelRequest, label_tickets, labels_of, logged_answers

ROOT = Path(__file__).resolve().parent.parent


def reply(text, usable=True):
    return lambda: {"reply": text, "error": None if usable else "no", "usable": usable}


@pytest.fixture()
def log(spark, tmp_path):
    return AnswerLog.at(spark, str(tmp_path / "log"))


def never():
    raise AssertionError("asked again")


def test_a_later_attempt_reads_what_an_earlier_one_has_asked(log):
    first = log.of_task(3, 0)
    assert first.ask("a", reply("one"))["reply"] == "one"
    assert first.ask("a", never)["reply"] == "one"
    # The first attempt is lost without an end.
    second = log.of_task(3, 1)
    assert second.ask("a", never)["reply"] == "one"
    assert second.ask("b", reply("two"))["reply"] == "two"
    second.close()
    third = log.of_task(3, 2)
    assert [third.ask(k, never)["reply"] for k in "ab"] == ["one", "two"]


def test_two_attempts_at_once_commit_one_answer(log):
    one, two = log.of_task(0, 0), log.of_task(0, 1)
    assert one.ask("a", reply("first"))["reply"] == "first"
    assert two.ask("a", reply("second"))["reply"] == "first"
    late = log.of_task(0, 2)
    one.ask("b", reply("first"))
    one.close()
    assert late.ask("b", reply("second"))["reply"] == "first"
    two.close()
    late.close()
    entries = [json.loads(x) for f in Path(log.uri.removeprefix("file:"), "p000000").iterdir() for x in f.read_text().splitlines()]
    assert sorted((e["key"], e["reply"]) for e in entries) == [("a", "first"), ("b", "first")]


def test_the_log_of_a_run_alone_is_packed(spark, tmp_path):
    """A ticket's answer repeats the keys and label names of all others."""
    plain, own = AnswerLog.at(spark, str(tmp_path / "kept")), AnswerLog.if_reachable(spark, str(tmp_path / "own"))
    text = json.dumps([{"ticket_id": f"TKT-{n}", "primary_label": "Billing", "sentiment": "Neutral"} for n in range(20)])
    sizes = {}
    for name, log in {"kept": plain, "own": own}.items():
        task = log.of_task(0, 0)
        assert task.ask("a", reply(text))["reply"] == text
        lost = log.of_task(0, 1)
        assert lost.ask("a", never)["reply"] == text
        lost.ask("b", reply(None, usable=False))
        lost.close()
        late = log.of_task(0, 2)
        assert late.ask("a", never)["reply"] == text and late.ask("b", never)["error"] == "no"
        sizes[name] = sum(f.stat().st_size for f in (tmp_path / name / "p000000").iterdir())
    assert sizes["own"] < sizes["kept"] / 3


def test_partitions_do_not_see_each_other(log):
    log.of_task(0, 0).ask("a", reply("one"))
    assert log.of_task(1, 0).ask("a", reply("two"))["reply"] == "two"


def test_another_run_takes_usable_answers_only(log):
    task = log.of_task(0, 0)
    task.ask("good", reply("one"))
    task.ask("bad", reply(None, usable=False))
    assert log.of_task(0, 1).ask("bad", never)["error"] == "no"
    task.close()
    other = AnswerLog(log.uri, "another").of_task(0, 0)
    assert other.ask("good", never)["reply"] == "one"
    assert other.ask("bad", reply("two"))["reply"] == "two"


def test_half_written_files_are_not_read(log):
    log.of_task(0, 0)
    Path(log.uri.removeprefix("file:"), "p000000", "_half").write_text('{"key": "a", "ru')
    assert log.of_task(0, 1).ask("a", reply("one"))["reply"] == "one"


def test_what_is_asked_is_the_key():
    assert content_key("v", "prompt", [{"a": 1, "b": None}]) == content_key("v", "prompt", [{"b": None, "a": 1}])
    assert len({content_key("v", "p", []), content_key("w", "p", []), content_key("v", "q", []), content_key("v", "p", [1])}) == 4


def test_the_number_of_a_batch_is_not_logged(log):
    calls = []

    def labeler(request):
        calls.append(request.batch_id)
        return "[]"

    def run(attempt, version, *numbers):
        return list(logged_answers([LabelRequest(n, "same", []) for n in numbers], labeler, log.of_task(0, attempt), version))

    assert [r["batch_id"] for r in run(0, "v", 1, 2)] == [1, 2] and calls == [1]
    assert [r["batch_id"] for r in run(1, "w", 3)] == [3] and calls == [1, 3]


def test_fast_answers_are_committed_together_and_slow_ones_one_by_one(log):
    folder = Path(log.uri.removeprefix("file:"), "p000000")
    fast, slow = TaskAnswers(log, 0, 0, commit_seconds=60), TaskAnswers(log, 1, 0, commit_seconds=0)
    rows = logged_answers([LabelRequest(n, f"p{n}", []) for n in range(100)], lambda r: "[]", fast, "v")
    next(rows)
    # Nothing is given out before it is in the log.
    assert len(list(folder.iterdir())) == 1 and len(folder.joinpath(f"{log.run}-00000000.json").read_text().splitlines()) == 64
    rows = logged_answers([LabelRequest(n, f"p{n}", []) for n in range(3)], lambda r: "[]", slow, "v")
    next(rows)
    assert len(list((folder.parent / "p000001").iterdir())) == 1
    next(rows)
    assert len(list((folder.parent / "p000001").iterdir())) == 2


def test_attempts_that_take_turns_agree(log):
    """Two attempts commit groups of different sizes; every key ends with one answer."""
    one, two = TaskAnswers(log, 0, 1, commit_seconds=60), TaskAnswers(log, 0, 2, commit_seconds=60)
    keys = [f"k{n}" for n in range(12)]
    for n, key in enumerate(keys):
        one.put(key, reply(f"one{n}"))
        two.put(key, reply(f"two{n}"))
        if n % 3 == 2:
            one.commit()
        if n % 4 == 3:
            two.commit()
    one.close()
    two.close()
    assert [one.get(k) for k in keys] == [two.get(k) for k in keys]
    assert {one.get(k)["reply"][:3] for k in keys} == {"one", "two"}
    late = log.of_task(0, 3)
    assert [late.ask(k, never) for k in keys] == [one.get(k) for k in keys]


@pytest.mark.parametrize("stable", [False, True])
def test_a_kept_log_serves_the_next_run(csv_tickets, tmp_path, stable):
    calls = tmp_path / "calls"
    calls.mkdir()

    def labeler(request):
        (calls / f"{os.getpid()}-{len(list(calls.iterdir()))}").write_text("x")
        # Unusable, and so asked for again.
        return "no" if "T00" in request.prompt else json.dumps([{"ticket_id": t["ticket_id"]} for t in request.tickets])

    tickets = csv_tickets(*[{"ticket_id": f"T{k:02d}"} for k in range(60)]).coalesce(1)
    options = {"stable_batches": stable, "answer_log": str(tmp_path / "log"), "concurrency": None}
    first = sorted(map(str, labels_of(label_tickets(tickets, labeler, **options)).collect()))
    asked = len(list(calls.iterdir()))
    assert asked == 3
    again = sorted(map(str, labels_of(label_tickets(tickets, labeler, **options)).collect()))
    assert again == first and len(list(calls.iterdir())) == asked + 1
    label_tickets(tickets, labeler, version="2", **options)
    assert len(list(calls.iterdir())) == asked + 4


RETRY = """
import json, os, sys, uuid
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import functions as F
from ticketlens.operators.answer_log import AnswerLog
from ticketlens.operators.batching import assign_batches
from ticketlens.operators.labeling import ANSWER_SCHEMA, answers_in_order, answers_in_place
from ticketlens.schemas import CSV_COLUMNS
from ticketlens.session import build_session, stage

folder, mode = sys.argv[1:]
spark = build_session("retry", "local[2,3]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
                      spark__checkpoint__dir=folder + "/shared", spark__sql__warehouse__dir=folder + "/warehouse")
spark.sparkContext.setLogLevel("OFF")
ids = F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 4, "0"))
tickets = spark.range(0, 400, 1, 4).select(*[(ids if c == "ticket_id" else F.lit("x")).alias(c) for c in CSV_COLUMNS])

def labeler(request):
    with open(folder + "/calls/" + uuid.uuid4().hex, "w") as f:
        f.write("\\n".join(t["ticket_id"] for t in request.tickets))
    return json.dumps([{{"ticket_id": t["ticket_id"], "one_line_summary": uuid.uuid4().hex}} for t in request.tickets])

def lost_once(batches):
    rows = list(batches)
    if TaskContext.get().attemptNumber() < 2:
        os._exit(1)  # the process dies after all its calls
    yield from rows

log = AnswerLog.at(spark, folder + "/log")
if mode == "stable":
    answers = answers_in_order(assign_batches(tickets), labeler, log=log)
else:
    answers = answers_in_place(tickets, labeler, log=log)
stage(answers.mapInArrow(lost_once, ANSWER_SCHEMA), "answers").selectExpr("inline(labels)").write.json(folder + "/out")
spark.stop()
"""


@pytest.mark.parametrize("mode", ["stable", "in place"])
def test_a_task_that_is_run_again_does_not_ask_again(tmp_path, mode):
    (tmp_path / "calls").mkdir()
    job = subprocess.run(
        [sys.executable, "-c", RETRY.format(root=str(ROOT)), str(tmp_path), mode], capture_output=True, text=True, timeout=300
    )
    assert job.returncode == 0, job.stderr[-3000:]
    asked = [line for f in (tmp_path / "calls").iterdir() for line in f.read_text().splitlines()]
    assert sorted(asked) == [f"T{k:04d}" for k in range(400)]
    out = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(r["ticket_id"] for r in out) == sorted(asked)
