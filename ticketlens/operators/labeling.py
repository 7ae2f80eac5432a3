"""The labelling job: batches of tickets go to a labeller, labels come back.

A labeller is any callable that takes a ``LabelRequest`` and returns the reply
text, which should be a JSON array with one object per ticket. Spark spreads the
batches over its tasks; the code in this module that runs per batch only calls
the labeller and reads its reply.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.operators.answer_log import MOST_WAITING, AnswerLog, TaskAnswers, content_key
from ticketlens.operators.batching import BATCH_SIZE, assign_batches
from ticketlens.schemas import (
    FALLBACK_SUMMARY,
    FALLBACK_URGENCY,
    LABEL_COLUMNS,
    LABEL_FIELDS,
    REPLACED_COLUMNS,
    SENTIMENTS,
)
from ticketlens.session import scratch_folder, session_conf, stage
from ticketlens.taxonomy import PAIRS_BY_PRIMARY

# Ship this module's functions to the workers by value, so that executors need
# only pyspark and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Prompts hold whole ticket texts; bound an Arrow batch by bytes, not by rows.
ARROW_BATCH_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class LabelRequest:
    """One batch: its prompt, and its tickets as dicts (labels and context, no body)."""

    batch_id: int
    prompt: str
    tickets: list[dict] = field(default_factory=list)


Labeler = Callable[[LabelRequest], str]

ANSWER_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("tickets", T.LongType()),
        T.StructField("is_fallback", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("labels", T.ArrayType(LABEL_FIELDS)),
    ]
)


# -- prompts -------------------------------------------------------------------------


def prompt_head() -> str:
    return (
        "Check and complete the labels of customer support tickets.\n\n"
        "Allowed secondary labels under each primary label:\n"
        f"{json.dumps(PAIRS_BY_PRIMARY, indent=2)}\n\n"
        f"Allowed sentiments: {', '.join(SENTIMENTS)}\n\n"
        "Answer with one JSON array and nothing else. It holds one object per ticket, with\n"
        "the keys ticket_id, primary_label, secondary_label, sentiment, urgency (1 low, 2 medium,\n"
        "3 high) and one_line_summary (ten words at most).\n\n"
        "Tickets:\n"
    )


def prompt_line() -> Column:
    # Fixed value: the format of a ticket's line.
    return F.concat(
        F.lit("- ticket_id: "),
        F.coalesce(F.col("ticket_id"), F.lit("")),
        F.lit(" | body: "),
        F.coalesce(F.col("ticket_body"), F.lit("")),
    )


def prompt_lines(batched: DataFrame) -> DataFrame:
    return batched.select("batch_id", "batch_pos", "ticket_id", prompt_line().alias("line"))


def _request_rows(batched: DataFrame, context: Iterable[str]) -> DataFrame:
    return batched.select("batch_id", "ticket_id", *REPLACED_COLUMNS, *context, prompt_line().alias("line"))


def whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Batches of rows that follow each other: the batch's number and its rows."""
    number, waiting = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = row.pop("batch_id")
            if waiting and own != number:
                yield number, waiting
                waiting = []
            number = own
            waiting.append(row)
    if waiting:
        yield number, waiting


def render_prompts(batched: DataFrame, context: Iterable[str] = ()) -> DataFrame:
    """One row per batch: ``(batch_id, prompt, tickets)``.

    Batches come from ``assign_batches``, which leaves the rows of each together in order,
    so they are not shuffled again. A task holds one batch and one Arrow batch at a time.
    """
    rows, head = _request_rows(batched, context), prompt_head()
    ticket = T.StructType([f for f in rows.schema.fields if f.name not in ("batch_id", "line")])
    schema = T.StructType(
        [
            T.StructField("batch_id", T.LongType()),
            T.StructField("prompt", T.StringType()),
            T.StructField("tickets", T.ArrayType(ticket)),
        ]
    )
    arrow = to_arrow_schema(schema)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, found in whole_batches(batches):
            prompt = head + "\n".join(row.pop("line") for row in found)
            yield pa.RecordBatch.from_pylist([{"batch_id": number, "prompt": prompt, "tickets": found}], schema=arrow)

    return rows.mapInArrow(render, schema)


# -- replies -------------------------------------------------------------------------


def parse_reply(reply: str) -> list[dict]:
    """The label rows of a reply; ValueError unless it is a JSON array of objects.

    Code fences are removed wherever they are, unknown keys are dropped, missing
    ones give nulls. Values are kept as text and not checked: labels are judged by
    the quality checks, urgency by the cast in staging.
    """
    text = reply.strip().replace("```json", "").replace("```", "").strip()
    parsed = json.loads(text)
    if not isinstance(parsed, list) or not all(isinstance(item, dict) for item in parsed):
        raise ValueError("reply is not a JSON array of objects")

    def text_of(value):
        text = value if value is None or isinstance(value, str) else json.dumps(value)
        if text is not None:
            text.encode()  # half a surrogate pair cannot be stored: a ValueError too
        return text

    return [{name: text_of(item.get(name)) for name in ["ticket_id", *LABEL_COLUMNS]} for item in parsed]


def fallback_labels(tickets: list[dict]) -> list[dict]:
    """The tickets' own labels, for a batch without a usable reply."""
    return [
        {
            "ticket_id": t["ticket_id"],
            **{c: t[c] for c in REPLACED_COLUMNS},
            "urgency": FALLBACK_URGENCY,
            "one_line_summary": FALLBACK_SUMMARY,
        }
        for t in tickets
    ]


def _outcome(labeler: Labeler, request: LabelRequest) -> dict:
    """What a call came to: its reply, or why there is no usable one."""
    try:
        reply = labeler(request)
        parse_reply(reply)
        return {"reply": reply, "error": None, "usable": True}
    except Exception as problem:
        reason = f"{type(problem).__name__}: {problem}".encode(errors="replace").decode()
        return {"reply": None, "error": reason, "usable": False}


def _answer_row(request: LabelRequest, outcome: dict) -> dict:
    failed = outcome["error"] is not None
    return {
        "batch_id": request.batch_id,
        "tickets": len(request.tickets),
        "is_fallback": failed,
        "error": outcome["error"],
        "labels": fallback_labels(request.tickets) if failed else parse_reply(outcome["reply"]),
    }


def answer(labeler: Labeler, request: LabelRequest) -> dict:
    """One answer row. A failing call or reply concerns its own batch only."""
    return _answer_row(request, _outcome(labeler, request))


def logged_answers(
    requests: Iterable[LabelRequest], labeler: Labeler, known: TaskAnswers, version: str
) -> Iterator[dict]:
    """Answer rows of which each is in the log before it is given out.

    Calls are left out whose outcome the log has, from the same ``version`` of a labeller.
    """
    waiting: list[tuple[LabelRequest, str]] = []

    def settled() -> Iterator[dict]:
        known.commit()
        for request, key in waiting:
            yield _answer_row(request, known.get(key))
        waiting.clear()

    for request in requests:
        key = content_key(version, request.prompt, request.tickets)
        known.put(key, lambda: _outcome(labeler, request))
        waiting.append((request, key))
        if known.is_due() or len(waiting) >= MOST_WAITING:
            yield from settled()
    yield from settled()
    known.close()


# -- the job -------------------------------------------------------------------------


def _numbered_in_place(size: int):
    """Cut the rows of a task into batches as they come; numbers tell tasks apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
        number, waiting = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            waiting += batch.to_pylist()
            while len(waiting) >= size:
                yield number, waiting[:size]
                number += 1
                del waiting[:size]
        if waiting:
            yield number, waiting

    return cut


def _answered(rows: DataFrame, cut: Callable, labeler: Labeler, log: AnswerLog | None, version: str) -> DataFrame:
    """Answers to the batches that ``cut`` makes of each task's rows."""
    schema, head = to_arrow_schema(ANSWER_SCHEMA), prompt_head()

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[LabelRequest]:
        for number, found in cut(batches):
            prompt = head + "\n".join(row.pop("line") for row in found)
            yield LabelRequest(number, prompt, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = requests(batches)
        if log:
            task = TaskContext.get()
            known = log.of_task(task.partitionId(), task.taskAttemptId())
            answers = logged_answers(asked, labeler, known, version)
        else:
            answers = (answer(labeler, request) for request in asked)
        for row in answers:
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return rows.mapInArrow(run, ANSWER_SCHEMA)


def version_of(labeler: Labeler) -> str:
    """The name under which a labeller's answers are logged."""
    return f"{getattr(labeler, '__module__', '')}:{getattr(labeler, '__qualname__', type(labeler).__qualname__)}"


def answers_in_order(
    batched: DataFrame, labeler: Labeler, context: Iterable[str] = (), log: AnswerLog | None = None, version: str = ""
) -> DataFrame:
    """Answers for batches that ``assign_batches`` has made; lazy, see ``label_tickets``."""
    return _answered(_request_rows(batched, context), whole_batches, labeler, log, version)


def answers_in_place(
    tickets: DataFrame,
    labeler: Labeler,
    context: Iterable[str] = (),
    batch_size: int = BATCH_SIZE,
    log: AnswerLog | None = None,
    version: str = "",
) -> DataFrame:
    """Answers for tickets batched inside their own partitions; lazy, see ``label_tickets``."""
    rows = tickets.where(F.col("ticket_id").isNotNull()).select(
        "ticket_id", *REPLACED_COLUMNS, *context, prompt_line().alias("line")
    )
    return _answered(rows, _numbered_in_place(batch_size), labeler, log, version)


def label_tickets(
    tickets: DataFrame,
    labeler: Labeler,
    context: Iterable[str] = (),
    batch_size: int = BATCH_SIZE,
    stable_batches: bool = False,
    concurrency: int | None = None,
    observation: Observation | None = None,
    folder: str | None = None,
    answer_log: str | None = None,
    version: str | None = None,
) -> DataFrame:
    """Label all tickets that have an id and return the stored answers.

    Ticket texts are not shuffled: each task batches the rows it reads. With
    ``stable_batches`` the batches follow the ticket ids instead and are the same
    for any partitioning, for the price of one exchange that sorts the texts.

    Answers are logged before a task gives them out, so a task that Spark runs again, or
    twice at once, reuses what it has; at most half a second of calls is not yet in the log
    when a task dies, or one call if it takes longer. The log goes when the answers are stored;
    with ``answer_log`` it is kept in that folder, and a later run over the same partitions
    uses its answers from the same ``version`` of the labeller (its name if not given).
    Where Python can't open the shared folder's file system, only a given ``answer_log`` is
    an error; otherwise there is no log.

    The answers are written before they are returned, so no later plan can call
    the labeller again. ``observation`` receives ``batches``, ``failed_batches``,
    ``tickets`` and ``labels`` without another scan. ``context`` names further
    ticket columns the labeller may look at. ``concurrency`` sets the number of
    partitions, and so of parallel labeller calls. ``folder`` takes the answers, if the
    caller removes it when they are read.
    """
    spark, context = tickets.sparkSession, list(context)
    version = version_of(labeler) if version is None else version
    with (
        session_conf(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(ARROW_BATCH_BYTES)),
        scratch_folder(spark, "batches") as scratch,
    ):
        log = AnswerLog.at(spark, answer_log) if answer_log else AnswerLog.if_reachable(spark, f"{scratch}/answers")
        if stable_batches:
            asked = list(dict.fromkeys(["ticket_id", *REPLACED_COLUMNS, *context, "ticket_body"]))
            batched = assign_batches(tickets, batch_size, folder=scratch, parts=concurrency, columns=asked)
            answers = answers_in_order(batched, labeler, context, log, version)
        else:
            source = tickets.repartition(concurrency) if concurrency else tickets
            answers = answers_in_place(source, labeler, context, batch_size, log, version)
        if observation is not None:
            answers = answers.observe(
                observation,
                F.count(F.lit(1)).alias("batches"),
                F.count_if("is_fallback").alias("failed_batches"),
                F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets"),
                F.coalesce(F.sum(F.size("labels")), F.lit(0)).alias("labels"),
            )
        return stage(answers, "answers", folder)


def labels_of(answers: DataFrame) -> DataFrame:
    """Answers flattened to one row per label; ``label_pos`` is its place in the reply."""
    exploded = answers.select("batch_id", "is_fallback", F.posexplode("labels").alias("label_pos", "label"))
    return exploded.select("batch_id", "label_pos", "label.*", "is_fallback")


def _answered_ids(labels: DataFrame) -> DataFrame:
    """The ids of labels, each at most eight times, for semi and anti joins.

    Reduced by id and a salt of the row, so that labels piled up on one id cost
    little. Not by id alone: that would leave the result partitioned for the join,
    and adaptive skew handling only splits joins whose sides are both freshly shuffled.
    """
    salt = F.pmod(F.xxhash64(*LABEL_COLUMNS), F.lit(8)).alias("_salt")
    return labels.select("ticket_id", salt).distinct().select("ticket_id")


def unlabelled(tickets: DataFrame, labels: DataFrame, retry_fallbacks: bool = True) -> DataFrame:
    """Tickets that still need a label, for a rerun that adds to earlier answers."""
    done = labels.where(~F.col("is_fallback")) if retry_fallbacks else labels
    # Tickets without an id cannot be labelled, and would all meet in one partition.
    return tickets.where(F.col("ticket_id").isNotNull()).join(_answered_ids(done), "ticket_id", "left_anti")


#: Labels of one id that meet in one part of the join, about.
LABELS_PER_PART = 10_000


def attach_labels(tickets: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """Replace the tickets' labels by the returned ones, where there are any.

    The result is that of a left join: a ticket without an answer gets null labels,
    one answered twice becomes two rows, answers for unknown ids disappear. Tickets without
    an id match nothing.

    It is one left join, so tickets are evaluated once. A ticket without an id gets a key
    of its own that no label has, so these spread over all partitions. Adaptive skew
    handling splits the tickets of a hot id, but can't split the right side of a left join:
    where labels pile up on an id (which a labeller may have made up), they are dealt to
    parts, and the few tickets of the id are repeated for each. The deal goes by a hash of the
    stored label with its batch and place, so a task that runs again deals as before.

    Ids with piled up labels are looked for first and stored (in ``folder``, if given), so that
    both sides are shuffled by the join alone, or not at all where there are none.
    """
    kept = [c for c in tickets.columns if c not in REPLACED_COLUMNS + LABEL_COLUMNS]
    keyed = labels.where(F.col("ticket_id").isNotNull())
    many = keyed.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LABELS_PER_PART)
    many = many.select(F.col("ticket_id").alias("_many"), F.ceil(F.col("_n") / LABELS_PER_PART).alias("_parts"))
    many = stage(many, "many", folder)
    # One row per ``LABELS_PER_PART`` labels, at most; a plan that knows of none leaves the joins out.
    many = many.limit(0) if many.isEmpty() else F.broadcast(many)
    no_id = F.concat(F.lit("none:"), F.xxhash64(*kept).cast("string"))
    key = F.when(F.col("ticket_id").isNull(), no_id).otherwise(F.concat(F.lit("id:"), "ticket_id"))

    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = tickets.select(*kept).join(many, F.col("ticket_id") == F.col("_many"), "left")
    left = left.select(*kept, "_many", key.alias("_key"), F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("_part"))
    right = keyed.join(many, F.col("ticket_id") == F.col("_many"), "left").select(
        F.concat(F.lit("id:"), "ticket_id").alias("_key"),
        F.pmod(F.xxhash64(*labels.columns), parts).cast("int").alias("_part"),
        F.lit(True).alias("_answered"),
        *LABEL_COLUMNS,
    )
    joined = left.join(right, ["_key", "_part"], "left")
    # A repeated ticket has answers; a part that happens to hold none of them adds nothing.
    return joined.where(F.col("_many").isNull() | F.col("_answered")).select(*kept, *LABEL_COLUMNS)
