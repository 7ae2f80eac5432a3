"""Answers that outlive the task that asked for them.

Spark may run a task again, or twice at once, and a labeller's calls are slow and paid for.
Answers are therefore committed to a log in a shared folder, under a hash of what was asked,
before the task gives them out. A later attempt of the task reads the log first and asks only
for what is missing.

The log of a task is a sequence of files. An attempt adds the next one, which only one attempt
can: whoever finds it there reads it, keeps the answers in it in place of its own, and tries
the next. So of two attempts that ask for the same, the first answer committed is the one that
both use.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession

from ticketlens.session import open_uri

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def content_key(*parts) -> str:
    """A hash of what is asked, whatever the number of its batch."""
    return sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class AnswerLog:
    """A folder of answers, by partition of the job. ``run`` tells the runs that share it apart.

    A run reuses whatever it has logged itself, failures too, so that its attempts agree, and
    the usable answers of earlier runs. Files are lines of JSON, or ``packed``: compressed, for a log
    that only the run itself reads.
    """

    uri: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    packed: bool = False

    @classmethod
    def at(cls, spark: SparkSession, path: str, packed: bool = False) -> AnswerLog:
        """The log in a folder that driver and executors reach, by Hadoop's name for it."""
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        log = cls(system.makeQualified(target).toString(), packed=packed)
        open_uri(log.uri)
        return log

    @classmethod
    def if_reachable(cls, spark: SparkSession, path: str) -> AnswerLog | None:
        """A packed log, or none where Python has no way to the folder's file system."""
        try:
            return cls.at(spark, path, packed=True)
        except (pa.ArrowException, OSError, ValueError):
            return None

    def of_task(self, partition: int, attempt: int) -> TaskAnswers:
        return TaskAnswers(self, partition, attempt)


#: Answers are committed together if a task gets many within this time; slow ones one by one.
COMMIT_SECONDS = 0.5
#: Batches that wait for their commit, at most.
MOST_WAITING = 64


class TaskAnswers:
    """The log as one attempt of a task sees it.

    When an attempt has ended, its files are put into one. Files appear whole or not at all:
    they are written under a name that nobody reads and then renamed.
    """

    def __init__(self, log: AnswerLog, partition: int, attempt: int, commit_seconds: float = COMMIT_SECONDS):
        self._fs, root = open_uri(log.uri)
        self._is_local = isinstance(self._fs, fs.LocalFileSystem)
        self._run, self._attempt, self._seconds = log.run, attempt, commit_seconds
        self._packed = log.packed
        self._folder = f"{root}/p{partition:06d}"
        self._fs.create_dir(self._folder, recursive=True)
        self._whole = f"{self._folder}/{log.run}.jsonl"
        self._known: dict[str, dict] = {}
        self._pending: dict[str, dict] = {}
        self._next, self._committed_at = 0, time.monotonic()
        for info in self._fs.get_file_info(fs.FileSelector(self._folder)):
            if info.base_name.endswith(".jsonl"):
                self._learn(self._read(info.path))
        self._catch_up()

    # -- files -------------------------------------------------------------------------

    def _path(self, number: int) -> str:
        return f"{self._folder}/{self._run}-{number:08d}.json"

    def _exists(self, path: str) -> bool:
        if self._is_local:
            return os.path.exists(path)
        return self._fs.get_file_info(path).type != fs.FileType.NotFound

    def _read(self, path: str) -> list[dict]:
        with self._fs.open_input_stream(path) as stream:
            data = stream.read()
        return [json.loads(line) for line in (zlib.decompress(data) if self._packed else data).splitlines()]

    def _write(self, path: str, entries: list[dict]) -> bool:
        """Write a file unless it is there; whether it was not."""
        hidden = f"{self._folder}/_{uuid.uuid4().hex}-{self._attempt}"
        data = "\n".join(map(json.dumps, entries)).encode()
        if self._packed:
            data = zlib.compress(data)
        if self._is_local:
            with open(hidden, "xb") as stream:
                stream.write(data)
            try:
                os.link(hidden, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(hidden)
            return True
        with self._fs.open_output_stream(hidden) as stream:
            stream.write(data)
        try:
            if not self._exists(path):
                self._fs.move(hidden, path)
                return True
        except OSError:
            # Some systems refuse to rename onto a file that has just appeared.
            if not self._exists(path):
                raise
        self._fs.delete_file(hidden)
        return False

    def _learn(self, entries: list[dict]) -> None:
        for entry in entries:
            if entry["run"] == self._run or (entry["usable"] and entry["key"] not in self._known):
                self._known[entry["key"]] = entry

    def _catch_up(self) -> None:
        """Read what other attempts have added, and the one file of an attempt that has ended."""
        while self._exists(path := self._path(self._next)):
            try:
                self._learn(self._read(path))
            except FileNotFoundError:
                break
            self._next += 1
        if self._exists(self._whole):
            self._learn(self._read(self._whole))

    # -- answers -----------------------------------------------------------------------

    def put(self, key: str, call: Callable[[], dict]) -> None:
        """Have an answer: that of the log, or of ``call``, which waits for the next commit.

        Answers have ``reply`` or ``error``, and say whether they are ``usable``.
        """
        if key not in self._known and key not in self._pending:
            self._pending[key] = {**call(), "key": key, "run": self._run}

    def is_due(self) -> bool:
        """Whether to commit now, so that what waits can be given out."""
        return not self._pending or time.monotonic() - self._committed_at >= self._seconds

    def commit(self) -> None:
        """Add the answers that wait to the log, unless it has other ones for their keys by now."""
        while self._pending:
            if self._write(self._path(self._next), list(self._pending.values())):
                self._learn(list(self._pending.values()))
                self._next += 1
                self._pending = {}
                # The number may have been free because an attempt has ended and tidied up.
                if self._exists(self._whole):
                    self._learn(self._read(self._whole))
            else:
                self._catch_up()
                self._pending = {k: v for k, v in self._pending.items() if k not in self._known}
        self._committed_at = time.monotonic()

    def get(self, key: str) -> dict:
        """The committed answer."""
        return self._known[key]

    def ask(self, key: str, call: Callable[[], dict]) -> dict:
        """One answer, committed at once."""
        self.put(key, call)
        self.commit()
        return self.get(key)

    def close(self) -> None:
        """Put the run's answers of this task into one file; the first attempt to end does."""
        self.commit()
        own = [entry for entry in self._known.values() if entry["run"] == self._run]
        if own:
            self._write(self._whole, own)
        for number in range(self._next):
            try:
                self._fs.delete_file(self._path(number))
            except FileNotFoundError:
                pass
