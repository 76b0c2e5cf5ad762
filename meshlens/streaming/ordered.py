"""Ordered replay of buffer files: by name, bounded per run, up to the first file that fails.

Spark's file source takes files by their times and can't stop before a given file. Here a ledger
does what a stream's checkpoint does: ``plans/<n>`` names the files of step n before they are sent,
``sent/<n>`` says that the step is through. A step that was planned and not finished, for whatever
reason, is the next one to run, with the same number and files, so that a sink keyed by the number
(the lake is) replaces what the first attempt has left.

Files of a step are read by Spark together. If a step of several files fails, they are sent one by one,
so that all files before the failing one are delivered, and none behind it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.sinks.lake import new_writer
from meshlens.sinks.messages import DEFAULT_PREFIX
from meshlens.sources.buffer import pending_files, read_files
from meshlens.sources.files import Folder
from meshlens.streaming.replay import store_messages

#: Takes the messages of a step (topic, key, value, arrival) and the step's number; raises if delivery fails.
Deliver = Callable[[DataFrame, int], None]
FILES_PER_STEP = 100


@dataclass
class Report:
    """What a run has sent: messages by file; the file it stopped at, and why."""

    sent: dict[str, int] = field(default_factory=dict)
    failed: str | None = None
    error: str | None = None


class Ledger:
    """Plans and finished steps of one buffer, in a folder that all runs share."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)
        if not self.folder.exists("writer"):
            self.folder.write("writer", new_writer())
        self.writer = self.folder.read("writer")

    def steps(self, kind: str) -> list[int]:
        names = (name.rsplit("/", 1)[-1] for name in self.folder.names(kind))
        return sorted(int(name) for name in names if name.isdigit())

    def files(self, step: int) -> list[str]:
        return json.loads(self.folder.read(f"plans/{step}"))

    def plan(self, step: int, files: list[str]) -> None:
        self.folder.write(f"plans/{step}", json.dumps(files))

    def finish(self, step: int) -> None:
        self.folder.write(f"sent/{step}", "")

    def unfinished(self) -> tuple[int, list[str]] | None:
        """The step to run again: the last plan, if it is not through."""
        planned, sent = self.steps("plans"), self.steps("sent")
        return (planned[-1], self.files(planned[-1])) if planned and planned[-1:] != sent[-1:] else None

    def sent_files(self) -> set[str]:
        return {name for step in self.steps("sent") for name in self.files(step)}


def drain(
    spark: SparkSession,
    buffer: str,
    ledger: str,
    deliver: Deliver,
    *,
    most_files: int | None = None,
    time_limit: float | None = None,
    files_per_step: int = FILES_PER_STEP,
    archive: str | None = None,
) -> Report:
    """Send pending files in the order of their names; returns what went.

    A run ends when nothing is pending, after ``most_files`` files, at the first step that would begin
    ``time_limit`` seconds after the start, or at the first file that fails: that file and those behind
    it stay for the next run. Sent files move to ``archive``; without one the ledger alone knows them.
    """
    book, report = Ledger(spark, ledger), Report()
    began = time.monotonic()
    alone: set[str] = set()  # files of a step that failed
    while time_limit is None or time.monotonic() - began < time_limit:
        left = None if most_files is None else most_files - len(report.sent)
        if left is not None and left <= 0:
            break
        again = book.unfinished()
        if again:
            step, files = again
        else:
            gone = book.sent_files()
            waiting = [name for name in pending_files(spark, buffer) if name not in gone]
            if not waiting:
                break
            step = max([-1, *book.steps("plans")]) + 1
            files = waiting[:1] if waiting[0] in alone else waiting[: min(files_per_step, left or files_per_step)]
            book.plan(step, files)
        try:
            counts = _send(spark, buffer, files, step, deliver)
        except Exception as error:  # noqa: BLE001 - whatever a sink raises, the files stay
            if len(files) > 1:
                alone.update(files)
                book.plan(step, files[:1])
                continue
            report.failed, report.error = files[0], f"{type(error).__name__}: {error}"
            break
        book.finish(step)
        report.sent |= counts
        if archive:
            for name in files:
                Folder(spark, buffer).move(name, f"{archive}/{name}")
    return report


def _send(spark: SparkSession, buffer: str, files: list[str], step: int, deliver: Deliver) -> dict[str, int]:
    """Deliver the messages of some files; the number of messages of each."""
    messages = read_files(spark, buffer, files).persist()
    try:
        found = {r.arrival: r.n for r in messages.groupBy("arrival").agg(F.count("*").alias("n")).collect()}
        if found:
            deliver(messages, step)
        return {name: found.get(name, 0) for name in files}
    finally:
        messages.unpersist()


def drain_to_lake(
    spark: SparkSession, buffer: str, ledger: str, lake: str, prefix: str = DEFAULT_PREFIX, **bounds
) -> Report:
    """:func:`drain` into the tables of a lake."""
    writer = Ledger(spark, ledger).writer

    def deliver(messages: DataFrame, step: int) -> None:
        store_messages(messages, step, lake, prefix, writer)

    return drain(spark, buffer, ledger, deliver, **bounds)
