"""The log of a job as a stream, and batches that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "job string, line_no bigint, line string, status string"
#: What followed() gives: lines of jobs in order, and one row for each end of a job, with the number of its lines.
EVENTS = "job string, kind string, line_no bigint, line string, status string"
#: What is kept of a job: the next line's number, whether it has ended, and lines that came before their turn.
_KEPT = "next bigint, ended boolean, numbers array<bigint>, lines array<string>, statuses array<string>"
RUNNING, EXPIRED = "running", "expired"


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """An append-only log, a folder of JSON files, as a stream. The offset of what was read is the query's checkpoint."""
    return spark.readStream.schema(LOG).json(folder)


def follow(log: DataFrame, checkpoint: str, emit: Callable[[DataFrame, int], None], *, every: str | None = None) -> StreamingQuery:
    """Hands each batch of new lines to emit. Without `every` the query ends when all that is there has been read."""
    writer = log.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _follower(first: int, running: str, expire_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ended, *held = state.get if state.exists else (first, False, [], [], [])
        waiting = {n: (line, status) for n, line, status in zip(*held)}
        out: list[tuple] = []

        def emit(number: int) -> None:
            nonlocal at, ended
            line, status = waiting.pop(number)
            out.append((key[0], "line", number, line, status))
            at = number + 1
            if status != running:
                out.append((key[0], "end", len_before + sum(r[1] == "line" for r in out), None, status))
                ended = True

        len_before = at - first
        if state.hasTimedOut:  # silent for too long: what waits goes out in order, and the job is forgotten
            while waiting and not ended:
                emit(min(waiting))
            if not ended:
                out.append((key[0], "end", len_before + sum(r[1] == "line" for r in out), None, EXPIRED))
            state.remove()
            yield pd.DataFrame(out, columns=["job", "kind", "line_no", "line", "status"])
            return
        for pdf in batches:
            for number, line, status in zip(pdf["line_no"].tolist(), pdf["line"].tolist(), pdf["status"].tolist()):
                if number >= at and not ended:
                    waiting.setdefault(number, (line, status))
            while at in waiting and not ended:
                emit(at)
        if ended:
            waiting.clear()
        order = sorted(waiting)
        state.update((at, ended, order, [waiting[n][0] for n in order], [waiting[n][1] for n in order]))
        if expire_ms:
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame(out, columns=["job", "kind", "line_no", "line", "status"])

    return step


def followed(log: DataFrame, *, first: int = 0, running: str = RUNNING, expire_ms: int | None = None) -> DataFrame:
    """Each job's lines once and in order, whatever order and however often they arrive, and one row where it ends: a stream of EVENTS.

    The state of a job is its offset and the lines that came before their turn. A status other than `running` ends a job: later lines don't count. With
    expire_ms a job without news for so long gives out what waits and ends as expired; its state is forgotten, as is that of an ended job.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    rows = log.select("job", F.col("line_no").cast("bigint").alias("line_no"), "line", "status").filter("job is not null and line_no is not null")
    return rows.groupBy("job").applyInPandasWithState(_follower(first, running, expire_ms), EVENTS, _KEPT, "append", timeout)


def written_out(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Reads a stream to its end into a folder of Parquet files; run again, it goes on where it stopped."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(lines: DataFrame) -> DataFrame:
    """Lines and last status of each job."""
    return lines.groupBy("job").agg(F.count("*").alias("n_lines"), F.max_by("status", "line_no").alias("status"))


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The part of the work that has no output yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")
