"""Structured Streaming jobs: trusted runs of a log stream, and upkeep of the fingerprint cache."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sylva.sources.cache import BUCKETS, append_cache
from sylva.sources.inventory import load_digest_cache, merge_digest_cache, save_digest_cache

_STATE = "files long, conflicts long, events long, last_count long, last_step long, broken string, done boolean"
_START = (0, 0, 0, -1, -1, "", False)
_RESULT = "run_id string, verdict string, files long, conflicts long, calls long"
_FIELDS = ["seq", "kind", "class", "ok", "total", "counted", "conflicts", "p4Calls", "count", "step"]


def _checked(state: tuple, row: tuple) -> tuple[tuple, str | None]:
    """(state, verdict) of a run after one more of its rows (_FIELDS); the verdict comes with the summary."""
    files, conflicts, events, last_count, last_step, broken, done = state
    _, kind, class_, ok, total, counted, said, calls, count, at = row
    verdict = None
    if kind == "file" and class_ != "handoff":
        files += 1
    elif kind == "conflict":
        conflicts += 1
    elif kind == "p4CommandCount":
        events += 1
        if pd.isna(count) or int(count) <= last_count or (last_count < 0 and int(count) != 0):
            broken = broken or "order"
        last_count = last_count if pd.isna(count) else int(count)
    elif kind == "progress":
        broken = broken or ("order" if not pd.isna(at) and int(at) < last_step else "")
        last_step = last_step if pd.isna(at) else int(at)
    elif kind == "summary":
        number = lambda x: 0 if pd.isna(x) else int(x)
        if pd.isna(ok) or not bool(ok):
            verdict = "failed"
        elif number(counted) != number(total) or files != number(total):
            verdict = "counts"
        elif conflicts != number(said):
            verdict = "conflicts"
        elif not broken and events and last_count != number(calls):
            verdict = "calls"
        else:
            verdict = broken or "trusted"
        done = True
    return (files, conflicts, events, last_count, last_step, broken, done), verdict


def _counted_total() -> Column:
    return F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, b: a + b)


def trusted_runs(log: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """One row for each run as soon as its summary came, or as ``incomplete`` when nothing came for ``timeout``. The state
    of a run is seven numbers, whatever its length. Rows of a run must arrive in order of seq, as a log is written."""
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else _START
        row = lambda verdict: pd.DataFrame([(key[0], verdict, *now[:3])], columns=["run_id", "verdict", "files", "conflicts", "calls"])
        if state.hasTimedOut:
            state.remove()
            if not now[-1]:
                yield row("incomplete")
            return
        for r in sorted((r for b in batches for r in b[_FIELDS].itertuples(index=False, name=None)), key=lambda r: r[0]):
            if not now[-1]:
                now, verdict = _checked(now, r)
                if verdict:
                    yield row(verdict)
        state.update(now)
        state.setTimeoutDuration(ms)

    rows = log.select("run_id", "seq", "kind", "class", "ok", "total", _counted_total().alias("counted"), "conflicts", "p4Calls", "count", "step")
    return rows.groupBy("run_id").applyInPandasWithState(step, _RESULT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


#: The fields where a word of Python can't be a name.
_HELD = [f if f != "class" else "class_name" for f in _FIELDS]
#: Rows that are released together.
RELEASED = 10_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Release(StatefulProcessor):
    """Holds the rows of a run, as JSON, until its summary came: then they go on, or are dropped if it doesn't agree with
    them. A run that is silent for too long is dropped; what comes after its end is, too."""

    def __init__(self, ms: int):
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.check, self.held = handle.getValueState("check", _STATE), handle.getListState("held", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.check.get()) if self.check.exists() else _START
        ordered = sorted((r for b in rows for r in b[[*_HELD, "value"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        new: list[tuple[str]] = []
        verdict = None
        for r in ordered:
            if not now[-1]:
                now, verdict = _checked(now, r[:-1])
                new.append((r[-1],))
        self.check.update(now)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ms)
        if verdict == "trusted":
            out: list[str] = []
            for (value,) in chain(self.held.get() if self.held.exists() else (), new):
                out.append(value)
                if len(out) == RELEASED:
                    yield pd.DataFrame({"value": out})
                    out = []
            yield pd.DataFrame({"value": out})
        if now[-1]:
            self.held.clear()
        elif new:
            self.held.appendList(new)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.check.clear()
        return iter(())

    def close(self) -> None:
        pass


def released_rows(log: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """The rows of trusted runs of a log stream, all of a run at once when its summary came; other rows never come out. The
    rows wait in the state store (RocksDB, which this sets for the session), so a run may be longer than memory, and a
    restart from the checkpoint goes on where it was. Rows of a run must arrive in order of seq."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    held = log.select("run_id", "seq", "kind", F.col("class").alias("class_name"), "ok", "total", _counted_total().alias("counted"), "conflicts", "p4Calls", "count", "step", F.to_json(F.struct(*log.columns)).alias("value"))
    out = held.groupBy("run_id").transformWithStateInPandas(_Release(ms), "value string", "append", "processingTime")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return out.select(F.from_json("value", schema).alias("r")).select("r.*")


def maintain_digest_cache(fingerprints: DataFrame, path: str, checkpoint: str, interval: str = "60 seconds"):
    """Writer that merges each micro-batch of (path_key, size, mtime, digest) into the cache at ``path`` and publishes a new
    version. Bound a batch with maxFilesPerTrigger on the source. Merging a batch again changes nothing, so a batch that is
    replayed after a crash is merged into the newest complete version under a name of its own; a half-written version is
    never read."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        current, _ = load_digest_cache(batch.sparkSession, path)
        if not batch.isEmpty():
            save_digest_cache(merge_digest_cache(current, batch), path, f"v{batch_id:010d}-{uuid.uuid4().hex[:12]}")

    return fingerprints.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def maintain_cache(fingerprints: DataFrame, path: str, checkpoint: str, interval: str = "60 seconds", buckets: int = BUCKETS):
    """Writer that publishes each micro-batch of (path_key, size, mtime, digest) as an increment of the cache at ``path``
    (``sources.cache``); bytes written follow the batch. A batch is published once, also if it is replayed after a crash, as
    its name is that of the query and its number. Bound a batch with maxFilesPerTrigger on the source."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        append_cache(batch, path, f"{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-{batch_id}", buckets)

    return fingerprints.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=interval)
