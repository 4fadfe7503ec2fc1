"""States of refresh runs from a stream of what is written about them, with timers for those that fall silent.

A run that hasn't finished is interrupted once its last beat is older than a timeout, without any
further word of it, or as soon as a later run of its catalog starts; a beat makes it running again.
Runs are keyed by catalog, as a start concerns all of a catalog's runs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .state import rocksdb

#: Minutes after which a silent run is interrupted, and finished runs that are remembered.
TIMEOUT_MINUTES, REMEMBERED = 90, 8
CHANGES = "catalog string, run_id string, at timestamp, state string"
_NEVER = -(1 << 62)


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class _Runs(StatefulProcessor):
    """State of one catalog: its runs with start, last beat, outcome and the state last told; apart from them, those that are running, the finished ones that are remembered, and the newest start.

    A word is weighed against its own run and against the running ones whose turn to fall silent has
    come, the longest silent first, so that the work grows with the words and not with their product
    with the runs.
    """

    def __init__(self, timeout_minutes: int) -> None:
        self.timeout = timeout_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id string", "started long, beat long, outcome string, told string")
        self.live = handle.getMapState("live", "run_id string", "beat long")
        self.done = handle.getMapState("done", "run_id string", "started long")
        self.newest = handle.getValueState("newest", "started long")

    def _open(self, catalog: str) -> None:
        self.catalog, self.changes = catalog, []
        self.met: dict[str, list] = {}  # runs of this call
        self.was_live = {k[0]: v[0] for k, v in self.live.iterator()}
        self.was_done = {k[0]: v[0] for k, v in self.done.iterator()}
        self.now_live, self.now_done = dict(self.was_live), dict(self.was_done)
        self.line = [(beat, k) for k, beat in self.now_live.items()]
        heapq.heapify(self.line)
        self.start = self.newest.get()[0] if self.newest.exists() else _NEVER

    def _run(self, run_id: str) -> list:
        if run_id not in self.met:
            self.met[run_id] = list(self.runs.getValue((run_id,)) if self.runs.containsKey((run_id,)) else (_NEVER, _NEVER, "", ""))
        return self.met[run_id]

    def _tell(self, run_id: str, at: int) -> None:
        """The state of one run at an instant, if it has changed."""
        run = self._run(run_id)
        state = run[2] or ("interrupted" if at - run[1] > self.timeout or run[1] < self.start else "running")
        if state != run[3]:
            run[3] = state
            self.changes.append((self.catalog, run_id, pd.Timestamp(at, unit="ms"), state))
        if state != "running":
            self.now_live.pop(run_id, None)
        elif self.now_live.get(run_id) != run[1]:
            self.now_live[run_id] = run[1]
            heapq.heappush(self.line, (run[1], run_id))

    def _fall(self, before: int, at: int | None = None) -> None:
        """Running runs whose last beat is earlier than an instant are told anew, at a given instant or when their time was up."""
        while self.line and self.line[0][0] < before:
            beat, run_id = heapq.heappop(self.line)
            if self.now_live.get(run_id) == beat:
                self._tell(run_id, beat + self.timeout + 1 if at is None else at)

    def _begin(self, run: list, at: int) -> None:
        first = at if run[0] == _NEVER else min(run[0], at)
        lowered, run[0] = run[0] == self.start and first < run[0], first
        self.start = max(self.start, first)
        if lowered:  # the newest run began earlier than was known: the others decide
            every = {k[0]: list(v) for k, v in self.runs.iterator()} | self.met
            self.met, self.start = every, max(r[0] for r in every.values())
            for run_id in sorted(every):
                self._tell(run_id, at)

    def _close(self) -> Iterator[pd.DataFrame]:
        for k, r in self.met.items():
            if r[2]:
                self.now_done[k] = r[0]
        forgotten = {k for _, k in sorted((s, k) for k, s in self.now_done.items())[: max(0, len(self.now_done) - REMEMBERED)]}
        for k in forgotten:
            del self.now_done[k]
            if k in self.was_done or self.runs.containsKey((k,)):
                self.runs.removeKey((k,))
        for k, r in self.met.items():
            if k not in forgotten:
                self.runs.updateValue((k,), tuple(r))
        for state, was, now in ((self.live, self.was_live, self.now_live), (self.done, self.was_done, self.now_done)):
            for k in was.keys() - now.keys():
                state.removeKey((k,))
            for k, v in now.items():
                if was.get(k) != v:
                    state.updateValue((k,), (v,))
        self.newest.update((self.start,))
        # one timer, for the moment at which the first of them will have been silent for too long
        wanted = {min(self.now_live.values()) + self.timeout + 1} if self.now_live else set()
        there = set(self.handle.listTimers())
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)
        yield pd.DataFrame(self.changes, columns=["catalog", "run_id", "at", "state"]).astype({"at": "datetime64[ns]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        self._open(key[0])
        came = pd.concat(list(rows), ignore_index=True).sort_values(["at", "run_id"], kind="stable")
        for e in came.itertuples(index=False):
            at = _ms(e.at)
            self._fall(at - self.timeout)  # what fell silent before this word came
            run = self._run(e.run_id)
            run[1] = max(run[1], at)
            if e.kind == "start":
                self._begin(run, at)
            elif e.kind == "finish":
                run[2] = e.value or "done"
            self._fall(self.start, at)
            self._tell(e.run_id, at)
        yield from self._close()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open(key[0])
        self._fall(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.timeout)
        yield from self._close()

    def close(self) -> None:
        pass


def changes(events: DataFrame, timeout_minutes: int = TIMEOUT_MINUTES, late: str = "0 seconds") -> DataFrame:
    """(catalog, run_id, at, state) of every change, of a stream of events (catalog, run_id, at, kind: start, beat, phase or finish, value: the outcome). Time is that of events: another catalog's words move it too."""
    marked = events.withWatermark("at", late)
    return marked.groupBy("catalog").transformWithStateInPandas(_Runs(timeout_minutes), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def follow(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, timeout_minutes: int = TIMEOUT_MINUTES) -> StreamingQuery:
    """Writes the changes of a stream of events to path, a folder for each batch, which a batch that is run again replaces. Ends when the stream has been read."""

    def take(batch: DataFrame, number: int) -> None:
        batch.withColumn("nth", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocksdb(spark):
        return changes(events, timeout_minutes).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def told(spark: SparkSession, path: str) -> DataFrame:
    """(catalog, run_id, at, state, nth) of what follow has written; nth: the batch."""
    return spark.read.option("recursiveFileLookup", True).schema(f"{CHANGES}, nth int").parquet(path)


def states(changed: DataFrame, at: F.Column) -> DataFrame:
    """(catalog, run_id, state) that held at an instant, from what told has."""
    last = F.row_number().over(Window.partitionBy("catalog", "run_id").orderBy(F.desc("at"), F.desc("nth")))
    return changed.where(F.col("at") <= at).withColumn("_rn", last).where("_rn = 1").select("catalog", "run_id", "state")
