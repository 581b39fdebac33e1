"""Running summaries of a live event log that a reset event clears.

Arbitrary state holds, for each event type, how many events came since the last reset and
the sums of their measures.  Events take effect in the order of their times, whatever the
order of their arrival within the lateness, so a replay or another cut into batches gives
the same summaries.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

RESET = "reset"
LATENESS_MINUTES = 10
IDLE_MINUTES = 24 * 60
#: Parts that an event type's rows are dealt to, so that a hot type is several keys.
LANES = 8
#: Before any event: the start of a log that was never reset.
NEVER = -(1 << 62)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "event_type string, lane int, epoch bigint, since bigint, number bigint, closed boolean, "
    "n bigint, sums array<double>, counts array<bigint>"
)


def lanes(
    events: DataFrame,
    measures: Mapping[str, Column],
    types: Sequence[str],
    reset: Column,
    time: str = "timestamp",
    n_lanes: int = LANES,
) -> DataFrame:
    """``event_type, lane, at, reset, measures``: events of ``types`` dealt by a hash of
    their time and measures, and each reset once for every type and lane.

    Copies of a reset are as many as ``types`` times ``n_lanes``.  Events of other types and
    events without a time are left out; a null ``reset`` is none.
    """
    values = F.array(*[m.cast("double") for m in measures.values()]).cast("array<double>")
    rows = events.select(
        time, "event_type", F.coalesce(reset, F.lit(False)).alias("reset"), values.alias("measures")
    ).where(F.col(time).isNotNull())
    every = F.array(
        *[F.struct(F.lit(t).alias("event_type"), F.lit(i).alias("lane")) for t in types for i in range(n_lanes)]
    )
    place = F.pmod(F.xxhash64(time, "measures"), F.lit(n_lanes)).cast("int")
    own = F.when(F.col("event_type").isin(*types), F.array(F.struct("event_type", place.alias("lane"))))
    return rows.select(
        time, "reset", "measures", F.inline(F.when(F.col("reset"), every).otherwise(own))
    ).withColumn("at", F.unix_micros(time))


class RunningSummary(StatefulProcessor):
    """Sums since the last reset; a key without events for ``idle`` is closed and forgotten.

    ``kept`` holds what can no longer change; ``waiting`` the rows within the lateness of
    the key's newest one, among which an earlier reset may still arrive.
    """

    def __init__(self, n_measures: int, lateness_minutes: int, idle_minutes: int):
        self.n_measures = n_measures
        self.lateness, self.idle = lateness_minutes * 60_000_000, idle_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState(
            "kept",
            "epoch bigint, since bigint, number bigint, newest bigint, n bigint, "
            "sums array<double>, counts array<bigint>",
        )
        self.waiting = handle.getListState("waiting", "at bigint, reset boolean, measures array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, reset, values = self._read(rows)
        kept = self.kept.get() if self.kept.exists() else None
        if kept is None:
            epoch, since, number, newest, n = int(at.min()), NEVER, 0, NEVER, 0
            sums, counts = np.zeros(self.n_measures), np.zeros(self.n_measures, np.int64)
        else:
            epoch, since, number, newest, n = kept[:5]
            sums, counts = np.array(kept[5], float), np.array(kept[6], np.int64)
        newest = max(newest, int(at.max()))
        horizon = newest - self.lateness
        old = at <= horizon
        settled = self._fold(since, n, sums, counts, at[old], reset[old], values[old])
        since_now, n_now, sums_now, counts_now = self._fold(*settled, at[~old], reset[~old], values[~old])
        number += 1
        since, n, sums, counts = settled
        self.kept.update((epoch, since, number, newest, n, sums.tolist(), counts.tolist()))
        if old.all():
            self.waiting.clear()
        else:
            rest = zip(at[~old].tolist(), reset[~old].tolist(), values[~old])
            self.waiting.put([(a, r, [None if np.isnan(x) else float(x) for x in v]) for a, r, v in rest])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.idle) // 1000)
        yield self._row(key, epoch, since_now, number, False, n_now, sums_now, counts_now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.kept.exists():
            return
        epoch, since, number, _, n, sums, counts = self.kept.get()
        at, reset, values = self._read(iter(()))
        done = self._fold(since, n, np.array(sums, float), np.array(counts, np.int64), at, reset, values)
        self.kept.clear()
        self.waiting.clear()
        yield self._row(key, epoch, done[0], number + 1, True, *done[1:])

    def close(self) -> None:
        pass

    def _read(self, rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Waiting and new rows as arrays; a missing measure is NaN."""
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        at, reset, values = [], [], []
        if waiting:
            at.append(np.array([w[0] for w in waiting], np.int64))
            reset.append(np.array([w[1] for w in waiting], bool))
            values.append(self._table([w[2] for w in waiting]))
        for part in rows:
            at.append(part["at"].to_numpy(np.int64))
            reset.append(part["reset"].to_numpy(bool))
            values.append(self._table(part["measures"].tolist()))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, self.n_measures))
        return np.concatenate(at), np.concatenate(reset), np.concatenate(values)

    def _table(self, lists: list) -> np.ndarray:
        return np.array([list(v) for v in lists], dtype=float).reshape(len(lists), self.n_measures)

    def _fold(self, since, n, sums, counts, at, reset, values):
        """The summary after further rows: a reset takes away all up to its time."""
        if reset.any() and (last := int(at[reset].max())) > since:
            since, n, sums, counts = last, 0, np.zeros_like(sums), np.zeros_like(counts)
        live = ~reset & (at > since)
        rows = values[live]
        return (
            since, n + int(live.sum()), sums + np.nansum(rows, axis=0), counts + (~np.isnan(rows)).sum(axis=0)
        )

    def _row(self, key, epoch, since, number, closed, n, sums, counts) -> pd.DataFrame:
        row = (key[0], key[1], epoch, since, number, closed, n, list(map(float, sums)), list(map(int, counts)))
        return pd.DataFrame([row], columns=[part.split()[0] for part in OUTPUT.split(", ")])


def running_summaries(
    events: DataFrame,
    measures: Mapping[str, Column],
    types: Sequence[str],
    reset: Column | None = None,
    time: str = "timestamp",
    lateness_minutes: int = LATENESS_MINUTES,
    idle_minutes: int = IDLE_MINUTES,
    n_lanes: int = LANES,
) -> DataFrame:
    """A stream of summaries by event type and lane, one for each batch that changes it.

    ``since`` is the last reset's time in microseconds, ``epoch`` the first time of the state
    it comes from, ``number`` its count of summaries.  ``reset`` marks resetting events
    (default: those of type ``reset``).  A reset clears every type, up to and including its
    own time.  Rows later than ``lateness_minutes`` drop; a key idle for ``idle_minutes``
    gives a closed summary and leaves the state.  A task holds the rows of a batch for one
    lane, so bound a backlog by the files of a batch.
    """
    if idle_minutes < lateness_minutes:
        raise ValueError("a key that may still get late rows is not idle")
    marked = F.col("event_type") == RESET if reset is None else reset
    dealt = lanes(events.withWatermark(time, f"{lateness_minutes} minutes"), measures, types, marked, time, n_lanes)
    processor = RunningSummary(len(measures), lateness_minutes, idle_minutes)
    return dealt.groupBy("event_type", "lane").transformWithStateInPandas(
        processor, OUTPUT, "Append", "EventTime"
    )


def run_summaries(summaries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over all waiting input, appending summaries to a parquet table exactly once.

    The state needs the RocksDB store; it is set for this query alone, which keeps the
    configuration that it starts with.
    """
    conf = summaries.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        writer = summaries.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).format("parquet").option("path", path).start()
    finally:
        conf.set(_PROVIDER, before)


def latest(stored: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``event_type, n_events`` and the mean of each measure since the last reset, from
    stored summaries: the last one of each epoch, if it began after that reset or saw it.

    A type without events since then counts 0 and has null means.
    """
    last = stored.groupBy("event_type", "lane", "epoch").agg(
        F.max_by(F.struct("since", "n", "sums", "counts"), "number").alias("s")
    )
    newest = last.groupBy("event_type", "lane").agg(F.max("s.since").alias("reset"))
    live = (F.col("s.since") == F.col("reset")) | (F.col("epoch") > F.col("reset"))
    kept = last.join(newest, ["event_type", "lane"])
    shown = [
        F.try_divide(
            F.sum(F.when(live, F.col("s.sums")[i])), F.sum(F.when(live, F.col("s.counts")[i]))
        ).alias(f"avg_{name}")
        for i, name in enumerate(measures)
    ]
    return kept.groupBy("event_type").agg(
        F.coalesce(F.sum(F.when(live, F.col("s.n"))), F.lit(0)).alias("n_events"), *shown
    )
