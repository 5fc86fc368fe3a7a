"""Structured Streaming forms of the incremental operators (section 2.13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docweave.operators.diffs import line_changes

CHANGES = "key string, version string, previous string, kind string, path string, before string, after string"
#: A kind of its own for a key whose state was given up.
EXPIRED = "expired"


class LastVersion(StatefulProcessor):
    """A key's last version as a value and its lines as a list, so that no row of state holds a document."""

    def __init__(self, keep_ms: int | None, idle_ms: int | None):
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version string", self.keep_ms)
        self.lines = handle.getListState("lines", "path string, text string", self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self._keep(row["version"], list(zip(row["paths"], row["texts"], strict=True)))
        self._wait(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version = self.last.get()[0] if self.last.exists() else None
        lines = None
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.version == version:
                continue  # it has come before: a replay changes nothing
            new = list(zip(row.paths, row.texts, strict=True))
            if version is not None:
                old = [tuple(x) for x in self.lines.get()] if lines is None else lines
                out += [(key[0], row.version, version, *c) for c in line_changes(old, new)]
            version, lines = row.version, new
        if lines is not None:
            self._keep(version, lines)
        self._wait(timerValues)
        yield pd.DataFrame(out, columns=_CHANGES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield pd.DataFrame([(key[0], self.last.get()[0], None, EXPIRED, None, None, None)], columns=_CHANGES)
        self.last.clear()
        self.lines.clear()

    def close(self) -> None:
        pass

    def _keep(self, version: str, lines: list[tuple[str, str]]) -> None:
        self.last.update((version,))
        if lines:
            self.lines.put(lines)
        else:
            self.lines.clear()

    def _wait(self, timerValues) -> None:
        """The last of a key's timers counts."""
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)


_CHANGES = [x.split()[0] for x in CHANGES.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snapshot_changes(snapshots: DataFrame, initial: DataFrame | None = None, keep_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Changes of (key, version, seq, paths, texts) against the last different version of each key.

    A version that comes again changes nothing and is not compared with itself, so replays after a failure are
    harmless. initial has (key, version, paths, texts), one row for each key, of a store that the stream goes on from. State that isn't
    written for keep_ms goes by itself; a key that brings nothing for idle_ms goes with a row of kind expired; with either, a query goes on until it is stopped, as time alone brings rows. The
    session's state store is set to the one that processors with state need.
    """
    snapshots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    mode = "none" if keep_ms is None and idle_ms is None else "ProcessingTime"
    begun = None if initial is None else initial.groupBy("key")
    return snapshots.groupBy("key").transformWithStateInPandas(LastVersion(keep_ms, idle_ms), CHANGES, "append", mode, begun)


def deduplicated(rows: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once, as long as its rows come within the overlap of the batches."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, time: str, width: str, by: list[str], late: str = "1 day") -> DataFrame:
    """A01 on a stream."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that gives each batch to several consumers, computed once."""

    def give(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return give
