"""Summaries of each entity's own window over a stream: the window begins at the entity's first event, so each has a state and a timer of its own.

Events may come in any order within the lateness. While an entity's window is open its events up to the window's end are kept; an earlier
first event moves the window and the timer. Once the watermark passes the end, nothing that belongs to the window can come any more: the
timer sends out the entity's summaries, the same as `events.summary` in `events.windows` gives for the whole table, and what is left
of the state is a mark that the entity is done. State is keyed by entity and sharded by Spark, in its RocksDB store.

Defined results: events without an entity or time, and those after the window or later than the watermark, don't count; values that
aren't finite numbers are skipped; an entity whose values are all skipped has no row; of events at the same time the least tie key is both first and last.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars
from ..operators.events import SCALE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLACES = Decimal(1).scaleb(-SCALE)


def _summary(events: list[tuple[int, str, float, int]]) -> tuple[int, float, float, float, float, float]:
    """(n, first, last, min, max, mean) of the values of (micros, concept, value, tie)."""
    values = [v for _, _, v, _ in events]
    total = sum((Decimal(repr(v)).quantize(_PLACES, ROUND_HALF_UP) for v in values), Decimal(0))
    first, last = min(events, key=lambda e: (e[0], e[3]))[2], min(events, key=lambda e: (-e[0], e[3]))[2]
    return len(values), first, last, min(values), max(values), float(total) / len(values)


class OwnWindow(StatefulProcessor):
    """Keeps an entity's events while its window is open; sends one row a concept when the watermark passes the end."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "first long, done boolean")
        self.events = handle.getListState("events", "at long, concept string, value double, tie long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803; names of the interface
        first, done = self.window.get() if self.window.exists() else (None, False)
        if done:
            for _ in rows:
                pass
            return
        before, kept = first, []
        for batch in rows:
            own = list(zip(batch["at"].tolist(), batch["concept"].tolist(), batch["value"].tolist(), batch["tie"].tolist(), strict=True))
            first = min([first, *(e[0] for e in own)], key=lambda t: (t is None, t)) if own else first
            kept += own
        kept = [e for e in kept if e[0] <= first + self.micros and e[2] == e[2]]
        if kept:
            self.events.appendList(kept)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(first))
            self.window.update((first, False))
        yield pd.DataFrame()

    def _end(self, first: int) -> int:
        return (first + self.micros) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, _ = self.window.get()
        by_concept: dict[str, list] = {}
        for e in self.events.get():
            if e[0] <= first + self.micros:
                by_concept.setdefault(e[1], []).append(tuple(e))
        self.events.clear()
        self.window.update((first, True))
        rows = [(key[0], concept, *_summary(own)) for concept, own in sorted(by_concept.items())]
        yield pd.DataFrame(rows, columns=["entity", "concept", "n", "first", "last", "min", "max", "mean"])

    def close(self) -> None:
        pass


def own_window_summary(stream: DataFrame, entity: str, concept: str, time: str, value: str, tie: str, hours: int = 48, lateness: str = "1 hour") -> DataFrame:
    """(entity, concept, n, first, last, min, max, mean) of each entity's window, appended once the watermark has passed its end."""
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"timers need spark.sql.streaming.stateStore.providerClass = {PROVIDER}")
    at = F.col(time).cast("timestamp")
    rows = stream.select(F.col(entity).alias("entity"), F.col(concept).cast("string").alias("concept"), at.alias("time"), F.coalesce(scalars.number(F.col(value)), F.lit(float("nan"))).alias("value"), F.col(tie).cast("long").alias("tie"))
    rows = rows.where("entity is not null and time is not null").withWatermark("time", lateness).withColumn("at", F.unix_micros("time"))
    schema = f"entity {stream.schema[entity].dataType.simpleString()}, concept string, n long, first double, last double, min double, max double, mean double"
    return rows.groupBy("entity").transformWithStateInPandas(OwnWindow(hours * 3_600_000_000), schema, "append", "eventTime")
