"""A stateful stream operator whose state ends: the last mark of a group within a time before each other event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "id long, mark_id long"


class _RecentMark(StatefulProcessor):
    """Keeps one mark a group, and a timer that deletes it when no event can refer to it any more."""

    def __init__(self, within_ms: int) -> None:
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "id long, micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events = pd.concat(list(rows))[["id", "micros", "mark"]]
        before = self.mark.get()  # None where there is none
        if before is not None:
            id_, micros = before
            events = pd.concat([pd.DataFrame({"id": [id_], "micros": [micros], "mark": [True]}), events])
        events = events.sort_values(["micros", "mark", "id"], ascending=[True, False, True], kind="stable")
        marks = events["mark"].astype(bool)
        last_id, last_at = (events[c].astype("Int64").where(marks).ffill() for c in ("id", "micros"))
        near = (events["micros"] - last_at <= self.within_ms * 1000).fillna(False).astype(bool)
        yield pd.DataFrame({"id": events["id"], "mark_id": last_id.where(near)})[~marks.to_numpy()]
        if pd.notna(last_at.iloc[-1]):
            now = int(last_id.iloc[-1]), int(last_at.iloc[-1])
            if before is None or now != tuple(before):
                self._keep(now, before, timerValues.getCurrentWatermarkInMs())

    def _end(self, micros: int) -> int:
        """The first millisecond at which no event can refer to a mark of that time any more."""
        return micros // 1000 + self.within_ms + 1

    def _keep(self, now: tuple[int, int], before: tuple[int, int] | None, watermark: int) -> None:
        if before is not None:
            self.handle.deleteTimer(self._end(before[1]))
        if self._end(now[1]) > watermark:
            self.mark.update(now)
            self.handle.registerTimer(self._end(now[1]))
        elif before is not None:
            self.mark.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.mark.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_mark(stream: DataFrame, *, by: str, on: str, id: str, marks: str, within_seconds: int, late_seconds: int) -> DataFrame:
    """(id, mark_id) of each event that isn't a mark: the id of the last mark of its group by then, null if that is longer ago than ``within_seconds``.

    ``marks`` is a condition (null counts as false), ``on`` a time; a mark comes before another event of the same time, of
    marks at one time the one with the largest id is the last.  The watermark is ``late_seconds`` behind; later events are left out, as are
    rows without a group or a time.  A group's state is one mark and one timer: when the watermark has passed the last moment
    at which an event could refer to the mark, both go, so a group that is quiet takes no space.  Start such a
    stream inside ``rocksdb_state``.  Events should come in order of batches: one that comes in a later batch than a
    newer mark of its group doesn't see older marks.  A group's rows of one batch are held together, so bound the batches.
    """
    rows = stream.where(F.col(by).isNotNull() & F.col(on).isNotNull())
    rows = rows.select(F.col(by).alias("g"), F.col(on).cast("timestamp").alias("at"), F.col(id).cast("long").alias("id"), F.coalesce(F.expr(marks), F.lit(False)).alias("mark"))
    rows = rows.withColumn("micros", F.unix_micros("at")).withWatermark("at", f"{late_seconds} seconds")
    return rows.groupBy("g").transformWithStateInPandas(_RecentMark(within_seconds * 1000), OUT, "Append", "EventTime")
