"""A stateful stream operator: the last mark of a group before each of its other events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_mark(stream: DataFrame, *, by: str, on: str, id: str, marks: str) -> DataFrame:
    """(id, mark_id) of each event that isn't a mark: the id of the last mark of its group by then, or null.

    ``marks`` is a condition; ``on`` orders the events, a mark before another event of the same time.  The state is
    one id and time a group and stays for good: where a mark counts for a while only, recent_marks.recent_mark frees it.
    A group's rows of one batch are held together, so bound the batches, as event_stream does.  Batches must come in order of time: an event that comes after a later batch of its
    group sees the marks of that batch too, unless their time is after its own.
    """
    rows = stream.select(F.col(by).alias("g"), F.col(on).cast("timestamp").alias("at"), F.col(id).cast("long").alias("id"), F.expr(marks).alias("mark"))

    def seen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "mark", "id"], ascending=[True, False, True], kind="stable")
        rows["mark_id"], rows["mark_at"] = rows["id"].where(rows["mark"]).astype("Int64"), rows["at"].where(rows["mark"])
        if state.exists:
            mark, micros = state.get
            first = pd.DataFrame({"id": [-1], "at": [pd.Timestamp(micros, unit="us")], "mark": [True], "mark_id": pd.array([mark], "Int64"), "mark_at": [pd.Timestamp(micros, unit="us")]})
            rows = pd.concat([first, rows]).sort_values(["at", "mark"], ascending=[True, False], kind="stable")
        rows[["mark_id", "mark_at"]] = rows[["mark_id", "mark_at"]].ffill()
        last = rows.iloc[-1]
        if pd.notna(last["mark_id"]):
            state.update((int(last["mark_id"]), int(last["mark_at"].value // 1000)))
        yield rows.loc[~rows["mark"], ["id", "mark_id"]]

    return rows.groupBy("g").applyInPandasWithState(seen, "id long, mark_id long", "mark long, micros long", "append", GroupStateTimeout.NoTimeout)
