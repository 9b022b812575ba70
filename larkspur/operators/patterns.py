"""Sequences of events: a first event, then others in order, within a time, the match as long as can be."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matches(time: np.ndarray, step: np.ndarray, steps: int, within: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``starts`` the end of its match, or -1, and the number of events of steps in between.

    ``time`` is in order; ``step`` has the number of the step that an event is for, -1 for none.  The automaton goes on
    to the next step as soon as it can; in the last it waits for the last event in time.
    """
    n = len(time)
    place = starts
    for k in range(1, steps - 1):
        following = np.append(np.where(step == k, np.arange(n), n), n)
        following = np.minimum.accumulate(following[::-1])[::-1]  # the first event of step k at or after each place
        place = following[np.minimum(place + 1, n)]
    limit = np.searchsorted(time, time[starts] + within, side="right") - 1
    latest = np.maximum.accumulate(np.where(step == steps - 1, np.arange(n), -1))
    end = latest[limit]
    end = np.where(end > place, end, -1)
    inside = np.concatenate([[0], np.cumsum((step > 0) & (step < steps - 1))])
    return end, np.where(end >= 0, inside[np.maximum(end, 0)] - inside[starts + 1], 0)


def match_sequence(events: DataFrame, *, by: str, on: str, id: str, steps: Sequence[str], within: int, width: int | None = None) -> DataFrame:
    """by, first_id, last_id and n_between of each match of ``steps``, conditions of which the first that holds counts.

    A match begins at every event of the first step whose group has events of all others after it, in order, the last of
    them at most ``within`` seconds later.  Other events may stand between.  It ends at the last such event of the last
    step.  n_between counts the events of the steps between that stand between the two ends.  Events of one time are in order of their ids;
    equal ids too are events like others, in any order.  Rows without a group, a time or an id are left out.

    Time is cut into stretches of ``width`` seconds, ``within`` at least: a task has the events of a group in two stretches and
    finds the matches that begin in the first.  So a group with a long history is spread, and each event is sent twice at most.
    """
    if len(steps) < 2 or within < 0:
        raise ValueError("a sequence has two steps or more and a time that isn't negative")
    span = max(width or 16 * within, within, 1) * 1_000_000
    step = F.coalesce(*(F.when(F.expr(c), k) for k, c in enumerate(steps)), F.lit(-1)).cast("int")
    rows = events.select(F.col(f"`{by}`").alias("g"), F.unix_micros(F.col(f"`{on}`").cast("timestamp")).alias("t"), F.col(f"`{id}`").cast("long").alias("id"), step.alias("step"))
    rows = rows.where("g is not null and t is not null and id is not null and step >= 0")
    own = F.floor(F.col("t") / span).cast("long")
    rows = rows.withColumn("stretch", F.explode(F.array(own, own - 1))).withColumn("own", F.col("stretch") == own)
    rows = rows.where(F.col("own") | (F.col("step") > 0) & (F.col("t") <= (F.col("stretch") + 1) * span + within * 1_000_000))

    def find(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by([("t", "ascending"), ("id", "ascending")])
        step, ids = t["step"].to_numpy(), t["id"].to_numpy()
        starts = np.flatnonzero((step == 0) & t["own"].to_numpy(zero_copy_only=False))
        end, between = _matches(t["t"].to_numpy(), step, len(steps), within * 1_000_000, starts)
        some = end >= 0
        group = t["g"].take(pa.array(np.zeros(int(some.sum()), np.int64)))
        return pa.table([group, *map(pa.array, (ids[starts[some]], ids[end[some]], between[some]))], ["g", "first_id", "last_id", "n_between"])

    kind = rows.schema["g"].dataType.simpleString()
    found = rows.groupBy("g", "stretch").applyInArrow(find, f"g {kind}, first_id long, last_id long, n_between long")
    return found.select(F.col("g").alias(by), "first_id", "last_id", "n_between")
