"""Recording runs from position fixes: a state machine per session, for tables and streams.

A fix is checked in this order: validity, rising timestamps, staleness against its arrival,
accuracy, speed, jitter. Late fixes are dropped without any change of state; stale and
inaccurate ones end the segment. Accepted fixes add their distance from the last one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Metres of radius and of accuracy, milliseconds, metres per second.
RADIUS, WORST_ACCURACY, LONGEST_GAP, FASTEST = 6371000.0, 40.0, 30_000, 15.0
OLDEST, FARTHEST_AHEAD = 15_000, 10_000

FIX = "session_id long, ts long, arrival long, lat double, lon double, accuracy double"
RESULT = "session_id long, ts long, reason string, metres double, segment long, total double"
STATE = "last long, total double, segment long, anchored boolean, ts long, lat double, lon double, accuracy double"
START = (-(2**62), 0.0, -1, False, 0, 0.0, 0.0, 0.0)


def metres_between(lat_a: float, lon_a: float, lat_b: float, lon_b: float) -> float:
    up, across = math.sin(math.radians(lat_b - lat_a) / 2), math.sin(math.radians(lon_b - lon_a) / 2)
    h = up * up + math.cos(math.radians(lat_a)) * math.cos(math.radians(lat_b)) * across * across
    return 2 * RADIUS * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def accept(state: tuple, fix: tuple) -> tuple[tuple, str, float]:
    """(new state, reason, metres added); the reason is ``accepted`` or why not."""
    last, total, segment, anchored, *anchor = state
    ts, arrival, lat, lon, accuracy = fix
    if not all(x is not None and math.isfinite(x) for x in fix) or abs(lat) > 90 or abs(lon) > 180 or accuracy < 0:
        return state, "invalid", 0.0
    if ts <= last:
        return state, "out-of-order", 0.0
    if arrival - ts > OLDEST or ts - arrival > FARTHEST_AHEAD:
        return (last, total, segment, False, *anchor), "stale", 0.0
    if accuracy > WORST_ACCURACY:
        return (ts, total, segment, False, *anchor), "accuracy", 0.0
    added = 0.0
    if anchored and ts - anchor[0] > LONGEST_GAP:
        anchored = False
    if anchored:
        added = metres_between(anchor[1], anchor[2], lat, lon)
        if added / ((ts - anchor[0]) / 1000) > FASTEST:
            return (ts, total, segment, True, *anchor), "jump", 0.0
        if added < max(3.0, min(10.0, (anchor[3] + accuracy) * 0.25)):
            return (ts, total, segment, True, *anchor), "jitter", 0.0
    return (ts, total + added, segment + (not anchored), True, ts, lat, lon, accuracy), "accepted", added


def replay(session, state: tuple, fixes: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    out = []
    for ts, arrival, lat, lon, accuracy in fixes[["ts", "arrival", "lat", "lon", "accuracy"]].itertuples(index=False, name=None):
        state, reason, metres = accept(state, (ts, arrival, lat, lon, accuracy))
        out.append((session, ts, reason, metres, state[2], state[1]))
    return state, pd.DataFrame(out, columns=["session_id", "ts", "reason", "metres", "segment", "total"])


def record_table(fixes: DataFrame) -> DataFrame:
    """Results of a table of fixes, each session in the order of arrival. A session is one run of
    one person, which bounds its rows."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return replay(key[0], START, pdf.sort_values(["arrival", "ts", "lat", "lon", "accuracy"], kind="stable"))[1]

    return fixes.groupBy("session_id").applyInPandas(one, RESULT)


def record_stream(fixes: DataFrame) -> DataFrame:
    """Results of a stream of fixes; a session's state is eight numbers."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        now = state.get if state.exists else START
        rows = pd.concat(list(batches))
        now, found = replay(key[0], tuple(now), rows.sort_values(["arrival", "ts"], kind="stable"))
        state.update(now)
        yield found

    return fixes.groupBy("session_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
