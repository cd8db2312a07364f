"""Ordered steps per key, with state and event-time timers.

A funnel asks for steps in a given order within a time limit: an attempt begins
with the first step, each further step counts only after the one before, and the
attempt ends with the last step or when its time is up. The next first step after
that begins another. What counts depends on the order of events and on where the
attempt before ended, which windows and sessions cannot say.

Events arrive in any order within the watermark's delay. Keys are dealt by their hash
into a fixed number of groups, and a group's keys are worked on together: every call
of a group and every access to its state costs about as much as a hundred events, so
with a group for each key these calls, and not the events, set the time. A group's
state holds the events that may still be preceded by others, in a list of parts, and
the open attempts. A timer at the earliest time at which anything can be decided wakes
the group, so attempts end without further events of their keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GROUPS = 1024
# Events in one entry of the list, and in Python objects at a time.
PART = 10_000
LAST_NUMBER = 2**63 - 1
Event = tuple[int, int, int]  # time in microseconds, a number that orders equal times, kind

_EVENTS = pa.schema(
    [("key", pa.large_string()), ("time", pa.int64()), ("number", pa.int64()), ("kind", pa.int32())]
)
_OPEN = pa.schema(
    [("key", pa.large_string()), ("times", pa.list_(pa.int64())), ("n_events", pa.int64())]
)


class Attempt:
    """The steps of one attempt so far, and the events seen meanwhile."""

    def __init__(self, times: list[int], n_events: int):
        self.times, self.n_events = times, n_events


def advanced(
    attempt: Attempt | None, events: Iterable[Event], upto: int, steps: list, limit: int
) -> tuple[Attempt | None, list[Attempt]]:
    """The open attempt and those that have ended, once no event up to `upto` can still come.

    `events` are all at or before `upto`, in order. An event at `limit` after the
    first step, or later, is out of time.
    """
    ended = []
    for time, _, kind in events:
        if attempt is not None and time >= attempt.times[0] + limit:
            ended.append(attempt)
            attempt = None
        if attempt is None:
            if kind != steps[0]:
                continue
            attempt = Attempt([time], 1)
        else:
            attempt.n_events += 1
            if kind == steps[len(attempt.times)]:
                attempt.times.append(time)
        if len(attempt.times) == len(steps):
            ended.append(attempt)
            attempt = None
    if attempt is not None and upto + 1 >= attempt.times[0] + limit:
        ended.append(attempt)
        attempt = None
    return attempt, ended


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _rows(events: pa.Table) -> Iterator[tuple]:
    for start in range(0, events.num_rows, PART):
        part = events.slice(start, PART).to_pandas()
        yield from zip(*(part[name].tolist() for name in part.columns))


class Funnel(StatefulProcessor):
    """Gives out each attempt of a group's keys when it has ended. Kinds and steps are numbers."""

    def __init__(self, steps: list[int], limit: int):
        self.steps, self.limit = steps, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.open = handle.getValueState("open", "attempts binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            frame = frame.loc[frame["key"].notna(), _EVENTS.names]
            new.append(pa.Table.from_pandas(frame, _EVENTS, preserve_index=False))
        yield from self._moved(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._moved([], timerValues.getCurrentWatermarkInMs())

    def _moved(self, new: list[pa.Table], watermark: int) -> Iterator[pd.DataFrame]:
        upto = watermark * 1000
        waiting = [_unpacked(data) for (data,) in self.waiting.get()]
        events = pa.concat_tables([_EVENTS.empty_table(), *waiting, *new])
        in_time = pc.less_equal(events["time"], upto)
        ready, rest = events.filter(in_time), events.filter(pc.invert(in_time))
        attempts = self._held()
        ended: list[tuple[str, Attempt]] = []
        ready = ready.sort_by([(name, "ascending") for name in _EVENTS.names])
        still = {}
        for own, of_key in groupby(_rows(ready), key=itemgetter(0)):
            moved = (event[1:] for event in of_key)
            self._advance(own, attempts.pop(own, None), moved, upto, still, ended)
        for own, attempt in attempts.items():
            self._advance(own, attempt, [], upto, still, ended)
        if ready.num_rows or new:
            self._wait(rest)
        if still:
            held = pa.table(
                [[*still], [a.times for a in still.values()], [a.n_events for a in still.values()]],
                schema=_OPEN,
            )
            self.open.update((_packed(held),))
        else:
            self.open.clear()
        due = [pc.min(rest["time"]).as_py()] if rest.num_rows else []
        due += [attempt.times[0] + self.limit for attempt in still.values()]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            # In milliseconds, and behind the event itself.
            self.handle.registerTimer(min(due) // 1000 + 1)
        if ended:
            yield pd.DataFrame(
                {
                    "key": [own for own, _ in ended],
                    "times": [a.times for _, a in ended],
                    "n_events": [a.n_events for _, a in ended],
                }
            )

    def _advance(
        self, own: str, attempt: Attempt | None, events: Iterable[Event], upto: int,
        still: dict[str, Attempt], ended: list[tuple[str, Attempt]],
    ) -> None:
        attempt, done = advanced(attempt, events, upto, self.steps, self.limit)
        ended += [(own, a) for a in done]
        if attempt is not None:
            still[own] = attempt

    def _held(self) -> dict[str, Attempt]:
        if not self.open.exists():
            return {}
        held = _unpacked(self.open.get()[0])
        return {own: Attempt(times, n) for own, times, n in zip(*(c.to_pylist() for c in held.columns))}

    def _wait(self, events: pa.Table) -> None:
        self.waiting.clear()
        for start in range(0, events.num_rows, PART):
            self.waiting.appendValue((_packed(events.slice(start, PART)),))

    def close(self) -> None:
        pass


def _numbered(kind: Column, steps: list[str]) -> tuple[Column, list[int]]:
    """Kinds as numbers in the same order, and the steps' own.

    Odd numbers are steps. Kinds between the same two steps share a number, and null comes first.
    """
    numbers = {step: 2 * i + 1 for i, step in enumerate(sorted(set(steps)))}
    number = F.when(kind.isNull(), 0)
    for step, odd in numbers.items():
        number = number.when(kind < step, odd - 1).when(kind == step, odd)
    return number.otherwise(2 * len(numbers)).cast("int"), [numbers[step] for step in steps]


def funnel(
    stream: DataFrame, key: str, time: str, number: str, kind: str, steps: list[str], limit: int, delay: str,
    groups: int | None = None,
) -> DataFrame:
    """key, reached_at (array of instants, one for each step reached), n_events: one row per attempt.

    `limit` is in seconds from the first step; `number` orders events of one time.
    Rows without key or time take no part, nor do those later than the watermark.
    `n_events` counts the key's events from the first step to the end, those of
    other kinds included. A key's events are worked on in order by one task, which
    holds those of the last `delay` of a group's keys and no more. Each batch rewrites
    the state of the groups it reaches, so `groups` (GROUPS, unless given) should leave
    a group what a task can hold; a stream goes on only with the number it began with.
    """
    kinds, own_steps = _numbered(F.col(kind).cast("string"), steps)
    own = F.col(key).cast("string")
    kept = stream.withWatermark(time, delay).select(
        F.pmod(F.xxhash64(own), F.lit(groups or GROUPS)).cast("int").alias("group"),
        own.alias("key"),
        F.col(time).alias("at"),
        F.unix_micros(time).alias("time"),
        # In pandas a null among whole numbers makes them floating-point numbers.
        F.coalesce(F.col(number).cast("bigint"), F.lit(LAST_NUMBER)).alias("number"),
        kinds.alias("kind"),
    )
    found = kept.where(F.col("at").isNotNull()).groupBy("group").transformWithStateInPandas(
        statefulProcessor=Funnel(own_steps, limit * 1_000_000),
        outputStructType="key string, times array<bigint>, n_events bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    reached_at = F.transform("times", F.timestamp_micros)
    given = F.col("key").cast(stream.schema[key].dataType)
    return found.select(given.alias(key), reached_at.alias("reached_at"), "n_events")
