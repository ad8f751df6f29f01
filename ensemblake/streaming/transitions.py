"""Streams of assignments and angles, in the order of their event times whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cards import gates
from ..plans.shared import workers_can_import


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Holds a key's events in slots of `width` milliseconds, each with a timer at its end, and hands them to step in order of time when the watermark reaches it.

    A batch reads and writes the slots that it adds to or releases, and no others, however many a key holds.
    """

    def __init__(self, step: Callable[[list, object], object], time: str, value: str, columns: list[str], kept: str, kind: str, width: int) -> None:
        self.step, self.time, self.value, self.columns, self.kept, self.kind, self.width = step, time, value, columns, kept, kind, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", f"kept array<{self.kept}>")
        self.slots = handle.getMapState("slots", "slot long", f"times array<long>, held array<{self.kind}>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, new = timerValues.getCurrentWatermarkInMs(), {}
        for batch in rows:
            at = batch[self.time].astype("datetime64[us]").astype("int64")
            there = (at > mark * 1000).to_numpy() | (mark <= 0)
            for t, v in zip(at[there].tolist(), batch[self.value][there].tolist()):
                times, held = new.setdefault(-(-t // (1000 * self.width)), ([], []))
                times.append(t)
                held.append(None if v is None or v != v else v)
        for slot, (times, held) in new.items():
            if self.slots.containsKey((slot,)):
                before = self.slots.getValue((slot,))
                times, held = [*before[0], *times], [*before[1], *held]
            else:
                self.handle.registerTimer(slot * self.width)
            self.slots.updateValue((slot,), (times, held))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = (expiredTimerInfo.getExpiryTimeInMs() // self.width,)
        times, held = self.slots.getValue(slot)
        keep = list(self.state.get()[0]) if self.state.exists() else []
        made = [(key[0], pd.Timestamp(times[j], unit="us"), *x) for j in sorted(range(len(times)), key=times.__getitem__) if (x := self.step(keep, held[j])) is not None]
        self.state.update((keep,))
        self.slots.removeKey(slot)
        if made:
            yield pd.DataFrame(made, columns=self.columns)

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, key: str, value: str, time: str, delay: str, out: str, kept: str, step: Callable[[list, object], object], width: int = 1) -> DataFrame:
    """Rows made by step(kept, value) for each event of a key, in order of time.

    Events are held until the watermark has passed them, when no earlier one can come; then they are taken in order. What comes later than that is dropped. State is what
    step keeps, and the events of the last `delay`: bounded, however long a key goes on. Events that are equal in time are taken as they came. As with any
    event time, the last events of a stream come out once later ones have moved the watermark on. Events without a time are dropped. Keyed state with timers needs RocksDB as state store, which the session
    is set to.
    """
    spark = stream.sparkSession
    workers_can_import(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(stream.dtypes)
    work = _InOrder(step, time, value, [c.split()[0] for c in out.split(", ")], kept, kinds[value], width)
    own = stream.withWatermark(time, delay).select(key, value, time).where(F.col(time).isNotNull())
    return own.groupBy(key).transformWithStateInPandas(work, out, "append", "eventTime")


def streaming_transitions(assigns: DataFrame, lag_time: int = 1, time: str = "ts", delay: str = "0 seconds", width: int = 1) -> DataFrame:
    """traj_id, `time`, i, j of a stream (traj_id, state, `time`): a pair for each event and that lag_time present ones before.

    Missing states (-1, null) are passed over, as in batch. Events up to `delay` late are put in order; later ones are dropped. Events are let go in slots of `width`
    milliseconds: where a key has many events a second, wide slots make fewer timers.
    """

    def step(last: list, now) -> tuple | None:
        if now is None or now == -1:
            return None
        last.append(int(now))
        return (last.pop(0), int(now)) if len(last) > lag_time else None

    kinds = dict(assigns.dtypes)
    return _in_order(assigns, "traj_id", "state", time, delay, f"traj_id {kinds['traj_id']}, {time} timestamp, i int, j int", "int", step, width)


def streaming_counts(pairs: DataFrame) -> DataFrame:
    """(i, j, v) so far, for output mode complete or update."""
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


def streaming_rotamers(angles: DataFrame, boundaries: list[float], buffer_width: float = 15, time: str = "ts", delay: str = "0 seconds", width: int = 1) -> DataFrame:
    """series, `time`, state of a stream (series, angle, `time`), as batch rotamers: a series' state, and its events of the last `delay`, are all that is kept of it."""
    gone = gates(boundaries, buffer_width)

    def step(kept: list, angle) -> tuple:
        basin = sum(angle >= b for b in boundaries[1:-1])
        if kept:
            low, high = gone[kept[0]]
            kept[:] = [basin] if (high <= angle <= low if high < low else not low <= angle <= high) else kept
        else:
            kept.append(basin)
        return (int(kept[0]),)

    kinds = dict(angles.dtypes)
    return _in_order(angles, "series", "angle", time, delay, f"series {kinds['series']}, {time} timestamp, state int", "int", step, width)
