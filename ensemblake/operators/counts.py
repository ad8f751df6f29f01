"""Transition counting: a lag window in each trajectory, then a grouped count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..exceptions import DataInvalid
from .ragged import renumbered


def _check(lag_time: int) -> None:
    if isinstance(lag_time, bool) or not isinstance(lag_time, int) or lag_time < 1:
        raise DataInvalid(f"lag time {lag_time!r} isn't a positive integer")


def present(assigns: DataFrame) -> DataFrame:
    """traj_id, frame, state without missing frames (-1 or null), frames counted anew: pairs bridge gaps."""
    return renumbered(assigns.where("state IS NOT NULL AND state <> -1").select("traj_id", "frame", "state"), ["frame"])


def transition_pairs(assigns: DataFrame, lag_time: int = 1, sliding_window: bool = True) -> DataFrame:
    """traj_id, frame, i, j for every pair of states a lag apart; without sliding, from every lag-th frame only."""
    _check(lag_time)
    w = Window.partitionBy("traj_id").orderBy("frame")
    df = assigns.where("state IS NOT NULL AND state <> -1").select("traj_id", "frame", "state")
    df = df.select("traj_id", F.col("state").cast("int").alias("i"), F.lead("state", lag_time).over(w).cast("int").alias("j"), (F.row_number().over(w) - 1).cast("long").alias("frame"))
    df = df.where("j IS NOT NULL")
    return df if sliding_window else df.where(F.col("frame") % lag_time == 0)


def assigns_to_counts(assigns: DataFrame, lag_time: int = 1, sliding_window: bool = True) -> DataFrame:
    """(i, j, v): how often j follows i a lag later. One exchange by trajectory; counts are partial before they are shuffled."""
    return transition_pairs(assigns, lag_time, sliding_window).groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


def counts_by_lag(assigns: DataFrame, lag_times: list[int], sliding_window: bool = True) -> DataFrame:
    """(lag, i, j, v) for many lags in one pass: all leads share one exchange and one sort."""
    for lag in lag_times:
        _check(lag)
    w = Window.partitionBy("traj_id").orderBy("frame")
    df = assigns.where("state IS NOT NULL AND state <> -1").select("traj_id", "frame", "state")
    leads = F.array(*(F.struct(F.lit(lag).alias("lag"), F.lead("state", lag).over(w).cast("int").alias("j")) for lag in lag_times))
    df = df.select(F.col("state").cast("int").alias("i"), (F.row_number().over(w) - 1).alias("k"), leads.alias("leads"))
    df = df.select("i", "k", F.inline("leads")).where("j IS NOT NULL")
    df = df if sliding_window else df.where(F.col("k") % F.col("lag") == 0)
    return df.groupBy("lag", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


def state_transitions(assigns: DataFrame) -> DataFrame:
    """traj_id, frame of frames whose next state is another."""
    w = Window.partitionBy("traj_id").orderBy("frame")
    return assigns.withColumn("__next", F.lead("state").over(w)).where("__next <> state").select("traj_id", "frame")
