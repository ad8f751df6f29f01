"""The driver's tables as trajectories, features and points, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(c: Column | str) -> Column:
    """Rounded to nine places, without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def r6(c: Column) -> Column:
    """Six places, without negative zeros, by a product as the SQL's round takes them: its last digit differs from that of decimal rounding in large numbers. Others stay as they are."""
    whole = c * 1e6
    return F.when(F.abs(whole) < float("inf"), F.round(whole) / 1e6 + 0.0).otherwise(c)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory per user: traj_id, frame, state (event type), and the event's columns."""
    e = table(spark, sf_dir, "events")
    state = F.coalesce(*(F.when(F.col("event_type") == s, k) for k, s in enumerate(STATES)))
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("traj_id"), frame.cast("long").alias("frame"), state.alias("state"), "value", "event_id", "ts", "props")


EV = """ev AS (
  SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS state,
         value, event_id, ts, props FROM events)"""


def ev_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ev, with every tenth event's state missing."""
    return ev(spark, sf_dir).withColumn("state", F.when(F.col("event_id") % 10 == 0, -1).otherwise(F.col("state")))


EV_MISSING = EV + """,
evm AS (SELECT traj_id, frame, CASE WHEN event_id % 10 = 0 THEN -1 ELSE state END AS state FROM ev)"""


def ev_absorbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories that leave the first two states for good from the third frame on: parts of the graph aren't strongly connected."""
    return ev(spark, sf_dir).withColumn("state", F.when((F.col("frame") >= 3) & (F.col("state") < 2), F.lit(2)).otherwise(F.col("state")))


EV_ABSORBING = EV + """,
eva AS (SELECT traj_id, frame, CASE WHEN frame >= 3 AND state < 2 THEN 2 ELSE state END AS state FROM ev)"""


def orders3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three states: a customer's orders by date."""
    o = table(spark, sf_dir, "orders")
    frame = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    state = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select(F.col("o_custkey").alias("traj_id"), frame.cast("long").alias("frame"), state.alias("state"))


ORD = """ord AS (
  SELECT o_custkey AS traj_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS state FROM orders)"""


def em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors: vec_id, label, x."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


EM = "em AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in space from the first components of a vector: id, frame (its label), px, py, pz."""
    e = table(spark, sf_dir, "embeddings")
    place = lambda k: F.round(e["embedding"][k].cast("double") * 10, 4)
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("frame"), place(0).alias("px"), place(1).alias("py"), place(2).alias("pz"))


PTS = "pts AS (SELECT vec_id AS id, label AS frame, round(embedding[1]::DOUBLE * 10, 4) AS px, round(embedding[2]::DOUBLE * 10, 4) AS py, round(embedding[3]::DOUBLE * 10, 4) AS pz FROM embeddings)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five discrete features of every frame: traj_id, frame, feature, state."""
    from ..operators.info import unpivot

    e = ev(spark, sf_dir)
    wide = e.select(
        "traj_id", "frame", "state",
        (F.hour("ts") % 4).alias("hour"),
        F.least(F.floor(F.col("value") / 25), F.lit(3)).cast("int").alias("size"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("k"),
        (F.col("event_id") % 3).cast("int").alias("id3"),
    )
    return unpivot(wide, ["state", "hour", "size", "k", "id3"])


N_STATES = {0: 5, 1: 4, 2: 4, 3: 4, 4: 3}
FEATURES = EV + """,
fx AS (
  SELECT traj_id, frame, unnest([0, 1, 2, 3, 4]) AS feature,
         unnest([state, (hour(ts) % 4)::INT, least(floor(value / 25), 3)::INT, (props->>'$.k')::INT % 4, (event_id % 3)::INT]) AS state FROM ev)"""
JOINT = FEATURES + """,
jc AS (SELECT a.feature AS fa, b.feature AS fb, a.state AS u, b.state AS v, count(*) AS n FROM fx a JOIN fx b USING (traj_id, frame) GROUP BY ALL)"""
MI = JOINT + """,
mi AS (
  SELECT fa, fb, greatest(sum(n / total * ln(n * total / (nu * nv))), 0.0) AS mi FROM (
    SELECT fa, fb, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY fa, fb))::DOUBLE AS total,
           (sum(n) OVER (PARTITION BY fa, fb, u))::DOUBLE AS nu, (sum(n) OVER (PARTITION BY fa, fb, v))::DOUBLE AS nv FROM jc) GROUP BY fa, fb)"""


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two angle series a trajectory: traj_id, feature, frame, angle."""
    e = ev(spark, sf_dir)
    both = F.array(*(F.struct(F.lit(k).alias("feature"), F.least(F.pmod(F.col("value") * m, F.lit(360.0)), F.lit(359.5)).alias("angle")) for k, m in enumerate((37.0, 53.0))))
    return e.select("traj_id", "frame", F.inline(both))


ANGLES = EV + """,
ang AS (SELECT traj_id, frame, unnest([0, 1]) AS feature, unnest([least(value * 37.0 % 360.0, 359.5), least(value * 53.0 % 360.0, 359.5)]) AS angle FROM ev)"""


def counts(df_sql: str, lag: int = 1, sliding: bool = True, name: str = "c", drop_missing: bool = False) -> str:
    """CTEs of transition counts (i, j, v) of a relation (traj_id, frame, state)."""
    keep = "WHERE state <> -1" if drop_missing else ""
    strided = "" if sliding else f"AND k % {lag} = 0"
    return f"""{name}_f AS (SELECT traj_id, state, row_number() OVER (PARTITION BY traj_id ORDER BY frame) - 1 AS k,
             lead(state, {lag}) OVER (PARTITION BY traj_id ORDER BY frame) AS nxt FROM (SELECT * FROM {df_sql} {keep})),
{name} AS (SELECT state AS i, nxt AS j, count(*)::DOUBLE AS v FROM {name}_f WHERE nxt IS NOT NULL {strided} GROUP BY state, nxt)"""
