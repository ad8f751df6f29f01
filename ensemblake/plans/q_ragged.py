"""Queries over ragged tables, sources and distances."""

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import ragged as rg
from . import domain as dm
from .domain import EM, EV, r9

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def values(s, d):
    return rg.Ragged(dm.ev(s, d), "value")


def states(s, d):
    return rg.Ragged(dm.ev(s, d), "state")


@q("ragged_lengths", f"WITH {EV} SELECT traj_id, count(*) AS n FROM ev GROUP BY traj_id")
def _(s, d):
    return states(s, d).lengths()


STARTS = "len AS (SELECT traj_id, count(*) AS n FROM ev GROUP BY traj_id), st AS (SELECT traj_id, n, coalesce(sum(n) OVER (ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM len)"


@q("ragged_starts", f"WITH {EV}, {STARTS} SELECT traj_id, n, start FROM st")
def _(s, d):
    return states(s, d).starts().select("traj_id", "n", "start")


@q("ragged_shape", f"WITH {EV}, {STARTS} SELECT count(*) AS n_rows, sum(n)::BIGINT AS n_values, CASE WHEN min(n) = max(n) THEN min(n) END AS n_columns FROM st")
def _(s, d):
    return states(s, d).shape()


@q("ragged_slice_2d", f"WITH {EV} SELECT traj_id, frame, state AS value FROM ev WHERE traj_id >= 10 AND traj_id < 100 AND (traj_id - 10) % 3 = 0 AND frame >= 2 AND frame < 20 AND (frame - 2) % 4 = 0")
def _(s, d):
    return states(s, d)[10:100:3, 2:20:4].df


@q("ragged_negative_stop", f"WITH {EV}, {STARTS} SELECT traj_id, frame, state AS value FROM ev JOIN len USING (traj_id) WHERE frame < n - 5")
def _(s, d):
    return states(s, d).select(cols=slice(None, -5)).df


@q("ragged_negative_column", f"WITH {EV}, {STARTS} SELECT traj_id, frame, state AS value FROM ev JOIN len USING (traj_id) WHERE frame = n - 1 OR frame = 0")
def _(s, d):
    return states(s, d).select(cols=[0, -1]).df


@q("ragged_stride", f"WITH {EV} SELECT traj_id, frame, state FROM ev WHERE frame % 7 = 0")
def _(s, d):
    from ..sources.tables import load

    return load(dm.ev(s, d), stride=7).select("traj_id", "frame", "state")


@q("ragged_load_keys", f"WITH {EV} SELECT traj_id, frame, state FROM ev WHERE traj_id IN (3, 5, 8) AND frame % 2 = 0")
def _(s, d):
    from ..sources.tables import load

    return load(dm.ev(s, d), keys=[3, 5, 8], stride=2).select("traj_id", "frame", "state")


@q("sound_trajectories", f"WITH {EV} SELECT traj_id, ceil(count(*) / 3.0)::BIGINT AS n FROM ev GROUP BY traj_id")
def _(s, d):
    from ..sources.tables import sound

    return sound(dm.ev(s, d), stride=3)


@q("ragged_mask_select", f"WITH {EV} SELECT traj_id, frame, state AS value FROM ev WHERE value > 50")
def _(s, d):
    return states(s, d)[values(s, d) > 50].df


@q("ragged_where", f"WITH {EV} SELECT traj_id, frame FROM ev WHERE state = 2")
def _(s, d):
    return (states(s, d) == 2).where()


@q("ragged_unique_states", "WITH " + dm.EV_MISSING + " SELECT DISTINCT state FROM evm WHERE state <> -1")
def _(s, d):
    return rg.unique_states(dm.ev_missing(s, d))


@q("ragged_set_where", f"WITH {EV} SELECT traj_id, frame, CASE WHEN frame < 3 THEN -1 ELSE state END AS value FROM ev")
def _(s, d):
    return states(s, d).set_where(F.col("frame") < 3, F.lit(-1)).df


ARITH = {
    "add": (lambda a, b: a + b, "value + state"),
    "sub": (lambda a, b: a - b, "value - state"),
    "rsub": (lambda a, b: 7 - a, "7 - value"),
    "mul": (lambda a, b: a * 2.5, "value * 2.5::DOUBLE"),
    "div": (lambda a, b: a / b, "CASE WHEN state = 0 THEN (CASE WHEN value > 0 THEN 'inf'::DOUBLE WHEN value < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END) ELSE value / state END"),
    "floordiv": (lambda a, b: a // 7, "floor(value / 7)::BIGINT"),
    "pow": (lambda a, b: a**2, "pow(value, 2)"),
    "mod": (lambda a, b: (a - 50) % 7, "(value - 50) - 7 * floor((value - 50) / 7)"),
}
for _name, (_f, _sql) in ARITH.items():
    _round = _name != "floordiv"

    def _run(s, d, f=_f, rounded=_round):
        out = f(values(s, d), states(s, d)).df
        return out.select("traj_id", "frame", (dm.r6(F.col("value").cast("double")) if rounded else F.col("value")).alias("v"))

    _col = f"CASE WHEN isfinite({_sql}) THEN round({_sql}, 6) + 0.0::DOUBLE ELSE {_sql} END" if _round else _sql
    q(f"ragged_arith_{_name}", f"WITH {EV} SELECT traj_id, frame, {_col} AS v FROM ev")(_run)


@q("ragged_cmp", f"WITH {EV} SELECT traj_id, frame, state < 2 AS lt, state <= 2 AS le, state > 2 AS gt, state >= 2 AS ge, state = 2 AS eq, state <> 2 AS ne FROM ev")
def _(s, d):
    e = dm.ev(s, d)
    own = rg.Ragged(e, "state")
    out = e.select("traj_id", "frame")
    # One pass: every comparison is an expression over the same rows.
    made = {"lt": own < 2, "le": own <= 2, "gt": own > 2, "ge": own >= 2, "eq": own == 2, "ne": own != 2}
    for n, t in made.items():
        out = out.join(t.df.withColumnRenamed("value", n), rg.KEY)
    return out


@q("ragged_bitops", f"WITH {EV} SELECT traj_id, frame, state & 3 AS a, state | 8 AS o, xor(state, 5) AS x, ~state AS n FROM ev")
def _(s, d):
    own = states(s, d)
    out = (own & 3).df.withColumnRenamed("value", "a")
    for n, t in {"o": own | 8, "x": own ^ 5, "n": ~own}.items():
        out = out.join(t.df.withColumnRenamed("value", n), rg.KEY)
    return out


@q("ragged_all_any_min_max", f"WITH {EV} SELECT bool_and(state <> 0) AS all_true, bool_or(state <> 0) AS any_true, min(state) AS min_value, max(state) AS max_value FROM ev")
def _(s, d):
    return states(s, d).aggregate()


@q("ragged_append", f"WITH {EV} SELECT traj_id, frame, state AS value FROM ev UNION ALL SELECT traj_id + (SELECT max(traj_id) + 1 FROM ev), frame, state FROM ev WHERE state = 1")
def _(s, d):
    own = states(s, d)
    return own.append(rg.Ragged(own.df.where("value = 1"))).df


@q("ragged_zeros_like", f"WITH {EV} SELECT traj_id, frame, 0 AS value FROM ev")
def _(s, d):
    return states(s, d).zeros_like().df


@q("ragged_flatten", f"WITH {EV}, {STARTS} SELECT start + frame AS flat, state AS value FROM ev JOIN st USING (traj_id)")
def _(s, d):
    return states(s, d).flatten()


@q("ragged_nested", f"WITH {EV} SELECT traj_id, array_to_string(list(state ORDER BY frame), ',') AS joined FROM ev GROUP BY traj_id")
def _(s, d):
    return states(s, d).to_nested().select("traj_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("joined"))


FLAT = "fl AS (SELECT event_id * 3 AS flat FROM events WHERE event_id % 2 = 0)"


@q("flat_to_ragged_index", f"WITH {EV}, {STARTS}, {FLAT} SELECT flat, traj_id, flat - start AS frame FROM fl JOIN st ON flat >= start AND flat < start + n")
def _(s, d):
    flat = dm.table(s, d, "events").where("event_id % 2 = 0").select((F.col("event_id") * 3).alias("flat"))
    return rg.partition_indices(flat, states(s, d).starts()).select("flat", "traj_id", "frame")


@q("ragged_to_flat_index", f"WITH {EV}, {STARTS} SELECT traj_id, frame, start + frame AS flat FROM ev JOIN st USING (traj_id) WHERE state = 3")
def _(s, d):
    own = dm.ev(s, d)
    return rg.to_flat(own.where("state = 3").select("traj_id", "frame"), states(s, d).starts()).select("traj_id", "frame", "flat")


@q("ragged_nonnegative", f"WITH {EV}, {STARTS} SELECT traj_id, n - 1 AS frame FROM st UNION ALL SELECT traj_id, 0 FROM st")
def _(s, d):
    n = states(s, d).lengths()
    asked = n.select("traj_id", F.explode(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))).alias("frame"))
    return rg.nonnegative(asked, n).select("traj_id", "frame")


@q("partition_by_lengths", "SELECT vec_id, (CASE WHEN vec_id < 100 THEN 0 WHEN vec_id < 350 THEN 1 ELSE 2 END)::BIGINT AS traj_id, vec_id - (CASE WHEN vec_id < 100 THEN 0 WHEN vec_id < 350 THEN 100 ELSE 350 END) AS frame FROM embeddings")
def _(s, d):
    e = dm.table(s, d, "embeddings").select("vec_id")
    return rg.partition_list(e, [100, 250, e.count() - 350], "vec_id").select("vec_id", "traj_id", "frame")


@q("divide_chunks", "SELECT vec_id, vec_id // 64 AS chunk FROM embeddings")
def _(s, d):
    return rg.divide_chunks(dm.table(s, d, "embeddings").select("vec_id"), "vec_id", 64)


@q("ragged_cartesian_pick", f"WITH {EV} SELECT traj_id, frame, state AS value FROM ev WHERE traj_id IN (1, 4, 9, 16) AND frame IN (0, 2, 30)")
def _(s, d):
    return states(s, d)[[1, 4, 9, 16], [0, 2, 30]].df


@q("load_frames_lookup", f"WITH {EV} SELECT k.traj_id, k.frame, ev.state FROM (SELECT DISTINCT user_id AS traj_id, event_id % 5 AS frame FROM events WHERE event_id % 11 = 0) k JOIN ev ON ev.traj_id = k.traj_id AND ev.frame = k.frame * 2")
def _(s, d):
    from ..sources.tables import load_frames

    keys = dm.table(s, d, "events").where("event_id % 11 = 0").select(F.col("user_id").alias("traj_id"), (F.col("event_id") % 5).alias("frame")).distinct()
    return load_frames(dm.ev(s, d), keys, stride=2).select("traj_id", "frame", "state")


@q("load_asymm_lookup", f"WITH {EV}, k AS (SELECT DISTINCT user_id AS traj_id, event_id % 7 AS frame FROM events WHERE event_id % 13 = 0) SELECT k.traj_id, k.frame, ev.state, n_name FROM k JOIN ev USING (traj_id, frame) JOIN nation ON n_nationkey = k.traj_id % 25")
def _(s, d):
    # Each trajectory has a topology of its own; all are looked up in one star join.
    from ..sources.tables import load_frames

    keys = dm.table(s, d, "events").where("event_id % 13 = 0").select(F.col("user_id").alias("traj_id"), (F.col("event_id") % 7).alias("frame")).distinct()
    own = load_frames(dm.ev(s, d), keys)
    return own.join(dm.table(s, d, "nation"), F.col("traj_id") % 25 == F.col("n_nationkey")).select("traj_id", "frame", "state", "n_name")


def _second(s, d):
    return dm.em(s, d).where("vec_id = 0").select(F.col("x").alias("y"))


for _name in ("euclidean", "manhattan", "chebyshev", "canberra", "braycurtis"):
    _sql = {
        "euclidean": "sqrt(sum((a - b) * (a - b)))",
        "manhattan": "sum(abs(a - b))",
        "chebyshev": "max(abs(a - b))",
        "canberra": "sum(CASE WHEN abs(a) + abs(b) > 0 THEN abs(a - b) / (abs(a) + abs(b)) ELSE 0 END)",
        "braycurtis": "sum(abs(a - b)) / sum(abs(a + b))",
    }[_name]

    def _run(s, d, name=_name):
        e = dm.em(s, d).crossJoin(F.broadcast(_second(s, d)))
        return e.select("vec_id", r9(metrics.metric(name)(F.col("x"), F.col("y"))).alias("d"))

    q(f"dist_{_name}", f"WITH {EM}, c AS (SELECT e.vec_id, unnest(e.x) AS a, unnest(o.x) AS b FROM em e, em o WHERE o.vec_id = 0) SELECT vec_id, round({_sql}, 9) + 0.0::DOUBLE AS d FROM c GROUP BY vec_id")(_run)

for _name, _sql in {"hamming": "avg((a <> b)::INT::DOUBLE)", "jaccard": "coalesce(sum((a <> b AND (a <> 0 OR b <> 0))::INT)::DOUBLE / nullif(sum((a <> 0 OR b <> 0)::INT), 0), 0)"}.items():

    def _run(s, d, name=_name):
        own = dm.em(s, d).select("vec_id", F.transform("x", lambda v: F.floor(v * 4)).alias("x"))
        e = own.crossJoin(F.broadcast(own.where("vec_id = 0").select(F.col("x").alias("y"))))
        return e.select("vec_id", r9(metrics.metric(name)(F.col("x"), F.col("y"))).alias("d"))

    q(f"dist_{_name}", f"WITH {EM}, c AS (SELECT e.vec_id, floor(unnest(e.x) * 4) AS a, floor(unnest(o.x) * 4) AS b FROM em e, em o WHERE o.vec_id = 0) SELECT vec_id, round({_sql}, 9) + 0.0::DOUBLE AS d FROM c GROUP BY vec_id")(_run)


@q("norm_vec", f"WITH {EM}, c AS (SELECT vec_id, unnest(x[1:3]) AS a, unnest([0, 1, 2]) AS k FROM em) SELECT vec_id, k, round(a / sqrt(sum(a * a) OVER (PARTITION BY vec_id)), 9) + 0.0::DOUBLE AS v FROM c")
def _(s, d):
    e = dm.em(s, d).select("vec_id", F.posexplode(metrics.norm_vec(F.slice("x", 1, 3))).alias("k", "v"))
    return e.select("vec_id", "k", r9("v").alias("v"))
