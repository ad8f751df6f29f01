"""Queries over round trips through files, jobs, estimators, path removal, dyes and structures."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import cli
from ..functions import fret, geometry, linalg, metrics
from ..operators import cards, dyes, exemplars, info, msm, tpt
from ..operators import clustering as cl
from ..operators import counts as tc
from ..operators import fret as fr
from ..operators import pockets as pk
from ..operators import ragged as rg
from ..operators import sampling
from ..sources import tables
from . import domain as dm
from . import q_info, q_model, q_space
from .domain import EM, EV, ORD, PTS, r9
from .shared import shared_dir

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def place(s, name):
    """A new folder below the shared one."""
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def cells(df, value="v"):
    return df.select(*[c for c in df.columns if c != value], r9(value).alias(value))


# --- ragged tables -------------------------------------------------------------------------------------------------

REFLECTED = {
    "rdiv": (lambda a: 7.0 / a, "CASE WHEN value = 0 THEN 'inf'::DOUBLE ELSE 7.0::DOUBLE / value END"),
    "rfloordiv": (lambda a: 700.0 // (a + 1), "floor(700.0::DOUBLE / (value + 1))::DOUBLE"),
    "rpow": (lambda a: 1.5 ** (a / 10), "pow(1.5::DOUBLE, value / 10)"),
    "rmod": (lambda a: 70.0 % (a + 1), "70.0::DOUBLE - (value + 1) * floor(70.0::DOUBLE / (value + 1))"),
}
for _name, (_f, _sql) in REFLECTED.items():

    def _run(s, d, f=_f):
        return f(rg.Ragged(dm.ev(s, d), "value")).df.select("traj_id", "frame", dm.r6(F.col("value").cast("double")).alias("v"))

    q(f"ragged_arith_{_name}", f"WITH {EV} SELECT traj_id, frame, CASE WHEN isfinite({_sql}) THEN round({_sql}, 6) + 0.0::DOUBLE ELSE {_sql} END AS v FROM ev")(_run)


@q("ragged_save_load", f"WITH {EV} SELECT traj_id, frame, state, value FROM ev WHERE frame % 3 = 0")
def _(s, d):
    path = place(s, "ragged")
    tables.save(dm.ev(s, d).select("traj_id", "frame", "state", "value"), path)
    return tables.load(path, stride=3, spark=s).select("traj_id", "frame", "state", "value")


@q("ragged_flat_round_trip", f"WITH {EV} SELECT traj_id, frame, state AS value FROM ev")
def _(s, d):
    path = place(s, "flat")
    tables.save_flat(rg.Ragged(dm.ev(s, d), "state"), path)
    return tables.load_flat(s, path).df.select("traj_id", "frame", "value")


@q("missing_assignments_round_trip", f"WITH {dm.EV_MISSING} SELECT traj_id, frame, state FROM evm")
def _(s, d):
    return tables.export_assignments(tables.load_assignments(dm.ev_missing(s, d))).select("traj_id", "frame", "state")


COORDS = f"{PTS}, co AS (SELECT frame::BIGINT AS traj_id, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS atom_id, px AS x, py AS y, pz AS z FROM pts)"


def coords(s, d):
    p = dm.points(s, d)
    atom = (F.row_number().over(Window.partitionBy("frame").orderBy("id")) - 1).cast("long")
    return p.select(F.col("frame").cast("long").alias("traj_id"), F.lit(0).cast("long").alias("frame"), atom.alias("atom_id"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))


@q("concatenate_trajectories", f"WITH {COORDS} SELECT CASE WHEN traj_id < 4 THEN traj_id + 6 ELSE traj_id - 4 END AS traj_id, atom_id, x FROM co WHERE atom_id IN (0, 3)")
def _(s, d):
    c = coords(s, d)
    late = c.where("traj_id >= 4").withColumn("traj_id", F.col("traj_id") - 4)
    return tables.concatenate([late, c.where("traj_id < 4")], atoms=[0, 3]).select("traj_id", "atom_id", "x")


@q("pdb_round_trip", f"WITH {COORDS} SELECT traj_id, 0::BIGINT AS frame, atom_id, CASE atom_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' ELSE 'C' END AS name, (atom_id // 3)::INT AS res_seq, x, y, z FROM co WHERE atom_id % 3 = 1 AND atom_id // 3 BETWEEN 0 AND 5")
def _(s, d):
    c = coords(s, d)
    name = F.element_at(F.array(F.lit("N"), F.lit("CA"), F.lit("C")), (F.col("atom_id") % 3 + 1).cast("int"))
    own = c.select(F.col("traj_id").alias("structure"), "atom_id", name.alias("name"), F.lit("ALA").alias("res_name"), F.lit("A").alias("chain"), F.floor(F.col("atom_id") / 3).cast("int").alias("res_seq"), "x", "y", "z", F.lit("C").alias("element"))
    path = place(s, "pdb")
    tables.write_pdb(own, path)
    atoms = tables.load_pdb(s, f"{path}/structure=*")
    found = tables.select_atoms(atoms, atoms, "name CA and resSeq 0 to 5")
    return found.select("traj_id", "frame", "atom_id", "name", "res_seq", *(F.round(k, 4).alias(k) for k in "xyz"))


def _put(s, path, data):
    """Bytes into a file of the shared file system."""
    jvm = s.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


@q("npy_features", "SELECT n_regionkey::BIGINT AS traj_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) * 2 AS frame, n_nationkey::DOUBLE AS a, (n_nationkey * 0.5)::DOUBLE AS b FROM nation QUALIFY (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) % 1 = 0")
def _(s, d):
    import io

    import numpy as np

    path = place(s, "npy")
    rows = dm.table(s, d, "nation").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()  # 25 rows at any size
    for region in sorted({r.n_regionkey for r in rows}):
        own = [[r.n_nationkey, r.n_nationkey * 0.5] for r in rows if r.n_regionkey == region]
        out = io.BytesIO()
        np.save(out, np.repeat(np.array(own), 2, axis=0))
        _put(s, f"{path}/{region}.npy", out.getvalue())
    x = tables.load_features(s, f"{path}/*.npy", stride=2)
    return x.select("traj_id", (F.col("frame") * 2).alias("frame"), F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


# --- models --------------------------------------------------------------------------------------------------------

C1 = q_model.C1
SIZE = "(SELECT count(DISTINCT i) FROM c)"


@q("trim_mapping_round_trip", q_model.REACH.format(threshold=60) + " SELECT original, mapped, true AS same FROM m")
def _(s, d):
    mapping, path = msm.TrimMapping(msm.trim_disconnected(q_model.absorbing(s, d), 60)[0]), place(s, "mapping")
    mapping.save(path)
    back = msm.TrimMapping.load(s, path)
    return back.df.withColumn("same", F.lit(back == mapping and back.to_original == {m: o for o, m in mapping.to_mapped.items()}))


@q("msm_round_trip", f"{C1}, {q_model.SYM} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v, true AS same FROM s")
def _(s, d):
    own, path = msm.MSM.from_assignments(dm.ev(s, d), lag_time=1, method="transpose"), place(s, "msm")
    own.save(path)
    back = msm.MSM.load(s, path)
    return cells(back.tprobs_).withColumn("same", F.lit(back == own and not back == msm.MSM(2, "transpose").fit(dm.ev(s, d))))


@q("msm_properties", f"{C1} SELECT {SIZE}::BIGINT AS n_states, 3 AS lag_time, 'normalize' AS method, true AS trim, false AS sliding_window, 'eq_probs_,mapping_,tcounts_,tprobs_' AS parts FROM c LIMIT 1")
def _(s, d):
    own = msm.MSM(3, "normalize", trim=True, sliding_window=False).fit(dm.ev(s, d))
    k = own.config
    row = (own.n_states_, k["lag_time"], k["method"], k["trim"], k["sliding_window"], ",".join(sorted(own.result_)))
    return s.createDataFrame([row], "n_states long, lag_time int, method string, trim boolean, sliding_window boolean, parts string")


def _times(lag):
    """Timescales of the symmetrised three-state model: its other eigenvalues from trace and determinant."""
    t = f"{dm.counts('ord', lag, name='c')}, {q_model.SYM}, t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM s), {q_model.DET}"
    return f"SELECT {lag} AS lag, k, CASE WHEN e > 0 THEN round(-{lag} / ln(e), 5) ELSE 'nan'::DOUBLE END AS timescale FROM (WITH {ORD}, {t} SELECT 0 AS k, tr / 2 + sqrt(tr * tr / 4 - det) AS e FROM x UNION ALL SELECT 1, tr / 2 - sqrt(tr * tr / 4 - det) FROM x)"


@q("implied_timescales_3state", " UNION ALL ".join(map(_times, (1, 2, 3))))
def _(s, d):
    out = msm.implied_timescales(dm.orders3(s, d), [1, 2, 3], "transpose", 2)
    return out.select("lag", "k", (F.round("timescale", 5) + 0.0).alias("timescale"))


@q("implied_job", f"SELECT lag, k, round(timescale * 2.5, 4) AS timescale FROM ({' UNION ALL '.join(map(_times, (1, 3)))})")
def _(s, d):
    src, out = place(s, "assignments"), place(s, "implied")
    dm.orders3(s, d).write.parquet(src)
    cli.run(s, ["implied", "--assignments", src, "--lag-times", "1:3:2", "--symmetrization", "transpose", "--n-eigenvalues", "2", "--timestep", "2.5", "--out", out])
    return s.read.parquet(out).select("lag", "k", (F.round("timescale", 4) + 0.0).alias("timescale"))


@q("prior_of_one_over_n", f"{C1}, {q_model.FULL} SELECT i, j, round((v + 0.2) / sum(v + 0.2) OVER (PARTITION BY i), 9) AS v FROM g")
def _(s, d):
    c = q_model.counts1(s, d)
    return cells(msm.normalize(c, 1.0 / msm.state_count(c), False)[1])


T5 = f"{dm.EV}, {dm.counts('ev')}, {q_model.SYM}, t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM s), pi AS (SELECT i, sum(v) / (SELECT sum(v) FROM s) AS p FROM s GROUP BY i)"


@q("mfpt_all_pairs", f"""WITH RECURSIVE {T5},
m AS (SELECT 0 AS n, a.i AS j, b.i, 0.0::DOUBLE AS v FROM pi a, pi b UNION ALL
      SELECT n + 1, m.j, t.i, CASE WHEN t.i = m.j THEN 0 ELSE 1 + sum(t.v * m.v) END FROM m JOIN t ON t.j = m.i WHERE n < 250 GROUP BY n, m.j, t.i)
SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM m WHERE n = 250""")
def _(s, d):
    return tpt.mfpts(msm.transpose(q_model.counts1(s, d))[1], n_states=5).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


NET5 = f"""{T5},
cq AS (SELECT 0 AS n, unnest(range(0, 5))::INT AS i, unnest([0.0, 0, 0, 0, 1])::DOUBLE AS v UNION ALL
       SELECT n + 1, t.i, CASE t.i WHEN 4 THEN 1 WHEN 0 THEN 0 ELSE sum(cq.v * t.v) END FROM cq JOIN t ON t.j = cq.i WHERE n < 200 GROUP BY n, t.i),
q AS (SELECT i, v AS q FROM cq WHERE n = 200),
fl AS (SELECT t.i, t.j, pi.p * (1 - qi.q) * t.v * qj.q AS v FROM t JOIN pi ON pi.i = t.i JOIN q qi ON qi.i = t.i JOIN q qj ON qj.i = t.j WHERE t.i <> t.j),
f0 AS (SELECT a.i, a.j, a.v - coalesce(b.v, 0) AS v FROM fl a LEFT JOIN fl b ON a.i = b.j AND a.j = b.i WHERE a.v - coalesce(b.v, 0) > 1e-12)"""


def _paths_sql(mode, ranks=3):
    """The widest simple path, taken out of the flux, so many times."""
    ctes = [NET5]
    for r in range(ranks):
        left = "f.v - b.flux" if mode == "subtract" else "f.v"
        ctes += [
            f"w{r} AS (SELECT [0] AS path, 'inf'::DOUBLE AS flux UNION ALL SELECT list_append(path, f.j), least(flux, f.v) FROM w{r} JOIN f{r} f ON f.i = path[-1] WHERE NOT list_contains(path, f.j) AND path[-1] <> 4 AND f.v > 0)",
            f"b{r} AS (SELECT path, flux FROM w{r} WHERE path[-1] = 4 ORDER BY flux DESC, len(path), path LIMIT 1)",
            f"e{r} AS (SELECT path[k] AS i, path[k + 1] AS j, flux FROM (SELECT path, flux, unnest(range(1, len(path))) AS k FROM b{r}))",
            f"f{r + 1} AS (SELECT f.i, f.j, CASE WHEN b.i IS NULL THEN f.v WHEN f.v = b.flux THEN 0 ELSE {left} END AS v FROM f{r} f LEFT JOIN e{r} b ON b.i = f.i AND b.j = f.j)",
        ]
    each = " UNION ALL ".join(f"SELECT {r} AS path_rank, (unnest(range(0, len(path))))::INT AS step, unnest(path) AS state, round(flux, 9) AS flux FROM b{r}" for r in range(ranks))
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + each


for _mode in ("subtract", "bottleneck"):
    q(f"top_paths_{_mode}", _paths_sql(_mode))(lambda s, d, mode=_mode: cells(tpt.paths([0], [4], q_model.net5(s, d), mode, num_paths=3, n_states=5), "flux"))


@q("absorb_labels", f"{C1}, {q_model.FULL}, dest AS (SELECT j FROM g WHERE i = 2 AND j <> 2 ORDER BY v DESC, j LIMIT 1) SELECT k AS state, (CASE WHEN k = 2 THEN (SELECT CASE WHEN j > 2 THEN j - 1 ELSE j END FROM dest) WHEN k > 2 THEN k - 1 ELSE k END)::INT AS label FROM ids")
def _(s, d):
    label = msm.absorb(linalg.gather(q_model.counts1(s, d), 5), [2])[1]
    return s.createDataFrame([(k, int(x)) for k, x in enumerate(label)], "state int, label int")


@q("checked_mi_matrix", f"WITH {dm.MI} SELECT fa AS i, fb AS j, round(mi, 9) + 0.0::DOUBLE AS v FROM mi")
def _(s, d):
    m = cells(q_info.matrix(s, d))
    info.check_symmetric(m)
    return m


# --- clustering ----------------------------------------------------------------------------------------------------

DIST, KEY = q_model.DIST, q_model.KEY


def _radius_sql(k, radius):
    ctes = [EM, "n0 AS MATERIALIZED (SELECT vec_id, x, 0 AS state, 'inf'::DOUBLE AS distance FROM em)"]
    for r in range(k):
        ctes.append(f"t{r} AS MATERIALIZED (SELECT x AS cx FROM (SELECT x, distance FROM n{r} ORDER BY distance DESC, vec_id LIMIT 1) WHERE distance > {radius})")
        ctes.append(f"n{r + 1} AS MATERIALIZED (SELECT vec_id, x, CASE WHEN d < distance THEN {r} ELSE state END AS state, CASE WHEN d < distance THEN d ELSE distance END AS distance FROM (SELECT n{r}.*, CASE WHEN cx IS NULL THEN NULL ELSE {DIST.format(a='x', b='cx')} END AS d FROM n{r} LEFT JOIN t{r} ON true))")
    return "WITH " + ", ".join(ctes) + f" SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM n{k}"


@q("kcenters_radius", _radius_sql(25, 1.2))
def _(s, d):
    return q_model.rounded(cl.kcenters(dm.em(s, d), "euclidean", 25, 1.2, key=KEY).assignments)


def _sweep_sql(start, centers, rounds):
    """PAM sweeps over proposals from a state (CTEs that end in p0 and c0)."""
    ctes, n = [start], 0
    for proposals in rounds:
        for k, v in enumerate(proposals):
            ctes += [
                f"prop{n} AS MATERIALIZED (SELECT x AS px FROM em WHERE vec_id = {v})",
                f"try{n} AS MATERIALIZED (SELECT state, CASE WHEN state = {k} THEN px ELSE cx END AS cx FROM c{n}, prop{n})",
                f"again{n} AS MATERIALIZED (SELECT p.vec_id, t.state, {DIST.format(a='p.x', b='t.cx')} AS again FROM p{n} p, try{n} t QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY again, t.state) = 1)",
                f"new{n} AS MATERIALIZED (SELECT p.vec_id, p.x, CASE WHEN d < p.distance THEN {k} WHEN p.state = {k} THEN a.state ELSE p.state END AS state, CASE WHEN d < p.distance THEN d WHEN p.state = {k} THEN a.again ELSE p.distance END AS distance FROM (SELECT *, {DIST.format(a='x', b='px')} AS d FROM p{n}, prop{n}) p JOIN again{n} a USING (vec_id))",
                f"ok{n} AS MATERIALIZED (SELECT (SELECT avg(distance * distance) FROM new{n}) < (SELECT avg(distance * distance) FROM p{n}) AS ok)",
                f"p{n + 1} AS MATERIALIZED (SELECT vec_id, x, state, distance FROM new{n} WHERE (SELECT ok FROM ok{n}) UNION ALL SELECT vec_id, x, state, distance FROM p{n} WHERE NOT (SELECT ok FROM ok{n}))",
                f"c{n + 1} AS MATERIALIZED (SELECT state, cx FROM try{n} WHERE (SELECT ok FROM ok{n}) UNION ALL SELECT state, cx FROM c{n} WHERE NOT (SELECT ok FROM ok{n}))",
            ]
            n += 1
    return "WITH " + ", ".join(ctes) + f" SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM p{n}"


def _near_start():
    return q_model.NEAR.removeprefix("WITH ") + ", c0 AS MATERIALIZED (SELECT state, cx FROM ce), p0 AS MATERIALIZED (SELECT e.vec_id, e.x, n.state, n.distance FROM near n JOIN em e USING (vec_id))"


def _kcenters_start(k):
    first = q_model._kcenters_sql(k).removeprefix("WITH ")
    return first + ", c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {r} AS state, cx FROM t{r}" for r in range(k)) + f"), p0 AS MATERIALIZED (SELECT vec_id, x, state, distance FROM n{k})"


HYBRID = [[7, 60, 200]]


def keyed(rounds):
    return [{k: (v,) for k, v in enumerate(p)} for p in rounds]


@q("khybrid_k3", _sweep_sql(_kcenters_start(3), 3, HYBRID))
def _(s, d):
    return q_model.rounded(cl.KHybrid("euclidean", 3, key=KEY, n_iters=1, proposals=keyed(HYBRID)).fit(dm.em(s, d)).result_.assignments)


SWEEPS = [[7, 60, 200, 400], [11, 90, 250, 300]]


def four_start(s, d):
    centers = s.createDataFrame([(k, v, x) for k, (v, x) in enumerate(zip([3, 50, 120, 333], q_model.four(s, d), strict=True))], "state int, vec_id long, x array<double>")
    return cl.ClusterResult(cl.assign_to_nearest_center(dm.em(s, d), q_model.four(s, d)).select("vec_id", "state", "distance"), centers)


@q("kmedoids_two_sweeps", _sweep_sql(_near_start(), 4, SWEEPS))
def _(s, d):
    own = cl.KMedoids("euclidean", key=KEY, n_iters=2, proposals=keyed(SWEEPS)).fit(dm.em(s, d), four_start(s, d))
    return q_model.rounded(own.result_.assignments)


@q("clusterer_parts", f"{q_model.KC} SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM n4")
def _(s, d):
    own = cl.KCenters("euclidean", 4, key=KEY).fit(dm.em(s, d))
    return q_model.rounded(own.labels_.join(own.distances_, KEY))


@q("clusterer_centers", q_model.KC.replace("SELECT x AS cx FROM n", "SELECT x AS cx, vec_id AS cid FROM n") + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {r} AS state, cid AS vec_id, round(cx[1], 9) + 0.0::DOUBLE AS x0 FROM t{r}" for r in range(4)) + ")")
def _(s, d):
    own = cl.KCenters("euclidean", 4, key=KEY).fit(dm.em(s, d))
    return own.center_indices_.join(own.centers_.select("state", F.round(F.col("x")[0], 9).alias("x0")), "state").select("state", "vec_id", (F.col("x0") + 0.0).alias("x0"))


@q("cluster_job", f"{q_model.KC} SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM n4")
def _(s, d):
    src, out = place(s, "features"), place(s, "clusters")
    dm.em(s, d).select(F.lit(0).cast("long").alias("traj_id"), F.col("vec_id").alias("frame"), "x").write.parquet(src)
    cli.run(s, ["cluster", "--features", src, "--algorithm", "kcenters", "--clusters", "4", "--out", out])
    again = place(s, "reassigned")
    cli.run(s, ["reassign", "--features", src, "--centers", f"{out}/centers", "--out", again])
    return q_model.rounded(s.read.parquet(again).join(s.read.parquet(f"{out}/assignments").select("traj_id", "frame", "state"), ["traj_id", "frame", "state"]).withColumnRenamed("frame", "vec_id"))


for _name, _sql in {
    "cosine": "1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))",
    "correlation": "1 - (avg(a * b) - avg(a) * avg(b)) / (stddev_pop(a) * stddev_pop(b))",
    "minkowski": "pow(sum(pow(abs(a - b), 3)), 1.0 / 3)",
}.items():

    def _run(s, d, name=_name):
        e = dm.em(s, d)
        both = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("x").alias("y"))))
        return both.select("vec_id", (F.round(metrics.metric(name)(F.col("x"), F.col("y")), 7) + 0.0).alias("d"))

    q(f"dist_{_name}", f"WITH {EM}, c AS (SELECT e.vec_id, unnest(e.x) AS a, unnest(o.x) AS b FROM em e, em o WHERE o.vec_id = 0) SELECT vec_id, round({_sql}, 7) + 0.0::DOUBLE AS d FROM c GROUP BY vec_id")(_run)


# --- rotamers ------------------------------------------------------------------------------------------------------

KINDS = f"""SELECT traj_id, feature, frame, state FROM ({q_info._two_basin(180, 0)}) WHERE feature = 0 UNION ALL
SELECT traj_id, feature, frame, state FROM ({q_info._two_basin(160, -100)}) WHERE feature = 1 UNION ALL
SELECT traj_id, 2, frame, state FROM ({q_info.CHI} SELECT traj_id, feature, frame, state FROM r) WHERE feature = 0"""


def kinds(s, d):
    a = dm.angles(s, d)
    kind = F.when(F.col("feature") == 0, "phi").otherwise("psi")
    return a.withColumn("kind", kind).unionByName(a.where("feature = 0").withColumn("feature", F.lit(2)).withColumn("kind", F.lit("chi")))


@q("all_rotamers", KINDS)
def _(s, d):
    return cards.RotamerFeaturizer(15).transform(kinds(s, d))


@q("entropy_job", f"WITH p AS (SELECT feature, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM ({KINDS}) GROUP BY feature, state) SELECT feature, round(-sum(p * ln(p)), 9) + 0.0::DOUBLE AS h FROM p GROUP BY feature")
def _(s, d):
    src, out = place(s, "angles"), place(s, "entropies")
    kinds(s, d).write.parquet(src)
    cli.run(s, ["entropy", "--angles", src, "--out", out])
    return cells(s.read.csv(out, header=True, schema="feature int, h double"), "h")


@q("cards_job", q_info.Q["cards_four_mi"][1])
def _(s, d):
    src, out = place(s, "angles"), place(s, "cards")
    dm.angles(s, d).withColumn("kind", F.lit("phi")).write.parquet(src)
    cli.run(s, ["cards", "--angles", src, "--out", out])
    found = None
    for name in ("struct_struct", "disorder_disorder", "struct_disorder", "disorder_struct"):
        a, b = name.split("_")
        own = cells(s.read.parquet(f"{out}/{name}"), "mi").select(F.lit(a[0] + b[0]).alias("kind"), "fa", "fb", "mi")
        found = own if found is None else found.unionByName(own)
    return found


# --- structures ----------------------------------------------------------------------------------------------------


def atoms_of(s, d):
    """Atoms of a chain from the points of one frame: residues of N, CA, C, O."""
    p = dm.points(s, d)
    k = F.row_number().over(Window.partitionBy("frame").orderBy("id")) - 1
    name = F.element_at(F.array(*map(F.lit, ("N", "CA", "C", "O"))), (F.col("k") % 4 + 1).cast("int"))
    return p.withColumn("k", k).select("frame", F.col("k").cast("long").alias("atom_id"), name.alias("name"), F.floor(F.col("k") / 4).cast("int").alias("res_seq"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))


ATOMS = f"{PTS}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS k FROM pts), am AS (SELECT frame, k AS atom_id, ['N', 'CA', 'C', 'O'][k % 4 + 1] AS name, (k // 4)::INT AS res_seq, px AS x, py AS y, pz AS z FROM k)"


@q("backbone_atoms", f"WITH {ATOMS} SELECT atom_id, (row_number() OVER (ORDER BY res_seq, atom_id) - 1)::INT AS k FROM am WHERE frame = 0 AND name <> 'O' AND res_seq BETWEEN 2 AND 6")
def _(s, d):
    return geometry.backbone(atoms_of(s, d).where("frame = 0"), [2, 3, 4, 5, 6]).select("atom_id", F.col("k").cast("int").alias("k"))


@q("ca_atoms", f"WITH {ATOMS} SELECT atom_id, (row_number() OVER (ORDER BY res_seq, atom_id) - 1)::INT AS k FROM am WHERE frame = 1 AND name = 'CA'")
def _(s, d):
    return geometry.backbone(atoms_of(s, d).where("frame = 1"), None, ("CA",)).select("atom_id", F.col("k").cast("int").alias("k"))


@q("find_atom", f"WITH {ATOMS} SELECT res_seq, min(atom_id) FILTER (name = 'C') AS c, min(atom_id) FILTER (name = 'ZZ') AS missing FROM am WHERE frame = 2 AND res_seq IN (1, 3) GROUP BY res_seq")
def _(s, d):
    own = atoms_of(s, d).where("frame = 2")
    rows = [(r, geometry.find_atom(own, r, "C"), geometry.find_atom(own, r, "ZZ")) for r in (1, 3)]
    return s.createDataFrame(rows, "res_seq int, c long, missing long")


@q("selected_atoms", f"WITH {ATOMS} SELECT frame, atom_id FROM am WHERE (name IN ('N', 'O') OR res_seq BETWEEN 3 AND 4) AND NOT (atom_id = 12)")
def _(s, d):
    a = atoms_of(s, d)
    return tables.select_atoms(a, a, "(name N O or resSeq 3 to 4) and not index 12").select("frame", "atom_id")


@q("b_factors", f"WITH {ATOMS}, r AS (SELECT a.res_seq, sqrt(avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS rmsf FROM am a JOIN am b ON b.frame = 0 AND b.atom_id = a.atom_id GROUP BY a.res_seq) SELECT atom_id, name, round(rmsf, 9) AS b_factor FROM am JOIN r USING (res_seq) WHERE frame = 0")
def _(s, d):
    a = atoms_of(s, d)
    found = geometry.b_factors(a.where("frame = 0"), geometry.rmsf(a, by="res_seq"))
    return found.select("atom_id", "name", F.round("b_factor", 9).alias("b_factor"))


@q("placed_points", f"WITH {q_space.VEC} SELECT vec_id, round(a_ * d_ + b_ * g_ + c_ * j_ + m_, 9) + 0.0::DOUBLE AS x, round(a_ * e_ + b_ * h_ + c_ * k_ + n_, 9) + 0.0::DOUBLE AS y, round(a_ * f_ + b_ * i_ + c_ * l_ + o_, 9) + 0.0::DOUBLE AS z FROM vs")
def _(s, d):
    e = q_space.emb(s, d)
    return q_space.parts(e.withColumn("t", geometry.placed(F.col("v0"), F.array("v1", "v2", "v3"), F.col("v4"))), "t")


@q("dye_parts", f"WITH {q_space.VEC} SELECT label AS frame, vec_id AS conformer, round(a_, 9) + 0.0::DOUBLE AS rx, round(d_, 9) + 0.0::DOUBLE AS ox, round(d_ - g_, 9) + 0.0::DOUBLE AS mx, round(f_ - i_, 9) + 0.0::DOUBLE AS mz FROM vs")
def _(s, d):
    e = q_space.emb(s, d)
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(v)[0].alias("px"), F.col(v)[1].alias("py"), F.col(v)[2].alias("pz")) for n, v in (("R1", "v0"), ("M1", "v1"), ("M2", "v2"))))
    placed = e.select(F.col("label").alias("frame"), F.col("vec_id").alias("conformer"), F.inline(rows))
    own = dyes.dipoles(placed, dyes.Dye(("name M1", "name M2"), "name R1"))
    return own.select("frame", "conformer", r9(F.col("centre")[0]).alias("rx"), r9(F.col("origin")[0]).alias("ox"), r9(F.col("dipole")[0]).alias("mx"), r9(F.col("dipole")[2]).alias("mz"))


@q("clear_conformers", f"WITH {PTS}, dy AS (SELECT frame, id // 40 AS conformer, id, px, py, pz FROM pts WHERE id % 2 = 0), pr AS (SELECT frame, px AS x, py AS y, pz AS z FROM pts WHERE id % 2 = 1), fr AS (SELECT frame, conformer, count(*) AS n FROM dy WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.frame = dy.frame AND (pr.x - px) ** 2 + (pr.y - py) ** 2 + (pr.z - pz) ** 2 < 0.36) GROUP BY ALL) SELECT frame, conformer FROM fr WHERE n >= 1")
def _(s, d):
    p = dm.points(s, d)
    dye = p.where("id % 2 = 0").withColumn("conformer", F.floor(F.col("id") / 40).cast("long"))
    protein = p.where("id % 2 = 1").select("frame", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.lit(0.5).alias("radius"))
    return fr.clear_conformers(dye, protein, 4, 0.1, 3, 0.5)


@q("clouds_as_structures", "WITH RECURSIVE " + q_space.CLUSTER.format(head=PTS, nodes="SELECT * FROM pts", reach="0.64", having="HAVING count(*) > 1") + " SELECT n.frame, row_number() OVER (PARTITION BY n.frame ORDER BY cluster, id) - 1 AS atom_id, cluster AS res_seq, px AS x FROM nodes n JOIN cm USING (id) JOIN sz ON sz.frame = n.frame AND sz.component = cm.component")
def _(s, d):
    found = pk.cluster_points(dm.points(s, d), 0.8, min_size=1)
    return pk.as_structures(found).select(F.col("structure").alias("frame"), "atom_id", "res_seq", "x")


# --- energy transfer -----------------------------------------------------------------------------------------------

QUANTITY = "qn AS (SELECT DISTINCT l_quantity AS x FROM lineitem)"


def quantity(s, d):
    return dm.table(s, d, "lineitem").select(F.col("l_quantity").alias("x")).distinct()


@q("fret_rates", f"WITH {QUANTITY} SELECT x, round(pow(5.2 / (x / 5 + 1), 6) / 4.1, 9) AS kret, round(0.92 / (x + 1), 9) AS krad, round(1 / (x + 1) - 0.92 / (x + 1), 9) AS knon FROM qn")
def _(s, d):
    rad, non = fret.radiative_rates(0.92, F.col("x") + 1)
    return quantity(s, d).select("x", F.round(fret.fret_rate(F.col("x") / 5 + 1, 5.2, 4.1), 9).alias("kret"), F.round(rad, 9).alias("krad"), F.round(non, 9).alias("knon"))


@q("exponential_decays", f"WITH {QUANTITY} SELECT x, round(3 * exp(-x / 4.1), 9) AS one, round(3 * exp(-x / 4.1) + 2 * exp(-x / 20), 9) AS two FROM qn")
def _(s, d):
    x = F.col("x")
    return quantity(s, d).select("x", F.round(fret.single_exp_decay(x, 3, 4.1), 9).alias("one"), F.round(fret.double_exp_decay(x, 3, 2, 4.1, 20), 9).alias("two"))


@q("burst_lifetimes", f"WITH e AS (SELECT user_id AS burst_id, value / 20 AS lifetime, {q_space.EVENTS} AS o FROM events) SELECT burst_id, round(avg((o = 'energy_transfer')::INT::DOUBLE), 9) AS efficiency, round(avg(lifetime) FILTER (o = 'energy_transfer'), 9) AS acceptor_lifetime, round(avg(lifetime) FILTER (o <> 'energy_transfer'), 9) AS donor_lifetime FROM e GROUP BY burst_id")
def _(s, d):
    e = dm.table(s, d, "events")
    drawn = e.join(q_space.dye_events(s, d).select("event_id", "lifetime", "outcome"), "event_id").withColumnRenamed("user_id", "burst_id")
    return fr.burst_lifetimes(drawn).select("burst_id", *(F.round(c, 9).alias(c) for c in ("efficiency", "acceptor_lifetime", "donor_lifetime")))


@q("protein_model_of_events", f"WITH {EV}, {dm.counts('ev')}, k AS (SELECT i, j, v FROM c WHERE i IN (0, 2, 3) AND j IN (0, 2, 3)) SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM k")
def _(s, d):
    seen = dm.ev(s, d).where("state IN (0, 2, 3)").select("state")
    return cells(dyes.protein_model(tc.assigns_to_counts(dm.ev(s, d)), seen, 5)[1])


@q("dye_table", "SELECT 'donor' AS type, n_name AS chromophore, n_nationkey * 1000.0::DOUBLE AS ext_coeff, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 25 END AS qd, n_regionkey + 0.5::DOUBLE AS td FROM nation")
def _(s, d):
    path = place(s, "dyes")
    n = dm.table(s, d, "nation")
    qd = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 25)
    n.select(F.lit("donor").alias("a"), "n_name", (F.col("n_nationkey") * 1000.0).alias("e"), qd.alias("q"), (F.col("n_regionkey") + 0.5).alias("t")).write.csv(path)
    return tables.load_dyes(s, path)


@q("spectra_table", f"WITH {q_space.SPECTRA} SELECT 'own' AS dye, wavelength, round(excitation, 6) AS excitation, round(emission, 6) AS emission FROM sp")
def _(s, d):
    path = place(s, "spectra")
    q_space.spectra(s, d).select(F.col("wavelength").alias("Wavelength"), F.col("excitation").alias("Excitation"), F.col("emission").alias("Emission")).coalesce(1).write.csv(path, header=True)
    return tables.load_spectra(s, path, "own").select("dye", "wavelength", F.round("excitation", 6).alias("excitation"), F.round("emission", 6).alias("emission"))


@q("dye_library", "SELECT r_name AS name, 'nobody' AS author, r_name || '.pdb' AS filename, 'C' || r_regionkey AS r, 'M1,M2' AS mu FROM region")
def _(s, d):
    path = place(s, "library")
    entry = F.concat(F.col("r_name"), F.lit(":\n  author: nobody\n  filename: "), F.col("r_name"), F.lit(".pdb\n  r: ["), F.concat(F.lit("C"), F.col("r_regionkey")), F.lit("]\n  mu: [M1, M2]\n  CB: [C9]"))
    dm.table(s, d, "region").select(entry.alias("value")).coalesce(1).write.text(path)
    return tables.load_dye_library(s, path).select("name", "author", "filename", F.array_join("r", ",").alias("r"), F.array_join("mu", ",").alias("mu"))



# --- what holds of random results, whatever was drawn ----------------------------------------------------------------


@q("bootstrap_draws", "WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT trial, n AS draws, true AS known FROM n, (SELECT unnest(range(0, 6)) AS trial)")
def _(s, d):
    e = dm.ev(s, d)
    w = sampling.bootstrap_weights(e, 6, 2)
    known = e.select("traj_id").distinct().withColumn("known", F.lit(True))
    return w.join(known, "traj_id", "left").groupBy("trial").agg(F.sum("times").cast("long").alias("draws"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


@q("bootstrap_rows_sum_to_one", f"WITH {EV}, {dm.counts('ev')} SELECT trial, i, 1.0::DOUBLE AS v FROM (SELECT DISTINCT i FROM c), (SELECT unnest(range(0, 5)) AS trial)")
def _(s, d):
    return cells(sampling.bootstrap_models(dm.ev(s, d), 1, 5, seed=3).groupBy("trial", "i").agg(F.sum("v").alias("v")))


@q("synthetic_trajectory_shape", f"WITH {EV}, {dm.counts('ev')} SELECT k AS traj_id, 50::BIGINT AS n, 2 AS first, true AS possible FROM (SELECT unnest(range(0, 20)) AS k)")
def _(s, d):
    t = msm.normalize(q_model.counts1(s, d), calculate_eq_probs=False)[1]
    own = sampling.synthetic_trajectories(t, 5, 20, 50, start_state=2, seed=1)
    step = own.withColumn("j", F.lead("state").over(Window.partitionBy("traj_id").orderBy("frame")))
    seen = step.join(t.where("v > 0").select(F.col("i").alias("state"), "j", F.lit(True).alias("ok")), ["state", "j"], "left")
    return seen.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("state", "frame").alias("first"), F.bool_and(F.coalesce("ok", F.col("j").isNull())).alias("possible"))


@q("burst_photons", f"WITH {q_space.PHOTONS} SELECT burst_id, count(*) AS n, true AS known FROM ph WHERE dt_us IS NOT NULL GROUP BY burst_id")
def _(s, d):
    own = q_space.Q["sample_bursts"][0](s, d)
    return own.groupBy("burst_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("state").between(0, 4)).alias("known"))


@q("drawn_distances_are_possible", f"WITH {EV} SELECT state, count(*) AS n, true AS possible FROM ev GROUP BY state")
def _(s, d):
    h = rg.make_distribution(fr.distance_histogram(*q_space.halves(s, d), 0.5), ["frame"]).withColumnRenamed("frame", "state")
    drawn = fr.sample_distances(dm.ev(s, d).select("traj_id", "frame", "state"), h, "state", ["traj_id", "frame"], 1)
    hit = drawn.withColumn("bin", F.floor(F.col("r") / 0.5).cast("int")).join(h.where("n > 0").select("state", "bin", F.lit(True).alias("ok")), ["state", "bin"], "left")
    return hit.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("possible"))


@q("drawn_events_gave_light", f"WITH {EV}, e AS (SELECT user_id % 40 AS state FROM events WHERE event_type <> 'error'), b AS (SELECT traj_id AS burst_id, event_id % 40 AS state FROM ev) SELECT burst_id, count(*) AS n, true AS light FROM b WHERE state IN (SELECT state FROM e) GROUP BY burst_id")
def _(s, d):
    bursts = dm.ev(s, d).select(F.col("traj_id").alias("burst_id"), F.col("frame").alias("k"), (F.col("event_id") % 40).alias("state"))
    own = fr.photon_events(bursts, q_space.dye_events(s, d), 3)
    return own.groupBy("burst_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("outcome") != "non_radiative").alias("light"))


@q("remade_histogram", "WITH h AS (SELECT floor(value / 10)::INT AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT bin, n FROM h")
def _(s, d):
    made = sampling.remake_from_histogram(metrics.histogram(dm.table(s, d, "events"), "value", 10.0), 4)
    return made.groupBy(F.floor(F.col("value") / 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@q("random_row_is_one", "SELECT 1::BIGINT AS n, true AS known")
def _(s, d):
    e = dm.ev(s, d).select("traj_id", "frame", "state")
    own = sampling.random_row(e, ["traj_id", "frame"], 5)
    return own.join(e, ["traj_id", "frame", "state"]).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 1).alias("known"))


@q("every_excitation_decays", "SELECT count(*) AS n, true AS positive, 3::BIGINT AS outcomes FROM events")
def _(s, d):
    own = q_space.Q["resolve_excitations"][0](s, d)
    return own.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("lifetime") > 0).alias("positive"), F.count_distinct("outcome").alias("outcomes"))


@q("bursts_are_shares", f"WITH {EV} SELECT traj_id AS burst_id, count(*) AS n, true AS share FROM ev GROUP BY traj_id")
def _(s, d):
    own = fr.burst_efficiencies(dm.ev(s, d).select(F.col("traj_id").alias("burst_id"), F.col("frame").alias("k"), (F.col("value") / 200).alias("e")), "e", 3)
    return own.select("burst_id", "n", F.col("efficiency").between(0, 1).alias("share"))


@q("medoids_are_members", "SELECT 3::BIGINT AS n, true AS at_zero, true AS nearest")
def _(s, d):
    own = cl.kmedoids(dm.em(s, d), "euclidean", 3, 1, KEY, seed=2)
    at = own.assignments.join(own.centers.select(F.col("state").alias("own"), "vec_id"), "vec_id")
    again = cl.assign_to_nearest_center(dm.em(s, d), own.centers.select("state", "x"))
    same = again.select("vec_id", F.col("distance").alias("least")).join(own.assignments, "vec_id").agg(F.bool_and(F.col("distance") <= F.col("least") + 1e-9).alias("nearest"))
    return at.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("state") == F.col("own")) & (F.col("distance") < 1e-9)).alias("at_zero")).crossJoin(same)


@q("exposon_labels", "SELECT residue, true AS grouped, true AS own, true AS best FROM (SELECT unnest(range(0, 4))::INT AS residue)")
def _(s, d):
    """Each residue is in a group, an exemplar is in its own, and no other exemplar tells more of a residue than its own."""
    mi = q_info.Q["exposed_sidechain_mi"][0](s, d)
    found = exemplars.affinity_propagation(mi.select(F.col("fa").alias("i"), F.col("fb").alias("k"), F.col("mi").alias("s")), 0.9, 0.0)
    named = found.where("i = exemplar").select(F.col("i").alias("fb"))
    most = mi.where("fa <> fb").join(named, "fb").groupBy(F.col("fa").alias("i")).agg(F.max("mi").alias("most"))
    mine = found.join(mi.select(F.col("fa").alias("i"), F.col("fb").alias("exemplar"), "mi"), ["i", "exemplar"], "left").join(most, "i", "left")
    labels = q_info.Q["exposons"][0](s, d).select(F.col("residue").alias("i"), (F.col("exposon") >= 0).alias("grouped"))
    stands = found.select(F.col("i").alias("exemplar"), (F.col("exemplar") == F.col("i")).alias("own"))
    best = (F.col("i") == F.col("exemplar")) | (F.col("mi") >= F.col("most") - 1e-9)
    return mine.join(stands, "exemplar").join(labels, "i").select(F.col("i").alias("residue"), "grouped", "own", best.alias("best"))


@q("exemplars_of_labels", "SELECT DISTINCT label, true AS own, true AS nearest FROM embeddings")
def _(s, d):
    """Labels by the distances of their means: an exemplar stands for itself, and no other exemplar is nearer to a label than its own."""
    e = dm.table(s, d, "embeddings")
    c = e.groupBy("label").agg(F.array(*(F.avg(F.col("embedding")[k].cast("double")) for k in range(8))).alias("x"))
    a, b = c.select(F.col("label").alias("i"), "x"), c.select(F.col("label").alias("k"), F.col("x").alias("y"))
    alike = a.join(b, F.col("i") != F.col("k")).select("i", "k", (-metrics.sqeuclidean(F.col("x"), F.col("y"))).alias("s"))
    found = exemplars.affinity_propagation(alike, 0.9)
    leaders = found.where("i = exemplar").select(F.col("i").alias("k"))
    most = alike.join(leaders, "k").groupBy("i").agg(F.max("s").alias("most"))
    mine = found.join(alike.withColumnRenamed("k", "exemplar"), ["i", "exemplar"], "left").join(most, "i", "left").join(leaders.withColumnRenamed("k", "exemplar").withColumn("own", F.lit(True)), "exemplar", "left")
    nearest = (F.col("i") == F.col("exemplar")) | (F.col("s") >= F.col("most") - 1e-9)
    return mine.select(F.col("i").alias("label"), F.coalesce("own", F.lit(False)).alias("own"), F.coalesce(nearest, F.lit(False)).alias("nearest"))


@q("superposed_rmsd_is_least", "SELECT vec_id, true AS least, vec_id = 0 AS self FROM embeddings")
def _(s, d):
    e = dm.table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 30).cast("array<double>").alias("x"))
    ref = e.where("vec_id = 0").select(F.col("x").alias("y"))
    both = e.crossJoin(F.broadcast(ref)).withColumn("rmsd", geometry.rmsd(F.col("x"), F.col("y")))
    plain = F.sqrt(metrics.sqeuclidean(F.col("x"), F.col("y")) / 10)
    return both.select("vec_id", (F.col("rmsd") <= plain + 1e-9).alias("least"), (F.col("rmsd") < 1e-6).alias("self"))
