"""Queries over transition counts, Markov models, paths and clustering."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clustering as cl
from ..operators import counts as tc
from ..operators import msm, sampling, tpt
from . import domain as dm
from .domain import EM, EV, ORD, r9

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def cells(df, value="v"):
    return df.select(*[c for c in df.columns if c != value], r9(value).alias(value))


ROUND = "round(v, 9) + 0.0::DOUBLE AS v"
C1 = f"WITH {EV}, {dm.counts('ev')}"
FULL = "ids AS (SELECT unnest(range(0, 5))::INT AS k), g AS (SELECT a.k AS i, b.k AS j, coalesce(v, 0) AS v FROM ids a, ids b LEFT JOIN c ON c.i = a.k AND c.j = b.k)"

for _name, _lag, _sliding in (("lag1", 1, True), ("lag5", 5, True), ("strided", 4, False)):

    def _run(s, d, lag=_lag, sliding=_sliding):
        return tc.assigns_to_counts(dm.ev(s, d), lag, sliding)

    q(f"transition_counts_{_name}", f"WITH {EV}, {dm.counts('ev', _lag, _sliding)} SELECT i, j, v FROM c")(_run)


@q("transition_counts_missing", f"WITH {dm.EV_MISSING}, {dm.counts('evm', 2, drop_missing=True)} SELECT i, j, v FROM c")
def _(s, d):
    return tc.assigns_to_counts(dm.ev_missing(s, d), 2)


LAGS = [1, 2, 5, 10]


@q("transition_counts_multilag", f"WITH {EV}, " + ", ".join(dm.counts("ev", k, name=f"c{k}") for k in LAGS) + " " + " UNION ALL ".join(f"SELECT {k} AS lag, i, j, v FROM c{k}" for k in LAGS))
def _(s, d):
    return tc.counts_by_lag(dm.ev(s, d), LAGS)


@q("state_transitions", f"WITH {EV} SELECT traj_id, frame FROM ev QUALIFY lead(state) OVER (PARTITION BY traj_id ORDER BY frame) <> state")
def _(s, d):
    return tc.state_transitions(dm.ev(s, d))


def counts1(s, d):
    return tc.assigns_to_counts(dm.ev(s, d))


@q("tprob_normalize", f"{C1} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM c")
def _(s, d):
    return cells(msm.normalize(counts1(s, d), calculate_eq_probs=False)[1])


REACH_ALL = f"{C1} SELECT i AS original, i AS mapped FROM c GROUP BY i"
SYM = "s AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM c UNION ALL SELECT j, i, v FROM c) GROUP BY i, j)"


@q("tprob_transpose", f"{C1}, {SYM} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM s")
def _(s, d):
    return cells(msm.transpose(counts1(s, d))[1])


@q("counts_transpose", f"{C1}, {SYM} SELECT i, j, v / 2 AS v FROM s")
def _(s, d):
    return msm.transpose(counts1(s, d))[0]


@q("tprob_prior", f"{C1}, {FULL} SELECT i, j, round((v + 0.5) / sum(v + 0.5) OVER (PARTITION BY i), 9) AS v FROM g")
def _(s, d):
    return cells(msm.normalize(counts1(s, d), 0.5, False, 5)[1])


@q("eq_probs_transpose", f"{C1}, {SYM} SELECT i, round(sum(v) / (SELECT sum(v) FROM s), 9) AS v FROM s GROUP BY i")
def _(s, d):
    return cells(msm.transpose(counts1(s, d))[2])


# The fixed point of x_ij = (c_ij + c_ji) / (c_i / x_i + c_j / x_j), by its own iteration.
MLE = f"""WITH RECURSIVE {C1.removeprefix('WITH ')}, {FULL}, ri AS (SELECT i, sum(v) AS r FROM g GROUP BY i), bo AS (SELECT a.i, a.j, a.v + b.v AS s FROM g a JOIN g b ON a.i = b.j AND a.j = b.i),
x AS (SELECT 0 AS n, i, j, s AS x FROM bo UNION ALL
      SELECT n + 1, i, j, y / sum(y) OVER () FROM (
        SELECT x.n, x.i, x.j, bo.s / (p.r / sum(x.x) OVER (PARTITION BY x.i) + q.r / sum(x.x) OVER (PARTITION BY x.j)) AS y
        FROM x JOIN bo ON bo.i = x.i AND bo.j = x.j JOIN ri p ON p.i = x.i JOIN ri q ON q.i = x.j WHERE n < 300))
SELECT i, j, round(x / sum(x) OVER (PARTITION BY i), 9) AS v FROM x WHERE n = 300"""


@q("tprob_mle", MLE)
def _(s, d):
    return cells(msm.mle(counts1(s, d), n_states=5)[1])


@q("mle_detailed_balance", f"{C1} SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, 0.0::DOUBLE AS v FROM c WHERE i <> j")
def _(s, d):
    _, t, pi = msm.mle(counts1(s, d), n_states=5)
    flux = t.join(pi.withColumnRenamed("v", "p"), "i").select("i", "j", (F.col("p") * F.col("v")).alias("f"))
    back = flux.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("f").alias("g"))
    return flux.join(back, ["i", "j"]).where("i < j").select("i", "j", r9(F.col("f") - F.col("g")).alias("v"))


@q("msm_mapping", REACH_ALL)
def _(s, d):
    return msm.MSM(1, "transpose").fit(dm.ev(s, d)).mapping_.df


POWER = """WITH RECURSIVE {head}, t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM c),
p AS (SELECT 0 AS n, unnest(range(0, 5))::INT AS i, 0.2::DOUBLE AS v UNION ALL
      SELECT n + 1, t.j, sum(p.v * t.v) FROM p JOIN t USING (i) WHERE n < {steps} GROUP BY n, t.j)"""


@q("eq_probs_power", POWER.format(head=f"{EV}, {dm.counts('ev')}", steps=40) + f" SELECT i, {ROUND} FROM p WHERE n = 40")
def _(s, d):
    return cells(msm.eq_probs(msm.normalize(counts1(s, d), calculate_eq_probs=False)[1], 5))


@q("power_iteration", POWER.format(head=f"{EV}, {dm.counts('ev')}", steps=6) + f" SELECT i, {ROUND} FROM p WHERE n = 6")
def _(s, d):
    return cells(msm.power_iteration(msm.normalize(counts1(s, d), calculate_eq_probs=False)[1].cache(), 5, 6))


@q("synthetic_ensemble", POWER.format(head=f"{EV}, {dm.counts('ev')}", steps=4).replace("0.2::DOUBLE", "CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0 END").replace("unnest(range(0, 5))::INT AS i, CASE", "i, CASE").replace(" UNION ALL\n      SELECT n + 1", " FROM (SELECT unnest(range(0, 5))::INT AS i) UNION ALL\n      SELECT n + 1") + " SELECT n AS t, i, round(v, 9) + 0.0::DOUBLE AS p FROM p")
def _(s, d):
    t = msm.normalize(counts1(s, d), calculate_eq_probs=False)[1].cache()
    start = s.createDataFrame([(k, float(k == 0)) for k in range(5)], "i int, v double")
    return cells(msm.synthetic_ensemble(t, start, 5), "p")


REACH = f"""WITH RECURSIVE {dm.EV_ABSORBING}, {dm.counts('eva')},
e AS (SELECT i, j FROM c WHERE v >= {{threshold}}),
r AS (SELECT i, i AS j FROM (SELECT i FROM c UNION SELECT j FROM c) UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j),
label AS (SELECT a.i, min(a.j) AS l FROM r a JOIN r b ON a.i = b.j AND a.j = b.i GROUP BY a.i),
w AS (SELECT l, sum(coalesce(v, 0)) AS w FROM label LEFT JOIN c USING (i) GROUP BY l),
best AS (SELECT l FROM w ORDER BY w DESC, l LIMIT 1),
m AS (SELECT i AS original, (row_number() OVER (ORDER BY i) - 1)::INT AS mapped FROM label WHERE l = (SELECT l FROM best))"""


def absorbing(s, d):
    return tc.assigns_to_counts(dm.ev_absorbing(s, d)).cache()


@q("trim_mapping", REACH.format(threshold=1) + " SELECT original, mapped FROM m")
def _(s, d):
    return msm.trim_disconnected(absorbing(s, d))[0]


@q("trim_disconnected", REACH.format(threshold=1) + " SELECT a.mapped AS i, b.mapped AS j, v FROM c JOIN m a ON a.original = c.i JOIN m b ON b.original = c.j")
def _(s, d):
    return msm.trim_disconnected(absorbing(s, d))[1]


@q("trim_threshold", REACH.format(threshold=60) + " SELECT original, mapped FROM m")
def _(s, d):
    return msm.trim_disconnected(absorbing(s, d), 60)[0]


@q("trim_keep_numbers", REACH.format(threshold=1) + " SELECT a.original AS i, b.original AS j, v FROM c JOIN m a ON a.original = c.i JOIN m b ON b.original = c.j")
def _(s, d):
    return msm.trim_disconnected(absorbing(s, d), renumber_states=False)[1]


@q("msm_fit_trim", REACH.format(threshold=1) + ", k AS (SELECT a.mapped AS i, b.mapped AS j, v FROM c JOIN m a ON a.original = c.i JOIN m b ON b.original = c.j) SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM k")
def _(s, d):
    return cells(msm.MSM(1, "normalize", trim=True).fit(dm.ev_absorbing(s, d)).tprobs_)


T3 = f"{ORD}, {dm.counts('ord')}, {SYM}, t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM s), pi AS (SELECT i, sum(v) / (SELECT sum(v) FROM s) AS p FROM s GROUP BY i)"


def model3(s, d):
    return msm.transpose(tc.assigns_to_counts(dm.orders3(s, d)).cache())


DET = "x AS (SELECT sum(v) FILTER (i = j) - 1 AS tr, (SELECT {d} FROM (SELECT max(v) FILTER (i=0 AND j=0) a, max(v) FILTER (i=0 AND j=1) b, max(v) FILTER (i=0 AND j=2) c, max(v) FILTER (i=1 AND j=0) d, max(v) FILTER (i=1 AND j=1) e, max(v) FILTER (i=1 AND j=2) f, max(v) FILTER (i=2 AND j=0) g, max(v) FILTER (i=2 AND j=1) h, max(v) FILTER (i=2 AND j=2) k FROM t)) AS det FROM t)".format(d="a*(e*k-f*h)-b*(d*k-f*g)+c*(d*h-e*g)")


@q("eigenvalues_3state", f"WITH {T3}, {DET} SELECT 0 AS k, 1.0::DOUBLE AS v UNION ALL SELECT 1, round(tr / 2 + sqrt(tr * tr / 4 - det), 6) FROM x UNION ALL SELECT 2, round(tr / 2 - sqrt(tr * tr / 4 - det), 6) FROM x")
def _(s, d):
    values, _ = msm.eigenspectrum(model3(s, d)[1], n_states=3)
    return s.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "k int, v double")


@q("implied_timescales")
def _(s, d):
    return cells(msm.implied_timescales(dm.ev(s, d), [1, 2, 4], "transpose", 2), "timescale")


V3 = "v3 AS (SELECT max(v) FILTER (i=0 AND j=0) a, max(v) FILTER (i=0 AND j=1) b, max(v) FILTER (i=0 AND j=2) c, max(v) FILTER (i=1 AND j=0) d, max(v) FILTER (i=1 AND j=1) e, max(v) FILTER (i=1 AND j=2) f, max(v) FILTER (i=2 AND j=0) g, max(v) FILTER (i=2 AND j=1) h, max(v) FILTER (i=2 AND j=2) k FROM t)"
COM = f"WITH {T3}, {V3}, q AS (SELECT 0 AS i, 0.0::DOUBLE AS q UNION ALL SELECT 1, f / (1 - e) FROM v3 UNION ALL SELECT 2, 1.0)"


@q("committors_3state", f"{COM} SELECT i, round(q, 9) + 0.0::DOUBLE AS v FROM q")
def _(s, d):
    return cells(tpt.committors(model3(s, d)[1], [0], [2], 3))


@q("mfpt_to_sink_3state", f"WITH {T3}, {V3} SELECT 0 AS i, round(((1 - e) + b) / ((1 - a) * (1 - e) - b * d), 6) AS v FROM v3 UNION ALL SELECT 1, round(((1 - a) + d) / ((1 - a) * (1 - e) - b * d), 6) FROM v3 UNION ALL SELECT 2, 0.0")
def _(s, d):
    return tpt.mfpts(model3(s, d)[1], [2], n_states=3).select("i", (F.round("v", 6) + 0.0).alias("v"))


FLUX = f"{COM}, fl AS (SELECT t.i, t.j, pi.p * (1 - qi.q) * t.v * qj.q AS v FROM t JOIN pi ON pi.i = t.i JOIN q qi ON qi.i = t.i JOIN q qj ON qj.i = t.j WHERE t.i <> t.j)"


@q("reactive_flux", f"{FLUX} SELECT i, j, {ROUND} FROM fl")
def _(s, d):
    _, t, pi = model3(s, d)
    return cells(tpt.reactive_fluxes(t, [0], [2], pi))


NET = f"{FLUX}, net AS (SELECT a.i, a.j, a.v - coalesce(b.v, 0) AS v FROM fl a LEFT JOIN fl b ON a.i = b.j AND a.j = b.i WHERE a.v - coalesce(b.v, 0) > 0)"


@q("net_flux", f"{NET} SELECT i, j, {ROUND} FROM net WHERE v > 1e-12")
def _(s, d):
    _, t, pi = model3(s, d)
    return cells(tpt.net_fluxes(t, [0], [2], pi).where("v > 1e-12"))


@q("reactive_populations", f"{COM} SELECT i, round(m / sum(m) OVER (), 9) + 0.0::DOUBLE AS v FROM (SELECT i, p * q * (1 - q) AS m FROM pi JOIN q USING (i))")
def _(s, d):
    _, t, pi = model3(s, d)
    return cells(tpt.reactive_populations(t, [0], [2], pi))


@q("committors_iterated", f"""WITH RECURSIVE {EV}, {dm.counts('ev')}, t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM c),
p AS (SELECT 0 AS n, unnest(range(0, 5))::INT AS i, unnest([0.0, 0, 0, 0, 1])::DOUBLE AS v UNION ALL
      SELECT n + 1, t.i, CASE t.i WHEN 4 THEN 1 WHEN 0 THEN 0 ELSE sum(p.v * t.v) END FROM p JOIN t ON t.j = p.i WHERE n < 8 GROUP BY n, t.i)
SELECT i, {ROUND} FROM p WHERE n = 8""")
def _(s, d):
    t = msm.normalize(counts1(s, d), calculate_eq_probs=False)[1].cache()
    return cells(tpt.committors_iterated(t, [0], [4], 8))


@q("committors_5state", f"""WITH RECURSIVE {EV}, {dm.counts('ev')}, t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM c),
p AS (SELECT 0 AS n, unnest(range(0, 5))::INT AS i, unnest([0.0, 0, 0, 0, 1])::DOUBLE AS v UNION ALL
      SELECT n + 1, t.i, CASE t.i WHEN 4 THEN 1 WHEN 0 THEN 0 ELSE sum(p.v * t.v) END FROM p JOIN t ON t.j = p.i WHERE n < 90 GROUP BY n, t.i)
SELECT i, {ROUND} FROM p WHERE n = 90""")
def _(s, d):
    return cells(tpt.committors(msm.normalize(counts1(s, d), calculate_eq_probs=False)[1], [0], [4], 5))


# A path's flux is the smallest on its edges; the best path is that of the largest, then the shortest, then the first.
@q("top_path", f"""WITH RECURSIVE {NET.removeprefix('WITH ')},
w AS (SELECT [0] AS path, 'inf'::DOUBLE AS flux UNION ALL SELECT list_append(path, net.j), least(flux, net.v) FROM w JOIN net ON net.i = path[-1] WHERE NOT list_contains(path, net.j) AND path[-1] <> 2 AND net.v > 1e-12),
best AS (SELECT path, flux FROM w WHERE path[-1] = 2 ORDER BY flux DESC, len(path), path LIMIT 1)
SELECT 0 AS path_rank, (unnest(range(0, len(path))))::INT AS step, unnest(path) AS state, round(flux, 9) AS flux FROM best""")
def _(s, d):
    _, t, pi = model3(s, d)
    net = tpt.net_fluxes(t, [0], [2], pi).where("v > 1e-12")
    return cells(tpt.paths([0], [2], net, num_paths=1, n_states=3), "flux")


def net5(s, d):
    _, t, pi = msm.transpose(counts1(s, d))
    return tpt.net_fluxes(t, [0], [4], pi).where("v > 1e-12")


@q("i_minus_q", f"{C1}, {FULL}, t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM g) SELECT i, j, round(CASE WHEN i IN (0, 4) OR j IN (0, 4) THEN (i = j)::INT ELSE (i = j)::INT - v END, 9) + 0.0::DOUBLE AS v FROM t")
def _(s, d):
    return cells(tpt.i_minus_q(msm.normalize(counts1(s, d), calculate_eq_probs=False)[1], [0, 4], 5))


SCORE = f"{C1}, {FULL}, h AS (SELECT i, j, v + 0.2 AS v FROM g), w AS (SELECT i, sum(v) AS w FROM h GROUP BY i)"


@q("bace_pseudo_scores", f"{SCORE} SELECT i, round(sum(0.2 * ln(0.2 / ((v + 0.2) / (w + 1))) + v * ln(v / w / ((v + 0.2) / (w + 1)))), 6) AS v FROM h JOIN w USING (i) GROUP BY i")
def _(s, d):
    return msm.pseudo_scores(counts1(s, d), 5).select("i", (F.round("v", 6) + 0.0).alias("v"))


@q("bace_pair_scores", f"""{SCORE}, p AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM c WHERE v > 1 AND i <> j)
SELECT p.i, p.j, round(sum(a.v * ln(a.v / wa.w / ((a.v + b.v) / (wa.w + wb.w))) + b.v * ln(b.v / wb.w / ((a.v + b.v) / (wa.w + wb.w)))), 6) AS v
FROM p JOIN h a ON a.i = p.i JOIN h b ON b.i = p.j AND b.j = a.j JOIN w wa ON wa.i = p.i JOIN w wb ON wb.i = p.j GROUP BY p.i, p.j""")
def _(s, d):
    return msm.pair_scores(counts1(s, d), 5).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@q("bace_levels")
def _(s, d):
    """A user's events in order of value instead of time, states their bands of value: they pass from band to band, and neighbours merge first."""
    e = dm.table(s, d, "events").where("value is not null")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")) - 1
    states = e.select(F.col("user_id").alias("traj_id"), frame.cast("long").alias("frame"), F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int").alias("state"))
    factors, labels = msm.bace(tc.assigns_to_counts(states, 1), 2)
    return s.createDataFrame([(n, k, int(x), round(factors[n], 6)) for n, own in labels.items() for k, x in enumerate(own)], "n int, state int, label int, factor double")


@q("absorb_state", f"""{C1}, {FULL}, dest AS (SELECT j FROM g WHERE i = 2 AND j <> 2 ORDER BY v DESC, j LIMIT 1)
SELECT CASE WHEN i = 2 THEN (SELECT j FROM dest) ELSE i END AS i, CASE WHEN j = 2 THEN (SELECT j FROM dest) ELSE j END AS j, sum(v) AS v FROM g GROUP BY 1, 2 HAVING sum(v) > 0""")
def _(s, d):
    from ..functions import linalg

    return linalg.scatter(s, msm.absorb(linalg.gather(counts1(s, d), 5), [2])[0])


DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _kcenters_sql(k):
    ctes = [EM, "n0 AS (SELECT vec_id, x, 0 AS state, 'inf'::DOUBLE AS distance FROM em)"]
    for r in range(k):
        ctes.append(f"t{r} AS (SELECT x AS cx FROM n{r} ORDER BY distance DESC, vec_id LIMIT 1)")
        ctes.append(f"m{r} AS (SELECT vec_id, x, state, distance, {DIST.format(a='x', b='cx')} AS d FROM n{r}, t{r})")
        ctes.append(f"n{r + 1} AS (SELECT vec_id, x, CASE WHEN d < distance THEN {r} ELSE state END AS state, least(d, distance) AS distance FROM m{r})")
    return "WITH " + ", ".join(ctes)


KEY = ["vec_id"]
KC = _kcenters_sql(4)


def rounded(a):
    return a.select("vec_id", "state", r9("distance").alias("distance"))


@q("kcenters_k4", f"{KC} SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM n4")
def _(s, d):
    return rounded(cl.kcenters(dm.em(s, d), "euclidean", 4, key=KEY).assignments)


@q("kcenters_triangle", f"{KC} SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM n4")
def _(s, d):
    return rounded(cl.kcenters(dm.em(s, d), "euclidean", 4, key=KEY, use_triangle_inequality=True).assignments)


def four(s, d):
    return [list(r.x) for r in dm.em(s, d).where("vec_id IN (3, 50, 120, 333)").orderBy("vec_id").collect()]


NEAR = f"WITH {EM}, ce AS (SELECT x AS cx, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS state FROM em WHERE vec_id IN (3, 50, 120, 333)), dd AS (SELECT vec_id, state, {DIST.format(a='x', b='cx')} AS distance FROM em, ce), near AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, state) = 1)"


@q("assign_nearest_center", f"{NEAR} SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM near")
def _(s, d):
    return rounded(cl.assign_to_nearest_center(dm.em(s, d), four(s, d)))


@q("reassign_full", f"{NEAR} SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM near")
def _(s, d):
    centers = s.createDataFrame(list(enumerate(four(s, d))), "state int, x array<double>")
    return rounded(cl.reassign(dm.em(s, d), centers, "euclidean"))


@q("cluster_sizes", f"{NEAR} SELECT state, count(*) AS n FROM near GROUP BY state")
def _(s, d):
    return cl.assign_to_nearest_center(dm.em(s, d), four(s, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@q("cluster_centers_argmin", f"{NEAR}, lab AS (SELECT n.vec_id, e.label AS state, n.distance FROM near n JOIN em e USING (vec_id)) SELECT state, vec_id, round(distance, 9) + 0.0::DOUBLE AS distance FROM lab QUALIFY row_number() OVER (PARTITION BY state ORDER BY distance, vec_id) = 1")
def _(s, d):
    own = cl.assign_to_nearest_center(dm.em(s, d), four(s, d)).withColumn("state", F.col("label"))
    return cl.find_cluster_centers(own, KEY).select("state", "vec_id", r9("distance").alias("distance"))


@q("save_states_top1", f"{NEAR} SELECT state, 0 AS rank, vec_id, round(distance, 9) + 0.0::DOUBLE AS distance FROM near WHERE distance > -0.1 QUALIFY row_number() OVER (PARTITION BY state ORDER BY distance, vec_id) = 1")
def _(s, d):
    own = cl.assign_to_nearest_center(dm.em(s, d), four(s, d))
    return cl.pick_states(own, KEY).select("state", "rank", "vec_id", r9("distance").alias("distance"))


@q("pam_cost", f"{NEAR} SELECT round(avg(distance * distance), 9) AS cost FROM near")
def _(s, d):
    return cl.pam_cost(cl.assign_to_nearest_center(dm.em(s, d), four(s, d))).select(r9("cost").alias("cost"))


PROPOSALS = [7, 60, 200, 400]


def _pam_sql():
    ctes = [NEAR.removeprefix("WITH "), "c0 AS (SELECT state, cx FROM ce)", "p0 AS (SELECT e.vec_id, e.x, n.state, n.distance FROM near n JOIN em e USING (vec_id))"]
    for k, v in enumerate(PROPOSALS):
        ctes += [
            f"prop{k} AS (SELECT x AS px FROM em WHERE vec_id = {v})",
            f"try{k} AS (SELECT state, CASE WHEN state = {k} THEN px ELSE cx END AS cx FROM c{k}, prop{k})",
            f"again{k} AS (SELECT p.vec_id, t.state, {DIST.format(a='p.x', b='t.cx')} AS again FROM p{k} p, try{k} t QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY again, t.state) = 1)",
            f"new{k} AS (SELECT p.vec_id, p.x, CASE WHEN d < p.distance THEN {k} WHEN p.state = {k} THEN a.state ELSE p.state END AS state, CASE WHEN d < p.distance THEN d WHEN p.state = {k} THEN a.again ELSE p.distance END AS distance FROM (SELECT *, {DIST.format(a='x', b='px')} AS d FROM p{k}, prop{k}) p JOIN again{k} a USING (vec_id))",
            f"ok{k} AS (SELECT (SELECT avg(distance * distance) FROM new{k}) < (SELECT avg(distance * distance) FROM p{k}) AS ok)",
            f"p{k + 1} AS (SELECT vec_id, x, state, distance FROM new{k} WHERE (SELECT ok FROM ok{k}) UNION ALL SELECT vec_id, x, state, distance FROM p{k} WHERE NOT (SELECT ok FROM ok{k}))",
            f"c{k + 1} AS (SELECT state, cx FROM try{k} WHERE (SELECT ok FROM ok{k}) UNION ALL SELECT state, cx FROM c{k} WHERE NOT (SELECT ok FROM ok{k}))",
        ]
    return "WITH " + ", ".join(ctes) + f" SELECT vec_id, state, round(distance, 9) + 0.0::DOUBLE AS distance FROM p{len(PROPOSALS)}"


@q("kmedoids_pam_sweep", _pam_sql())
def _(s, d):
    e = dm.em(s, d)
    centers = s.createDataFrame([(k, v, x) for k, (v, x) in enumerate(zip([3, 50, 120, 333], four(s, d)))], "state int, vec_id long, x array<double>")
    start = cl.ClusterResult(cl.assign_to_nearest_center(e, four(s, d)).select("vec_id", "state", "distance"), centers)
    return rounded(cl.pam_sweep(e, start, "euclidean", KEY, {k: (v,) for k, v in enumerate(PROPOSALS)}).assignments)


@q("kmedoids_random")
def _(s, d):
    return rounded(cl.kmedoids(dm.em(s, d), "euclidean", 3, 1, KEY, seed=2).assignments)


@q("bootstrap_models")
def _(s, d):
    return cells(sampling.bootstrap_models(dm.ev(s, d), 1, 5, seed=3))


@q("synthetic_trajectories")
def _(s, d):
    t = msm.normalize(counts1(s, d), calculate_eq_probs=False)[1]
    return sampling.synthetic_trajectories(t, 5, 20, 50, seed=1)


@q("random_row")
def _(s, d):
    return sampling.random_row(dm.ev(s, d).select("traj_id", "frame", "state"), ["traj_id", "frame"], 5)
