"""Queries over information theory, rotamers and disorder."""

from pyspark.sql import functions as F

from ..operators import cards, info, msm
from ..operators import counts as tc
from . import domain as dm
from .domain import ANGLES, EV, FEATURES, JOINT, MI, N_STATES, r9

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def cells(df, value="v"):
    return df.select(*[c for c in df.columns if c != value], r9(value).alias(value))


@q("joint_counts", f"WITH {JOINT} SELECT fa, fb, u, v, n FROM jc")
def _(s, d):
    return info.joint_counts(dm.features(s, d))


@q("joint_counts_two_sets", f"WITH {FEATURES} SELECT a.feature AS fa, b.feature AS fb, a.state AS u, b.state AS v, count(*) AS n FROM fx a JOIN fx b USING (traj_id, frame) WHERE a.feature < 2 AND b.feature >= 2 GROUP BY ALL")
def _(s, d):
    x = dm.features(s, d)
    return info.joint_counts(x.where("feature < 2"), x.where("feature >= 2"))


@q("mutual_information", f"WITH {MI} SELECT fa, fb, round(mi, 9) + 0.0::DOUBLE AS mi FROM mi")
def _(s, d):
    return cells(info.mutual_information(info.joint_counts(dm.features(s, d))), "mi")


NST = "[5, 4, 4, 4, 3]"


@q("mi_channel_capacity", f"WITH {MI} SELECT fa, fb, round(mi / ln(least({NST}[fa + 1], {NST}[fb + 1])), 9) + 0.0::DOUBLE AS mi FROM mi")
def _(s, d):
    return cells(info.mi_matrix(dm.features(s, d), None, N_STATES), "mi")


WMI = FEATURES + """,
wx AS (SELECT fx.*, ev.value AS w FROM fx JOIN ev USING (traj_id, frame)),
wj AS (SELECT a.feature AS fa, b.feature AS fb, a.state AS u, b.state AS v, sum(a.w) AS n FROM wx a JOIN wx b USING (traj_id, frame) GROUP BY ALL),
wm AS (SELECT *, sum(n) OVER (PARTITION BY fa, fb) AS total, sum(n) OVER (PARTITION BY fa, fb, u) AS nu, sum(n) OVER (PARTITION BY fa, fb, v) AS nv FROM wj WHERE n > 0)"""


@q("weighted_mi", f"WITH {WMI} SELECT fa, fb, round(greatest(sum(n / total * ln(n * total / (nu * nv))), 0.0), 9) + 0.0::DOUBLE AS mi FROM wm GROUP BY fa, fb")
def _(s, d):
    x = dm.features(s, d).join(dm.ev(s, d).select("traj_id", "frame", F.col("value").alias("w")), ["traj_id", "frame"])
    return cells(info.weighted_mi(x, "w", N_STATES, normalize=False), "mi")


def matrix(s, d):
    mi = info.mutual_information(info.joint_counts(dm.features(s, d)))
    return mi.select(F.col("fa").alias("i"), F.col("fb").alias("j"), F.col("mi").alias("v")).cache()


M = MI + ", m AS (SELECT fa AS i, fb AS j, mi AS v FROM mi), h AS (SELECT i, v AS h FROM m WHERE i = j), ap AS (SELECT a.i, b.j, sum(a.v * b.v) / 25 AS a FROM m a JOIN m b ON a.j = b.i GROUP BY a.i, b.j)"


@q("apc", f"WITH {M} SELECT i, j, round(a, 9) + 0.0::DOUBLE AS v FROM ap")
def _(s, d):
    return cells(info.apc(matrix(s, d), 5))


@q("nmi", f"WITH {M} SELECT m.i, m.j, round(CASE WHEN m.i = m.j THEN 1 ELSE coalesce(v / nullif(a.h + b.h - v, 0), 0) END, 9) + 0.0::DOUBLE AS v FROM m JOIN h a ON a.i = m.i JOIN h b ON b.i = m.j")
def _(s, d):
    return cells(info.nmi(matrix(s, d)))


@q("nmi_apc", f"WITH {M} SELECT m.i, m.j, round((v - ap.a) / (CASE WHEN m.i = m.j THEN v ELSE a.h + b.h - v END), 7) + 0.0::DOUBLE AS v FROM m JOIN h a ON a.i = m.i JOIN h b ON b.i = m.j JOIN ap ON ap.i = m.i AND ap.j = m.j")
def _(s, d):
    return info.nmi_apc(matrix(s, d), 5).select("i", "j", (F.round("v", 7) + 0.0).alias("v"))


@q("feature_entropies", f"WITH {FEATURES}, p AS (SELECT feature, state, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM fx GROUP BY feature, state) SELECT feature, round(-sum(p * ln(p)), 9) + 0.0::DOUBLE AS h FROM p GROUP BY feature")
def _(s, d):
    return cells(info.feature_entropies(dm.features(s, d)), "h")


@q("shannon_entropy_plain", f"WITH {FEATURES}, p AS (SELECT feature, state, count(*) / 20000.0 AS p FROM fx GROUP BY feature, state) SELECT feature, round(-sum(p * ln(p)), 9) + 0.0::DOUBLE AS h FROM p GROUP BY feature")
def _(s, d):
    p = dm.features(s, d).groupBy("feature", "state").agg((F.count(F.lit(1)) / 20000.0).alias("p"))
    return cells(info.shannon_entropy(p, "p", ["feature"], normalize=False), "h")


@q("residue_entropies", f"WITH {FEATURES}, p AS (SELECT feature, state, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM fx GROUP BY feature, state), e AS (SELECT feature, -sum(p * ln(p)) AS h FROM p GROUP BY feature), r AS (SELECT feature // 2 AS residue, sum(h) AS h, sum(ln({NST}[feature + 1])) AS c FROM e GROUP BY 1) SELECT ids.k AS residue, round(coalesce(h, 0), 9) AS h, round(coalesce(c, 0), 9) AS capacity, round(coalesce(h / c, 'nan'::DOUBLE), 9) AS share FROM (SELECT unnest(range(0, 4))::INT AS k) ids LEFT JOIN r ON r.residue = ids.k")
def _(s, d):
    h = info.feature_entropies(dm.features(s, d))
    mapping = s.createDataFrame([(f, f // 2, n) for f, n in N_STATES.items()], "feature int, residue int, n_states int")
    residues = s.range(4).select(F.col("id").cast("int").alias("residue"))
    out = info.residue_entropies(h, mapping, residues)
    return out.select("residue", *(F.round(c, 9).alias(c) for c in ("h", "capacity", "share")))


def two_models(s, d):
    t = lambda cut: msm.row_normalize(tc.assigns_to_counts(dm.ev(s, d).where(cut)))
    return t("traj_id % 2 = 0"), t("traj_id % 2 = 1")


TWO = f"""{EV}, ea AS (SELECT * FROM ev WHERE traj_id % 2 = 0), eb AS (SELECT * FROM ev WHERE traj_id % 2 = 1), {dm.counts('ea', name='ca')}, {dm.counts('eb', name='cb')},
p AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM ca), r AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM cb)"""


@q("kl_divergence", f"WITH {TWO} SELECT i, round(sum(p.v * ln(p.v / r.v)) / ln(2), 9) + 0.0::DOUBLE AS v FROM p JOIN r USING (i, j) GROUP BY i")
def _(s, d):
    return cells(info.kl_divergence(*two_models(s, d)))


@q("js_divergence", f"WITH {TWO} SELECT i, round(sum(p.v * ln(2 * p.v / (p.v + r.v)) + r.v * ln(2 * r.v / (p.v + r.v))) / 2 / ln(2), 9) + 0.0::DOUBLE AS v FROM p JOIN r USING (i, j) GROUP BY i")
def _(s, d):
    return cells(info.js_divergence(*two_models(s, d)))


@q("relative_entropy_state", f"WITH {TWO}, w AS (SELECT i, sum(v) / (SELECT sum(v) FROM ca) AS w FROM ca GROUP BY i) SELECT i, round(sum(p.v * ln(p.v / r.v)) / ln(2) * min(w), 9) + 0.0::DOUBLE AS v FROM p JOIN r USING (i, j) JOIN w USING (i) WHERE i <> 2 GROUP BY i")
def _(s, d):
    w = msm.row_shares(tc.assigns_to_counts(dm.ev(s, d).where("traj_id % 2 = 0")))
    return cells(info.relative_entropy_per_state(*two_models(s, d), w, [0, 1, 3, 4]))


@q("relative_entropy_msm", f"WITH {TWO}, w AS (SELECT i, sum(v) AS w FROM ca GROUP BY i), k AS (SELECT i, sum(p.v * ln(p.v / r.v)) / ln(2) AS v FROM p JOIN r USING (i, j) GROUP BY i) SELECT round(sum(v * w) / sum(w), 9) + 0.0::DOUBLE AS v FROM k JOIN w USING (i) WHERE i IN (0, 1, 2)")
def _(s, d):
    w = msm.row_shares(tc.assigns_to_counts(dm.ev(s, d).where("traj_id % 2 = 0")))
    return cells(info.relative_entropy_msm(*two_models(s, d), w, [0, 1, 2]))


@q("q_from_assignments", f"WITH {EV}, {dm.counts('ev')}, ids AS (SELECT unnest(range(0, 5))::INT AS k), g AS (SELECT a.k AS i, b.k AS j, coalesce(v, 0) + 1.0 / (SELECT sum(n) FROM (SELECT count(*) - 1 AS n FROM ev GROUP BY traj_id)) AS v FROM ids a, ids b LEFT JOIN c ON c.i = a.k AND c.j = b.k) SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM g")
def _(s, d):
    return cells(info.q_from_assignments(dm.ev(s, d), 5))


SAS = "sa AS (SELECT label AS grp, vec_id AS frame, unnest([0, 1, 2, 3]) AS residue, unnest([abs(embedding[1]), abs(embedding[2]), abs(embedding[3]), abs(embedding[4])])::DOUBLE AS sasa FROM embeddings)"


def sasas(s, d):
    e = dm.table(s, d, "embeddings")
    each = F.array(*(F.struct(F.lit(k).alias("residue"), F.abs(F.col("embedding")[k]).cast("double").alias("sasa")) for k in range(4)))
    return e.select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame"), F.inline(each))


@q("exposed_sidechain_mi", f"""WITH {SAS}, x AS (SELECT frame, residue, (sasa > 0.1)::INT AS s FROM sa),
j AS (SELECT a.residue AS fa, b.residue AS fb, a.s AS u, b.s AS v, count(*)::DOUBLE AS n FROM x a JOIN x b USING (frame) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY fa, fb) AS t, sum(n) OVER (PARTITION BY fa, fb, u) AS nu, sum(n) OVER (PARTITION BY fa, fb, v) AS nv FROM j)
SELECT fa, fb, round(greatest(sum(n / t * ln(n * t / (nu * nv))), 0.0) / ln(2), 9) + 0.0::DOUBLE AS mi FROM w GROUP BY fa, fb""")
def _(s, d):
    return cells(info.exposons_from_sasas(sasas(s, d), 0.9, None, 0.1)[0], "mi")


@q("exposons")
def _(s, d):
    return info.exposons_from_sasas(sasas(s, d), 0.9, None, 0.1)[1]


@q("sidechain_sasa", "WITH a AS (SELECT vec_id AS frame, unnest(range(0, 6))::BIGINT AS atom_id, unnest([abs(embedding[1]), abs(embedding[2]), abs(embedding[3]), abs(embedding[4]), abs(embedding[5]), abs(embedding[6])])::DOUBLE AS sasa FROM embeddings) SELECT frame, (atom_id // 3)::INT AS residue, round(sum(sasa), 9) AS sasa FROM a WHERE atom_id NOT IN (0, 3) GROUP BY ALL")
def _(s, d):
    e = dm.table(s, d, "embeddings")
    each = F.array(*(F.struct(F.lit(k).cast("long").alias("atom_id"), F.abs(F.col("embedding")[k]).cast("double").alias("sasa")) for k in range(6)))
    atoms = s.createDataFrame([(k, ["CA", "CB", "CG"][k % 3], k // 3) for k in range(6)], "atom_id long, name string, res_id int")
    own = e.select(F.lit(0).alias("traj_id"), F.col("vec_id").alias("frame"), F.inline(each))
    return info.condense_sidechain_sasas(own, atoms).select("frame", "residue", F.round("sasa", 9).alias("sasa"))


@q("deconvolve_network")
def _(s, d):
    return info.deconvolve_network(matrix(s, d), 5).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def _two_basin(boundary, shift):
    a = "angle" if not shift else f"((angle + {360 + shift}) % 360)"
    return f"""WITH {ANGLES}, z AS (SELECT traj_id, feature, frame, {a} AS a, row_number() OVER (PARTITION BY traj_id, feature ORDER BY frame) AS k FROM ang),
core AS (SELECT *, CASE WHEN k = 1 THEN (a >= {boundary})::INT
  WHEN a BETWEEN {boundary} + 15 AND 345 THEN 1 WHEN a BETWEEN 15 AND {boundary} - 15 THEN 0 END AS core FROM z)
SELECT traj_id, feature, frame, last_value(core IGNORE NULLS) OVER (PARTITION BY traj_id, feature ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM core"""


@q("rotamer_2basin", _two_basin(180, 0))
def _(s, d):
    return cards.phi_rotamers(dm.angles(s, d))


@q("rotamer_psi_shift", _two_basin(160, -100))
def _(s, d):
    return cards.psi_rotamers(dm.angles(s, d))


CHI = f"""WITH RECURSIVE {ANGLES}, z AS (SELECT traj_id, feature, frame, angle AS a, (CASE WHEN angle >= 240 THEN 2 WHEN angle >= 120 THEN 1 ELSE 0 END) AS hard FROM ang),
r AS (SELECT traj_id, feature, frame, hard AS state FROM z WHERE frame = 0 UNION ALL
  SELECT z.traj_id, z.feature, z.frame, CASE WHEN (r.state = 0 AND z.a BETWEEN 135 AND 345) OR (r.state = 1 AND NOT z.a BETWEEN 105 AND 255) OR (r.state = 2 AND z.a BETWEEN 15 AND 225) THEN hard ELSE r.state END
  FROM r JOIN z ON z.traj_id = r.traj_id AND z.feature = r.feature AND z.frame = r.frame + 1)"""


@q("rotamer_3basin", CHI + " SELECT traj_id, feature, frame, state FROM r")
def _(s, d):
    return cards.chi_rotamers(dm.angles(s, d))


ROT = _two_basin(180, 0).removeprefix("WITH ")
RT = ROT[: ROT.rindex("SELECT traj_id")] + ", rt AS (" + ROT[ROT.rindex("SELECT traj_id") :] + ")"
TT = RT + """,
ch AS (SELECT *, lead(state) OVER (PARTITION BY traj_id, feature ORDER BY frame) AS nxt FROM rt),
tt AS (SELECT traj_id, feature, frame AS t, frame - lag(frame) OVER (PARTITION BY traj_id, feature ORDER BY frame) AS gap FROM ch WHERE nxt <> state)"""
ST = TT + """,
ag AS (SELECT traj_id, feature, count(*) AS n, avg(gap) AS mg, sum(coalesce(gap, t) * (coalesce(gap, t) + 1) / 2.0)::DOUBLE AS hs, sum(coalesce(gap, t))::DOUBLE AS ws, min(t) AS f, max(t) AS l FROM tt GROUP BY ALL),
sr AS (SELECT traj_id, feature, count(*)::DOUBLE AS len FROM rt GROUP BY ALL),
st AS (SELECT sr.traj_id, sr.feature, len, coalesce(CASE WHEN n > 1 THEN hs / ws ELSE hs END, 0)::DOUBLE AS ord_time, coalesce(l, 0)::DOUBLE AS n_ord,
  coalesce(CASE WHEN n > 1 THEN mg ELSE 0 END, 0)::DOUBLE AS disord_time, coalesce(CASE WHEN n > 1 THEN l - f ELSE 0 END, 0)::DOUBLE AS n_disord FROM sr LEFT JOIN ag USING (traj_id, feature)),
mt AS (SELECT feature, sum(ord_time * len) / sum(len) AS ord_time, sum(disord_time * len) / sum(len) AS disord_time FROM st GROUP BY feature)"""


def rotamers(s, d):
    return cards.phi_rotamers(dm.angles(s, d)).cache()


@q("transition_times", f"WITH {TT} SELECT traj_id, feature, t, gap FROM tt")
def _(s, d):
    return cards.transition_times(rotamers(s, d))


@q("order_disorder_times", f"WITH {ST} SELECT traj_id, feature, round(ord_time, 9) AS ord_time, n_ord, round(disord_time, 9) AS disord_time, n_disord FROM st")
def _(s, d):
    return cards.transition_stats(rotamers(s, d)).select("traj_id", "feature", F.round("ord_time", 9).alias("ord_time"), "n_ord", F.round("disord_time", 9).alias("disord_time"), "n_disord")


@q("disorder_mean_times", f"WITH {ST} SELECT feature, round(ord_time, 9) AS ord_time, round(disord_time, 9) AS disord_time FROM mt")
def _(s, d):
    return cards.mean_times(rotamers(s, d)).select("feature", F.round("ord_time", 9).alias("ord_time"), F.round("disord_time", 9).alias("disord_time"))


DIS = ST + """,
sg AS (SELECT traj_id, feature, t AS a, lead(t) OVER (PARTITION BY traj_id, feature ORDER BY t) AS z FROM tt),
dis AS (SELECT rt.traj_id, rt.feature, rt.frame, coalesce((mt.ord_time / mt.disord_time * exp(-(z - a) * (1 / mt.disord_time - 1 / mt.ord_time)) >= 3)::INT, 0) AS state
  FROM rt JOIN mt USING (feature) LEFT JOIN sg ON sg.traj_id = rt.traj_id AND sg.feature = rt.feature AND rt.frame >= a AND rt.frame < z)"""


@q("disorder_traj", f"WITH {DIS} SELECT traj_id, feature, frame, state FROM dis")
def _(s, d):
    return cards.disorder(rotamers(s, d))


@q("cards_four_mi", f"""WITH {DIS}, al AS (SELECT 's' AS kind, * FROM rt UNION ALL SELECT 'd', * FROM dis),
j AS (SELECT a.kind || b.kind AS kind, a.feature AS fa, b.feature AS fb, a.state AS u, b.state AS v, count(*)::DOUBLE AS n FROM al a JOIN al b USING (traj_id, frame) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY kind, fa, fb) AS t, sum(n) OVER (PARTITION BY kind, fa, fb, u) AS nu, sum(n) OVER (PARTITION BY kind, fa, fb, v) AS nv FROM j)
SELECT kind, fa, fb, round(greatest(sum(n / t * ln(n * t / (nu * nv))), 0.0) / ln(2), 9) + 0.0::DOUBLE AS mi FROM w GROUP BY kind, fa, fb""")
def _(s, d):
    out = None
    for name, mi in cards.cards(rotamers(s, d), {0: 2, 1: 2}).items():
        a, b = name.split("_")
        own = cells(mi, "mi").select(F.lit(a[0] + b[0]).alias("kind"), "fa", "fb", "mi")
        out = own if out is None else out.unionByName(own)
    return out
