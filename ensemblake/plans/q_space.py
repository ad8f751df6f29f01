"""Queries over geometry, pockets, FRET and histograms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fret, geometry, metrics
from ..operators import fret as fr
from ..operators import pockets as pk
from ..operators import ragged as rg
from ..operators import sampling
from . import domain as dm
from .domain import EV, PTS, r9

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def vec(e, a):
    """Three components of an embedding from the a-th."""
    return F.transform(F.slice(e["embedding"], a + 1, 3), lambda x: x.cast("double"))


def emb(s, d):
    e = dm.table(s, d, "embeddings")
    return e.select("vec_id", "label", *(vec(e, 3 * k).alias(f"v{k}") for k in range(6)))


VEC = "vs AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {'abcdefghijklmnopqr'[k]}_" for k in range(18)) + " FROM embeddings)"


def parts(df, col):
    return df.select("vec_id", *(r9(F.col(col)[k]).alias(c) for k, c in enumerate("xyz")))


@q("angles_from_vecs", f"WITH {VEC} SELECT o.vec_id, round(acos(round((o.a_ * r.a_ + o.b_ * r.b_ + o.c_ * r.c_) / (sqrt(o.a_ ** 2 + o.b_ ** 2 + o.c_ ** 2) * sqrt(r.a_ ** 2 + r.b_ ** 2 + r.c_ ** 2)), 5)), 6) + 0.0::DOUBLE AS angle FROM vs o, vs r WHERE r.vec_id = 0")
def _(s, d):
    e = emb(s, d)
    both = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("v0").alias("ref"))))
    return both.select("vec_id", (F.round(geometry.angle_between(F.col("v0"), F.col("ref")), 6) + 0.0).alias("angle"))


@q("plane_projection", f"WITH {VEC}, m AS (SELECT vec_id, a_ AS p, b_ AS w, sqrt(a_ * a_ + b_ * b_) AS size FROM vs) SELECT vec_id, round(degrees(acos(round(p / size, 5))) * CASE WHEN w < 0 THEN -1 ELSE 1 END, 6) + 0.0::DOUBLE AS angle, round(size, 9) AS size FROM m")
def _(s, d):
    x, y = (F.array(*(F.lit(float(k == a)) for k in range(3))) for a in (0, 1))
    angle, size = geometry.plane_projection(F.col("v0"), x, y)
    return emb(s, d).select("vec_id", (F.round(angle, 6) + 0.0).alias("angle"), F.round(size, 9).alias("size"))


@q("rodrigues_rotation", f"WITH {VEC} SELECT vec_id, round(a_ * cos(0.7) - b_ * sin(0.7), 9) + 0.0::DOUBLE AS x, round(a_ * sin(0.7) + b_ * cos(0.7), 9) + 0.0::DOUBLE AS y, round(c_, 9) + 0.0::DOUBLE AS z FROM vs")
def _(s, d):
    axis = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return parts(emb(s, d).withColumn("t", geometry.rodrigues(F.col("v0"), axis, 0.7)), "t")


CB = VEC + """,
u AS (SELECT vec_id, d_, e_, f_, d_ - (a_ + g_) / 2 AS wx, e_ - (b_ + h_) / 2 AS wy, f_ - (c_ + i_) / 2 AS wz, d_ - a_ AS p1, e_ - b_ AS p2, f_ - c_ AS p3, d_ - g_ AS q1, e_ - h_ AS q2, f_ - i_ AS q3 FROM vs),
n AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS wl, p2 * q3 - p3 * q2 AS n1, p3 * q1 - p1 * q3 AS n2, p1 * q2 - p2 * q1 AS n3 FROM u),
cb AS (SELECT vec_id, d_ + 0.153 * (sin(radians(30)) * wx / wl + cos(radians(30)) * n1 / nl) AS x, e_ + 0.153 * (sin(radians(30)) * wy / wl + cos(radians(30)) * n2 / nl) AS y, f_ + 0.153 * (sin(radians(30)) * wz / wl + cos(radians(30)) * n3 / nl) AS z
  FROM (SELECT *, sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS nl FROM n))"""


@q("cb_coords", f"WITH {CB} SELECT vec_id, round(x, 9) + 0.0::DOUBLE AS x, round(y, 9) + 0.0::DOUBLE AS y, round(z, 9) + 0.0::DOUBLE AS z FROM cb")
def _(s, d):
    return parts(emb(s, d).withColumn("t", geometry.cb_coords(F.col("v0"), F.col("v1"), F.col("v2"))), "t")


@q("residue_frame_is_orthonormal", "SELECT vec_id, 1.0::DOUBLE AS xx, 0.0::DOUBLE AS xy, 0.0::DOUBLE AS yz, 1.0::DOUBLE AS zz FROM embeddings")
def _(s, d):
    m = emb(s, d).withColumn("m", geometry.residue_frame(F.col("v0"), F.col("v1"), F.col("v2")))
    t = lambda i, j: r9(metrics.dot(F.col("m")[i], F.col("m")[j]))
    return m.select("vec_id", t(0, 0).alias("xx"), t(0, 1).alias("xy"), t(1, 2).alias("yz"), t(2, 2).alias("zz"))


@q("reference_vectors", f"""WITH {VEC}, u AS (SELECT vec_id, d_ - g_ AS x, e_ - h_ AS y, f_ - i_ AS z, a_ / l AS nx, b_ / l AS ny, c_ / l AS nz FROM (SELECT *, sqrt(a_ * a_ + b_ * b_ + c_ * c_) AS l FROM vs)),
w AS (SELECT vec_id, x - t * nx AS x, y - t * ny AS y, z - t * nz AS z FROM (SELECT *, x * nx + y * ny + z * nz AS t FROM u)), l AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM w)
SELECT vec_id, round(x / l, 9) + 0.0::DOUBLE AS x, round(y / l, 9) + 0.0::DOUBLE AS y, round(z / l, 9) + 0.0::DOUBLE AS z FROM l""")
def _(s, d):
    own = emb(s, d).withColumn("t", geometry.reference_vector(metrics.norm_vec(F.col("v0")), F.col("v2"), F.col("v1")))
    return parts(own, "t")


COO = "co AS (SELECT frame, id AS atom, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS atom_id, px AS x, py AS y, pz AS z FROM pts)"


def coords(s, d):
    p = dm.points(s, d)
    atom = (F.row_number().over(Window.partitionBy("frame").orderBy("id")) - 1).cast("long")
    return p.select("frame", atom.alias("atom_id"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))


@q("rmsf_weighted", f"WITH {PTS}, {COO} SELECT c.atom_id, round(sqrt(sum(((c.x - r.x) ** 2 + (c.y - r.y) ** 2 + (c.z - r.z) ** 2) * (c.frame + 1)) / sum(c.frame + 1)), 9) + 0.0::DOUBLE AS rmsf FROM co c JOIN co r ON r.atom_id = c.atom_id AND r.frame = 0 GROUP BY c.atom_id")
def _(s, d):
    w = s.createDataFrame([(k, float(k + 1)) for k in range(10)], "frame int, w double")
    return geometry.rmsf(coords(s, d), w).select("atom_id", r9("rmsf").alias("rmsf"))


@q("running_mean", f"WITH {PTS}, {COO}, m AS (SELECT frame, atom_id, count(*) OVER (PARTITION BY frame) AS n, row_number() OVER (PARTITION BY frame ORDER BY atom_id) AS k, avg(x) OVER (PARTITION BY frame ORDER BY atom_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM co) SELECT frame, atom_id, round(m, 9) + 0.0::DOUBLE AS m FROM m WHERE k < n - 4")
def _(s, d):
    out = geometry.running_mean(coords(s, d), "x", 4, "atom_id", ["frame"])
    return out.select("frame", "atom_id", r9("x_mean").alias("m"))


@q("helix_vectors", f"""WITH {PTS}, {COO}, m AS (SELECT frame, atom_id, count(*) OVER w0 AS n, row_number() OVER w AS k, avg(x) OVER w4 AS x, avg(y) OVER w4 AS y, avg(z) OVER w4 AS z FROM co
  WINDOW w0 AS (PARTITION BY frame), w AS (PARTITION BY frame ORDER BY atom_id), w4 AS (PARTITION BY frame ORDER BY atom_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
t AS (SELECT frame, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM (SELECT * FROM m WHERE k < n - 4) WINDOW w AS (PARTITION BY frame ORDER BY atom_id)),
a AS (SELECT frame, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz FROM t GROUP BY frame)
SELECT frame, round(dx / sqrt(dx * dx + dy * dy + dz * dz), 6) + 0.0::DOUBLE AS dx, round(dy / sqrt(dx * dx + dy * dy + dz * dz), 6) + 0.0::DOUBLE AS dy FROM a""")
def _(s, d):
    h = geometry.helix_vectors(coords(s, d).withColumnRenamed("atom_id", "k"), 4)
    return h.select("frame", (F.round(F.col("direction")[0], 6) + 0.0).alias("dx"), (F.round(F.col("direction")[1], 6) + 0.0).alias("dy"))


@q("rmsd_superposed")
def _(s, d):
    e = dm.table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 30).cast("array<double>").alias("x"))
    ref = e.where("vec_id = 0").select(F.col("x").alias("y"))
    return e.crossJoin(F.broadcast(ref)).select("vec_id", F.round(geometry.rmsd(F.col("x"), F.col("y")), 6).alias("rmsd"))


@q("dihedral_angles", f"""WITH {VEC}, b AS (SELECT vec_id, d_-a_ AS p1, e_-b_ AS p2, f_-c_ AS p3, g_-d_ AS q1, h_-e_ AS q2, i_-f_ AS q3, j_-g_ AS r1, k_-h_ AS r2, l_-i_ AS r3 FROM vs),
n AS (SELECT *, p2*q3-p3*q2 AS m1, p3*q1-p1*q3 AS m2, p1*q2-p2*q1 AS m3, q2*r3-q3*r2 AS n1, q3*r1-q1*r3 AS n2, q1*r2-q2*r1 AS n3, sqrt(q1*q1+q2*q2+q3*q3) AS ql FROM b),
t AS (SELECT vec_id, degrees(atan2(((m2*n3-m3*n2)*q1+(m3*n1-m1*n3)*q2+(m1*n2-m2*n1)*q3)/ql, m1*n1+m2*n2+m3*n3)) AS a FROM n)
SELECT vec_id, round(least(CASE WHEN a < 0 THEN a + 360 ELSE a END, 359.5), 6) + 0.0::DOUBLE AS angle FROM t""")
def _(s, d):
    from ..operators.cards import dihedral

    return emb(s, d).select("vec_id", (F.round(dihedral(*(F.col(f"v{k}") for k in range(4))), 6) + 0.0).alias("angle"))


GRID = 1.0
ATOMS = "atm AS (SELECT frame, px AS x, py AS y, pz AS z, 0.6 AS radius FROM pts)"
GR = f"""{PTS}, {ATOMS}, en AS (SELECT frame, min(x) AS lx, min(y) AS ly, min(z) AS lz, ceil((max(x) - min(x)) / {GRID})::INT AS nx, ceil((max(y) - min(y)) / {GRID})::INT AS ny, ceil((max(z) - min(z)) / {GRID})::INT AS nz FROM atm GROUP BY frame),
gr AS (SELECT frame, x, y, unnest(range(0, nz + 1))::INT AS z, lx, ly, lz FROM (SELECT *, unnest(range(0, ny + 1))::INT AS y FROM (SELECT *, unnest(range(0, nx + 1))::INT AS x FROM en))),
gp AS (SELECT frame, x, y, z, lx + x * {GRID} AS px, ly + y * {GRID} AS py, lz + z * {GRID} AS pz FROM gr),
tp AS (SELECT g.*, (EXISTS (SELECT 1 FROM atm a WHERE a.frame = g.frame AND (a.x - g.px) ** 2 + (a.y - g.py) ** 2 + (a.z - g.pz) ** 2 < 0.49))::INT AS touch FROM gp g)"""


def atoms(s, d):
    return dm.points(s, d).select("frame", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.lit(0.6).alias("radius"))


@q("pocket_grid", f"WITH {GR} SELECT frame, x, y, z, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM gp")
def _(s, d):
    g = pk.create_grid(atoms(s, d), GRID)
    return g.select("frame", "x", "y", "z", *(F.round(c, 6).alias(c) for c in ("px", "py", "pz")))


def touched(s, d):
    return pk.touches_protein(pk.create_grid(atoms(s, d), GRID), atoms(s, d), 0.1, 0.6)


@q("pocket_touches", f"WITH {GR} SELECT frame, x, y, z, touch FROM tp")
def _(s, d):
    return touched(s, d).select("frame", "x", "y", "z", "touch")


def _line(parts, order):
    w = f"OVER (PARTITION BY frame, {parts})"
    return f"(touch = 0 AND coalesce(min(CASE WHEN touch = 1 THEN {order} END) {w} < {order} AND max(CASE WHEN touch = 1 THEN {order} END) {w} > {order}, false))::INT"


def _diagonal(p, r):
    return f"CASE WHEN {p} = {r} AND {p} < 0 THEN 0 ELSE {_line(f'{p}, {r}', 'z')} END"


RANK = f"""{GR}, tq AS (SELECT *, x - z AS p, y - z AS q, max(x) OVER (PARTITION BY frame) - x - z AS fp, max(y) OVER (PARTITION BY frame) - y - z AS fq FROM tp),
rk AS (SELECT frame, x, y, z, {_line('y, z', 'x')} + {_line('x, z', 'y')} + {_line('x, y', 'z')} + {_diagonal('p', 'q')} + {_diagonal('p', 'fq')} + {_diagonal('fp', 'q')} + {_diagonal('fp', 'fq')} AS rank FROM tq)"""


@q("pocket_rank", f"WITH {RANK} SELECT frame, x, y, z, rank FROM rk")
def _(s, d):
    return pk.all_ranks(touched(s, d)).select("frame", "x", "y", "z", "rank")


@q("pocket_cells", f"WITH {RANK} SELECT frame, x, y, z FROM rk WHERE rank >= 2")
def _(s, d):
    return pk.pocket_cells(atoms(s, d), GRID, 0.1, 2, 0.6).select("frame", "x", "y", "z")


CLUSTER = """{head}, nodes AS ({nodes}),
lk AS (SELECT a.frame, a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.frame = b.frame AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2 <= {reach}),
rc AS (SELECT id AS a, id AS b FROM nodes UNION SELECT rc.a, lk.b FROM rc JOIN lk ON lk.a = rc.b),
cm AS (SELECT a AS id, min(b) AS component FROM rc GROUP BY a),
sz AS (SELECT frame, component, count(*) AS size, (row_number() OVER (PARTITION BY frame ORDER BY count(*) DESC, component) - 1)::INT AS cluster FROM nodes JOIN cm USING (id) GROUP BY frame, component {having})"""


@q("cluster_grids", "WITH RECURSIVE " + CLUSTER.format(head=PTS, nodes="SELECT * FROM pts", reach="0.64", having="HAVING count(*) > 1") + " SELECT id, n.frame, cluster, size FROM nodes n JOIN cm USING (id) JOIN sz ON sz.frame = n.frame AND sz.component = cm.component")
def _(s, d):
    return pk.cluster_points(dm.points(s, d), 0.8, min_size=1).select("id", "frame", "cluster", "size")


@q("largest_clouds", "WITH RECURSIVE " + CLUSTER.format(head=PTS, nodes="SELECT * FROM pts", reach="0.64", having="") + " SELECT id, n.frame, cluster FROM nodes n JOIN cm USING (id) JOIN sz ON sz.frame = n.frame AND sz.component = cm.component WHERE cluster = 0")
def _(s, d):
    return pk.cluster_points(dm.points(s, d), 0.8, n_clouds=1).select("id", "frame", "cluster")


POCKETS = "WITH RECURSIVE " + CLUSTER.format(head=RANK.replace("rk AS (SELECT frame, x, y, z, ", "rk AS (SELECT frame, x, y, z, px, py, pz, "), nodes="SELECT frame, x, y, z, frame || ',' || x || ',' || y || ',' || z AS id, px, py, pz FROM rk WHERE rank >= 2", reach=(1.5 * GRID) ** 2, having="")


@q("pocket_clusters", POCKETS + " SELECT n.frame, n.x, n.y, n.z, cluster FROM nodes n JOIN cm USING (id) JOIN sz ON sz.frame = n.frame AND sz.component = cm.component")
def _(s, d):
    return pk.pockets(atoms(s, d), GRID, 0.1, 2, 0, 0.6).select("frame", "x", "y", "z", "cluster")


@q("clash_filter", f"WITH {PTS}, {ATOMS} SELECT id, frame FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts a WHERE a.frame = p.frame AND a.id <> p.id AND (a.px - p.px) ** 2 + (a.py - p.py) ** 2 + (a.pz - p.pz) ** 2 < 0.49)")
def _(s, d):
    p = dm.points(s, d)
    # A point is near itself: those that are near nothing else stay.
    hit = pk.near_points(p, p.select("frame", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")), ["px", "py", "pz"], F.lit(0.7), 0.7, ["frame"])
    alone = hit.groupBy("frame", "id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("frame", "id")
    return p.join(alone, ["frame", "id"]).select("id", "frame")


HALVES = f"{PTS}, pa AS (SELECT * FROM pts WHERE id % 2 = 0), pb AS (SELECT * FROM pts WHERE id % 2 = 1), dd AS (SELECT frame, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS r FROM pa a JOIN pb b USING (frame)), hh AS (SELECT frame, floor(r / 0.5)::INT AS bin, count(*) AS n FROM dd GROUP BY ALL), tops AS (SELECT frame, unnest(range(0, floor(max(r) / 0.5)::INT + 2))::INT AS bin FROM dd GROUP BY frame), hist AS (SELECT frame, bin, coalesce(n, 0) AS n FROM tops LEFT JOIN hh USING (frame, bin))"


def halves(s, d):
    p = dm.points(s, d)
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


@q("pair_distance_hist", f"WITH {HALVES} SELECT frame, bin, n, round(n / (sum(n) OVER (PARTITION BY frame) * 0.5), 9) AS density FROM hist")
def _(s, d):
    return fr.distance_histogram(*halves(s, d), 0.5).select("frame", "bin", "n", F.round("density", 9).alias("density"))


@q("both_label_orders", f"WITH {HALVES} SELECT frame, bin, round(n / (sum(n) OVER (PARTITION BY frame) * 0.5), 9) AS p FROM hist")
def _(s, d):
    a, b = halves(s, d)
    return fr.both_orders(fr.distance_histogram(a, b, 0.5), fr.distance_histogram(b, a, 0.5)).select("frame", "bin", F.round("p", 9).alias("p"))


@q("merge_histograms", f"WITH {HALVES} SELECT bin, sum(n * (frame + 1))::BIGINT AS n FROM hist GROUP BY bin")
def _(s, d):
    h = fr.distance_histogram(*halves(s, d), 0.5).withColumn("w", F.col("frame") + 1)
    return rg.merge_histograms(h, weight="w").select("bin", "n")


@q("make_distribution", f"WITH {HALVES} SELECT frame, bin, round(n / sum(n) OVER (PARTITION BY frame), 9) AS p, bin * 0.5::DOUBLE + 0.25::DOUBLE AS middle FROM hist")
def _(s, d):
    h = fr.distance_histogram(*halves(s, d), 0.5)
    return rg.make_distribution(h, ["frame"]).select("frame", "bin", F.round("p", 9).alias("p"), "middle")


@q("fret_efficiency", "SELECT l_orderkey, l_quantity, round(pow(5.2, 6) / (pow(5.2, 6) + pow(l_quantity / 5 + 0.1, 6)), 9) AS e FROM lineitem")
def _(s, d):
    li = dm.table(s, d, "lineitem")
    return li.select("l_orderkey", "l_quantity", F.round(fret.fret_efficiency(F.col("l_quantity") / 5, 5.2, 0.1), 9).alias("e"))


@q("forster_radius", "SELECT DISTINCT l_quantity, round(0.02108 * pow(l_quantity / 50 * 0.92 * 2.4e15 / pow(1.333, 4), 1.0 / 6), 6) AS r0 FROM lineitem")
def _(s, d):
    q_ = dm.table(s, d, "lineitem").select("l_quantity").distinct()
    return q_.select("l_quantity", F.round(fret.forster_radius(F.col("l_quantity") / 50, 0.92, 2.4e15), 6).alias("r0"))


KAPPA = VEC + """,
kb AS (SELECT *, g_ - a_ AS rx, h_ - b_ AS ry, i_ - c_ AS rz FROM vs),
kn AS (SELECT *, sqrt(rx*rx+ry*ry+rz*rz) AS r, sqrt(d_*d_+e_*e_+f_*f_) AS dl, sqrt(j_*j_+k_*k_+l_*l_) AS al FROM kb),
kk AS (SELECT vec_id, label, r, pow((d_*j_+e_*k_+f_*l_)/(dl*al) - 3*((d_*rx+e_*ry+f_*rz)/(dl*r))*((j_*rx+k_*ry+l_*rz)/(al*r)), 2) AS k2 FROM kn)"""


@q("kappa2", f"WITH {KAPPA} SELECT vec_id, round(k2, 9) AS k2, round(r, 9) AS r FROM kk")
def _(s, d):
    k2, r = fret.kappa2_r(F.col("v0"), F.col("v1"), F.col("v2"), F.col("v3"))
    return emb(s, d).select("vec_id", F.round(k2, 9).alias("k2"), F.round(r, 9).alias("r"))


@q("transfer_probs", """WITH t AS (SELECT DISTINCT l_quantity AS qn, pow(5.2 / (l_quantity / 5 + 1), 6) / 4.1 AS kr FROM lineitem), p AS (SELECT qn, 1 - exp(-0.92 / 4.1 * 0.5) AS a, 1 - exp(-(1 / 4.1 - 0.92 / 4.1) * 0.5) AS b, 1 - exp(-kr * 0.5) AS c FROM t)
SELECT qn AS l_quantity, round(a / greatest(a + b + c, 1), 9) AS radiative, round(b / greatest(a + b + c, 1), 9) AS non_radiative, round(c / greatest(a + b + c, 1), 9) AS energy_transfer, round(greatest(1 - (a + b + c), 0), 9) + 0.0::DOUBLE AS excited FROM p""")
def _(s, d):
    t = dm.table(s, d, "lineitem").select("l_quantity").distinct()
    rad, non = fret.radiative_rates(0.92, 4.1)
    p = fret.transfer_probabilities(rad, non, fret.fret_rate(F.col("l_quantity") / 5 + 1, 5.2, 4.1), 0.5)
    return t.withColumn("p", p).select("l_quantity", *(r9(f"p.{c}").alias(c) for c in ("radiative", "non_radiative", "energy_transfer", "excited")))


SPECTRA = "sp AS (SELECT p_size AS wavelength, avg(p_retailprice) / 1000 AS emission, count(*)::DOUBLE AS excitation FROM part GROUP BY p_size)"


def spectra(s, d):
    return dm.table(s, d, "part").groupBy(F.col("p_size").alias("wavelength")).agg((F.avg("p_retailprice") / 1000).alias("emission"), F.count(F.lit(1)).cast("double").alias("excitation"))


@q("dye_overlap_trapz", f"WITH {SPECTRA}, f AS (SELECT wavelength, emission, emission * excitation * 2.0 * pow(wavelength, 4) AS f FROM sp), t AS (SELECT (wavelength - lag(wavelength) OVER w) / 2 AS h, f + lag(f) OVER w AS a, emission + lag(emission) OVER w AS b FROM f WINDOW w AS (ORDER BY wavelength)) SELECT round(sum(h * a) / sum(h * b), 3) AS j FROM t")
def _(s, d):
    return fret.overlap_integral(spectra(s, d), spectra(s, d), 2.0).select(F.round("j", 3).alias("j"))


@q("trapezoid_area", f"WITH {SPECTRA} SELECT round(sum((wavelength - lw) * (emission + le) / 2), 6) AS area FROM (SELECT *, lag(wavelength) OVER (ORDER BY wavelength) AS lw, lag(emission) OVER (ORDER BY wavelength) AS le FROM sp)")
def _(s, d):
    return fret.trapezoid(spectra(s, d), "wavelength", "emission").select(F.round("area", 6).alias("area"))


EVENTS = "CASE WHEN event_type IN ('click', 'view') THEN 'radiative' WHEN event_type = 'error' THEN 'non_radiative' ELSE 'energy_transfer' END"


def dye_events(s, d):
    e = dm.table(s, d, "events")
    outcome = F.when(F.col("event_type").isin("click", "view"), "radiative").when(F.col("event_type") == "error", "non_radiative").otherwise("energy_transfer")
    return e.select((F.col("user_id") % 40).alias("state"), "event_id", (F.col("value") / 20).alias("lifetime"), outcome.alias("outcome"))


@q("per_state_fe", f"WITH e AS (SELECT user_id % 40 AS state, {EVENTS} AS o FROM events), n AS (SELECT state, count(*) FILTER (o = 'energy_transfer') AS t, count(*) FILTER (o = 'radiative') AS r FROM e GROUP BY state) SELECT k AS state, round(coalesce(t / (t + r), 'nan'::DOUBLE), 9) AS fe FROM (SELECT unnest(range(0, 42)) AS k) s LEFT JOIN n ON n.state = k")
def _(s, d):
    states = s.range(42).withColumnRenamed("id", "state")
    return fr.per_state_efficiency(states, dye_events(s, d)).select("state", F.round("fe", 9).alias("fe"))


@q("isotropic_fe", f"""WITH {VEC}, dn AS (SELECT vec_id % 5 + 1.0 AS p, a_, b_, c_, d_, e_, f_ FROM vs WHERE vec_id % 2 = 0), ac AS (SELECT vec_id % 3 + 1.0 AS p, a_ + 5 AS g_, b_ AS h_, c_ AS i_, d_ AS j_, e_ AS k_, f_ AS l_ FROM vs WHERE vec_id % 2 = 1),
kb AS (SELECT dn.p * ac.p AS w, *, g_ - a_ AS rx, h_ - b_ AS ry, i_ - c_ AS rz FROM dn, ac), kn AS (SELECT *, sqrt(rx*rx+ry*ry+rz*rz) AS r, sqrt(d_*d_+e_*e_+f_*f_) AS dl, sqrt(j_*j_+k_*k_+l_*l_) AS al FROM kb),
kk AS (SELECT w, r, pow((d_*j_+e_*k_+f_*l_)/(dl*al) - 3*((d_*rx+e_*ry+f_*rz)/(dl*r))*((j_*rx+k_*ry+l_*rz)/(al*r)), 2) AS k2 FROM kn), z AS (SELECT w, r, 0.02108 * pow(k2 * 0.92 * 2.4e15 / pow(1.333, 4), 1.0 / 6) AS r0 FROM kk)
SELECT round(sum(w * pow(r0, 6) / (pow(r0, 6) + pow(r, 6))) / sum(w), 6) AS fe FROM z""")
def _(s, d):
    e = emb(s, d)
    shifted = F.array(F.col("v0")[0] + 5, F.col("v0")[1], F.col("v0")[2])
    donors = e.where("vec_id % 2 = 0").select((F.col("vec_id") % 5 + 1.0).alias("p"), F.col("v0").alias("origin"), F.col("v1").alias("dipole"))
    acceptors = e.where("vec_id % 2 = 1").select((F.col("vec_id") % 3 + 1.0).alias("p"), shifted.alias("origin"), F.col("v1").alias("dipole"))
    return fr.isotropic_efficiency(donors, acceptors, 2.4e15, 0.92).select(F.round("fe", 6).alias("fe"))


@q("dyeless_states", "SELECT DISTINCT l_suppkey % 50 AS state FROM lineitem WHERE l_suppkey % 50 NOT IN (SELECT DISTINCT s_suppkey % 50 FROM supplier WHERE s_acctbal > 3000)")
def _(s, d):
    states = dm.table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("state")).distinct()
    return fr.dyeless_states(states, dm.table(s, d, "supplier").where("s_acctbal > 3000").select((F.col("s_suppkey") % 50).alias("state")))


@q("remove_bad_states", f"WITH {EV}, {dm.counts('ev')} SELECT i, j, v FROM c WHERE i NOT IN (1, 3) AND j NOT IN (1, 3)")
def _(s, d):
    from ..operators.counts import assigns_to_counts

    return fr.remove_bad_states(assigns_to_counts(dm.ev(s, d)), s.createDataFrame([(1,), (3,)], "state int"))


@q("labelled_model", f"WITH {EV}, {dm.counts('ev')}, k AS (SELECT i, j, v FROM c WHERE i NOT IN (1, 3) AND j NOT IN (1, 3)) SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM k")
def _(s, d):
    from ..operators.counts import assigns_to_counts

    bad = [s.createDataFrame([(k,)], "state int") for k in (1, 3)]
    return fr.labelled_model(assigns_to_counts(dm.ev(s, d)), *bad, 5)[1].select("i", "j", F.round("v", 9).alias("v"))


@q("histogram_fixed_width", "WITH h AS (SELECT event_type, floor(value / 10)::INT AS bin, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT event_type, unnest(range(0, floor(max(value) / 10)::INT + 2))::INT AS bin FROM events GROUP BY event_type) SELECT event_type, bin, bin * 10.0::DOUBLE AS lo, (bin + 1) * 10.0::DOUBLE AS hi, coalesce(n, 0) AS n FROM t LEFT JOIN h USING (event_type, bin)")
def _(s, d):
    return metrics.histogram(dm.table(s, d, "events"), "value", 10.0, ["event_type"])


MATCH = "hm AS (SELECT event_type, least(floor((value - 5) * 20 / 90), 19)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 5 AND 95 GROUP BY ALL), hp AS (SELECT event_type, bin, n / sum(n) OVER (PARTITION BY event_type) AS p FROM hm)"


@q("hist_match_expt", f"WITH {MATCH} SELECT event_type, bin, round(p, 9) AS p FROM hp")
def _(s, d):
    return metrics.histogram_like(dm.table(s, d, "events"), "value", 5, 95, 20, ["event_type"]).select("event_type", "bin", F.round("p", 9).alias("p"))


@q("hist_rss", f"WITH {MATCH}, ex AS (SELECT bin, p FROM hp WHERE event_type = 'view'), ty AS (SELECT DISTINCT event_type FROM hp), b AS (SELECT event_type, bin FROM ty, ex UNION SELECT event_type, bin FROM hp) SELECT b.event_type, round(sum(pow(coalesce(hp.p, 0) - coalesce(ex.p, 0), 2)), 9) AS rss FROM b LEFT JOIN hp ON hp.event_type = b.event_type AND hp.bin = b.bin LEFT JOIN ex ON ex.bin = b.bin GROUP BY b.event_type")
def _(s, d):
    h = metrics.histogram_like(dm.table(s, d, "events"), "value", 5, 95, 20, ["event_type"])
    return metrics.sum_sq_resid(h, h.where("event_type = 'view'").select("bin", "p"), ["event_type"]).select("event_type", F.round("rss", 9).alias("rss"))


@q("hist_moments", "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(pow(value - m, 3)) / pow(stddev_pop(value), 3), 6) + 0.0::DOUBLE AS skew, round(avg(pow(value - m, 4)) / pow(var_pop(value), 2) - 3, 6) + 0.0::DOUBLE AS kurtosis FROM events JOIN m USING (event_type) GROUP BY event_type")
def _(s, d):
    m = metrics.moments(dm.table(s, d, "events"), "value", ["event_type"])
    return m.select("event_type", *((F.round(c, 6) + 0.0).alias(c) for c in ("mean", "std", "skew", "kurtosis")))


@q("minmax_normalize", "SELECT event_id, round((value - min(value) OVER (PARTITION BY event_type)) / (max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type)), 9) AS scaled FROM events")
def _(s, d):
    return metrics.minmax(dm.table(s, d, "events"), "value", ["event_type"]).select("event_id", F.round("scaled", 9).alias("scaled"))


@q("int_norm", f"WITH {SPECTRA} SELECT wavelength, round(emission / (sum(emission) OVER () * (SELECT nth FROM (SELECT wavelength - lag(wavelength) OVER (ORDER BY wavelength) AS nth FROM sp ORDER BY wavelength LIMIT 1 OFFSET 1))), 9) AS y FROM sp")
def _(s, d):
    return metrics.int_norm(spectra(s, d), "wavelength", "emission").select("wavelength", F.round("y_norm", 9).alias("y"))


@q("int_norm_hist", "WITH h AS (SELECT floor(value / 10)::INT AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT bin, round(n / (sum(n) OVER () * 10), 9) AS density FROM h")
def _(s, d):
    h = metrics.histogram(dm.table(s, d, "events"), "value", 10.0).where("n > 0")
    return metrics.int_norm_hist(h).select("bin", F.round("density", 9).alias("density"))


@q("boltzmann_weights", f"WITH {SPECTRA}, w AS (SELECT wavelength, exp(-(emission * 10 - (SELECT avg(emission * 10) FROM sp)) / 2.479) AS w FROM sp) SELECT wavelength, round(w / sum(w) OVER (), 9) AS p FROM w")
def _(s, d):
    return metrics.energy_to_probability(spectra(s, d).withColumn("u", F.col("emission") * 10), "u").select("wavelength", F.round("p", 9).alias("p"))


PHOTONS = EV + """,
ph AS (SELECT traj_id AS burst_id, frame AS k, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY traj_id ORDER BY frame)) / 1000000.0 AS dt_us FROM ev)"""


def photons(s, d):
    e = dm.ev(s, d)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    dt = (us - F.lag(us).over(Window.partitionBy("traj_id").orderBy("frame"))) / 1000000.0
    return e.select(F.col("traj_id").alias("burst_id"), F.col("frame").alias("k"), dt.alias("dt_us")).where("dt_us IS NOT NULL")


@q("photon_frames", f"WITH {PHOTONS} SELECT burst_id, k, sum(floor(dt_us * 1000 / (7000.0 * 3)))  OVER (PARTITION BY burst_id ORDER BY k)::BIGINT AS frame FROM ph WHERE dt_us IS NOT NULL")
def _(s, d):
    return fr.photon_frames(photons(s, d), 7000.0, 3.0).select("burst_id", "k", "frame")


@q("sample_bursts")
def _(s, d):
    from ..operators import counts, msm

    _, t, pi = msm.transpose(counts.assigns_to_counts(dm.ev(s, d)))
    frames = fr.photon_frames(photons(s, d), 7e6, 3.0).withColumn("frame", F.least(F.col("frame"), F.lit(500)))
    return fr.sample_bursts(frames, t, pi, 5, seed=2)


@q("sample_distances")
def _(s, d):
    h = rg.make_distribution(fr.distance_histogram(*halves(s, d), 0.5), ["frame"]).withColumnRenamed("frame", "state")
    frames = dm.ev(s, d).select("traj_id", "frame", "state")
    return fr.sample_distances(frames, h, "state", ["traj_id", "frame"], 1).select("traj_id", "frame", F.round("r", 9).alias("r"))


@q("photon_events")
def _(s, d):
    bursts = dm.ev(s, d).select(F.col("traj_id").alias("burst_id"), F.col("frame").alias("k"), (F.col("event_id") % 40).alias("state"))
    return fr.burst_lifetimes(fr.photon_events(bursts, dye_events(s, d), 3))


@q("resolve_excitations")
def _(s, d):
    import numpy as np

    t = np.array([[0.9, 0.1], [0.2, 0.8]])
    pi = np.array([2 / 3, 1 / 3])
    samples = dm.table(s, d, "events").select(F.col("event_id").alias("sample_id"))
    return fr.resolve_excitations(samples, t, t, pi, pi, np.array([[0.5, 0.1], [0.1, 0.02]]), 0.22, 0.02, 0.1, 7)


@q("fit_lifetimes")
def _(s, d):
    fit = fr.fit_lifetimes(dye_events(s, d), 50, 5.0)
    return s.createDataFrame([(k, round(v, 4)) for k, v in enumerate(fit)], "k int, v double")


@q("fit_time_factor", f"WITH {MATCH}, ex AS (SELECT bin, p FROM hp WHERE event_type = 'view'), tf AS (SELECT CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 2.0 WHEN 'purchase' THEN 3.0 ELSE 4.0 END::DOUBLE AS time_factor, bin, p FROM hp WHERE event_type <> 'view'), g AS (SELECT DISTINCT time_factor FROM tf), b AS (SELECT time_factor, bin FROM g, ex UNION SELECT time_factor, bin FROM tf), r AS (SELECT b.time_factor, sum(pow(coalesce(tf.p, 0) - coalesce(ex.p, 0), 2)) AS rss FROM b LEFT JOIN tf ON tf.time_factor = b.time_factor AND tf.bin = b.bin LEFT JOIN ex ON ex.bin = b.bin GROUP BY b.time_factor) SELECT time_factor, round(rss, 9) AS diff FROM r ORDER BY rss, time_factor LIMIT 1")
def _(s, d):
    h = metrics.histogram_like(dm.table(s, d, "events"), "value", 5, 95, 20, ["event_type"])
    factor = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "error", 2.0).when(F.col("event_type") == "purchase", 3.0).otherwise(4.0)
    predicted = h.where("event_type <> 'view'").select(factor.alias("time_factor"), "bin", "p")
    return fr.fit_time_factor(predicted, h.where("event_type = 'view'").select("bin", "p")).select("time_factor", F.round("diff", 9).alias("diff"))


@q("remake_from_histogram")
def _(s, d):
    return sampling.remake_from_histogram(metrics.histogram(dm.table(s, d, "events"), "value", 10.0), 4)
