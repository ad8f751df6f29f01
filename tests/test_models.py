"""Counting, models, paths, information and states against brute force on inputs of our own."""

import itertools
from collections import Counter

import numpy as np
import pytest

from ensemblake.exceptions import ConvergenceWarning, DataInvalid, ImproperlyConfigured
from ensemblake.functions import linalg
from ensemblake.operators import cards, clustering, counts, info, msm, sampling, tpt


def frames(spark, rows, feature=None):
    return spark.createDataFrame([(t, f, s) for t, row in enumerate(rows) for f, s in enumerate(row)], "traj_id long, frame long, state int")


def matrix(spark, a):
    return linalg.scatter(spark, np.array(a, float))


def dense(df, n):
    return linalg.gather(df, n)


def test_counts_bridge_missing_frames(spark):
    rng = np.random.default_rng(11)
    rows = [rng.choice([-1, -1, 0, 1, 2, 3], n).tolist() for n in (40, 25, 3, 1)]
    want = np.zeros((4, 4))
    for row in rows:
        own = [x for x in row if x != -1]
        for a, b in zip(own, own[1:]):
            want[a, b] += 1
    assert (dense(counts.assigns_to_counts(frames(spark, rows)), 4) == want).all() and want.sum() > 20


def test_counts_lags_and_strides(spark):
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 4, n).tolist() for n in (30, 7, 1)]
    df = frames(spark, rows)
    for lag in (1, 3):
        for sliding in (True, False):
            want = np.zeros((4, 4))
            for r in rows:
                for t in range(0, len(r) - lag, 1 if sliding else lag):
                    want[r[t], r[t + lag]] += 1
            assert (dense(counts.assigns_to_counts(df, lag, sliding), 4) == want).all()
            many = counts.counts_by_lag(df, [lag, 5], sliding).where(f"lag = {lag}")
            assert (dense(many, 4) == want).all()
    for lag in (0, -1, 1.5, True):
        with pytest.raises(DataInvalid):
            counts.assigns_to_counts(df, lag)


def heaviest_part(c, threshold):
    """States that reach each other over counts at or above the threshold, of the largest row sums."""
    n = len(c)
    reach = [{j for j in range(n) if c[i, j] >= threshold} | {i} for i in range(n)]
    for _ in range(n):
        reach = [set().union(*(reach[j] for j in r)) for r in reach]
    parts = {frozenset(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}
    return sorted(min(parts, key=lambda p: (-c[sorted(p)].sum(), min(p))))


@pytest.mark.parametrize("threshold", [1, 3, 6])
def test_trim(spark, threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(3):
        c = np.where(rng.random((7, 7)) < 0.35, rng.integers(1, 9, (7, 7)), 0)
        keep = heaviest_part(c, threshold)
        mapping, kept = msm.trim_disconnected(matrix(spark, c), threshold, n_states=7)
        assert msm.TrimMapping(mapping) == [(o, k) for k, o in enumerate(keep)]
        assert (dense(kept, len(keep)) == c[np.ix_(keep, keep)]).all()
        assert (dense(msm.trim_disconnected(matrix(spark, c), threshold, False, 7)[1], 7)[np.ix_(keep, keep)] == c[np.ix_(keep, keep)]).all()


def test_builders(spark):
    c = np.array([[6.0, 3, 0], [2, 5, 8], [0, 4, 1]])
    t, pi = linalg.reversible_mle(c)
    flux = pi[:, None] * t
    assert np.allclose(flux, flux.T, atol=1e-9) and np.allclose(t.sum(axis=1), 1) and np.allclose(pi @ t, pi)

    def likelihood(t):
        return (c[c > 0] * np.log(t[c > 0])).sum()

    rng = np.random.default_rng(2)
    for _ in range(50):
        x = (flux * np.exp(0.05 * rng.normal(size=(3, 3))))
        x = x + x.T
        assert likelihood(linalg.row_normalized(x)) <= likelihood(t) + 1e-9
    with pytest.warns(ConvergenceWarning):
        linalg.reversible_mle(c, most=3)
    both, t, pi = msm.transpose(matrix(spark, c))
    assert dense(both, 3).tolist() == ((c + c.T) / 2).tolist() and np.allclose(linalg.gather_vector(pi, 3), (c + c.T).sum(axis=1) / (2 * c.sum()))
    _, t, _ = msm.normalize(matrix(spark, [[0, 0], [1, 3]]), n_states=2)
    assert dense(t, 2).tolist() == [[0, 0], [0.25, 0.75]]
    with pytest.raises(ImproperlyConfigured):
        msm.builder("nonsense")


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = frames(spark, [rng.integers(0, 3, 60).tolist() for _ in range(3)])
    own = msm.MSM(1, "transpose", trim=True).fit(df)
    own.save(f"{tmp_path}/m")
    assert msm.MSM.load(spark, f"{tmp_path}/m") == own and own != msm.MSM(2, "transpose", trim=True).fit(df)
    with pytest.raises(ImproperlyConfigured):
        msm.MSM(1).n_states_  # noqa: B018


def walk(seed, n):
    """A random walk's matrix with every entry above 0."""
    return linalg.row_normalized(np.random.default_rng(seed).random((n, n)) + 0.05)


def test_committors():
    for seed, sources, sinks in ((1, [0], [4]), (2, [0, 3], [1]), (3, [2], [0, 5])):
        t = walk(seed, 6)
        q = np.isin(np.arange(6), sinks).astype(float)
        for _ in range(2000):
            q = t @ q
            q[sources], q[sinks] = 0, 1
        assert np.allclose(linalg.committors(t, sources, sinks), q, atol=1e-9)
    with pytest.raises(DataInvalid):
        linalg.committors(walk(1, 3), [0], [0])


def test_passage_times():
    t = walk(4, 5)

    def steps(sinks):
        m = np.zeros(5)
        for _ in range(3000):
            m = 1 + t @ m
            m[sinks] = 0
        return m

    assert np.allclose(linalg.mfpts(t), np.stack([steps([j]) for j in range(5)], axis=1), atol=1e-8)
    assert np.allclose(linalg.mfpts(t, [1, 4], lagtime=5), 5 * steps([1, 4]), atol=1e-8)


def test_fluxes(spark):
    c = np.random.default_rng(5).integers(1, 30, (4, 4))
    t = linalg.row_normalized((c + c.T).astype(float))
    pi = (c + c.T).sum(axis=1) / (c + c.T).sum()
    q = linalg.committors(t, [0], [3])
    want = np.array([[pi[i] * (1 - q[i]) * t[i, j] * q[j] if i != j else 0 for j in range(4)] for i in range(4)])
    flux = tpt.reactive_fluxes(matrix(spark, t), [0], [3])
    assert np.allclose(dense(flux, 4), want)
    assert np.allclose(dense(tpt.net_of(flux), 4), np.maximum(want - want.T, 0))
    inner = want - want.T
    assert np.allclose(inner[[1, 2]].sum(axis=1), 0)  # what flows into a state between flows out of it


def widest(flux, source, sink):
    """By trying every simple path: the largest least flux, then fewer steps, then smaller states."""
    inner = [k for k in range(len(flux)) if k not in (source, sink)]
    found = []
    for n in range(len(inner) + 1):
        for middle in itertools.permutations(inner, n):
            path = [source, *middle, sink]
            if (width := min(flux[e] for e in zip(path, path[1:]))) > 0:
                found.append((-width, len(path), path))
    return min(found, default=None)


@pytest.mark.parametrize("mode", ["subtract", "bottleneck"])
def test_paths(spark, mode):
    rng = np.random.default_rng(6)
    flux = np.triu(np.where(rng.random((6, 6)) < 0.7, rng.integers(1, 40, (6, 6)), 0), 1).astype(float)
    left, want, total = flux.copy(), [], flux[0].sum()
    while sum(w for _, w in want) < total * (1 - 1e-10) and (best := widest(left, 0, 5)):
        width, _, path = best
        want.append((path, -width))
        edges = list(zip(path, path[1:]))
        least = min(edges, key=lambda e: left[e])
        if mode == "subtract":
            for e in edges:
                left[e] += width
        left[least] = 0
    found = {}
    for r in tpt.paths([0], [5], matrix(spark, flux), mode, n_states=6).orderBy("path_rank", "step").collect():
        found.setdefault(r.path_rank, ([], r.flux))[0].append(r.state)
    assert [(p, w) for p, w in found.values()] == want and len(want) > 2


def test_absorb_and_prune(spark):
    rng = np.random.default_rng(7)
    c = rng.integers(1, 6, (5, 5)) + 200.0 * np.eye(5)
    c[3], c[:, 3] = 0, 0
    c[3, 1], c[1, 3], c[3, 3] = 3, 2, 1  # a state of few counts beside state 1
    out, label = msm.absorb(c, [3])
    merge = np.zeros((5, 5))
    for k in range(5):
        merge[1 if k == 3 else k, k] = 1
    assert (out == merge @ c @ merge.T).all() and label.tolist() == [0, 1, 2, 1, 3]
    pruned, labels, kept = msm.bayesian_prune(c)
    assert (pruned == out).all() and labels.tolist() == label.tolist() and kept.tolist() == [0, 1, 2, 4]
    alone = np.diag([5.0, 60, 70])
    alone[1, 2] = alone[2, 1] = 9
    with pytest.raises(DataInvalid):
        msm.absorb(alone, [0])
    got = {r.i: r.v for r in msm.pseudo_scores(matrix(spark, c), 5).collect()}
    for k, row in enumerate(c + 0.2):
        p, shared = row / row.sum(), (row + 0.2) / (row.sum() + 1)
        assert abs(got[k] - (0.2 * np.log(0.2 / shared) + row * np.log(p / shared)).sum()) < 1e-9


def test_macrostates():
    """Groups that mix within and hardly between are what is left."""
    rng = np.random.default_rng(8)
    groups = np.repeat([0, 1, 2], [2, 4, 3])
    c = np.where(groups[:, None] == groups[None], rng.integers(200, 400, (9, 9)), rng.integers(2, 6, (9, 9))).astype(float)
    order = rng.permutation(9)
    groups, c = groups[order], c[np.ix_(order, order)]
    factors, labels = msm.bace(c, 2)
    same = lambda a: a[:, None] == a[None]
    assert (same(labels[3]) == same(groups)).all() and sorted(labels) == list(range(2, 9)) and factors[2] > 3 * factors[3]


def test_joint_counts(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 3, 80).tolist(), rng.integers(0, 4, 80).tolist()
    long = lambda v, k: spark.createDataFrame([(0, f, k, x) for f, x in enumerate(v)], "traj_id long, frame long, feature int, state int")
    got = {(r.u, r.v): r.n for r in info.joint_counts(long(a, 0), long(b, 1)).collect()}
    assert got == Counter(zip(a, b))


def test_apc_and_nmi(spark):
    rng = np.random.default_rng(10)
    m = rng.random((4, 4))
    m = np.minimum(m + m.T, 0.9) + np.eye(4)
    background = m @ m / 16
    h = np.diag(m)
    joint = np.where(np.eye(4, dtype=bool), m, h[:, None] + h[None] - m)
    assert np.allclose(dense(info.apc(matrix(spark, m), 4), 4), background)
    assert np.allclose(dense(info.nmi(matrix(spark, m)), 4), np.where(np.eye(4, dtype=bool), 1, m / joint))
    assert np.allclose(dense(info.nmi_apc(matrix(spark, m), 4), 4), (m - background) / joint)
    with pytest.raises(DataInvalid):
        info.check_symmetric(spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], "i int, j int, v double"))


def test_weighted_information_equals_repetition(spark):
    rng = np.random.default_rng(12)
    rows = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 2, 9), rng.integers(0, 2, 9), rng.integers(1, 6, 9))]
    once = spark.createDataFrame([(0, k, f, v, float(w)) for k, (a, b, w) in enumerate(rows) for f, v in enumerate((a, b))], "traj_id long, frame long, feature int, state int, w double")
    again = spark.createDataFrame([(0, 10 * k + r, f, v) for k, (a, b, w) in enumerate(rows) for r in range(w) for f, v in enumerate((a, b))], "traj_id long, frame long, feature int, state int")
    a = {(r.fa, r.fb): r.mi for r in info.weighted_mi(once, "w").collect()}
    b = {(r.fa, r.fb): r.mi for r in info.mi_matrix(again, None, {0: 2, 1: 2}).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_divergence_edges(spark):
    p, q = matrix(spark, [[0.5, 0.5], [0.0, 1.0]]), matrix(spark, [[1.0, 0.0], [0.5, 0.5]])
    assert {r.i: r.v for r in info.kl_divergence(p, q).collect()} == {0: float("inf"), 1: 1.0}
    with pytest.raises(Exception, match="negative"):
        info.kl_divergence(matrix(spark, [[-0.5, 1.5], [0.5, 0.5]]), p).collect()


def test_deconvolution_inverts_closure():
    direct = np.array([[0.2, 0.1], [0.1, 0.3]])
    assert np.allclose(linalg.deconvolve(direct @ np.linalg.inv(np.eye(2) - direct)), direct)


def test_transitions(spark):
    rng = np.random.default_rng(13)
    rows = [rng.integers(0, 3, n).tolist() for n in (30, 12, 1)]
    want = [(t, f) for t, row in enumerate(rows) for f in range(len(row) - 1) if row[f] != row[f + 1]]
    assert sorted(tuple(r) for r in counts.state_transitions(frames(spark, rows)).collect()) == want


def series(spark, rows):
    return spark.createDataFrame([(t, 0, f, s) for t, row in enumerate(rows) for f, s in enumerate(row)], "traj_id long, feature int, frame long, state int")


def test_order_and_disorder_times(spark):
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 2, 40).tolist(), [0] * 10, [0, 0, 0, 1, 1], [1, 0]]
    got = {r.traj_id: r for r in cards.transition_stats(series(spark, rows)).collect()}
    for k, row in enumerate(rows):
        t = [f for f in range(len(row) - 1) if row[f] != row[f + 1]]
        gaps = np.diff(t)
        if not t:
            want = (0, 0, 0, 0)
        elif len(t) == 1:
            want = (t[0] * (t[0] + 1) / 2, t[0], 0, 0)
        else:
            w = np.array([t[0], *gaps])
            want = ((w * (w + 1) / 2).sum() / w.sum(), t[-1], gaps.mean(), t[-1] - t[0])
        assert np.allclose([got[k].ord_time, got[k].n_ord, got[k].disord_time, got[k].n_disord], want)


def hysteresis(angles, boundaries, width):
    def basin(a):
        return sum(a >= b for b in boundaries[1:-1])

    out = [basin(angles[0])]
    for a in angles[1:]:
        low, high = cards.gates(boundaries, width)[out[-1]]
        gone = high <= a <= low if high < low else not low <= a <= high
        out.append(basin(a) if gone else out[-1])
    return out


@pytest.mark.parametrize("boundaries", [[0, 180, 360], [0, 160, 360], [0, 120, 240, 360]])
def test_rotamers_follow_the_state_machine(spark, boundaries):
    rng = np.random.default_rng(5)
    rows = [np.round(rng.uniform(0, 359.5, 80), 1).tolist() for _ in range(10)] + [[15.0, 345.0, 165.0, 195.0, 105.0, 255.0, 135.0, 225.0, 0.0, 359.5]]
    df = spark.createDataFrame([(t, 0, f, a) for t, row in enumerate(rows) for f, a in enumerate(row)], "traj_id long, feature int, frame long, angle double")
    got = {}
    for r in cards.rotamers(df, boundaries).orderBy("traj_id", "frame").collect():
        got.setdefault(r.traj_id, []).append(r.state)
    assert got == {t: hysteresis(row, boundaries, 15) for t, row in enumerate(rows)}


def blobs(spark, n=20):
    rng = np.random.default_rng(14)
    centers = [(0, 0), (12, 3), (-4, 15)]
    return spark.createDataFrame([(k, i, (rng.normal(size=2) + c).tolist(), k) for k, c in enumerate(centers) for i in range(n)], "traj_id long, frame long, x array<double>, blob int")


def pure(result, df):
    pairs = result.assignments.join(df, ["traj_id", "frame"]).select("state", "blob").distinct().collect()
    return len(pairs) == 3 and len({p.state for p in pairs}) == 3


def test_clusterers_find_blobs(spark):
    df = blobs(spark)
    assert pure(clustering.KCenters("euclidean", 3).fit(df).result_, df)
    assert pure(clustering.KHybrid("euclidean", 3, n_iters=1).fit(df).result_, df)
    own = clustering.KCenters("euclidean", cluster_radius=6.0).fit(df)
    assert pure(own.result_, df) and own.distances_.agg({"distance": "max"}).first()[0] <= 6.0
    again = own.predict(df)
    assert again.assignments.exceptAll(own.labels_.join(own.distances_, ["traj_id", "frame"])).isEmpty()
    for bad in (lambda: clustering.KCenters("euclidean"), lambda: clustering.KCenters("euclidean", 3).predict(df), lambda: clustering.kcenters(df), lambda: clustering.kcenters(df, "nonsense", 2)):
        with pytest.raises(ImproperlyConfigured):
            bad()


def test_medoids_never_get_worse(spark):
    df = blobs(spark)
    start = clustering.kcenters(df, "euclidean", 3)
    base = df.select("traj_id", "frame", "x")
    swept = clustering.pam_sweep(base, start, "euclidean", ["traj_id", "frame"], seed=1)
    assert clustering.mean_square(swept.assignments) <= clustering.mean_square(start.assignments)


def test_bootstrap(spark):
    df = frames(spark, [[0, 1] * 30, [1, 0, 0] * 20, [0, 0, 1, 1] * 15, [1, 1] * 20])
    weights = sampling.bootstrap_weights(df, 3, 7)
    assert {r[0]: r[1] for r in weights.groupBy("trial").sum("times").collect()} == {0: 4, 1: 4, 2: 4}
    by = sampling.bootstrap(df, lambda x: dense(counts.assigns_to_counts(x), 2), 3, 7)
    got = sampling.bootstrap_counts(df, 1, 3, 7)
    for k in range(3):
        assert (dense(got.where(f"trial = {k}"), 2) == by[k]).all()


def test_synthetic_paths_follow_the_model(spark):
    t = [[0.9, 0.1], [0.3, 0.7]]
    df = sampling.synthetic_trajectories(matrix(spark, t), 2, 40, 500, seed=3)
    assert np.allclose(dense(msm.row_normalize(counts.assigns_to_counts(df)), 2), t, atol=0.02)


def test_affinity_propagation_finds_groups():
    s = np.kron(np.eye(3), np.ones((4, 4))) + 0.01
    labels = linalg.affinity_propagation(s, 0.9, 0.0)
    assert [len(set(labels[k : k + 4])) for k in (0, 4, 8)] == [1, 1, 1] and len(set(labels)) == 3


def test_exponential_fits():
    t = np.linspace(0.1, 20, 100)
    assert np.allclose(linalg.fit_exponentials(t, 5 * np.exp(-t / 3), [1, 1]), [5, 3], rtol=1e-4)
    p = linalg.fit_exponentials(t, 5 * np.exp(-t / 1) + 2 * np.exp(-t / 7), [3, 3, 0.5, 10])
    assert np.allclose(sorted(zip(p[2:], p[:2])), [(1, 5), (7, 2)], rtol=1e-2)
