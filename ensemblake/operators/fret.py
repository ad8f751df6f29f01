"""Single-molecule FRET: dye clouds, bursts and lifetimes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fret, linalg
from ..functions.draws import Draws
from ..functions.geometry import cb_coords, placed, residue_frame
from ..functions.metrics import filled_bins
from ..plans.shared import sized, workers_can_import
from .msm import normalize
from .pockets import near_points

BY = ["frame"]


def remove_clashes(points: DataFrame, atoms: DataFrame, probe_radius: float = 0.17, most_radius: float = 0.2, by: list[str] = BY) -> DataFrame:
    """Points (by, id, px, py, pz) that are near no atom (by, x, y, z, radius): an anti-join on cells of space."""
    hit = near_points(points, atoms, ["px", "py", "pz"], F.col("radius") + probe_radius, most_radius + probe_radius, list(by)).select(*by, "id").distinct()
    return points.join(hit, [*by, "id"], "left_anti")


def place_cloud(cloud: DataFrame, atoms: DataFrame, res_seq: int) -> DataFrame:
    """frame, id, px, py, pz: a cloud's points (id, x, y, z in a residue's axes from its CB) on a residue of every frame that has its N, CA and C.

    A cloud is a library; it goes out with the tasks while its points are counted to be few.
    """
    at = lambda name: F.max(F.when(F.col("name") == name, F.array("x", "y", "z")))
    own = atoms.where(F.col("res_seq") == res_seq).groupBy("frame").agg(at("N").alias("n"), at("CA").alias("ca"), at("C").alias("c")).where("n IS NOT NULL AND ca IS NOT NULL AND c IS NOT NULL")
    own = own.select("frame", residue_frame(F.col("n"), F.col("ca"), F.col("c")).alias("axes"), cb_coords(F.col("n"), F.col("ca"), F.col("c")).alias("cb"))
    both = own.crossJoin(sized(cloud.select("id", F.array("x", "y", "z").alias("p")), 1_000_000)).select("frame", "id", placed(F.col("p"), F.col("axes"), F.col("cb")).alias("p"))
    return both.select("frame", "id", *(F.col("p")[k].alias(c) for k, c in enumerate(("px", "py", "pz"))))


def clear_conformers(dye: DataFrame, atoms: DataFrame, n_atoms: int, probe_radius: float = 0.04, atom_tol: int = 6, most_radius: float = 0.2, by: list[str] = BY) -> DataFrame:
    """by, conformer of dye conformers (by, conformer, id, px, py, pz) all but atom_tol of whose atoms are free."""
    free = remove_clashes(dye, atoms, probe_radius, most_radius, by)
    return free.groupBy(*by, "conformer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_atoms - atom_tol).select(*by, "conformer")


#: Points in a block of a cloud, about: two blocks make a million distances at a time.
SIDE = 1024


def _blocks(points: DataFrame, by: list[str], side: int) -> DataFrame:
    """by, block, blocks (of a frame), px, py, pz, times (arrays): a cloud's different points in blocks of about `side`, dealt by a hash of their place."""
    sum_ = F.col("px") + F.col("py") + F.col("pz")
    there = points.where(sum_.isNotNull() & ~F.isnan(sum_))
    different = there.groupBy(*by, *(F.col(c).cast("double").alias(c) for c in ("px", "py", "pz"))).agg(F.count(F.lit(1)).alias("times"))
    sizes = different.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("blocks"))
    dealt = different.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("px", "py", "pz"), "blocks").cast("int"))
    return dealt.groupBy(*by, "blocks", "block").agg(*(F.collect_list(c).alias(c) for c in ("px", "py", "pz", "times")))


def _distance_counts(width: float, by: list[str]):
    """Of rows with a block of each cloud: by, bin, n. Differences are taken axis by axis, as the plain expression would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bins, counts = [], [], []
            arrays = {c: batch.column(c) for c in ("px", "py", "pz", "times", "ox", "oy", "oz", "o_times")}
            for k in range(batch.num_rows):
                own = {c: a[k].values.to_numpy() for c, a in arrays.items()}
                d2 = np.zeros((len(own["px"]), len(own["ox"])))
                for c in "xyz":
                    step = own[f"p{c}"][:, None] - own[f"o{c}"][None, :]
                    d2 += step * step
                at = np.floor(np.sqrt(d2) / width).astype(np.int64).ravel()
                weights = own["times"][:, None] * own["o_times"][None, :]
                found, where = np.unique(at, return_inverse=True) if at.max() > 1_000_000 else (None, at)
                n = np.bincount(where, weights.ravel() if weights.max() > 1 else None)
                seen = np.flatnonzero(n)
                rows.append(np.full(len(seen), k))
                bins.append(seen if found is None else found[seen])
                counts.append(n[seen].astype(np.int64))
            if rows:
                keys = batch.select(by).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.concatenate(bins).astype(np.int32)), pa.array(np.concatenate(counts))], names=[*by, "bin", "n"])

    return run


def distance_histogram(a: DataFrame, b: DataFrame, bin_width: float = 0.1, by: list[str] = BY, side: int = SIDE) -> DataFrame:
    """by, bin, lo, hi, n, density: of all distances between two clouds of one frame. Points without a place have none.

    Equal points are counted once, with their number. Each block of a cloud meets each of the other's in a row of its own, so a large frame is spread over tasks, and a
    row's distances are binned where they are made: memory is that of two blocks, and what is shuffled are blocks and counts.
    """
    by = list(by)
    workers_can_import(a.sparkSession)
    own, other = _blocks(a, by, side), _blocks(b, by, side)
    ends = other.select(*by, "blocks").distinct().withColumnRenamed("blocks", "__n")
    asked = own.drop("blocks", "block").join(ends, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    other = other.select(*by, "block", F.col("px").alias("ox"), F.col("py").alias("oy"), F.col("pz").alias("oz"), F.col("times").alias("o_times"))
    both = asked.join(other, [*by, "block"]).drop("block")
    kinds = dict(both.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "bin int", "n long"])
    counts = both.mapInArrow(_distance_counts(bin_width, by), schema).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    counts = filled_bins(counts, bin_width, by)
    total = counts.groupBy(*by).agg((F.sum("n") * bin_width).alias("__area"))
    return counts.join(total, by).withColumn("density", F.col("n") / F.col("__area")).drop("__area")


def both_orders(first: DataFrame, second: DataFrame, by: list[str] = BY) -> DataFrame:
    """by, bin, lo, hi, p: distance distributions of the two ways to place a pair of dyes, half each."""
    halves = first.select(*by, "bin", "lo", "hi", "density").unionByName(second.select(*by, "bin", "lo", "hi", "density"))
    return halves.groupBy(*by, "bin").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), (F.sum("density") / 2).alias("p"))


def photon_frames(photons: DataFrame, lagtime: float, slowing_factor: float) -> DataFrame:
    """photons (burst_id, k, dt_us) with frame: the running sum of waits, each cut to whole model steps first."""
    step = F.floor(F.col("dt_us") * 1000 / (lagtime * slowing_factor)).cast("long")
    return photons.withColumn("frame", F.sum(step).over(Window.partitionBy("burst_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))


def uniform(*key, seed: int):
    """In [0, 1), from a hash of a row's key: the same in any partitioning."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def sample_distances(frames: DataFrame, distribution: DataFrame, state: str, key: list[str], seed: int = 0) -> DataFrame:
    """frames with r: a distance drawn from its state's distribution (state, bin, lo, hi, p), evenly within the bin."""
    w = Window.partitionBy("state").orderBy("bin")
    cdf = distribution.withColumn("z", F.sum("p").over(w)).withColumn("all", F.sum("p").over(Window.partitionBy("state")))
    table = cdf.groupBy("state").agg(F.sort_array(F.collect_list(F.struct((F.col("z") / F.col("all")).alias("z"), "lo", "hi"))).alias("cdf")).withColumnRenamed("state", state)
    drawn = frames.withColumn("__u", uniform(*key, seed=seed)).join(table, state)
    bin_ = F.element_at(F.filter("cdf", lambda b: (b["z"] > F.col("__u")) | (b["z"] >= 1)), 1)
    return drawn.withColumn("__b", bin_).withColumn("r", F.col("__b.lo") + (F.col("__b.hi") - F.col("__b.lo")) * uniform(*key, seed=seed + 1)).drop("__b", "__u", "cdf")


def _path(t: np.ndarray, start: np.ndarray, frames: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """States at rising frames of one path through a Markov model, skipping steps by matrix powers."""
    powers: dict[int, np.ndarray] = {}
    state = int(rng.choice(len(start), p=start / start.sum()))
    out, last = np.empty(len(frames), np.int64), 0
    for k, f in enumerate(frames):
        gap = int(f - last)
        if gap:
            if gap not in powers:
                powers[gap] = np.cumsum(np.linalg.matrix_power(t, gap), axis=1)
            row = powers[gap][state]
            state = int(min(np.searchsorted(row, rng.random() * row[-1], "right"), len(row) - 1))
        out[k], last = state, f
    return out


def sample_bursts(photons: DataFrame, t: DataFrame, populations: DataFrame, n_states: int, seed: int = 0) -> DataFrame:
    """photons (burst_id, k, frame) with the state of a simulated path at each; a burst is one group, with a seed of its own."""
    workers_can_import(photons.sparkSession)
    dense, pi = linalg.gather(t, n_states), linalg.gather_vector(populations, n_states)
    kind = dict(photons.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        rng = np.random.default_rng([seed, int(group["burst_id"].iloc[0])])
        return group[["burst_id", "k", "frame"]].assign(state=_path(dense, pi, group["frame"].to_numpy(), rng))

    return photons.select("burst_id", "k", "frame").groupBy("burst_id").applyInPandas(run, f"burst_id {kind['burst_id']}, k {kind['k']}, frame {kind['frame']}, state long")


def burst_efficiencies(bursts: DataFrame, efficiency: str = "e", seed: int = 0) -> DataFrame:
    """burst_id, efficiency, n: the share of photons that a transfer of probability e makes red."""
    red = (uniform("burst_id", "k", seed=seed) < F.col(efficiency)).cast("double")
    return bursts.groupBy("burst_id").agg(F.avg(red).alias("efficiency"), F.count(F.lit(1)).alias("n"))


def dyeless_states(states: DataFrame, conformers: DataFrame) -> DataFrame:
    """States (state) with no conformer at all."""
    return states.join(conformers.select("state").distinct(), "state", "left_anti")


def remove_bad_states(counts: DataFrame, bad: DataFrame) -> DataFrame:
    """Counts without the rows and columns of bad states (state)."""
    return counts.join(bad.select(F.col("state").alias("i")), "i", "left_anti").join(bad.select(F.col("state").alias("j")), "j", "left_anti").select("i", "j", "v")


def labelled_model(counts: DataFrame, bad1: DataFrame, bad2: DataFrame, n_states: int):
    """The model without states that either dye can't label."""
    return normalize(remove_bad_states(counts, bad1.select("state").union(bad2.select("state")).distinct()), n_states=n_states)


def per_state_efficiency(states: DataFrame, events: DataFrame) -> DataFrame:
    """state, fe: transfers over transfers and photons among its events (state, outcome); NaN where it has none."""
    n = events.groupBy("state").agg(F.count_if(F.col("outcome") == "energy_transfer").alias("t"), F.count_if(F.col("outcome") == "radiative").alias("r"))
    both = states.join(n, "state", "left")
    return both.select("state", F.coalesce(F.try_divide("t", F.col("t") + F.col("r")), F.lit(float("nan"))).alias("fe"))


#: Pairs of states that a task takes, about, and states in a block of donors and in one of acceptors.
PAIRS, DONORS, ACCEPTORS = 20_000_000, 256, 1024
STATE = ["p", "x", "y", "z", "u", "v", "w"]


def _different(states: DataFrame) -> DataFrame:
    """p, x, y, z, u, v, w: a dye's different states that have an origin and a dipole's direction, with their probability in all."""
    vector = lambda c: F.when(F.col(c).isNull() | (F.size(c) == 3), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} needs three components")).cast("array<double>")).cast("array<double>")
    own = states.select("p", vector("origin").alias("o"), vector("dipole").alias("d"))
    own = own.select(F.col("p").cast("double").alias("p"), *(F.col(v)[k].alias(c) for v, names in (("o", "xyz"), ("d", "uvw")) for k, c in enumerate(names)))
    there = own.where((F.col("x") + F.col("y") + F.col("z")).isNotNull() & (F.sqrt(sum((F.col(c) * F.col(c) for c in "vw"), F.col("u") * F.col("u"))) > 0))
    return there.groupBy(*STATE[1:]).agg(F.sum("p").alias("p")).where("p IS NOT NULL")


def _dealt(states: DataFrame, n: int, side: int, name: str) -> DataFrame:
    """Columns of n states as arrays, in blocks of about `side`, dealt by a hash of their place."""
    block = F.pmod(F.xxhash64(*STATE[1:]), F.lit(max(1, -(-n // side))))
    return states.groupBy(block.alias("block")).agg(*(F.collect_list(c).alias(f"{name}{c}") for c in STATE)).drop("block")


def _transfers(factor: float):
    """Of rows with a block of either dye: efficiencies of their pairs, each times its probability; null where no two are apart. factor: of the orientation's in R0^6."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, seen = 0.0, False
            for k in range(batch.num_rows):
                (p, *d), (q, *a) = ([batch.column(f"{name}{c}")[k].values.to_numpy() for c in STATE] for name in ("d_", "a_"))
                with np.errstate(all="ignore"):
                    for dye in (d, a):
                        length = np.sqrt(dye[3] * dye[3] + dye[4] * dye[4] + dye[5] * dye[5])
                        dye[3:] = [c / length for c in dye[3:]]
                    r2, turned, by_d, by_a = (np.zeros((len(p), len(q))) for _ in range(4))
                    for c in range(3):
                        step, du, au = a[c][None, :] - d[c][:, None], d[c + 3][:, None], a[c + 3][None, :]
                        by_d += step * du
                        by_a += step * au
                        turned += du * au
                        step *= step
                        r2 += step
                    by_d *= by_a
                    by_d /= r2
                    by_d *= 3
                    turned -= by_d
                    turned *= turned
                    turned *= factor
                    turned /= turned + r2 * r2 * r2
                turned[r2 == 0] = 0
                seen = seen or bool(np.any(r2 != 0))
                total += float(p @ turned @ q)
            yield pa.RecordBatch.from_arrays([pa.array([total if seen else None], pa.float64())], names=["fe"])

    return run


def isotropic_efficiency(donors: DataFrame, acceptors: DataFrame, j: float, qd: float, n: float = 1.333) -> DataFrame:
    """One row, fe: over all pairs of a donor's and an acceptor's states (p, origin, dipole), each by its probability.

    Equal states are taken once. Blocks of donors meet blocks of acceptors, which go out with the tasks while they are counted to be few, and a block's pairs are summed
    where they are made: time grows with the pairs, memory is that of two blocks. A pair at one place, or without a place or direction, has weight but no efficiency.
    """
    workers_can_import(donors.sparkSession)
    own, other = _different(donors), _different(acceptors)
    n_own, n_other = own.count(), other.count()
    tasks = -(-n_own * n_other // PAIRS) or 1
    d, a = _dealt(own, n_own, DONORS, "d_"), _dealt(other, n_other, ACCEPTORS, "a_")
    if n_other <= 500_000:
        both = d.repartition(min(tasks, -(-n_own // DONORS)) or 1).crossJoin(F.broadcast(a))
    else:
        both = d.repartition(side := int(np.ceil(np.sqrt(tasks)))).crossJoin(a.repartition(side))
    found = both.mapInArrow(_transfers(fret.R0_FACTOR**6 * qd * j / n**4), "fe double").agg(F.sum("fe").alias("fe"))
    all_ = [df.where("p IS NOT NULL").agg(F.sum("p").alias(name)) for df, name in ((donors, "d_p"), (acceptors, "a_p"))]
    return found.crossJoin(F.broadcast(all_[0])).crossJoin(F.broadcast(all_[1])).select((F.col("fe") / (F.col("d_p") * F.col("a_p"))).alias("fe"))


#: Samples that a task steps together, about: they are topped up from the next batch as others decay.
TOGETHER = 1 << 14


def _drawn(cdf: np.ndarray, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The state that each u falls to in its row of cumulated probabilities, by halving: as searchsorted from the right, but never past the last."""
    n, flat = cdf.shape[1], cdf.ravel()
    first, low, high = rows * n, np.zeros(len(u), np.int64), np.full(len(u), n - 1)
    for _ in range(int(n - 1).bit_length()):
        middle = (low + high) >> 1
        beyond = (flat.take(first + middle) <= u) & (low < high)
        low, high = np.where(beyond, middle + 1, low), np.where(beyond, high, middle)
    return low


def resolve_excitations(samples: DataFrame, d_t: np.ndarray, a_t: np.ndarray, d_pi: np.ndarray, a_pi: np.ndarray, kret: np.ndarray, krad: float, knon: float, dt: float, seed: int = 0, most_steps: int = 1_000_000) -> DataFrame:
    """sample_id, lifetime, outcome of excitations (sample_id): both dyes move through their models until one of three decays.

    kret: transfer rates by (donor state, acceptor state). A sample draws from its own seed: two numbers for where it starts, then one for its decay and two for its move a step.
    The samples of a task step together, with the draws of each one's own generator; those that last go on beside the next batch's.
    """
    workers_can_import(samples.sparkSession)
    kind = dict(samples.dtypes)["sample_id"]
    cdfs = [np.cumsum(t, axis=1) for t in (d_t, a_t)]
    starts = [c / c[-1] for c in (np.cumsum(pi / pi.sum()) for pi in (d_pi, a_pi))]
    rates = np.stack(np.broadcast_arrays(float(krad), float(knon), kret), axis=-1)
    p = 1 - np.exp(-rates * dt)
    p /= np.maximum(p.sum(axis=-1, keepdims=True), 1)
    decay, any_ = np.cumsum(p, axis=-1).reshape(-1, 3), p.sum(axis=-1).ravel()
    names = pa.array(["radiative", "non_radiative", "energy_transfer", "excited"])

    def begun(ids: np.ndarray) -> list:
        """Samples as they start: id, generator, states of both dyes, steps so far."""
        draws = Draws(seed, ids if ids.dtype.kind in "iu" else np.array([int(s) for s in ids], object))
        d, a = (np.minimum(np.searchsorted(z, draws.random(), "right"), len(z) - 1) for z in starts)
        return [ids, draws, d, a, np.zeros(len(ids), np.int64)]

    def stepped(own: list, most: int, type_: pa.DataType) -> tuple[list, pa.RecordBatch]:
        """What is left when no more than `most` samples last, and those that decayed."""
        ids, draws, d, a, steps = own
        ended = [(ids[:0], steps[:0], steps[:0])]
        while len(ids) > most:
            over = steps == most_steps
            steps += ~over
            u, at = draws.random(), d * rates.shape[1] + a
            u[over] = 2
            gone = over | (u < any_.take(at))
            if gone.any():
                ended.append((ids[gone], steps[gone], (decay[at[gone]] <= u[gone, None]).sum(axis=1)))
                stay = np.flatnonzero(~gone)
                ids, draws, d, a, steps = (x[stay] for x in (ids, draws, d, a, steps))
            d, a = _drawn(cdfs[0], d, draws.random()), _drawn(cdfs[1], a, draws.random())
        done, took, outcome = (np.concatenate(x) for x in zip(*ended, strict=True))
        return [ids, draws, d, a, steps], pa.RecordBatch.from_arrays([pa.array(done, type_), pa.array(took * dt, pa.float64()), names.take(pa.array(outcome))], names=["sample_id", "lifetime", "outcome"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            new, type_ = begun(batch.column(0).to_numpy(zero_copy_only=False)), batch.schema.field(0).type
            own = new if own is None else [x + y if isinstance(x, Draws) else np.concatenate([x, y]) for x, y in zip(own, new, strict=True)]
            own, done = stepped(own, TOGETHER, type_)
            yield done
        if own is not None:
            yield stepped(own, 0, type_)[1]

    return samples.select("sample_id").repartition("sample_id").mapInArrow(run, f"sample_id {kind}, lifetime double, outcome string")


def photon_events(bursts: DataFrame, events: DataFrame, seed: int = 0) -> DataFrame:
    """bursts (burst_id, k, state) with an event's lifetime and outcome drawn from the state's events that gave a photon."""
    w = Window.partitionBy("state").orderBy("event_id")
    own = events.where("outcome <> 'non_radiative'").withColumn("at", F.row_number().over(w) - 1)
    sizes = own.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    drawn = bursts.join(sizes, "state").withColumn("at", F.floor(uniform("burst_id", "k", seed=seed) * F.col("n")).cast("int"))
    return drawn.join(own.select("state", "at", "lifetime", "outcome"), ["state", "at"]).drop("at", "n")


def burst_lifetimes(drawn: DataFrame) -> DataFrame:
    """burst_id, efficiency, mean lifetimes by colour."""
    red = F.col("outcome") == "energy_transfer"
    return drawn.groupBy("burst_id").agg(F.avg(red.cast("double")).alias("efficiency"), F.avg(F.when(red, F.col("lifetime"))).alias("acceptor_lifetime"), F.avg(F.when(~red, F.col("lifetime"))).alias("donor_lifetime"))


def fit_lifetimes(lifetimes: DataFrame, bins: int = 100, top: float = 25.0, n_exp: int = 1, p0: list[float] | None = None) -> list[float]:
    """Amplitudes, then times, of a sum of exponentials fitted to the histogram of a column `lifetime`; no fit: 0 and 100."""
    h = lifetimes.where(F.col("lifetime").between(0, top)).groupBy(F.least(F.floor(F.col("lifetime") * bins / top), F.lit(bins - 1)).alias("bin")).count().collect()
    y = np.zeros(bins)
    for b, n in h:
        y[int(b)] = n
    t = (np.arange(bins) + 0.5) * top / bins
    if not y.any():
        return [0.0] * n_exp + [100.0] * n_exp
    mean = float((t * y).sum() / y.sum())
    start = p0 or [y.max() / n_exp] * n_exp + [mean * (k + 1) / n_exp * 1.3 for k in range(n_exp)]
    return linalg.fit_exponentials(t, y, start).tolist()


def fit_time_factor(predicted: DataFrame, measured: DataFrame, by: str = "time_factor") -> DataFrame:
    """by, diff of the one whose histogram (by, bin, p) is nearest to the measured (bin, p)."""
    from ..functions.metrics import sum_sq_resid

    rss = sum_sq_resid(predicted, measured, [by])
    return rss.agg(F.min_by(by, F.struct("rss", by)).alias(by), F.min("rss").alias("diff"))
