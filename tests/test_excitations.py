"""Excitations of two dyes step together, with the draws of one after another."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblake.functions.draws import Draws
from ensemblake.operators import fret as fr
from ensemblake.plans import q_more


def one_by_one(ids, d_t, a_t, d_pi, a_pi, kret, krad, knon, dt, seed, most_steps):
    """sample_id: (lifetime, outcome), each sample from its own generator."""
    out, names = {}, ["radiative", "non_radiative", "energy_transfer"]
    for s in ids:
        rng = np.random.default_rng([seed, s])
        d, a = rng.choice(len(d_pi), p=d_pi / d_pi.sum()), rng.choice(len(a_pi), p=a_pi / a_pi.sum())
        for step in range(1, most_steps + 1):
            out[s] = (step * dt, "excited")
            p = 1 - np.exp(-np.array([krad, knon, kret[d, a]]) * dt)
            p = p / p.sum() if p.sum() > 1 else p
            if (u := rng.random()) < p.sum():
                out[s] = (step * dt, names[np.searchsorted(np.cumsum(p), u, "right")])
                break
            d = min(np.searchsorted(np.cumsum(d_t[d]), rng.random(), "right"), len(d_pi) - 1)
            a = min(np.searchsorted(np.cumsum(a_t[a]), rng.random(), "right"), len(a_pi) - 1)
    return out


def test_samples_keep_their_own_draws(spark):
    rng = np.random.default_rng(3)
    d_t, a_t = rng.dirichlet(np.ones(5), 5), rng.dirichlet(np.ones(3), 3)
    d_pi, a_pi, kret = rng.random(5), rng.random(3), rng.random((5, 3)) * 2
    kret[2, 1] = 400.0  # all three together exceed 1
    for krad, knon, dt, most in ((0.2, 0.02, 0.1, 1_000_000), (30.0, 9.0, 0.1, 1000), (0.01, 0.01, 0.01, 37)):
        args = (d_t, a_t, d_pi, a_pi, kret, krad, knon, dt, 7, most)
        got = {r.sample_id: (r.lifetime, r.outcome) for r in fr.resolve_excitations(spark.range(400).select((F.col("id") * 13).alias("sample_id")), *args).collect()}
        assert got == one_by_one(range(0, 400 * 13, 13), *args)
    assert fr.resolve_excitations(spark.range(0).toDF("sample_id"), *args).collect() == []


def test_a_hundred_thousand_samples_in_time(spark):
    """One after another in the task that read them they took over a minute."""
    t, pi = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([2 / 3, 1 / 3])
    at = time.time()
    own = fr.resolve_excitations(spark.range(0, 100_000, 1, 1).toDF("sample_id"), t, t, pi, pi, np.array([[0.5, 0.1], [0.1, 0.02]]), 0.22, 0.02, 0.1, 7)
    assert own.where("lifetime > 0").count() == 100_000
    assert time.time() - at < 40


def test_query_over_every_event_in_time(spark, tmp_path):
    spark.range(0, 60_000, 1, 1).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    at = time.time()
    row = q_more.Q["every_excitation_decays"][0](spark, str(tmp_path)).first()
    assert (row.n, row.positive, row.outcomes) == (60_000, True, 3)
    assert time.time() - at < 25


def test_generators_draw_together_what_each_draws_alone():
    sets = np.array([0, 1, 2**31, 2**32 - 1, 2**32, 2**62 + 3, 2**63 - 1]), np.array([0, 2**64 - 1], np.uint64), np.array([3, 2**64, 10**37], object), np.array([1, 2], np.int32)
    for seed in (0, 7, 2**40 + 3, 2**100 + 1):
        for keys in sets:
            own, alone = Draws(seed, keys), [np.random.default_rng([seed, int(k)]) for k in keys]
            assert all(own.random().tolist() == [rng.random() for rng in alone] for _ in range(20))
    with pytest.raises(ValueError):
        Draws(7, np.array([3, -1]))


def test_samples_that_last_go_on_with_the_next_batch(spark, monkeypatch):
    """Batches of 64 ids of several kinds, at most 20 samples of which are carried on."""
    monkeypatch.setattr(fr, "TOGETHER", 20)
    rng = np.random.default_rng(4)
    args = rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(2), 2), rng.random(4), rng.random(2), rng.random((4, 2)), 0.2, 0.02, 0.1, 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        for kind in ("long", "int", "string", "decimal(25,0)"):
            for most in (1_000_000, 30, 1, 0):
                made = fr.resolve_excitations(spark.range(900).selectExpr(f"cast(id * 11 AS {kind}) AS sample_id"), *args, most)
                assert dict(made.dtypes)["sample_id"] == kind.replace("long", "bigint")
                got = {int(r.sample_id): (r.lifetime, r.outcome) for r in made.collect()}
                want = one_by_one(range(0, 9900, 11), *args, most) if most else {s: (0.0, "excited") for s in range(0, 9900, 11)}
                assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_million_events_sooner_than_a_generator_each(spark, tmp_path):
    """Against this machine's time for generators one after another, of a twentieth of the events: four tasks that made them took ten times that."""
    for name, n in (("few", 1000), ("many", 1_000_000)):
        spark.range(0, n, 1, 1).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/{name}/events.parquet")
    query = q_more.Q["every_excitation_decays"][0]
    query(spark, f"{tmp_path}/few").collect()
    at = time.time()
    for k in range(50_000):
        np.random.default_rng([7, k]).random(62)
    alone, at = time.time() - at, time.time()
    row = query(spark, f"{tmp_path}/many").first()
    took = time.time() - at
    assert (row.n, row.positive, row.outcomes) == (1_000_000, True, 3)
    assert took < 5 * alone, (took, alone)
