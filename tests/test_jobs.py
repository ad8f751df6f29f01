"""Streams, jobs and the driver contract."""

import argparse
import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblake import cli, util
from ensemblake.exceptions import DataInvalid, ImproperlyConfigured
from ensemblake.functions import linalg
from ensemblake.operators import cards, counts
from ensemblake.sources import tables
from ensemblake.streaming import transitions


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def late(spark, df, path, delay):
    """df as a stream of five files in which events come up to `delay` seconds late, then two later ones that move the watermark on."""
    arrival = F.col("frame") + F.pmod(F.xxhash64("frame", *df.columns[:1]), F.lit(delay))
    own = df.withColumn("file", F.floor(arrival / 20))
    for k in range(5):
        own.where(f"file = {k}").drop("file").orderBy(F.desc("ts")).coalesce(1).write.parquet(f"{path}/in/b{k}")
    for k in (5, 6):
        df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(10_000.0 * k))).withColumn(df.columns[0], F.lit(-k).cast(df.dtypes[0][1])).write.parquet(f"{path}/in/b{k}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@pytest.mark.parametrize("lag", [1, 3])
def test_stream_equals_batch(spark, tmp_path, lag):
    rng = np.random.default_rng(1)
    rows = [(t, f, int(rng.integers(-1, 4))) for f in range(60) for t in range(5)]
    df = spark.createDataFrame(rows, "traj_id long, frame long, state int").selectExpr("*", "timestamp_seconds(frame + 100) AS ts")
    stream = late(spark, df, tmp_path, 25)
    pairs = drain(transitions.streaming_transitions(stream, lag, delay="30 seconds"), f"pairs{lag}")
    got = linalg.gather(transitions.streaming_counts(pairs), 4)
    assert (got == linalg.gather(counts.assigns_to_counts(df, lag), 4)).all() and got.sum() > 0


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped with events still held: what was held, and what is kept of a key, come back; slots of 4 seconds release in order of time too."""
    rng = np.random.default_rng(7)
    rows = [(t, f, int(rng.integers(-1, 4))) for f in range(60) for t in range(3)]
    df = spark.createDataFrame(rows, "traj_id long, frame long, state int").selectExpr("*", "timestamp_seconds(frame + 100) AS ts")
    late(spark, df, tmp_path, 25)
    kinds = {c: k for c, k in df.dtypes}

    def step(last, now):
        if now is None or now == -1:
            return None
        last.append(int(now))
        return (last.pop(0), int(now)) if len(last) > 1 else None

    def run(width):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/arrived{width}/*")
        out = transitions._in_order(source, "traj_id", "state", "ts", "30 seconds", f"traj_id {kinds['traj_id']}, ts timestamp, i int, j int", "int", step, width)
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state{width}").option("path", f"{tmp_path}/out{width}").trigger(availableNow=True).start()
        query.awaitTermination()

    for width in (1, 4000):
        for part in ((0, 1, 2), (3, 4, 5, 6)):
            for k in part:
                shutil.copytree(f"{tmp_path}/in/b{k}", f"{tmp_path}/arrived{width}/b{k}")
            run(width)
        pairs = spark.read.parquet(f"{tmp_path}/out{width}")
        assert (linalg.gather(transitions.streaming_counts(pairs), 4) == linalg.gather(counts.assigns_to_counts(df, 1), 4)).all()


def test_events_after_the_watermark_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 50, 2), (0, 51, 3)], "traj_id long, frame long, state int").selectExpr("*", "timestamp_seconds(frame + 100) AS ts")
    for k, f in enumerate(([50], [51], [0, 1], [900], [901])):
        df.select("traj_id", "frame", "state", "ts").where(F.col("frame").isin(f)).union(df.limit(int(f[0] >= 900)).selectExpr("9L", "0L", "0", f"timestamp_seconds({f[0]})")).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pairs = drain(transitions.streaming_transitions(stream, 1, delay="10 seconds"), "dropped")
    assert [(r.i, r.j) for r in pairs.where("traj_id = 0").collect()] == [(2, 3)]


def test_streamed_rotamers(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(0, 0, f, float(a)) for f, a in enumerate(rng.uniform(0, 359, 50))]
    df = spark.createDataFrame(rows, "traj_id long, feature int, frame long, angle double").selectExpr("traj_id AS series", "traj_id", "feature", "frame", "angle", "timestamp_seconds(frame + 100) AS ts")
    got = drain(transitions.streaming_rotamers(late(spark, df, tmp_path, 25), [0, 120, 240, 360], delay="30 seconds"), "rot").where("series = 0")
    want = [r.state for r in cards.chi_rotamers(df).orderBy("frame").collect()]
    assert [r.state for r in got.orderBy("ts").collect()] == want


def test_jobs(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = [(t, f, (rng.normal(size=2) + 10 * (f % 3)).tolist()) for t in range(4) for f in range(30)]
    spark.createDataFrame(x, "traj_id long, frame long, x array<double>").write.parquet(f"{tmp_path}/x")
    cli.run(spark, ["cluster", "--features", f"{tmp_path}/x", "--clusters", "3", "--iterations", "1", "--subsample", "2", "--out", f"{tmp_path}/c"])
    a = spark.read.parquet(f"{tmp_path}/c/assignments")
    assert a.count() == 120 and a.select("state").distinct().count() == 3
    cli.run(spark, ["reassign", "--features", f"{tmp_path}/x", "--centers", f"{tmp_path}/c/centers", "--out", f"{tmp_path}/r"])
    assert spark.read.parquet(f"{tmp_path}/r").exceptAll(a.select("traj_id", "frame", "state", "distance")).isEmpty()
    cli.run(spark, ["implied", "--assignments", f"{tmp_path}/c/assignments", "--lag-times", "1:3:2", "--out", f"{tmp_path}/t"])
    assert {r.lag for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {1, 3}
    angles = [(t, k, f, "chi" if k else "phi", float(rng.uniform(0, 359))) for t in range(2) for k in range(2) for f in range(40)]
    spark.createDataFrame(angles, "traj_id long, feature int, frame long, kind string, angle double").write.parquet(f"{tmp_path}/a")
    cli.run(spark, ["cards", "--angles", f"{tmp_path}/a", "--out", f"{tmp_path}/k"])
    assert spark.read.parquet(f"{tmp_path}/k/struct_disorder").count() == 4
    cli.run(spark, ["entropy", "--angles", f"{tmp_path}/a", "--out", f"{tmp_path}/h"])
    assert spark.read.csv(f"{tmp_path}/h", header=True).count() == 2
    for bad in (["cluster", "--features", "x"], ["cluster", "--clusters", "2"], ["cluster", "--features", "x", "--clusters", "2", "--metric", "rmsd"], ["cluster", "--trajectories", "x", "--clusters", "2"], ["cluster", "--features", "x", "--radius", "1", "--algorithm", "kmedoids"], ["cards", "--angles", "x", "--buffer-width", "400"]):
        with pytest.raises(ImproperlyConfigured):
            cli.run(spark, [*bad, "--out", "y"])
    times = [(0, f, 0.25 * f) for f in range(3)]
    spark.createDataFrame(times, "traj_id long, frame long, time double").write.parquet(f"{tmp_path}/times")
    slow = [(0, f, f // 7 % 3) for f in range(200)]
    spark.createDataFrame(slow, "traj_id long, frame long, state int").write.parquet(f"{tmp_path}/slow")
    ask = ["implied", "--assignments", f"{tmp_path}/slow", "--lag-times", "1:1:1", "--prior"]
    cli.run(spark, [*ask, "--infer-timestep", f"{tmp_path}/times", "--out", f"{tmp_path}/t1"])
    cli.run(spark, [*ask, "--out", f"{tmp_path}/t2"])
    one, two = (sorted(r.timescale for r in spark.read.parquet(f"{tmp_path}/{n}").collect() if r.timescale == r.timescale) for n in ("t1", "t2"))
    assert np.allclose(one, 0.25 * np.array(two)) and one


def test_structures_are_clustered(spark, tmp_path):
    """Two folds of a small chain, turned and shifted at random, in models of PDB files."""
    rng = np.random.default_rng(5)
    folds = [rng.normal(size=(6, 3)) * 0.4 for _ in range(2)]
    for t in range(2):
        lines = []
        for m in range(5):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            q *= np.sign(np.linalg.det(q))
            xyz = folds[(m + t) % 2] @ q + rng.uniform(0, 3, 3) + rng.normal(size=(6, 3)) * 0.005
            lines.append(f"MODEL     {m + 1:4d}")
            for k, (x, y, z) in enumerate(xyz * 10):
                lines.append(f"ATOM  {2 * k + 1:5d}  CA  ALA A{k + 1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C")
                lines.append(f"ATOM  {2 * k + 2:5d}  O   ALA A{k + 1:4d}    {x + 1:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           O")
            lines.append("ENDMDL")
        (tmp_path / f"{t}.pdb").write_text("\n".join(lines))
    files = [f"{tmp_path}/{t}.pdb" for t in range(2)]
    cli.run(spark, ["cluster", "--trajectories", *files, "--atoms", "name CA", "--radius", "0.1", "--algorithm", "kcenters", "--out", f"{tmp_path}/c"])
    got = {(r.traj_id, r.frame): r.state for r in spark.read.parquet(f"{tmp_path}/c/assignments").collect()}
    assert len(got) == 10 and all((got[t, m] == got[0, 0]) == ((m + t) % 2 == 0) for t, m in got) and set(got.values()) == {0, 1}
    cli.run(spark, ["reassign", "--trajectories", files[0], "--atoms", "name CA", "--trajectories", files[1], "--atoms", "name CA", "--centers", f"{tmp_path}/c/centers", "--out", f"{tmp_path}/r"])
    assert {(r.traj_id, r.frame): r.state for r in spark.read.parquet(f"{tmp_path}/r").collect()} == got
    with pytest.raises(DataInvalid):
        tables.load_trajectories(spark, files, ["name CA", "name CA O"])


def test_fret_jobs(spark, tmp_path):
    """Two protein states, near and far: bursts are mostly red or blue, and a fit finds the time factor that made them."""
    n, ca, c = [0.0, 0.146, 0.0], [0.0, 0.0, 0.0], [0.152, 0.0, 0.0]
    atoms = [(f, 10 * r + k, name, r, p[0] + r * (3.0 + 5 * f), p[1], p[2], 0.15) for f in range(2) for r in (1, 2) for k, (name, p) in enumerate(zip(("N", "CA", "C"), (n, ca, c)))]
    put = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}")
    put(atoms, "frame int, atom_id long, name string, res_seq int, x double, y double, z double, radius double", "atoms")
    put([(k, 0.0, 0.0, 0.5 + 0.1 * k) for k in range(4)], "id int, x double, y double, z double", "cloud")
    cli.run(spark, ["dye-clouds", "--atoms", f"{tmp_path}/atoms", "--cloud", f"{tmp_path}/cloud", "--pairs", "1:2", "--out", f"{tmp_path}/distances"])
    mean = {r.state: r.r for r in spark.read.parquet(f"{tmp_path}/distances").groupBy("state").agg((F.sum(F.col("p") * (F.col("lo") + F.col("hi")) / 2)).alias("r")).collect()}
    assert abs(mean[0] - 3) < 0.3 and abs(mean[1] - 8) < 0.3
    put([(0, 0, 900.0), (0, 1, 5.0), (1, 0, 5.0), (1, 1, 900.0)], "i int, j int, v double", "counts")
    put([(b, k, 20.0) for b in range(120) for k in range(30)], "burst_id long, k long, dt_us double", "photons")
    common = ["--counts", f"{tmp_path}/counts", "--photons", f"{tmp_path}/photons", "--lagtime", "2000"]
    cli.run(spark, ["fret-bursts", *common, "--distances", f"{tmp_path}/distances/pair=1%3A2", "--r0", "5", "--time-factors", "0.05", "50", "--out", f"{tmp_path}/fret"])
    spark.read.parquet(f"{tmp_path}/fret").where("time_factor = 50").select("efficiency").write.parquet(f"{tmp_path}/measured")
    spread = {r.time_factor: r.s for r in spark.read.parquet(f"{tmp_path}/fret").groupBy("time_factor").agg(F.stddev("efficiency").alias("s")).collect()}
    assert spread[50.0] > 2 * spread[0.05]
    cli.run(spark, ["fit-fret", "--predicted", f"{tmp_path}/fret", "--measured", f"{tmp_path}/measured", "--out", f"{tmp_path}/fit"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/fit").collect()] == [(50.0, 0.0)]


def test_helpers(spark, tmp_path):
    said = []
    with util.timed("took {} s", said.append):
        pass
    assert said[0].startswith("took 0.")
    with pytest.raises(argparse.ArgumentTypeError):
        util.readable_path()(f"{tmp_path}/nothing")
    assert util.readable_path()(str(tmp_path)) == str(tmp_path)
    (tmp_path / "articles.json").write_text('{"key": "a", "title": "T", "author": "A", "year": 2001}\n{"key": "b", "title": "U", "author": "B", "year": 2002}')
    own = util.Citations.load(spark, f"{tmp_path}/articles.json")
    assert own.cite("b")(lambda x: x + 1)(1) == 2 and own.text() == "B (2002): U"
    with pytest.raises(ImproperlyConfigured):
        own.add("c")
    with pytest.raises(DataInvalid):
        util.Citations({"x": {"title": "T"}})


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 120 and entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_without_the_training_data_subpackage(tmp_path, pipeline_too):
    """In a copy of the tree with the folders really deleted, with and without the pipeline's module."""
    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    gone = [tmp_path / "copy/ensemblake/llm", tmp_path / "copy/tests/llm"]
    for folder in gone:
        shutil.rmtree(folder, ignore_errors=True)
    if pipeline_too:
        (tmp_path / "copy/corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tprob_transpose' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True)
