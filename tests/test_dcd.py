"""DCD files: written and read by Spark, read in ranges, and read as other programs write them."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblake.exceptions import DataInvalid, ImproperlyConfigured
from ensemblake.sources import dcd, tables


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


def frames(spark, sizes, n_atoms, cell=False):
    rng = np.random.default_rng(1)
    rows = []
    for t, size in enumerate(sizes):
        for k in range(size):
            rows.append((t, k, rng.normal(size=3 * n_atoms).round(3).tolist(), [2.0, 3.0, 4.5, 90.0, 80.0, 70.0] if cell else None))
    return rows, spark.createDataFrame(rows, dcd.SCHEMA)


def test_round_trip_in_many_tasks(spark, tmp_path):
    for cell in (False, True):
        rows, df = frames(spark, [7, 1, 40], 5, cell)
        path = str(tmp_path / f"c{cell}")
        dcd.write_dcd(df if cell else df.drop("cell"), path)
        for split in (50, 300, 1 << 20):
            got = dcd.load_dcd(spark, path, split=split)
            assert split > 50 or got.rdd.getNumPartitions() > 40
            own = sorted((r.traj_id, r.frame, r.x, r.cell) for r in got.collect())
            assert [x[:2] for x in own] == [x[:2] for x in rows]
            assert np.allclose([x[2] for x in own], [x[2] for x in rows], atol=1e-6)
            assert all(x[3] is None if not cell else np.allclose(x[3], [2.0, 3.0, 4.5, 90.0, 80.0, 70.0]) for x in own)
        some = dcd.load_dcd(spark, path, stride=3, atoms=[4, 1], split=300)
        assert {(r.traj_id, r.frame): np.allclose(r.x, np.reshape(dict(((a, b), x) for a, b, x, _ in rows)[r.traj_id, r.frame], (5, 3))[[1, 4]].ravel(), atol=1e-6) for r in some.collect()} == {(t, k): True for t, k, *_ in rows if k % 3 == 0}
    with pytest.raises(ImproperlyConfigured):
        dcd.write_dcd(df, path)


def test_filters_reach_the_reader(spark, tmp_path):
    _, df = frames(spark, [30, 30], 4)
    dcd.write_dcd(df.drop("cell"), str(tmp_path / "d"))
    got = dcd.load_dcd(spark, f"{tmp_path}/d/*.dcd").where("frame >= 10 AND frame < 14 AND traj_id = 1 AND x[0] > -1000")
    assert sorted((r.traj_id, r.frame) for r in got.collect()) == [(1, k) for k in range(10, 14)]
    reader = dcd.DcdReader({"path": str(tmp_path / "d")})
    left = list(reader.pushFilters([dcd.GreaterThan(("frame",), 3), dcd.LessThanOrEqual(("frame",), 9), dcd.EqualTo(("traj_id",), 1), dcd.EqualTo(("x",), 0), dcd.EqualTo(("frame",), 5)]))
    assert left == [dcd.EqualTo(("x",), 0)] and (reader.least, reader.most, reader.ids) == (5, 6, {1})
    assert [p.traj_id for p in reader.partitions()] == [1]


def test_stride_and_atoms_read_fewer_bytes():
    rng = np.random.default_rng(2)
    xyz = rng.normal(size=(60, 20_000, 3))
    raw = dcd.head_of(60, 20_000, False) + b"".join(dcd.bytes_of(x, None) for x in xyz)
    part = dcd.Part(0, "a.dcd", len(raw), 0, len(raw))

    def read(**options):
        file = Counted(raw)
        return file, [np.array(x.as_py()) for b in dcd.DcdReader({"path": "a", **options}).frames(file, part) for x in b.column("x")]

    whole, all_frames = read()
    assert len(all_frames) == 60 and np.allclose(all_frames[7].reshape(-1, 3), xyz[7], atol=1e-5)
    strided, some = read(stride="10")
    assert len(some) == 6 and strided.total < whole.total / 9
    few, atoms = read(atoms="[3, 4, 19999]")
    assert np.allclose(atoms[5].reshape(-1, 3), xyz[5][[3, 4, 19999]], atol=1e-5) and few.total < whole.total / 1000
    halves = [dcd.Part(0, "a.dcd", len(raw), a, z) for a, z in ((0, len(raw) // 3), (len(raw) // 3, len(raw)))]
    assert sum(len(b) for p in halves for b in dcd.DcdReader({"path": "a"}).frames(io.BytesIO(raw), p)) == 60


def other_program(order, xyz, cell=None, fixed=()):
    """A file as X-PLOR or a machine of the other byte order writes it: no cell flag without cells, fixed atoms in the first frame alone."""
    n = xyz.shape[1]
    free = [k for k in range(n) if k not in fixed]
    number = np.zeros(20, order + "i4")
    number[[0, 8]] = 0, len(fixed)
    if cell is not None:
        number[[10, 19]] = 1, 24

    def record(data):
        mark = np.array([len(data)], order + "i4").tobytes()
        return mark + data + mark

    out = record(b"CORD" + number.tobytes()) + record(np.array([2], order + "i4").tobytes() + b" " * 160) + record(np.array([n], order + "i4").tobytes())
    if fixed:
        out += record(np.array([k + 1 for k in free], order + "i4").tobytes())
    for k, x in enumerate(xyz):
        if cell is not None:
            out += record(np.array(cell, order + "f8").tobytes())
        own = x if k == 0 else x[free]
        out += b"".join(record(own[:, c].astype(order + "f4").tobytes()) for c in range(3))
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("fixed", [(), (0, 3)])
def test_files_of_other_programs(order, fixed):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(9, 6, 3)) * 10
    xyz[:, list(fixed)] = xyz[0, list(fixed)]
    for cell in (None, [20.0, 0.0, 30.0, 0.0, 0.5, 40.0]):
        raw = other_program(order, xyz, cell, fixed) + b"\x00" * 11  # and a frame that was begun
        for atoms in (None, [0, 2, 3, 5]):
            reader = dcd.DcdReader({"path": "a"} | ({"atoms": str(atoms)} if atoms else {}))
            for cut in (len(raw), 400):
                parts = [dcd.Part(0, "a", len(raw), a, min(len(raw), a + cut)) for a in range(0, len(raw), cut)]
                got = [r for p in parts for b in reader.frames(io.BytesIO(raw), p) for r in b.to_pylist()]
                assert [r["frame"] for r in got] == list(range(9))
                want = xyz if atoms is None else xyz[:, atoms]
                assert np.allclose([np.reshape(r["x"], (-1, 3)) for r in got], want / 10, atol=1e-5)
                assert all(r["cell"] is None if cell is None else np.allclose(r["cell"], [2, 3, 4, 60, 90, 90]) for r in got)


def test_what_is_no_trajectory(spark, tmp_path):
    with pytest.raises(DataInvalid):
        dcd.header(io.BytesIO(b"not a trajectory" * 20))
    with pytest.raises(ImproperlyConfigured):
        dcd.DcdReader({"path": "a", "atoms": "[2, 1]"})
    with pytest.raises(ImproperlyConfigured):
        dcd.listed([str(tmp_path / "none.dcd")])
    uneven = spark.createDataFrame([(0, 0, [1.0] * 6), (0, 1, [1.0] * 3)], "traj_id long, frame long, x array<double>")
    with pytest.raises(Exception, match="as many atoms"):
        dcd.write_dcd(uneven, str(tmp_path / "u"))
    assert dcd.listed([str(tmp_path / "u")]) == []


def test_as_structures(spark, tmp_path):
    """load_trajectories takes DCD files with the atoms of a PDB file, and PDB files beside them."""
    atoms = [(k, ("N", "CA", "C")[k % 3], k // 3) for k in range(9)]
    top = spark.createDataFrame([(0, 0, k, name, "ALA", "A", res, 0.1 * k, 0.2, 0.3, name[0], 0.15, "s") for k, name, res in atoms], "structure int, frame int, atom_id long, name string, res_name string, chain string, res_seq int, x double, y double, z double, element string, radius double, u string")
    tables.write_pdb(top, str(tmp_path / "pdb"))
    rows, df = frames(spark, [4, 2], 9)
    dcd.write_dcd(df.drop("cell"), str(tmp_path / "d"))
    pdb = f"{tmp_path}/pdb/structure=0"
    got = tables.load_trajectories(spark, [pdb, f"{tmp_path}/d"], ["name CA", "name CA"], [None, pdb])
    own = {(r.traj_id, r.frame): r.x for r in got.collect()}
    assert set(own) == {(0, 0), *((t + 1, k) for t, k, *_ in rows)}
    assert np.allclose(own[2, 1], np.reshape(dict(((t, k), x) for t, k, x, _ in rows)[1, 1], (9, 3))[[1, 4, 7]].ravel(), atol=1e-6)
    assert np.allclose(own[0, 0], np.array([[0.1 * k, 0.2, 0.3] for k in (1, 4, 7)]).ravel(), atol=1e-3)
    with pytest.raises(ImproperlyConfigured):
        tables.load_trajectories(spark, [f"{tmp_path}/d/*.dcd"], ["name CA"])
    assert dcd.load_dcd(spark, f"{tmp_path}/d").agg(F.count("*")).first()[0] == 6
