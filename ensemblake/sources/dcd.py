"""DCD trajectories as a Spark data source: files are split at byte ranges, and a task reads the frames that start in its own.

A file is a header and frames of equal size, so where a frame is follows by arithmetic: planning lists files and sizes and opens none. Stride, atoms and bounds on
frames are applied where bytes are read; what they leave out isn't. Lengths are in angstrom there and in nm here.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..exceptions import DataInvalid, ImproperlyConfigured
from ..plans.shared import sized, workers_can_import

SCHEMA = "traj_id long, frame long, x array<double>, cell array<double>"
#: Fixed values of the format: a header record of 84 bytes, and which of its 20 numbers is what.
HEAD, N_FRAMES, INTERVAL, N_FIXED, HAS_CELL, HAS_FOURTH, VERSION = 84, 0, 2, 8, 10, 11, 19
#: Lengths of an edge and cosines or degrees of an angle, in the file's order.
CELL = ("a", "gamma", "b", "beta", "alpha", "c")
PER_NM = 10.0
#: Bytes of a file for a task, of frames in a batch, and of unwanted atoms that are read rather than skipped.
SPLIT, TOGETHER, GAP = 64 << 20, 8 << 20, 4096


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A store and a path in it; without a scheme, one that all machines see as a folder."""
    scheme, rest = path.split(":", 1) if ":" in path.split("/")[0] else ("file", path)
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/") if path != rest else rest) if scheme == "file" else fs.FileSystem.from_uri(path)


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of files, of the .dcd files of folders, and of those whose names match a pattern, in order of paths."""
    found = {}
    for path in paths:
        store, where = place(path)
        prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
        pattern = posixpath.basename(where) if any(c in where for c in "*?[") else None
        info = store.get_file_info(posixpath.dirname(where) if pattern else where)
        if info.type == fs.FileType.NotFound:
            raise ImproperlyConfigured(f"there is no {path}")
        own = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(info.path))
        for x in own:
            if x.type == fs.FileType.File and (info.type == fs.FileType.File or fnmatch.fnmatch(x.base_name, pattern or "*.dcd")):
                found[prefix + x.path] = x.size
    return sorted(found.items())


@dataclass(frozen=True)
class Layout:
    """What a header says: byte order, atoms, those that move (None: all), where the first frame starts, blocks of a frame."""

    order: str
    n_atoms: int
    free: np.ndarray | None
    start: int
    cell: bool
    fourth: bool

    def block(self, atoms: int) -> int:
        return (56 if self.cell else 0) + (3 + self.fourth) * (8 + 4 * atoms)

    def moving(self, frame: int) -> int:
        """Atoms that a frame has: only the first one has those that are fixed."""
        return self.n_atoms if frame == 0 or self.free is None else len(self.free)

    def at(self, frame: int) -> int:
        return self.start + (0 if frame == 0 else self.block(self.n_atoms) + (frame - 1) * self.block(self.moving(1)))

    def first_from(self, byte: int) -> int:
        """The first frame that starts at this byte or later."""
        if byte <= self.start:
            return 0
        rest = byte - self.at(1)
        return 1 + max(0, -(-rest // self.block(self.moving(1))))

    def frames(self, size: int) -> int:
        """Whole frames of a file of so many bytes; one that a stopped program left unfinished doesn't count."""
        full = self.block(self.n_atoms)
        return 0 if size < self.start + full else 1 + (size - self.start - full) // self.block(self.moving(1))


def header(file, path: str = "") -> Layout:
    file.seek(0)
    head = file.read(HEAD + 8)
    order = next((o for o in "<>" if len(head) == HEAD + 8 and np.frombuffer(head[:4], o + "i4")[0] == HEAD), None)
    if order is None or head[4:8] != b"CORD":
        raise DataInvalid(f"{path} is no DCD file")
    number = np.frombuffer(head[8 : 4 + HEAD], order + "i4")
    charmm = number[VERSION] != 0

    def record() -> bytes:
        (n,) = np.frombuffer(file.read(4), order + "i4")
        return (file.read(int(n)), file.read(4))[0]

    record()  # titles
    (n_atoms,) = np.frombuffer(record(), order + "i4")
    free = np.frombuffer(record(), order + "i4").astype(np.int64) - 1 if number[N_FIXED] else None
    return Layout(order, int(n_atoms), free, file.tell(), bool(charmm and number[HAS_CELL]), bool(charmm and number[HAS_FOURTH]))


def spans(atoms: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, z) that hold the sorted atoms, joined over gaps that aren't worth a seek."""
    cuts = np.flatnonzero(np.diff(atoms) > 1 + GAP // 4) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(atoms, cuts)]


def frame_of(file, own: Layout, frame: int, atoms: np.ndarray | None, fixed: np.ndarray | None, path: str = "") -> tuple[np.ndarray, np.ndarray | None]:
    """(coordinates as in the file, n x 3, of the atoms; cell). fixed: those of the first frame, where some atoms don't move."""
    n, at = own.moving(frame), own.at(frame)
    cell = None
    if own.cell:
        file.seek(at + 4)
        cell = np.frombuffer(file.read(48), own.order + "f8")
        at += 56
    part = np.full((own.n_atoms, 3), np.nan) if fixed is None else fixed.copy()
    rows = np.arange(n) if n == own.n_atoms else own.free
    wanted = rows if atoms is None else np.flatnonzero(np.isin(rows, atoms))
    if atoms is None:
        file.seek(at)
        raw = file.read(3 * (8 + 4 * n))
        words = np.frombuffer(raw, own.order + "f4").reshape(3, n + 2)
        marks = np.frombuffer(raw, own.order + "i4").reshape(3, n + 2)[:, [0, -1]]
        if (marks != 4 * n).any():
            raise DataInvalid(f"{path}: frame {frame} isn't where its header says")
        part[rows] = words[:, 1:-1].T
        return part, cell
    for k in range(3):
        for a, z in spans(wanted) if len(wanted) else []:
            file.seek(at + k * (8 + 4 * n) + 4 + 4 * a)
            part[rows[a:z], k] = np.frombuffer(file.read(4 * (z - a)), own.order + "f4")
    return part[atoms], cell


def in_nm(cell: np.ndarray | None) -> list[float] | None:
    """Lengths a, b, c in nm and angles alpha, beta, gamma in degrees; some programs write cosines."""
    if cell is None:
        return None
    own = dict(zip(CELL, cell.tolist(), strict=True))
    angles = [own[c] for c in ("alpha", "beta", "gamma")]
    if all(-1 <= v <= 1 for v in angles):
        angles = np.degrees(np.arccos(angles)).tolist()
    return [*(own[c] / PER_NM for c in "abc"), *angles]


@dataclass
class Part(InputPartition):
    """Bytes [start, end) of a file."""

    traj_id: int
    path: str
    size: int
    start: int
    end: int


class DcdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.stride, self.split = int(options.get("stride", 1)), int(options.get("split", SPLIT))
        self.atoms = np.array(json.loads(options["atoms"]), np.int64) if options.get("atoms") else None
        if self.stride < 1 or (self.atoms is not None and (len(self.atoms) == 0 or (np.diff(self.atoms) <= 0).any() or self.atoms[0] < 0)):
            raise ImproperlyConfigured("a stride is positive, and atoms are ascending numbers from 0")
        self.least, self.most, self.ids = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on frames and single trajectories are kept here; Spark applies the rest."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("frame",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
            if column == ("frame",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                end = value + (not isinstance(f, LessThan))
                self.most = end if self.most is None else min(self.most, end)
            elif column == ("traj_id",) and isinstance(f, EqualTo):
                self.ids = {value} if self.ids is None else self.ids & {value}
            elif not (column == ("frame",) and isinstance(f, GreaterThan | GreaterThanOrEqual)):
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for k, (path, size) in enumerate(listed(self.paths)):
            if self.ids is None or k in self.ids:
                out += [Part(k, path, size, a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out or [Part(-1, "", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, where = place(part.path)
        with store.open_input_file(where) as file:
            yield from self.frames(file, part)

    def frames(self, file, part: Part) -> Iterator[pa.RecordBatch]:
        """Batches of frames that start in the part's bytes; file is anything that seeks and reads."""
        own = header(file, part.path)
        if self.atoms is not None and self.atoms[-1] >= own.n_atoms:
            raise ImproperlyConfigured(f"{part.path} has {own.n_atoms} atoms, atom {self.atoms[-1]} isn't among them")
        first = max(own.first_from(part.start), self.least)
        first += -first % self.stride
        end = min(own.first_from(part.end), own.frames(part.size), *([] if self.most is None else [self.most]))
        fixed = frame_of(file, own, 0, None, None, part.path)[0] if own.free is not None and first < end else None
        n = own.n_atoms if self.atoms is None else len(self.atoms)
        many = max(1, TOGETHER // (24 * n or 1))
        for k in range(first, end, self.stride * many):
            numbers = list(range(k, min(end, k + self.stride * many), self.stride))
            found = [frame_of(file, own, j, self.atoms, fixed, part.path) for j in numbers]
            flat = np.concatenate([x.ravel() for x, _ in found]) / PER_NM
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * 3 * n, pa.int32()), pa.array(flat))
            cells = pa.array([in_nm(c) for _, c in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([part.traj_id] * len(found), pa.int64()), pa.array(numbers, pa.int64()), lists, cells], names=["traj_id", "frame", "x", "cell"])


def head_of(n_frames: int, n_atoms: int, cell: bool) -> bytes:
    """A header as CHARMM writes it: little-endian, one title, all atoms free."""
    number = np.zeros(20, "<i4")
    number[[N_FRAMES, INTERVAL, HAS_CELL, VERSION]] = n_frames, 1, cell, 24
    title = np.array([1], "<i4").tobytes() + b"trajectory".ljust(80)
    records = (b"CORD" + number.tobytes(), title, np.array([n_atoms], "<i4").tobytes())
    return b"".join(framed(r) for r in records)


def framed(record: bytes) -> bytes:
    mark = np.array([len(record)], "<i4").tobytes()
    return mark + record + mark


def bytes_of(x: np.ndarray, cell: list[float] | None) -> bytes:
    """A frame: n x 3 coordinates in nm, and its cell."""
    own = (x * PER_NM).astype("<f4")
    head = b"" if cell is None else framed(np.array([dict(zip(("a", "b", "c", "alpha", "beta", "gamma"), [*(v * PER_NM for v in cell[:3]), *cell[3:]], strict=True))[c] for c in CELL], "<f8").tobytes())
    return head + b"".join(framed(own[:, k].tobytes()) for k in range(3))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class DcdWriter(DataSourceArrowWriter):
    """A file a trajectory, from rows (traj_id, frame, n, x[, cell]) in order. Files get their names when all tasks are through, so a repeated task leaves no second one."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, where = place(self.path)
        store.create_dir(where)
        now, file, files, shape = None, None, [], None
        for batch in batches:
            cells = batch.column("cell").to_pylist() if "cell" in batch.schema.names else [None] * batch.num_rows
            for traj, n, x, cell in zip(batch.column("traj_id").to_pylist(), batch.column("n").to_pylist(), batch.column("x"), cells, strict=True):
                own = x.values.to_numpy(zero_copy_only=False).reshape(-1, 3) if x.is_valid and len(x.values) % 3 == 0 else None
                if own is None or (traj == now and (len(own), cell is None) != shape):
                    raise DataInvalid(f"trajectory {traj}: every frame needs as many atoms, and all or none a cell")
                if traj != now:
                    if file:
                        file.close()
                    now, shape = traj, (len(own), cell is None)
                    final = f"{where}/{traj:09d}.dcd"
                    files.append((f"{where}/.{traj:09d}-{uuid.uuid4().hex}", final))
                    file = store.open_output_stream(files[-1][0])
                    file.write(head_of(n, len(own), cell is not None))
                file.write(bytes_of(own, cell))
        if file:
            file.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, _ = place(self.path)
        for m in messages:
            for now, final in m.files:
                store.move(now, final)

    def abort(self, messages: list) -> None:
        store, _ = place(self.path)
        for m in messages:
            for now, _ in m.files if m else []:
                store.delete_file(now)


class DcdSource(DataSource):
    """Options of a read: path or paths (JSON), stride, atoms (JSON, ascending), split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DcdReader:
        return DcdReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DcdWriter:
        return DcdWriter(dict(self.options))


def load_dcd(spark: SparkSession, paths: list[str] | str, stride: int = 1, atoms: list[int] | None = None, split: int = SPLIT) -> DataFrame:
    """traj_id, frame, x (flat coordinates in nm, in order of atoms), cell (lengths in nm and degrees, or null) of DCD files, numbered in order of paths.

    paths: files, folders or patterns of names. Every stride-th frame is read, under its own number. atoms: numbers from 0, of which only those are read.
    where() on frame and traj_id reaches the reader. Files of either byte order, with cells and with fixed atoms, are read.
    """
    workers_can_import(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DcdSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = spark.read.format("dcd").option("paths", json.dumps(paths)).option("stride", stride).option("split", split)
    return (read if atoms is None else read.option("atoms", json.dumps(sorted({int(a) for a in atoms})))).load()


def write_dcd(frames: DataFrame, path: str) -> None:
    """A DCD file for each traj_id of frames (traj_id, frame, x in nm[, cell]) in a folder that has none yet, frames in order; files sort as ids from 0 do.

    A trajectory is streamed through one task, since a file has one writer. Frames of one trajectory that differ in size are an error.
    """
    spark = frames.sparkSession
    workers_can_import(spark)
    store, where = place(path)
    if store.get_file_info(where).type == fs.FileType.Directory and listed([path]):
        raise ImproperlyConfigured(f"{path} has trajectories already")
    spark.dataSource.register(DcdSource)
    n = frames.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))
    own = frames.select("traj_id", "frame", F.col("x").cast("array<double>").alias("x"), *([F.col("cell").cast("array<double>").alias("cell")] if "cell" in frames.columns else []))
    rows = own.join(sized(n), "traj_id").repartition("traj_id").sortWithinPartitions("traj_id", "frame")
    rows.write.format("dcd").mode("append").save(path)
