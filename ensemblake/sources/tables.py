"""Reading and writing trajectories, features and assignments as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..exceptions import DataInvalid, ImproperlyConfigured
from ..functions.geometry import selection
from ..operators.pockets import radius_of
from ..operators.ragged import Ragged, partition_indices
from .dcd import listed, load_dcd

KEY = ["traj_id", "frame"]


#: Folders of a saved table: how many parts its trajectories are dealt to, and which this is.
PARTS, PART = "__parts", "__part"


def _part(traj_id: Column, parts: Column) -> Column:
    """A trajectory's part: as Spark deals rows to tasks, so each part is one task's file."""
    return F.pmod(F.hash(traj_id), parts)


def load(source: DataFrame | str, keys: list | None = None, stride: int = 1, spark: SparkSession | None = None) -> DataFrame:
    """A ragged table or its folder: rows by key (pruned parts, pushed filters) and every stride-th frame, under its own number."""
    if isinstance(source, DataFrame):
        df = source
    else:
        df = spark.read.parquet(source)
        if keys is not None and {PARTS, PART} <= set(df.columns):
            kind = df.schema["traj_id"].dataType
            df = df.where(F.col(PART).isin([_part(F.lit(k).cast(kind), F.col(PARTS)) for k in keys]))
        df = df.drop(PARTS, PART)
        if dict(df.dtypes).get("traj_id") == "int":  # of folders' names, as other tables have them, Spark makes the smallest type
            df = df.withColumn("traj_id", F.col("traj_id").cast("long"))
    df = df if keys is None else df.where(F.col("traj_id").isin(list(keys)))
    return df if stride == 1 else df.where(F.col("frame") % stride == 0)


def save(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder with a part for each hash of trajectories, in their order, so that readers of some skip most others.

    There are as many parts as the session has shuffle partitions: files don't grow with the trajectories.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(PARTS, F.lit(parts)).withColumn(PART, _part(F.col("traj_id"), F.lit(parts))).repartition(parts, "traj_id")
    dealt.sortWithinPartitions(PARTS, PART, "traj_id", "frame").write.mode(mode).option("compression", "zstd").partitionBy(PARTS, PART).parquet(path)


def save_flat(ragged: Ragged, path: str) -> None:
    """All rows put end to end (flat, value) and each row's length: two folders, the layout of arrays that are kept with their lengths."""
    ragged.flatten().write.parquet(f"{path}/array")
    ragged.starts().select("traj_id", "n", "start").write.parquet(f"{path}/lengths")


def load_flat(spark: SparkSession, path: str) -> Ragged:
    return Ragged(partition_indices(spark.read.parquet(f"{path}/array"), spark.read.parquet(f"{path}/lengths")).select("traj_id", "frame", "value"))


def sound(df: DataFrame, stride: int = 1) -> DataFrame:
    """traj_id, n: frames that a strided read would have, by keys alone."""
    return df.groupBy("traj_id").agg(F.ceil(F.count(F.lit(1)) / stride).cast("long").alias("n"))


def load_frames(frames: DataFrame, keys: DataFrame, stride: int = 1) -> DataFrame:
    """Frames by a list (traj_id, frame), which counts in strides."""
    wanted = keys.select("traj_id", F.col("frame").alias("__k"), (F.col("frame") * stride).alias("frame"))
    return frames.join(wanted, KEY).withColumn("frame", F.col("__k")).drop("__k")


def concatenate(tables: list[DataFrame], atoms: list[int] | None = None) -> DataFrame:
    """Coordinate tables one after another, trajectories numbered on; their columns must agree."""
    out, at = None, 0
    for df in tables:
        own = df if atoms is None else df.where(F.col("atom_id").isin(atoms))
        if out is not None and own.dtypes != out.dtypes:
            raise DataInvalid("tables of different columns can't be put together")
        ids = df.select("traj_id").distinct().count()
        out = own.withColumn("traj_id", F.col("traj_id") + at) if out is None else out.unionByName(own.withColumn("traj_id", F.col("traj_id") + at))
        at += ids
    return out


def load_npy(spark: SparkSession, paths: list[str] | str, stride: int = 1) -> DataFrame:
    """traj_id, frame, x of .npy arrays, one a trajectory, in order of their paths. Rows are read on the executors."""
    import io

    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").load(paths)
    names = sorted(r.path for r in files.select("path").collect())
    number = spark.createDataFrame([(p, k) for k, p in enumerate(names)], "path string, traj_id long")

    def read(batches):
        for batch in batches:
            for traj, content in zip(batch["traj_id"], batch["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)[::stride]
                for at in range(0, len(a), 5000):
                    part = a[at : at + 5000]
                    yield pd.DataFrame({"traj_id": traj, "frame": np.arange(at, at + len(part)), "x": [np.ravel(v).astype(float) for v in part]})

    return files.join(number, "path").select("traj_id", "content").mapInPandas(read, "traj_id long, frame long, x array<double>")


def load_features(spark: SparkSession, paths: list[str] | str, stride: int = 1) -> DataFrame:
    """From .npy files, or from a folder of a ragged table."""
    first = paths if isinstance(paths, str) else paths[0]
    if first.endswith(".npy"):
        return load_npy(spark, paths, stride)
    return load(first, None, stride, spark)


PDB_ATOMS = T.StructType([T.StructField(n, t) for n, t in (("traj_id", T.LongType()), ("frame", T.LongType()), ("atom_id", T.LongType()), ("name", T.StringType()), ("res_name", T.StringType()), ("chain", T.StringType()), ("res_seq", T.IntegerType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("z", T.DoubleType()), ("element", T.StringType()), ("radius", T.DoubleType()))])


def load_pdb(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Atoms of PDB files in nm: a trajectory per file, a frame per model in order of model numbers. The text is parsed by column positions, in the JVM.

    A model is a record, so large files are read by several tasks; a file without models is one. What stands before the first model of a file isn't one.
    """
    text = spark.read.option("lineSep", "\nMODEL ").text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("part"))
    number = F.regexp_extract("part", r"\A(?:MODEL )?\s*(\d+)\s*(?:\r?\n|\z)", 1)
    text = text.withColumn("serial", F.when(number != "", number.cast("long")))
    keys = text.select("path", "serial").distinct()
    names = sorted(r.path for r in keys.select("path").distinct().collect())
    files = spark.createDataFrame([(p, k) for k, p in enumerate(names)], "path string, traj_id long")
    frames = keys.withColumn("many", F.max("serial").over(Window.partitionBy("path")).isNotNull()).where("serial IS NOT NULL OR NOT many")
    frames = frames.withColumn("frame", (F.row_number().over(Window.partitionBy("path").orderBy("serial")) - 1).cast("long")).join(files, "path").select(F.col("path").alias("__path"), F.col("serial").alias("__serial"), "traj_id", "frame")
    models = text.join(frames, (F.col("path") == F.col("__path")) & F.col("serial").eqNullSafe(F.col("__serial"))).select("traj_id", "frame", "part")
    lines = F.filter(F.split("part", r"\r?\n"), lambda x: x.startswith("ATOM  ") | x.startswith("HETATM"))
    own = models.select("traj_id", "frame", F.posexplode(lines).alias("atom_id", "l"))
    field = lambda a, n: F.trim(F.substring("l", a, n))
    element = F.when(F.length(field(77, 2)) > 0, field(77, 2)).otherwise(F.substring(F.regexp_replace(field(13, 4), "[0-9]", ""), 1, 1))
    nm = lambda a: F.round(field(a, 8).cast("double") / 10, 5)
    out = own.select("traj_id", "frame", F.col("atom_id").cast("long").alias("atom_id"), field(13, 4).alias("name"), field(18, 3).alias("res_name"), field(22, 1).alias("chain"), field(23, 4).cast("int").alias("res_seq"), nm(31).alias("x"), nm(39).alias("y"), nm(47).alias("z"), element.alias("element"))
    return out.withColumn("radius", radius_of(F.col("element"))).select(*PDB_ATOMS.names)


def write_pdb(atoms: DataFrame, path: str) -> None:
    """PDB text, a file a structure: columns of load_pdb, with a column `structure` that names the file's folder, and b_factor if there is one."""
    b = F.col("b_factor") if "b_factor" in atoms.columns else F.lit(0.0)
    line = F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00%6.2f          %2s", (F.col("atom_id") + 1).cast("int"), F.concat(F.lit(" "), F.col("name")), "res_name", F.coalesce("chain", F.lit("A")), "res_seq", F.col("x") * 10, F.col("y") * 10, F.col("z") * 10, b, "element")
    ordered = atoms.groupBy("structure").agg(F.sort_array(F.collect_list(F.struct("atom_id", line.alias("l")))).alias("a"))
    text = ordered.select("structure", F.concat(F.array_join(F.transform("a", lambda r: r["l"]), "\n"), F.lit("\nEND")).alias("value"))
    text.write.mode("overwrite").partitionBy("structure").text(path)


def structures(coords: DataFrame) -> DataFrame:
    """traj_id, frame, x: each frame's coordinates (atom_id, x, y, z) in order of atoms as one flat vector, as rmsd takes them."""
    own = coords.groupBy("traj_id", "frame").agg(F.sort_array(F.collect_list(F.struct("atom_id", F.array(*(F.col(c).cast("double") for c in "xyz")).alias("p")))).alias("a"))
    return own.select("traj_id", "frame", F.flatten(F.transform("a", lambda r: r["p"])).alias("x"))


def load_trajectories(spark: SparkSession, groups: list[list[str] | str], selections: list[str], topologies: list[str | None] | None = None, stride: int = 1) -> DataFrame:
    """As structures, of groups of PDB or DCD files, each with a selection of its own; all must select equally many atoms. Trajectories are numbered on.

    DCD files hold coordinates alone: their group's topology is a PDB file with its atoms, and only the atoms that are selected are read.
    """
    topologies = topologies or [None] * len(groups)
    if not len(groups) == len(selections) == len(topologies):
        raise ImproperlyConfigured("needs a selection for each group of trajectories")
    found, at = None, 0
    for paths, text, top in zip(groups, selections, topologies, strict=True):
        paths = [paths] if isinstance(paths, str) else list(paths)
        if top is None and any(p.endswith(".dcd") for p in paths):
            raise ImproperlyConfigured(f"{paths[0]} needs a topology, a PDB file with its atoms")
        if top is None:
            atoms = load_pdb(spark, paths)
            own = structures(select_atoms(atoms, atoms, text)).where(F.col("frame") % stride == 0)
            many = atoms.agg(F.max("traj_id") + 1).first()[0]
        else:
            first = load_pdb(spark, top).where("traj_id = 0 AND frame = 0")
            wanted = [r.atom_id for r in select_atoms(first, first, text).select("atom_id").distinct().collect()]  # a structure's atoms, as many as one frame has
            own, many = load_dcd(spark, paths, stride, wanted).select("traj_id", "frame", "x"), len(listed(paths))
        own = own.withColumn("traj_id", F.col("traj_id") + at)
        at += many
        found = own if found is None else found.unionByName(own)
    sizes = [r.n for r in found.select((F.size("x") / 3).cast("int").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise DataInvalid(f"selections of {sizes[0]} and {sizes[1]} atoms can't be compared")
    return found


def select_atoms(coords: DataFrame, atoms: DataFrame, text: str) -> DataFrame:
    """Coordinates of the atoms that a selection names; a selection of none is an error."""
    own = atoms.where(selection(text)).select("atom_id").distinct()
    if own.isEmpty():
        raise ImproperlyConfigured(f"no atom is selected by {text!r}")
    return coords.join(own, "atom_id", "left_semi")


def load_assignments(source: DataFrame) -> DataFrame:
    """-1 as null."""
    return source.withColumn("state", F.when(F.col("state") != -1, F.col("state")))


def export_assignments(df: DataFrame) -> DataFrame:
    """null as -1."""
    return df.withColumn("state", F.coalesce("state", F.lit(-1)))


def load_spectra(spark: SparkSession, path: str, dye: str) -> DataFrame:
    """dye, wavelength, excitation, emission of a CSV with those headers, capitalised."""
    df = spark.read.csv(path, header=True, schema="Wavelength int, Excitation double, Emission double")
    return df.select(F.lit(dye).alias("dye"), *(F.col(c).alias(c.lower()) for c in df.columns))


def load_dyes(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV of dyes; missing fields are null."""
    return spark.read.csv(path, schema="type string, chromophore string, ext_coeff double, qd double, td double")


def load_dye_library(spark: SparkSession, path: str) -> DataFrame:
    """name, author, filename, r, mu, cb of a YAML library of dyes. A library is a file of some kB."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    rows = [(k, v.get("author"), v.get("filename"), [str(x) for x in v.get("r", [])], [str(x) for x in v.get("mu", [])], [str(x) for x in v.get("CB", [])]) for k, v in yaml.safe_load(text).items()]
    return spark.createDataFrame(rows, "name string, author string, filename string, r array<string>, mu array<string>, cb array<string>")
