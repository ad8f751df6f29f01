"""Intermediate tables in the session's shared folder, which cut the lineage of iterations."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..exceptions import ImproperlyConfigured


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of this machine only where none is configured and Spark runs on this machine alone (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None and not sc.master.startswith("local"):
            raise ImproperlyConfigured("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="ensemblake-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """df as a table in the shared folder, in sorted buckets by its keys: tables of equal keys join without a shuffle or a sort."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name alone: the files of a table with a path stay
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return out


def sized(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """A join's small side: broadcast while its rows, a key or two each, are counted to be few; beyond that the join shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows


def workers_can_import(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package when it isn't installed."""
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if top not in (had := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, had) if x)
