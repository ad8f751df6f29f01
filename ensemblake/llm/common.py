"""Shared plumbing: the shared folder, written intermediate tables, worker imports."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import shared_dir, sized

T = TypeVar("T")
__all__ = ["only", "prepare", "shared_dir", "sized", "table", "tokenizer_path", "written"]


def prepare(spark: SparkSession) -> None:
    """For operators that run Python: workers find the package, give freed memory back, and get whole texts in small batches.

    On a cluster the package is shipped with --py-files; a missing folder in the path is harmless. A batch size that the
    session has set itself stays.
    """
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if top not in (had := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, had) if x)
    for name, value in {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000", "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1"}.items():
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


_slot: dict = {}


def only(key: tuple, make: Callable[[], T]) -> T:
    """A worker process's one large object, kept from task to task: a model or vocabulary gives way to the next operator's."""
    if key not in _slot:
        _slot.clear()
        gc.collect()
        _slot[key] = make()
    return _slot[key]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back, which cuts its lineage.

    A lost executor then costs only its running tasks. The files go when the session's JVM ends. Codec snappy is for large binary cells,
    which aren't gathered in a dictionary.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.enable.dictionary", str(codec != "snappy").lower()).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
