"""Small helpers of jobs: paths as arguments, timing, and the methods that a program used."""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .exceptions import DataInvalid, ImproperlyConfigured


def readable_path(exists: bool = True) -> Callable[[str], str]:
    """An argparse type: a local folder that can be read, if it must exist; a path with a scheme is left to Spark."""

    def check(path: str) -> str:
        if "://" not in path and exists and not (os.path.isdir(path) and os.access(path, os.R_OK)):
            raise argparse.ArgumentTypeError(f"{path} isn't a folder that can be read")
        if not path:
            raise argparse.ArgumentTypeError("an empty path")
        return path

    return check


@contextmanager
def timed(text: str, log: Callable[[str], object] = print) -> Iterator[None]:
    """Logs a text with the seconds that its block took in place of {}, also where the block fails."""
    start = time.perf_counter()
    try:
        yield
    finally:
        log(text.format(f"{time.perf_counter() - start:.2f}"))


class Citations:
    """Articles by key, and which of them a program has used."""

    NEEDED = ("title", "author", "year")

    def __init__(self, articles: dict[str, dict]):
        for key, own in articles.items():
            if missing := [n for n in self.NEEDED if not own.get(n)]:
                raise DataInvalid(f"article {key} has no {', '.join(missing)}")
        self.articles, self.used = articles, []

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Citations:
        """From JSON lines with a key and the needed fields; a list of articles is a small file."""
        rows = spark.read.json(path).withColumn("key", F.col("key").cast("string")).collect()
        return cls({r.key: {k: v for k, v in r.asDict().items() if k != "key"} for r in rows})

    def add(self, key: str) -> None:
        if key not in self.articles:
            raise ImproperlyConfigured(f"unknown article {key!r}")
        if key not in self.used:
            self.used.append(key)

    def cite(self, key: str) -> Callable[[Callable], Callable]:
        """A decorator: a call of the function counts as use of the article."""
        if key not in self.articles:
            raise ImproperlyConfigured(f"unknown article {key!r}")

        def put(f: Callable) -> Callable:
            @wraps(f)
            def run(*args, **kwargs):
                self.add(key)
                return f(*args, **kwargs)

            return run

        return put

    def text(self) -> str:
        """What a program should cite, in the order of first use; empty where nothing was used."""
        return "\n".join(f"{a['author']} ({a['year']}): {a['title']}" for a in map(self.articles.__getitem__, self.used))
