"""Every registered query of the engine with its SQL twin, where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_info, q_large, q_model, q_more, q_ragged, q_space


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {k: v for module in (q_ragged, q_model, q_info, q_space, q_more, q_large) for k, v in module.Q.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
