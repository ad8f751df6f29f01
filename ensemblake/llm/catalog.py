"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_sharding import op1_minimax_shards
from .op2_urls import ORACLE as OP2_SQL
from .op2_urls import op2_url_filter
from .op3_language import op3_language_id
from .op4_quality import ORACLE as OP4_SQL
from .op4_quality import op4_adaptive_quality
from .op5_decontamination import op5_decontamination
from .op6_secrets import op6_secret_scan
from .op7_near_duplicates import op7_near_duplicates
from .op8_token_files import op8_token_files
from .op9_counts import op9_token_counts
from .op10_packing import op10_best_fit_packing
from .op11_spelling_variants import op11_spelling_variants
from .op12_top_k import ORACLE as OP12_SQL
from .op12_top_k import op12_top_k_search
from .op13_fill_in_middle import ORACLE as OP13_SQL
from .op13_fill_in_middle import op13_fill_in_middle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minimax_shards, op2_url_filter, op3_language_id, op4_adaptive_quality, op5_decontamination, op6_secret_scan, op7_near_duplicates, op8_token_files, op9_token_counts, op10_best_fit_packing, op11_spelling_variants, op12_top_k_search, op13_fill_in_middle)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_adaptive_quality": OP4_SQL, "op12_top_k_search": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
