"""The queries of this subpackage and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, line_dedup, merkle
from .alignment import op13_tokenizer_alignment
from .ann import op10_curve_neighbours
from .chat import op11_chat_formatting
from .decontamination import op4_benchmark_decontamination
from .line_dedup import op1_line_dedup
from .lm_scoring import op9_lm_scoring
from .merkle import op12_merkle_manifest
from .near_dup import op3_minhash_near_dedup
from .packing import op8_best_fit_packing
from .secrets import op5_secret_scans
from .suffix_dedup import op7_suffix_array_dedup
from .quality import op6_quality_classifier
from .token_output import op2_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_output": op2_token_output,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_curve_neighbours": op10_curve_neighbours,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op4_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op11_chat_formatting": chat.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
