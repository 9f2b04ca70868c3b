"""The queries of this subpackage, by name, and their SQL where SQL can express them (ORACLES)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphspan.llm import (
    archives,
    cover_tree,
    cross_polytope,
    decontaminate,
    language_id,
    lm_scoring,
    packing,
    periodic_runs,
    simhash,
    substring_dedup,
    token_counts,
    training_order,
    whitening,
)
from graphspan.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_simhash": simhash.op2,
    "op3_packing": packing.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_training_order": training_order.op5,
    "op6_language_id": language_id.op6,
    "op7_archives": archives.op7,
    "op8_token_counts": token_counts.op8,
    "op9_cover_tree": cover_tree.op9,
    "op10_lm_scoring": lm_scoring.op10,
    "op11_whitening": whitening.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_cross_polytope": cross_polytope.op13,
}
