"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tapeworks.llm import decontaminate, fingerprints, mixing, ngram_join, ngram_lm, repeats, shards, token_store, toxicity, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_repeats": repeats.op2_repeats,
        "op3_token_store": token_store.op3_token_store,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_main_text": wrappers.op8_main_text,
        "op9_shards": shards.op9_shards,
        "op10_ngram_lm": ngram_lm.op10_ngram_lm,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL}
