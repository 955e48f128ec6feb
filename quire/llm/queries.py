"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage that defines it.
MODULES = {
    "op1_quality_model": "quality_model",
    "op2_byte_bpe": "byte_bpe",
    "op3_quality_rules": "quality_rules",
    "op4_pii": "pii",
    "op5_interleave": "sharding",
    "op6_pivot_search": "pivot_search",
    "op7_packing": "packing",
    "op8_warc": "warc",
    "op9_simhash": "simhash",
    "op10_preferences": "chat_format",
    "op11_merkle": "merkle",
    "op12_filter_audit": "filter_audit",
    "op13_suffix_dedup": "suffix_dedup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"quire.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from quire.llm.oracles import SQL

    return dict(SQL)
