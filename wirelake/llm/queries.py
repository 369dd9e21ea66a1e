"""The registered queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import OP10_SQL
from .lines import OP9_SQL
from .quality_rules import OP2_SQL
from .repair import OP12_SQL
from .substring import OP6_SQL
from .trie import OP11_SQL


def _over(module: str, function: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies an operator to whole tables."""
    apply = getattr(importlib.import_module(f"{__package__}.{module}"), function)
    return lambda spark, sf_dir: apply(*(table(spark, sf_dir, t) for t in tables))


def _over_documents(module: str, function: str, *others: str) -> Callable[[SparkSession, str], DataFrame]:
    return _over(module, function, "documents", *others)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": _over_documents("mixing", "op1"),
    "op2_quality_rules": _over_documents("quality_rules", "op2"),
    "op3_token_output": _over_documents("tokens", "op3"),
    "op4_language_id": _over_documents("language", "op4"),
    "op5_quality_crf": _over_documents("quality_crf", "op5", "labels"),
    "op6_substring_dedup": _over_documents("substring", "op6"),
    "op7_secret_scan": _over_documents("secrets", "op7"),
    "op8_simhash_near_dedup": _over_documents("simhash", "op8"),
    "op9_line_dedup": _over_documents("lines", "op9"),
    "op10_decontaminate": _over_documents("decontaminate", "op10", "benchmark"),
    "op11_prefix_trie": _over("trie", "op11", "conversations"),
    "op12_conversation_repair": _over("repair", "op12", "conversations"),
    "op13_sentencepiece": _over_documents("pieces", "op13"),
}

SQL: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
