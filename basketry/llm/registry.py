"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.decontaminate import op1_decontamination
from basketry.llm.language import op3_language_id
from basketry.llm.lexical import OP13_SQL, op13_lexical_search
from basketry.llm.license_scan import OP8_SQL, op8_license_scan
from basketry.llm.near_dedup import op2_near_dedup
from basketry.llm.packing import op6_packing
from basketry.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from basketry.llm.quality import op10_quality
from basketry.llm.repeat_dedup import op9_substring_dedup
from basketry.llm.secret_scan import OP12_SQL, op12_secret_scan
from basketry.llm.suffix_dedup import op5_suffix_dedup
from basketry.llm.topk import OP7_SQL, op7_topk_products
from basketry.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_topk_products": op7_topk_products,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_secret_scan": op12_secret_scan,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op7_topk_products": OP7_SQL,
    "op8_license_scan": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
