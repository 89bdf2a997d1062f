"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quern.llm import bm25, bpe, collocations, html_text, mixing, periodic, permutation_index, quality, sharding, simhash, toxicity, training_order, url_filter

MODULES = (bm25, bpe, collocations, html_text, mixing, periodic, permutation_index, quality, sharding, simhash, toxicity, training_order, url_filter)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
