"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from quern.plans import content, files, flows, kept, lists, usage

MODULES = (usage, lists, content, flows, files, kept)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
