"""Names of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logquarry.operators import logparse, nested
from logquarry.plans import catalog, coverage, entries_sql, lookups, nested_sql  # noqa: F401  coverage and lookups add their queries to the catalogue
from logquarry.session import load

Query = Callable[[SparkSession, str], DataFrame]


def _leaves(s: SparkSession, d: str) -> DataFrame:
    t = nested.shred(load(s, d, "api_responses"), ("answers", "members"))
    return nested.leaves(t["answers"], t["members"]).select("response_id", "path", "value")


def queries() -> dict[str, Query]:
    """Core queries by name."""
    return catalog.QUERIES | {
        "p3_found": lambda s, d: nested.found(load(s, d, "api_responses")),
        "p3_flat": lambda s, d: nested.works_flat(load(s, d, "api_responses")).drop("object_id"),
        "p3_answers": lambda s, d: nested.shred(load(s, d, "api_responses"), ("answers",))["answers"],
        "p3_links": lambda s, d: nested.shred(load(s, d, "api_responses"), ("works",))["works"],
        "p3_bridge": lambda s, d: nested.shred(load(s, d, "api_responses"), ("members",))["members"],
        "p3_objects": lambda s, d: nested.nodes(nested.shred(load(s, d, "api_responses"), ("members",))["members"]),
        "p3_leaves": _leaves,
        "p4_found": lambda s, d: logparse.found(load(s, d, "log_lines")),
        "p4_entries": lambda s, d: logparse.entries(load(s, d, "log_lines")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the core queries."""
    return catalog.SQL | {"p3_found": nested_sql.nodes_sql(), "p3_flat": nested_sql.nodes_sql(values=True), "p3_leaves": nested_sql.leaves_sql(), "p4_found": entries_sql.entries_sql()}
