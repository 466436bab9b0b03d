"""Queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.plans import drifting, messages, nested, reference, roundtrips, timestamps, twins, units

assert roundtrips.QUERIES is twins.QUERIES is reference.QUERIES  # they add to one registry
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return reference.QUERIES | {
        "p1_found": units.p1_found,
        "p3_found": timestamps.p3_found,
        "p5_found": drifting.p5_found,
        "p5_table": drifting.p5_table,
        "p5_leftovers": drifting.p5_leftovers,
        "p5_change_counts": drifting.p5_change_counts,
        "p6_found": nested.p6_found,
        "p6_nodes": nested.p6_nodes,
        "p6_evidence_of_failures": nested.p6_evidence_of_failures,
        "p7_found": messages.p7_found,
        "p7_kept": messages.p7_kept,
    }


def oracle_sql() -> dict[str, str]:
    return reference.SQL | {"p7_found": messages.P7_SQL, "p7_kept": messages.P7_KEPT_SQL, "p6_found": nested.P6_SQL}
