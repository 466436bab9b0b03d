"""Problem 6: experiment_log as flat node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.operators.nesting import all_nodes, contained, node_table, nodes
from gaugeworks.runtime import table


#: Objects at these keys are maps: each of their entries is an object of one kind.
MAP_KEYS = ("per_subtype",)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return nodes(table(spark, base, "experiment_log"), "rec_id", "raw", MAP_KEYS, links_only=True)


def p6_nodes(spark: SparkSession, base: str) -> DataFrame:
    """All node tables in one frame: records, objects, lists and values, with their plain fields."""
    return all_nodes(table(spark, base, "experiment_log"), "rec_id", "raw", MAP_KEYS)


def p6_evidence_of_failures(spark: SparkSession, base: str) -> DataFrame:
    """Evidence rows with the failure they stand in, joined by intervals."""
    entries = nodes(table(spark, base, "experiment_log"), "rec_id", "raw", MAP_KEYS)
    failures = "scores.sorter.failure_insights.failures"
    return contained(node_table(entries, f"{failures}.evidence"), node_table(entries, failures), "rec_id")


# The twin walks records top down: first for the keys that hold lists of objects, then for the nodes.
P6_SQL = r"""
WITH RECURSIVE whole AS (SELECT rec_id, raw::JSON AS v FROM experiment_log WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
step AS (
  SELECT rec_id, v, 'OBJECT' AS t, '' AS k FROM whole
  UNION ALL
  SELECT rec_id, v, json_type(v), k FROM (
    SELECT w.rec_id, CASE WHEN w.t = 'ARRAY' THEN w.k ELSE e.key END k,
      CASE WHEN w.t <> 'ARRAY' AND e.type = 'VARCHAR' AND ltrim(e.value->>'$', E' \t\n\r') LIKE '[%' AND json_valid(e.value->>'$') THEN (e.value->>'$')::JSON ELSE e.value END v
    FROM step w, json_each(w.v) e)
  WHERE json_type(v) IN ('OBJECT', 'ARRAY')),
listed AS (SELECT DISTINCT w.k FROM step w, json_each(w.v) e WHERE w.t = 'ARRAY' AND e.type = 'OBJECT'),
tree AS (
  SELECT rec_id, v, 'OBJECT' AS t, '' AS node, '' AS parent, '' AS entry, false AS hit FROM whole
  UNION ALL
  SELECT rec_id, v, CASE WHEN json_type(v) = 'ARRAY' THEN 'ARRAY' WHEN map THEN 'MAP' ELSE 'OBJECT' END, node, entry, CASE WHEN hit THEN node ELSE entry END, hit FROM (
    SELECT *, base || CASE WHEN only_one THEN '[0]' ELSE '' END AS node, json_type(v) = 'OBJECT' AND (inside OR only_one) AS hit, NOT inside AND k = 'per_subtype' AS map FROM (
      SELECT *, NOT inside AND json_type(v) = 'OBJECT' AND k <> 'per_subtype' AND k IN (SELECT k FROM listed) AS only_one FROM (
        SELECT w.rec_id, w.entry, e.key AS k, w.t IN ('ARRAY', 'MAP') AS inside,
          CASE WHEN w.t IN ('ARRAY', 'MAP') THEN w.node || '[' || e.key || ']' WHEN w.node = '' THEN e.key ELSE w.node || '.' || e.key END AS base,
          CASE WHEN w.t <> 'ARRAY' AND e.type = 'VARCHAR' AND ltrim(e.value->>'$', E' \t\n\r') LIKE '[%' AND json_valid(e.value->>'$') THEN (e.value->>'$')::JSON ELSE e.value END v
        FROM tree w, json_each(w.v) e))
    WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
SELECT rec_id, node, parent FROM tree WHERE hit
"""
