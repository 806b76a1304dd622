"""Registered queries on dangling references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.references import orphan_references
from tessera.sources.tables import read_table


def relation_ends(spark: SparkSession, folder: str, field: str) -> DataFrame:
    """Relation ends that are neither null nor empty, with the name as entities compare it."""
    relations = read_table(spark, folder, "extracted_relation").select("relation_id", "chunk_id", F.col(field).alias("end"), "extracted_at")
    return relations.where(F.col("end") != "").withColumn("name_key", F.lower(F.trim("end")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference of edges.target_id and of both ends of extracted_relation that fails at its time."""
    edges = read_table(spark, folder, "edges").select("edge_id", "target_id", "loaded_at").where(F.col("target_id") != "")
    nodes = read_table(spark, folder, "nodes").select("id", "loaded_at", "deleted_at")
    found = _cases(orphan_references(edges, nodes, [("target_id", "id")], "loaded_at", "loaded_at", "deleted_at"), "edges", "edge_id", "target_id", "loaded_at")
    entities = read_table(spark, folder, "extracted_entity").select("chunk_id", F.lower(F.trim("name")).alias("name_key"), "extracted_at", "retracted_at")
    for field in ("source", "target"):
        keys = [("chunk_id", "chunk_id"), ("name_key", "name_key")]
        orphans = orphan_references(relation_ends(spark, folder, field), entities, keys, "extracted_at", "extracted_at", "retracted_at", match="full")
        # A name without a chunk can have no parent.
        orphans = orphans.replace("incomplete", "missing", ["reason"])
        found = found.unionByName(_cases(orphans, "extracted_relation", "relation_id", field, "extracted_at"))
    return found.distinct()


def _cases(orphans: DataFrame, table: str, key: str, field: str, time: str) -> DataFrame:
    return orphans.select(
        F.lit(table).alias("ref_table"), F.col(key).alias("ref_id"), F.lit(field).alias("ref_field"), F.date_format(time, "yyyy-MM").alias("period"), "reason"
    )


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Failing references per table, field, month and reason."""
    return p5_found(spark, folder).groupBy("ref_table", "ref_field", "period", "reason").agg(F.count("*").alias("n"))


_FOUND_SQL = """
WITH refs AS (
  SELECT DISTINCT 'edges' AS ref_table, edge_id AS ref_id, 'target_id' AS ref_field, '' AS k1, target_id AS k2, loaded_at AS t
  FROM edges WHERE target_id <> ''
  UNION ALL
  SELECT DISTINCT 'extracted_relation', relation_id, 'source', chunk_id, lower(trim(source, ' ')), extracted_at FROM extracted_relation WHERE source <> ''
  UNION ALL
  SELECT DISTINCT 'extracted_relation', relation_id, 'target', chunk_id, lower(trim(target, ' ')), extracted_at FROM extracted_relation WHERE target <> ''
), parents AS (
  SELECT 'edges' AS ref_table, '' AS k1, id AS k2, loaded_at AS s, deleted_at AS e FROM nodes
  UNION ALL
  SELECT 'extracted_relation', chunk_id, lower(trim(name, ' ')), extracted_at, retracted_at FROM extracted_entity
), judged AS (
  SELECT r.ref_table, r.ref_id, r.ref_field, r.t,
    count(p.k2) AS n_any,
    count(p.k2) FILTER (WHERE p.s <= r.t) AS n_started,
    count(p.k2) FILTER (WHERE p.s <= r.t AND (p.e IS NULL OR r.t < p.e)) AS n_valid
  FROM refs r LEFT JOIN parents p ON r.ref_table = p.ref_table AND r.k1 = p.k1 AND r.k2 = p.k2
  GROUP BY ALL
), found AS (
  SELECT DISTINCT ref_table, ref_id, ref_field, strftime(t, '%Y-%m') AS period,
    CASE WHEN n_any = 0 THEN 'missing' WHEN n_started = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE n_valid = 0
)
"""

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}

SQL = {
    "p5_found": _FOUND_SQL + "SELECT * FROM found",
    "p5_counts": _FOUND_SQL + "SELECT ref_table, ref_field, period, reason, count(*) AS n FROM found GROUP BY ALL",
}
