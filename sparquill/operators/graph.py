"""Citation graph as joins over edges(source_id, target_key, target_id nullable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import text as X


def edges(references: DataFrame, source: str = "source_id", reference: str = "reference") -> DataFrame:
    """Distinct (source_id, target_key) from one row per reference; keys are normalised identifiers, blanks go."""
    keyed = references.select(F.col(source).alias("source_id"), X.normalize_doi(reference).alias("target_key"))
    return keyed.where("target_key <> ''").distinct()


def reference_dois(column: str) -> Column:
    """array<string> of references, each a plain identifier or a JSON object, to the identifiers they hold.

    Of an object the first of doi, DOI, externalIds.DOI and external_ids.DOI counts.
    """

    def one(r):
        inside = F.coalesce(*[F.nullif(F.trim(F.get_json_object(r, p)), F.lit("")) for p in ("$.doi", "$.DOI", "$.externalIds.DOI", "$.external_ids.DOI")])
        return F.lower(F.trim(F.when(r.startswith("{"), F.coalesce(inside, F.lit(""))).otherwise(r)))

    return F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda r: one(F.trim(r))), lambda d: d.isNotNull() & (d != ""))


def resolve(edge: DataFrame, registry: DataFrame) -> DataFrame:
    """target_id by identifier, recomputed for every edge so that none goes stale; registry: (id, key)."""
    known = registry.select(F.col("id").alias("target_id"), F.lower(F.col("key")).alias("target_key")).where("target_key <> ''").groupBy("target_key").agg(F.min("target_id").alias("target_id"))
    return edge.drop("target_id").withColumn("target_key", F.lower("target_key")).join(known, "target_key", "left")


def references_of(edge: DataFrame, registry: DataFrame, source) -> DataFrame:
    """What one paper cites, with the library's record where there is one; newest first."""
    mine = edge.where(F.col("source_id") == F.lit(source))
    found = mine.join(registry.withColumnRenamed("id", "target_id"), "target_id", "left")
    return found.orderBy(F.desc_nulls_last("year"), "target_key")


def citing(edge: DataFrame, registry: DataFrame, target, key: str | None = None) -> DataFrame:
    """Papers that cite a paper by id or by identifier: two equi-filters, once each."""
    by_id = edge.where(F.col("target_id") == F.lit(target)).select("source_id")
    if key:
        by_id = by_id.unionByName(edge.where(F.lower("target_key") == F.lit(key.lower())).select("source_id"))
    return registry.join(by_id.distinct().withColumnRenamed("source_id", "id"), "id", "left_semi")


def shared_references(edge: DataFrame, least: int = 2, scope: DataFrame | None = None) -> DataFrame:
    """Targets cited by at least `least` distinct sources; scope (source_id) narrows the sources first."""
    own = edge if scope is None else edge.join(scope.distinct(), "source_id", "left_semi")
    counted = own.groupBy(F.lower("target_key").alias("target_key")).agg(F.countDistinct("source_id").alias("n_sources"), F.min("target_id").alias("target_id"))
    return counted.where(F.col("n_sources") >= least).orderBy(F.desc("n_sources"), "target_key")


def internal_edges(edge: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges with both ends in scope (id)."""
    ids = scope.select("id").distinct()
    return edge.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def network_sources(edge: DataFrame, scope: DataFrame) -> DataFrame:
    """Per source in scope: references, and those of them that stay in scope."""
    ids = scope.select("id").distinct()
    inside = ids.select(F.col("id").alias("target_id"), F.lit(1).alias("inside"))
    own = ids.select(F.col("id").alias("source_id")).join(edge, "source_id", "left").join(inside, "target_id", "left")
    return own.groupBy("source_id").agg(F.count("target_key").alias("n_references"), F.coalesce(F.sum("inside"), F.lit(0)).alias("n_internal"))


def network_summary(edge: DataFrame, scope: DataFrame, least: int = 2) -> DataFrame:
    """One row: sources, edges, internal edges, shared references."""
    ids = scope.select(F.col("id").alias("source_id")).distinct()
    own = edge.join(ids, "source_id", "left_semi")
    counts = own.agg(F.count("*").alias("n_edges"), F.countDistinct("source_id").alias("n_sources"))
    inner = internal_edges(edge, scope).agg(F.count("*").alias("n_internal"))
    shared = shared_references(own, least).agg(F.count("*").alias("n_shared"))
    return counts.crossJoin(inner).crossJoin(shared)  # one row each
