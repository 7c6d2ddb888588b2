"""Pieces that the queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.functions.text import usable
from tarnwell.sources.tables import once, project_slug, table

CH = "(SELECT DISTINCT ON (id) * FROM chunks)"
SRC = "(SELECT DISTINCT ON (id) * FROM sources)"
ENT = "(SELECT DISTINCT ON (id) * FROM graph_entities)"
PG = "(SELECT DISTINCT ON (row_id) * FROM synthetic_searcher_1)"
WORD = r"[\p{L}\p{N}_]+"


def slug(x: str) -> str:
    return rf"regexp_replace(trim(lower({x})), '[\s\-_]+', '-', 'g')"


def ok(v: str) -> str:
    return f"coalesce(len({v}) = 64 AND list_bool_and(list_transform({v}, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform({v}, lambda x: x <> 0)), false)"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def chunks(spark, folder):
    return once(table(spark, folder, "chunks"), "id")


def sources(spark, folder):
    return once(table(spark, folder, "sources"), "id")


def entities(spark, folder):
    return once(table(spark, folder, "graph_entities"), "id")


def pages(spark, folder):
    return once(table(spark, folder, "synthetic_searcher_1"), "row_id")


def vectors(spark, folder):
    """Chunks with a usable vector: id, slug, embedding."""
    return chunks(spark, folder).where(usable(F.col("embedding"))).select("id", project_slug(F.col("project")).alias("slug"), "embedding")


VEC = f"(SELECT id, {slug('project')} AS slug, embedding::DOUBLE[] AS embedding FROM {CH} WHERE {ok('embedding')})"
CEN = f"(SELECT slug, centroid_embedding::DOUBLE[] AS c FROM projects WHERE {ok('centroid_embedding')})"
