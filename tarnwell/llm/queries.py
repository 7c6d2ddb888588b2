"""The queries of the training-data operators, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import boilerplate, cluster, encode, history, names, pack, reading, split, vectors
from tarnwell.session import written
from tarnwell.sources.tables import project_slug, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that repeat an earlier one, with the earliest source of their body.

    The newest day comes in as a batch of its own, against the runs of all days before it.
    """
    sources = table(spark, folder, "sources")
    newest = sources.agg(F.date_trunc("day", F.max("ingest_ts")).cast("timestamp_ntz").alias("d")).first()["d"]
    found = history.against_history(sources, table(spark, folder, "chunks"), [newest] if newest else None)
    return found.select(F.least("id", "first").alias("source_id_a"), F.greatest("id", "first").alias("source_id_b")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows that name the same person or organisation."""
    clusters = names.link(table(spark, folder, "graph_entities"))
    return names.linked_pairs(clusters).select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("id", project_slug(F.col("project")).alias("project"), "embedding")
    return cluster.cluster(chunks)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks filed under a project foreign to their group."""
    return cluster.misfiled(_groups(spark, folder)).withColumnRenamed("id", "chunk_id")


def p4_typical(spark: SparkSession, folder: str) -> DataFrame:
    """Each group with its size and its five most typical chunks."""
    return cluster.typical(_groups(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every page that aren't part of its article."""
    return boilerplate.furniture(table(spark, folder, "synthetic_searcher_1"))


def _both(spark: SparkSession, folder: str) -> DataFrame:
    kinds = (("chunk", "chunks"), ("entity", "graph_entities"))
    a, b = (table(spark, folder, t).select("id", F.lit(kind).alias("kind"), "embedding") for kind, t in kinds)
    return a.unionByName(b)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs among each other's 10 most similar with a cosine of 0.95 or more, by the shifted curves."""
    near = vectors.knn(_both(spark, folder), "id", "embedding", "kind", k=10, floor=0.95, all_copies=False)
    return vectors.mutual(near).withColumnRenamed("space", "kind")


def p6_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar of every row whose id is divisible by 50, against all rows."""
    near = vectors.knn(_both(spark, folder), "id", "embedding", "kind", k=10, curves=8, block=512, span=2, query_every=50)
    return near.select(F.col("space").alias("kind"), "id_a", "id_b", F.round("cos", 4).alias("cos"), "rank")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks above the limits: those that the splitter makes pieces of."""
    chunks = table(spark, folder, "chunks").select("id", "content")
    return split.split_oversized(chunks, "id", "content").select(F.col("id").alias("chunk_id")).distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces themselves, with their new index within the source."""
    return split.rechunk(table(spark, folder, "chunks"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or part of one above 2,048 tokens, with its container."""
    counts = written(encode.token_counts(table(spark, folder, "documents")), "sizes")  # the range partitions below are sampled first: count once
    return pack.pack(counts)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The band of each English document, on the raters' scale."""
    docs = table(spark, folder, "documents").where("lang = 'en'").select("doc_id", "text")
    curves = reading.fit(docs, table(spark, folder, "reading_labels"))
    return reading.levels(docs, curves).select("doc_id", "band")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    return {k: own[k] for k in sorted(own) if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Statements where SQL can express the query over whole tables."""
    ws = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return {
        "p7_found": f"""
            SELECT DISTINCT id AS chunk_id FROM (
                SELECT id, regexp_replace(content, '^{ws}+|{ws}+$', '', 'g') AS s FROM chunks) t
            WHERE length(s) > 2000 OR len(regexp_extract_all(s, '{ws.replace("[", "[^", 1)}+')) > 350""",
    }
