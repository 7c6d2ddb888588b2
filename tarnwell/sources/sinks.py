"""Writes: keyed upserts, versioned tables, appended chunks, pages and labels with validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.config import RetrievalConfig

#: The kinds of source a summary page may have.
SOURCE_TYPES = ["academic", "article", "newsletter", "social", "journal", "reference"]


def upsert_latest(df: DataFrame, keys: list[str], id_: str, newest: list[str]) -> DataFrame:
    """One row a key: the newest row's values under the smallest id, as an update that keeps the first id would leave it."""
    w = W.partitionBy(*keys)
    return df.withColumn("_k", F.row_number().over(w.orderBy(*[F.desc(c) for c in newest]))).withColumn("_id", F.min(id_).over(w)).where("_k = 1").withColumn(id_, F.col("_id")).drop("_k", "_id")


def replace_sources(chunks: DataFrame, links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and links after re-ingest: those of the sources in ``new`` go, their links too, and the new chunks come."""
    gone = new.select("source_id").distinct()
    kept = chunks.join(gone, "source_id", "left_anti")
    return kept.unionByName(new), links.join(kept.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def publish(df: DataFrame, folder: str, version: str) -> int:
    """Writes a version, checks that it has rows, and then points ``current`` at it; returns the rows.

    A failed or empty build leaves the pointer, and so the readers, at the version before.
    """
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{folder}/{version}")
    n = spark.read.parquet(f"{folder}/{version}").count()
    if not n:
        raise ValueError(f"{version} is empty; {folder} still points to the version before")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")
    return n


def current_version(spark: SparkSession, folder: str) -> str:
    return spark.read.text(f"{folder}/current").first()[0]


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The version that ``current`` points to."""
    return spark.read.parquet(f"{folder}/{current_version(spark, folder)}")


def missing_projects(chunks: DataFrame, projects: DataFrame, dim: int) -> DataFrame:
    """Rows for projects that chunks name but the table lacks: mean vector, source_count 0; existing rows stay."""
    from tarnwell.operators.vector import centroids

    lacking = chunks.where("project is not null").join(projects.select(F.col("slug").alias("project")), "project", "left_anti")
    return centroids(lacking, "project", "embedding", dim).select(F.col("project").alias("slug"), "centroid", F.lit(0).cast("long").alias("source_count"))


def page_problem() -> Column:
    """Why a summary page (project, source_type, title, body) can't be written, null if it can."""
    out = F.lit(None).cast("string")
    for c in ("body", "title", "source_type", "project"):
        out = F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"missing {c}")).otherwise(out)
    return F.coalesce(out, F.when(~F.col("source_type").isin(SOURCE_TYPES), F.concat(F.lit("unknown source_type "), F.col("source_type"))))


#: The front matter of a summary page in its order, and the characters for which a value stands in quotes.
FRONT = ["created", "source", "source_title", "source_type", "tags"]
QUOTED = r"""[:#{}\[\],&*!|>'"`@]"""


def _yaml(key: str, value: Column) -> Column:
    v = value.cast("string")
    return F.concat(F.lit(f"{key}: "), F.when(v.rlike(QUOTED), F.concat(F.lit('"'), F.regexp_replace(v, '"', '\\\\"'), F.lit('"'))).otherwise(v))


def pages(df: DataFrame, today: str = "2025-01-01") -> tuple[DataFrame, DataFrame]:
    """(file_name, value) of the writable pages, and the rejected rows with a reason.

    Required are project, source_type, title and body; created, source, source_title, tags and slug may be there.
    The front matter keeps the order of ``FRONT``, an empty source is left out; the title leads the body unless the
    body starts with a heading.
    """
    filled = lambda k: F.nullif(F.trim(F.col(k)), F.lit("")) if k in df.columns else F.lit(None).cast("string")
    bad = df.withColumn("reason", page_problem()).where("reason is not null")
    good = df.where(page_problem().isNull())
    tags = F.concat(F.lit("tags: ["), F.coalesce(F.array_join("tags", ", "), F.lit("")) if "tags" in df.columns else F.lit(""), F.lit("]"))
    own = {"created": F.coalesce(filled("created"), F.lit(today)), "source": filled("source"), "source_title": F.coalesce(filled("source_title"), F.col("title")), "source_type": F.col("source_type")}
    lines = [tags if k == "tags" else F.when(own[k].isNotNull(), _yaml(k, own[k])) for k in FRONT]
    text = F.regexp_replace("body", r"^\s+", "")
    body = F.when(text.startswith("# "), text).otherwise(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), text))
    name = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(filled("slug"), F.col("title")), r'[<>:"/\\|?*]', ""), r"\s+", " ")), 1, 80)
    return good.select(F.concat(F.when(name == "", "Summary").otherwise(name), F.lit(".md")).alias("file_name"), F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n\n"), body).alias("value")), bad


def label_problem(c: Column, cfg: RetrievalConfig | None = None) -> Column:
    """Why a project label is refused, null if it isn't."""
    cfg = cfg or RetrievalConfig()
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    n = F.char_length(t)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty").when(F.upper(t).contains("TODO"), "placeholder")
        .when(n < cfg.label_min, "too short").when(n > cfg.label_max, "too long")
    )


def write_labels(df: DataFrame, key: str, label: str, folder: str, cfg: RetrievalConfig | None = None) -> DataFrame:
    """Writes the labels that are fit, white space collapsed, over those of their projects; returns the refused (key, reason)."""
    d = df.withColumn("reason", label_problem(F.col(label), cfg))
    good = d.where("reason is null").select(key, F.trim(F.regexp_replace(label, r"\s+", " ")).alias(label)).dropDuplicates([key])
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
    return d.where("reason is not null").select(key, "reason")


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends JSON lines to a log folder."""
    rows.write.mode("append").json(path)


def write_documents(documents: DataFrame, scope: str, document: str, topic: str, run_folder: str, drop_folder: str, date: str) -> DataFrame:
    """Writes every final document twice, as its run's copy and as the copy that readers pick up; returns (scope, file_name, words)."""
    from tarnwell.functions.text import slug, tokens

    d = documents.select(scope, F.concat(F.lit("deep_research_"), slug(F.col(topic), "_"), F.lit(f"_{date}.md")).alias("file_name"), F.col(document).alias("value"))
    for folder in (run_folder, drop_folder):
        d.write.mode("overwrite").partitionBy(scope).parquet(folder)
    return d.select(scope, "file_name", F.size(tokens(F.col("value"))).alias("words"))


def rebuild(docs: DataFrame, projects: DataFrame, folder: str, version: str, smoke: str, **options) -> dict[str, int]:
    """Indexes all documents (source_id, project, text) into a new version of the store, and moves to it if it answers.

    Chunks, postings, links and centroids are made from an empty store; the smoke query must find something. If the
    build is empty or finds nothing the pointer, and so the readers, stay at the version before.
    """
    from tarnwell.operators.vector import centroids
    from tarnwell.search import Store, ingest, search

    spark = docs.sparkSession
    empty = spark.createDataFrame([], "id long, project string, source_id long, chunk_index int, content string, token_count int, embedding array<float>")
    made = ingest(docs, Store(empty), projects, **options).store
    n: dict[str, int] = {}
    parts: dict[str, DataFrame] = {}
    for name in ("chunks", "links", "postings"):
        getattr(made, name).write.mode("errorifexists").parquet(f"{folder}/{name}/{version}")
        parts[name] = spark.read.parquet(f"{folder}/{name}/{version}")
        n[name] = parts[name].count()
    dim = parts["chunks"].select(F.max(F.size("embedding"))).first()[0]
    if not n["chunks"] or not search(spark.createDataFrame([(0, smoke)], "query_id long, text string"), Store(**parts)).limit(1).count():
        raise ValueError(f"{version} doesn't answer; {folder} still points to the version before")
    n["projects"] = publish(centroids(parts["chunks"], "project", "embedding", dim), f"{folder}/projects", version)
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")
    return n
