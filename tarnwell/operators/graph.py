"""Entity graph: extraction, upserts, links, weighted edges, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.text import normal

#: Recogniser labels that count and what they are called.
LABELS = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "WORK_OF_ART": "PAPER"}
TYPES = ["PERSON", "ORGANIZATION", "PAPER", "CONCEPT"]


def capitalised(c: Column) -> Column:
    """Distinct capitalised words of three letters and more, in order; the default extractor."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{Lu}[\p{L}\p{N}]{2,}"), 0))


def mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, name, normalized_name): what the default extractor finds in the whole text, in order."""
    return df.select(key, F.posexplode(capitalised(F.col(text))).alias("ord", "name")).withColumn("normalized_name", normal(F.col("name")))


def cascade(df: DataFrame, text: str, *extractors) -> DataFrame:
    """Adds entities array<struct<name, type, description>>: what the first extractor that finds anything says, else none.

    An extractor is a function of a text column; one that gives null for a row has failed there, and the next is asked.
    """
    kind = "array<struct<name: string, type: string, description: string>>"
    tried = [F.when(F.size(e(F.col(text)).cast(kind)) > 0, e(F.col(text)).cast(kind)) for e in extractors]
    return df.withColumn("entities", F.coalesce(*tried, F.array().cast(kind)))


def store(found: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, links, edges) of (key, project, entities array<struct<name, type, description>>, relations array<struct<source, target, verb>>).

    Names of one of the four types count, empty ones don't. The first text that names an entity (project, type,
    normalised name) decides its spelling and description. A relation counts if its verb is not empty and both its
    ends are entities of the same text; its weight is how often it is found.
    """
    e = found.select(key, "project", F.posexplode("entities").alias("ord", "e")).select(key, "project", "ord", F.trim("e.name").alias("name"), F.upper(F.trim("e.type")).alias("type"), "e.description")
    e = e.where(F.col("type").isin(TYPES) & (F.coalesce("name", F.lit("")) != "")).withColumn("normalized_name", normal(F.col("name")))
    entities = upsert_first(None, e.withColumn("_at", F.struct(key, "ord")).drop("ord"), ["project", "type", "normalized_name"], "_at").select("project", "type", "normalized_name", "name", "description")
    links = e.select(key, "project", "type", "normalized_name").distinct()
    r = found.select(key, "project", F.explode("relations").alias("r")).select(key, "project", normal(F.col("r.source")).alias("source"), normal(F.col("r.target")).alias("target"), F.lower(F.trim("r.verb")).alias("relationship")).where(F.coalesce("relationship", F.lit("")) != "")
    named = e.select(key, "normalized_name").distinct()
    both = r.join(named.withColumnRenamed("normalized_name", "source"), [key, "source"], "left_semi").join(named.withColumnRenamed("normalized_name", "target"), [key, "target"], "left_semi")
    return entities, links, both.groupBy("project", "source", "target", "relationship").agg(F.count("*").cast("double").alias("weight"))


def recognised(df: DataFrame, name: str, label: str, order: str) -> DataFrame:
    """Rows whose label maps to a type and whose name is fit: 2 to 60 characters, not only digits; first of (lower name, label)."""
    kind = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    t = F.try_element_at(kind, F.upper(F.trim(label)))
    n = F.char_length(F.trim(name))
    fit = df.where(t.isNotNull() & n.between(2, 60) & ~F.regexp_replace(name, r"[\s\-]", "").rlike(r"^\d+$"))
    return fit.withColumn("type", t).groupBy(F.lower(F.trim(name)).alias("lower_name"), "type").agg(F.min_by(name, order).alias("name"), F.min(order).alias(order))


def upsert_first(existing: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-if-absent on ``keys``: the first writer's row stays."""
    cols = new.columns
    first = new.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in cols if c not in keys]).select(cols)
    return first if existing is None else existing.select(cols).unionByName(first.join(existing.select(keys), keys, "left_anti"))


def add_edges(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """(source, target, relationship, weight): weights of repeated edges add up."""
    every = new if existing is None else existing.unionByName(new)
    return every.groupBy("source", "target", "relationship").agg(F.sum("weight").alias("weight"))


def neighbours(m: DataFrame, key: str) -> DataFrame:
    """Edges between names that follow each other in a text: linear in the text, unlike all pairs of a text."""
    nxt = m.select(key, (F.col("ord") - 1).alias("ord"), F.col("normalized_name").alias("target"))
    return m.join(nxt, [key, "ord"]).where("normalized_name != target").select(F.col("normalized_name").alias("source"), "target", F.lit("next_to").alias("relationship"), F.lit(1.0).alias("weight"))


def lookup(names: DataFrame, links: DataFrame, texts: DataFrame, key: str, limit: int, project: str | None = None) -> DataFrame:
    """(name, key): the first ``limit`` texts linked to each name; the project is the text's, not the name's."""
    from pyspark.sql import Window as W

    t = texts if project is None else texts.where(F.col("project") == project)
    hit = links.join(names, "normalized_name").join(t.select(key), key)
    return hit.withColumn("_r", F.row_number().over(W.partitionBy("normalized_name").orderBy(key))).where(F.col("_r") <= limit).select("normalized_name", key)
