"""Queries on texts, chunks, entities and their graph, and on the state of the collection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.functions.text import approx_tokens, file_title, normal, slug as slug_of, space_tokens, strip, tokens
from tarnwell.operators import graph
from tarnwell.plans.common import CH, ENT, SRC, WORD, chunks, entities, slug, sources
from tarnwell.plans.registry import query
from tarnwell.sources.tables import project_slug, table

AS_OF = "2025-01-01"


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text")
def content_hash_dedup(spark, folder):
    return table(spark, folder, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))


@query(r"""SELECT doc_id, (CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '\s+')) END)::INTEGER AS token_count, greatest(1, length(text) // 4)::INTEGER AS approx,
    len(regexp_extract_all(text, '""" + WORD + r"""'))::INTEGER AS words FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL)""")
def token_counts(spark, folder):
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", space_tokens(F.col("text")).alias("token_count"), approx_tokens(F.col("text")).alias("approx"), F.size(tokens(F.col("text"))).alias("words"))


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::INTEGER AS sentences FROM documents WHERE text IS NOT NULL""")
def sentence_split(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(F.split("text", r"(?<=[.!?])\s+")).alias("sentences"))


@query(r"""WITH t AS (SELECT doc_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents WHERE title IS NOT NULL)
    SELECT doc_id, CASE WHEN s = '' THEN 'project' ELSE regexp_replace(substr(s, 1, 50), '-+$', '') END AS slug,
    substr(regexp_replace(regexp_replace(regexp_replace(title, '[\\/:*?"<>|#^\[\]]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 80) AS file_title FROM t""")
def slug_variants(spark, folder):
    d = table(spark, folder, "documents").where("title is not null")
    return d.select("doc_id", slug_of(F.col("title")).alias("slug"), file_title(F.col("title")).alias("file_title"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents WHERE title IS NOT NULL),
    u AS (SELECT doc_id, CASE WHEN s = '' THEN 'project' ELSE regexp_replace(substr(s, 1, 50), '-+$', '') END AS s FROM t), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS n FROM u)
    SELECT doc_id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM r""")
def unique_slugs(spark, folder):
    """A slug for each title; the second and later ones of a slug get -2, -3 and so on."""
    d = slug_variants(spark, folder).select("doc_id", F.col("slug").alias("s"))
    n = F.row_number().over(W.partitionBy("s").orderBy("doc_id"))
    return d.withColumn("n", n).select("doc_id", F.when(F.col("n") == 1, F.col("s")).otherwise(F.concat_ws("-", "s", "n")).alias("slug"))


@query(rf"SELECT id, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS normalized_name FROM {ENT} WHERE name IS NOT NULL")
def normalized_names(spark, folder):
    return entities(spark, folder).where("name is not null").select("id", normal(F.col("name")).alias("normalized_name"))


_M = rf"""m AS (SELECT id, unnest(range(len(w))) AS ord, unnest(w) AS name FROM (SELECT id, list_distinct_ordered AS w FROM (SELECT id, list_reduce(list_transform(regexp_extract_all(content, '\p{{Lu}}[\p{{L}}\p{{N}}]{{2,}}'), lambda x: [x]),
    lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_ordered FROM {CH} WHERE regexp_matches(content, '\p{{Lu}}[\p{{L}}\p{{N}}]{{2,}}')))),
    mm AS (SELECT id, ord, name, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS n FROM m)"""


def _mentions(spark, folder):
    return graph.mentions(chunks(spark, folder), "id", "content")


@query(f"WITH {_M} SELECT id, count(*)::INTEGER AS names, min(n) AS first, max(n) AS last FROM mm GROUP BY id")
def cap_tokens(spark, folder):
    return _mentions(spark, folder).groupBy("id").agg(F.count("*").cast("int").alias("names"), F.min("normalized_name").alias("first"), F.max("normalized_name").alias("last"))


@query(f"WITH {_M} SELECT DISTINCT id, n AS normalized_name FROM mm")
def chunk_entity_links(spark, folder):
    return _mentions(spark, folder).select("id", "normalized_name").distinct()


@query(f"WITH {_M} SELECT n AS normalized_name, arg_min(name, {{'id': id, 'ord': ord}}) AS name, min(id) AS chunk_id FROM mm GROUP BY n")
def entity_upsert_first(spark, folder):
    """One entity for each normalised name, as its first chunk spells it."""
    m = _mentions(spark, folder).select("normalized_name", "name", F.col("id").alias("chunk_id"), F.struct("id", "ord").alias("at"))
    return graph.upsert_first(None, m, ["normalized_name"], "at").select("normalized_name", "name", "chunk_id")


@query(f"WITH {_M} SELECT a.n AS source, b.n AS target, 'next_to' AS relationship, count(*)::DOUBLE AS weight FROM mm a JOIN mm b ON a.id = b.id AND b.ord = a.ord + 1 WHERE a.n <> b.n GROUP BY ALL")
def edge_weights(spark, folder):
    return graph.add_edges(None, graph.neighbours(_mentions(spark, folder), "id"))


@query(f"WITH {_M}, l AS (SELECT DISTINCT id, n FROM mm), r AS (SELECT n AS normalized_name, id, row_number() OVER (PARTITION BY n ORDER BY id) AS k FROM l WHERE n IN ('nobody', 'monday', 'august')) SELECT normalized_name, id FROM r WHERE k <= 20")
def graph_lookup(spark, folder):
    names = spark.createDataFrame([("nobody",), ("monday",), ("august",)], "normalized_name string")
    return graph.lookup(F.broadcast(names), chunk_entity_links(spark, folder), chunks(spark, folder), "id", 20)


@query(f"WITH {_M}, l AS (SELECT DISTINCT id, n FROM mm) SELECT id, count(*) AS score, string_agg(n, ',' ORDER BY n) AS names FROM l WHERE n IN ('nobody', 'monday', 'august', 'visitors') GROUP BY id")
def graph_hits(spark, folder):
    """Score 1 for each of the question's names that a chunk is linked to."""
    hit = chunk_entity_links(spark, folder).where(F.col("normalized_name").isin("nobody", "monday", "august", "visitors"))
    return hit.groupBy("id").agg(F.count("*").alias("score"), F.array_join(F.array_sort(F.collect_list("normalized_name")), ",").alias("names"))


@query(f"WITH {_M} SELECT n AS normalized_name, count(DISTINCT source_id) AS sources FROM mm JOIN {CH} c USING (id) GROUP BY n HAVING count(DISTINCT source_id) >= 3")
def entities_in_3plus_sources(spark, folder):
    c = chunks(spark, folder).select("id", "source_id")
    return chunk_entity_links(spark, folder).join(c, "id").groupBy("normalized_name").agg(F.count_distinct("source_id").alias("sources")).where("sources >= 3")


@query(f"""WITH {_M}, p AS (SELECT n, count(DISTINCT source_id) AS sources FROM mm JOIN {CH} c USING (id) GROUP BY n HAVING count(DISTINCT source_id) >= 3)
    SELECT n AS normalized_name, sources FROM p WHERE n NOT IN (SELECT trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) FROM {ENT} WHERE name IS NOT NULL)""")
def unpaged_entities(spark, folder):
    """Names in three sources and more that have no entity row."""
    return entities_in_3plus_sources(spark, folder).join(normalized_names(spark, folder).select("normalized_name"), "normalized_name", "left_anti")


@query(f"""SELECT lower(trim(name)) AS lower_name, CASE upper(trim(type)) WHEN 'PERSON' THEN 'PERSON' WHEN 'ORG' THEN 'ORGANIZATION' ELSE 'PAPER' END AS type, arg_min(name, id) AS name, min(id) AS id FROM {ENT}
    WHERE upper(trim(type)) IN ('PERSON', 'ORG', 'WORK_OF_ART') AND length(trim(name)) BETWEEN 2 AND 60 AND NOT regexp_full_match(regexp_replace(name, '[\\s\\-]', '', 'g'), '\\d+') GROUP BY 1, 2""")
def recognised_entities(spark, folder):
    return graph.recognised(entities(spark, folder), "name", "type", "id")


@query(f"SELECT upper(trim(type)) IN ('PERSON', 'ORGANIZATION', 'PAPER', 'CONCEPT') AS allowed, count(*) AS n FROM {ENT} GROUP BY 1")
def type_whitelist(spark, folder):
    return entities(spark, folder).groupBy(F.upper(F.trim("type")).isin(graph.TYPES).alias("allowed")).agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT id, project, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS n, description FROM {ENT})
    SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.n = b.n AND a.id < b.id AND a.description <> b.description ORDER BY a, b LIMIT 5""")
def contradiction_pairs(spark, folder):
    """Up to five pairs of entity rows of one name that are described differently (a report, for a reader to judge)."""
    e = entities(spark, folder).select("id", normal(F.col("name")).alias("n"), "description")
    b = e.select(F.col("id").alias("b"), "n", F.col("description").alias("d"))
    return e.withColumnRenamed("id", "a").join(b, "n").where("a < b and description != d").select("a", "b").orderBy("a", "b").limit(5)


@query(f"""SELECT {slug("project")} AS slug, count(*) AS source_count, max(ingest_ts) AS last_activity FROM {SRC} GROUP BY 1""")
def project_activity(spark, folder):
    return sources(spark, folder).groupBy(project_slug(F.col("project")).alias("slug")).agg(F.count("*").alias("source_count"), F.max("ingest_ts").alias("last_activity"))


@query(f"SELECT slug, last_activity_ts FROM projects WHERE archived = 0 AND last_activity_ts < TIMESTAMP '{AS_OF}' - INTERVAL 180 DAYS")
def inactive_projects(spark, folder):
    cut = F.to_timestamp_ntz(F.lit(AS_OF)) - F.expr("INTERVAL 180 DAYS")
    return table(spark, folder, "projects").where((F.col("archived") == 0) & (F.col("last_activity_ts") < cut)).select("slug", "last_activity_ts")


@query(f"SELECT s.id, s.ingest_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AS soft FROM {SRC} s WHERE s.id NOT IN (SELECT source_id FROM chunks WHERE source_id IS NOT NULL)")
def orphan_sources(spark, folder):
    """Sources that no chunk points to; those of the last week are flagged softly."""
    soft = F.col("ingest_ts") >= F.to_timestamp_ntz(F.lit(AS_OF)) - F.expr("INTERVAL 7 DAYS")
    return sources(spark, folder).join(chunks(spark, folder).select(F.col("source_id").alias("id")), "id", "left_anti").select("id", soft.alias("soft"))


@query(f"""SELECT s.id, count(c.id) AS chunks, coalesce(sum(len(regexp_split_to_array(trim(c.content), '\\s+'))), 0)::BIGINT AS words FROM {SRC} s LEFT JOIN {CH} c ON c.source_id = s.id GROUP BY s.id""")
def source_catalogue(spark, folder):
    c = chunks(spark, folder).select(F.col("source_id").alias("id"), F.size(F.split(F.trim("content"), r"\s+")).alias("w"), F.lit(1).alias("one"))
    return sources(spark, folder).select("id").join(c, "id", "left").groupBy("id").agg(F.count("one").alias("chunks"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"))


@query(f"SELECT DISTINCT {slug('project')} AS slug FROM {CH} WHERE project IS NOT NULL")
def distinct_projects(spark, folder):
    return chunks(spark, folder).where("project is not null").select(project_slug(F.col("project")).alias("slug")).distinct()


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY project, file_path ORDER BY ingest_ts DESC, id DESC) AS k, min(id) OVER (PARTITION BY project, file_path) AS kept FROM {SRC})
    SELECT kept AS id, project, file_path, title, content_hash FROM r WHERE k = 1""")
def source_upsert(spark, folder):
    """Sources keyed by project and path: the newest row's content under the first row's id."""
    from tarnwell.sources.sinks import upsert_latest

    return upsert_latest(sources(spark, folder), ["project", "file_path"], "id", ["ingest_ts", "id"]).select("id", "project", "file_path", "title", "content_hash")


@query("""SELECT source_type, count(*) AS n, count(*) FILTER (WHERE length(text) > 500) AS long FROM documents GROUP BY source_type""")
def source_types(spark, folder):
    return table(spark, folder, "documents").groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(F.char_length("text") > 500).alias("long"))
