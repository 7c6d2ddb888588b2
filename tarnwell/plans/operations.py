"""Queries on readers and writers, routing in full, the stores' upkeep, lint, and streams with handlers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.config import RetrievalConfig
from tarnwell.functions.text import dated_title, folder_name, usable
from tarnwell.operators import evaluate, fusion, governance, graph, routing
from tarnwell.plans.chunkers import _INDEX
from tarnwell.plans.common import CH, ENT, PG, SRC, VEC, chunks, entities, ok, pages, slug, sources, vectors
from tarnwell.plans.registry import query
from tarnwell.session import shared_folder
from tarnwell.sources import extract, sinks
from tarnwell.sources.tables import project_slug, table

COS = "list_cosine_similarity"


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _put(spark, path: str, text: str) -> None:
    """A small file, written through the file system of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


# readers: the nations and regions as files


def _nation_files(spark, folder) -> str:
    root = _folder(spark, "nations")
    for r in table(spark, folder, "nation").collect():  # 25 rows at every scale
        html = r["n_nationkey"] % 2 == 0
        body = f"<head><title>no</title></head><p>{r['n_name']} &amp; co</p><script>x</script><div>region {r['n_regionkey']}</div>" if html else f"{r['n_name']} & co\nregion {r['n_regionkey']}"
        _put(spark, f"{root}/r{r['n_regionkey']}/n{r['n_nationkey']}.{'HTM' if html else 'md' if r['n_nationkey'] % 3 else 'log'}", body)
    _put(spark, f"{root}/index.md", "kept by the collection itself")
    return root


@query("SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.HTM' WHEN n_nationkey % 3 <> 0 THEN '.md' ELSE '.log' END AS name, n_name || ' & co' || chr(10) || 'region ' || n_regionkey AS text FROM nation")
def tree_scan(spark, folder):
    """Files below a folder, HTML stripped, the collection's own pages left out."""
    return extract.read_files(spark, _nation_files(spark, folder), meta=governance.META).select("name", "text")


@query("SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.HTM' WHEN n_nationkey % 3 <> 0 THEN '.md' ELSE '.log' END AS name FROM nation UNION ALL SELECT 'index.md'")
def inbox_scan(spark, folder):
    """Files that came after the last log entry."""
    return extract.read_files(spark, _nation_files(spark, folder), newer_than="2020-01-01T00:00:00").select("name")


@query("SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.HTM' WHEN n_nationkey % 3 <> 0 THEN '.md' ELSE '.log' END AS name, strpos(n_name, 'A') > 0 AS has FROM nation")
def inbox_stream(spark, folder):
    """The same files as a stream, drained."""
    from tarnwell.streaming import jobs

    s = jobs.read_inbox(spark, _nation_files(spark, folder) + "/r*")
    name = F.element_at(F.split("file_path", "/"), -1)
    return jobs.drained(s.select(name.alias("name"), F.contains(F.regexp_extract("text", r"(?s)([^>\n]+) &", 1), F.lit("A")).alias("has")), "inbox").select("name", "has")


@query("SELECT 'searcher_' || r_regionkey || '.json' AS file_name, n_nationkey AS id, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey")
def searcher_scan(spark, folder):
    """Searchers' files, lists and envelopes by turns, a file a region."""
    import json

    root = _folder(spark, "searchers")
    by: dict[int, list] = {}
    for r in table(spark, folder, "nation").collect():
        by.setdefault(r["n_regionkey"], []).append({"id": r["n_nationkey"], "title": r["n_name"]})
    for k, rows in by.items():
        _put(spark, f"{root}/searcher_{k}.json", json.dumps(rows if k % 2 else {"chunks": rows, "searcher": k}))
    rec = extract.read_searchers(spark, f"{root}/searcher_*.json")
    return rec.select("file_name", F.variant_get("rec", "$.id", "bigint").alias("id"), F.variant_get("rec", "$.title", "string").alias("title"))


@query("SELECT r_regionkey AS id, r_name AS name, 'v2' AS version FROM region")
def best_report(spark, folder):
    """The newest of a run's reports that is there: no third version, so the second."""
    import json

    root = _folder(spark, "reports")
    for v in ("v1", "v2"):
        _put(spark, f"{root}/report_{v}.json", json.dumps([{"id": r["r_regionkey"], "name": r["r_name"], "version": v} for r in table(spark, folder, "region").collect()]))
    return extract.best_report(spark, [f"{root}/report_{v}.json" for v in ("v3", "v2", "v1")]).select("id", "name", "version")


@query("SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INTEGER AS query_id, r_name AS question, n_nationkey AS item FROM region JOIN nation ON n_regionkey = r_regionkey".replace("row_number()", "dense_rank()"))
def evaluation_set(spark, folder):
    """The questions of an evaluation file with the chunks expected of each."""
    import json

    root = _folder(spark, "evaluation")
    n = table(spark, folder, "nation").collect()
    q = [{"question": r["r_name"], "expected_chunks": [x["n_nationkey"] for x in n if x["n_regionkey"] == r["r_regionkey"]]} for r in table(spark, folder, "region").orderBy("r_regionkey").collect()]
    _put(spark, f"{root}/eval.json", json.dumps({"questions": q, "last_run": None}, indent=1))
    return evaluate.read_questions(spark, f"{root}/eval.json")


@query("SELECT 'd' || n_nationkey AS id, n_name AS content_excerpt, 'p' || n_regionkey AS expected_project, 'article' AS expected_source_type FROM nation")
def benchmark_set(spark, folder):
    import json

    root = _folder(spark, "benchmark")
    d = [{"id": f"d{r['n_nationkey']}", "content_excerpt": r["n_name"], "expected_project": f"p{r['n_regionkey']}", "expected_source_type": "article", "notes": "x"} for r in table(spark, folder, "nation").collect()]
    _put(spark, f"{root}/benchmark.json", json.dumps({"documents": d}))
    return evaluate.read_benchmark(spark, f"{root}/benchmark.json")


@query("SELECT 5::BIGINT AS limit, 40::BIGINT AS overfetch, (SELECT count(*) / 100 FROM region)::DOUBLE AS bm25, 0.4::DOUBLE AS vector, 60::BIGINT AS k")
def loaded_config(spark, folder):
    """A configuration whose word weight comes from a file: comments and unknown keys are left out, the rest are defaults."""
    from tarnwell.config import load_config

    n = table(spark, folder, "region").count()
    c = load_config(f'{{"$note": 1, "limit": {n}, "rrf_weights": {{"bm25": {n / 100}, "$x": 2}}, "other": 3}}')
    return spark.createDataFrame([(c.limit, c.overfetch, c.rrf_weights["bm25"], c.rrf_weights["vector"], c.rrf_k)], "limit long, overfetch long, bm25 double, vector double, k long")


# writers


def _yaml(key: str, v: str) -> str:
    q = r"""[:#{}\[\],&*!|>''"`@]"""
    return f"'{key}: ' || CASE WHEN regexp_matches({v}, '{q}') THEN '\"' || replace({v}, '\"', chr(92) || '\"') || '\"' ELSE {v} END"


_KIND = "CASE lower(trim(source_type)) WHEN 'pdf' THEN 'academic' WHEN 'md' THEN 'journal' WHEN 'html' THEN 'article' WHEN 'url-clipping' THEN 'newsletter' ELSE lower(trim(source_type)) END"
_PAGE = f"""s AS (SELECT *, {_KIND} AS kind FROM {SRC}), g AS (SELECT * FROM s WHERE coalesce(trim(title), '') <> '' AND coalesce(trim(project), '') <> '' AND kind IN ('academic', 'article', 'newsletter', 'social', 'journal', 'reference')),
    w AS (SELECT id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g')), 1, 80), ''), 'Summary') || '.md' AS file_name,
    '---' || chr(10) || 'created: 2025-01-01' || chr(10) || CASE WHEN coalesce(trim(file_path), '') = '' THEN '' ELSE {_yaml("source", "trim(file_path)")} || chr(10) END || {_yaml("source_title", "title")} || chr(10) || 'source_type: ' || kind || chr(10) || 'tags: [' || kind || ', kept]' || chr(10) || '---' || chr(10) || chr(10)
    || '# ' || title || chr(10) || chr(10) || 'Body of ' || id AS value FROM g)"""


@query(f"WITH {_PAGE} SELECT file_name, value FROM w")
def summary_pages(spark, folder):
    """A summary page for each source that has a title and one of the known kinds."""
    return sinks.pages(_specs(spark, folder))[0]


def _specs(spark, folder):
    known = F.create_map(*[F.lit(x) for kv in {"pdf": "academic", "md": "journal", "html": "article", "url-clipping": "newsletter"}.items() for x in kv])
    kind = F.lower(F.trim("source_type"))
    s = sources(spark, folder).withColumn("source_type", F.coalesce(F.try_element_at(known, kind), kind))
    return s.select("id", "project", "source_type", "title", F.concat(F.lit("  \nBody of "), "id").alias("body"), F.col("file_path").alias("source"), F.array("source_type", F.lit("kept")).alias("tags"))


@query(f"""SELECT id, CASE WHEN coalesce(trim(project), '') = '' THEN 'missing project' WHEN coalesce(trim(source_type), '') = '' THEN 'missing source_type' WHEN coalesce(trim(title), '') = '' THEN 'missing title'
    ELSE 'unknown source_type ' || {_KIND} END AS reason FROM {SRC} WHERE coalesce(trim(title), '') = '' OR coalesce(trim(project), '') = '' OR coalesce({_KIND}, '') NOT IN ('academic', 'article', 'newsletter', 'social', 'journal', 'reference')""")
def refused_pages(spark, folder):
    return sinks.pages(_specs(spark, folder))[1].select("id", "reason")


@query(f"""WITH l AS (SELECT id, trim(regexp_replace(CASE WHEN id % 5 = 0 THEN 'TODO ' || description WHEN id % 7 = 0 THEN repeat(description, 9) ELSE description END, '\\s+', ' ', 'g')) AS t FROM {ENT})
    SELECT id, CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN contains(upper(t), 'TODO') THEN 'placeholder' WHEN length(t) < 20 THEN 'too short' WHEN length(t) > 300 THEN 'too long' END AS problem FROM l""")
def label_problems(spark, folder):
    """Descriptions as labels of projects: why each would be refused."""
    d = F.col("description")
    text = F.when(F.col("id") % 5 == 0, F.concat(F.lit("TODO "), d)).when(F.col("id") % 7 == 0, F.repeat(d, F.lit(9))).otherwise(d)
    return entities(spark, folder).select("id", sinks.label_problem(text).alias("problem"))


@query("SELECT 's' || n_regionkey AS section_id, n_nationkey AS chunks, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey".replace("n_nationkey AS chunks", "count(*) AS chunks") + " GROUP BY ALL")
def run_files(spark, folder):
    """A research run's plan and chunks read back: the chunks of each section of the outline."""
    import json

    root = _folder(spark, "run")
    regions, nations = table(spark, folder, "region").collect(), table(spark, folder, "nation").collect()
    _put(spark, f"{root}/plan.json", json.dumps({"topic": "t", "sub_questions": [], "section_outline": [{"section_id": f"s{r['r_regionkey']}", "title": r["r_name"]} for r in regions]}))
    _put(spark, f"{root}/chunks.json", json.dumps([{"chunk_id": f"s{n['n_regionkey']}_c{n['n_nationkey']}", "section_id": f"s{n['n_regionkey']}", "text": n["n_name"]} for n in nations]))
    plan, c = extract.read_run(spark, root)
    outline = plan.select(F.inline("section_outline")).select("section_id", "title")
    return outline.join(c, "section_id").groupBy("section_id", "title").agg(F.count("*").alias("chunks"))


@query("SELECT 'p' || n_nationkey AS project, trim(n_name) || ' is a place in region number ' || n_regionkey AS label FROM nation WHERE n_nationkey % 3 <> 0")
def written_labels(spark, folder):
    """Labels written for two of three nations, the third being a marker, and read back."""
    root = _folder(spark, "labels")
    n = table(spark, folder, "nation")
    text = F.when(F.col("n_nationkey") % 3 == 0, "TODO").otherwise(F.concat(F.lit("  "), F.trim("n_name"), F.lit(" is  a place\nin region number "), "n_regionkey"))
    sinks.write_labels(n.select(F.concat(F.lit("p"), "n_nationkey").alias("project"), text.alias("label")), "project", "label", root)
    return spark.read.parquet(root).select("project", "label")


@query("SELECT day, n, row_number() OVER (ORDER BY day) AS entry FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)")
def activity_log(spark, folder):
    """A log of each day's events, appended in two goes and read back."""
    root = _folder(spark, "log")
    d = table(spark, folder, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    for even in (0, 1):
        sinks.append_log(spark, root, d.where(F.dayofyear("day") % 2 == even))
    log = spark.read.schema("day timestamp, n long").json(root)
    return log.select(F.col("day").cast("timestamp_ntz").alias("day"), "n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("day")).cast("long").alias("entry"))  # a row a day


@query(f"""WITH v AS (SELECT *, {slug("project")} AS slug FROM {CH} WHERE {ok("embedding")} AND project IS NOT NULL), gone AS (SELECT slug FROM projects WHERE id % 4 = 0),
    u AS (SELECT slug, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM v WHERE slug IN (SELECT slug FROM gone) OR slug NOT IN (SELECT slug FROM projects))
    SELECT slug, pos::INTEGER AS pos, round(avg(x), 6) AS value, 0::BIGINT AS source_count FROM u GROUP BY ALL""")
def healed_projects(spark, folder):
    """Projects that chunks name but the table lacks (every fourth is taken out) come back with the mean of their chunks."""
    p = table(spark, folder, "projects").where("id % 4 != 0")
    m = sinks.missing_projects(chunks(spark, folder).select(project_slug(F.col("project")).alias("project"), "embedding"), p, 64)
    return m.select("slug", F.posexplode("centroid").alias("pos", "v"), "source_count").select("slug", "pos", F.round("v", 6).alias("value"), "source_count")


@query(f"""WITH n AS (SELECT source_id FROM {CH} GROUP BY source_id HAVING source_id % 3 = 0), kept AS (SELECT id FROM {CH} WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM n WHERE source_id IS NOT NULL))
    SELECT 'chunks' AS t, count(*) AS n FROM (SELECT id FROM kept UNION ALL SELECT -id FROM {CH} WHERE source_id % 3 = 0) UNION ALL SELECT 'links', count(*) FROM kept""")
def replaced_sources(spark, folder):
    """Every third source ingested again: its chunks and links go, its new chunks come, all others stay."""
    c = chunks(spark, folder).select("id", "source_id", "content")
    again = c.where("source_id % 3 = 0").withColumn("id", -F.col("id"))
    new, links = sinks.replace_sources(c, c.select(F.col("id").alias("chunk_id")), again)
    return new.select(F.lit("chunks").alias("t")).unionByName(links.select(F.lit("links").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))


@query(f"SELECT {slug('project')} AS slug, count(*) AS n, 'v2' AS version FROM {SRC} GROUP BY 1")
def published_version(spark, folder):
    """Two versions of a table published; readers get the second, and still do after a third that is empty is refused."""
    root = _folder(spark, "published")
    s = sources(spark, folder).groupBy(project_slug(F.col("project")).alias("slug")).agg(F.count("*").alias("n"))
    for v in ("v1", "v2"):
        sinks.publish(s.withColumn("version", F.lit(v)), root, v)
    try:
        sinks.publish(s.withColumn("version", F.lit("v3")).where("slug = 'no such project'"), root, "v3")
    except ValueError:
        pass
    return sinks.current(spark, root)


@query(f"WITH {_INDEX} SELECT doc_id AS source_id, count(*) AS chunks FROM chunk GROUP BY doc_id")
def rebuilt_index(spark, folder):
    """The whole index rebuilt from the documents, checked by a smoke query, and the chunks of each document in it."""
    root = _folder(spark, "index")
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce(project_slug(F.col("project")), F.lit("none")).alias("project"), "text").dropDuplicates(["source_id"])
    sinks.rebuild(d, table(spark, folder, "projects").select("slug"), root, "v1", "the water of the lock")
    return spark.read.parquet(f"{root}/chunks/{sinks.current_version(spark, root)}").groupBy("source_id").agg(F.count("*").alias("chunks"))


@query("SELECT run, round(m, 6) AS ndcg, i = 5 AS last FROM (SELECT event_type AS run, avg(value) / 1000 AS m, row_number() OVER (ORDER BY event_type) AS i FROM events GROUP BY 1)")
def evaluation_log(spark, folder):
    """Runs appended one by one (a kind of event stands for a run), and the newest one beside the questions."""
    root = _folder(spark, "runs")
    m = table(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg("value") / 1000, 6).alias("ndcg")).collect()  # five rows
    for r in sorted(m, key=lambda r: r["event_type"]):
        evaluate.append_run(spark.createDataFrame([(r["ndcg"],)], "ndcg double"), f"{root}/runs", r["event_type"], "{}", f"{root}/last_run")
    newest = spark.read.json(f"{root}/last_run").select("run_ts", F.lit(True).alias("l"))
    return spark.read.parquet(f"{root}/runs").join(F.broadcast(newest), "run_ts", "left").select(F.col("run_ts").alias("run"), "ndcg", F.coalesce("l", F.lit(False)).alias("last"))


@query("""SELECT label, round(avg(a), 6) AS ndcg, round(avg(a) - (SELECT avg((vec_id % 10) / 10) FROM embeddings WHERE label = (SELECT min(label) FROM embeddings)), 6) AS ndcg_delta FROM (SELECT label, (vec_id % 10) / 10 AS a FROM embeddings) GROUP BY label""")
def metric_deltas(spark, folder):
    """What each configuration (a label) loses against the first one."""
    m = table(spark, folder, "embeddings").groupBy("label").agg(F.avg((F.col("vec_id") % 10) / 10).alias("ndcg"))
    base = table(spark, folder, "embeddings").agg(F.min("label").alias("b")).first()["b"]
    return evaluate.deltas(m, "label", base).select("label", F.round("ndcg", 6).alias("ndcg"), "ndcg_delta")


@query("SELECT round(sum(value / 1000), 6) / count(*)::DOUBLE AS ndcg, round(sum(value / 2000), 6) / count(*)::DOUBLE AS mrr, 0.0::DOUBLE AS recall, count(*)::INTEGER AS questions_run FROM region, (SELECT 1 AS value)".replace("round(sum(value / 1000), 6) / count(*)::DOUBLE", "round(sum(r_regionkey / 10) / count(*), 6)").replace("round(sum(value / 2000), 6) / count(*)::DOUBLE", "round(sum(r_regionkey / 20) / count(*), 6)"))
def metric_means(spark, folder):
    """Means over all questions, one of which has no row."""
    m = table(spark, folder, "region").where("r_regionkey > 0").select((F.col("r_regionkey") / 10).alias("ndcg"), (F.col("r_regionkey") / 20).alias("mrr"), F.lit(0.0).alias("recall"))
    return evaluate.summary(m, table(spark, folder, "region").count())


@query("SELECT day, CASE WHEN n < 3 THEN 'no questions' WHEN n % 3 = 0 THEN 'no evaluator' WHEN last > DATE '2024-01-20' THEN 'recent run' END AS reason FROM (SELECT event_type AS day, length(event_type) AS n, max(ts) AS last FROM events WHERE ts < TIMESTAMP '2024-01-22' OR event_type <> 'x' GROUP BY 1)".replace("last > DATE '2024-01-20'", "last > TIMESTAMP '2024-02-05' - INTERVAL 7 DAYS").replace(" WHERE ts < TIMESTAMP '2024-01-22' OR event_type <> 'x'", ""))
def weekly_guards(spark, folder):
    """Whether an evaluation would run for each kind of event, whose last one stands for its last run."""
    e = table(spark, folder, "events")
    some = e.limit(1)
    out = []
    for r in e.groupBy("event_type").agg(F.max("ts").alias("last")).collect():  # five rows
        n = len(r["event_type"])
        runs = spark.createDataFrame([(r["last"],)], "run_ts timestamp_ntz")
        out.append((r["event_type"], evaluate.skip_reason(runs, some if n >= 3 else some.limit(0), "2024-02-05", some, n % 3 != 0)))
    return spark.createDataFrame(out, "day string, reason string")


# routing in full


_STATE = f"v AS {VEC}, c AS (SELECT slug, centroid_embedding::DOUBLE[] AS c FROM projects WHERE archived = 0 AND {ok('centroid_embedding')}), s AS (SELECT v.id, c.slug, {COS}(v.embedding, c.c) AS score FROM v, c)"


def _decided(case: str) -> str:
    return f"""SELECT d.id, '{case}' AS state, CASE WHEN zsc THEN 'file' WHEN n = 1 AND score < 0.85 OR score < 0.7 OR score IS NULL THEN 'create' ELSE 'file' END AS decision, CASE WHEN zsc THEN 'zsc' WHEN n = 1 AND score < 0.85 THEN 'cosine_cold_start' ELSE 'cosine' END AS reason,
        CASE WHEN zsc THEN 'labelled' WHEN n = 1 AND score < 0.85 OR score < 0.7 OR score IS NULL THEN NULL ELSE slug END AS slug"""


@query(f"""WITH {_STATE}, one AS (SELECT min(slug) AS slug FROM c), d AS (SELECT id FROM {CH}),
    a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, slug) AS r FROM s), b AS (SELECT *, 1 AS r FROM s WHERE slug = (SELECT slug FROM one))
    {_decided("all")} FROM (SELECT d.id, a.slug, a.score, 2 AS n, d.id % 3 = 0 AS zsc FROM d LEFT JOIN a ON a.id = d.id AND a.r = 1) d
    UNION ALL {_decided("one")} FROM (SELECT d.id, b.slug, b.score, 1 AS n, false AS zsc FROM d LEFT JOIN b ON b.id = d.id) d
    UNION ALL SELECT id, 'none', 'create', 'first', NULL FROM d UNION ALL SELECT id, 'blank', 'create', 'cosine', NULL FROM d""")
def route_table(spark, folder):
    """Every chunk routed against four states of the projects: all with labels, a single centroid, no project, no centroid."""
    c = chunks(spark, folder).select("id", "embedding")
    p = table(spark, folder, "projects").select("slug", "centroid_embedding", "archived")
    live = p.where((F.col("archived") == 0) & usable(F.col("centroid_embedding")))
    first = live.agg(F.min("slug").alias("slug"))
    k = F.col("id") % 3
    labels = c.select("id", F.explode(F.array(F.struct(F.lit("labelled").alias("label"), F.when(k == 0, 0.9).otherwise(0.69).alias("p")), F.struct(F.lit("other").alias("label"), F.lit(0.5).alias("p")))).alias("x")).select("id", "x.label", "x.p")
    states = {"all": p, "one": live.join(F.broadcast(first), "slug", "left_semi"), "none": p.where("archived = 7"), "blank": p.where("archived = 0").withColumn("centroid_embedding", F.lit(None).cast("array<float>"))}
    out = None
    for name, projects in states.items():
        d = routing.decide(c, "id", "embedding", projects, labels=labels if name == "all" else None).select("id", F.lit(name).alias("state"), "decision", "reason", "slug")
        out = d if out is None else out.unionByName(d)
    return out


_FOLD = "row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS i, count(*) OVER (PARTITION BY {by}) AS n"


@query(f"""WITH {_STATE}, a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, slug) AS r FROM s),
    hit AS (SELECT a.slug, v.embedding AS e, ch.created_ts AS ts, {_FOLD.format(by="a.slug", order="ch.created_ts, v.id")} FROM a JOIN v USING (id) JOIN {CH} ch USING (id) WHERE r = 1 AND score >= 0.7),
    w AS (SELECT slug, unnest(range(64)) AS pos, unnest(e) * 0.1 * pow(0.9, n - i) AS x FROM hit), t AS (SELECT slug, pos, sum(x) AS x FROM w GROUP BY ALL), k AS (SELECT slug, count(*) AS n, max(ts) AS at FROM hit GROUP BY slug)
    SELECT p.slug, coalesce(p.source_count, 0) + coalesce(k.n, 0) AS source_count, greatest(p.last_activity_ts, k.at) AS last_activity_ts,
        CASE WHEN k.n IS NULL THEN NULL ELSE (SELECT round(sum((pos + 1) * (c.c[pos + 1] * pow(0.9, k.n) + t.x)), 2) FROM t WHERE t.slug = p.slug) END AS moved
    FROM projects p LEFT JOIN k USING (slug) LEFT JOIN c USING (slug)""")
def filed_projects(spark, folder):
    """The projects after all chunks were filed: activity, counts, and the centroids that the filed ones moved, in order of time."""
    c = chunks(spark, folder).select("id", "embedding", "created_ts")
    p = table(spark, folder, "projects")
    d = routing.decide(c, "id", "embedding", p.select("slug", "centroid_embedding", "archived"))
    new = routing.filed(p, c, d, "id", "embedding", "created_ts")
    changed = new.join(d.where("decision = 'file'").select("slug").distinct().withColumn("hit", F.lit(True)), "slug", "left")
    total = F.aggregate(F.transform("centroid_embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return changed.select("slug", "source_count", "last_activity_ts", F.when(F.col("hit"), F.round(total, 2)).alias("moved"))


_OVER = f"""o AS (SELECT c.id, {slug("s.project")} AS slug, c.embedding::DOUBLE[] AS e FROM {CH} c JOIN {SRC} s ON c.source_id = s.id WHERE {slug("s.project")} <> {slug("c.project")} AND {ok("c.embedding")}),
    f AS (SELECT o.slug, o.e, {_FOLD.format(by="o.slug", order="o.id")}, p.c FROM o JOIN (SELECT slug, CASE WHEN {ok("centroid_embedding")} THEN centroid_embedding::DOUBLE[] END AS c FROM projects) p USING (slug)),
    w AS (SELECT slug, c, n, unnest(range(64)) AS pos, unnest(e) * CASE WHEN i = 1 AND c IS NULL THEN pow(0.8, n - 1) ELSE 0.2 * pow(0.8, n - i) END AS x FROM f)"""


def _overrides(spark, folder):
    c, s = chunks(spark, folder), sources(spark, folder)
    o = c.join(s.select(F.col("id").alias("source_id"), project_slug(F.col("project")).alias("slug")), "source_id").withColumn("original", project_slug(F.col("project"))).where("slug != original")
    p = table(spark, folder, "projects").select("slug", "centroid_embedding")
    return routing.apply_overrides(p, o.select("id", "source_id", "original", "slug", "embedding").where(usable(F.col("embedding"))), "embedding", ["id"])


@query(f"WITH {_OVER} SELECT slug, pos::INTEGER AS pos, round(sum(x) + coalesce(any_value(c)[pos + 1] * pow(0.8, any_value(n)), 0) + 3e-8, 6) AS value FROM w GROUP BY slug, pos")
def override_blend(spark, folder):
    """Chunks filed elsewhere than their source correct that project's centroid, every one of them by 0.2, in order of id."""
    new, log = _overrides(spark, folder)
    hit = log.select(F.col("corrected_project").alias("slug")).distinct()
    return new.join(hit, "slug", "left_semi").select("slug", F.posexplode("centroid_embedding").alias("pos", "v")).select("slug", "pos", F.round(F.col("v") + 3e-8, 6).alias("value"))


@query(f"SELECT s.id AS source_id, {slug('c.project')} AS original_project, {slug('s.project')} AS corrected_project, c.id AS override_id FROM {CH} c JOIN {SRC} s ON c.source_id = s.id WHERE {slug('s.project')} <> {slug('c.project')} AND {ok('c.embedding')}")
def override_log(spark, folder):
    return _overrides(spark, folder)[1]


@query(rf"""WITH t AS (SELECT DISTINCT doc_id, title FROM documents WHERE title IS NOT NULL), u AS (SELECT doc_id, title, CASE WHEN s = '' THEN 'project' ELSE regexp_replace(substr(s, 1, 50), '-+$', '') END AS s FROM (SELECT doc_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM t)),
    r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) + CASE WHEN s IN (SELECT slug FROM projects) THEN 1 ELSE 0 END AS n FROM u)
    SELECT title AS name, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug, 'TODO' AS label, 0::BIGINT AS source_count, 0 AS archived FROM r""")
def created_projects(spark, folder):
    """A project for every titled document: slugs that are taken go on with -2, -3; the label says that it has yet to be written."""
    d = table(spark, folder, "documents").where("title is not null").select("doc_id", "title").distinct().withColumn("v", F.array(F.lit(1.0))).withColumn("at", F.lit(0))
    made = routing.created(d.select("doc_id", F.lit("create").alias("decision")), d, table(spark, folder, "projects"), "doc_id", "title", "v", "at")
    return made.select("name", "slug", "label", "source_count", "archived")


@query(f"SELECT slug FROM projects WHERE id % 4 <> 0 AND id % 4 <> 1")
def labelled_projects(spark, folder):
    """Projects whose label is filled; every fourth is empty, every fourth a marker."""
    k = F.col("id") % 4
    p = table(spark, folder, "projects").withColumn("label", F.when(k == 0, F.when(F.col("id") % 8 == 0, " ")).when(k == 1, " todo: write").otherwise(F.col("name")))
    return routing.labelled(p, "label").select("slug")


@query("""WITH RECURSIVE e AS (SELECT event_type AS lane, user_id, event_id AS id, [1.0, (event_id % 7) / 3.0, (event_id % 5) / 4.0]::DOUBLE[] AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE event_id < 0)
    SELECT event_type AS lane, event_id AS id, CASE WHEN event_id = m THEN 'create' ELSE 'file' END AS decision, CASE WHEN event_id = m THEN 'first' ELSE 'cosine' END AS reason, 0::INTEGER AS project
    FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS m FROM events)""".replace("""WITH RECURSIVE e AS (SELECT event_type AS lane, user_id, event_id AS id, [1.0, (event_id % 7) / 3.0, (event_id % 5) / 4.0]::DOUBLE[] AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE event_id < 0)
    """, ""))
def stream_routing(spark, folder):
    """Events routed one at a time, a lane a kind: the first makes a project, and all others, being near it, are filed and move it."""
    from tarnwell.streaming import jobs

    cfg = RetrievalConfig()
    e = jobs.read_table_stream(spark, folder, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("id"), F.array(F.lit(1.0), (F.col("event_id") % 7) / 30, (F.col("event_id") % 5) / 40).alias("vec"))
    return jobs.drained(jobs.route_stream(e, ["id"], 3, cfg.split_below, cfg.cold_start, cfg.ema_route), "routing").select("lane", "id", "decision", "reason", "project")


# the graph store


_FOUND = f"""c AS (SELECT id, {slug("project")} AS project, regexp_extract_all(content, '\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{2,}}') AS w FROM {CH} WHERE content IS NOT NULL),
    n AS (SELECT id, project, i AS ord, w[i] AS name, lower(w[i]) AS n, (['PERSON', 'ORGANIZATION', 'THING', 'PAPER'])[1 + length(w[i]) % 4] AS type FROM (SELECT id, project, w, unnest(range(1, len(w) + 1)) AS i FROM c)),
    k AS (SELECT * FROM n WHERE type <> 'THING')"""


def _extracted(spark, folder):
    """Capitalised words as entities whose type follows their length, and a relation from each to the next; every third verb is empty."""
    words = F.regexp_extract_all("content", F.lit(r"\p{Lu}[\p{L}\p{N}]{2,}"), 0)
    kind = F.array(*[F.lit(x) for x in ("person", " ORGANIZATION ", "THING", "Paper")])
    c = chunks(spark, folder).where("content is not null").select("id", project_slug(F.col("project")).alias("project"), words.alias("w"))
    ent = F.transform("w", lambda x: F.struct(x.alias("name"), F.element_at(kind, F.char_length(x) % 4 + 1).alias("type"), F.lit(None).cast("string").alias("description")))
    rel = F.expr("transform(slice(w, 2, greatest(size(w) - 1, 0)), (x, i) -> named_struct('source', element_at(w, i + 1), 'target', concat(' ', x, '  '), 'verb', if(i % 3 = 2, ' ', 'Meets')))")
    return graph.store(c.select("id", "project", ent.alias("entities"), rel.alias("relations")), "id")


@query(f"WITH {_FOUND} SELECT project, type, n AS normalized_name, arg_min(name, {{'a': id, 'b': ord}}) AS name FROM k GROUP BY ALL")
def stored_entities(spark, folder):
    """Entities of the four types by project, type and name, as their first chunk spells them."""
    return _extracted(spark, folder)[0].select("project", "type", "normalized_name", "name")


@query(f"WITH {_FOUND} SELECT DISTINCT id, type, n AS normalized_name FROM k")
def stored_links(spark, folder):
    return _extracted(spark, folder)[1].select("id", "type", "normalized_name")


@query(f"WITH {_FOUND} SELECT a.project, a.n AS source, b.n AS target, 'meets' AS relationship, count(*)::DOUBLE AS weight FROM n a JOIN n b ON a.id = b.id AND b.ord = a.ord + 1 WHERE a.type <> 'THING' AND b.type <> 'THING' AND (a.ord - 1) % 3 <> 2 GROUP BY ALL")
def stored_relations(spark, folder):
    """Relations with a verb whose ends are both entities of their chunk, with how often they are found."""
    return _extracted(spark, folder)[2].select("project", "source", "target", "relationship", "weight")


@query(f"WITH c AS (SELECT id, content, CASE WHEN id % 5 = 0 THEN [] WHEN id % 2 = 0 THEN ['Tag'] ELSE list_distinct(regexp_extract_all(content, '\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{2,}}')) END AS e FROM {CH} WHERE content IS NOT NULL) SELECT id, len(CASE WHEN id % 5 = 0 THEN list_distinct(regexp_extract_all(content, '\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{2,}}')) ELSE e END)::INTEGER AS n FROM c")
def extraction_cascade(spark, folder):
    """Entities of each chunk by the first extractor that finds any: one that fails, one that only knows some, the default."""
    shape = lambda a: F.transform(a, lambda x: F.struct(x.alias("name"), F.lit("PERSON").alias("type"), F.lit(None).cast("string").alias("description")))
    fails = lambda c: F.lit(None).cast("array<struct<name: string, type: string, description: string>>")
    some = lambda c: shape(F.when(c.startswith("2:"), F.array(F.lit("Tag"))).otherwise(F.array().cast("array<string>")))
    mark = F.when((F.col("id") % 5 != 0) & (F.col("id") % 2 == 0), F.concat(F.lit("2:"), "content")).otherwise(F.col("content"))
    c = chunks(spark, folder).where("content is not null").select("id", mark.alias("t"))
    return graph.cascade(c, "t", fails, some, lambda c: shape(graph.capitalised(c))).select("id", F.size("entities").alias("n"))


# ranking and names


@query("SELECT doc_id, round(n_chars / 60000, 6) >= 0.92 AS skip FROM (SELECT DISTINCT doc_id, n_chars FROM documents) WHERE n_chars IS NOT NULL")
def skip_flag(spark, folder):
    """Whether a score (the length in 60,000ths) is high enough to leave the rerank out."""
    d = table(spark, folder, "documents").where("n_chars is not null").select("doc_id", "n_chars").distinct()
    return d.select("doc_id", fusion.should_skip(F.round(F.col("n_chars") / 60000, 6)).alias("skip"))


@query(r"""WITH t AS (SELECT DISTINCT doc_id, title FROM documents WHERE title IS NOT NULL), u AS (SELECT doc_id, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '^[\s\-_.,;:!?]+|[\s\-_.,;:!?]+$', '', 'g') AS c FROM t),
    v AS (SELECT *, CASE WHEN length(c) <= 60 THEN c ELSE coalesce(nullif(regexp_extract(substr(c, 1, 60), '^(.+) [^ ]*$', 1), ''), substr(c, 1, 60)) END AS h FROM u), w AS (SELECT *, regexp_split_to_array(lower(h), '\s+') AS a FROM v)
    SELECT doc_id, CASE WHEN h = '' THEN 'Research' ELSE array_to_string(list_transform(a, lambda x, i: CASE WHEN i > 1 AND x IN ('a', 'an', 'the', 'and', 'or', 'but', 'of', 'in', 'on', 'at', 'to', 'for', 'from', 'with', 'by', 'as', 'is', 'vs') THEN x ELSE upper(x[1:1]) || x[2:] END), ' ') END || ' - 2025-01-01.md' AS file_name,
        substr(trim(regexp_replace(regexp_replace(regexp_replace(trim(title), '^[''"`*]+|[''"`*]+$', '', 'g'), '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')), 1, 60) AS folder FROM w""")
def dated_file_names(spark, folder):
    """Title-case file names with a date, and folder names, of the documents' titles."""
    d = table(spark, folder, "documents").where("title is not null").select("doc_id", "title").distinct()
    return d.select("doc_id", dated_title(F.col("title"), "2025-01-01").alias("file_name"), folder_name(F.col("title")).alias("folder"))


# lint: the sources as pages, each of which links to the one after the next, every fifth also to itself


_NOTE = f"n AS (SELECT 'p' || id AS name, id, ingest_ts, {slug('project')} AS topic FROM {SRC}), l AS (SELECT name AS s, 'p' || (id + 2) AS t FROM n WHERE id % 4 <> 0 UNION SELECT name, name FROM n WHERE id % 5 = 0)"


def _notes(spark, folder):
    s = sources(spark, folder)
    nxt = F.when(F.col("id") % 4 != 0, F.concat(F.lit("see [[p"), F.col("id") + 2, F.lit("|the next]] and [[ p"), F.col("id") + 2, F.lit("#part]]")))
    own = F.when(F.col("id") % 5 == 0, F.concat(F.lit("[[p"), "id", F.lit("]]")))
    return s.select(F.concat(F.lit("p"), "id").alias("name"), F.coalesce(F.concat_ws(" ", nxt, own), F.lit("")).alias("text"), "ingest_ts", project_slug(F.col("project")).alias("topic"), "id")


@query(f"WITH {_NOTE} SELECT name, ingest_ts >= TIMESTAMP '2024-12-25' AS soft FROM n WHERE name NOT IN (SELECT t FROM l WHERE s <> t)")
def orphan_pages(spark, folder):
    """Pages that no other page links to."""
    return governance.orphans(_notes(spark, folder), "name", "text", "ingest_ts", F.to_timestamp_ntz(F.lit("2025-01-01")))


@query(f"WITH {_NOTE} SELECT name, ingest_ts, (SELECT count(*) FROM l WHERE s = name) AS outlinks, (SELECT count(*) FROM l WHERE t = name) AS inlinks FROM n")
def page_catalogue(spark, folder):
    return governance.catalogue(_notes(spark, folder), "name", "text", "ingest_ts")


@query(f"WITH {_NOTE}, x AS (SELECT name AS older, lead(name) OVER (PARTITION BY topic ORDER BY ingest_ts NULLS FIRST, name) AS newer, count(*) OVER (PARTITION BY topic) AS n FROM n) SELECT older, newer FROM x WHERE newer IS NOT NULL AND n >= 10")
def stale_pages(spark, folder):
    """Pages of one topic with the next newer one, where the topic has ten and more."""
    return governance.stale(_notes(spark, folder), "topic", "name", "ingest_ts")


@query(f"WITH {_NOTE} SELECT name FROM n ORDER BY ingest_ts DESC NULLS LAST, name LIMIT 200")
def newest_pages(spark, folder):
    """The 200 newest pages, which a lint of a large collection looks at (the limit is the feature)."""
    return governance.newest(_notes(spark, folder), "name", "ingest_ts").select("name")


@query(f"SELECT id, lower(trim(type)) AS tag FROM {ENT} WHERE lower(trim(type)) IN ('person', 'paper', 'concept', 'organization')")
def tagged_pages(spark, folder):
    """Entity pages by their tag, written with a # before every other one."""
    t = F.array(F.when(F.col("id") % 2 == 0, F.concat(F.lit("#"), F.trim("type"))).otherwise(F.trim("type")), F.lit("other"))
    return governance.tagged(entities(spark, folder).where("type is not null").select("id", t.alias("tags")), "id", "tags").select("id", F.col("tags")[0].alias("tag"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 OR id % 7 = 0 THEN 'label missing' WHEN id % 2 = 0 THEN NULL ELSE 'no source_type' END AS reason FROM {SRC}")
def preflight_gates(spark, folder):
    """Sources with labels missing or unwritten, and with and without a source_type in their front matter."""
    k = F.col("id")
    d = sources(spark, folder).select("id", F.when(k % 3 == 0, " ").when(k % 7 == 0, "todo: label").otherwise("a label").alias("label"), F.when(k % 2 == 0, "---\ntitle: x\nsource_type: article\n---").otherwise("no source_type: here").alias("text"))
    return governance.gates(d, "label", "text").select("id", "reason")


# streams with handlers


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def stream_handlers(spark, folder):
    """Two kinds of events, each with its own sink."""
    from tarnwell.streaming import jobs

    root = _folder(spark, "handlers")
    put = lambda kind: lambda df, epoch: df.write.mode("overwrite").parquet(f"{root}/{kind}/{epoch}")
    for q in jobs.handlers(jobs.read_table_stream(spark, folder, "events"), "event_type", {k: put(k) for k in ("click", "view")}, f"{root}/state"):
        q.awaitTermination()
    out = [spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{k}").groupBy("event_type").agg(F.count("*").alias("n")) for k in ("click", "view")]
    return out[0].unionByName(out[1])


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_mirror(spark, folder):
    """Every session (a kind of event) mirrored into its own folder."""
    from tarnwell.streaming import jobs

    root = _folder(spark, "mirror")
    jobs.mirror(jobs.read_table_stream(spark, folder, "events"), "event_type", f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query(r"""SELECT user_id, ts, chr(10) || '---' || chr(10) || chr(10) || '## [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] PRE-COMPACT CHECKPOINT | session=' || user_id || chr(10) AS value FROM events WHERE event_type = 'error'""")
def checkpoint_markers(spark, folder):
    """The marker that each user's memory gets at a compaction (an error event stands for one), appended and read back."""
    from tarnwell.streaming import transcripts

    root = _folder(spark, "markers")
    e = table(spark, folder, "events").withColumn("kind", F.when(F.col("event_type") == "error", "compact").otherwise("other"))
    transcripts.checkpoints(e, "kind", "user_id", "ts").write.mode("append").parquet(root)
    return spark.read.parquet(root)


@query(f"""WITH p AS {PG}, m AS (SELECT file_name, row_id, CASE WHEN row_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text, row_number() OVER (PARTITION BY file_name ORDER BY row_id DESC) AS r FROM p WHERE text IS NOT NULL)
    SELECT file_name AS session, role, md5(arg_max(CASE WHEN role = 'user' THEN text ELSE text || chr(10) || 'end' END, row_id)) AS body FROM m WHERE r <= 200 AND row_id % 6 <> 0 GROUP BY ALL""")
def last_turns(spark, folder):
    """The last turn of each role in transcripts made of the pages: users write text, assistants blocks; every sixth line is broken."""
    from tarnwell.streaming import transcripts

    p = pages(spark, folder).where("text is not null")
    blocks = F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text"))).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    line = F.when(F.col("row_id") % 6 == 0, "{broken").when(F.col("row_id") % 2 == 0, plain).otherwise(blocks)
    m = transcripts.messages(p.select(F.col("file_name").alias("session"), F.col("row_id").alias("line_no"), line.alias("value")))
    return transcripts.last_turns(m).select("session", "role", F.md5("text").alias("body"))
