"""Queries that run the whole search, many questions at once, and their SQL with the same switches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.config import RetrievalConfig
from tarnwell.functions.text import usable
from tarnwell.operators import evaluate
from tarnwell.plans.chunkers import count_words, sentences, trimmed
from tarnwell.plans.common import CH, SRC, VEC, chunks, sources, words
from tarnwell.plans.registry import query
from tarnwell.plans.retrieval import _hashed
from tarnwell.session import written
from tarnwell.sources.tables import project_slug

_BASE = f"""c AS (SELECT id, content, source_id, {words("content")} AS w FROM {CH}), v AS {VEC}, pw AS (SELECT id, unnest(w) AS term FROM c), post AS (SELECT id, term, count(*) AS tf FROM pw GROUP BY ALL),
    st AS (SELECT count(*) AS total, avg(len(w)) AS avgdl FROM c WHERE content IS NOT NULL), lk AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(content, '\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{2,}}'))) AS name FROM c)"""


def statement(x: str, decomposition=True, vector=True, bm25=True, graph=True, rrf=True, reranker=True) -> str:
    """CTEs from ``q0`` (query_id, text) to ``out<x>`` (query_id, id, rank, rrf_score, rerank_score), each name with the suffix ``x``."""
    parts = f"""(SELECT query_id, CASE WHEN len(a) > 1 AND list_min(list_transform(a, lambda y: {count_words("y")})) >= 3 THEN a ELSE [q] END AS a FROM (
        SELECT query_id, q, CASE WHEN len(a) < 2 AND {count_words("q")} >= 15 THEN list_filter(list_transform(regexp_split_to_array(q, '\\b(?:and|or|but)\\b'), lambda y: trim(y, ' ,;')), lambda y: y <> '') ELSE a END AS a FROM (
        SELECT query_id, q, list_filter(list_transform({sentences("q")}, lambda y: {trimmed("y")}), lambda y: y <> '') AS a FROM (SELECT query_id, {trimmed("text")} AS q FROM q0 WHERE text IS NOT NULL))))"""
    subs = f"SELECT query_id * 100 + i - 1 AS k, query_id, i - 1 AS sub, a[i] AS text FROM (SELECT query_id, a, unnest(range(1, len(a) + 1)) AS i FROM {parts})" if decomposition else "SELECT query_id * 100 AS k, query_id, 0 AS sub, text FROM q0 WHERE text IS NOT NULL"
    lists = []
    if vector:
        lists.append(f"SELECT k, id, 0 AS l, 0.4 AS w, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS rank FROM (SELECT k, v.id, round(coalesce(CASE WHEN list_max(list_transform(vec, lambda y: abs(y))) = 0 THEN 0 ELSE list_cosine_similarity(vec, v.embedding) END, 0), 6) AS s FROM hv{x}, v) QUALIFY rank <= 40")
    if bm25:
        lists.append(f"SELECT k, id, 1 AS l, 0.6 AS w, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS rank FROM bm{x} QUALIFY rank <= 40")
    if graph:
        lists.append(f"SELECT k, id, 2 AS l, 0.35 AS w, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS rank FROM gr{x} QUALIFY rank <= 20")
    fused = f"SELECT k, id, round(sum(w / (60 + rank)), 12) AS s FROM ls{x} GROUP BY k, id" if rrf else f"SELECT k, id, -rank::DOUBLE AS s FROM (SELECT *, min(l) OVER (PARTITION BY k) AS m FROM ls{x}) WHERE l = m"
    skip = "max(rrf_score) OVER (PARTITION BY query_id) >= 0.03 AND count(*) OVER (PARTITION BY query_id) <= 3" if rrf else "false"
    score = f"CASE WHEN {skip} THEN NULL ELSE round(coalesce(1 / (1 + exp(-8 * (len(list_intersect(qw, w)) / nullif(len(qw), 0) - 0.5))), 0), 6) END" if reranker else "NULL::DOUBLE"
    return f"""sb{x} AS ({subs}), hv{x} AS {_hashed("k", f"sb{x}", "text")},
    tm{x} AS (SELECT DISTINCT k, unnest({words("text")}) AS term FROM sb{x}), tf{x} AS (SELECT k, term, id, tf, count(*) OVER (PARTITION BY k, term) AS n FROM tm{x} JOIN post USING (term)),
    bm{x} AS (SELECT k, tf.id, round(sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS s FROM tf{x} tf JOIN c ON c.id = tf.id, st GROUP BY k, tf.id),
    nm{x} AS (SELECT DISTINCT k, lower(unnest(regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{2,}}'))) AS name FROM sb{x}), ne{x} AS (SELECT k, name, greatest(5, 20 // count(*) OVER (PARTITION BY k)) AS each FROM nm{x}),
    gr{x} AS (SELECT k, id, count(*) AS s FROM (SELECT k, id, each, row_number() OVER (PARTITION BY k, name ORDER BY id) AS p FROM ne{x} JOIN lk USING (name)) WHERE p <= each GROUP BY k, id),
    ls{x} AS ({" UNION ALL ".join(lists)}), fu{x} AS ({fused}),
    tp{x} AS (SELECT query_id, sub, id, s, row_number() OVER (PARTITION BY f.k ORDER BY s DESC, id) AS r, max(sub) OVER (PARTITION BY query_id) > 0 AS many FROM fu{x} f JOIN sb{x} b ON f.k = b.k QUALIFY r <= 40),
    mg{x} AS (SELECT query_id, id, round(sum(CASE WHEN many THEN 1.0 / (60 + r) ELSE s END), 9) AS rrf_score FROM tp{x} GROUP BY query_id, id),
    rk{x} AS (SELECT query_id, id, rrf_score, {score} AS rerank_score FROM mg{x} JOIN c USING (id) JOIN (SELECT query_id, list_distinct({words("text")}) AS qw FROM q0) USING (query_id)),
    out{x} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rrf_score DESC, id)::INTEGER AS rank, rrf_score, rerank_score FROM rk{x} QUALIFY rank <= 10)"""


def _store(spark, folder):
    from tarnwell.search import Store

    c = chunks(spark, folder).select("id", project_slug(F.col("project")).alias("project"), "source_id", "chunk_index", "content", "token_count", F.when(usable(F.col("embedding")), F.col("embedding")).alias("embedding"))
    return Store(written(c, "chunks"))


_TITLES = f"q0 AS (SELECT id AS query_id, title AS text FROM {SRC} WHERE id % 50 = 0)"


@query(f"WITH {_BASE}, {_TITLES}, {statement('')} SELECT query_id, id, rank, round(rrf_score, 6) AS rrf_score, rerank_score FROM out")
def batched_search(spark, folder):
    """The titles of every fiftieth source as queries, all searched at once over all chunks."""
    from tarnwell.search import search

    q = sources(spark, folder).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    return search(q, _store(spark, folder)).select("query_id", "id", "rank", F.round("rrf_score", 6).alias("rrf_score"), "rerank_score")


_OFF = {"full": {}} | {f"no_{p}": {p: False} for p in ("vector", "bm25", "rrf", "decomposition", "reranker", "graph")}
_ASKED = f"q0 AS (SELECT s.id AS query_id, s.title || ' and what was written of it in the years after the repair of the gate, or ' || coalesce(n.title, 'of the Canal') AS text FROM {SRC} s LEFT JOIN {SRC} n ON n.id = s.id + 1 WHERE s.id % 50 = 0 AND s.title IS NOT NULL)"
_METRICS = "x AS (SELECT query_id, count(c.id) AS n FROM q0 JOIN c ON c.source_id = query_id GROUP BY query_id), " + ", ".join(
    f"m{i} AS (SELECT '{name}' AS run, round(coalesce(sum(dcg / idcg), 0) / (SELECT greatest(count(*), 1) FROM q0), 6) AS ndcg, round(coalesce(sum(mrr), 0) / (SELECT greatest(count(*), 1) FROM q0), 6) AS mrr, round(coalesce(sum(hit / n), 0) / (SELECT greatest(count(*), 1) FROM q0), 6) AS recall FROM ("
    f"SELECT x.query_id, n, (SELECT sum(1 / log2(j + 1)) FROM range(1, 11) r(j) WHERE j <= x.n) AS idcg, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE ok), 0) AS dcg, coalesce(max(1.0 / rank) FILTER (WHERE ok), 0) AS mrr, count(*) FILTER (WHERE ok AND rank <= 5) AS hit "
    f"FROM x LEFT JOIN (SELECT o.query_id, o.rank, c.source_id = o.query_id AS ok FROM out{i} o JOIN c ON c.id = o.id) k USING (query_id) GROUP BY x.query_id, n))"
    for i, name in enumerate(_OFF)
)


@query(f"WITH {_BASE}, {_ASKED}, {', '.join(statement(str(i), **off) for i, off in enumerate(_OFF.values()))}, {_METRICS}, every AS ({' UNION ALL '.join(f'SELECT * FROM m{i}' for i in range(len(_OFF)))})"
       " SELECT e.run, e.ndcg, e.mrr, e.recall, round(e.ndcg - f.ndcg, 6) AS ndcg_delta, round(e.mrr - f.mrr, 6) AS mrr_delta, round(e.recall - f.recall, 6) AS recall_delta FROM every e, (SELECT * FROM every WHERE run = 'full') f")  # fmt: skip
def ablation(spark, folder):
    """Each component of the search switched off in turn: the metrics over long questions, and what they lose; a source's own chunks are expected."""
    from tarnwell.search import searches

    s = sources(spark, folder).select("id", "title")
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("title").alias("t"))
    q = s.where("id % 50 = 0 and title is not null").join(nxt, "id", "left").select(F.col("id").alias("query_id"), F.concat("title", F.lit(" and what was written of it in the years after the repair of the gate, or "), F.coalesce("t", F.lit("of the Canal"))).alias("text"))
    q = written(q, "questions")
    store, n = _store(spark, folder), q.count()
    expected = store.chunks.select(F.col("source_id").alias("query_id"), F.col("id").alias("item")).join(q.select("query_id"), "query_id", "left_semi")
    names = list(RetrievalConfig().ablations())
    at = F.struct("run", "query_id")  # a question of a run counts as a query of its own
    found = searches(q, store, RetrievalConfig().ablations()).select(at.alias("query_id"), F.col("id").alias("item"), "rank")
    runs = spark.createDataFrame([(x,) for x in names], "run string")
    m = evaluate.metrics(found, expected.crossJoin(F.broadcast(runs)).select(at.alias("query_id"), "item"))
    return evaluate.deltas(written(runs.join(evaluate.summaries(m, n, F.col("query_id.run"), "run"), "run", "left").na.fill(0.0), "runs"))
