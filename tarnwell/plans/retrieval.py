"""Queries on vectors, routing, keyword search, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.config import RetrievalConfig
from tarnwell.functions.text import cosine, normal, tokens, usable
from tarnwell.operators import evaluate, fulltext, fusion, vector
from tarnwell.plans.common import CEN, CH, SRC, VEC, chunks, ok, slug, sources, vectors, words
from tarnwell.plans.registry import query
from tarnwell.session import written
from tarnwell.sources.tables import project_slug, table

QUESTION = "why was the lock gate repaired before winter"
PHRASE = "as the members had asked"
COS = "list_cosine_similarity"


@query(f"""SELECT vec_id, round({COS}(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
    FROM embeddings ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk(spark, folder):
    e = table(spark, folder, "embeddings")
    return vector.topk(e, "vec_id", "embedding", e.where("vec_id = 0"), "embedding", 10)


@query(f"""WITH v AS {VEC}, q AS (SELECT * FROM v ORDER BY id LIMIT 1)
    SELECT v.id, round({COS}(v.embedding, q.embedding), 6) AS score FROM v, q WHERE v.slug = q.slug ORDER BY score DESC, v.id LIMIT 10""")
def vector_topk_by_project(spark, folder):
    v = vectors(spark, folder)
    q = v.orderBy("id").limit(1).select("slug", F.col("embedding").alias("q"))
    own = v.join(F.broadcast(q), "slug")
    return own.select("id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, round({COS}(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE vec_id <> query_id)
    SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
    QUALIFY rank <= 10""")
def vector_self_knn(spark, folder):
    e = table(spark, folder, "embeddings")
    return vector.exact_knn(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query(f"""WITH v AS {VEC}, u AS (SELECT slug, unnest(range(64)) AS pos, unnest(embedding) AS x FROM v)
    SELECT slug, pos::INTEGER AS pos, round(avg(x), 6) AS value, count(*) AS n FROM u GROUP BY ALL""")
def centroid_by_project(spark, folder):
    c = vector.centroids(vectors(spark, folder), "slug", "embedding")
    return c.select("slug", "n", F.posexplode("centroid").alias("pos", "v")).select("slug", "pos", F.round("v", 6).alias("value"), "n")


@query(f"""WITH v AS {VEC}, u AS (SELECT slug, unnest(range(64)) AS pos, unnest(embedding) AS x FROM v),
    c AS (SELECT slug, list(a ORDER BY pos) AS m FROM (SELECT slug, pos, avg(x) AS a FROM u GROUP BY ALL) GROUP BY slug)
    SELECT p.slug, round({COS}(p.c, c.m), 5) AS score FROM {CEN} p JOIN c USING (slug)""")
def centroid_drift(spark, folder):
    """How far the stored centroids are from the rebuilt ones."""
    p = table(spark, folder, "projects").where(usable(F.col("centroid_embedding"))).select("slug", F.col("centroid_embedding").alias("c"))
    return p.join(vector.centroids(vectors(spark, folder), "slug", "embedding"), "slug").select("slug", F.round(cosine(F.col("c"), F.col("centroid")), 5).alias("score"))


@query(f"""WITH c AS {CEN} SELECT a.slug AS a, b.slug AS b, round({COS}(a.c, b.c), 6) AS score FROM c a, c b WHERE a.slug < b.slug""")
def centroid_similarity_matrix(spark, folder):
    p = table(spark, folder, "projects").where(usable(F.col("centroid_embedding"))).select("slug", "centroid_embedding")
    s = vector.scores(p.withColumnRenamed("slug", "a"), "a", "centroid_embedding", p.withColumnRenamed("slug", "b").withColumnRenamed("centroid_embedding", "c"), "b", "c")
    return s.where("a < b").select("a", "b", F.round("score", 6).alias("score"))


def _scored(spark, folder):
    p = table(spark, folder, "projects").where((F.col("archived") == 0) & usable(F.col("centroid_embedding"))).select("slug", "centroid_embedding")
    return vector.scores(vectors(spark, folder).select("id", "embedding"), "id", "embedding", p, "slug", "centroid_embedding")


SCORED = f"""v AS {VEC}, c AS (SELECT slug, centroid_embedding::DOUBLE[] AS c FROM projects WHERE archived = 0 AND {ok("centroid_embedding")}),
    s AS (SELECT v.id, c.slug, {COS}(v.embedding, c.c) AS score FROM v, c),
    r AS (SELECT id, slug, score, row_number() OVER w AS k, lead(score) OVER w AS second, count(*) OVER (PARTITION BY id) AS n FROM s
        WINDOW w AS (PARTITION BY id ORDER BY round(score, 9) DESC, slug))"""


@query(f"WITH {SCORED} SELECT id, slug, round(score, 6) AS score FROM r WHERE k = 1")
def nearest_centroid(spark, folder):
    return vector.nearest(_scored(spark, folder), "id", "slug").select("id", "slug", F.round("score", 6).alias("score"))


@query(f"""WITH {SCORED} SELECT id, CASE WHEN n = 1 AND score < 0.85 THEN 'cosine_cold_start' WHEN score < 0.70 THEN 'cosine' ELSE 'cosine' END AS reason,
    CASE WHEN (n = 1 AND score < 0.85) OR score < 0.70 THEN 'create' ELSE 'file' END AS decision,
    CASE WHEN (n = 1 AND score < 0.85) OR score < 0.70 THEN NULL ELSE slug END AS slug FROM r WHERE k = 1""")
def route_decision(spark, folder):
    cfg = RetrievalConfig()
    n = vector.nearest(_scored(spark, folder), "id", "slug")
    cold = (F.col("n") == 1) & (F.col("score") < cfg.cold_start)
    create = cold | (F.col("score") < cfg.split_below)
    return n.select("id", F.when(cold, "cosine_cold_start").otherwise("cosine").alias("reason"), F.when(create, "create").otherwise("file").alias("decision"), F.when(~create, F.col("slug")).alias("slug"))


@query(f"WITH {SCORED} SELECT id, round(score, 6) AS top, round(score - second, 6) AS margin, score >= 0.70 AND score - second >= 0.15 AS passes FROM r WHERE k = 1")
def margin_gate(spark, folder):
    cfg = RetrievalConfig()
    n = vector.nearest(_scored(spark, folder), "id", "slug")
    margin = F.col("score") - F.col("second")
    return n.select("id", F.round("score", 6).alias("top"), F.round(margin, 6).alias("margin"), ((F.col("score") >= cfg.gate_threshold) & (margin >= cfg.gate_margin)).alias("passes"))


@query(f"WITH {SCORED} SELECT id, slug, round(exp(score - max(score) OVER p) / sum(exp(score - m)) OVER p, 6) AS p FROM (SELECT *, max(score) OVER (PARTITION BY id) AS m FROM s) WINDOW p AS (PARTITION BY id)")
def softmax_scores(spark, folder):
    return vector.softmax(_scored(spark, folder), "id", "score").select("id", "slug", F.round("p", 6).alias("p"))


@query("""WITH e AS (SELECT label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    u AS (SELECT label, unnest(range(64)) AS pos, unnest(e) AS x, CASE WHEN i = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - i) END AS w FROM e)
    SELECT label, pos::INTEGER AS pos, round(sum(w * x), 6) AS value FROM u GROUP BY ALL""")
def ema_centroid(spark, folder):
    c = vector.moving_centroids(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", RetrievalConfig().ema_route)
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("value"))


@query("SELECT slug, coalesce(len(centroid_embedding), -1)::INTEGER AS dim FROM projects WHERE archived = 0")
def active_projects(spark, folder):
    """Projects that take documents; a missing centroid stays missing."""
    return table(spark, folder, "projects").where("archived = 0").select("slug", F.when(F.col("centroid_embedding").isNull(), -1).otherwise(F.size("centroid_embedding")).alias("dim"))


@query(f"SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i])), 5) AS total, 256::INTEGER AS bytes FROM {VEC}")
def vector_codec(spark, folder):
    """Vectors to float32 blobs and back: a sum over the parts of what came back, and the length of the blob."""
    blob = vector.to_blob(vectors(spark, folder).select("id", F.transform("embedding", lambda x: x.cast("float")).alias("embedding")), "embedding", 64)
    back = vector.from_blob(blob.withColumn("b", F.octet_length("embedding")), "embedding", 64)
    return back.select("id", F.round(F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.col("b").alias("bytes"))


def _hashed(key: str, rel: str, text: str) -> str:
    """(key, vec): the hash encoder's vectors of a relation's texts, written with unnested words."""
    return f"""(SELECT {key}, list_transform(v, lambda x: (x / CASE WHEN n = 0 THEN 1 ELSE n END)::FLOAT::DOUBLE) AS vec FROM (SELECT {key}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
        SELECT {key}, list(coalesce(s, 0)::DOUBLE ORDER BY pos) AS v FROM (SELECT k.{key}, pos, s FROM (SELECT DISTINCT {key} FROM {rel} WHERE {text} IS NOT NULL) k CROSS JOIN range(64) r(pos) LEFT JOIN (
            SELECT {key}, h % 64 AS pos, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS s FROM (SELECT {key}, ('0x' || left(md5(w), 8))::BIGINT AS h FROM (SELECT {key}, unnest({words(text)}) AS w FROM {rel})) GROUP BY ALL) c USING ({key}, pos)) GROUP BY {key})))"""


@query(f"""SELECT doc_id, round(list_sum(list_transform(range(1, 65), lambda i: i * vec[i])), 3) + 0.0 AS total, len(list_filter(vec, lambda x: x <> 0))::INTEGER AS filled FROM {_hashed("doc_id", "(SELECT DISTINCT doc_id, text FROM documents)", "text")}""")
def embed_documents(spark, folder):
    """Every document's vector by the default encoder: a sum over its parts, and how many aren't zero; null texts have none."""
    d = vector.embed(table(spark, folder, "documents").select("doc_id", "text").distinct(), "text", vector.HashEncoder()).where("text is not null")
    total = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return d.select("doc_id", (F.round(total, 3) + 0.0).alias("total"), F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"))


# keyword search


@query(f"SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest({words('content')}) AS term FROM {CH}) GROUP BY term")
def postings_df(spark, folder):
    p = fulltext.postings(chunks(spark, folder), "id", "content")
    return p.groupBy("term", "id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(f"""WITH t AS (SELECT id, {words("content")} AS w FROM {CH}), p AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM t)
    SELECT term, id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p WHERE term IN ('towpath', 'clapper', 'dipwell') GROUP BY term, id""")
def postings_lookup(spark, folder):
    i = fulltext.index(chunks(spark, folder), "id", "content").where(F.col("term").isin("towpath", "clapper", "dipwell"))
    return i.select("term", "id", "tf", F.array_join("positions", ",").alias("positions"))


_T = f"t AS (SELECT id, {words('content')} AS w FROM {CH} WHERE content IS NOT NULL)"
_PH = f"{_T}, h AS (SELECT id, len(list_filter(range(1, greatest(1, len(w) - 3)), lambda i: w[i:i + 4] = ['as', 'the', 'members', 'had', 'asked'])) AS tf FROM t)"


@query(f"WITH {_PH} SELECT id, tf::BIGINT AS tf FROM h WHERE tf > 0")
def phrase_match(spark, folder):
    return fulltext.phrase_tf(chunks(spark, folder), "id", "content", PHRASE)


@query(f"""WITH {_PH}, s AS (SELECT count(*) AS n_all, avg(len(w)) AS avgdl FROM t), d AS (SELECT count(*) AS n FROM h WHERE tf > 0)
    SELECT h.id, round(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl)), 6) AS score
    FROM h JOIN t USING (id), s, d WHERE tf > 0 ORDER BY score DESC, id LIMIT 40""")
def bm25_phrase_topk(spark, folder):
    return fulltext.bm25_phrase(chunks(spark, folder), "id", "content", PHRASE, 40)


_TERMS = f"""{_T}, u AS (SELECT id, unnest(w) AS term FROM t), q AS (SELECT DISTINCT unnest({words(f"'{QUESTION}'")}) AS term),
    f AS (SELECT term, id, count(*) AS tf FROM u JOIN q USING (term) GROUP BY ALL), d AS (SELECT term, count(*) AS n FROM f GROUP BY term),
    s AS (SELECT count(*) AS n_all, avg(len(w)) AS avgdl FROM t),
    b AS (SELECT id, round(sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score
        FROM f JOIN d USING (term) JOIN t USING (id), s GROUP BY id ORDER BY score DESC, id LIMIT 40)"""


@query(f"WITH {_TERMS} SELECT id, score FROM b")
def bm25_terms_topk(spark, folder):
    return fulltext.bm25_terms(chunks(spark, folder), "id", "content", QUESTION, 40)


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1, _V0 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V}{_C})", f"^({_C})?[aeiouy]"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_CVC = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"
_DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"


def _ending(col: str, table: dict[str, str], measure: str) -> str:
    """Longest ending first: an ending that stands there decides, whether its stem is long enough or not."""
    return "CASE " + " ".join(f"WHEN ends_with({col}, '{e}') THEN CASE WHEN regexp_matches(left({col}, length({col}) - {len(e)}), '{measure}') THEN left({col}, length({col}) - {len(e)}) || '{r}' ELSE {col} END" for e, r in sorted(table.items(), key=lambda x: -len(x[0]))) + f" ELSE {col} END"


_STEP4 = "CASE " + " ".join(
    f"WHEN ends_with(w3, '{e}') THEN CASE WHEN regexp_matches(left(w3, length(w3) - {len(e)}), '{_M1}')" + (" AND regexp_matches(w3, '[st]ion$')" if e == "ion" else "") + f" THEN left(w3, length(w3) - {len(e)}) ELSE w3 END" for e in sorted(fulltext.STEP4, key=len, reverse=True)
) + " ELSE w3 END"


def _porter(vocabulary: str) -> str:
    """CTEs that stem the words ``w`` of a relation by the published rules, as regular expressions on consonant and vowel runs."""
    return f"""st0 AS (SELECT DISTINCT w FROM {vocabulary}), st1 AS (SELECT w, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS a FROM st0 WHERE length(w) > 2),
    st2 AS (SELECT w, a, CASE WHEN a LIKE '%eed' THEN NULL WHEN a LIKE '%ed' AND regexp_matches(left(a, length(a) - 2), '{_V0}') THEN left(a, length(a) - 2) WHEN a LIKE '%ing' AND regexp_matches(left(a, length(a) - 3), '{_V0}') THEN left(a, length(a) - 3) END AS k FROM st1),
    st3 AS (SELECT w, CASE WHEN a LIKE '%eed' THEN CASE WHEN regexp_matches(left(a, length(a) - 3), '{_M0}') THEN left(a, length(a) - 1) ELSE a END WHEN k IS NULL OR k = '' THEN a WHEN regexp_matches(k, '(at|bl|iz)$') THEN k || 'e'
        WHEN regexp_matches(k, '{_DOUBLE}') THEN left(k, length(k) - 1) WHEN regexp_matches(k, '{_ONE}') AND regexp_matches(k, '{_CVC}') THEN k || 'e' ELSE k END AS b FROM st2),
    st4 AS (SELECT w, CASE WHEN b LIKE '%y' AND regexp_matches(left(b, length(b) - 1), '{_V0}') THEN left(b, length(b) - 1) || 'i' ELSE b END AS w1 FROM st3),
    st5 AS (SELECT w, {_ending("w1", fulltext.STEP2, _M0)} AS w2 FROM st4), st6 AS (SELECT w, {_ending("w2", fulltext.STEP3, _M0)} AS w3 FROM st5), st7 AS (SELECT w, {_STEP4} AS w4 FROM st6),
    st8 AS (SELECT w, CASE WHEN w4 LIKE '%e' AND (regexp_matches(left(w4, length(w4) - 1), '{_M1}') OR regexp_matches(left(w4, length(w4) - 1), '{_ONE}') AND NOT regexp_matches(left(w4, length(w4) - 1), '{_CVC}')) THEN left(w4, length(w4) - 1) ELSE w4 END AS w5 FROM st7),
    stem AS (SELECT w, CASE WHEN w5 LIKE '%ll' AND regexp_matches(w5, '{_M1}') THEN left(w5, length(w5) - 1) ELSE w5 END AS s FROM st8 UNION ALL SELECT w, w FROM st0 WHERE length(w) <= 2)"""


@query(f"""WITH cw AS (SELECT id, unnest({words("strip_accents(content)")}) AS w FROM {CH} WHERE content IS NOT NULL), qw AS (SELECT DISTINCT unnest({words(f"'{QUESTION}'")}) AS w), {_porter("(SELECT w FROM cw UNION SELECT w FROM qw)")},
    t AS (SELECT id, s AS term FROM cw JOIN stem USING (w)), q AS (SELECT DISTINCT s AS term FROM qw JOIN stem USING (w)), l AS (SELECT id, count(*) AS dl FROM cw GROUP BY id), al AS (SELECT id, coalesce(dl, 0) AS dl FROM {CH} LEFT JOIN l USING (id) WHERE content IS NOT NULL),
    f AS (SELECT term, id, count(*) AS tf FROM t JOIN q USING (term) GROUP BY ALL), d AS (SELECT term, count(*) AS n FROM f GROUP BY term), st AS (SELECT count(*) AS n_all, avg(dl) AS avgdl FROM al)
    SELECT id, round(sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM f JOIN d USING (term) JOIN al USING (id), st GROUP BY id ORDER BY score DESC, id LIMIT 40""")
def bm25_porter_topk(spark, folder):
    """As ``bm25_terms_topk``, on folded and stemmed words."""
    return fulltext.bm25_terms(fulltext.stemmed(chunks(spark, folder).select("id", "content"), "content"), "id", "content", fulltext.fold(QUESTION), 40)


# fusion

_LISTS = f"""{_TERMS}, v AS {VEC}, q0 AS (SELECT v.embedding AS e FROM v JOIN b ON v.id = b.id ORDER BY b.score DESC, b.id LIMIT 1),
    vt AS (SELECT v.id, round({COS}(v.embedding, q0.e), 6) AS score FROM v, q0 ORDER BY score DESC, v.id LIMIT 40),
    lv AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vt), lb AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b),
    g0 AS (SELECT id, len(list_filter(['lock', 'gate', 'towpath'], lambda x: list_contains(w, x))) AS score FROM t),
    g AS (SELECT id, score FROM g0 WHERE score > 0 ORDER BY score DESC, id LIMIT 20), lg AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM g)"""
_FUSED = "f1 AS (SELECT id, round(sum(w / (60 + rank)), 9) AS rrf_score FROM (SELECT id, rank, 0.4 AS w FROM lv UNION ALL SELECT id, rank, 0.6 FROM lb UNION ALL SELECT id, rank, 0.35 FROM lg) GROUP BY id)"


GRAPH = ["lock", "gate", "towpath"]


def _lists(spark, folder):
    """Vector, keyword and graph lists for the question; the best keyword hit's vector stands for the question's.

    All texts are split once, for the frequencies of the question's words and of the graph's names.
    """
    asked = fulltext.words_of(QUESTION)
    own = asked + [w for w in GRAPH if w not in asked]
    tf = fulltext.frequencies(chunks(spark, folder).select("id", "content"), "id", "content", own)
    b = fulltext.scored(tf.withColumn("tf", F.slice("tf", 1, len(asked))), "id", len(asked)).orderBy(F.desc("score"), "id").limit(40)
    v = written(vectors(spark, folder).select("id", "embedding"), "vectors")
    q = v.join(F.broadcast(b.select("id", F.col("score").alias("s"))), "id").orderBy(F.desc("s"), "id").limit(1).select(F.col("embedding").alias("q"))
    vt = v.crossJoin(F.broadcast(q)).select("id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(40)
    hits = sum((F.col("tf")[own.index(w)] > 0).cast("int") for w in GRAPH)
    g = tf.select("id", hits.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(20)
    return [fusion.ranked(x, "id", "score") for x in (vt, b, g)]


@query(f"WITH {_LISTS}, {_FUSED} SELECT id, rrf_score FROM f1")
def rrf_fusion(spark, folder):
    w = RetrievalConfig().rrf_weights
    return fusion.rrf(_lists(spark, folder), [w["vector"], w["bm25"], w["graph"]], "id").select("id", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"""WITH {_LISTS}, r AS (SELECT 1 AS sub, id, rank FROM lv UNION ALL SELECT 2, id, rank FROM lb)
    SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM r GROUP BY id""")
def rrf_subquery_merge(spark, folder):
    """Two sub-queries' results merged with weight 1 each."""
    a, b, _ = _lists(spark, folder)
    return fusion.rrf([a, b], [1.0, 1.0], "id").select("id", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"WITH {_LISTS}, {_FUSED} SELECT 'one' AS query_id, round(max(rrf_score), 6) AS top, count(*) AS candidates, max(rrf_score) >= 0.03 AND count(*) <= 3 AS skip FROM f1")
def adaptive_skip_flag(spark, folder):
    f = rrf_fusion(spark, folder).withColumn("query_id", F.lit("one"))
    return fusion.skips(f, "query_id", "rrf_score").withColumn("top", F.round("top", 6))


@query(f"WITH {_LISTS} SELECT id, rank::INTEGER AS rank FROM lv")
def no_fusion_pick(spark, folder):
    return fusion.first_list(_lists(spark, folder), "id")


_HYB = f"""{_LISTS}, {_FUSED}, c2 AS (SELECT id, rrf_score FROM f1 ORDER BY rrf_score DESC, id LIMIT 40),
    o AS (SELECT id, rrf_score, round(1 / (1 + exp(-8 * (len(list_intersect((SELECT list(term) FROM q), w)) / (SELECT count(*) FROM q) - 0.5))), 6) AS rerank_score FROM c2 JOIN t USING (id))"""


@query(f"WITH {_HYB} SELECT id, rrf_score, rerank_score, (row_number() OVER (ORDER BY rerank_score DESC, id))::INTEGER AS rank FROM o QUALIFY rank <= 10")
def hybrid_search(spark, folder):
    """Three retrievers, weighted reciprocal-rank fusion, then the reranker on the fused candidates."""
    cfg = RetrievalConfig()
    f = rrf_fusion(spark, folder).orderBy(F.desc("rrf_score"), "id").limit(cfg.overfetch)
    c = chunks(spark, folder).select("id", "content").join(F.broadcast(f), "id")
    s = c.select("id", "rrf_score", F.round(vector.overlap_score(F.lit(QUESTION), F.col("content")), 6).alias("rerank_score"))
    return fusion.ranked(s, "id", "rerank_score").where(F.col("rank") <= cfg.limit).select("id", "rrf_score", "rerank_score", "rank")


# evaluation: the neighbours of every fiftieth vector, a neighbour being relevant if it has the same label

_KNN = f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, label = ql AS rel, round({COS}(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE vec_id <> query_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10),
    x AS (SELECT query_id, count(*) FILTER (WHERE rel) AS expected FROM s GROUP BY query_id)"""


def _judged(spark, folder):
    e = table(spark, folder, "embeddings")
    ranked = vector_self_knn(spark, folder).select("query_id", F.col("vec_id").alias("item"), "rank")
    own, other = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("item"), "label")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("expected"))
    n = own.where("query_id % 50 = 0").join(sizes, own.ql == sizes.label).select("query_id", "expected")
    relevant = ranked.join(other, "item").join(own, "query_id").where("ql = label").select("query_id", "rank")
    return evaluate.scored(relevant, n.where("expected > 0"))


@query(f"""WITH {_KNN} SELECT query_id, round(coalesce((SELECT sum(1 / log2(rank + 1)) FROM k WHERE k.query_id = x.query_id AND rel), 0) / nullif((SELECT sum(1 / log2(i + 1)) FROM range(1, least(expected, 10)::BIGINT + 1) r(i)), 0), 6) AS ndcg FROM x""")
def ndcg_at_10(spark, folder):
    return _judged(spark, folder).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_KNN} SELECT query_id, round(coalesce(max(1.0 / rank) FILTER (WHERE rel), 0), 6)::DOUBLE AS mrr FROM k GROUP BY query_id")
def mrr(spark, folder):
    return _judged(spark, folder).select("query_id", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_KNN} SELECT query_id, round(count(*) FILTER (WHERE rel AND rank <= 5) / any_value(expected), 6) AS recall FROM k JOIN x USING (query_id) GROUP BY query_id")
def recall_at_5(spark, folder):
    return _judged(spark, folder).select("query_id", F.round("recall", 6).alias("recall"))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS run, avg(value) / 100 AS m FROM events GROUP BY 1), l AS (SELECT run, m, lag(m) OVER (ORDER BY run) AS prior FROM d)
    SELECT run, round(prior - m, 6) AS fall FROM l WHERE coalesce(prior, 0) - coalesce(m, 0) >= 0.05""")
def eval_drop(spark, folder):
    """Runs whose metric fell by 0.05 or more against the run before (a day's mean value stands for the metric)."""
    runs = table(spark, folder, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run")).agg((F.avg("value") / 100).alias("m"))
    return evaluate.drops(runs, "run", ["m"], 0.05).select("run", F.round("fall", 6).alias("fall"))


@query(f"""WITH c AS (SELECT label, list(a ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS a FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL) GROUP BY label),
    s AS (SELECT vec_id, e.label, c.label AS guess, row_number() OVER (PARTITION BY vec_id ORDER BY round({COS}(e.embedding::DOUBLE[], c.m), 9) DESC, c.label) AS k FROM embeddings e, c)
    SELECT label, guess, count(*) AS n FROM s WHERE k = 1 GROUP BY ALL""")
def confusion(spark, folder):
    e = table(spark, folder, "embeddings")
    c = vector.centroids(e, "label", "embedding").select(F.col("label").alias("guess"), "centroid")
    best = vector.nearest(vector.scores(e, "vec_id", "embedding", c, "guess", "centroid"), "vec_id", "guess")
    return best.join(e.select("vec_id", "label"), "vec_id").groupBy("label", "guess").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT label, list(a ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS a FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL) GROUP BY label),
    s AS (SELECT vec_id, e.label, c.label AS guess, row_number() OVER (PARTITION BY vec_id ORDER BY round({COS}(e.embedding::DOUBLE[], c.m), 9) DESC, c.label) AS k FROM embeddings e, c)
    SELECT round(avg((label = guess)::INTEGER), 6) AS accuracy, count(*) AS n FROM s WHERE k = 1""")
def classification_accuracy(spark, folder):
    return confusion(spark, folder).agg(F.round(F.sum(F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"), F.sum("n").alias("n"))


@query(f"""SELECT id, round(len(list_intersect({words("title")}, {words(f"'{QUESTION}'")})) , 0)::INTEGER AS shared FROM {SRC} WHERE title IS NOT NULL""")
def title_overlap(spark, folder):
    """How many words of the question a source's title has."""
    q = F.array(*[F.lit(w) for w in QUESTION.split()])
    return sources(spark, folder).where("title is not null").select("id", F.size(F.array_intersect(tokens(normal(F.col("title"))), q)).alias("shared"))


@query("SELECT label, min(vec_id) AS first, max(vec_id) AS last, count(*) AS n FROM embeddings GROUP BY label")
def label_extent(spark, folder):
    return table(spark, folder, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.count("*").alias("n"))
