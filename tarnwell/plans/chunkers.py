"""Queries on the chunkers. Their SQL folds the parts of a text one by one, where the operators search in running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.operators import chunking
from tarnwell.plans.common import PG, SRC, pages, sources
from tarnwell.plans.registry import query
from tarnwell.sources.tables import table

WS = r"[\t\n\x{b}\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def count_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WS.replace('[', '[^', 1)}+'))::INTEGER"


def packed(parts: str, size: str, target: int, glue: str, first: int, joins: int) -> str:
    """Groups of the list ``parts`` packed one by one; ``first`` is added to the size of the opening part, ``joins`` to that of others."""
    start = "{'out': []::VARCHAR[], 'cur': x, 'n': " + size.replace("$", "x") + f" + {first}" + "}"
    n = size.replace("$", "x.cur")
    step = f"CASE WHEN a.n + {n} > {target} THEN {{'out': a.out || [a.cur], 'cur': x.cur, 'n': {n}}} ELSE {{'out': a.out, 'cur': a.cur || {glue} || x.cur, 'n': a.n + {n} + {joins}}} END"
    return f"list_transform([list_reduce(list_transform({parts}, lambda x: {start}), lambda a, x: {step})], lambda r: r.out || [r.cur])[1]"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(2), 'g'), chr(2))"


_MARKS = ["chr(10)", "'. '", "'! '", "'? '", "', '", "' '"]
_CUT = "CASE " + " ".join(f"WHEN contains(substr(rest, 1001, 1000), {m}) THEN 2001 - strpos(reverse(substr(rest, 1001, 1000)), reverse({m}))" for m in _MARKS) + " ELSE 2000 END"
_INDEX = f"""RECURSIVE t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({trimmed("text")}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda p: {trimmed("p")}), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM t), b AS (SELECT *, length(p) > 2000 AS big, i - row_number() OVER (PARTITION BY doc_id, length(p) > 2000 ORDER BY i) AS run FROM u),
    g AS (SELECT doc_id, min(i) AS i, list(p ORDER BY i) AS parts FROM b WHERE NOT big GROUP BY doc_id, run),
    k AS (SELECT doc_id, i, {packed("parts", "length($)", 1000, "chr(10) || chr(10)", 2, 2)} AS c FROM g
        UNION ALL SELECT doc_id, i, {packed("list_filter(" + sentences("p") + ", lambda s: s <> '')", "length($)", 1000, "' '", 1, 1)} FROM b WHERE big),
    e AS (SELECT doc_id, i, unnest(range(len(c))) AS j, unnest(c) AS rest FROM k),
    cut(doc_id, i, j, n, piece, rest) AS (
        SELECT doc_id, i, j, 0, CASE WHEN length(rest) <= 2000 THEN rest ELSE substr(rest, 1, {_CUT}) END, CASE WHEN length(rest) <= 2000 THEN '' ELSE substr(rest, {_CUT} + 1) END FROM e
        UNION ALL SELECT doc_id, i, j, n + 1, CASE WHEN length(rest) <= 2000 THEN rest ELSE substr(rest, 1, {_CUT}) END, CASE WHEN length(rest) <= 2000 THEN '' ELSE substr(rest, {_CUT} + 1) END FROM cut WHERE rest <> ''),
    chunk AS (SELECT doc_id, i, j, n, {trimmed("piece")} AS content FROM cut WHERE length({trimmed("piece")}) >= 100)"""


@query(f"WITH {_INDEX} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j, n) - 1)::INTEGER AS chunk_index, content, {count_words('content')} AS token_count FROM chunk")
def index_chunks(spark, folder):
    return chunking.explode_text(table(spark, folder, "documents"), "doc_id", "text", "index")


@query(f"WITH {_INDEX} SELECT (length(content) // 500)::INTEGER AS size, count(*) AS n, min(length(content))::INTEGER AS least, max(length(content))::INTEGER AS most FROM chunk GROUP BY 1")
def chunk_cap_invariants(spark, folder):
    """The sizes of the index chunker's chunks: none above the cap, none below the least size."""
    n = F.char_length("content")
    return index_chunks(spark, folder).groupBy(F.floor(n / 500).cast("int").alias("size")).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))


_PARA = rf"""held AS (SELECT doc_id, regexp_extract_all(text, '(?s)```.*?```') AS f, regexp_split_to_array(regexp_replace(text, '(?s)```.*?```', chr(1), 'g'), '\n{WS}*\n') AS parts FROM documents WHERE text IS NOT NULL),
    one AS (SELECT doc_id, f, parts, unnest(range(1, len(parts) + 1)) AS i FROM held),
    two AS (SELECT doc_id, i, f, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) - length(replace(x, chr(1), '')))), 0)::INTEGER AS before, string_split(parts[i], chr(1)) AS b FROM one),
    para AS (SELECT doc_id, i, {trimmed("array_to_string(list_transform(range(1, len(b) + 1), lambda k: b[k] || CASE WHEN k < len(b) THEN f[before + k] ELSE '' END), '')")} AS p FROM two)"""


@query(f"WITH {_PARA} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, p AS content FROM para WHERE p <> ''")
def paragraph_split(spark, folder):
    """The paragraphs of every document, fenced blocks kept whole."""
    return chunking.explode_text(table(spark, folder, "documents"), "doc_id", "text", "paragraphs").select("doc_id", "chunk_index", "content")


@query(f"""WITH {_PARA}, b AS (SELECT doc_id, i, p, length(p) // 4 >= 500 AS big FROM para WHERE p <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, big ORDER BY i) AS run FROM b),
    g AS (SELECT doc_id, min(i) AS i, list(p ORDER BY i) AS parts FROM r WHERE NOT big GROUP BY doc_id, run),
    k AS (SELECT doc_id, i, {packed("parts", "greatest(1, length($) // 4)", 500, "chr(10) || chr(10)", 0, 0)} AS c FROM g UNION ALL SELECT doc_id, i, [p] FROM b WHERE big),
    e AS (SELECT doc_id, i, unnest(range(len(c))) AS j, unnest(c) AS content FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM e)
    SELECT 's' || doc_id || '_c' || n AS chunk_id, doc_id, (n - 1)::INTEGER AS chunk_index, {count_words("content")} AS token_count, md5(content) AS body FROM n""")
def research_chunks(spark, folder):
    c = chunking.explode_text(table(spark, folder, "documents"), "doc_id", "text", "research")
    ids = chunking.section_ids(c.withColumn("section", F.concat(F.lit("s"), F.col("doc_id"))), "section", ["chunk_index"])
    return ids.select("chunk_id", "doc_id", "chunk_index", "token_count", F.md5("content").alias("body"))


@query(f"""WITH q AS (SELECT id, {trimmed("title")} AS q FROM {SRC} WHERE title IS NOT NULL), s AS (SELECT id, q, list_filter(list_transform({sentences("q")}, lambda x: {trimmed("x")}), lambda x: x <> '') AS a FROM q),
    p AS (SELECT id, q, CASE WHEN len(a) < 2 AND {count_words("q")} >= 15 THEN list_filter(list_transform(regexp_split_to_array(q, '\\b(?:and|or|but)\\b'), lambda x: trim(x, ' ,;')), lambda x: x <> '') ELSE a END AS a FROM s),
    k AS (SELECT id, CASE WHEN len(a) > 1 AND list_min(list_transform(a, lambda x: {count_words("x")})) >= 3 THEN a ELSE [q] END AS a FROM p)
    SELECT id, unnest(range(len(a)))::INTEGER AS chunk_index, unnest(a) AS content FROM k""")
def decomposed_titles(spark, folder):
    return chunking.explode_text(sources(spark, folder), "id", "title", "decompose").select("id", "chunk_index", "content")


_LONG = f"SELECT s.id, s.title || ' and ' || coalesce(n.title, 'nothing further was said') || ' but the older records of the archive say something else' AS q FROM {SRC} s LEFT JOIN {SRC} n ON n.id = s.id + 1 WHERE s.title IS NOT NULL"


@query(f"""WITH q AS ({_LONG}), s AS (SELECT id, q, list_filter(list_transform({sentences("q")}, lambda x: {trimmed("x")}), lambda x: x <> '') AS a FROM q),
    p AS (SELECT id, q, CASE WHEN len(a) < 2 AND {count_words("q")} >= 15 THEN list_filter(list_transform(regexp_split_to_array(q, '\\b(?:and|or|but)\\b'), lambda x: trim(x, ' ,;')), lambda x: x <> '') ELSE a END AS a FROM s),
    k AS (SELECT id, CASE WHEN len(a) > 1 AND list_min(list_transform(a, lambda x: {count_words("x")})) >= 3 THEN a ELSE [q] END AS a FROM p)
    SELECT id, unnest(range(len(a)))::INTEGER AS chunk_index, unnest(a) AS content FROM k""")
def decomposed_questions(spark, folder):
    """Long questions, made of two titles and a clause, at their conjunctions."""
    s = sources(spark, folder)
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("title").alias("t"))
    q = s.where("title is not null").join(nxt, "id", "left").select("id", F.concat("title", F.lit(" and "), F.coalesce("t", F.lit("nothing further was said")), F.lit(" but the older records of the archive say something else")).alias("q"))
    return chunking.explode_text(q, "id", "q", "decompose").select("id", "chunk_index", "content")


@query(rf"""WITH p AS {PG}, old AS (SELECT section_id, coalesce(max(TRY_CAST(nullif(regexp_extract(chunk_id, '^s\d+_c(\d+)$', 1), '') AS INTEGER)), 0) AS k FROM p WHERE regexp_matches(chunk_id, '^s\d+_c\d+$') AND starts_with(chunk_id, section_id || '_c') GROUP BY section_id)
    SELECT row_id, p.section_id || '_c' || (coalesce(k, 0) + row_number() OVER (PARTITION BY p.section_id ORDER BY row_id)) AS chunk_id FROM p LEFT JOIN old USING (section_id) WHERE p.section_id IS NOT NULL""")
def continued_ids(spark, folder):
    """New ids for all pages as if they were appended to what is there: each section goes on from its highest number."""
    p = pages(spark, folder).where("section_id is not null")
    old = p.where(F.col("chunk_id").startswith(F.concat("section_id", F.lit("_c"))))
    return chunking.section_ids(p.select("row_id", "section_id"), "section_id", ["row_id"], old).select("row_id", "chunk_id")


@query(f"""WITH p AS {PG}, h AS (SELECT DISTINCT file_name, section_id, sub_question_origin AS hint FROM p WHERE section_id IS NOT NULL AND sub_question_origin IS NOT NULL)
    SELECT row_id, h.section_id AS section FROM p JOIN h ON p.file_name = h.file_name AND p.sub_question_origin = h.hint""")
def hint_routing(spark, folder):
    """Each page under every section of its file that asks its question (the questions seen in a section are its hints)."""
    p = pages(spark, folder)
    o = p.where("section_id is not null").groupBy("file_name", "section_id").agg(F.collect_set("sub_question_origin").alias("source_routing_hints"))
    return chunking.routed(p.select("row_id", "file_name", "sub_question_origin"), o, "file_name").select("row_id", "section")
