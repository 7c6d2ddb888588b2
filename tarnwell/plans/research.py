"""Queries on the research chain: records, merges, citations, documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.operators import citations, research
from tarnwell.plans.common import PG, pages
from tarnwell.plans.registry import query
from tarnwell.sources.tables import table

_REC = """r0 AS (SELECT DISTINCT ON (raw_id) raw_id, searcher, file_name, TRY_CAST(payload AS JSON) AS j FROM searcher_raw),
    r1 AS (SELECT raw_id, searcher, file_name, CASE WHEN json_type(j, '$.chunks') = 'ARRAY' THEN json_extract(j, '$.chunks[*]') ELSE [j] END AS a FROM r0 WHERE j IS NOT NULL),
    r AS (SELECT raw_id, searcher, file_name, unnest(range(len(a))) AS pos, unnest(a) AS j FROM r1)"""


def _pick(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(CASE WHEN json_type(j, '$.{n}') IN ('VARCHAR') THEN json_extract_string(j, '$.{n}') END, '')" for n in names) + ")"


_NORM = f"""{_REC}, n AS (SELECT raw_id, pos, file_name, {_pick("chunk_id", "id")} AS chunk_id, {_pick("section_id", "section")} AS section_id, {_pick("source_url", "url")} AS source_url,
    {_pick("source_title", "title")} AS source_title, coalesce({_pick("fetched_at", "date")}, '2026-01-01T00:00:00Z') AS fetched_at, coalesce({_pick("sub_question_origin", "subquestion", "topic")}, '(not recorded)') AS sub_question_origin,
    {_pick("text", "extract")} AS text FROM r),
    m AS (SELECT *, list_aggregate(list_filter([CASE WHEN chunk_id IS NULL THEN 'chunk_id' END, CASE WHEN section_id IS NULL THEN 'section_id' END, CASE WHEN source_url IS NULL THEN 'source_url' END, CASE WHEN source_title IS NULL THEN 'source_title' END,
        CASE WHEN text IS NULL THEN 'text' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS lacking FROM n)"""


def _normal(spark, folder):
    from tarnwell.operators.drift import fields, records

    recs = records(table(spark, folder, "searcher_raw"))
    f = fields(recs).where("type = 'string'").groupBy("raw_id", "pos", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("r"))
    return research.normalise(recs.select("raw_id", "pos", "file_name").join(f, ["raw_id", "pos", "file_name"], "left"))


@query(f"WITH {_NORM} SELECT raw_id, pos::INTEGER AS pos, chunk_id, section_id, fetched_at, sub_question_origin, CASE WHEN lacking <> '' THEN 'missing ' || lacking WHEN length(text) < 200 THEN 'short text' END AS reason FROM m")
def schema_drift_coalesce(spark, folder):
    return _normal(spark, folder).select("raw_id", "pos", "chunk_id", "section_id", "fetched_at", "sub_question_origin", "reason")


@query(f"WITH {_NORM} SELECT coalesce(CASE WHEN lacking <> '' THEN 'missing ' || lacking WHEN length(text) < 200 THEN 'short text' END, 'accepted') AS reason, count(*) AS n FROM m GROUP BY 1")
def reject_reasons(spark, folder):
    return _normal(spark, folder).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT file_name, chunk_id, count(*) AS n FROM {PG} GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, folder):
    return pages(spark, folder).groupBy("file_name", "chunk_id").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH p AS {PG}, d AS (SELECT file_name, max(n) > 1 AS dup FROM (SELECT file_name, chunk_id, count(*) AS n FROM p GROUP BY ALL) GROUP BY file_name)
    SELECT row_id, CASE WHEN dup THEN section_id || '_c' || row_number() OVER (PARTITION BY file_name, section_id ORDER BY row_id) ELSE chunk_id END AS chunk_id FROM p JOIN d USING (file_name)""")
def dup_renumber(spark, folder):
    return research.renumber(pages(spark, folder), "file_name", ["row_id"]).select("row_id", "chunk_id")


_SEC = r"coalesce(TRY_CAST(nullif(regexp_extract(section_id, '^s(\d{1,5})$', 1), '') AS INTEGER), 99)"
_NUM = r"coalesce(TRY_CAST(nullif(regexp_extract(chunk_id, '_c(\d{1,5})$', 1), '') AS INTEGER), 999)"


@query(f"SELECT row_id, file_name, (row_number() OVER (PARTITION BY file_name ORDER BY {_SEC}, {_NUM}, row_id))::INTEGER AS place FROM {PG}")
def merged_order(spark, folder):
    p = pages(spark, folder)
    order = [*research.reading_order(F.col("section_id"), F.col("chunk_id")), "row_id"]
    return p.select("row_id", "file_name", F.row_number().over(W.partitionBy("file_name").orderBy(*order)).alias("place"))


@query(f"SELECT file_name, section_id, count(*) AS chunks, string_agg(chunk_id, ',' ORDER BY row_id) AS ids, count(DISTINCT source_url) AS urls FROM {PG} GROUP BY ALL")
def section_counts(spark, folder):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("row_id", "chunk_id")))), lambda x: x["chunk_id"]), ",")
    return pages(spark, folder).groupBy("file_name", "section_id").agg(F.count("*").alias("chunks"), F.nullif(ids, F.lit("")).alias("ids"), F.count_distinct("source_url").alias("urls"))


@query(f"SELECT file_name, section_id, max({_NUM.replace('999', '0')}) AS last FROM {PG} GROUP BY ALL")
def ordinal_max(spark, folder):
    return pages(spark, folder).groupBy("file_name", "section_id").agg(F.max(research.number(F.col("chunk_id"), r"_c(\d{1,5})$", 0)).alias("last"))


@query(f"""WITH p AS {PG}, plan AS (SELECT DISTINCT file_name, 's' || i AS section_id, i FROM p, range(1, 7) t(i)), h AS (SELECT DISTINCT file_name, section_id FROM p)
    SELECT file_name, count(*) AS framing, string_agg(section_id, ',' ORDER BY i) AS sections FROM plan WHERE (file_name, section_id) NOT IN (SELECT file_name, section_id FROM h WHERE section_id IS NOT NULL) GROUP BY file_name""")
def framing_sections(spark, folder):
    """Against a plan of s1 to s6 for each file: its sections without chunks, in plan order."""
    p = pages(spark, folder)
    plan = p.select("file_name").distinct().select("file_name", F.posexplode(F.array(*[F.lit(f"s{i}") for i in range(1, 7)])).alias("ord", "section_id"))
    counts = p.where("section_id is not null").groupBy("file_name", "section_id").agg(F.count("*").alias("n"))
    out = research.pending(plan, counts, "file_name").where("size(framing) > 0")
    return out.select("file_name", F.size("framing").cast("long").alias("framing"), F.array_join("framing", ",").alias("sections"))


@query(f"SELECT file_name, section_id, count(*) AS n FROM {PG} GROUP BY ALL HAVING count(*) < 5")
def thin_sections(spark, folder):
    return pages(spark, folder).groupBy("file_name", "section_id").agg(F.count("*").alias("n")).where("n < 5")


@query(f"""WITH d AS (SELECT DISTINCT file_name, sub_question_origin AS q, source_url FROM {PG} WHERE sub_question_origin IS NOT NULL AND source_url IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_name, q ORDER BY source_url) AS k FROM d), t AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY k, q, source_url) AS n FROM r WHERE k <= 5)
    SELECT file_name, q, source_url, k::INTEGER AS place FROM t WHERE n <= 50""")
def per_question_cap(spark, folder):
    """The first five URLs of each question and fifty of each file, as the collecting contract has it."""
    d = pages(spark, folder).where("sub_question_origin is not null and source_url is not null").select("file_name", F.col("sub_question_origin").alias("q"), "source_url").distinct()
    return research.per_source_cap(d, "q", "source_url", [], scope="file_name").select("file_name", "q", "source_url", "place")


_MERGED = f"""{_NORM}, keep AS (SELECT * FROM m WHERE coalesce(lacking, '') = '' AND length(text) >= 200),
    d AS (SELECT file_name, max(n) > 1 AS dup FROM (SELECT file_name, chunk_id, count(*) AS n FROM keep GROUP BY ALL) GROUP BY file_name),
    ren AS (SELECT raw_id, pos, keep.file_name, section_id, CASE WHEN dup THEN section_id || '_c' || row_number() OVER (PARTITION BY keep.file_name, section_id ORDER BY raw_id, pos) ELSE chunk_id END AS chunk_id FROM keep JOIN d USING (file_name)),
    mg AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY {_SEC}, {_NUM}, raw_id, pos) AS place FROM ren)"""


def _merge(spark, folder):
    from tarnwell.operators.drift import fields, records

    recs = records(table(spark, folder, "searcher_raw"))
    f = fields(recs).where("type = 'string'").groupBy("raw_id", "pos", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("r"))
    full = recs.select("raw_id", "pos", "file_name").join(f, ["raw_id", "pos", "file_name"], "left")
    plan = recs.select("file_name").distinct().select("file_name", F.posexplode(F.array(*[F.lit(f"s{i}") for i in range(1, 7)])).alias("ord", "section_id"))
    return research.merge(full, plan, "file_name", ["raw_id", "pos"])


@query(f"WITH {_MERGED} SELECT file_name, raw_id, pos::INTEGER AS pos, chunk_id, place::INTEGER AS place FROM mg")
def merged_chunks(spark, folder):
    """All searchers' records merged: canonical, short ones refused, repeated ids numbered anew, in reading order."""
    return _merge(spark, folder)[0].select("file_name", "raw_id", "pos", "chunk_id", "place")


@query(f"""WITH {_MERGED}, f AS (SELECT DISTINCT file_name FROM r WHERE json_type(j) = 'OBJECT'), plan AS (SELECT file_name, 's' || i AS section_id, i FROM f, range(1, 7) t(i)),
    c AS (SELECT file_name, section_id, count(*) AS n FROM mg GROUP BY ALL)
    SELECT plan.file_name, coalesce(string_agg(plan.section_id, ',' ORDER BY i) FILTER (WHERE c.n IS NULL), '') AS framing,
        (SELECT string_agg(x.section_id, ',' ORDER BY x.section_id) FROM c x WHERE x.file_name = plan.file_name) AS with_chunks, coalesce((SELECT sum(n) FROM c x WHERE x.file_name = plan.file_name), 0)::BIGINT AS total
    FROM plan LEFT JOIN c ON c.file_name = plan.file_name AND c.section_id = plan.section_id GROUP BY plan.file_name""")
def pending_sections(spark, folder):
    p = _merge(spark, folder)[1]
    return p.select("file_name", F.array_join("framing", ",").alias("framing"), F.array_join("with_chunks", ",").alias("with_chunks"), "total")


# Drafts: every page's first sentence cites its own id, and every seventh page one that isn't there.

_DRAFT = rf"""p AS {PG}, dr AS (SELECT row_id, file_name, section_id, chunk_id, source_url, source_title, fetched_at, regexp_extract(text, '[^.!?]{{30,200}}\.', 0) || ' [' || chunk_id || CASE WHEN row_id % 7 = 0 THEN ', s9_c' || row_id ELSE '' END || ']' AS body FROM p
    WHERE regexp_full_match(chunk_id, 's\d+_c\d+') AND regexp_extract(text, '[^.!?]{{30,200}}\.', 0) <> ''),
    c0 AS (SELECT file_name, unnest(regexp_extract_all(body, '\[(s\d+_c\d+(?:\s*,\s*s\d+_c\d+)*)\]', 1)) AS c FROM dr),
    ct AS (SELECT DISTINCT file_name, unnest(string_split_regex(c, '\s*,\s*')) AS chunk_id FROM c0)"""


def _drafts(spark, folder):
    first = F.regexp_extract("text", r"[^.!?]{30,200}\.", 0)
    p = pages(spark, folder).withColumn("first", first).where(F.col("chunk_id").rlike(r"^s\d+_c\d+$") & (F.col("first") != ""))
    ref = F.when(F.col("row_id") % 7 == 0, F.concat(F.lit(", s9_c"), "row_id")).otherwise("")
    return p.withColumn("body", F.concat("first", F.lit(" ["), "chunk_id", ref, F.lit("]")))


def _cited(spark, folder):
    d = _drafts(spark, folder)
    return d.select("file_name", F.explode(F.regexp_extract_all("body", F.lit(citations.PATTERN), 1)).alias("c")).select("file_name", F.explode(F.split("c", r"\s*,\s*")).alias("chunk_id")).distinct()


@query(f"WITH {_DRAFT} SELECT file_name, count(*) AS cited FROM ct GROUP BY file_name")
def cited_ids(spark, folder):
    return _cited(spark, folder).groupBy("file_name").agg(F.count("*").alias("cited"))


@query(f"WITH {_DRAFT} SELECT file_name, chunk_id FROM ct WHERE (file_name, chunk_id) NOT IN (SELECT file_name, chunk_id FROM p WHERE chunk_id IS NOT NULL)")
def missing_chunks(spark, folder):
    return _cited(spark, folder).join(pages(spark, folder).select("file_name", "chunk_id"), ["file_name", "chunk_id"], "left_anti")


@query(f"WITH {_DRAFT} SELECT DISTINCT file_name, chunk_id FROM p WHERE chunk_id IS NOT NULL AND (file_name, chunk_id) NOT IN (SELECT file_name, chunk_id FROM ct)")
def unused_sources(spark, folder):
    return pages(spark, folder).where("chunk_id is not null").select("file_name", "chunk_id").distinct().join(_cited(spark, folder), ["file_name", "chunk_id"], "left_anti")


@query(rf"""WITH {_DRAFT} SELECT row_id, '| ' || chunk_id || ' | ' || coalesce(source_url, '') || ' | ' || replace(substr(coalesce(source_title, ''), 1, 60), '|', '\|') || ' | ' || substr(coalesce(fetched_at, ''), 1, 10) || ' |' AS line
    FROM p WHERE (file_name, chunk_id) IN (SELECT file_name, chunk_id FROM ct)""")
def cited_sources(spark, folder):
    return _lines(pages(spark, folder), _cited(spark, folder))


@query(rf"""WITH {_DRAFT} SELECT row_id, file_name, (row_number() OVER (PARTITION BY file_name ORDER BY {_SEC}, {_NUM}, row_id))::INTEGER AS place FROM p WHERE (file_name, chunk_id) IN (SELECT file_name, chunk_id FROM ct)""")
def sources_order(spark, folder):
    """The place of each cited page in its file's sources table, by section and chunk number."""
    p = pages(spark, folder)
    rows = research.sources_table(p.withColumn("scope", F.concat_ws("\0", "file_name", "row_id")), _cited(spark, folder).join(p.select("file_name", "chunk_id", "row_id"), ["file_name", "chunk_id"]).select(F.concat_ws("\0", "file_name", "row_id").alias("scope"), "chunk_id"), "scope")
    d = rows.select(F.split("scope", "\0")[0].alias("file_name"), F.split("scope", "\0")[1].cast("long").alias("row_id"), "sec", "num")
    return d.select("row_id", "file_name", F.row_number().over(W.partitionBy("file_name").orderBy("sec", "num", "row_id")).alias("place"))


def _lines(p, cited):
    rows = research.sources_table(p.withColumn("scope", F.concat_ws("\0", "file_name", "row_id")), cited.join(p.select("file_name", "chunk_id", "row_id"), ["file_name", "chunk_id"]).select(F.concat_ws("\0", "file_name", "row_id").alias("scope"), "chunk_id"), "scope")
    return rows.select(F.element_at(F.split("scope", "\0"), 2).cast("long").alias("row_id"), "line")


@query(f"""WITH {_DRAFT}, long AS (SELECT file_name || '#' || row_id AS draft, '# Note' || chr(10) || 'It is said in A. B. that ' || replace(body, '. [', ' [') || '. What else? * So it is [s8_c' || row_id || ']' AS t FROM dr),
    hit AS (SELECT draft, t, unnest(regexp_extract_all(t, '\\[(s\\d+_c\\d+(?:\\s*,\\s*s\\d+_c\\d+)*)\\]')) AS c FROM long),
    pos AS (SELECT DISTINCT draft, t, c, strpos(t, c) AS pl FROM hit),
    cl AS (SELECT draft, pl, c, t, coalesce(list_max(list_filter(range(1, pl), lambda i: substr(t, i::INTEGER, 1) IN ('.', '!', '?', chr(10)) AND (i = 1 OR substr(t, (i - 1)::INTEGER, 1) <> '.') AND substr(t, (i + 1)::INTEGER, 1) IN (' ', chr(9), chr(10)))), 0) AS b FROM pos)
    SELECT draft, (pl - 1)::INTEGER AS position, ltrim(trim(substr(t, b + 1, pl + length(c) - 1 - b), ' ' || chr(10)), ' #>*-' || chr(9) || chr(10)) AS claim, unnest(string_split_regex(substr(c, 2, length(c) - 2), '\\s*,\\s*')) AS chunk_id FROM cl""")
def cited_claims(spark, folder):
    """Every citation of the drafts with the sentence that it ends; a heading, an abbreviation and a list mark stand before them."""
    d = _drafts(spark, folder)
    t = F.concat(F.lit("# Note\nIt is said in A. B. that "), F.regexp_replace("body", r"\. \[", " ["), F.lit(". What else? * So it is [s8_c"), "row_id", F.lit("]"))
    return citations.citations(d.select(F.concat_ws("#", "file_name", "row_id").alias("draft"), t.alias("t")), "draft", "t")


# Claims whose score is known: a passage of the chunk with a run of its letters, 0 to 80 of 100, made unreadable. Every seventh asks for a chunk that isn't there.

_CLAIMS = f"""p AS {PG}, d AS (SELECT file_name, max(n) > 1 AS dup FROM (SELECT file_name, chunk_id, count(*) AS n FROM p GROUP BY ALL) GROUP BY file_name),
    ren AS (SELECT row_id, p.file_name, text, CASE WHEN dup THEN section_id || '_c' || row_number() OVER (PARTITION BY p.file_name, section_id ORDER BY row_id) ELSE chunk_id END AS chunk_id FROM p JOIN d USING (file_name)),
    c0 AS (SELECT row_id, file_name, text, CASE WHEN row_id % 7 = 0 THEN 's9_c' || row_id ELSE chunk_id END AS chunk_id, regexp_extract(text, '[^.!?]{{30,200}}\\.', 0) AS s FROM ren WHERE chunk_id IS NOT NULL AND regexp_extract(text, '[^.!?]{{30,200}}\\.', 0) <> ''),
    c1 AS (SELECT *, length(s) AS n, (length(s) * (row_id % 5) * 20 // 100)::INTEGER AS k FROM c0),
    cv AS (SELECT row_id AS position, file_name, chunk_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE floor(2.0 * (n - k) / (2 * n) * 100)::INTEGER END AS fuzzy_score, text, s[1:n - k - 5] || repeat(chr(1), k) || s[n - 4:n] AS claim FROM c1),
    cw AS (SELECT *, CASE WHEN fuzzy_score IS NULL THEN 'MISSING_CHUNK' WHEN fuzzy_score >= 70 THEN 'PASS' WHEN fuzzy_score >= 38 THEN 'AMBIGUOUS' ELSE 'FAIL' END AS verdict FROM cv)"""


def _claimed(spark, folder):
    p = research.renumber(pages(spark, folder), "file_name", ["row_id"]).where("chunk_id is not null").select("row_id", "file_name", "chunk_id", "text")
    s = F.regexp_extract("text", r"[^.!?]{30,200}\.", 0)
    n = F.char_length("s")
    k = F.floor(n * (F.col("row_id") % 5) * 20 / 100).cast("int")
    c = p.withColumn("s", s).where("s != ''").withColumn("n", n).withColumn("k", k)
    claim = F.expr("concat(substring(s, 1, n - k - 5), repeat(char(1), k), substring(s, n - 4, 5))")
    return c.select("file_name", F.col("row_id").alias("position"), F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("s9_c"), "row_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), claim.alias("claim")), p


def _judged(spark, folder):
    c, p = _claimed(spark, folder)
    return citations.verdicts(c, p, "file_name"), p


@query(f"WITH {_CLAIMS} SELECT file_name, position, chunk_id, fuzzy_score, verdict FROM cw")
def citation_verdicts(spark, folder):
    """The fuzzy verdict of every claim against the whole text of the chunk that it names."""
    return _judged(spark, folder)[0].select("file_name", "position", "chunk_id", "fuzzy_score", "verdict")


@query(f"""WITH {_CLAIMS} SELECT file_name, count(*) AS total, count(*) FILTER (WHERE verdict = 'PASS') AS pass, count(*) FILTER (WHERE verdict = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE verdict = 'FAIL') AS fail,
    count(*) FILTER (WHERE verdict = 'MISSING_CHUNK') AS missing_chunk, count(*) FILTER (WHERE verdict IN ('AMBIGUOUS', 'FAIL')) AS needs_judge, count(*) FILTER (WHERE verdict IN ('FAIL', 'MISSING_CHUNK')) AS needs_substitution,
    count(*) FILTER (WHERE verdict IN ('FAIL', 'MISSING_CHUNK')) <= 0.05 * count(*) AS clean FROM cw GROUP BY file_name""")
def citation_report(spark, folder):
    return citations.report(_judged(spark, folder)[0], "file_name")


_ESC = f"""{_CLAIMS}, es AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY position, chunk_id) - 1 AS id FROM cw WHERE verdict IN ('AMBIGUOUS', 'FAIL')),
    jd AS (SELECT *, CASE id % 5 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CONTRADICTED' WHEN 2 THEN 'UNRELATED' ELSE 'PARTIAL' END AS judged FROM es)"""


def _escalated(spark, folder):
    v, p = _judged(spark, folder)
    return citations.escalations(v.withColumn("against", F.col("fuzzy_score") / 100), p, "file_name", "against")


def _merged_verdicts(spark, folder):
    e = _escalated(spark, folder)
    own = F.when(F.col("id") % 5 == 0, "SUPPORTED").when(F.col("id") % 5 == 1, "CONTRADICTED").when(F.col("id") % 5 == 2, "UNRELATED").otherwise("ODD")
    return citations.merge_verdicts(e, e.where("id % 5 != 4").select("file_name", "id", own.alias("verdict")), "file_name")


@query(f"WITH {_ESC} SELECT file_name, id::INTEGER AS id, chunk_id, md5(substr(claim, 1, 300)) AS claim, md5(substr(text, 1, 600)) AS source, fuzzy_score > 50 AS hinted FROM es")
def escalated_claims(spark, folder):
    """What a judge should see of each file, numbered, with a hint where a score above one half stands for a contradiction."""
    return _escalated(spark, folder).select("file_name", "id", "chunk_id", F.md5("claim").alias("claim"), F.md5("source").alias("source"), F.col("hint").isNotNull().alias("hinted"))


@query(f"WITH {_ESC} SELECT file_name, id::INTEGER AS id, judged AS verdict FROM jd")
def judged_claims(spark, folder):
    """The judge's verdicts laid over the escalations; missing and unknown ones are PARTIAL."""
    return _merged_verdicts(spark, folder).select("file_name", "id", "verdict")


@query(f"WITH {_ESC} SELECT file_name, {', '.join(f'count(*) FILTER (WHERE judged = {v!r}) AS {v.lower()}' for v in ('SUPPORTED', 'PARTIAL', 'CONTRADICTED', 'UNRELATED'))} FROM jd GROUP BY file_name")
def judge_counters(spark, folder):
    return citations.counters(_merged_verdicts(spark, folder), "file_name")


@query(f"""WITH {_CLAIMS}, o AS (SELECT cw.file_name, cw.position, list_filter(list_distinct(regexp_extract_all(lower(claim), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) >= 4) AS w, regexp_extract_all(lower(coalesce(t.text, '')), '[\\p{{L}}\\p{{N}}_]+') AS tw, t.text IS NOT NULL AS has
        FROM cw LEFT JOIN (SELECT file_name AS f2, row_id + 1 AS position, text FROM ren) t ON t.f2 = cw.file_name AND t.position = cw.position)
    SELECT file_name, position, len(w) = 0 OR len(list_intersect(w, tw)) > 0 AS shared FROM o WHERE has""")
def claim_overlap(spark, folder):
    """Whether each claim shares a word of content with the chunk before it in its file."""
    c, p = _claimed(spark, folder)
    t = pages(spark, folder).where("chunk_id is not null").select("file_name", (F.col("row_id") + 1).alias("position"), "text").where("text is not null")
    return c.join(t, ["file_name", "position"]).select("file_name", "position", citations.shares_words(F.col("claim"), F.col("text")).alias("shared"))


@query(f"""WITH {_CLAIMS}, y AS (SELECT position, '[{{"id": 0, "verdict": "' || verdict || '", "rationale": "r"}}, {{"id": 1, "verdict": "PASS", "rationale": null}}]' AS j FROM cw)
    SELECT position, CASE WHEN position % 11 = 0 OR position % 3 <> 1 THEN NULL ELSE json_extract_string(j, '$[0].verdict') END AS first FROM y""")
def parsed_verdicts(spark, folder):
    """The judge's answers, each an array between two marks; answers that are cut or of the wrong length give nothing."""
    n = F.col("position")
    j = F.concat(F.lit('Text. BEGIN_VERDICTS\n[{"id": 0, "verdict": "'), "verdict", F.lit('", "rationale": "r"}, {"id": 1, "verdict": "PASS", "rationale": null}]\n'))
    d = _judged(spark, folder)[0].select(n, F.when(n % 11 == 0, j).otherwise(F.concat(j, F.lit("END_VERDICTS"))).alias("t"), (1 + n % 3).cast("int").alias("want"))
    return citations.parse_verdicts(d, "t", "want").select("position", F.try_element_at("verdicts", F.lit(1))["verdict"].alias("first"))


_STITCH = f"""{_DRAFT}, sec AS (SELECT file_name, section_id, {_SEC} AS ord, string_agg(body, ' ' ORDER BY row_id) AS body FROM dr GROUP BY file_name, section_id),
    main AS (SELECT file_name, string_agg('## ' || CASE WHEN ord = 1 THEN 'Context' WHEN ord = 6 THEN 'Gaps & Caveats' ELSE 'Part ' || section_id END || chr(10) || chr(10) || {{trim}} || chr(10), chr(10) ORDER BY ord) AS main FROM sec WHERE section_id IS NOT NULL GROUP BY file_name),
    used AS (SELECT p.file_name, p.chunk_id, source_url, {_SEC} AS a, {_NUM} AS b, '| ' || p.chunk_id || ' | ' || coalesce(source_url, '') || ' | ' || replace(substr(coalesce(source_title, ''), 1, 60), '|', '\\|') || ' | ' || substr(coalesce(fetched_at, ''), 1, 10) || ' |' AS line
        FROM p JOIN ct USING (file_name, chunk_id)),
    refs AS (SELECT file_name, string_agg(line, chr(10) ORDER BY a, b, chunk_id, line) || chr(10) AS refs, count(DISTINCT source_url) AS n FROM used GROUP BY file_name),
    vc AS (SELECT file_name, verdict, count(*) AS n FROM (SELECT file_name, CASE WHEN ct.chunk_id IN (SELECT chunk_id FROM p WHERE p.file_name = ct.file_name) THEN 'PASS' ELSE 'MISSING_CHUNK' END AS verdict FROM ct) GROUP BY ALL),
    app AS (SELECT file_name, string_agg('  - ' || verdict || ': ' || n, chr(10) ORDER BY CASE verdict WHEN 'PASS' THEN 0 ELSE 3 END) AS lines FROM vc GROUP BY file_name),
    doc AS (SELECT main.file_name, '---' || chr(10) || 'topic: "' || main.file_name || '"' || chr(10) || 'date: "2025-01-01"' || chr(10) || 'research_tool: "in-session"' || chr(10) || 'cost: null' || chr(10) || 'sources_count: ' || coalesce(n, 0) || chr(10) || '---' || chr(10) || chr(10)
        || main || chr(10) || '## Sources' || chr(10) || chr(10) || '| ID | URL | Title | Access date |' || chr(10) || '|----|-----|-------|-------------|' || chr(10) || coalesce(refs, '')
        || chr(10) || '## Verification' || chr(10) || chr(10) || 'This document was produced by the research chain on 2025-01-01.' || chr(10) || coalesce(chr(10) || '### Fuzzy' || chr(10) || lines || chr(10), '') AS document
        FROM main LEFT JOIN refs USING (file_name) LEFT JOIN app USING (file_name))""".replace("{trim}", r"regexp_replace(body, '^\s+|\s+$', '', 'g')")


def _documents(spark, folder):
    d = _drafts(spark, folder).where("section_id is not null")
    s = d.groupBy("file_name", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "body"))), lambda x: x["body"]), " ").alias("body"))
    place = research.number(F.col("section_id"), r"^s(\d{1,5})$", 99)
    title = F.when(place == 1, "Context").when(place == 6, "Gaps & Caveats").otherwise(F.concat(F.lit("Part "), "section_id"))
    s = s.select("file_name", place.alias("ord"), title.alias("title"), "body")
    p, cited = pages(spark, folder), _cited(spark, folder)
    there = p.select("file_name", "chunk_id").distinct().withColumn("here", F.lit(True))
    n = cited.join(there, ["file_name", "chunk_id"], "left").select("file_name", F.when(F.col("here"), "PASS").otherwise("MISSING_CHUNK").alias("verdict")).groupBy("file_name", "verdict").agg(F.count("*").alias("n"))
    return research.stitch(s, research.sources_table(p, cited, "file_name"), "file_name", F.col("file_name"), "2025-01-01", counters=n.withColumn("stage", F.lit("fuzzy")))


@query(f"WITH {_STITCH} SELECT file_name, document FROM doc")
def stitched_documents(spark, folder):
    """One document a file: the drafts in section order, the sources they cite, and what the check of the citations found."""
    return _documents(spark, folder)


_RULES = rf"""parts AS (SELECT file_name, document, regexp_extract(document, '(?s)^---
(.*?)
---
', 1) AS front, regexp_replace(document, '(?s)^---
.*?
---
', '') AS body FROM doc),
    h AS (SELECT *, list_transform(regexp_extract_all(body, '(?m)^## [^
]+'), lambda x: trim(x)) AS h2, strpos(body, '## Sources') AS cut FROM parts),
    ids AS (SELECT *, list_distinct(flatten(list_transform(regexp_extract_all(CASE WHEN cut > 0 THEN substr(body, 1, cut - 1) ELSE body END, '\[(s\d+_c\d+(?:\s*,\s*s\d+_c\d+)*)\]', 1), lambda x: string_split_regex(x, '\s*,\s*')))) AS cited,
        list_distinct(regexp_extract_all(substr(body, cut), '\|\s*(s\d+_c\d+)\s*\|\s*https?://', 1)) AS listed FROM h),
    rules AS (SELECT file_name, unnest([CASE WHEN len(h2) > 0 AND h2[1] <> '## Context' THEN 'Context not first' END,
        CASE WHEN list_position(h2, '## Sources') > 0 AND list_position(h2, '## Sources') <= coalesce(list_position(h2, '## Context'), 0) THEN 'Sources before Context' END,
        CASE WHEN list_position(h2, '## Sources') - greatest(coalesce(list_position(h2, '## Context'), 0), 1) - 1 < 2 THEN 'too few sections' END, CASE WHEN len(listed) = 0 THEN 'no source rows' END,
        CASE WHEN len(list_filter(cited, lambda x: NOT list_contains(listed, x))) > 0 THEN 'citations without source' END,
        CASE WHEN len(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+')) < 3000 THEN 'too short' END, CASE WHEN NOT list_contains(h2, '## Gaps & Caveats') THEN 'no gaps section' END,
        CASE WHEN len(list_filter(listed, lambda x: NOT list_contains(cited, x))) > 0 THEN 'unused sources' END]) AS rule FROM ids)"""


@query(f"WITH {_STITCH}, {_RULES} SELECT file_name, rule FROM rules WHERE rule IS NOT NULL")
def contract_errors(spark, folder):
    """The rules of the final contract that each stitched document breaks, and what it is warned of."""
    v = research.validate(_documents(spark, folder), "file_name", "document")
    return v.select("file_name", F.explode(F.concat("errors", "warnings")).alias("rule"))


@query(rf"""WITH {_STITCH} SELECT file_name, regexp_extract(document, 'topic: "([^"]*)"', 1) AS topic, TRY_CAST(regexp_extract(document, 'sources_count: (\d+)', 1) AS INTEGER) AS sources, len(regexp_extract_all(document, '(?m)^## [^\n]+'))::INTEGER AS sections FROM doc""")
def document_heads(spark, folder):
    """The front matter of each stitched document read back, and its number of sections."""
    d = _documents(spark, folder).withColumn("m", research.front_matter(F.col("document")))
    return d.select("file_name", F.col("m")["topic"].alias("topic"), F.col("m")["sources_count"].try_cast("int").alias("sources"), F.size(F.regexp_extract_all("document", F.lit(r"(?m)^## [^\n]+"), 0)).alias("sections"))


@query(rf"WITH {_STITCH} SELECT file_name, 'deep_research_' || coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(file_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50), '_+$', ''), ''), 'project') || '_2025-01-01.md' AS name, len(regexp_extract_all(document, '[\p{{L}}\p{{N}}_]+'))::INTEGER AS words FROM doc")
def written_documents(spark, folder):
    """The stitched documents written as run copy and drop copy, and the drop copy read back."""
    import uuid

    from tarnwell.functions.text import tokens
    from tarnwell.session import shared_folder
    from tarnwell.sources.sinks import write_documents

    root = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    write_documents(_documents(spark, folder).withColumnRenamed("file_name", "run").withColumn("topic", F.col("run")), "run", "document", "topic", f"{root}/run", f"{root}/drop", "2025-01-01")
    back = spark.read.parquet(f"{root}/drop")
    return back.select(F.col("run").alias("file_name"), F.col("file_name").alias("name"), F.size(tokens(F.col("value"))).alias("words"))


@query(rf"""WITH p AS {PG} SELECT row_id, CASE WHEN NOT regexp_full_match(coalesce(section_id, 'none'), 's\d+') THEN 'section id' WHEN row_id % 5 = 0 THEN 'missing section' WHEN row_id % 11 = 0 THEN 'empty section' END AS problem,
    CASE WHEN row_id % 3 = 0 THEN NULL ELSE (row_id % 100)::INTEGER END AS word_count, CASE WHEN row_id % 5 = 0 THEN '' WHEN row_id % 11 = 0 THEN '' ELSE coalesce(chunk_id, 'x') || ' says' END AS body, 's1_c1;s2_c2' AS ids FROM p""")
def section_responses(spark, folder):
    """Responses of section writers, one a page: some lack the end of a block, some an id, some a number."""
    p = pages(spark, folder)
    n = F.col("row_id")
    count = F.when(n % 3 == 0, "many").otherwise((n % 100).cast("string"))
    body = F.when(n % 11 == 0, " ").otherwise(F.concat(F.coalesce("chunk_id", F.lit("x")), F.lit(" says")))
    t = F.concat_ws("\n", F.lit("Here:"), F.lit("---BEGIN_SECTION---"), body, F.when(n % 5 == 0, "").otherwise("---END_SECTION---"), F.lit("---BEGIN_SUMMARY---\nsum\n---END_SUMMARY---\n---METADATA---"), F.concat(F.lit("Word_count: "), count), F.lit("chunk_ids_cited: s1_c1, , s2_c2\n---END_METADATA---"))
    r = research.parse_response(p.select("row_id", F.coalesce("section_id", F.lit("none")).alias("sid"), t.alias("t")), "t", F.col("sid"))
    return r.select("row_id", "problem", "word_count", "body", F.array_join("chunk_ids_cited", ";").alias("ids"))


@query(rf"""WITH s AS (SELECT file_name, section_id, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')))::BIGINT AS words FROM {PG} WHERE text IS NOT NULL GROUP BY ALL), t AS (SELECT *, (round(sum(words) OVER (PARTITION BY file_name) / count(*) OVER (PARTITION BY file_name) / 50) * 50)::INTEGER AS target FROM s)
    SELECT file_name, section_id, target, abs(words - target) <= 0.25 * target AS within FROM t""")
def section_targets(spark, folder):
    """An even share of its file's words for each section, and whether the section is within a quarter of it."""
    from tarnwell.functions.text import tokens

    s = pages(spark, folder).where("text is not null").groupBy("file_name", "section_id").agg(F.sum(F.size(tokens(F.col("text")))).alias("words"))
    w = W.partitionBy("file_name")
    t = s.withColumn("target", research.target_words(F.sum("words").over(w), F.count("*").over(w)))
    return t.select("file_name", "section_id", "target", research.in_band(F.col("words"), F.col("target")).alias("within"))


@query(f"""WITH p AS {PG}, q AS (SELECT file_name, list_sort(list_distinct(list(sub_question_origin))) AS sub FROM p WHERE sub_question_origin IS NOT NULL GROUP BY file_name), n AS (SELECT file_name, sub, len(sub) AS q, 3 + len(sub) % 4 AS s FROM q)
    SELECT file_name, array_to_string(list_filter([CASE WHEN q NOT BETWEEN 10 AND 20 THEN '10 to 20 sub-questions' END, CASE WHEN s NOT BETWEEN 3 AND 5 THEN '3 to 5 sections' END, CASE WHEN q % 2 = 1 THEN 'ids in sequence' END,
        CASE WHEN s > q THEN 'a hint for each section' END], lambda x: x IS NOT NULL), ';') AS problems FROM n""")
def plan_rules(spark, folder):
    """Plans made of each file's questions, dealt to three to six sections; in odd ones the last id is wrong."""
    q = pages(spark, folder).where("sub_question_origin is not null").groupBy("file_name").agg(F.array_sort(F.collect_set("sub_question_origin")).alias("sub_questions"))
    plan = q.withColumn("n", F.size("sub_questions")).withColumn("s", 3 + F.col("n") % 4).select(
        F.col("file_name").alias("run"), "sub_questions",
        F.expr("transform(sequence(1, s), i -> named_struct('section_id', concat('s', if(i = s and n % 2 = 1, 99, i)), 'source_routing_hints', filter(sub_questions, (x, k) -> k % s = i - 1)))").alias("section_outline"),
    )
    return research.plan_problems(plan).select(F.col("run").alias("file_name"), F.array_join("problems", ";").alias("problems"))
