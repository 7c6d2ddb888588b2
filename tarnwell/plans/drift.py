"""Queries on schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.operators import drift
from tarnwell.plans.registry import query
from tarnwell.sources.tables import table


#: The names that the searchers use, as the SQL knows them; the operator goes by content first and has its own list.
_NAMES = {
    "chunk_id": "chunk_id id chunkId cid passage_id chunk_key ref", "section_id": "section_id section sec sectionId", "source_url": "source_url url link href page_url",
    "source_title": "source_title title page_title headline", "fetched_at": "fetched_at date retrieved fetch_time accessed crawled_on fetchedAt",
    "sub_question_origin": "sub_question_origin subquestion topic subQuestion asked origin_q question", "text": "text extract body content_text passage",
}


def _role(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN (" + ", ".join(f"'{n}'" for n in names.split()) + f") THEN '{role}'" for role, names in _NAMES.items()) + f" ELSE {c} END"


_FOUND = f"""WITH raw AS (SELECT DISTINCT ON (raw_id) searcher, file_name, written_ts, TRY_CAST(payload AS JSON) AS j FROM searcher_raw),
    env AS (SELECT searcher, file_name, written_ts, unnest(CASE WHEN json_type(j, '$.chunks') = 'ARRAY' THEN json_extract(j, '$.chunks[*]') ELSE [j] END) AS j FROM raw WHERE j IS NOT NULL),
    rec AS (SELECT * FROM env WHERE json_type(j) = 'OBJECT'),
    keyed AS (SELECT searcher, file_name, written_ts, j, unnest(json_keys(j)) AS field FROM rec),
    typed AS (SELECT searcher, file_name, written_ts, field, CASE json_type(json_extract(j, '$."' || field || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array'
        WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS type FROM keyed),
    prof AS (SELECT searcher, file_name, field, mode(type) AS type FROM typed GROUP BY ALL),
    files AS (SELECT searcher, file_name, row_number() OVER (PARTITION BY searcher ORDER BY min(written_ts), file_name) AS seq FROM typed GROUP BY searcher, file_name),
    p AS (SELECT searcher, seq, field, type, {_role("field")} AS role FROM prof JOIN files USING (searcher, file_name)),
    both_ AS (SELECT coalesce(n.searcher, o.searcher) AS searcher, coalesce(n.seq, o.seq + 1) AS seq, n.field AS nf, o.field AS f0, n.type AS nt, o.type AS ot, coalesce(n.role, o.role) AS role
        FROM p n FULL JOIN p o ON n.searcher = o.searcher AND n.seq = o.seq + 1 AND n.field = o.field),
    b AS (SELECT both_.*, file_name FROM both_ JOIN files USING (searcher, seq) WHERE seq > 1),
    come AS (SELECT *, row_number() OVER (PARTITION BY searcher, seq, role ORDER BY nf) AS k FROM b WHERE f0 IS NULL),
    gone AS (SELECT *, row_number() OVER (PARTITION BY searcher, seq, role ORDER BY f0) AS k FROM b WHERE nf IS NULL)
    SELECT DISTINCT file_name, nf AS field, 'retyped' AS change FROM b WHERE nt <> ot
    UNION SELECT coalesce(c.file_name, g.file_name), coalesce(c.nf, g.f0), CASE WHEN c.nf IS NULL THEN 'removed' WHEN g.f0 IS NULL THEN 'added' ELSE 'renamed' END
        FROM come c FULL JOIN gone g ON c.searcher = g.searcher AND c.seq = g.seq AND c.role = g.role AND c.k = g.k"""


@query(_FOUND)
def p3_found(spark, folder):
    return drift.changes(table(spark, folder, "searcher_raw")).select("file_name", "field", "change").distinct()


_CHANGES = _FOUND.index("SELECT DISTINCT file_name, nf AS field")
_VERSION = _FOUND[:_CHANGES].rstrip() + """, fs AS (SELECT searcher, seq, string_agg(field || ':' || coalesce(type, 'null'), ',' ORDER BY field) AS schema FROM p GROUP BY ALL),
    vs AS (SELECT f.*, file_name, CASE WHEN lag(schema) OVER w IS NULL OR lag(schema) OVER w <> schema THEN 1 ELSE 0 END AS began FROM fs f JOIN files USING (searcher, seq) WINDOW w AS (PARTITION BY f.searcher ORDER BY f.seq)),
    vn AS (SELECT *, sum(began) OVER (PARTITION BY searcher ORDER BY seq) AS version FROM vs)"""


@query(_VERSION + " SELECT searcher, version::INTEGER AS version, substr(sha256(schema), 1, 16) AS fingerprint, schema, arg_min(file_name, seq) AS first_file, count(*) AS files FROM vn GROUP BY searcher, version, schema")
def p3_versions(spark, folder):
    """The versions of each searcher's schema in order."""
    return drift.versions(table(spark, folder, "searcher_raw")).drop("steps")


@query(_VERSION + ", ch AS (" + _FOUND[_CHANGES:] + ")" + " SELECT searcher, version::INTEGER AS version, count(change) AS steps FROM (SELECT searcher, version, arg_min(file_name, seq) AS file_name FROM vn GROUP BY ALL) LEFT JOIN ch USING (file_name) GROUP BY ALL")
def p3_steps(spark, folder):
    """How many migration steps lead to each version from the one before it."""
    v = drift.versions(table(spark, folder, "searcher_raw"))
    return v.select("searcher", "version", F.when(F.col("steps") == "", 0).otherwise(F.size(F.split("steps", ";"))).cast("long").alias("steps"))


_VALUE = "CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') ELSE x::VARCHAR END"
_TABLE = f"""WITH raw AS (SELECT DISTINCT ON (raw_id) raw_id, searcher, file_name, TRY_CAST(payload AS JSON) AS j FROM searcher_raw), env0 AS (SELECT raw_id, file_name, CASE WHEN json_type(j, '$.chunks') = 'ARRAY' THEN json_extract(j, '$.chunks[*]') ELSE [j] END AS a FROM raw WHERE j IS NOT NULL),
    env AS (SELECT raw_id, file_name, unnest(range(len(a))) AS pos, unnest(a) AS j FROM env0), rec AS (SELECT * FROM env WHERE json_type(j) = 'OBJECT'),
    kv0 AS (SELECT raw_id, pos, unnest(json_keys(j)) AS field, j FROM rec), kv1 AS (SELECT raw_id, pos, field, json_extract(j, '$."' || field || '"') AS x FROM kv0), kv AS (SELECT raw_id, pos, field, {_role("field")} AS role, json_type(x) AS kind, x, {_VALUE} AS v FROM kv1 WHERE json_type(x) <> 'NULL'),
    one AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY raw_id, pos, role ORDER BY field <> role, field) = 1),
    w AS (SELECT raw_id, pos, {", ".join(f"max(v) FILTER (WHERE role = '{r}') AS {r}, max(kind) FILTER (WHERE role = '{r}') AS {r}_k" for r in _NAMES)} FROM one GROUP BY ALL),
    al AS (SELECT rec.raw_id, rec.pos, rec.file_name, w.* EXCLUDE (raw_id, pos) FROM rec LEFT JOIN w USING (raw_id, pos)),
    c AS (SELECT *, CASE WHEN chunk_id_k = 'OBJECT' THEN json_extract_string(chunk_id, '$.s') || '_c' || json_extract_string(chunk_id, '$.c') WHEN regexp_full_match(chunk_id, '\\d{{4,10}}') THEN 's' || (chunk_id::BIGINT // 1000) || '_c' || (chunk_id::BIGINT % 1000) ELSE chunk_id END AS cid,
        CASE WHEN fetched_at_k = 'OBJECT' THEN json_extract_string(fetched_at, '$.day') || 'T' || json_extract_string(fetched_at, '$.clock') || ':00Z'
            WHEN regexp_full_match(fetched_at, '\\d{{9,14}}') THEN strftime(epoch_ms(CASE WHEN fetched_at::BIGINT > 100000000000 THEN fetched_at::BIGINT // 1000 ELSE fetched_at::BIGINT END * 1000), '%Y-%m-%dT%H:%M:%SZ')
            ELSE regexp_replace(regexp_replace(regexp_replace(fetched_at, '^(\\d{{4}}-\\d\\d-\\d\\d) ', '\\1T'), '\\+00:00$', 'Z'), '(T\\d\\d:\\d\\d:\\d\\d)$', '\\1Z') END AS at,
        CASE sub_question_origin_k WHEN 'ARRAY' THEN json_extract_string(sub_question_origin, '$[0]') WHEN 'OBJECT' THEN json_extract_string(sub_question_origin, '$.q') ELSE sub_question_origin END AS q FROM al)
    SELECT raw_id, pos::INTEGER AS pos, file_name, cid AS chunk_id, coalesce(section_id, nullif(regexp_extract(cid, '^(s\\d+)_', 1), '')) AS section_id, source_url, source_title, at AS fetched_at, coalesce(q, 'unrecorded') AS sub_question_origin, text FROM c"""


@query(_TABLE.replace("AS at,", "AS fa,").replace("at AS fetched_at", "fa AS fetched_at"))
def p3_table(spark, folder):
    """All records in the columns of the searchers' canonical schema."""
    return drift.consistent(table(spark, folder, "searcher_raw")).drop("changed")
