"""Queries on events, transcripts, routing by labels, redaction and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.operators import governance, routing
from tarnwell.plans.common import PG, SRC, pages, sources
from tarnwell.plans.registry import query
from tarnwell.sources.tables import table
from tarnwell.streaming import transcripts


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_json_extract(spark, folder):
    return table(spark, folder, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT user_id, max(ts) AS last_ts, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def latest_activity(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY ALL")
def last_event_per_kind(spark, folder):
    """The last event of each user and kind, as the last turn of each role."""
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS b, event_id FROM events),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
    SELECT user_id, session::BIGINT AS session, min(ts) AS began, count(*) AS n FROM s GROUP BY ALL""")
def session_rollup(spark, folder):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 1 DAY")
    e = table(spark, folder, "events").withColumn("b", F.when(gap, 1).otherwise(0)).withColumn("session", F.sum("b").over(w))
    return e.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT project AS memory, doc_id, length(text) AS n, sum(length(text)) OVER w AS newer, sum(length(text)) OVER (PARTITION BY project) AS total FROM documents WHERE project IS NOT NULL AND text IS NOT NULL
        WINDOW w AS (PARTITION BY project ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT memory, count(*) FILTER (WHERE total <= 10000 OR newer <= 8000) AS kept, count(*) FILTER (WHERE total > 10000 AND newer > 8000) AS archived FROM d GROUP BY memory""")
def memory_rotation(spark, folder):
    """A project's texts as its memory: above 10,000 characters the newest 8,000 stay, the rest is archived."""
    d = table(spark, folder, "documents").where("project is not null and text is not null")
    r = transcripts.rotate(d, "project", "doc_id", "text")
    return r.groupBy(F.col("project").alias("memory")).agg(F.count_if(F.col("keep")).alias("kept"), F.count_if(~F.col("keep")).alias("archived"))


@query("""WITH t AS (SELECT project AS memory, string_agg(text, chr(10) ORDER BY doc_id) AS s FROM documents WHERE project IS NOT NULL AND text IS NOT NULL GROUP BY project)
    SELECT memory, (CASE WHEN length(s) > 10000 THEN '[earlier memory omitted]' || chr(10) || substr(s, length(s) - 9999) ELSE s END) AS memory_text FROM t""")
def rehydrated_memory(spark, folder):
    d = table(spark, folder, "documents").where("project is not null and text is not null")
    return transcripts.rehydrate(d, "project", "doc_id", "text").select(F.col("project").alias("memory"), "memory_text")




_MINED = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS x FROM dd" for p in transcripts.DECISIONS)


@query(rf"""WITH dd AS (SELECT doc_id, text || ' We decided on ' || title || '.' AS text FROM documents WHERE text IS NOT NULL AND title IS NOT NULL), d AS ({_MINED}),
    c AS (SELECT doc_id, trim(x) AS x FROM d WHERE length(trim(x)) BETWEEN 3 AND 200) SELECT DISTINCT doc_id, trim(regexp_replace(x, '[*`"]+', '', 'g')) AS decision FROM c WHERE trim(regexp_replace(x, '[*`"]+', '', 'g')) <> ''""")
def decision_mining(spark, folder):
    """Decisions in the documents, each of which ends with one on its title."""
    d = table(spark, folder, "documents").where("text is not null and title is not null")
    return transcripts.decisions(d.select("doc_id", F.concat("text", F.lit(" We decided on "), "title", F.lit(".")).alias("text")), "doc_id", "text")


@query(f"""WITH p AS {PG}, s AS (SELECT file_name, section_id, max(length(text)) AS bytes FROM p WHERE section_id IN ('s1', 's2', 's3') GROUP BY ALL)
    SELECT file_name, count(*) = 3 AND min(bytes) >= 50 AS complete FROM s GROUP BY file_name""")
def completion_barrier(spark, folder):
    """Whether a file has drafts of 50 characters and more for all of its first three sections."""
    d = pages(spark, folder).groupBy("file_name", "section_id").agg(F.max(F.char_length("text")).alias("bytes"))
    return transcripts.complete(d.where("section_id in ('s1', 's2', 's3')"), "file_name", ["s1", "s2", "s3"], "section_id", "bytes")


@query(rf"""WITH p AS {PG} SELECT file_name, section_id, count(*) AS rows, count(*) FILTER (WHERE k > 1 OR row_id % 4 <> 0) AS open FROM (SELECT *, row_number() OVER (PARTITION BY file_name, section_id ORDER BY row_id DESC) AS k FROM p WHERE regexp_matches(section_id, '^s\d+$'))
    GROUP BY ALL""".replace("count(*) FILTER (WHERE k > 1 OR row_id % 4 <> 0) AS open", "count(*) - CASE WHEN bool_or(row_id % 4 = 0) THEN 1 ELSE 0 END AS open"))
def start_registry(spark, folder):
    """Writers started for each section, by the section that their prompt names, and how many are open after the stops (every fourth page's)."""
    p = pages(spark, folder)
    prompt = F.concat(F.lit("Write it.\nsection_id: "), F.coalesce("section_id", F.lit("none")), F.lit("\nGo on."))
    reg = transcripts.started(p.select("file_name", prompt.alias("prompt"), F.col("row_id").alias("at")), "file_name", "prompt", "at")
    stops = p.where((F.col("row_id") % 4 == 0) & F.col("section_id").rlike(r"^s\d+$")).select("file_name", "section_id")
    return transcripts.closed(reg, stops, "file_name").groupBy("file_name", "section_id").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "started").alias("open"))


# routing by labels

_CUES = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v.split())}])" for k, v in routing.CUES.items())


def _typed(head: str) -> str:
    """Kinds of the documents by the cue words in ``head`` of their text; doc_ids that repeat count once."""
    return f"""cue(label, w) AS (VALUES {_CUES}), d AS (SELECT DISTINCT doc_id, text FROM documents), t AS (SELECT doc_id, text, list_distinct(regexp_split_to_array(lower({head}), '[^\\p{{L}}\\p{{N}}@#]+')) AS w FROM d),
    s AS (SELECT doc_id, text, label, coalesce(1 / (1 + exp(-(len(list_intersect(t.w, cue.w)) - 1.5))), 0) AS p FROM t, cue),
    r AS (SELECT *, row_number() OVER k AS r, lead(p) OVER k AS second FROM s WINDOW k AS (PARTITION BY doc_id ORDER BY round(p, 9) DESC, label)),
    st AS (SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'article' ELSE label END AS source_type, round(CASE WHEN coalesce(trim(text), '') = '' THEN 0 ELSE p END, 9) AS confidence, p, second, label FROM r WHERE r = 1)"""


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text").distinct()


@query(f"WITH {_typed('substr(text, 1, 500)')} SELECT doc_id, source_type, confidence FROM st")
def source_type_guess(spark, folder):
    """The kind of each document from its head, which is what the classifier is given (its contract, not a cut to save work)."""
    return routing.source_type(_docs(spark, folder), "doc_id", "text").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {_typed('substr(text, 1, 500)')} SELECT o.source_type, st.source_type AS guess, count(*) AS n, count(*) FILTER (WHERE confidence < 0.4) AS unsure FROM (SELECT DISTINCT doc_id, source_type FROM documents) o JOIN st USING (doc_id) WHERE o.source_type IS NOT NULL GROUP BY ALL")
def source_type_accuracy(spark, folder):
    g = routing.source_type(_docs(spark, folder), "doc_id", "text").withColumnRenamed("source_type", "guess")
    d = table(spark, folder, "documents").where("source_type is not null").select("doc_id", "source_type").distinct()
    return d.join(g, "doc_id").groupBy("source_type", "guess").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.4).alias("unsure"))


_FOCUS = " ".join(f"WHEN {k!r} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in routing.FOCUS.items())


@query(f"WITH {_typed('substr(text, 1, 500)')} SELECT doc_id, CASE source_type {_FOCUS} END AS focus, confidence < 0.4 AS unsure FROM st")
def extraction_focus(spark, folder):
    """What to take from each document by its guessed kind, and whether the guess is unsure."""
    return routing.focus(routing.source_type(_docs(spark, folder), "doc_id", "text")).select("doc_id", "focus", "unsure")


@query(f"WITH {_typed('text')} SELECT doc_id, label, round(p, 6) AS p, round(round(p, 6) - round(second, 6), 6) AS margin, coalesce(p >= 0.7 AND round(p - second, 6) >= 0.15, false) AS passes FROM st")
def label_gate(spark, folder):
    """The best label of each whole text, its margin, and whether it passes the gate."""
    g = routing.gate(routing.classify(_docs(spark, folder), "doc_id", F.col("text"), list(routing.SOURCE_TYPES), True).withColumn("p", F.round("p", 6)), "doc_id", "label", "p")
    return g.select("doc_id", "label", "p", F.round("margin", 6).alias("margin"), "passes")


@query(f"WITH {_typed('text')} SELECT doc_id, label, round(exp(p) / sum(exp(p)) OVER (PARTITION BY doc_id), 6) AS p FROM s")
def label_probabilities(spark, folder):
    """One label only: the softmax over the labels of each document."""
    return routing.classify(_docs(spark, folder), "doc_id", F.col("text"), list(routing.SOURCE_TYPES)).select("doc_id", "label", F.round("p", 6).alias("p"))


@query(r"""WITH t AS (SELECT DISTINCT doc_id, text, title FROM documents WHERE text IS NOT NULL), x AS (SELECT *, doc_id % 3 AS k, trim(regexp_replace(title, '\s+', ' ', 'g')) AS flat FROM t)
    SELECT doc_id, nullif(CASE WHEN title IS NULL THEN NULL WHEN k = 1 THEN trim(regexp_extract(flat, '^([^''"]*)', 1)) ELSE trim(regexp_extract(flat, '^([^<]*)', 1)) END, '') AS title FROM x WHERE NOT regexp_matches(text, '(?i)<title|(^|\n)\s*# |(^|\n)title:') AND NOT regexp_matches(coalesce(title, ''), '[<''"]')""")
def stated_titles(spark, folder):
    """The titles that texts state: in HTML, as a title field, as a heading, by turns; texts that have such marks of their own are left out."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", "title").distinct()
    d = d.where(~F.col("text").rlike(r"(?i)<title|(^|\n)\s*# |(^|\n)title:") & ~F.coalesce("title", F.lit("")).rlike("[<'\"]"))
    k = F.col("doc_id") % 3
    t = F.when(F.col("title").isNull(), F.col("text")).when(k == 0, F.concat(F.lit("<html><Title lang='x'>"), "title", F.lit("</TITLE>"), "text")).when(k == 1, F.concat(F.lit("---\ntitle: \""), "title", F.lit("\"\n---\n"), "text")).otherwise(F.concat(F.lit("\n # "), "title", F.lit("\n"), "text"))
    return d.select("doc_id", routing.content_title(t).alias("title"))


_SW = "'" + "','".join(routing.STOPWORDS) + "'"


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(title, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_''-]*'), lambda w: lower(w) NOT IN ({_SW})) AS w FROM documents WHERE title IS NOT NULL),
    u AS (SELECT doc_id, w[greatest(1, len(w) - 2):len(w)] AS w FROM t WHERE len(w) > 0)
    SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN x = upper(x) AND length(x) >= 2 AND regexp_matches(x, '\p{{L}}') THEN x ELSE upper(x[1:1]) || lower(x[2:]) END), ' ') AS name FROM u""")
def project_names(spark, folder):
    """The name that a project would get from a document's title."""
    d = table(spark, folder, "documents").where("title is not null")
    name = routing.project_name(F.concat(F.lit("# "), "title"), "20250101")
    return d.select("doc_id", name.alias("name")).where(~F.col("name").startswith("Untitled Project "))


# redaction and audits


_PATTERNS = ["archive/**", "clips/*/*.html", "papers", "notes/?.md", "**/*.md"]
_WHERE = [r"regexp_matches(fp, '^archive/.*$')", r"regexp_matches(fp, '^clips/[^/]*/[^/]*\.html$')", "fp = 'papers' OR starts_with(fp, 'papers/')", r"regexp_matches(fp, '^notes/.\.md$')", r"regexp_matches(fp, '^.*/[^/]*\.md$')"]


@query(f"WITH s AS (SELECT id, replace(file_path, chr(92), '/') AS fp, file_path, ingest_ts FROM {SRC}) " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(DISTINCT file_path) AS files, count(DISTINCT file_path) > 20 OR {p in ('archive/**', 'papers')} AS escalate, count(DISTINCT date_trunc('day', ingest_ts)) AS commits FROM s WHERE {w}" for p, w in zip(_PATTERNS, _WHERE, strict=True)))
def redact_preview(spark, folder):
    """What each of five patterns would take, whether it needs a second look, and how many commits (days of ingest) touch it."""
    s = sources(spark, folder)
    days = s.select(F.date_trunc("day", "ingest_ts").alias("commit"), "file_path")
    out = None
    for p in _PATTERNS:
        one = governance.preview(s, "file_path", p, commits=days)
        out = one if out is None else out.unionByName(one)
    return out


@query(rf"SELECT id FROM {SRC} WHERE file_path IS NULL OR NOT regexp_matches(file_path, '^clips/[^\\/]*/[^\\/]*\.html$')")
def redact_purge(spark, folder):
    kept, _ = governance.redact(sources(spark, folder), "file_path", "clips/*/*.html", "2025-01-01", dry_run=False)
    return kept.select("id")


@query(rf"SELECT DISTINCT file_path, substr(sha256(file_path), 1, 16) AS path_hash, '2025-01-01' AS redacted_at, false AS dry_run FROM {SRC} WHERE regexp_matches(file_path, '^clips/[^\\/]*/[^\\/]*\.html$')")
def tombstones(spark, folder):
    return governance.redact(sources(spark, folder), "file_path", "clips/*/*.html", "2025-01-01", dry_run=False)[1]


@query(f"SELECT id, CASE WHEN file_path IS NULL OR trim(file_path) = '' OR id % 3 = 1 THEN 'allow' WHEN id % 3 = 2 THEN 'path_boundary_violation' WHEN starts_with(replace(lower(file_path), chr(92), '/'), 'papers/') THEN 'allow' ELSE 'path_boundary_violation' END AS verdict FROM {SRC}")
def boundary_audit(spark, folder):
    """Every source's path as the target of a write that may only go below papers: as it is, led there by dots, led away by dots."""
    k = F.col("id") % 3
    path = F.when(F.trim("file_path") == "", F.col("file_path")).when(k == 1, F.concat(F.lit("x/../PAPERS/./"), "file_path")).when(k == 2, F.concat(F.lit("papers/../more/"), "file_path")).otherwise(F.col("file_path"))
    return sources(spark, folder).select("id", governance.audit(F.lit("Write"), F.lit(None).cast("string"), path, "papers").alias("verdict"))


_COMMANDS = {"git status": "allow", "git push": "unsafe_git", "git show HEAD": "allow", "GIT commit -m x": "allow", "git commit x": "unsafe_git", "ls && rm x": "compound_command", "uv run y": "allow", "python scripts/z.py": "allow", "curl x": "unauthorized_shell", "git log --oneline -5": "allow", "git log": "unsafe_git", "echo `x`": "compound_command"}


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'allow' ELSE CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_COMMANDS.values())) + " END END AS verdict FROM events")
def command_audit(spark, folder):
    """A command for each event, dealt from a list, judged by the governor; views run no command."""
    cmd = F.array(*[F.lit(x) for x in _COMMANDS])[(F.col("event_id") % 12).cast("int")]
    tool = F.when(F.col("event_type") == "view", "Read").otherwise("Bash")
    return table(spark, folder, "events").select("event_id", governance.audit(tool, cmd, F.lit(None).cast("string"), "papers").alias("verdict"))


@query("""SELECT user_id, CASE WHEN h >= 720 THEN 'EXPIRED' WHEN h >= 336 THEN 'WARN' ELSE 'VALID' END AS state FROM (SELECT user_id, epoch(TIMESTAMP '2024-02-10' - max(ts)) / 3600 AS h FROM events GROUP BY user_id)""")
def token_expiry(spark, folder):
    """The age of each user's last event as that of a token."""
    last = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    hours = (F.unix_timestamp(F.to_timestamp_ntz(F.lit("2024-02-10")).cast("timestamp")) - F.unix_timestamp(F.col("t").cast("timestamp"))) / 3600
    return last.select("user_id", governance.expiry(hours, F.lit(None).cast("double")).alias("state"))


@query(rf"SELECT row_id, trim(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text FROM {PG} WHERE text IS NOT NULL")
def html_stripped(spark, folder):
    """Pages wrapped into HTML, a block a line, with a head, a script and a comment, and stripped again."""
    from tarnwell.sources.extract import strip_html

    p = pages(spark, folder).where("text is not null")
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    h = p.select("row_id", F.concat(F.lit("<html><head><title>x</title></head><body><script>if (a<b) var a = '</p>';</script><!-- <p>no</p> --><p class=\"a>b\">"), F.regexp_replace(esc, "\n", "</p><P>"), F.lit("</p></body></html>")).alias("text"))
    return strip_html(h, "text").select("row_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


# streams: the events file read as a stream and drained


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def stream_daily_counts(spark, folder):
    """Counts by day and kind through a watermarked stream: the days that are over, the last one is still open."""
    from tarnwell.streaming import jobs

    e = jobs.read_table_stream(spark, folder, "events")
    return jobs.drained(jobs.windowed_counts(e, "ts", "1 day", "event_type", "value"), "daily").select(F.col("began").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, count(*) AS n, min(ts) AS completed_ts FROM (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, ts FROM events ORDER BY user_id, event_type, ts) GROUP BY user_id HAVING count(*) = 5".replace("min(ts)", "max(ts)"))
def stream_completion(spark, folder):
    """Users who have had all five kinds of events, told once, with the moment the last kind came."""
    from tarnwell.streaming import jobs

    e = jobs.read_table_stream(spark, folder, "events")
    done = jobs.completion(e, "user_id", "event_type", "ts", ["click", "error", "purchase", "signup", "view"])
    return jobs.drained(done, "completion").select("user_id", "n", "completed_ts")


@query("""WITH e AS (SELECT user_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(sum(value * CASE WHEN i = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - i) END), 4) AS level FROM e GROUP BY user_id""")
def stream_moving_level(spark, folder):
    """A moving mean (alpha 0.1) of each user's values in order of time, kept as state of a stream."""
    from tarnwell.streaming import jobs

    e = jobs.read_table_stream(spark, folder, "events")
    return jobs.latest(jobs.drained(jobs.moving_level(e, "user_id", "value", ["ts", "event_id"], 0.1), "level", mode="update"), "user_id", "seen").select("user_id", F.round("level", 4).alias("level"))
