"""The research chain: tolerant records, merge and order, responses, stitching, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.config import RetrievalConfig
from tarnwell.functions.text import strip

#: Other names of the canonical fields that searchers write.
ALIASES = {
    "chunk_id": ["chunk_id", "id"], "section_id": ["section_id", "section"], "source_url": ["source_url", "url"], "source_title": ["source_title", "title"],
    "fetched_at": ["fetched_at", "date"], "sub_question_origin": ["sub_question_origin", "subquestion", "topic"], "text": ["text", "extract"],
}
REQUIRED = ["chunk_id", "section_id", "source_url", "source_title", "text"]
#: What stands where a searcher recorded no date and no question.
DEFAULTS = {"fetched_at": "2026-01-01T00:00:00Z", "sub_question_origin": "(not recorded)"}


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def normalise(records: DataFrame, cfg: RetrievalConfig | None = None) -> DataFrame:
    """``records`` with a map ``r`` of text values become canonical columns and ``reason``, null for the accepted.

    Aliases fall through empty values; two fields have defaults; five are required; short texts are refused.
    """
    cfg = cfg or RetrievalConfig()
    pick = {k: first_filled(*[F.try_element_at("r", F.lit(a)) for a in names]) for k, names in ALIASES.items()}
    out = records.select(*[c for c in records.columns if c != "r"], *[F.coalesce(v, F.lit(DEFAULTS[k])).alias(k) if k in DEFAULTS else v.alias(k) for k, v in pick.items()])
    lacking = F.array_join(F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED])), ",")
    return out.withColumn("reason", F.when(lacking != "", F.concat(F.lit("missing "), lacking)).when(F.char_length("text") < cfg.merged_min_chars, F.lit("short text")))


def number(c: Column, pattern: str, missing: int) -> Column:
    """The number that ``pattern`` finds, ``missing`` if it finds none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int"), F.lit(missing))


def reading_order(section: Column, chunk: Column) -> list[Column]:
    """By section number, 99 where there is none, then by chunk number, 999 where there is none."""
    return [number(section, r"^s(\d{1,5})$", 99), number(chunk, r"_c(\d{1,5})$", 999)]


def renumber(chunks: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """If any chunk_id of a scope repeats, all its chunks are renumbered section by section in ``order``."""
    repeated = F.count("*").over(W.partitionBy(scope, "chunk_id")) > 1
    w = W.partitionBy(scope, "section_id").orderBy(*order)
    d = chunks.withColumn("_d", repeated).withColumn("_any", F.max("_d").over(W.partitionBy(scope))).withColumn("_n", F.row_number().over(w))
    return d.withColumn("chunk_id", F.when(F.col("_any"), F.concat("section_id", F.lit("_c"), "_n")).otherwise(F.col("chunk_id"))).drop("_d", "_any", "_n")


def pending(plan: DataFrame, counts: DataFrame, run: str) -> DataFrame:
    """(run, all_sections, with_chunks, framing, total): framing sections are those of the plan without chunks, in plan order."""
    j = plan.join(counts, [run, "section_id"], "left")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "section_id")))), lambda x: x["section_id"])
    have = counts.groupBy(run).agg(F.array_sort(F.collect_set("section_id")).alias("with_chunks"), F.sum("n").alias("total"))
    return j.groupBy(run).agg(ordered(F.lit(True)).alias("all_sections"), ordered(F.col("n").isNull()).alias("framing")).join(have, run, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def merge(records: DataFrame, plan: DataFrame, run: str, order: list[str], cfg: RetrievalConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, pending, rejects) of the searchers' records of many runs.

    Records become canonical, those that lack something or are short are refused with the reason. If an id repeats
    in a run all its chunks are numbered anew in ``order``. ``place`` is the reading order; ``pending`` tells which
    sections of the plan have chunks and which only frame.
    """
    n = normalise(records, cfg)
    chunks = renumber(n.where("reason is null").drop("reason"), run, order)
    place = F.row_number().over(W.partitionBy(run).orderBy(*reading_order(F.col("section_id"), F.col("chunk_id")), *order))
    chunks = chunks.withColumn("place", place)
    counts = chunks.groupBy(run, "section_id").agg(F.count("*").alias("n"))
    return chunks, pending(plan, counts, run), n.where("reason is not null")


#: The blocks of a section response and the lines that enclose them.
BLOCKS = {"section": ("---BEGIN_SECTION---", "---END_SECTION---"), "summary": ("---BEGIN_SUMMARY---", "---END_SUMMARY---"), "metadata": ("---METADATA---", "---END_METADATA---")}
#: Metadata that are numbers, and those that are lists of ids.
NUMBERS, LISTS = ["word_count", "distinct_chunks_cited"], ["chunk_ids_cited"]


def parse_response(df: DataFrame, text: str, section_id: str) -> DataFrame:
    """Adds body, summary, metadata, word_count, distinct_chunks_cited, chunk_ids_cited and problem.

    ``problem`` is null for a good response, else what is wrong with it: an empty response, an id that isn't
    s<number>, missing blocks, an empty section or summary. Metadata keys are in lower case, unknown ones are kept;
    the two numbers are null where they can't be read (their text stays in ``metadata``), the ids have no blanks.
    """
    t = F.col(text)
    got = {k: F.regexp_extract(t, rf"(?s)({a}\s*\n(.*?)\n{z})", 2) for k, (a, z) in BLOCKS.items()}
    there = {k: t.rlike(rf"(?s){a}\s*\n(.*?)\n{z}") for k, (a, z) in BLOCKS.items()}
    line = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:\s*(.+?)\s*$"
    pairs = F.filter(F.transform(F.split(got["metadata"], "\n"), lambda x: F.struct(F.lower(F.regexp_extract(x, line, 1)).alias("k"), F.regexp_extract(x, line, 2).alias("v"))), lambda p: p["k"] != "")
    # of a key that repeats the last line counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    lacking = F.array_join(F.array_compact(F.array(*[F.when(~there[k], F.lit(k)) for k in BLOCKS])), ",")
    d = df.withColumn("body", strip(got["section"])).withColumn("summary", strip(got["summary"])).withColumn("metadata", F.map_from_entries(last))
    for k in NUMBERS:
        d = d.withColumn(k, F.try_element_at("metadata", F.lit(k)).try_cast("int"))
    for k in LISTS:
        d = d.withColumn(k, F.filter(F.transform(F.split(F.try_element_at("metadata", F.lit(k)), ","), lambda x: F.trim(x)), lambda x: x != ""))
    problem = (
        F.when(F.coalesce(strip(t), F.lit("")) == "", "empty response").when(~F.coalesce(F.trim(section_id).rlike(r"^s\d+$"), F.lit(False)), "section id")
        .when(lacking != "", F.concat(F.lit("missing "), lacking)).when(F.col("body") == "", "empty section").when(F.col("summary") == "", "empty summary")
    )
    return d.withColumn("problem", problem)


def front_matter(c: Column) -> Column:
    """The front matter as a map of its lines' keys and values, quotes off; null where a text has none."""
    raw = F.regexp_extract(c, r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.transform(F.regexp_extract_all(raw, F.lit(r"(?m)^([A-Za-z_]\w*):[ \t]*(.*)$"), 0), lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.regexp_replace(F.regexp_replace(x, r"^\w+:[ \t]*", ""), r"^[\"'](.*)[\"']$", "$1").alias("v")))
    unique = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.when(c.rlike(r"(?s)^---\n(.*?)\n---\n"), F.map_from_entries(unique))


def sources_table(chunks: DataFrame, cited: DataFrame, scope: str) -> DataFrame:
    """Rows of the sources table: chunks that are cited, titles cut to 60 and pipes escaped, dates to the day, in reading order."""
    rows = chunks.join(cited.select(scope, "chunk_id").distinct(), [scope, "chunk_id"], "left_semi")
    a, b = reading_order(F.col("section_id"), F.col("chunk_id"))
    title = F.regexp_replace(F.substring(F.coalesce("source_title", F.lit("")), 1, 60), r"\|", r"\\|")
    line = F.concat(F.lit("| "), "chunk_id", F.lit(" | "), F.coalesce("source_url", F.lit("")), F.lit(" | "), title, F.lit(" | "), F.substring(F.coalesce("fetched_at", F.lit("")), 1, 10), F.lit(" |"))
    return rows.select(scope, "chunk_id", "source_url", a.alias("sec"), b.alias("num"), line.alias("line"))


#: Counters of a verification report that the appendix lists, in this order.
COUNTERS = {"fuzzy": ["PASS", "AMBIGUOUS", "FAIL", "MISSING_CHUNK"], "judge": ["SUPPORTED", "PARTIAL", "CONTRADICTED", "UNRELATED"]}


def appendix(scope: str, documents: DataFrame, counters: DataFrame | None, date: str) -> DataFrame:
    """(scope, appendix): what the verification found. ``counters`` has (scope, stage, verdict, n); stages without a row are left out."""
    intro = F.lit(f"\n## Verification\n\nThis document was produced by the research chain on {date}.\n")
    if counters is None:
        return documents.select(scope, intro.alias("appendix"))
    place = F.create_map(*[F.lit(x) for k, names in COUNTERS.items() for i, v in enumerate(names) for x in (f"{k}/{v}", i)])
    own = counters.withColumn("_o", F.try_element_at(place, F.concat_ws("/", "stage", "verdict"))).where("_o is not null")
    listed = own.groupBy(scope, "stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.concat(F.lit("  - "), "verdict", F.lit(": "), "n").alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    part = F.concat(F.lit("### "), F.initcap("stage"), F.lit("\n"), "lines", F.lit("\n"))
    text = listed.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", part.alias("t")))), lambda x: x["t"]), "\n").alias("_a"))
    return documents.select(scope).join(text, scope, "left").select(scope, F.concat(intro, F.coalesce(F.concat(F.lit("\n"), "_a"), F.lit(""))).alias("appendix"))


def stitch(sections: DataFrame, table_rows: DataFrame, scope: str, topic: Column, date: str, tool: str = "in-session", counters: DataFrame | None = None) -> DataFrame:
    """(scope, document): front matter, the sections in plan order under their titles, the sources cited, the verification.

    ``sections`` has scope, ord, title and body; sections without a body are left out. The topic stands in quotes as
    it is, the cost is null.
    """
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    text = F.struct("ord", F.concat(F.lit("## "), "title", F.lit("\n\n"), strip(F.col("body")), F.lit("\n")).alias("t"))
    main = sections.where("body is not null").groupBy(scope).agg(join(text).alias("main"), F.first(topic, True).alias("topic"))
    refs = table_rows.groupBy(scope).agg(join(F.struct("sec", "num", "chunk_id", F.col("line").alias("t"))).alias("refs"), F.count_distinct("source_url").alias("n"))
    head = F.concat(F.lit('---\ntopic: "'), "topic", F.lit(f'"\ndate: "{date}"\nresearch_tool: "{tool}"\ncost: null\nsources_count: '), F.coalesce("n", F.lit(0)), F.lit("\n---\n\n"))
    end = F.concat(F.lit("\n## Sources\n\n| ID | URL | Title | Access date |\n|----|-----|-------|-------------|\n"), F.coalesce(F.concat("refs", F.lit("\n")), F.lit("")))
    return main.join(refs, scope, "left").join(appendix(scope, main, counters, date), scope).select(scope, F.concat(head, "main", end, "appendix").alias("document"))


def validate(df: DataFrame, key: str, text: str, cfg: RetrievalConfig | None = None) -> DataFrame:
    """(key, errors, warnings): the contract of a final document, one name for each rule that it breaks."""
    cfg = cfg or RetrievalConfig()
    doc = F.col(text)
    front = F.regexp_extract(doc, r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.when(front != "", F.regexp_replace(doc, r"(?s)^---\n.*?\n---\n", "")).otherwise(doc)
    field = lambda k: F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1)
    has = lambda k: front.rlike(rf"(?m)^{k}:")
    h2 = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^## [^\n]+"), 0), lambda x: F.trim(x))
    first, at = F.array_position(h2, "## Context"), F.array_position(h2, "## Sources")
    cut = F.instr(body, "## Sources")
    before, after = F.substring(body, F.lit(1), F.when(cut > 0, cut - 1).otherwise(F.char_length(body))), F.when(cut > 0, F.substring(body, cut, F.char_length(body))).otherwise(F.lit(""))
    cited = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(before, F.lit(r"\[(s\d+_c\d+(?:\s*,\s*s\d+_c\d+)*)\]"), 1), lambda x: F.split(x, r"\s*,\s*"))))
    listed = F.array_distinct(F.regexp_extract_all(after, F.lit(r"\|\s*(s\d+_c\d+)\s*\|\s*https?://"), 1))
    words = F.size(F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}_]+"), 0))
    rule = lambda c, name: F.when(c, F.lit(name))
    missing = F.size(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), has(k).alias("h")) for k in ("topic", "date", "research_tool", "cost", "sources_count")]), lambda x: ~x["h"])) > 0
    errors = F.array_compact(
        F.array(
            rule(front == "", "front matter missing"), rule((front != "") & missing, "front matter incomplete"), rule(has("sources_count") & ~field("sources_count").rlike(r"^-?\d+$"), "sources_count no integer"),
            rule(has("cost") & ~field("cost").rlike(r"^(|null|~|-?\d+(\.\d+)?)$"), "cost no number"), rule(F.size(h2) == 0, "no sections"), rule((F.size(h2) > 0) & (first != 1), "Context not first"),
            rule((F.size(h2) > 0) & (at == 0), "Sources missing"), rule((at > 0) & (at <= first), "Sources before Context"), rule((at > 0) & (at - F.greatest(first, F.lit(1)) - 1 < cfg.min_sections), "too few sections"),
            rule((at > 0) & (F.size(listed) == 0), "no source rows"), rule((at > 0) & (F.size(F.array_except(cited, listed)) > 0), "citations without source"), rule(words < cfg.min_words, "too short"),
        )
    )
    warnings = F.array_compact(F.array(rule(~F.array_contains(h2, "## Gaps & Caveats"), "no gaps section"), rule(F.size(F.array_except(listed, cited)) > 0, "unused sources")))
    return df.select(key, errors.alias("errors"), warnings.alias("warnings"))


def plan_problems(plan: DataFrame) -> DataFrame:
    """(run, problems) of plans with sub_questions array<string> and section_outline array<struct<section_id, source_routing_hints array<string>>>."""
    q, s = F.size("sub_questions"), F.size("section_outline")
    seq = F.expr("forall(transform(section_outline, (x, i) -> x.section_id = concat('s', i + 1)), b -> b)")
    hints = F.expr("forall(section_outline, x -> size(x.source_routing_hints) > 0)")
    used = F.expr("size(array_except(sub_questions, flatten(transform(section_outline, x -> x.source_routing_hints)))) = 0")
    rule = lambda c, name: F.when(~F.coalesce(c, F.lit(False)), F.lit(name))
    return plan.select("run", F.array_compact(F.array(rule(q.between(10, 20), "10 to 20 sub-questions"), rule(s.between(3, 5), "3 to 5 sections"), rule(seq, "ids in sequence"), rule(hints, "a hint for each section"), rule(used, "every question used"))).alias("problems"))


def target_words(total: Column, sections: Column) -> Column:
    """Words a section should have: an even share, rounded to fifty."""
    return (F.round(total / sections / 50) * 50).cast("int")


def in_band(words: Column, target: Column, band: float = 0.25) -> Column:
    """Whether a section's words are within ``band`` of its target."""
    return F.abs(words - target) <= band * target


def per_source_cap(found: DataFrame, question: str, url: str, order: list[str], each: int = 5, most: int = 50, scope: str | None = None) -> DataFrame:
    """The first ``each`` URLs of each question, of these the first ``most`` of the scope by place, question and URL."""
    by = [scope] if scope else []
    place = F.row_number().over(W.partitionBy(*by, question).orderBy(*order, url))
    near = found.withColumn("place", place).where(F.col("place") <= each)
    if not by:
        return near.orderBy("place", question, url).limit(most)
    return near.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("place", question, url))).where(F.col("_k") <= most).drop("_k")
