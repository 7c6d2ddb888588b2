"""Transcripts, memory and completion: batch transformations that the streams reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.config import RetrievalConfig

#: The phrases that announce a decision.
DECISIONS = [
    r"(?i)let'?s go with\s+(.+?)(?:[\.\n]|$)",
    r"(?i)(?:we|i)(?:'ve)?\s+decided(?:\s+on)?\s*:?\s*(.+?)(?:[\.\n]|$)",
    r"(?i)(?:we|i)'?ll\s+(?:use|go with|stick with|choose)\s+(.+?)(?:[\.\n]|$)",
    r"(?i)going (?:with|forward with)\s+(.+?)(?:[\.\n]|$)",
    r"(?i)final answer\s*:\s*(.+?)(?:[\.\n]|$)",
    r"(?i)(?:from now on|henceforth|going forward),?\s+(.+?)(?:[\.\n]|$)",
    r"(?i)commit(?:ting)? to\s+(.+?)(?:[\.\n]|$)",
    r"(?i)settl(?:e|ed|ing) on\s+(.+?)(?:[\.\n]|$)",
]


def decisions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, decision): what a text decides, 3 to 200 characters long, emphasis and quotes taken off, once a text."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in DECISIONS]))
    trimmed = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.char_length(x).between(3, 200))
    clean = F.filter(F.transform(trimmed, lambda x: F.trim(F.regexp_replace(x, r'[*`"]+', ""))), lambda x: x != "")
    return df.select(key, F.explode(clean).alias("decision")).distinct()


def flatten_content(c: Column) -> Column:
    """The text of a message: itself if it is a string, else its text blocks, a line each. ``c`` is a VARIANT."""
    blocks = F.try_variant_get(c, "$", "array<struct<type: string, text: string>>")
    return F.coalesce(F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))


def messages(lines: DataFrame, last: int = 200) -> DataFrame:
    """(session, line_no, role, text) of JSON lines (session, line_no, value); malformed lines are skipped, the last ``last`` of a session count."""
    w = W.partitionBy("session").orderBy(F.desc("line_no"))
    tail = lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    v = tail.withColumn("v", F.try_parse_json("value")).where("v is not null")
    role = F.coalesce(F.try_variant_get("v", "$.message.role", "string"), F.try_variant_get("v", "$.role", "string"))
    body = F.coalesce(F.try_variant_get("v", "$.message.content", "variant"), F.try_variant_get("v", "$.content", "variant"))
    return v.select("session", "line_no", role.alias("role"), flatten_content(body).alias("text")).where("role is not null")


def last_turns(m: DataFrame) -> DataFrame:
    """(session, role, text): the last message of each role."""
    return m.groupBy("session", "role").agg(F.max_by("text", "line_no").alias("text"))


def rotate(df: DataFrame, memory: str, order: str, text: str, cfg: RetrievalConfig | None = None) -> DataFrame:
    """Adds keep: of a memory above the cap only the newest rows that fit into what is kept stay."""
    cfg = cfg or RetrievalConfig()
    n = F.char_length(text)
    newer = F.sum(n).over(W.partitionBy(memory).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("keep", (F.sum(n).over(W.partitionBy(memory)) <= cfg.memory_cap) | (newer <= cfg.memory_keep))


def rehydrate(df: DataFrame, memory: str, order: str, text: str, cfg: RetrievalConfig | None = None) -> DataFrame:
    """(memory, memory_text): the last characters up to the cap, with a notice where earlier ones are left out.

    Only the newest rows that reach into the last characters are put together.
    """
    cfg = cfg or RetrievalConfig()
    cap = cfg.memory_cap
    w = W.partitionBy(memory)
    newer = F.coalesce(F.sum(F.char_length(text) + 1).over(w.orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.char_length(text) + 1).over(w) - 1
    need = df.withColumn("_newer", newer).withColumn("_total", total).where(F.col("_newer") < cap + 1)
    tail = need.groupBy(memory).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("s"), F.first("_total").alias("n"))
    return tail.select(memory, F.when(F.col("n") > cap, F.concat(F.lit("[earlier memory omitted]\n"), F.right("s", F.lit(cap)))).otherwise(F.col("s")).alias("memory_text"))


def complete(drafts: DataFrame, run: str, wanted: list[str], section: str, size: str, cfg: RetrievalConfig | None = None) -> DataFrame:
    """(run, complete): whether all wanted sections of a run have a draft of the least size."""
    cfg = cfg or RetrievalConfig()
    return drafts.groupBy(run).agg(((F.count_distinct(F.when(F.col(section).isin(wanted), F.col(section))) == len(wanted)) & (F.min(size) >= cfg.draft_bytes)).alias("complete"))


def checkpoints(events: DataFrame, kind: str, session: str, at: str) -> DataFrame:
    """(session, at, value): the marker that the memory of a session gets before each compaction, to be appended to it."""
    mark = F.concat(F.lit("\n---\n\n## ["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("] PRE-COMPACT CHECKPOINT"), F.coalesce(F.concat(F.lit(" | session="), F.col(session)), F.lit("")), F.lit("\n"))
    return events.where(F.col(kind) == "compact").select(session, at, mark.alias("value"))


#: Fixed value: how a section writer's prompt names its section.
SECTION_ID = r"section_id:\s*(s\d+)"


def started(events: DataFrame, run: str, prompt: str, at: str) -> DataFrame:
    """(run, section_id, started_at, status): the writers that began, by the section that their prompt names; other prompts are left out."""
    s = F.regexp_extract(prompt, SECTION_ID, 1)
    return events.where((s != "") & F.col(run).isNotNull()).select(run, s.alias("section_id"), F.col(at).alias("started_at"), F.lit("started").alias("status"))


def closed(registry: DataFrame, stopped: DataFrame, run: str) -> DataFrame:
    """``registry`` after the stops (run, section_id): of each section the newest row that is still open becomes completed."""
    n = F.row_number().over(W.partitionBy(run, "section_id").orderBy(F.col("status") != "started", F.desc("started_at")))
    stops = stopped.select(run, "section_id").distinct().withColumn("_s", F.lit(True))
    return registry.withColumn("_n", n).join(stops, [run, "section_id"], "left").withColumn("status", F.when((F.col("_n") == 1) & F.col("_s") & (F.col("status") == "started"), "completed").otherwise(F.col("status"))).drop("_n", "_s")
