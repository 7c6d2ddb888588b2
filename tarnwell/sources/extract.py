"""Text of source files: plain files as they are, HTML stripped."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without text of their own, and those whose end is the end of a line.
SKIPPED = {"script", "style", "noscript", "head"}
BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}


#: Scripts and styles whole (their text may look like tags), comments and declarations, then single tags.
_MARKUP = re.compile(r"""<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^>"'])*>""", re.S | re.I)


def html_text(html: str) -> str:
    """The text of an HTML page: skipped elements left out, a line break at the end of each block, at most one blank line."""
    pieces: list[str] = []
    hidden = at = 0
    for tag in _MARKUP.finditer(html):
        if not hidden:
            pieces.append(unescape(html[at : tag.start()]))
        at, name = tag.end(), (tag["name"] or "").lower()
        closed = bool(tag["end"]) or html.endswith("/>", tag.start(), at)  # an element that closes itself ends a line too
        if name in SKIPPED and bool(tag["end"]) == closed:
            hidden = max(0, hidden - 1) if closed else hidden + 1
        if closed and name in BLOCKS and not hidden:
            pieces.append("\n")
    if not hidden:
        pieces.append(unescape(html[at:]))
    return re.sub(r"\n{3,}", "\n\n", "".join(pieces)).strip()


def strip_html(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the text of the pages in ``column``; null stays null."""
    at = df.schema.names.index(column)

    def run(batches):
        for b in batches:
            out = [None if h is None else html_text(h) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, T.StructType(df.schema.fields))


def read_files(spark: SparkSession, folder: str, newer_than: str | None = None, glob: str = "*", meta: list[str] | None = None) -> DataFrame:
    """(path, name, modified, text) of the files below ``folder``: HTML stripped, all else as UTF-8 with replacements.

    ``newer_than`` keeps files modified after that instant; files whose name without suffix is in ``meta`` are left out.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if newer_than:
        r = r.option("modifiedAfter", newer_than)
    name = F.element_at(F.split("path", "/"), -1)
    files = r.load(folder).select("path", name.alias("name"), F.col("modificationTime").alias("modified"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if meta:
        files = files.where(~F.regexp_replace("name", r"\.[^.]*$", "").isin(meta))
    html = F.lower("name").rlike(r"\.html?$")
    return files.where(~html).unionByName(strip_html(files.where(html), "text"))


def read_searchers(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, pos, rec): the records of searcher JSON files, a list or an envelope with ``chunks``; rec is a VARIANT.

    A file of another shape raises when it is read.
    """
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.chunks", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    checked = F.when(items.isNull(), F.raise_error(F.concat(F.lit("neither a list nor an envelope: "), "file_name"))).otherwise(items)
    return raw.select("file_name", F.posexplode(checked).alias("pos", "rec"))


def existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first of the files that exists, in the order given; an error if none does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    raise FileNotFoundError(", ".join(candidates))


def best_report(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first of the report files that exists, in the order given."""
    return spark.read.json(existing(spark, candidates), multiLine=True)


#: What a research run's files hold: the plan's outline in order, and its chunks.
PLAN = "topic string, sub_questions array<string>, section_outline array<struct<section_id: string, title: string, source_routing_hints: array<string>>>"
CHUNKS = "chunk_id string, section_id string, source_url string, source_title string, fetched_at string, sub_question_origin string, text string"


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(plan, chunks) of a research run from its plan.json and chunks.json; a missing file raises at once."""
    for name in ("plan.json", "chunks.json"):
        existing(spark, [f"{folder}/{name}"])
    return spark.read.schema(PLAN).json(f"{folder}/plan.json", multiLine=True), spark.read.schema(CHUNKS).json(f"{folder}/chunks.json", multiLine=True)
