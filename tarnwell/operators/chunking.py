"""Chunkers: packing of paragraphs and sentences to a target size, research chunks, query decomposition.

A text is read once into the lengths of its parts. With the running total of the lengths, where a chunk ends is a
search in a sorted array, so packing takes a step for each chunk and not for each part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.config import RetrievalConfig

#: Fixed value: a sentence ends where white space follows one of these marks.
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Marks after which an oversized piece may be cut, the better ones first.
BREAKS = ("\n", ". ", "! ", "? ", ", ", " ")
#: A blank line, or a fenced block as a whole.
_BLANK = re.compile(r"```.*?```|\n\s*\n", re.S)


def runs(sizes: list[int], target: int, glue: int, head: int) -> list[tuple[int, int]]:
    """(from, to) of the groups of parts that are packed together, each as long as it can be and at least one part.

    A part that joins a group must fit with ``glue`` for each part before it; in groups but the first the opening
    part's glue is not counted, and ``head`` is 0 if it never is.
    """
    total = [0, *accumulate(s + glue for s in sizes)]
    out, at = [], 0
    while at < len(sizes):
        room = total[at] + target + glue + (glue if out or not head else 0)
        end = max(at + 1, bisect_right(total, room) - 1)
        out.append((at, end))
        at = end
    return out


def joined(parts: list[str], target: int, glue: str) -> list[str]:
    """``parts`` packed to ``target`` characters and joined."""
    return [glue.join(parts[a:b]) for a, b in runs([len(p) for p in parts], target, len(glue), 1)]


def cap(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last of the first kind of break in the second half of each."""
    starts = [0]
    while len(text) - starts[-1] > most:
        lo, hi = starts[-1] + most // 2, starts[-1] + most
        found = ((text.rfind(b, lo, hi), len(b)) for b in BREAKS)
        starts.append(next((at + n for at, n in found if at >= 0), hi))
    pieces = (text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)], strict=True))
    return [p for p in pieces if p]


def index_chunks(text: str, cfg: RetrievalConfig | None = None) -> list[str]:
    """The index chunker: paragraphs packed to the target, oversized ones by sentence, all capped, tiny ones dropped."""
    cfg = cfg or RetrievalConfig()
    parts = [p.strip() for p in re.sub(r"\n{3,}", "\n\n", text.strip()).split("\n\n")]
    packed: list[str] = []
    for oversized, run in groupby(filter(None, parts), key=lambda p: len(p) > cfg.chunk_cap):
        if oversized:
            packed += [c for p in run for c in joined([s for s in SENTENCE.split(p) if s], cfg.chunk_target, " ")]
        else:
            packed += joined(list(run), cfg.chunk_target, "\n\n")
    return [c for x in packed for c in cap(x, cfg.chunk_cap) if len(c) >= cfg.chunk_min]


def paragraphs(text: str) -> list[str]:
    """Paragraphs at blank lines; a blank line inside a fenced block is none."""
    cuts = [m.span() for m in _BLANK.finditer(text) if m.group()[0] == "\n"]
    edges = [0, *(x for span in cuts for x in span), len(text)]
    return [p for p in (text[a:b].strip() for a, b in zip(edges[::2], edges[1::2], strict=True)) if p]


def research_chunks(text: str, target: int = 500, chars: int = 4) -> list[str]:
    """Research chunks: paragraphs packed to ``target`` approximate tokens; a paragraph of that size stands alone."""
    size = lambda p: max(1, len(p) // chars)
    out: list[str] = []
    for alone, run in groupby(paragraphs(text), key=lambda p: size(p) >= target):
        own = list(run)
        out += own if alone else ["\n\n".join(own[a:b]) for a, b in runs([size(p) for p in own], target, 0, 0)]
    return out


def decompose(query: str, tokens: int = 15, words: int = 3) -> list[str]:
    """Sub-queries: the sentences, or for a long single sentence its parts at and/or/but; short parts undo the split."""
    q = query.strip()
    parts = [s for s in map(str.strip, SENTENCE.split(q)) if s]
    if len(parts) < 2 and len(q.split()) >= tokens:
        parts = [s for s in (x.strip(" ,;") for x in re.split(r"\b(?:and|or|but)\b", q)) if s]
    return parts if len(parts) > 1 and min(len(p.split()) for p in parts) >= words else [q]


def explode_text(df: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """(key, chunk_index, content, token_count) by the chunker named: index, research, paragraphs or decompose.

    Null texts have no rows; the index counts what is kept, from 0. Chunks leave as they are made, document by document.
    """
    f = {"index": index_chunks, "research": research_chunks, "paragraphs": paragraphs, "decompose": decompose}[how]

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = f(t)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), b.schema.field(0).type), pa.array(range(len(c)), pa.int32()), pa.array(c, pa.string()), pa.array([len(x.split()) for x in c], pa.int32())], names=["key", "chunk_index", "content", "token_count"])

    kind = df.schema[key].dataType
    src = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = [T.StructField("key", kind), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("token_count", T.IntegerType())]
    return src.mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)


def section_ids(df: DataFrame, section: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Adds chunk_id s<section>_c<n>, going on from the highest number of ``existing`` ids of the section."""
    n = F.row_number().over(W.partitionBy(section).orderBy(*order))
    out = df.withColumn("_n", n)
    if existing is None:
        return out.withColumn("chunk_id", F.concat(F.col(section), F.lit("_c"), F.col("_n"))).drop("_n")
    last = existing.select(F.regexp_extract("chunk_id", r"^(s\d+)_c\d+$", 1).alias(section), F.expr(r"try_cast(regexp_extract(chunk_id, '_c([0-9]+)$', 1) AS INT)").alias("k")).groupBy(section).agg(F.max("k").alias("_last"))
    return out.join(last, section, "left").withColumn("chunk_id", F.concat(F.col(section), F.lit("_c"), F.col("_n") + F.coalesce("_last", F.lit(0)))).drop("_n", "_last")


def routed(chunks: DataFrame, outline: DataFrame, run: str, question: str = "sub_question_origin") -> DataFrame:
    """(columns of chunks, section): each chunk under every section of its run whose hints name its question.

    ``outline`` has (run, section_id, source_routing_hints array<string>). A chunk that no section asks for has no row.
    """
    hints = outline.select(run, F.col("section_id").alias("section"), F.explode(F.array_distinct("source_routing_hints")).alias("_hint"))
    return chunks.join(hints, (chunks[run] == hints[run]) & (chunks[question] == hints["_hint"])).drop(hints[run]).drop("_hint")
