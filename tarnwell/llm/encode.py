"""Encoding of texts by a public tokenizer, and the sizes that follow from it.

Texts of up to ``window`` code points are encoded where they lie, without a shuffle. A longer text is cut into
overlapping windows that are pre-tokenised in parallel. Neighbouring windows are stitched at the first boundary
of pre-tokens that both found in their overlap: from a common boundary on, the pattern's matches depend on the
following text alone, so both would go on alike. The pieces between the stitches are then encoded in parallel and
their ids put together in order. Only boundaries that hold whatever came before count, such as that between a word
and white space: a window may begin amid a run, and what it makes of that run's end proves nothing. Where an overlap
has no such common boundary (one endless run of letters), the two windows stay one piece, so the result is that of
encoding the text whole in every case.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The encoding of a rank file; strings that look like special tokens are plain text."""
    import tiktoken
    from pyspark import SparkFiles

    name = os.path.basename(path)
    try:
        shipped = SparkFiles.get(name)
    except Exception:  # no session here
        shipped = path
    with open(shipped if os.path.exists(shipped) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship_tokenizer(spark, path: str) -> None:
    """Gives the executors the rank file, once a session, so that nothing depends on their own disks."""
    sc = spark.sparkContext
    sent = getattr(sc, "_tarnwell_tokenizers", set())
    if path not in sent and os.path.exists(path):
        sc.addFile(path)
        sc._tarnwell_tokenizers = sent | {path}


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    # white space by its Unicode property, as the encoder has it
    own = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
    sp = r"\p{White_Space}"
    sure = regex.compile(rf"(?<=[^{sp}'])(?={sp})|(?<=\p{{L}})(?=[^\p{{L}}{sp}])|(?<=\p{{N}})(?=[^\p{{N}}{sp}])|(?<=[^{sp}\p{{L}}\p{{N}}'])(?=[\p{{L}}\p{{N}}])")
    return own, sure


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of ``text`` that would be starts after any other text before it."""
    own, sure = _pattern()
    certain = {m.start() for m in sure.finditer(text)}
    return [m.start() for m in own.finditer(text) if m.start() in certain]


def _ids_array(texts: list[str | None], path: str) -> pa.ListArray:
    enc = encoder(path)
    parts = [np.asarray(enc.encode_ordinary(t), np.int32) if t else np.empty(0, np.int32) for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts) if parts else np.empty(0, np.int32))


def _encode_in_place(df: DataFrame, key: str, text: str, path: str, rows: int = 512) -> DataFrame:
    """(key, ids) for each row, in batches of few rows so that long texts don't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), _ids_array(part.column(1).to_pylist(), path)], names=["key", "ids"])

    kind = df.schema[key].dataType
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    )


def long_text_pieces(df: DataFrame, key: str, text: str, window: int, overlap: int) -> DataFrame:
    """(key, piece_no, piece) for the texts of ``df``, which are all longer than ``window``."""
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType

    def cut(batches):  # one walk along each text, whatever its length
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                for j in range(-(-len(t) // window)):
                    start = max(0, j * window - overlap)
                    part = t[start : min(len(t), (j + 1) * window + overlap)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(t)], pa.int32()), pa.array([j], pa.int32()), pa.array([start], pa.int32()), pa.array([part])], names=["key", "n", "j", "start", "part"])

    ints = [T.StructField(c, T.IntegerType()) for c in ("n", "j", "start")]
    windows = d.mapInArrow(cut, T.StructType([T.StructField("key", kind), *ints, T.StructField("part", T.StringType())]))

    def run(batches):
        for b in batches:
            for key_, n_, j, start, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [start + x for x in boundaries(part)]
                end = start + len(part)
                if end < n_:
                    own = [x for x in own if x < end - 2]  # what touches the end of the window may go on beyond it
                at, to = j * window, (j + 1) * window
                head = [x for x in own if at - overlap <= x <= at + overlap] if j else []
                tail = [x for x in own if to - overlap <= x <= to + overlap] if end < n_ else []
                yield pa.RecordBatch.from_pydict({"key": pa.array([key_], b.schema.field(0).type), "j": pa.array([j], pa.int32()), "head": pa.array([head], pa.list_(pa.int64())), "tail": pa.array([tail], pa.list_(pa.int64()))})

    longs = T.ArrayType(T.LongType())
    seen = windows.repartition("key", "j").mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("j", T.IntegerType()), T.StructField("head", longs), T.StructField("tail", longs)]))
    order = W.partitionBy("key").orderBy("j")
    cuts = (
        seen.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
        .groupBy("key")
        .agg(F.array_sort(F.array_distinct(F.array_compact(F.collect_list("cut")))).alias("cuts"))
    )

    def pieces(batches):
        for b in batches:
            for i in range(b.num_rows):
                t, at = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                edges = [0, *at, len(t)]
                for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([t[x:y]])], names=["key", "piece_no", "piece"])

    out = T.StructType([T.StructField("key", kind), T.StructField("piece_no", T.IntegerType()), T.StructField("piece", T.StringType())])
    return d.join(cuts, "key").select("key", "text", "cuts").mapInArrow(pieces, out)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, window: int = 65_536, overlap: int = 512) -> DataFrame:
    """(key, ids) for each row of ``df``; other columns, whatever their names, play no part.

    Null and empty texts have no ids (an empty list); blank texts are encoded as they are. A repeated row gives a
    repeated result row up to ``window`` code points; of rows with one key and longer texts that key must be unique.
    An empty table gives an empty table. ``window`` only decides how the work is split, never the ids.
    """
    ship_tokenizer(df.sparkSession, tokenizer)
    n = F.char_length(text)
    short = _encode_in_place(df.where(n.isNull() | (n <= window)), key, text, tokenizer)
    pieces = long_text_pieces(df.where(n > window), key, text, window, overlap)
    packed = pieces.withColumn("at", F.struct("key", "piece_no"))
    long = (
        _encode_in_place(packed.repartition("key", "piece_no"), "at", "piece", tokenizer, rows=1)
        .groupBy("key.key")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("key.piece_no", "ids"))), lambda x: x["ids"])).alias("ids"))
    )
    return short.unionByName(long).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, text): the raw bytes of the ids put together, then read as UTF-8 (undecodable bytes become U+FFFD)."""
    ship_tokenizer(df.sparkSession, tokenizer)

    def run(batches):
        for b in batches:
            enc = encoder(tokenizer)
            texts = [enc.decode_bytes(x).decode("utf-8", "replace") if x is not None else None for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType
    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType())]))
    return out.withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens); null and empty texts have 0."""
    ship_tokenizer(df.sparkSession, tokenizer)

    def run(batches):
        for b in batches:
            enc = encoder(tokenizer)
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("n_tokens", T.LongType())]))
    return out.withColumnRenamed("key", key)
