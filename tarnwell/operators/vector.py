"""Vector operators: exact top-k, centroids, moving centroids, routing scores, the float32 codec, encoders."""

from __future__ import annotations

import functools
import hashlib
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.functions.text import cosine, dot, tokens, usable

#: Query vectors compared in one pass; more queries are taken in blocks of this many.
QUERY_BLOCK = 4096


def mean_of(c: Column, dim: int) -> Column:
    """The mean vector of a group, position by position: partial sums before the shuffle, nothing collected."""
    return F.array(*[F.avg(c[i].cast("double")) for i in range(dim)])


def centroids(df: DataFrame, by: str, vector: str, dim: int = 64) -> DataFrame:
    """(by, centroid, n): mean of the usable vectors of each group."""
    return df.where(usable(F.col(vector), dim)).groupBy(by).agg(mean_of(F.col(vector), dim).alias("centroid"), F.count("*").alias("n"))


def moving_centroids(df: DataFrame, by: str, order: str, vector: str, alpha: float, dim: int = 64) -> DataFrame:
    """(by, centroid): the fold c = (1 - alpha) c + alpha x over each group in ``order``, the first vector seeding it.

    Written in closed form, so it is a weighted sum and not a sequential fold.
    """
    w = W.partitionBy(by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    weight = F.when(i == 1, F.pow(F.lit(1 - alpha), n - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), n - i))
    x = df.where(usable(F.col(vector), dim)).withColumn("_w", weight)
    return x.groupBy(by).agg(F.array(*[F.sum(F.col("_w") * F.col(vector)[k].cast("double")) for k in range(dim)]).alias("centroid"))


def topk(base: DataFrame, key: str, vector: str, query: DataFrame, query_vector: str, k: int, digits: int = 6) -> DataFrame:
    """(key, score): the ``k`` nearest of ``base`` to the one vector of ``query``; ties go to the smaller key."""
    q = query.select(F.col(query_vector).alias("_q")).limit(1)
    return base.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(q)).select(key, F.round(cosine(F.col(vector), F.col("_q")), digits).alias("score")).orderBy(F.desc("score"), key).limit(k)


def exact_knn(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank) by brute force: every query against every row, in blocks of queries.

    Each block of queries goes to the executors as a matrix of about ``block`` rows; a task scores its rows batch by
    batch and keeps ``k`` of them a query, so what is shuffled depends on tasks and queries, not on rows.
    """
    q = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    blocks = max(1, -(-q.count() // block))

    def one(part: DataFrame) -> DataFrame | None:
        rows = part.toPandas()
        if not len(rows):
            return None
        qid = rows[key].to_numpy()
        m = np.stack(rows[vector].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        def run(batches):
            score, ids = np.empty((len(m), 0)), np.empty((len(m), 0), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                s = np.round(m @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, digits)
                own = b.column(0).to_numpy()
                s[qid[:, None] == own] = -np.inf
                score, ids = np.hstack([score, s]), np.hstack([ids, np.broadcast_to(own, s.shape)])
                if score.shape[1] > k:
                    best = np.lexsort((ids, -score), axis=1)[:, :k]
                    score, ids = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
            at = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, at.sum(axis=1)).astype(np.int64)), pa.array(ids[at]), pa.array(score[at])], names=["query_id", key, "score"])

        return base.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query_id long, {key} long, score double")

    parts = [d for i in range(blocks) if (d := one(q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) if blocks > 1 else q)) is not None]
    if not parts:
        return base.sparkSession.createDataFrame([], f"query_id long, {key} long, score double, rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return functools.reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)


def scores(df: DataFrame, key: str, vector: str, centers: DataFrame, name: str, center: str, most: int = 10_000) -> DataFrame:
    """(key, name, score) of every row against every center; the centers must be few (checked) to be sent along."""
    if centers.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centers: route in blocks of them")
    # norms once a row and once a center, below the join; only the dot products are made pair by pair
    c = centers.select(F.col(name), F.col(center).alias("_c"), F.sqrt(dot(F.col(center), F.col(center))).alias("_cn"))
    v = df.select(key, F.col(vector).alias("_v"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("_vn"))
    norm = F.col("_vn") * F.col("_cn")
    score = F.when(F.size("_v") != F.size("_c"), None).when(norm == 0, F.lit(0.0)).otherwise(dot(F.col("_v"), F.col("_c")) / norm)
    return v.crossJoin(F.broadcast(c)).select(key, name, score.alias("score"))


def nearest(scored: DataFrame, key: str, name: str, digits: int = 9) -> DataFrame:
    """(key, name, score, second, n): the best of each row, the score of the runner-up, and how many were scored."""
    s = scored.where("score is not null").withColumn("_s", F.round("score", digits))
    w = W.partitionBy(key).orderBy(F.desc("_s"), name)
    return s.withColumn("_r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).withColumn("n", F.count("*").over(W.partitionBy(key))).where("_r = 1").drop("_r", "_s")


def softmax(scored: DataFrame, key: str, score: str, out: str = "p") -> DataFrame:
    """Adds the softmax of ``score`` within ``key``, shifted by the maximum."""
    w = W.partitionBy(key)
    e = scored.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def to_blob(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Replaces the vector by its little-endian float32 bytes; another length than ``dim`` raises."""
    at = df.schema.names.index(vector)

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(at).to_pylist():
                if v is not None and len(v) != dim:
                    raise ValueError(f"vector of {len(v)} parts, not {dim}")
                out.append(None if v is None else np.asarray(v, "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(vector, T.BinaryType()) if f.name == vector else f for f in df.schema.fields]))


def from_blob(df: DataFrame, blob: str, dim: int) -> DataFrame:
    """The reverse of ``to_blob``."""
    at = df.schema.names.index(blob)

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(at).to_pylist():
                if v is not None and len(v) != 4 * dim:
                    raise ValueError(f"blob of {len(v)} bytes, not {4 * dim}")
                out.append(None if v is None else np.frombuffer(v, "<f4").tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float32())) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(blob, T.ArrayType(T.FloatType())) if f.name == blob else f for f in df.schema.fields]))


class Encoder(Protocol):
    """Turns texts into vectors; one instance a Python worker."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """The default encoder: signed feature hashing of words (the first 32 bits of their MD5), unit length. Deterministic, without a model."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = _word_hash(w)
                out[i, h % self.dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).astype(np.float32)


@functools.lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4], "big")


def embed(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds the vectors of ``text``; the encoder is made once a worker and sees ``batch`` texts at once; null stays null."""
    at = df.schema.names.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            got: list = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(full), batch):
                part = full[k : k + batch]
                for i, v in zip(part, encoder.encode([texts[i] for i in part]), strict=True):
                    got[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker: share of the query's words that the text has, through a sigmoid centred at one half."""
    q = F.array_distinct(tokens(query))
    share = F.size(F.array_intersect(q, tokens(text))) / F.nullif(F.size(q), F.lit(0))
    return F.coalesce(1 / (1 + F.exp(-8 * (share - 0.5))), F.lit(0.0))
