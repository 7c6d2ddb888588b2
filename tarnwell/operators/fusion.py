"""Ranking and fusion of result lists: weighted reciprocal ranks, merges, gates, rerank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.operators.vector import overlap_score


def ranked(df: DataFrame, key: str, score: str, by: list[str] | None = None, most: int = 1000) -> DataFrame:
    """Adds ``rank`` from 1 by score, ties to the smaller key; within ``by`` if given, else of the ``most`` best.

    Without ``by`` the ranks are given in one task, so the best are taken first, which every task does for its own rows.
    """
    order = [F.desc(score), key]
    if by:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


def rrf(lists: list[DataFrame], weights: list[float], key: str, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """(by, key, rrf_score): sum of weight / (k + rank) over the lists, which have (by, key, rank).

    As many weights as lists, else an error. Ties keep the order of first sight: the earlier list, then its rank.
    An empty list gives nothing and moves no weight.
    """
    if len(lists) != len(weights):
        raise ValueError(f"{len(lists)} lists, {len(weights)} weights")
    by = by or []
    every = reduce(DataFrame.unionByName, [d.select(*by, key, "rank", F.lit(i).alias("_l"), F.lit(w).alias("_w")) for i, (d, w) in enumerate(zip(lists, weights, strict=True))])
    return every.groupBy(*by, key).agg(F.sum(F.col("_w") / (k + F.col("rank"))).alias("rrf_score"), F.min(F.struct("_l", "rank")).alias("seen"))


def first_list(lists: list[DataFrame], key: str) -> DataFrame:
    """Without fusion: the first list that isn't empty."""
    every = reduce(DataFrame.unionByName, [d.select(key, "rank", F.lit(i).alias("_l")) for i, d in enumerate(lists)])
    least = every.agg(F.min("_l").alias("_m"))
    return every.crossJoin(F.broadcast(least)).where("_l = _m").select(key, "rank")


def skips(df: DataFrame, by: str, score: str, least: float = 0.03, most: int = 3) -> DataFrame:
    """(by, top, candidates, skip): whether the rerank can be left out, a query at a time."""
    return df.groupBy(by).agg(F.max(score).alias("top"), F.count("*").alias("candidates")).withColumn("skip", (F.col("top") >= least) & (F.col("candidates") <= most))


def should_skip(score: Column, threshold: float = 0.92) -> Column:
    return F.coalesce(score >= threshold, F.lit(False))


def rerank(df: DataFrame, query: Column, text: str, key: str, k: int, scorer=overlap_score) -> DataFrame:
    """The ``k`` best by ``scorer``, a missing score being 0; ties to the smaller key."""
    return df.withColumn("rerank_score", F.coalesce(scorer(query, F.col(text)), F.lit(0.0))).orderBy(F.desc("rerank_score"), key).limit(k)
