"""Retrieval quality: NDCG, reciprocal rank, recall, drops between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def metrics(ranked: DataFrame, expected: DataFrame, k: int = 10, recall_k: int = 5) -> DataFrame:
    """(query_id, ndcg, mrr, recall) of (query_id, item, rank) against the set of (query_id, item) expected.

    Relevance is binary, an item expected twice counts once. A query without results scores 0; one of which nothing
    is expected has no row here and counts 0 in any mean over questions.
    """
    want = expected.select("query_id", "item").distinct()
    n = want.groupBy("query_id").agg(F.count("*").alias("expected"))
    return scored(ranked.where(F.col("rank") <= k).join(want, ["query_id", "item"]).select("query_id", "rank"), n, k, recall_k)


def scored(relevant: DataFrame, n: DataFrame, k: int = 10, recall_k: int = 5) -> DataFrame:
    """(query_id, ndcg, mrr, recall) from the ranks of relevant results and the number of items expected, (query_id, expected)."""
    hit = relevant.where(F.col("rank") <= k)
    got = hit.groupBy("query_id").agg(
        F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.max(1 / F.col("rank")).alias("mrr"), F.count_if(F.col("rank") <= recall_k).alias("within")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("expected", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return n.join(got, "query_id", "left").select(
        "query_id", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), (F.coalesce("within", F.lit(0)) / F.col("expected")).alias("recall")
    )


def summary(m: DataFrame, questions: int) -> DataFrame:
    """The means over all ``questions``, those without a row counting 0; without questions all means are 0."""
    return m.agg(*[F.round(F.coalesce(F.sum(c), F.lit(0.0)) / max(questions, 1), 6).alias(c) for c in ("ndcg", "mrr", "recall")], F.lit(questions).alias("questions_run"))


def summaries(m: DataFrame, questions: int, by: Column, name: str) -> DataFrame:
    """(name, ndcg, mrr, recall): ``summary`` of several runs, ``by`` telling them apart; a run without any row has none here."""
    return m.groupBy(by.alias(name)).agg(*[F.round(F.coalesce(F.sum(c), F.lit(0.0)) / max(questions, 1), 6).alias(c) for c in ("ndcg", "mrr", "recall")])


def drops(runs: DataFrame, order: str, columns: list[str], least: float = 0.05) -> DataFrame:
    """(order, metric, fall): metrics that fell by ``least`` or more from the run before; null counts as 0."""
    w = W.partitionBy(F.lit(0)).orderBy(order)  # runs are few: one row an evaluation
    out = runs
    for c in columns:
        out = out.withColumn(f"_{c}", F.coalesce(F.lag(c).over(w), F.lit(0.0)) - F.coalesce(F.col(c), F.lit(0.0)))
    return out.select(order, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"_{c}").alias("fall")) for c in columns])).alias("m")).select(order, "m.metric", "m.fall").where(F.col("fall") >= least)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, item) of an evaluation set; one without questions raises when it is read."""
    schema = "questions array<struct<question: string, expected_chunks: array<bigint>>>"
    q = spark.read.json(path, multiLine=True, schema=schema)
    checked = F.when(F.coalesce(F.size("questions"), F.lit(0)) == 0, F.raise_error(F.lit("no questions"))).otherwise(F.col("questions"))
    return q.select(F.posexplode(checked).alias("query_id", "q")).select("query_id", "q.question", F.explode_outer(F.array_distinct("q.expected_chunks")).alias("item"))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(id, content_excerpt, expected_project, expected_source_type) of a classification benchmark."""
    d = "documents array<struct<id: string, content_excerpt: string, expected_project: string, expected_source_type: string, notes: string>>"
    return spark.read.json(path, multiLine=True, schema=d).select(F.inline("documents")).drop("notes")


def append_run(means: DataFrame, folder: str, run_ts: str, config: str, last_run: str | None = None) -> None:
    """Appends the means of an evaluation to the log of runs; ``last_run`` names the file that keeps the newest ones beside the questions."""
    run = means.withColumn("run_ts", F.lit(run_ts)).withColumn("config_snapshot", F.lit(config))
    run.write.mode("append").parquet(folder)
    if last_run:
        run.coalesce(1).write.mode("overwrite").json(last_run)


def skip_reason(runs: DataFrame | None, questions: DataFrame | None, now: str, chunks: DataFrame | None = None, evaluator: bool = True, days: int = 7) -> str | None:
    """Why the weekly evaluation doesn't run now, null if it does: no collection, no questions, no evaluator, or a run in the last week."""
    if chunks is None or questions is None or not chunks.limit(1).count():
        return "no collection"
    if not questions.limit(1).count():
        return "no questions"
    if not evaluator:
        return "no evaluator"
    if runs is not None:
        recent = F.max("run_ts") > F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS")
        if runs.agg(recent.alias("r")).first()["r"]:
            return "recent run"
    return None


def deltas(means: DataFrame, run: str = "run", base: str = "full") -> DataFrame:
    """``means`` (run and metrics, a row a configuration) with what each metric loses against the run ``base``."""
    metrics = [c for c in means.columns if c != run]
    ref = means.where(F.col(run) == base).select(*[F.col(c).alias(f"_{c}") for c in metrics])
    return means.crossJoin(F.broadcast(ref)).select(run, *metrics, *[F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"{c}_delta") for c in metrics])  # one row on the right
