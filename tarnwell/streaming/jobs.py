"""Structured Streaming: file sources, watermarked windows, keyed state, sinks by batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwell.session import shared_folder


def read_table_stream(spark: SparkSession, folder: str, name: str, files_a_batch: int = 64) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def read_inbox(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """(path, modified, text) of text files as they come into a folder."""
    r = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).schema("value string")
    return r.load(folder).select("_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What a stream has to say by now: run until its input is used up, written by batches to the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{label}-{uuid.uuid4().hex}"

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/{epoch:08d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(T.StructType([*stream.schema.fields, T.StructField("_epoch", T.IntegerType())])).parquet(f"{root}/out")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest update of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("_epoch")))).where("_r = 1").drop("_r")


def windowed_counts(stream: DataFrame, ts: str, width: str, kind: str, value: str, late: str = "0 seconds") -> DataFrame:
    """(began, kind, n, total) of each closed window; rows later than ``late`` are left out."""
    e = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    g = e.groupBy(F.window("_at", width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("began"), kind, "n", "total")


def completion(stream: DataFrame, key: str, part: str, ts: str, wanted: list[str], keep: str = "30 days") -> DataFrame:
    """(key, n, completed_ts): once for each key, when all wanted parts have come; null parts and times don't count.

    The state of a key is dropped once the stream's time has gone on for ``keep`` beyond the newest of its events;
    events later than that are left out.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, at, told, newest = state.get if state.exists else ("", "", False, 0)
        have = dict(zip(seen.split("\x1f"), at.split("\x1f"), strict=True)) if seen else {}
        for b in batches:
            newest = max(newest, int(b["_at"].max().timestamp() * 1000) if b["_at"].notna().any() else newest)
            for p, t in zip(b[part], b[ts], strict=True):
                if p in wanted and (p not in have or str(t) < have[p]):
                    have[p] = str(t)
        done = not told and len(have) == len(wanted)
        state.update(("\x1f".join(have), "\x1f".join(have.values()), told or done, newest))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        if done:
            yield pd.DataFrame({key: [k[0]], "n": [len(have)], "completed_ts": [pd.Timestamp(max(have.values()))]})

    kind = stream.schema[key].dataType.simpleString()
    s = stream.where(F.col(key).isNotNull() & F.col(part).isNotNull() & F.col(ts).isNotNull()).select(key, part, ts, F.col(ts).cast("timestamp").alias("_at")).withWatermark("_at", keep)
    return s.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, completed_ts timestamp_ntz", "seen string, at string, told boolean, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def moving_level(stream: DataFrame, key: str, value: str, order: list[str], alpha: float) -> DataFrame:
    """(key, level, seen): the moving mean after each batch; within a batch rows are taken in ``order``."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, seen = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value].dropna():
            level = v if not seen else (1 - alpha) * level + alpha * v
            seen += 1
        state.update((float(level), int(seen)))
        yield pd.DataFrame({key: [k[0]], "level": [level], "seen": [seen]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, value, *order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, level double, seen long", "level double, seen long", "update", GroupStateTimeout.NoTimeout)


def route_stream(stream: DataFrame, order: list[str], dim: int, split_below: float, cold_start: float, alpha: float) -> DataFrame:
    """(lane, id, decision, reason, project, score): documents routed one at a time, each against what the ones before it left.

    ``stream`` has lane, id, vec array<double> and the ``order`` columns. The projects of a lane (a collection, a
    tenant) are its state: their centroids, which a filed document moves by ``alpha`` and a created one adds to.
    """
    kinds = "lane string, id long, decision string, reason string, project int, score double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat = np.frombuffer(state.get[0], np.float64) if state.exists else np.empty(0)
        centers = flat.reshape(-1, dim).copy()
        out = []
        for row in pd.concat(list(batches)).sort_values(order).itertuples():
            x = np.asarray(row.vec, np.float64) if row.vec is not None else np.empty(0)
            if len(x) != dim or not np.isfinite(x).all() or not x.any():
                out.append((k[0], row.id, "reject", "vector", None, None))
                continue
            if not len(centers):
                score, best, reason, create = None, 0, "first", True
            else:
                norm = np.linalg.norm(centers, axis=1) * np.linalg.norm(x)
                s = np.round(np.divide(centers @ x, norm, out=np.zeros(len(centers)), where=norm > 0), 9)
                best = int(s.argmax())
                score = float(s[best])
                cold = len(centers) == 1 and score < cold_start
                reason, create = "cosine_cold_start" if cold else "cosine", cold or score < split_below
            if create:
                centers, best = np.vstack([centers, x]), len(centers)
            else:
                centers[best] = (1 - alpha) * centers[best] + alpha * x
            out.append((k[0], row.id, "create" if create else "file", reason, best, score))
        state.update((centers.tobytes(),))
        yield pd.DataFrame(out, columns=["lane", "id", "decision", "reason", "project", "score"]).astype({"project": "Int32"})

    s = stream.select("lane", "id", "vec", *[c for c in order if c not in ("lane", "id", "vec")])
    return s.groupBy("lane").applyInPandasWithState(step, kinds, "centers binary", "append", GroupStateTimeout.NoTimeout)


def mirror(stream: DataFrame, session: str, folder: str, checkpoint: str):
    """Starts a query that keeps one folder a session, each overwritten by the session's newest batch."""

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(folder)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def handlers(stream: DataFrame, kind: str, registry: dict, checkpoint: str) -> list:
    """One query for each kind of event, each with its own sink ``f(batch, epoch)``."""
    return [stream.where(F.col(kind) == k).writeStream.option("checkpointLocation", f"{checkpoint}/{k}").trigger(availableNow=True).foreachBatch(f).start() for k, f in registry.items()]
