"""Most similar vectors by shifted space-filling curves.

Usable vectors are brought to unit length and copies of one vector fold into one representative. Each curve projects
the representatives onto a few random orthogonal axes, shifts them, and orders them along a Hilbert curve. Spark
range-partitions every curve by its key; within the partitions each block of keys is compared with the blocks next
to it, and the neighbours that the curves found are merged and reranked by exact cosine.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.session import written

#: Axes of a curve and bits of each, so that a key fits into 63 bits.
AXES, BITS = 7, 9


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors: of length ``dim``, without null or not finite parts, not zero."""
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid & (lengths == dim))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    big = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(x).all(axis=1) & (big > 0)
    x, rows = x[good] / big[good][:, None], rows[good]
    return rows, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int = 64, extra: list[str] | None = None) -> DataFrame:
    """(key, ``extra`` columns, vec binary) of the rows whose vector is usable; repeated rows stay."""
    keep = [key, *(extra or [])]
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(vector).cast("array<float>").alias("v"))

    def run(batches):
        for b in batches:
            rows, x = matrix(b.column(len(keep)), dim)
            at = pa.array(rows)
            buf = pa.py_buffer(np.ascontiguousarray(x).tobytes())
            vec = pa.Array.from_buffers(pa.binary(dim * 4), len(rows), [None, buf]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), vec], names=[*keep, "vec"])

    fields = [T.StructField(c, df.schema[c].dataType) for c in keep]
    return src.mapInArrow(run, T.StructType([*fields, T.StructField("vec", T.BinaryType())]))


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (one a row), by Gray-code rotation of the bit planes."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@functools.lru_cache(maxsize=64)
def _axes(curve: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, curve])
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q[:, :AXES].astype(np.float32), rng.random(AXES).astype(np.float32)


def curve_keys(x: np.ndarray, curve: int, seed: int = 7) -> np.ndarray:
    """Keys of unit vectors on one curve: projected, spread evenly by a logistic curve, shifted, quantised."""
    dim = x.shape[1]
    axes, shift = _axes(curve, dim, seed)
    u = 1 / (1 + np.exp(-1.7 * math.sqrt(dim) * (x @ axes)))
    return hilbert_keys(np.minimum((u + shift) * (1 << (BITS - 1)), (1 << BITS) - 1).astype(np.int64))


def _hashed(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec"))


def folded(vectors: DataFrame, key: str, space: str, k: int) -> DataFrame:
    """(space, h1, h2, rep, vec, ids): one row for each distinct vector, with the ``k`` + 1 smallest of its ids.

    More ids are nobody's neighbours: in the order by cosine and id, smaller ids of the group come before them. Their
    own ``k`` nearest are the group's ``k`` smallest ids; see ``further``.
    """
    h = _hashed(vectors)
    group = [space, "h1", "h2"]
    first = h.withColumn("_r", F.dense_rank().over(W.partitionBy(*group).orderBy(key))).where(F.col("_r") <= k + 1)
    return first.groupBy(*group).agg(F.min(key).alias("rep"), F.first("vec").alias("vec"), F.array_sort(F.collect_set(key)).alias("ids"))


def further(vectors: DataFrame, reps: DataFrame, key: str, space: str, k: int) -> DataFrame:
    """(space, id_a, id_b, cos): the neighbours of the copies that ``folded`` left out of ``reps``."""
    full = reps.where(F.size("ids") > k).select(space, "h1", "h2", "ids")
    left = _hashed(vectors).select(space, key, "h1", "h2").join(full, [space, "h1", "h2"]).where(F.col(key) > F.col("ids")[k])
    return left.dropDuplicates([space, key]).select(space, F.col(key).alias("id_a"), F.explode(F.slice("ids", 1, k)).alias("id_b"), F.lit(1.0).cast("float").alias("cos"))


def near(reps: DataFrame, k: int, floor: float, curves: int, block: int, span: int, dim: int, rows_a_task: int, query_every: int | None) -> DataFrame:
    """(space, a, b, cos): for each representative its up to ``k`` nearest in the windows of the curves, from ``floor`` on."""

    def keyed(batches):
        for b in batches:
            x = unpack(b.column(2), dim)
            if len(x):
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), c, np.int32)), pa.array(curve_keys(x, c)), b.column(1), b.column(2)], names=["space", "curve", "at", "rep", "vec"])

    at = reps.select("space", "rep", "vec").mapInArrow(keyed, "space string, curve int, at long, rep long, vec binary")
    tasks = max(1, math.ceil(reps.count() * curves / rows_a_task))

    def compare(batches):
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        t = t.combine_chunks()
        spaces, curve, rep = t["space"].to_pandas().to_numpy(), t["curve"].to_numpy(), t["rep"].to_numpy()
        change = np.flatnonzero((spaces[1:] != spaces[:-1]) | (curve[1:] != curve[:-1])) + 1
        for lo, hi in zip([0, *change], [*change, len(rep)], strict=True):
            x = unpack(t["vec"].slice(lo, hi - lo), dim)
            ids = rep[lo:hi]
            for s in range(0, len(x), block):
                rows = np.arange(s, min(s + block, len(x)))
                if query_every:
                    rows = rows[ids[rows] % query_every == 0]
                if not len(rows):
                    continue
                a, z = max(0, s - span * block), min(len(x), s + (span + 1) * block)
                sim = x[rows] @ x[a:z].T
                sim[np.arange(len(rows)), rows - a] = -2
                if floor > -1:
                    i, j = np.nonzero(sim >= floor)
                    if not len(i):
                        continue
                    v = sim[i, j]
                    order = np.lexsort((ids[a:z][j], -v, i))
                    i, j, v = i[order], j[order], v[order]
                    first = np.searchsorted(i, i)
                    near_ = np.arange(len(i)) - first < k
                    i, j, v = i[near_], j[near_], v[near_]
                else:
                    m = min(k, sim.shape[1] - 1)
                    if m < 1:
                        continue
                    top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    i, j = np.repeat(np.arange(len(rows)), m), top.ravel()
                    v = sim[i, j]
                yield pa.RecordBatch.from_arrays([pa.array([spaces[lo]] * len(i), pa.string()), pa.array(ids[rows][i]), pa.array(ids[a:z][j]), pa.array(v.astype(np.float32))], names=["space", "a", "b", "cos"])

    found = at.repartitionByRange(tasks, "space", "curve", "at", "rep").sortWithinPartitions("space", "curve", "at", "rep").mapInArrow(compare, "space string, a long, b long, cos float")
    merged = found.groupBy("space", "a", "b").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(W.partitionBy("space", "a").orderBy(F.desc("cos"), "b"))
    return merged.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def knn(
    vectors: DataFrame, key: str, vector: str, space: str, k: int = 10, floor: float = -1.0, curves: int = 4, block: int = 256, span: int = 1,
    dim: int = 64, rows_a_task: int = 40_000, query_every: int | None = None, all_copies: bool = True,
) -> DataFrame:
    """(space, id_a, id_b, cos, rank): for each row the ``k`` most similar rows of its space with a cosine of ``floor`` or more.

    ``space`` is a string column; rows of different spaces never meet. Re-delivered rows (one space and key) count
    once. Unusable vectors (null, zero, not finite, with null parts, not of length ``dim``) neither have nor are
    neighbours; the length of a vector doesn't matter. Ties go to the smaller id. With
    ``query_every`` only keys divisible by it ask, against all rows. Null keys are left out. Without ``all_copies``
    the copies of a vector beyond the ``k`` + 1 smallest ids don't ask: none of their neighbours, the first ``k`` of
    the copies, has them among its own, so ``mutual`` pairs are the same.
    """
    usable = lambda rows: unit_vectors(rows.where(F.col(key).isNotNull()), key, vector, dim, [space]).withColumnRenamed(key, "_id").withColumnRenamed(space, "space")
    reps = written(folded(usable(vectors), "_id", "space", k), "vectors")
    pairs = near(reps, k, floor, curves, block, span, dim, rows_a_task, None)
    ids = reps.select("space", "rep", "ids")
    copies = ids.where(F.size("ids") > 1).select("space", F.explode("ids").alias("id_a"), "ids").select("space", "id_a", F.explode("ids").alias("id_b"), F.lit(1.0).cast("float").alias("cos")).where("id_a != id_b")
    across = (
        pairs.join(ids.select("space", F.col("rep").alias("a"), F.col("ids").alias("ia")), ["space", "a"])
        .join(ids.select("space", F.col("rep").alias("b"), F.col("ids").alias("ib")), ["space", "b"])
        .select("space", F.explode("ia").alias("id_a"), "ib", "cos")
        .select("space", "id_a", F.explode("ib").alias("id_b"), "cos")
    )
    every = copies.unionByName(across)
    if query_every:
        every = every.where(F.col("id_a") % query_every == 0)
    rank = F.row_number().over(W.partitionBy("space", "id_a").orderBy(F.desc("cos"), "id_b"))
    if all_copies:
        asking = vectors.where(F.col(key) % query_every == 0) if query_every else vectors
        every = every.unionByName(further(usable(asking), reps, "_id", "space", k))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """(space, id_a, id_b) of the rows that are among each other's neighbours, the smaller id first."""
    return (
        neighbours.select("space", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        .groupBy("space", "id_a", "id_b").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    )
