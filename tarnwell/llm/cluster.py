"""Groups of similar vectors: MinHash bands, exact Jaccard, components, and medoids for the loose ones.

A vector's set holds the ``top`` directions, of a fixed random family, that it points along most. MinHash bands of
these sets put vectors into buckets; in each bucket the first vector leads, those that the exact Jaccard similarity
of their sets rejects have their own first as the next leader, and so on until none is left. Members of different
leaders are compared too, and a pair that joins what isn't joined yet is added, so that the components are those of
all similar pairs of all buckets. A bucket of any size gives fewer than two pairs a member; it is held by one task,
which compares all its members that aren't known to be of one component.
Components of the verified pairs are groups if they are tight, that is if their mean unit vector is long. Loose
ones, which a few chance pairs chained together, are split around their vertices of highest degree. Every vector,
paired or not, then belongs to the group whose mean is nearest, if its cosine to that mean is high enough.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.llm.components import components
from tarnwell.llm.vectors import unit_vectors, unpack
from tarnwell.session import drop_written, written

#: Means sent to the executors at once; more are taken in blocks of this many.
BLOCK_OF_MEANS = 8192


@functools.lru_cache(maxsize=8)
def _family(dim: int, directions: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = rng.standard_normal((dim, directions)).astype(np.float32)
    return p / np.linalg.norm(p, axis=0), np.stack([rng.permutation(directions) for _ in range(hashes)]).astype(np.int16)


def set_of(x: np.ndarray, directions: int, top: int, seed: int = 1) -> np.ndarray:
    """The ``top`` directions of each vector."""
    p, _ = _family(x.shape[1], directions, 1, seed)
    return np.argpartition(-(x @ p), top, axis=1)[:, :top]


def bands_of(sets: np.ndarray, dim: int, directions: int, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One bucket key for each vector and band."""
    _, perms = _family(dim, directions, bands * rows, seed)
    key = np.zeros((len(sets), bands), np.int64)
    for b in range(bands):
        for r in range(rows):
            key[:, b] = key[:, b] * directions + perms[b * rows + r][sets].min(axis=1)
    return key


def _sets(bits: np.ndarray) -> np.ndarray:
    """Sets held as four words each, as rows of zeros and ones."""
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1).astype(np.float32)


def _joining(x: np.ndarray, y: np.ndarray, labels: list[np.ndarray]) -> list[int]:
    """The places of those of the pairs of labels that join two that aren't joined yet; ``labels`` are brought up to date."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while k in parent:
            k = parent[k]
        return k

    out = []
    _, first = np.unique(np.stack([x, y]), axis=1, return_index=True)
    for i in np.sort(first).tolist():
        u, v = root(int(x[i])), root(int(y[i]))
        if u != v:
            parent[v] = u
            out.append(i)
    if parent:
        old = np.array(sorted(parent))
        new = np.array([root(k) for k in old.tolist()])
        for a in labels:
            if len(a):
                i = np.minimum(np.searchsorted(old, a), len(old) - 1)
                a[:] = np.where(old[i] == a, new[i], a)
    return out


def led_pairs(batches, least: float, rows: int = 256, leaders: int = 2048, whole: bool = False):
    """Batches (a, b) from batches (band, bucket, id, f0, f1, f2, f3) in order: each member with the first leader of its
    bucket that shares ``least`` directions with it; a member that no leader shares them with leads those after it.

    With ``whole`` also a pair for any two that share them and that the pairs before don't join, at whatever distance.
    """
    at, lead_ids, lead_bits = None, np.empty(0, np.int64), np.empty((0, 4), np.int64)
    # with ``whole``, of the open bucket: the labels of its leaders, and all members with theirs; one label is one component
    lead_label, all_ids, all_bits, all_label = lead_ids, lead_ids, lead_bits, lead_ids
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        a, b = [], []
        for s in range(0, batch.num_rows, rows):
            band, bucket, ids = (c[s : s + rows] for c in cols[:3])
            bits = np.stack([c[s : s + rows] for c in cols[3:]], axis=1)
            if at is None or (band[0], bucket[0]) != at:
                lead_ids, lead_bits, lead_label, all_ids, all_bits, all_label = lead_ids[:0], lead_bits[:0], lead_label[:0], all_ids[:0], all_bits[:0], all_label[:0]
            label = ids.copy()
            x, free, left = _sets(bits), np.ones(len(ids), bool), np.flatnonzero((band == band[0]) & (bucket == bucket[0]))
            lo, step = 0, 64  # the oldest leaders have the most members
            while lo < len(lead_ids) and len(left):
                hit = x[left] @ _sets(lead_bits[lo : lo + step]).T >= least
                some = hit.any(axis=1)
                a.append(lead_ids[lo + hit[some].argmax(axis=1)])
                b.append(ids[left[some]])
                free[left[some]] = False
                if whole:
                    label[left[some]] = lead_label[lo + hit[some].argmax(axis=1)]
                left, lo, step = left[~some], lo + step, leaders
            hit = (x @ x.T >= least) & (band[:, None] == band) & (bucket[:, None] == bucket)
            np.fill_diagonal(hit, False)
            for i in np.flatnonzero(hit.any(axis=1)):
                if free[i]:
                    own = np.flatnonzero(hit[i] & free)
                    a.append(np.full(len(own), ids[i]))
                    b.append(ids[own])
                    free[own] = False
                    label[own] = label[i]
            if whole:
                i, j = np.nonzero(hit & (label[:, None] < label))
                for k in _joining(label[i], label[j], [label, lead_label, all_label]) if len(i) else ():
                    a.append(ids[i[k : k + 1]])
                    b.append(ids[j[k : k + 1]])
                first = np.flatnonzero((band == band[0]) & (bucket == bucket[0])) if len(all_ids) else ()
                for lo in range(0, len(all_ids), leaders):
                    one = (all_label[lo : lo + leaders] == all_label[lo]).all()
                    some = first[label[first] != all_label[lo]] if one else first
                    if not len(some):
                        continue
                    i, j = np.nonzero((x[some] @ _sets(all_bits[lo : lo + leaders]).T >= least) & (label[some][:, None] != all_label[lo : lo + leaders]))
                    i, j = some[i], j + lo
                    for k in _joining(label[i], all_label[j], [label, lead_label, all_label]) if len(i) else ():
                        a.append(all_ids[j[k : k + 1]])
                        b.append(ids[i[k : k + 1]])
            last = free & (band == band[-1]) & (bucket == bucket[-1])
            if (band[0], bucket[0]) != (band[-1], bucket[-1]):
                lead_ids, lead_bits, lead_label, all_ids, all_bits, all_label = lead_ids[:0], lead_bits[:0], lead_label[:0], all_ids[:0], all_bits[:0], all_label[:0]
            if whole:
                own = (band == band[-1]) & (bucket == bucket[-1])
                lead_label, all_ids, all_bits, all_label = np.concatenate([lead_label, label[last]]), np.concatenate([all_ids, ids[own]]), np.concatenate([all_bits, bits[own]]), np.concatenate([all_label, label[own]])
            at, lead_ids, lead_bits = (band[-1], bucket[-1]), np.concatenate([lead_ids, ids[last]]), np.concatenate([lead_bits, bits[last]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def verified_pairs(vecs: DataFrame, dim: int, directions: int, top: int, bands: int, rows: int, jaccard: float, whole: bool = False) -> DataFrame:
    """(a, b): vectors that share a bucket with one of its leaders and reach ``jaccard`` with it; with ``whole`` also as many others as join all that reach it."""

    def keyed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unpack(b.column(1), dim)
            s = set_of(x, directions, top)
            bits = np.zeros((len(x), 4), np.uint64)
            for k in range(top):
                w, at = s[:, k] >> 6, (s[:, k] & 63).astype(np.uint64)
                bits[np.arange(len(x)), w] |= np.uint64(1) << at
            bits = bits.view(np.int64)
            keys = bands_of(s, dim, directions, bands, rows)
            for c in range(bands):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(keys[:, c]), b.column(0), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))], names=["band", "bucket", "id", "f0", "f1", "f2", "f3"])

    k = vecs.select("id", "vec").mapInArrow(keyed, "band int, bucket long, id long, f0 long, f1 long, f2 long, f3 long")
    least = 2 * top * jaccard / (1 + jaccard) - 1e-9  # |A & B| for this Jaccard, both sets having ``top`` members
    ordered = k.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "id")
    return ordered.mapInArrow(lambda batches: led_pairs(batches, least, whole=whole), "a long, b long").distinct()


def nearest(vecs: DataFrame, means: np.ndarray, dim: int) -> DataFrame:
    """(columns of vecs, g, cos): the nearest mean of each vector; the means go out in blocks of bounded size."""

    def one(block: np.ndarray, base: int) -> DataFrame:
        def run(batches):
            for b in batches:
                if b.num_rows:
                    sim = unpack(b.column(b.schema.get_field_index("vec")), dim) @ block.T
                    g = sim.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array((g + base).astype(np.int32)), pa.array(sim[np.arange(len(g)), g].astype(np.float32))], names=[*b.schema.names, "g", "cos"])

        return vecs.mapInArrow(run, T.StructType([*vecs.schema.fields, T.StructField("g", T.IntegerType()), T.StructField("cos", T.FloatType())]))

    blocks = [one(means[i : i + BLOCK_OF_MEANS].astype(np.float32), i) for i in range(0, len(means), BLOCK_OF_MEANS)]
    if len(blocks) == 1:
        return blocks[0]
    every = functools.reduce(DataFrame.unionByName, blocks)
    keys = [c for c in vecs.columns if c != "vec"]
    return every.groupBy(*keys).agg(F.max_by(F.struct("vec", "g", "cos"), "cos").alias("m")).select(*keys, "m.vec", "m.g", "m.cos")


def sums(rows: DataFrame, group: str, dim: int) -> DataFrame:
    """(group, n, mean array<double>): summed in each partition first."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            if b.num_rows:
                x = unpack(b.column(1), dim).astype(np.float64)
                labels, inv = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                acc = np.zeros((len(labels), dim))
                np.add.at(acc, inv, x)
                for k, v, c in zip(labels.tolist(), acc, np.bincount(inv), strict=True):
                    total[k] = total.get(k, 0) + v
                    n[k] = n.get(k, 0) + int(c)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["g", "n", "s"])

    part = rows.select(F.col(group).cast("long").alias("g"), "vec").mapInArrow(run, "g long, n long, s array<double>")
    return part.groupBy("g").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s")).select(F.col("g").alias(group), "n", F.expr("transform(s, x -> x / n)").alias("mean"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def merged(means: np.ndarray, sizes: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """(means, sizes): means that are as near to each other as ``same`` become one, the larger group first."""
    out, unit, weight, n = np.zeros_like(means, dtype=np.float64), np.zeros_like(means, dtype=np.float64), np.zeros(len(means)), 0
    for k in np.argsort(-sizes, kind="stable"):
        sim = unit[:n] @ _unit(means[k])
        j = int(sim.argmax()) if n else 0
        if not n or sim[j] < same:
            j, n = n, n + 1
        out[j] += means[k] * sizes[k]
        weight[j] += sizes[k]
        unit[j] = _unit(out[j])
    return out[:n] / weight[:n, None], weight[:n]


def split_loose(loose: DataFrame, dim: int, least: int, apart: float, near_medoid: float, leaders: int) -> tuple[list[np.ndarray], list[int]]:
    """(means, sizes) of the groups in (id, vec, degree), around medoids, until none of the vectors can start one.

    A round takes its medoids from the ``leaders`` open vectors of highest degree. Vectors near a mean leave; medoids
    don't lead again, but stay as members for others, so each round has fewer open vectors.
    """
    found: list[np.ndarray] = []
    sizes: list[int] = []
    loose, old = loose.select("id", "vec", "degree", F.lit(True).alias("open")), None
    while True:
        lead = loose.where("open").orderBy(F.desc("degree"), "id").limit(leaders).select("id", "vec").toPandas()
        x = np.frombuffer(b"".join(lead["vec"]), np.float32).reshape(-1, dim)
        medoids, ids = np.empty_like(x), []
        for v, key in zip(x, lead["id"].tolist(), strict=True):
            if not ids or (medoids[: len(ids)] @ v).max() < apart:
                medoids[len(ids)] = v
                ids.append(key)
        if not ids:
            break
        sure = nearest(loose.select("id", "vec"), medoids[: len(ids)], dim)
        got = [r for r in sums(sure.where(F.col("cos") >= near_medoid), "g", dim).collect() if r["n"] >= least]  # a row a medoid
        left = loose
        if got:
            means = np.array([r["mean"] for r in got])
            found += list(means)
            sizes += [r["n"] for r in got]
            left = nearest(loose, _unit(means), dim).where(F.col("cos") < near_medoid).select("id", "vec", "degree", "open")
        tried = loose.sparkSession.createDataFrame([(k, True) for k in ids], "id long, tried boolean")
        left = left.join(F.broadcast(tried), "id", "left").select("id", "vec", "degree", (F.col("open") & F.col("tried").isNull()).alias("open"))
        loose = written(left, "loose")
        if old is not None:
            drop_written(old)
        old = loose
        if loose.limit(least).count() < least:
            break
    if old is not None:
        drop_written(old)
    return found, sizes


def group_means(
    vecs: DataFrame, dim: int = 64, directions: int = 256, top: int = 16, bands: int = 12, rows: int = 2, jaccard: float = 0.35, least: int = 8,
    tight: float = 0.62, apart: float = 0.4, near_medoid: float = 0.45, same: float = 0.85, leaders: int = 4000, passes: int = 2, cut: float = 0.5,
) -> np.ndarray:
    """The unit means of the groups of (id, vec); see the module. Groups of under ``least`` members don't count.

    The driver sees the means of components, in blocks of ``leaders`` where they are small, and up to ``leaders``
    candidates for medoids a round, never members.
    """
    edges = written(verified_pairs(vecs, dim, directions, top, bands, rows, jaccard, whole=True), "pairs")
    label = components(edges)
    degree = edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    size = label.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    core = written(vecs.select("id", "vec").join(label.join(size, "label").join(degree, "id"), "id").select("id", "vec", "label", "degree"), "core")
    parts = written(sums(core, "label", dim).withColumn("tight", F.expr("sqrt(aggregate(mean, 0d, (s, x) -> s + x * x))") >= tight), "parts")
    found: list[np.ndarray] = []
    sizes: list[int] = []
    for r in parts.where("tight").toLocalIterator():  # one row a group
        found.append(np.array(r["mean"]))
        sizes.append(r["n"])
    more, n = split_loose(core.join(parts.where("not tight").select("label"), "label", "left_semi"), dim, least, apart, near_medoid, leaders)
    found, sizes = found + more, sizes + n
    means = merged(np.stack(found), np.array(sizes), same)[0] if found else np.empty((0, dim))
    # small groups show as small components; those that no mean found so far covers are added, and must grow to count
    bits = label.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= 3)
    rest = vecs.select("id", "vec").join(label.join(bits, "label").select("id", "label"), "id")
    if len(means):
        rest = nearest(rest, _unit(means), dim).where(F.col("cos") < cut).select("id", "vec", "label")
    small = written(sums(rest, "label", dim).where((F.col("n") >= 3) & (F.expr("sqrt(aggregate(mean, 0d, (s, x) -> s + x * x))") >= tight)), "small")
    own, weight = np.empty((0, dim)), np.empty(0)
    components_ = small.orderBy(F.desc("n"), "label").toLocalIterator()
    while block := list(itertools.islice(components_, leaders)):  # a row a component
        own, weight = merged(np.concatenate([own, [r["mean"] for r in block]]), np.concatenate([weight, [r["n"] for r in block]]), 0.7)
    means = np.concatenate([means, own])
    for _ in range(passes):
        if not len(means):
            break
        got = sums(nearest(vecs.select("id", "vec"), _unit(means), dim).where(F.col("cos") >= cut), "g", dim).collect()  # a row a group
        got = [r for r in got if r["n"] >= least]
        means = merged(np.array([r["mean"] for r in got]), np.array([r["n"] for r in got]), same)[0] if got else np.empty((0, dim))
    for t in (edges, core, parts, small):
        drop_written(t)
    return _unit(means)


def cluster(df: DataFrame, key: str = "id", vector: str = "embedding", project: str = "project", dim: int = 64, cut: float = 0.5, **options) -> DataFrame:
    """(id, project, g, cos): the group of each row, null where its cosine to every group's mean is below ``cut``.

    ``key`` is a long. Re-delivered rows count once; rows with unusable vectors or a null key are left out; without
    any group (few or no rows) every g is null. ``project`` is passed through. Other columns play no part.
    """
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(project).alias("project"), F.col(vector).alias("v"))
    vecs = written(unit_vectors(src, "id", "v", dim, ["project"]).dropDuplicates(["id"]), "unit")
    means = group_means(vecs, dim, cut=cut, **options)
    if not len(means):
        return vecs.select("id", "project", F.lit(None).cast("int").alias("g"), F.lit(None).cast("float").alias("cos"))
    return nearest(vecs, means, dim).select("id", "project", F.when(F.col("cos") >= cut, F.col("g")).alias("g"), "cos")


def misfiled(groups: DataFrame) -> DataFrame:
    """(id, project): rows of a group most of whose rows are filed under the other project given."""
    counts = groups.where("g is not null").groupBy("g", "project").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("g"))
    main = counts.withColumn("share", F.col("n") / total).where("share > 0.5 and project is not null").select("g", F.col("project").alias("home"))
    return groups.join(main, "g").where("project != home").select("id", F.col("home").alias("project"))


def typical(groups: DataFrame, members: int = 5) -> DataFrame:
    """(g, size, rank, id, cos): the most typical rows of each group, those nearest to its mean, with its size."""
    size = groups.where("g is not null").groupBy("g").agg(F.count("*").alias("size"))
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("cos"), "id"))
    return groups.where("g is not null").withColumn("rank", rank).where(F.col("rank") <= members).join(size, "g").select("g", "size", "rank", "id", F.round("cos", 4).alias("cos"))
