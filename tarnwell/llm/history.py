"""New batches against all history: multi-key sorted-neighbourhood runs.

A body is known by a fingerprint: a hash of its raw content, a hash of its words, its words as small integers, and
``KEYS`` sort keys, each a chain of MinHash values of five-word shingles. Bodies with one hash form a class; only
the first of a class enters the runs. A run holds the sort keys of one batch, sorted and cut into key ranges; a new
batch is sorted, merged with the key ranges of the earlier runs that it touches, and only the windows around its new
records are compared. Candidates are verified on their whole bodies.

What is kept of the past (runs, fingerprints, names of contents, classes) is cut into ranges of about ``rows_a_range``
rows by the key by which it is looked up, a folder each, and a batch opens only the ranges that its own keys fall
into. Runs and all else are compacted when there are many. The chunks of earlier batches are never read again.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.llm.components import components
from tarnwell.session import drop_written, shared_folder, written

KEYS, CHAIN, SHINGLE = 24, 3, 5
#: Bins of the word histogram, which bounds what two bodies can share.
BINS = 256
#: Fixed value: SHA-256 of nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
PRINTS = "id long, ts timestamp_ntz, raw string, words_hash string, n_words int, words binary, keys binary, bins binary"


class _Words(dict):
    """Word to 32-bit hash, remembered for the frequent ones."""

    def __missing__(self, w: str) -> int:
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[w] = h
        return h


@functools.lru_cache(maxsize=1)
def _tools():
    import re

    import xxhash

    rng = np.random.default_rng(11)
    return re.compile(r"\w+"), _Words().__getitem__, xxhash.xxh3_128_hexdigest, rng.integers(1, 2**63, KEYS, np.uint64) | np.uint64(1), rng.integers(1, 2**63, KEYS, np.uint64)


def words_of(text: str) -> np.ndarray:
    """The words of a text as integers; case, spacing and punctuation don't count."""
    find, word, *_ = _tools()
    w = find.findall(text.lower())
    return np.fromiter(map(word, w), np.uint32, len(w))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words (of all words if there are fewer)."""
    n = max(1, min(n, len(w)))
    x = w.astype(np.uint64)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k] + np.uint64(k + 1)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def sort_keys(w: np.ndarray) -> np.ndarray:
    """``KEYS`` MinHash values of the shingles."""
    *_, a, b = _tools()
    h = grams(w, SHINGLE)
    h ^= h >> np.uint64(32)
    out = np.empty(KEYS, np.uint32)
    for k in range(KEYS):
        out[k] = ((h * a[k] + b[k]) >> np.uint64(32)).min()
    return out * np.uint32(2654435761)  # minima lie near 0: spread again, so that the key ranges are even


def histogram(w: np.ndarray) -> np.ndarray:
    """Counts of the words by hash, up to 255: the smaller counts of two bodies add up to no less than they share."""
    return np.minimum(np.bincount((w * np.uint32(2654435761)) >> np.uint32(24), minlength=BINS), 255).astype(np.uint8)


def fingerprints(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """The fingerprint of each source (see ``PRINTS``), re-delivered rows once.

    The raw hash is content_hash where that holds 64 hex digits (whatever its case, blanks and prefix), else that of
    the chunks joined by blank lines, else null. Sources without words have no words_hash; those with no content at
    all have neither and repeat nothing. Chunks of no source and of null content are left out. Of chunks that share
    an index the smaller id reads first.
    """
    s = sources.where("id is not null").select("id", F.col("ingest_ts").alias("ts"), F.regexp_extract(F.lower("content_hash"), "([0-9a-f]{64})", 1).alias("given")).dropDuplicates(["id"])
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", F.col("id").alias("chunk_id"), "content")))
    c = chunks.where("content is not null").select(F.col("source_id").alias("id0"), "chunk_index", "id", "content").groupBy("id0").agg(parts.alias("parts"))
    joined = s.join(c, F.col("id") == F.col("id0"), "left").select("id", "ts", "given", F.array_join(F.transform(F.array_distinct("parts"), lambda x: x["content"]), "\n\n").alias("body"))

    def run(batches):
        import hashlib

        _, _, digest, *_ = _tools()
        for b in batches:
            raws, hashes, ns, words, keys, bins = [], [], [], [], [], []
            for given, body in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = words_of(body) if body else np.empty(0, np.uint32)
                blank = body is not None and not body.strip()
                raw = given or (hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest() if body else None)
                raws.append(None if raw == EMPTY or blank else raw)
                ns.append(len(w))
                hashes.append(digest(w.tobytes()) if len(w) else None)
                words.append(w.tobytes() if len(w) else None)
                keys.append(sort_keys(w).tobytes() if len(w) else None)
                bins.append(histogram(w).tobytes() if len(w) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raws, pa.string()), pa.array(hashes, pa.string()), pa.array(ns, pa.int32()), pa.array(words, pa.binary()), pa.array(keys, pa.binary()), pa.array(bins, pa.binary())], names=["id", "ts", "raw", "words_hash", "n_words", "words", "keys", "bins"])

    return joined.mapInArrow(run, PRINTS)


def _covered(a: np.ndarray, b: np.ndarray, n: int) -> int:
    """Words of ``a`` in a run of ``n`` words that ``b`` has too."""
    if len(a) < n or len(b) < n:
        return 0
    hit = np.isin(grams(a, n), grams(b, n))
    cover = np.zeros(len(a) + 1, np.int32)
    np.add.at(cover, np.flatnonzero(hit), 1)
    ends = np.zeros(len(a) + n + 1, np.int32)
    np.add.at(ends, np.flatnonzero(hit) + n, 1)
    return int((np.cumsum(cover - ends[: len(a) + 1])[: len(a)] > 0).sum())


def _in_order(a: list[int], b: list[int]) -> int:
    """Words matched in order, block by block, where blocks of five words and more may have moved."""
    from difflib import SequenceMatcher

    total = 0
    for _ in range(12):
        blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        got = sum(m.size for m in blocks)
        total += got
        if not got or max(m.size for m in blocks) < 5:
            break
        # what is left may match elsewhere: a moved paragraph; -1 and -2 keep runs from growing together
        for m in blocks:
            for k in range(m.size):
                a[m.a + k], b[m.b + k] = -1, -2
        a = [x for i, x in enumerate(a) if x != -1 or (i and a[i - 1] != -1)]
        b = [x for i, x in enumerate(b) if x != -2 or (i and b[i - 1] != -2)]
        if SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size < 5:
            break
    return total


def same_body(a: np.ndarray, b: np.ndarray, share: float = 0.8) -> bool:
    """Whether ``share`` of the words of the longer text stand in the other in the same order, blocks moved or not."""
    if len(a) < len(b):
        a, b = b, a
    need = math.ceil(share * len(a) - 1e-9)
    if len(b) < need or not len(a):
        return False
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return False
    if _covered(a, b, 8) >= need:
        return True
    return _in_order(a.tolist(), b.tolist()) >= need


def entries(prints: DataFrame) -> DataFrame:
    """(key_no, k0, k1, k2, id): the sort keys of the fingerprints, a chain of MinHash values for each."""

    def run(batches):
        for b in batches:
            k = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, KEYS).astype(np.int64)
            for n in range(KEYS):
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), *(pa.array(np.ascontiguousarray(k[:, (n + c) % KEYS])) for c in range(CHAIN)), b.column(0)], names=["key_no", "k0", "k1", "k2", "id"])

    return prints.where("keys is not null").select("id", "keys").mapInArrow(run, "key_no int, k0 long, k1 long, k2 long, id long")


def windows(merged: DataFrame, window: int, agree: int = 2) -> DataFrame:
    """(a, b): a new record and one of the ``window`` records before or after it in the sorted runs of ``agree`` keys.

    A window ends where the first hash of the chain changes: what lies beyond agrees in nothing. The runs are sorted
    by range over the whole key, so a hash that a third of all rows share is spread over many tasks. The first and
    last rows of each range are kept beside its pairs, and the windows across the borders are made from these.
    """
    order = ["key_no", "k0", "k1", "k2", "id"]

    def compare(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        tail = [np.empty(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            at = np.arange(seen, seen + batch.num_rows)
            if seen < window:  # the first rows of the range
                first = slice(0, window - seen)
                yield _rows(edge=[x[first] for x in now], part=part, at=at[first])
            key, k0, new, ids = (np.concatenate([t, x]) for t, x in zip(tail, now, strict=True))
            old = len(tail[0])
            a, b = [], []
            for d in range(1, window + 1):
                j = np.arange(max(old, d), len(ids))
                i = j - d
                hit = (key[i] == key[j]) & (k0[i] == k0[j]) & ((new[i] | new[j]) > 0) & (ids[i] != ids[j])
                a.append(np.minimum(ids[i[hit]], ids[j[hit]]))
                b.append(np.maximum(ids[i[hit]], ids[j[hit]]))
            yield _rows(pairs=(np.concatenate(a), np.concatenate(b)))
            tail = [x[-window:] for x in (key, k0, new, ids)]
            seen += batch.num_rows
        if seen > window:  # the last rows, those that aren't among the first
            m = min(window, seen - window)
            yield _rows(edge=[x[-m:] for x in tail], part=part, at=np.arange(seen - m, seen))

    def across(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).to_pandas().sort_values(["part", "at"])
        size = t.groupby("part")["at"].max() + 1
        place = (t["at"] + t["part"].map(size.cumsum() - size)).to_numpy()
        part, key, k0, new, ids = (t[c].to_numpy() for c in ("part", "key_no", "k0", "new", "id"))
        for d in range(1, min(2 * window, len(t))):  # neighbours in this table are at least as near in the run
            i, j = np.arange(len(t) - d), np.arange(d, len(t))
            hit = (part[i] != part[j]) & (place[j] - place[i] <= window) & (key[i] == key[j]) & (k0[i] == k0[j]) & ((new[i] | new[j]) > 0) & (ids[i] != ids[j])
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i[hit]], ids[j[hit]])), pa.array(np.maximum(ids[i[hit]], ids[j[hit]]))], names=["a", "b"])

    found = written(merged.select("key_no", "k0", F.col("new").cast("int").alias("new"), "id", "k1", "k2").repartitionByRange(*order).sortWithinPartitions(*order).select("key_no", "k0", "new", "id").mapInArrow(compare, WINDOWED), "windows")
    # a few rows a range: one task
    border = found.where("part is not null").select("part", "at", "key_no", "k0", "new", "id").repartition(1).mapInArrow(across, "a long, b long")
    every = found.where("a is not null").select("a", "b").unionByName(border)
    return every.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= agree).select("a", "b")


WINDOWED = "a long, b long, part int, at long, key_no int, k0 long, new int, id long"


def _rows(pairs=None, edge=None, part: int = 0, at=None) -> pa.RecordBatch:
    """Pairs, or rows at the edge of a range, in the columns of ``WINDOWED``."""
    n = len(pairs[0]) if pairs is not None else len(at)
    none = lambda kind: pa.nulls(n, kind)
    if pairs is not None:
        cols = [pa.array(pairs[0]), pa.array(pairs[1]), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.int64())]
    else:
        key, k0, new, ids = edge
        cols = [none(pa.int64()), none(pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(at.astype(np.int64)), pa.array(key.astype(np.int32)), pa.array(k0), pa.array(new.astype(np.int32)), pa.array(ids)]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "part", "at", "key_no", "k0", "new", "id"])


def verified(pairs: DataFrame, prints: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose whole bodies repeat each other.

    The histograms come first: they rule out most chance pairs, and never a true one, before any words move.
    """
    h = prints.select("id", "n_words", "bins")
    known = pairs.join(h.select(F.col("id").alias("a"), F.col("n_words").alias("na"), F.col("bins").alias("ha")), "a").join(h.select(F.col("id").alias("b"), F.col("n_words").alias("nb"), F.col("bins").alias("hb")), "b")
    close = known.where(F.least("na", "nb") >= share * F.greatest("na", "nb") - 1e-9)

    def possible(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
                longer = np.maximum(b.column(2).to_numpy(), b.column(3).to_numpy())
                full = (x.max(axis=1) == 255) | (y.max(axis=1) == 255)
                keep = pa.array(full | (np.minimum(x, y).sum(axis=1, dtype=np.int64) >= share * longer - 1e-9))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    near = close.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(possible, "a long, b long")
    w = prints.select("id", "words")
    both = near.join(w.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(w.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")

    def run(batches):
        for b in batches:
            ok = [same_body(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), share) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


#: By what each table of the past is looked up.
LOOKUP = {"runs": "k0", "prints": "id", "names": "raw", "classes": "cls"}


class History:
    """All bodies accepted so far, in a folder that every executor sees.

    ``add`` takes the fingerprints of a batch and returns (id, first): each source of the batch that repeats an
    earlier one, with the earliest source (ts, then id) of its body. Batches come in any order; a source of a later
    batch never changes what an earlier batch was told. ``rows_read`` counts the rows of the past that ``add`` opened.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = 8, share: float = 0.8, most_runs: int = 8, rows_a_range: int = 65_536, most_ranges: int = 4096, heads: int = 16, measure: bool = False) -> None:
        self.spark, self.window, self.share, self.most_runs, self.heads = spark, window, share, most_runs, heads
        self.rows_a_range, self.most_ranges, self.measure, self.rows_read = rows_a_range, most_ranges, measure, Counter()
        self.folder = folder or f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
        self.tables: dict[str, list[list]] = {k: [] for k in LOOKUP}  # [path, ranges, schema] of each part

    def save(self) -> None:
        """Writes the list of parts beside them, so that ``load`` finds this state again."""
        self.spark.createDataFrame([(json.dumps(self.tables),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, **options) -> History:
        h = cls(spark, folder, **options)
        h.tables = json.loads(spark.read.text(f"{folder}/state").first()["value"])
        return h

    @staticmethod
    def _range(kind: str, ranges: int):
        """The range that a key falls into: of the runs a range of the first hash, of the others one of the key's hash."""
        key = F.col(LOOKUP[kind])
        return F.shiftright(key, 32 - (ranges.bit_length() - 1)).cast("int") if kind == "runs" else F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")

    def _put(self, df: DataFrame, kind: str, rows: int, order: list[str]) -> DataFrame:
        """Writes a part, cut into ranges of about ``rows_a_range`` rows, and returns it."""
        ranges = 1
        while ranges * self.rows_a_range < rows and ranges < self.most_ranges:
            ranges *= 2
        path = f"{self.folder}/{kind}/{uuid.uuid4().hex}"
        if ranges > 1:
            df.withColumn("range", self._range(kind, ranges)).repartition("range").sortWithinPartitions("range", *order).write.partitionBy("range").parquet(path)
        else:
            df.withColumn("range", F.lit(0)).write.partitionBy("range").parquet(path)
        self.tables[kind].append([path, ranges, df.schema.json()])
        return self._part(self.tables[kind][-1])

    def _part(self, part: list, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(part[2]))
        df = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("range", T.IntegerType())])).parquet(part[0])
        return (df if only is None else df.where(F.col("range").isin(only))).select(schema.names)

    def touched(self, kind: str, keys: DataFrame, parts: list[list] | None = None) -> DataFrame | None:
        """The ranges of the past that the keys (a column named as in ``LOOKUP``) fall into; None if there is no past."""
        out, wanted = None, {}
        for part in self.tables[kind] if parts is None else parts:
            n = part[1]
            if n > 1 and n not in wanted:
                wanted[n] = [r[0] for r in keys.where(F.col(LOOKUP[kind]).isNotNull()).select(self._range(kind, n)).distinct().collect()]  # ``most_ranges`` rows at most
            d = self._part(part, None if n == 1 or len(wanted[n]) == n else wanted[n])
            if self.measure:
                self.rows_read[kind] += d.count()
            out = d if out is None else out.unionByName(d)
        return out

    def compact(self) -> None:
        """Merges the parts of each table into one, cut anew; of the fingerprints only those of classes' first bodies stay."""
        for kind, order in (("runs", ["key_no", "k0", "k1", "k2", "id"]), ("classes", ["cls"]), ("names", ["raw"]), ("prints", ["id"])):
            old = list(self.tables[kind])
            if len(old) > 1:
                df = functools.reduce(DataFrame.unionByName, [self._part(p) for p in old])
                if kind == "prints":
                    reps = functools.reduce(DataFrame.unionByName, [self._part(p) for p in self.tables["classes"]]).select(F.col("rep").alias("id")).where("id is not null").distinct()
                    df = df.join(reps, "id", "left_semi")
                elif kind == "classes":
                    df = df.groupBy("cls").agg(F.max("rep").alias("rep"), F.min(F.struct("ts", "id")).alias("f")).select("cls", "rep", "f.ts", "f.id")
                elif kind == "names":
                    df = df.groupBy("raw", "cls", "has_words").agg(F.min(F.struct("ts", "id")).alias("f")).select("raw", "cls", "has_words", "f.ts", "f.id")
                rows = df.count()
                self.tables[kind] = []
                self._put(df, kind, rows, order)
                for p in old:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(p[0])
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _firsts(self, reps: DataFrame, heads: DataFrame) -> DataFrame:
        """(rep, first): the earliest source of the class of each of the bodies ``reps`` (rep), from this batch and from the ranges it touches."""
        now = heads.join(reps, "rep", "left_semi").select("rep", "first")
        past = self.touched("prints", reps.select(F.col("rep").alias("id")), self.tables["prints"][:-1])
        if past is not None:
            own = written(past.select(F.col("id").alias("rep"), F.col("words_hash").alias("cls")).join(reps, "rep", "left_semi"), "classes-of")
            old = self.touched("classes", own)
            if old is not None:
                known = own.join(old.select("cls", F.struct("ts", "id").alias("first")), "cls").select("rep", "first")
                now = now.unionByName(known)
        return written(now.groupBy("rep").agg(F.min("first").alias("first")), "firsts")

    def add(self, batch: DataFrame, rows: int | None = None) -> DataFrame:
        """See the class; ``rows`` is about how many there are, if known, and decides into how many ranges they are cut."""
        made: list[DataFrame] = []

        def keep(df: DataFrame, label: str) -> DataFrame:
            made.append(written(df, label))
            return made[-1]

        new = self._put(batch, "prints", rows or 0, ["id"])
        slim = new.where("raw is not null or words_hash is not null").select("id", "ts", "raw", "words_hash")
        # a source without chunks has its words_hash from another source of the same raw content
        known = slim.where("words_hash is not null and raw is not null").groupBy("raw").agg(F.min("words_hash").alias("wh"))
        past = self.touched("names", slim.select("raw"))
        if past is not None:
            known = known.unionByName(past.where("has_words").select("raw", F.col("cls").alias("wh"))).groupBy("raw").agg(F.min("wh").alias("wh"))
        cls = F.coalesce("words_hash", "wh", "raw")
        named = keep(slim.join(known, "raw", "left").select("id", "ts", "raw", cls.alias("cls"), F.coalesce("words_hash", "wh").isNotNull().alias("has_words"), F.col("words_hash").isNotNull().alias("own")), "named")
        head = F.min(F.struct("ts", "id")).alias("first")
        heads = named.groupBy("cls").agg(head, F.min(F.when(F.col("own"), F.struct("ts", "id"))).alias("body"))
        old = self.touched("classes", named.select("cls"))
        if old is not None and past is not None:
            # raw first: a class that was known by its raw hash alone may get its words only now
            before = old.groupBy("cls").agg(F.min(F.struct("ts", "id")).alias("old"), F.max("rep").alias("old_rep"))
            aka = past.where("not has_words").select("raw", F.struct("ts", "id").alias("o"))
            late = named.where("has_words and raw is not null").select("cls", "raw").distinct().join(aka, "raw").groupBy("cls").agg(F.min("o").alias("late"))
            heads = heads.join(before, "cls", "left").join(late, "cls", "left")
        else:
            heads = heads.withColumn("old", F.lit(None).cast(named.select(head).schema[0].dataType)).withColumn("old_rep", F.lit(None).cast("long")).withColumn("late", F.col("old"))
        heads = keep(heads.select("cls", F.least("first", "old", "late").alias("first"), F.coalesce("old_rep", "body.id").alias("rep"), (F.col("old_rep").isNull() & F.col("body").isNotNull()).alias("fresh")), "heads")
        # only the first body of a new class enters the runs
        fresh = heads.where("fresh").select(F.col("rep").alias("id"))
        run = self._put(entries(new.join(fresh, "id", "left_semi")), "runs", fresh.count() * KEYS, ["key_no", "k0", "k1", "k2", "id"])
        merged = run.withColumn("new", F.lit(True))
        earlier = self.touched("runs", run.select("k0"), self.tables["runs"][:-1])
        if earlier is not None:
            merged = merged.unionByName(earlier.join(run.select("key_no", "k0").distinct(), ["key_no", "k0"], "left_semi").withColumn("new", F.lit(False)))
        candidates = keep(windows(merged, self.window), "candidates")
        ids = keep(candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct(), "ids")
        links = keep(verified(candidates, self.touched("prints", ids), self.share), "links")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = self._firsts(both.select(F.col("a").alias("rep")).distinct(), heads)
        made.append(first)
        direct = both.join(first.select(F.col("rep").alias("b"), F.col("first").alias("other")), "b").groupBy("a").agg(F.min("other").alias("near"))
        best = direct.unionByName(self._far(links, candidates, first, made)).groupBy("a").agg(F.min("near").alias("near"))
        firsts = heads.join(best, heads.rep == best.a, "left").select("cls", F.least("first", "near").alias("first"))
        out = written(named.join(firsts, "cls").where("first.id != id").select("id", F.col("first.id").alias("first")), "found")
        seen = named.where("raw is not null").groupBy("raw", "cls", "has_words").agg(F.min(F.struct("ts", "id")).alias("f")).select("raw", "cls", "has_words", "f.ts", "f.id")
        classes = heads.count()
        self._put(seen, "names", classes, ["raw"])
        own = named.groupBy("cls").agg(F.min(F.struct("ts", "id")).alias("f"))
        self._put(heads.select("cls", "rep").join(own, "cls").select("cls", "rep", "f.ts", "f.id"), "classes", classes, ["cls"])
        for t in made:
            drop_written(t)
        if len(self.tables["runs"]) > self.most_runs:
            self.compact()
        return out

    def _far(self, links: DataFrame, candidates: DataFrame, first: DataFrame, made: list) -> DataFrame:
        """(a, near): members of families with an earlier body that their windows don't show.

        The members of a family are verified against its ``heads`` earliest bodies. Those that none of these matches
        are taken again against the earliest of what is left, until all that is left has led. Every round compares each
        member with a few heads, more from round to round, never all with all. Families of up to ``heads`` different
        bodies are therefore exact; in larger ones that drift a member may get the second earliest.
        """
        label = components(links)
        left = written(label.join(first, label.id == first.rep).select("label", "rep", "first"), "family")
        if left.count() == 0:
            return left.select(F.col("rep").alias("a"), F.col("first").alias("near")).limit(0)
        bodies = self.touched("prints", left.select(F.col("rep").alias("id")))
        found, heads = None, self.heads
        while True:
            place = F.row_number().over(W.partitionBy("label").orderBy("first", "rep"))
            lead = written(left.withColumn("k", place).where(F.col("k") <= heads).select("label", F.col("rep").alias("r"), F.col("first").alias("f")), "lead")
            far = left.join(lead, "label").where("rep != r and f < first").select(F.col("rep").alias("m"), "r", "f")
            # what the windows verified already needs no second look
            pair = far.select(F.least("m", "r").alias("a"), F.greatest("m", "r").alias("b"))
            more = written(verified(pair.join(candidates, ["a", "b"], "left_anti"), bodies, self.share).unionByName(pair.join(links, ["a", "b"], "left_semi")), "more")
            reach = far.join(more, (F.least("m", "r") == more.a) & (F.greatest("m", "r") == more.b)).groupBy("m").agg(F.min("f").alias("near")).withColumnRenamed("m", "a")
            reach = written(reach, "reach")
            made += [lead, more, reach]
            found = reach if found is None else found.unionByName(reach)
            rest = left.join(lead.select(F.col("r").alias("rep")), "rep", "left_anti").join(reach.select(F.col("a").alias("rep")), "rep", "left_anti")
            rest = written(rest.select("label", "rep", "first"), "family")
            made.append(left)
            left, heads = rest, min(2 * heads, 256)
            if left.limit(1).count() == 0:
                made.append(left)
                return found


def against_history(sources: DataFrame, chunks: DataFrame, edges: list | None = None, **options) -> DataFrame:
    """(id, first) over a whole table, taken in as batches: ``edges`` are the instants at which a new batch begins.

    Sources without ingest_ts come last. The fingerprints are made batch by batch, each from its own chunks alone.
    """
    spark = sources.sparkSession
    h = History(spark, **options)
    bounds = [None, *(edges or []), None]
    found = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = sources
        if lo is not None:
            part = part.where((F.col("ingest_ts") >= F.lit(lo)) | (F.col("ingest_ts").isNull() if hi is None else F.lit(False)))
        if hi is not None:
            part = part.where(F.col("ingest_ts") < F.lit(hi))
        own = chunks if lo is None and hi is None else chunks.join(part.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
        found.append(h.add(fingerprints(part, own), part.count()))
    return functools.reduce(DataFrame.unionByName, found)
