"""Cutting oversized texts at natural boundaries by lexical cohesion.

The text is read as units (paragraph, line and sentence ends, and word ends where a sentence alone is too long).
At each boundary the words of the block before it are compared with those of the block after it; the depth of the
valley in this similarity says how far the topic turns there. Each piece ends at the deepest valley among the
strongest kind of boundary in its size window, and the next piece begins up to ``overlap`` characters earlier.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.session import written

#: Fixed value: the characters Unicode calls white space (Java and the regex module know them by this property).
SPACE = r"\p{IsWhite_Space}"


def stripped(c: Column) -> Column:
    """The text without any Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_oversized(c: Column, max_chars: int, max_tokens: int) -> Column:
    """Whether the stripped text has more code points or more runs of other characters than allowed; null: false."""
    s = stripped(c)
    long = F.char_length(s) > max_chars
    # max_tokens + 1 runs need 2 * max_tokens + 1 characters, which spares the count for most texts
    many = (F.char_length(s) > 2 * max_tokens) & (F.size(F.regexp_extract_all(s, F.lit(rf"\P{{IsWhite_Space}}+"), 0)) > max_tokens)
    return F.coalesce(long | many, F.lit(False))


def _re():
    import regex

    return regex


def _ends(text: str) -> list[tuple[int, int]]:
    """(position after the boundary's white space, level) in order: 3 paragraph, 2 line, 1 sentence, 0 word."""
    out = []
    for m in _re().finditer(r"\p{White_Space}+", text):
        gap = m.group()
        if not m.start() or m.end() == len(text):
            continue
        breaks = gap.count("\n")
        level = 3 if breaks > 1 else 2 if breaks else 1 if text[m.start() - 1] in ".!?…。！？" or text[m.start() - 2 : m.start()] in ('."', "!\"", '?"', ".'", ".)") else 0
        out.append((m.end(), level))
    for m in _re().finditer(r"[。！？](?=\P{White_Space})", text):  # scripts that put no space after a sentence
        out.append((m.end(), 1))
    return sorted(set(out))


def _valleys(text: str, ends: list[tuple[int, int]], block: int) -> dict[int, float]:
    """Depth of the similarity valley at each boundary above word ends, from blocks of ``block`` words."""
    words = [(m.start(), m.group().lower()) for m in _re().finditer(r"[\p{L}\p{N}]+", text)]
    where = [p for p, level in ends if level]
    sims = []
    k = 0
    for p in where:
        while k < len(words) and words[k][0] < p:
            k += 1
        a, b = Counter(w for _, w in words[max(0, k - block) : k]), Counter(w for _, w in words[k : k + block])
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        sims.append(sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0)
    depth = {}
    n = len(sims)
    for i, s in enumerate(sims):
        left = i
        while left > 0 and sims[left - 1] >= sims[left]:
            left -= 1
        right = i
        while right < n - 1 and sims[right + 1] >= sims[right]:
            right += 1
        depth[where[i]] = sims[left] + sims[right] - 2 * s
    return depth


def cut(text: str, max_chars: int = 2000, max_tokens: int = 350, overlap: int = 200, block: int = 60) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``, each within both limits, white space at its ends left out.

    A text within the limits is one piece, a blank one none. Consecutive pieces overlap by at most ``overlap``
    characters, whole words if there are any. Text without any boundary is cut at the limit itself.
    """
    re = _re()
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\P{White_Space}+", text)]
    if not tokens:
        return []
    lo, hi = tokens[0][0], tokens[-1][1]
    starts = [a for a, _ in tokens]
    if hi - lo <= max_chars and len(tokens) <= max_tokens:
        return [(lo, hi)]
    from bisect import bisect_left, bisect_right

    ends = [(p, level) for p, level in _ends(text) if lo < p < hi]
    places = [p for p, _ in ends]
    depth = _valleys(text, ends, block)
    pieces = []
    begin, after = lo, lo  # ``begin`` with the overlap, ``after``: where new text starts
    while True:
        first = bisect_right(starts, begin) - 1
        limit = begin + max_chars
        if first + max_tokens < len(tokens):
            limit = min(limit, starts[first + max_tokens])
        if hi <= limit:
            pieces.append((begin, hi))
            break
        # the white space of a boundary doesn't count against the limit
        t = bisect_left(starts, limit + 1) if limit in starts[bisect_left(starts, limit) : bisect_left(starts, limit) + 1] else bisect_left(starts, limit)
        reach = starts[t] if t < len(tokens) and tokens[t - 1][1] <= limit else limit
        least = max(after + 1, begin + (limit - begin) // 2)
        window = range(bisect_left(places, least), bisect_right(places, reach))
        if not window:
            window = range(bisect_left(places, after + 1), bisect_right(places, reach))
        if window:
            best = max(ends[i][1] for i in window)
            at = max((i for i in window if ends[i][1] == best), key=lambda i: (depth.get(places[i], 0.0), places[i]))
            stop = places[at]
        else:
            stop = limit
        end = tokens[bisect_left(starts, stop) - 1][1]
        pieces.append((begin, min(end, stop)))
        after = stop
        # the overlap: whole words before the cut, fewer than half a piece, never back to where this piece began
        from_ = max(stop - overlap, begin + 1)
        k = bisect_left(places, from_)
        nxt = places[k] if k < len(places) and places[k] < stop else stop if window else from_
        head = bisect_left(starts, nxt)
        if bisect_left(starts, stop) - head > max_tokens // 4:
            head = bisect_left(starts, stop) - max_tokens // 4
            nxt = starts[head]
        begin = starts[head] if head < len(starts) and nxt in (starts[head], *places[k : k + 1]) and starts[head] < stop else nxt
        if begin >= stop:
            begin = starts[bisect_left(starts, stop)] if bisect_left(starts, stop) < len(starts) and window else stop
    return pieces


def split_oversized(
    df: DataFrame, key: str = "id", text: str = "content", max_chars: int = 2000, max_tokens: int = 350, overlap: int = 200, block: int = 60
) -> DataFrame:
    """(key, piece_no, start, piece) of the oversized texts of ``df`` only; other columns play no part.

    Null, blank and small texts give no rows. A repeated row gives its pieces again. Pieces are numbered from 0;
    ``start`` is the offset of the piece in the text, in code points. Limits as in ``is_oversized``.
    """
    big = df.where(is_oversized(F.col(text), max_chars, max_tokens)).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = cut(t, max_chars, max_tokens, overlap, block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(p), b.schema.field(0).type), pa.array(range(len(p)), pa.int32()), pa.array([x for x, _ in p], pa.int32()), pa.array([t[x:y] for x, y in p], pa.string())],
                    names=["key", "piece_no", "start", "piece"],
                )

    fields = [T.StructField("key", df.schema[key].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("piece", T.StringType())]
    return big.mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)


def rechunk(chunks: DataFrame, **limits: int) -> DataFrame:
    """(source_id, chunk_id, piece_no, new_index, start, piece): the pieces of oversized chunks, numbered in reading order.

    ``new_index`` counts the pieces of a source, chunks within the limits being one piece each. Re-delivered rows
    count once; of rows that share (source_id, chunk_index) the smaller id reads first; a null index reads last.
    """
    c = chunks.select("id", "source_id", "chunk_index", "content").dropDuplicates(["id"])
    pieces = written(split_oversized(c, "id", "content", **limits), "pieces")  # counted and joined below: split once
    sizes = pieces.groupBy("id").agg(F.count("*").alias("n"))
    order = W.partitionBy("source_id").orderBy(F.col("chunk_index").asc_nulls_last(), "id").rowsBetween(W.unboundedPreceding, -1)
    base = c.select("id", "source_id", "chunk_index").join(sizes, "id", "left").withColumn("base", F.coalesce(F.sum(F.coalesce("n", F.lit(1))).over(order), F.lit(0))).where("n is not null")
    return pieces.join(base.select("id", "source_id", "base"), "id").select("source_id", F.col("id").alias("chunk_id"), "piece_no", (F.col("base") + F.col("piece_no")).alias("new_index"), "start", "piece")
