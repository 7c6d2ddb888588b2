"""Reading level of documents: the median of several readability formulas, each brought to the raters' scale.

Sentences, words and syllables are counted in one pass. Syllables follow hyphenation-style rules: vowel groups of a
word, less the silent endings. Each classic formula gives a grade; what it means on the raters' scale is learned
from the labelled documents by a monotone fit, formula by formula, and a document's level is the median of these.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ["sentences", "words", "letters", "syllables", "poly", "mono", "long", "tokens"]
FORMULAS = ["flesch_kincaid", "fog", "smog", "ari", "coleman_liau", "forcast", "lix"]


@functools.lru_cache(maxsize=1)
def _patterns():
    import re

    return {
        "word": re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*"),
        "end": re.compile(r"[.!?…]+(?=[\s\"'”’»)\]]|$)|\n\s*\n|\n(?=\s*[-*•\d#>|])"),
        "vowels": re.compile(r"[aeiouyàáâäãåæèéêëìíîïòóôöøœùúûüýÿ]+"),
        "silent": re.compile(r"(?:[^aeiouyl]|[^aeiouy]l)e$|[^aeiouytd]ed$|[^aeiouysxzc]es$"),
        "apart": re.compile(r"i[ao]|[^cgst]ious|[aeo]ing|ea[nt]e|eo|ua[lt]|uou|[^q]ui[nt]|iu"),
    }


def syllables(word: str) -> int:
    """Syllables of a word: its vowel groups, less a silent ending, plus vowels that meet without merging."""
    p = _patterns()
    w = word.lower()
    n = len(p["vowels"].findall(w))
    if len(w) > 3 and p["silent"].search(w) and not (w.endswith("le") and len(w) > 2 and w[-3] not in "aeiouy"):
        n -= 1
    n += len(p["apart"].findall(w)) - len(__import__("re").findall(r"[ct]io|[cst]ia|gio", w))
    return max(1, n)


class _Seen(dict):
    def __missing__(self, w: str) -> tuple[int, int]:
        v = (len(w), syllables(w))
        if len(self) < 300_000:
            self[w] = v
        return v


@functools.lru_cache(maxsize=1)
def _seen():
    return _Seen()


def count(text: str) -> list[int]:
    """The counts of a text in the order of ``COUNTS``."""
    p = _patterns()
    words = p["word"].findall(text)
    got = np.array(list(map(_seen().__getitem__, words)), np.int32).reshape(-1, 2)
    pieces = [x for x in p["end"].split(text)]
    sentences = sum(1 for x in pieces if p["word"].search(x))
    size, syl = got[:, 0], got[:, 1]
    return [sentences, len(words), int(size.sum()), int(syl.sum()), int((syl >= 3).sum()), int((syl == 1).sum()), int((size > 6).sum()), len(text.split())]


def grades(c: np.ndarray) -> np.ndarray:
    """One row of grades (order of ``FORMULAS``) for each row of counts.

    A text without marks of sentence ends, or without any words, has no known sentence length; the formulas that need
    it then take the length that its words alone suggest.
    """
    s, w, letters, syl, poly, mono, long_, _ = (c[:, i].astype(np.float64) for i in range(8))
    w1 = np.maximum(w, 1)
    asl = w1 / np.maximum(s, 1)
    asl = np.where((asl > 60) & (w > 60) | (s == 0), 4 + 45 * long_ / w1, asl)
    return np.stack(
        [
            0.39 * asl + 11.8 * syl / w1 - 15.59,
            0.4 * (asl + 100 * poly / w1),
            1.043 * np.sqrt(30 * poly / w1 * asl) + 3.1291,
            4.71 * letters / w1 + 0.5 * asl - 21.43,
            5.88 * letters / w1 - 29.6 / asl - 15.8,
            20 - 15 * mono / w1,
            asl + 100 * long_ / w1,
        ],
        axis=1,
    )


def monotone(x: np.ndarray, y: np.ndarray, knots: int = 40) -> tuple[list[float], list[float]]:
    """A rising curve through (x, y): pooled adjacent violators over quantile bins, as points to interpolate."""
    order = np.argsort(x, kind="stable")
    bins = np.array_split(order, max(1, min(knots, len(x) // 8)))
    px, py, n = [float(np.median(x[b])) for b in bins], [float(np.mean(y[b])) for b in bins], [len(b) for b in bins]
    blocks: list[list] = []
    for a, b, k in zip(px, py, n, strict=True):
        blocks.append([b, k, [a]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, m, xs = blocks.pop()
            u, j, ws = blocks.pop()
            blocks.append([(u * j + v * m) / (j + m), j + m, ws + xs])
    gx, gy = [], []
    for v, _, xs in blocks:
        for a in (xs[0], xs[-1]) if len(xs) > 1 else xs:
            gx.append(a)
            gy.append(v)
    return gx, gy


def curves(c: np.ndarray, y: np.ndarray, slack: float = 1.3) -> dict:
    """The fitted curves of the formulas that the labels bear out.

    Where long chains of short clauses mislead the formulas that lean on sentence length, they miss the raters' grades
    by more; formulas whose error is above ``slack`` times the smallest have no say.
    """
    g = grades(c)
    fitted = {name: monotone(g[:, i], y) for i, name in enumerate(FORMULAS)}
    miss = {name: float(np.sqrt(np.mean((np.interp(g[:, i], *fitted[name]) - y) ** 2))) for i, name in enumerate(FORMULAS)}
    return {name: v for name, v in fitted.items() if miss[name] <= slack * min(miss.values())}


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the ``COUNTS``) for each row with a text; null texts have no row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [count(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) if got else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), pa.int64()) for x in cols)], names=["key", *COUNTS])

    src = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("key", key)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", most_labels: int = 20_000) -> dict:
    """The curves from each formula to the raters' scale, as plain lists.

    A document's grade is the median of its raters' (re-delivered rows once, null grades and those outside 1 to 20
    left out). The fit takes up to ``most_labels`` labelled documents, the first by a hash of their key.
    """
    y = labels.where("grade between 1 and 20").dropDuplicates([key, "rater", "rated_ts"]).groupBy(key).agg(F.percentile("grade", 0.5).alias("grade"))
    y = y.orderBy(F.xxhash64(key)).limit(most_labels)
    rows = counts(docs.join(F.broadcast(y.select(key)), key, "left_semi"), key).where("words >= 20").join(y, key).toPandas()
    if len(rows) < 8:
        return {}
    return curves(rows[COUNTS].to_numpy(), rows["grade"].to_numpy(np.float64))


def levels(docs: DataFrame, curves: dict, key: str = "doc_id", text: str = "text", least_tokens: int = 40) -> DataFrame:
    """(key, grade, band) of each document with at least ``least_tokens`` tokens separated by white space.

    Without curves (too few labels) the formulas' own grades stand, held between 1 and 20. Null texts have no row;
    a repeated row gives a repeated result; a text without any word gets the lowest grade.
    """
    spec = json.dumps(curves)
    kind = docs.schema[key].dataType.simpleString()
    src = docs.where(F.col(text).isNotNull() & (F.char_length(text) >= 2 * least_tokens - 1)).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        known = json.loads(spec)
        for b in batches:
            got = [count(t) for t in b.column(1).to_pylist()]
            c = np.array(got, np.int64).reshape(-1, len(COUNTS))
            keep = c[:, -1] >= least_tokens
            c = c[keep]
            g = grades(c) if len(c) else np.empty((0, len(FORMULAS)))
            if known:
                g = np.stack([np.interp(g[:, i], *known[n]) for i, n in enumerate(FORMULAS) if n in known], axis=1)
            g = np.where(c[:, 1] > 0, np.clip(np.median(g, axis=1), 1, 20), 1.0) if len(c) else np.empty(0)
            band = np.where(g < 6.5, "easy", np.where(g < 11.5, "middle", "hard"))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(g), pa.array(band.tolist(), pa.string())], names=["key", "grade", "band"])

    return src.mapInArrow(run, f"key {kind}, grade double, band string").withColumnRenamed("key", key)
