"""Keyword search: postings, phrase and term BM25 with corpus-wide statistics, the Porter stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions.text import WORD, tokens
from tarnwell.session import written

#: Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, term): every word of every text in order; null texts have none."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, positions, tf, doc_len): the inverted index."""
    t = df.select(key, tokens(F.col(text)).alias("_t"))
    p = t.select(key, F.size("_t").alias("doc_len"), F.posexplode("_t").alias("pos", "term"))
    return p.groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def frequencies(df: DataFrame, key: str, text: str, words: list[str], label: str = "frequencies") -> DataFrame:
    """(key, doc_len, tf array<int>): how often each text has each of the words, from one reading of the texts.

    The texts are split once and only these few numbers are kept, written to the shared folder, so that the corpus
    statistics and the scores both come from them. Null texts have no row.
    """
    t = df.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("_t"))
    count = lambda w: F.size(F.filter("_t", lambda x: x == w))
    tf = F.array(*[count(w) for w in words]) if words else F.array().cast("array<int>")
    return written(t.select(key, F.size("_t").alias("doc_len"), tf.alias("tf")), label)


def scored(tf: DataFrame, key: str, terms: int) -> DataFrame:
    """(key, score): the sum of BM25 over the ``terms`` frequencies of each text that has any of them."""
    each = [F.count_if(F.col("tf")[i] > 0) for i in range(terms)]
    stats = tf.agg(F.count("*").alias("total"), F.avg("doc_len").alias("avgdl"), F.array(*each).alias("n"))
    hit = tf.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row of statistics
    norm = K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl"))

    def part(i: int) -> Column:
        n = F.col("n")[i]
        idf = F.greatest(F.log((F.col("total") - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
        return F.when(F.col("tf")[i] > 0, idf * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + norm)).otherwise(0.0)

    total = part(0)
    for i in range(1, terms):
        total = total + part(i)
    return hit.select(key, F.round(total, 6).alias("score"))


def words_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W]+", query.lower())))


def _phrase_count(text: Column, phrase: list[str]) -> Column:
    """How often the words of ``phrase`` stand next to each other in that order; a search in the text's words, joined by blanks, that may overlap."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    return F.regexp_count(flat, F.lit("(?= " + " ".join(phrase) + " )"))


def phrase_tf(df: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """(key, tf): how often the words of ``phrase`` stand next to each other in that order; texts that have it not at all have no row."""
    words = re.findall(r"[^\W]+", phrase.lower())
    return df.where(F.col(text).isNotNull()).select(key, _phrase_count(F.col(text), words).cast("long").alias("tf")).where("tf > 0")


def bm25_phrase(df: DataFrame, key: str, text: str, phrase: str, k: int, keep: DataFrame | None = None) -> DataFrame:
    """(key, score): the ``k`` best by phrase BM25, one idf for the phrase; ``keep`` filters after scoring."""
    words = re.findall(r"[^\W]+", phrase.lower())
    t = df.where(F.col(text).isNotNull())
    tf = written(t.select(key, F.size(tokens(F.col(text))).alias("doc_len"), F.array(_phrase_count(F.col(text), words)).alias("tf")), "phrase")
    s = scored(tf, key, 1)
    if keep is not None:
        s = s.join(keep.select(key), key, "left_semi")
    return s.orderBy(F.desc("score"), key).limit(k)


def bm25_terms(df: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """(key, score): the ``k`` best by the sum of the query words' BM25 (bag of words)."""
    words = words_of(query)
    return scored(frequencies(df, key, text, words), key, len(words)).orderBy(F.desc("score"), key).limit(k)


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c", _shape(stem)))


def _shape(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


#: Fixed values of the Porter algorithm: endings of the steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The Porter stem (published algorithm); words of one or two letters stay."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = ""
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _ends_cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Words in lower case without accents, stemmed, joined by blanks."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(porter(w) for w in re.findall(r"\w+", plain))


def stemmed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the folded and stemmed words of ``text`` in its place."""
    at = df.schema.names.index(text)

    def run(batches):
        for b in batches:
            out = [None if t is None else fold(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, T.StructType(df.schema.fields))


__all__ = ["WORD", "bm25_phrase", "bm25_terms", "fold", "index", "phrase_tf", "porter", "postings", "stemmed"]
