"""Citation checks: extraction, fuzzy verdicts, escalation, merged verdicts."""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.config import RetrievalConfig
from tarnwell.functions.text import tokens

PATTERN = r"\[(s\d+_c\d+(?:\s*,\s*s\d+_c\d+)*)\]"
CITED = re.compile(PATTERN)


#: Fixed value: a sentence ends at one of these marks (not after a full stop) if white space follows.
BOUNDARY = re.compile(r"(?<!\.)[.!?\n](?=[ \t\n])")
#: Fixed value: markup before a claim that is no part of it.
NOISE = " \t\r\n#>*-"


def claims(text: str) -> list[tuple[int, str, str]]:
    """(position, claim, chunk_id) of every cited id: the claim reaches from the last sentence end to the citation's end."""
    ends = [0, *(m.end() for m in BOUNDARY.finditer(text))]
    return [(m.start(), text[ends[bisect_right(ends, m.start()) - 1] : m.end()].strip().lstrip(NOISE), c.strip()) for m in CITED.finditer(text) for c in m[1].split(",")]


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, claim, chunk_id): every cited id of every citation in the text."""

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = claims(t)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), b.schema.field(0).type), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["key", "position", "claim", "chunk_id"])

    kind = df.schema[key].dataType.simpleString()
    src = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"key {kind}, position int, claim string, chunk_id string").withColumnRenamed("key", key)


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: how well the shorter text matches the best window of the longer one."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    if s in t:
        return 100.0
    best = 0.0
    m = SequenceMatcher(None, s, t, autojunk=False)
    tried = set()
    for block in m.get_matching_blocks():
        at = min(max(0, block.b - block.a), len(t) - len(s))
        if at in tried:
            continue
        tried.add(at)
        w = SequenceMatcher(None, s, t[at : at + len(s)], autojunk=False)
        if w.real_quick_ratio() * 100 > best and w.quick_ratio() * 100 > best:
            best = max(best, w.ratio() * 100)
    return best


def verdict_of(score: Column, found: Column, cfg: RetrievalConfig | None = None) -> Column:
    """PASS, AMBIGUOUS or FAIL by the fuzzy score, MISSING_CHUNK where the chunk isn't there."""
    cfg = cfg or RetrievalConfig()
    low = int(cfg.fuzzy_pass * cfg.fuzzy_factor)
    return F.when(~found, "MISSING_CHUNK").when(score >= cfg.fuzzy_pass, "PASS").when(score >= low, "AMBIGUOUS").otherwise("FAIL")


def shares_words(claim: Column, text: Column, least: int = 4) -> Column:
    """Whether the claim, its citations left out, has a word of ``least`` letters that the text has too; true if it has none of that length."""
    own = F.filter(tokens(F.regexp_replace(claim, PATTERN, " ")), lambda w: F.char_length(w) >= least)
    return (F.size(own) == 0) | F.arrays_overlap(own, tokens(text))


def verdicts(cited: DataFrame, chunks: DataFrame, scope: str, cfg: RetrievalConfig | None = None, overlap: bool = False) -> DataFrame:
    """``cited`` with fuzzy_score and verdict: PASS, AMBIGUOUS, FAIL, or MISSING_CHUNK where the chunk isn't there.

    A claim that stands in the chunk as it is scores 100 inside the JVM; only the others are compared in Python.
    With ``overlap`` a claim that shares no word of content with its chunk is AMBIGUOUS whatever its score.
    """
    j = cited.join(chunks.select(scope, "chunk_id", F.col("text").alias("_t")), [scope, "chunk_id"], "left")

    @F.pandas_udf("int")
    def score(claim, text):
        return (claim.str.lower().combine(text.str.lower(), lambda x, y: int(partial_ratio(x, y)) if isinstance(x, str) and isinstance(y, str) else None)).astype("Int32")

    inside = F.contains(F.lower("_t"), F.lower("claim"))
    # null for those that need no comparison: the worker skips them
    s = j.withColumn("fuzzy_score", F.when(inside, 100).when(F.col("_t").isNotNull(), score(F.when(~inside, F.col("claim")), F.when(~inside, F.col("_t")))))
    v = verdict_of(F.col("fuzzy_score"), F.col("_t").isNotNull(), cfg)
    if overlap:
        v = F.when(F.col("_t").isNotNull() & ~shares_words(F.col("claim"), F.col("_t")), "AMBIGUOUS").otherwise(v)
    return s.withColumn("verdict", v).drop("_t")


def report(v: DataFrame, scope: str) -> DataFrame:
    """Counts by verdict and what follows from them; a run is clean if at most a twentieth has to go."""
    n = lambda *names: F.count_if(F.col("verdict").isin(*names))
    return v.groupBy(scope).agg(
        F.count("*").alias("total"), n("PASS").alias("pass"), n("AMBIGUOUS").alias("ambiguous"), n("FAIL").alias("fail"), n("MISSING_CHUNK").alias("missing_chunk"),
        n("AMBIGUOUS", "FAIL").alias("needs_judge"), n("FAIL", "MISSING_CHUNK").alias("needs_substitution"), (n("FAIL", "MISSING_CHUNK") / F.count("*") <= 0.05).alias("clean"),
    )


def escalations(v: DataFrame, chunks: DataFrame, scope: str, contradiction: str | None = None) -> DataFrame:
    """(scope, id, chunk_id, position, claim, source, hint): what a judge should see, numbered from 0 by position.

    Claim and source are cut to 300 and 600 characters, as the judge's input form asks. ``contradiction`` names a
    column of probabilities that the two contradict each other; above one half it makes a hint, else hint is null.
    """
    e = v.where(F.col("verdict").isin("AMBIGUOUS", "FAIL")).join(chunks.select(scope, "chunk_id", "text"), [scope, "chunk_id"], "left")
    n = F.row_number().over(W.partitionBy(scope).orderBy("position", "chunk_id")) - 1
    hint = F.lit(None).cast("string")
    if contradiction:
        hint = F.when(F.col(contradiction) > 0.5, F.concat(F.lit("leans toward contradiction ("), F.format_number(contradiction, 2), F.lit("): look closely")))
    return e.select(scope, n.alias("id"), "chunk_id", "position", F.substring("claim", 1, 300).alias("claim"), F.substring(F.coalesce("text", F.lit("")), 1, 600).alias("source"), hint.alias("hint"))


#: The verdicts of a judge.
JUDGED = ["SUPPORTED", "PARTIAL", "CONTRADICTED", "UNRELATED"]


def merge_verdicts(esc: DataFrame, judged: DataFrame, scope: str) -> DataFrame:
    """Escalations with the judge's verdict by number; one that is missing or unknown counts as PARTIAL."""
    j = judged.select(scope, "id", F.col("verdict").alias("_v"))
    return esc.join(j, [scope, "id"], "left").withColumn("verdict", F.when(F.col("_v").isin(JUDGED), F.col("_v")).otherwise("PARTIAL")).drop("_v")


def counters(merged: DataFrame, scope: str) -> DataFrame:
    """(scope, a count for each judge's verdict)."""
    return merged.groupBy(scope).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in JUDGED])


def substitutes(v: DataFrame, chunks: DataFrame, scope: str, cfg: RetrievalConfig | None = None, least: int = 4) -> DataFrame:
    """(scope, position, chunk_id, other): for failed claims the first other chunk of the scope that passes.

    Only chunks that share a word of ``least`` letters and more with the claim are scored. Two texts of a score of 70
    share runs of letters, so a chunk without any whole word of the claim is one in which every word was altered.
    """
    cfg = cfg or RetrievalConfig()
    words = lambda c: F.array_distinct(F.filter(tokens(c), lambda w: F.char_length(w) >= least))
    bad = v.where(F.col("verdict").isin("FAIL", "MISSING_CHUNK")).select(scope, "position", "chunk_id", "claim")
    asked = bad.select("*", F.explode_outer(words(F.regexp_replace("claim", PATTERN, " "))).alias("_w"))
    offered = chunks.where("text is not null").select(scope, F.col("chunk_id").alias("other"), F.explode_outer(words(F.col("text"))).alias("_w"))
    near = asked.join(offered, [scope, "_w"]).where("other != chunk_id").groupBy(scope, "position", "chunk_id", "other").agg(F.first("claim").alias("claim"))
    short = asked.where("_w is null").select(scope, "position", "chunk_id", "claim").join(chunks.where("text is not null").select(scope, F.col("chunk_id").alias("other")), scope).where("other != chunk_id")
    pairs = near.unionByName(short.select(near.columns)).join(chunks.select(scope, F.col("chunk_id").alias("other"), F.col("text").alias("_t")), [scope, "other"])

    @F.pandas_udf("boolean")
    def passes(claim, text):
        return claim.str.lower().combine(text.str.lower(), lambda x, y: int(partial_ratio(x, y)) >= cfg.fuzzy_pass).astype(bool)

    return pairs.where(passes("claim", "_t")).groupBy(scope, "position", "chunk_id").agg(F.min("other").alias("other"))


def parse_verdicts(df: DataFrame, text: str, expected: str) -> DataFrame:
    """Adds verdicts, the judge's array between BEGIN_VERDICTS and END_VERDICTS, null unless it has as many as ``expected``."""
    raw = F.regexp_extract(text, r"(?s)BEGIN_VERDICTS\s*(.*?)\s*END_VERDICTS", 1)
    got = F.from_json(raw, "array<struct<id: int, verdict: string, rationale: string>>")
    return df.withColumn("verdicts", F.when(F.size(got) == F.col(expected), got))
