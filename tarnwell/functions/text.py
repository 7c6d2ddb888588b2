"""Scalar functions on text and vectors, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def normal(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def space_tokens(c: Column) -> Column:
    """Number of runs of other characters than white space."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def approx_tokens(c: Column, chars: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / chars).cast("int"))


def slug(c: Column, sep: str = "-", most: int = 50, empty: str = "project") -> Column:
    """Runs of other characters than letters and digits become ``sep``; cut to ``most``; ``empty`` if nothing stays."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), f"{sep}+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(empty)).otherwise(s)


def file_title(c: Column, most: int = 80) -> Column:
    """A title that can be a file name: reserved characters become blanks, white space collapses."""
    return F.substring(strip(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', " "), r"\s+", " ")), 1, most)


#: Words that stay in lower case inside a title.
SMALL_WORDS = "a an the and or but of in on at to for from with by as is vs".split()


def folder_name(c: Column, most: int = 60) -> Column:
    """A name that can be a folder: quotes and stars around it and reserved characters go, white space collapses."""
    bare = F.regexp_replace(F.trim(c), r"^['\"`*]+|['\"`*]+$", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r'[<>:"/\\|?*]', ""), r"\s+", " ")), 1, most)


def dated_title(c: Column, date: str, most: int = 60) -> Column:
    """``Title Case Topic - <date>.md``: cut to ``most`` at a word, small words but the first in lower case; Research if nothing stays."""
    flat = strip(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "))
    core = F.regexp_replace(flat, r"^[\s\-_.,;:!?]+|[\s\-_.,;:!?]+$", "")
    head = F.substring(core, 1, most)
    short = F.when(F.char_length(core) <= most, core).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"^(.+) [^ ]*$", 1), F.lit("")), head))
    cased = F.transform(F.split(F.lower(short), r"\s+"), lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))))
    title = F.array_join(cased, " ")
    return F.concat(F.when(F.coalesce(title, F.lit("")) == "", F.lit("Research")).otherwise(title), F.lit(f" - {date}.md"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0, null where the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def usable(v: Column, dim: int = 64) -> Column:
    """Whether a vector has ``dim`` finite parts that aren't all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def blend(old: Column, new: Column, alpha: float) -> Column:
    """(1 - alpha) old + alpha new; the new one alone where there is no old one."""
    return F.when(old.isNull(), new).otherwise(F.zip_with(old, new, lambda p, q: p * (1 - alpha) + q * alpha))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
