"""Redaction with its audit trail, command audits, pre-flight gates, link analysis of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paths that a redaction may never touch.
PROTECTED = [".git", ".gitignore", ".gitattributes", ".claude", ".obsidian", "knowledge.db"]
#: Pages that the collection itself keeps.
META = ["CLAUDE", "Welcome", "index", "log", "decisions"]


def pattern_problem(pattern: str) -> str | None:
    """Why a redaction pattern is refused, None if it isn't."""
    if not pattern.strip():
        return "pattern_empty"
    if ".." in pattern or re.match(r"^[A-Za-z]:[\\/]", pattern) or pattern[0] in "/\\":
        return "pattern_traversal"
    if any(p in pattern.lower() for p in PROTECTED):
        return "pattern_internal"
    return None


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a glob: ** any path, * within a folder, ? one character."""
    out = ""
    for part in re.split(r"(\*\*|\*|\?)", pattern):
        out += {"**": ".*", "*": r"[^\\/]*", "?": "."}.get(part, re.escape(part))
    return f"^{out}$"


def matched(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows whose path the pattern takes; a refused pattern raises.

    A pattern with * or ? is a glob, which never reaches into the protected folders. One without is a file, or a
    folder and then all below it.
    """
    if reason := pattern_problem(pattern):
        raise ValueError(reason)
    clean = F.regexp_replace(path, r"\\", "/")
    if re.search(r"[*?]", pattern):
        return df.where(clean.rlike(glob_regex(pattern)) & ~clean.rlike(r"^\.(git|claude|obsidian)/"))
    plain = pattern.replace("\\", "/").rstrip("/")
    return df.where((clean == plain) | clean.startswith(plain + "/"))


def preview(df: DataFrame, path: str, pattern: str, many: int = 20, commits: DataFrame | None = None) -> DataFrame:
    """(pattern, files, escalate[, commits]): what a redaction would take, and whether it needs a second look.

    ``commits`` (commit, path) adds how many commits touch a file that goes.
    """
    top = bool(re.fullmatch(r"[^\\/]+[\\/](\*{1,2})?", pattern)) or pattern in ("*", "**") or not re.search(r"[\\/.]", pattern)
    n = F.count_distinct(path)
    hit = matched(df, path, pattern)
    out = hit.agg(F.lit(pattern).alias("pattern"), n.alias("files"), ((n > many) | F.lit(top)).alias("escalate"))
    if commits is None:
        return out
    touched = commits.join(hit.select(path).distinct(), path, "left_semi").agg(F.count_distinct("commit").alias("commits"))
    return out.crossJoin(F.broadcast(touched))  # one row each


def redact(df: DataFrame, path: str, pattern: str, when: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(what stays, tombstones): a dry run keeps every row. A tombstone has path, a short hash of it, and when."""
    hit = matched(df, path, pattern).select(path).distinct()
    stones = hit.select(path, F.substring(F.sha2(path, 256), 1, 16).alias("path_hash"), F.lit(when).alias("redacted_at"), F.lit(dry_run).alias("dry_run"))
    return (df if dry_run else df.join(hit, path, "left_anti")), stones


#: Git commands that are allowed, each with what may follow it.
GIT = {
    "add": [r"\s+.*"], "commit": [r"\s+-m\s+.*", r"\s+--quiet\s+.*"], "status": [r"(\s+--porcelain)?"], "log": [r"\s+--oneline(\s+.*)?"],
    "checkout": [r"\s+HEAD~1\s+--\s+.*"], "init": [""], "diff": [r"(\s+.*)?"], "show": [r"(\s+.*)?"],
}
#: Other commands that are allowed, and what makes a command a compound one.
WRAPPERS = [r"^uv\s+run\s+", r"^python\s+-m\s+spacy\s+download\s+", r"hooks[\\/][^\\/]+\.ps1", r"scripts[\\/][^\\/]+\.py"]
COMPOUND = ["&&", "||", ";", "|", "`", "$("]


def resolved(path: Column, cwd: str = "") -> Column:
    """The absolute form of a path: slashes made one kind, relative paths below ``cwd``, . and .. taken out."""
    p = F.regexp_replace(path, r"\\", "/")
    whole = F.when(p.rlike(r"^(/|[A-Za-z]:)"), p).otherwise(F.concat(F.lit(cwd.replace("\\", "/").rstrip("/") + "/"), p))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def audit(tool: Column, command: Column, target: Column, root: str, cwd: str | None = None) -> Column:
    """The governor's verdict on an event: allow, or why it is blocked. Relative targets stand below ``cwd`` (else the root's parent)."""
    base = root.replace("\\", "/").strip("/").lower()
    at = F.lower(resolved(target, cwd if cwd is not None else ""))
    c = F.trim(command)
    some = lambda patterns: F.array_contains(F.array(*[c.rlike("(?i)" + p) for p in patterns]), True)
    git = [rf"^git\s+{name}{rest}$" for name, forms in GIT.items() for rest in forms]
    return (
        F.when(tool.rlike("(?i)^(Edit|Write)$") & (F.coalesce(F.trim(target), F.lit("")) != "") & ~((at == base) | at.startswith(base + "/")), "path_boundary_violation")
        .when(~tool.rlike("(?i)^Bash$") | (F.coalesce(c, F.lit("")) == ""), "allow")
        .when(some([re.escape(x) for x in COMPOUND]), "compound_command")
        .when(c.rlike(r"(?i)^git\s+"), F.when(some(git), "allow").otherwise("unsafe_git"))
        .when(some(WRAPPERS), "allow").otherwise("unauthorized_shell")
    )


def expiry(age_hours: Column, hours_left: Column, warn_days: int = 14, end_days: int = 30, warn_hours: int = 12) -> Column:
    """VALID, WARN or EXPIRED, by the hours left if known, else by age."""
    by_left = F.when(hours_left <= 0, "EXPIRED").when(hours_left <= warn_hours, "WARN").otherwise("VALID")
    by_age = F.when(age_hours >= 24 * end_days, "EXPIRED").when(age_hours >= 24 * warn_days, "WARN").otherwise("VALID")
    return F.when(hours_left.isNotNull(), by_left).otherwise(by_age)


def links(pages: DataFrame, name: str, text: str) -> DataFrame:
    """(source, target): the [[wiki links]] of each page, aliases and headings cut off."""
    raw = F.explode(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), 1))
    return pages.select(F.col(name).alias("source"), raw.alias("target")).select("source", F.trim("target").alias("target")).distinct()


def orphans(pages: DataFrame, name: str, text: str, created: str, as_of: Column, days: int = 7) -> DataFrame:
    """(name, soft): pages that no other page links to; young ones are flagged softly. Meta pages don't count."""
    inbound = links(pages, name, text).where("source != target").select(F.col("target").alias(name))
    return pages.where(~F.col(name).isin(META)).join(inbound, name, "left_anti").select(name, (F.col(created) >= as_of - F.expr(f"INTERVAL {days} DAYS")).alias("soft"))


def catalogue(pages: DataFrame, name: str, text: str, modified: str) -> DataFrame:
    """(name, outlinks, inlinks): newest first, then by name."""
    e = links(pages, name, text)
    out = e.groupBy(F.col("source").alias(name)).agg(F.count("*").alias("outlinks"))
    into = e.groupBy(F.col("target").alias(name)).agg(F.count("*").alias("inlinks"))
    return pages.where(~F.col(name).isin(META)).join(out, name, "left").join(into, name, "left").select(name, modified, F.coalesce("outlinks", F.lit(0)).alias("outlinks"), F.coalesce("inlinks", F.lit(0)).alias("inlinks")).orderBy(F.desc(modified), name)


def stale(pages: DataFrame, topic: str, name: str, created: str, floor: int = 10) -> DataFrame:
    """(older, newer): pages of one topic of which a newer one may contradict an older one; none below ``floor`` pages of the topic.

    Each page is paired with its next newer one, not with all.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(topic).orderBy(created, name)
    return pages.withColumn("newer", F.lead(name).over(w)).withColumn("_n", F.count("*").over(W.partitionBy(topic))).where(F.col("newer").isNotNull() & (F.col("_n") >= floor)).select(F.col(name).alias("older"), "newer")


def newest(pages: DataFrame, name: str, modified: str, most: int = 200) -> DataFrame:
    """The ``most`` newest pages, which a lint of a large collection looks at; ties by name."""
    return pages.orderBy(F.desc(modified), name).limit(most)


#: The tags of entity pages.
TAGS = ["person", "paper", "concept", "organization"]


def tagged(pages: DataFrame, name: str, tags: str) -> DataFrame:
    """(name, tags): pages with one of the entity tags, a # before a tag and its case not counting, by name."""
    own = F.array_sort(F.array_intersect(F.transform(tags, lambda t: F.lower(F.ltrim(t, F.lit("#")))), F.array(*[F.lit(t) for t in TAGS])))
    return pages.withColumn("_t", own).where("size(_t) > 0").select(name, F.col("_t").alias("tags")).orderBy(name)


def gates(docs: DataFrame, label: str, text: str) -> DataFrame:
    """Adds reason: why pre-flight stops a document, null if it passes. The label must be filled and the text's head name its source_type."""
    head = F.substring(text, 1, 2000)  # the front matter stands there: the rule is about the head, not the text
    return docs.withColumn("reason", F.when((F.coalesce(F.trim(label), F.lit("")) == "") | F.upper(label).contains("TODO"), "label missing").when(~F.coalesce(head.rlike(r"(?m)^source_type:"), F.lit(False)), "no source_type"))
