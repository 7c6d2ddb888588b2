"""Schemas that drift between files: profiles, versions, changes, and one consistent table.

Every file's schema has a fingerprint, its fields with their JSON types. A searcher's fingerprints in order of time
are the versions of its schema, and between neighbouring versions stand explicit migration steps, worked out once for
each pair of schemas; the changes of a file are the steps with which its version begins. The steps name the content
that a field holds (its role), so a field that only changed its name is renamed, not removed and added. Each record
goes through chained rename, default and cast rules, and what they did to it is recorded beside it. All of it runs on
VARIANT values inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.session import written

#: Names under which the canonical fields are known. The first of each is the canonical one.
ROLES = {
    "chunk_id": ["chunk_id", "id", "chunkId", "cid", "passage_id", "chunk_key", "ref"],
    "section_id": ["section_id", "section", "sec", "sectionId"],
    "source_url": ["source_url", "url", "link", "href", "page_url"],
    "source_title": ["source_title", "title", "page_title", "headline"],
    "fetched_at": ["fetched_at", "date", "retrieved", "fetch_time", "accessed", "crawled_on", "fetchedAt"],
    "sub_question_origin": ["sub_question_origin", "subquestion", "topic", "subQuestion", "asked", "origin_q", "question"],
    "text": ["text", "extract", "body", "content_text", "passage"],
}
CANONICAL = list(ROLES)


def records(raw: DataFrame) -> DataFrame:
    """(searcher, file_name, written_ts, raw_id, pos, rec): the readable records, envelopes opened; rec is a VARIANT.

    Re-delivered rows (one raw_id) count once. Unreadable payloads, and values that are no objects, have no records.
    """
    v = raw.where("raw_id is not null").dropDuplicates(["raw_id"]).select("searcher", "file_name", "written_ts", "raw_id", F.try_parse_json("payload").alias("v")).where("v is not null")
    inner = F.try_variant_get("v", "$.chunks", "array<variant>")
    return v.select("searcher", "file_name", "written_ts", "raw_id", F.posexplode(F.when(inner.isNotNull(), inner).otherwise(F.array("v"))).alias("pos", "rec")).where(F.schema_of_variant("rec").startswith("OBJECT"))


def _json_type(c: str) -> Column:
    s = F.schema_of_variant(c)
    return (
        F.when(s == "VOID", None).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number")
    )


def fields(recs: DataFrame) -> DataFrame:
    """The columns of ``records`` but rec, with field, type (null for a null value) and value (as text)."""
    return recs.sparkSession.sql(
        "SELECT r.searcher, r.file_name, r.written_ts, r.raw_id, r.pos, e.key AS field, e.value AS v FROM {r} r, LATERAL variant_explode(r.rec) e WHERE e.key IS NOT NULL", r=recs
    ).select("searcher", "file_name", "written_ts", "raw_id", "pos", "field", _json_type("v").alias("type"), F.expr("cast(v as string)").alias("value"))


def _looks(value: Column, kind: Column) -> Column:
    """The role that a value's own form tells, if it does."""
    return (
        F.when((kind == "string") & value.rlike(r"^s\d+_c\d+$") | (kind == "object") & value.rlike(r'^\{"c":\d+,"s":"?s?\d+"?\}$|^\{"s":"?s?\d+"?,"c":\d+\}$'), "chunk_id")
        .when((kind == "string") & value.rlike(r"^s\d+$"), "section_id")
        .when((kind == "string") & value.rlike(r"^(?i)https?://\S+$"), "source_url")
        .when((kind == "string") & value.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?$") | (kind == "object") & value.rlike(r'"day":'), "fetched_at")
        .when((kind == "string") & value.rlike(r"^(?s).{8,300}\?$") & ~value.rlike(r"[.!?]\s.*\?$") | (kind == "object") & value.rlike(r'"q":') | (kind == "array") & value.rlike(r"\?\"\]$"), "sub_question_origin")
        .when((kind == "string") & (F.char_length(value) >= 160), "text")
    )


def profiles(f: DataFrame) -> DataFrame:
    """(searcher, file_name, written_ts, field, type, role): one row for each field of a file.

    The type is the most frequent of the file, null if all values are. The role is what most of its values look
    like, else what its name is known for, else the name itself.
    """
    named = F.create_map(*[F.lit(x) for role, names in ROLES.items() for n in names for x in (n, role)])
    seen = f.withColumn("looks", _looks(F.col("value"), F.col("type")))
    p = seen.groupBy("searcher", "file_name", "field").agg(
        F.min("written_ts").alias("written_ts"), F.mode("type", deterministic=True).alias("type"), F.mode("looks", deterministic=True).alias("looks"), F.try_divide(F.count("looks"), F.count("type")).alias("sure")
    )
    known = F.try_element_at(named, F.col("field"))
    # the form decides for names nobody knows; of known names only if every value agrees
    role = F.when(known.isNull() & (F.col("sure") >= 0.6), F.col("looks")).when(known.isNotNull() & (F.col("sure") >= 0.99) & (F.col("looks") != "text"), F.col("looks"))
    return p.select("searcher", "file_name", "written_ts", "field", "type", F.coalesce(role, known, "field").alias("role"))


def schemas(p: DataFrame) -> DataFrame:
    """(searcher, seq, file_name, at, fields, schema, fingerprint): each file's schema, from ``profiles``, and its place among its searcher's files.

    ``fields`` are (field, type, role) in order of name; the schema is their names and types as text, the fingerprint
    its hash. Places go by written_ts and name, from 1. One row a file: the records themselves stay behind.
    """
    own = F.array_sort(F.collect_list(F.struct("field", "type", "role"))).alias("fields")
    f = p.groupBy("searcher", "file_name").agg(F.min("written_ts").alias("at"), own)
    text = F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["field"], F.coalesce(x["type"], F.lit("null")))), ",")
    order = W.partitionBy("searcher").orderBy(F.col("at").asc_nulls_last(), "file_name")
    return f.withColumn("schema", text).withColumn("fingerprint", F.substring(F.sha2("schema", 256), 1, 16)).withColumn("seq", F.row_number().over(order))


def versioned(f: DataFrame) -> DataFrame:
    """``schemas`` with version, and the fingerprint and the fields of the file before where a version begins, else null."""
    w = W.partitionBy("searcher").orderBy("seq")
    last = F.lag("fingerprint").over(w)
    # roles are part of what a step says, so a file whose fields changed only their content begins a version too
    began = last.isNull() | (last != F.col("fingerprint")) | (F.lag("fields").over(w) != F.col("fields"))
    d = f.withColumn("began", began).withColumn("from_print", F.when(F.col("began"), last)).withColumn("from_fields", F.when(F.col("began"), F.lag("fields").over(w)))
    return d.withColumn("version", F.sum(F.col("began").cast("int")).over(w).cast("int"))


STEP = "array<struct<change: string, field: string, before: string, role: string>>"


def steps(old: Column, new: Column) -> Column:
    """The migration steps from one schema's fields to another's: retyped, renamed, removed and added.

    Fields of one role that went and came are renamed, the first by name to the first, and so on; what is left over
    was removed or added.
    """
    names = lambda c: F.transform(c, lambda x: x["field"])
    gone = F.filter(old, lambda x: ~F.array_contains(names(new), x["field"]))
    come = F.filter(new, lambda x: ~F.array_contains(names(old), x["field"]))
    nth = lambda rows: F.transform(rows, lambda x, i: F.struct(x["field"].alias("field"), x["role"].alias("role"), F.size(F.filter(F.slice(rows, 1, i), lambda y: y["role"] == x["role"])).alias("k")))
    g, c = nth(gone), nth(come)
    match = lambda rows, x: F.try_element_at(F.filter(rows, lambda y: (y["role"] == x["role"]) & (y["k"] == x["k"])), F.lit(1))
    step = lambda change, field, before, role: F.struct(change.alias("change"), field.alias("field"), before.alias("before"), role.alias("role"))
    text = F.lit(None).cast("string")
    retyped = F.flatten(F.transform(new, lambda x: F.transform(F.filter(old, lambda y: (y["field"] == x["field"]) & (y["type"] != x["type"])), lambda y: step(F.lit("retyped"), x["field"], y["type"], x["role"]))))
    came = F.transform(c, lambda x: step(F.when(match(g, x).isNull(), "added").otherwise("renamed"), x["field"], F.coalesce(match(g, x)["field"], text), x["role"]))
    went = F.transform(F.filter(g, lambda x: match(c, x).isNull()), lambda x: step(F.lit("removed"), x["field"], text, x["role"]))
    return F.concat(retyped, came, went).cast(STEP)


def migrations(versions_: DataFrame) -> DataFrame:
    """(from_fields, fields, steps): the steps between two schemas, worked out once for each pair of neighbours that occurs."""
    pairs = versions_.where("from_fields is not null").select("from_fields", "fields").distinct()
    return pairs.withColumn("steps", steps(F.col("from_fields"), F.col("fields")))


def changes(raw: DataFrame) -> DataFrame:
    """(searcher, file_name, field, change, before, role): every change between a file and the one before it.

    Only a file with which a version begins has changes: those of the migration from the version before it. change is
    added, removed, renamed (``before`` holds the old name) or retyped (``before`` holds the old type). The first
    file of a searcher has no changes; files without any readable record count as absent.
    """
    v = written(versioned(schemas(profiles(fields(records(raw))))), "versions")
    found = v.where("from_fields is not null").join(migrations(v), ["from_fields", "fields"])
    return found.select("searcher", "file_name", F.explode("steps").alias("s")).select("searcher", "file_name", "s.field", "s.change", "s.before", "s.role")


def versions(raw: DataFrame) -> DataFrame:
    """(searcher, version, fingerprint, schema, first_file, files, steps): the versions of each searcher's schema in order.

    A version begins where the fingerprint differs from that of the file before; a schema that comes back is a new
    version. ``steps`` are those that lead to it from the version before, as text.
    """
    v = written(versioned(schemas(profiles(fields(records(raw))))), "versions")
    own = v.groupBy("searcher", "version", "fingerprint", "schema").agg(F.min_by("file_name", "seq").alias("first_file"), F.count("*").alias("files"), F.min_by("fields", "seq").alias("fields"), F.min_by("from_fields", "seq").alias("from_fields"))
    told = F.array_join(F.array_sort(F.transform("steps", lambda s: F.concat_ws(" ", s["change"], s["field"], s["before"]))), ";")
    return own.join(migrations(v), ["from_fields", "fields"], "left").select("searcher", "version", "fingerprint", "schema", "first_file", "files", F.coalesce(told, F.lit("")).alias("steps"))


def _first(role: str) -> Column:
    return F.first(F.when(F.col("role") == role, F.col("b.value")), ignorenulls=True).alias(role)


def consistent(raw: DataFrame, default_question: str = "unrecorded") -> DataFrame:
    """(raw_id, pos, file_name and the seven canonical strings) for every readable record, whatever its file's schema.

    Chained rules: fields go to their role's name; ids given as numbers or objects become s<section>_c<number>;
    seconds, milliseconds and day/clock objects become ISO instants; questions in arrays or objects are unwrapped.
    A missing section comes from the chunk id, a missing or null question gets ``default_question``; the rest stays null.
    ``changed`` records what the rules did to the record: renamed, cast and defaulted fields, in order of field.
    """
    f = fields(records(raw))
    roles = profiles(f).select("searcher", "file_name", "field", "role").where(F.col("role").isin(CANONICAL))
    # of two fields with one role in a record the canonical name wins, then the alphabet
    best = F.struct((F.col("field") != F.col("role")).alias("other"), "field", F.col("value"))
    flat = f.where("type is not null").join(roles, ["searcher", "file_name", "field"]).groupBy("raw_id", "pos", "file_name", "role").agg(F.min(best).alias("b"))
    wide = records(raw).select("raw_id", "pos", "file_name").join(flat.groupBy("raw_id", "pos", "file_name").agg(*[_first(r) for r in CANONICAL], F.array_compact(F.collect_list(F.when(F.col("b.other"), F.concat(F.lit("rename "), "b.field", F.lit(" to "), "role")))).alias("renamed")), ["raw_id", "pos", "file_name"], "left")
    n = F.try_to_number(F.col("chunk_id"), F.lit("9999999999")).cast("long")
    cid = (
        F.when(F.col("chunk_id").startswith("{"), F.concat(F.regexp_extract("chunk_id", r'"s":"?(s?\d+)', 1), F.lit("_c"), F.regexp_extract("chunk_id", r'"c":(\d+)', 1)))
        .when(F.col("chunk_id").rlike(r"^\d{4,10}$"), F.concat(F.lit("s"), F.floor(n / 1000), F.lit("_c"), n % 1000)).otherwise(F.col("chunk_id"))
    )
    t = F.col("fetched_at")
    ticks = F.when(t.rlike(r"^\d{9,14}$"), t.cast("long"))
    ticks = F.when(ticks > 100_000_000_000, F.floor(ticks / 1000)).otherwise(ticks)
    when = (
        F.when(t.startswith("{"), F.concat(F.regexp_extract(t, r'"day":"([^"]+)', 1), F.lit("T"), F.regexp_extract(t, r'"clock":"([^"]+)', 1), F.lit(":00Z")))
        .when(ticks.isNotNull(), F.date_format(F.timestamp_seconds(ticks), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^(\d{4}-\d\d-\d\d) ", "$1T"), r"\+00:00$", "Z"), r"(T\d\d:\d\d:\d\d)$", "$1Z"))
    )
    q = F.col("sub_question_origin")
    ask = F.when(q.startswith("["), F.get_json_object(q, "$[0]")).when(q.startswith("{"), F.get_json_object(q, "$.q")).otherwise(q)
    rules = F.array_compact(F.array(
        F.when(~cid.eqNullSafe(F.col("chunk_id")), "cast chunk_id"), F.when(~when.eqNullSafe(t), "cast fetched_at"), F.when(ask.isNotNull() & (ask != q), "cast sub_question_origin"),
        F.when(F.col("section_id").isNull() & cid.rlike(r"^s\d+_"), "default section_id"), F.when(ask.isNull(), "default sub_question_origin"),
    ))
    return wide.select(
        "raw_id", "pos", "file_name", F.array_join(F.array_sort(F.concat(F.coalesce("renamed", F.array().cast("array<string>")), rules)), ";").alias("changed"), cid.alias("chunk_id"), F.coalesce(F.col("section_id"), F.nullif(F.regexp_extract(cid, r"^(s\d+)_", 1), F.lit(""))).alias("section_id"), "source_url", "source_title",
        when.alias("fetched_at"), F.coalesce(ask, F.lit(default_question)).alias("sub_question_origin"), "text",
    )
