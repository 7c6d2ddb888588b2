"""Routing by labels: entailment scores, gates, source types, project names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.config import RetrievalConfig
from tarnwell.operators.vector import softmax

#: Kinds of source and the phrase that each stands for.
SOURCE_TYPES = {
    "academic": "an academic paper", "article": "a news article or blog post", "newsletter": "an email newsletter", "social": "a social media post", "journal": "a personal diary entry", "reference": "a reference manual or documentation",
}
#: What to take from each kind of source.
FOCUS = {
    "academic": "methodology, findings, limitations, datasets, citations",
    "article": "thesis sentence + key arguments + concrete examples + author POV",
    "newsletter": "summary stripped of subscribe/footer/ad chrome; the actionable items only",
    "social": "preserve verbatim as a quoted block; capture author + platform + thread context",
    "journal": "personal-journaling structure: date, topics-of-the-day, mood/tone",
    "reference": "searchable index style — minimal editing; capture canonical terms + cross-refs",
}
#: Where a text states its title, the better places first: an HTML title, a first-level heading, a title field.
TITLES = {"html": r"(?is)<title[^>]*>([^<]+)</title>", "heading": r"^\s*# (.*)$", "field": r"(?m)^title:\s*['\"]?([^\n'\"]+)['\"]?\s*$"}
#: Fixed value: the lines in which a heading counts as the title.
HEADING_LINES = 50
#: Words that carry no topic.
STOPWORDS = """
a an the and or but nor so yet of in on at by for with to from as about into through during after before
is was are were be been being am have has had having do does did doing will would could should may might must can shall
this that these those i you he she we they it my your his her its our their what which who whom when where why how
all any some many few more most other another each every both either neither not no only just very too also still even
there here if because though although unless until while
""".split()
#: Cue words of the default scorer.
CUES = {
    "academic": "abstract et al cf hypothesis methodological hence longitudinal covariance sigma", "article": "said reported according news by yesterday", "newsletter": "issue weekly subscribe newsletter edition volume",
    "social": "@ # rt lol follow", "journal": "today i we my diary felt morning", "reference": "see table section manual parameter definition note",
}


def cue_score(text: Column, label: Column) -> Column:
    """The default entailment scorer: share of a kind's cue words that the text has, as an independent probability."""
    cues = F.create_map(*[x for k, v in CUES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}@#]+"))
    hits = F.size(F.array_intersect(words, F.try_element_at(cues, label)))
    return F.coalesce(1 / (1 + F.exp(-(hits - 1.5))), F.lit(0.0))


def classify(docs: DataFrame, key: str, text: Column, labels: list[str], multi: bool = False, template: str = "This text is {}.", scorer=cue_score) -> DataFrame:
    """(key, label, p): raw probabilities, or with ``multi`` off their softmax over the labels. The template needs {}."""
    if "{}" not in template:
        raise ValueError("the template lacks {}")
    d = docs.select(key, text.alias("_t")).crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in labels], "label string")))
    s = d.select(key, "label", scorer(F.col("_t"), F.col("label")).alias("p"))
    return s if multi else softmax(s, key, "p", "q").select(key, "label", F.col("q").alias("p"))


def source_type(docs: DataFrame, key: str, text: str, cue: Column | None = None, cfg: RetrievalConfig | None = None, scorer=cue_score) -> DataFrame:
    """(key, source_type, confidence): the most probable kind from the head of the text; blank texts are (article, 0)."""
    cfg = cfg or RetrievalConfig()
    head = F.substring(F.col(text), 1, cfg.head_chars)
    if cue is not None:
        head = F.concat_ws("\n", cue, head)
    best = classify(docs, key, head, list(SOURCE_TYPES), True, scorer=scorer)
    w = W.partitionBy(key).orderBy(F.desc(F.round("p", 9)), "label")
    top = best.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col("label").alias("_l"), F.col("p").alias("_p"))
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    return docs.join(top, key).select(key, F.when(blank, "article").otherwise(F.col("_l")).alias("source_type"), F.when(blank, F.lit(0.0)).otherwise(F.col("_p")).alias("confidence"))


def gate(scored: DataFrame, key: str, label: str, p: str, cfg: RetrievalConfig | None = None) -> DataFrame:
    """(key, label, p, margin, passes): the best label of each row; with one label only there is no margin and no pass."""
    cfg = cfg or RetrievalConfig()
    w = W.partitionBy(key).orderBy(F.desc(p), label)
    d = scored.withColumn("_r", F.row_number().over(w)).withColumn("_s", F.lead(p).over(w)).where("_r = 1")
    margin = F.round(F.col(p) - F.col("_s"), 9)
    return d.select(key, label, p, margin.alias("margin"), F.coalesce((F.col(p) >= cfg.gate_threshold) & (margin >= cfg.gate_margin), F.lit(False)).alias("passes"))


def content_title(c: Column) -> Column:
    """The title that a text states, by the first of ``TITLES`` that it has; null if none."""
    top = F.filter(F.slice(F.split(c, "\n"), 1, HEADING_LINES), lambda line: line.rlike(TITLES["heading"]))
    stated = [F.regexp_extract(c, TITLES["html"], 1), F.regexp_extract(F.try_element_at(top, F.lit(1)), TITLES["heading"], 1), F.regexp_extract(c, TITLES["field"], 1)]
    return F.coalesce(*[F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("")) for x in stated])


def _named(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(STOPWORDS))


def project_name(c: Column, day: str) -> Column:
    """A project's name: the last three words of the title that carry a topic, else the first capitalised words, else a dated stand-in."""
    t = _named(F.regexp_extract_all(content_title(c), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*"), 0))
    shown = F.transform(F.slice(t, F.greatest(F.lit(1), F.size(t) - 2), 3), lambda w: F.when((w == F.upper(w)) & (F.char_length(w) >= 2) & w.rlike(r"\p{L}"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))))
    lead = _named(F.regexp_extract_all(F.substring(c, 1, 500), F.lit(r"\b[A-Z][a-z]+\b"), 0))
    return F.coalesce(F.when(F.size(t) > 0, F.array_join(shown, " ")), F.when(F.size(lead) >= 2, F.array_join(F.slice(lead, 1, 3), " ")), F.lit(f"Untitled Project {day}"))


def focus(types: DataFrame, kind: str = "source_type", confidence: str = "confidence", unsure: float = 0.40) -> DataFrame:
    """Adds focus, what to extract from a source of its kind, and unsure where the kind is a guess of little confidence."""
    m = F.create_map(*[F.lit(x) for kv in FOCUS.items() for x in kv])
    return types.withColumn("focus", F.try_element_at(m, F.col(kind))).withColumn("unsure", F.col(confidence) < unsure)


def decide(docs: DataFrame, key: str, vector: str, projects: DataFrame, cfg: RetrievalConfig | None = None, labels: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """(key, decision, reason, slug, score): where each document goes, all judged against the same projects.

    No projects: create (first). Two labelled projects and more whose gate a document passes: file (zsc). No project
    with a usable centroid: create (cosine). One such project and a score below the cold start: create
    (cosine_cold_start). The best score below the split: create (cosine); else file (cosine). A document without a
    usable vector scores null and is created. ``labels`` (key, label, p) are the entailment scores; projects without
    a filled label are no part of it.
    """
    from tarnwell.functions.text import usable
    from tarnwell.operators.vector import nearest, scores

    cfg = cfg or RetrievalConfig()
    live = projects.where("coalesce(archived, 0) = 0")
    state = live.agg(F.count("*").alias("_projects"), F.count_if(usable(F.col("centroid_embedding"), dim)).alias("_centroids"))
    known = live.where(usable(F.col("centroid_embedding"), dim)).select("slug", "centroid_embedding")
    best = nearest(scores(docs.where(usable(F.col(vector), dim)).select(key, vector), key, vector, known, "slug", "centroid_embedding"), key, "slug").select(key, "slug", "score")
    d = docs.select(key).join(best, key, "left").crossJoin(F.broadcast(state))  # one row of counts
    if labels is not None:
        few = labels.select("label").distinct().limit(2).count() < 2
        passed = gate(labels, key, "label", "p", cfg).where(F.col("passes") & ~F.lit(few)).select(key, F.col("label").alias("_zsc"))
        d = d.join(passed, key, "left")
    else:
        d = d.withColumn("_zsc", F.lit(None).cast("string"))
    first, zsc = F.col("_projects") == 0, F.col("_zsc").isNotNull()
    cold = (F.col("_centroids") == 1) & (F.col("score") < cfg.cold_start)
    low = F.col("score").isNull() | (F.col("score") < cfg.split_below)
    reason = F.when(first, "first").when(zsc, "zsc").when(cold, "cosine_cold_start").otherwise("cosine")
    create = first | (~zsc & (cold | low))
    return d.select(key, F.when(create, "create").otherwise("file").alias("decision"), reason.alias("reason"), F.when(~create, F.coalesce("_zsc", "slug")).alias("slug"), "score")


def filed(projects: DataFrame, docs: DataFrame, decisions: DataFrame, key: str, vector: str, when: str, cfg: RetrievalConfig | None = None, dim: int = 64) -> DataFrame:
    """``projects`` after the decisions: those filed by cosine blend into the centroid in order of time and key, in one fold; all filed count and touch.

    A document filed by its label counts as activity but leaves the centroid alone.
    """
    cfg = cfg or RetrievalConfig()
    hit = decisions.where("decision = 'file'").join(docs.select(key, vector, when), key)
    active = hit.groupBy("slug").agg(F.count("*").alias("_n"), F.max(when).alias("_at"))
    moved = folded(projects, hit.where("reason = 'cosine'"), vector, [when, key], cfg.ema_route, dim)
    return moved.join(active, "slug", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).withColumn("last_activity_ts", F.coalesce(F.greatest("last_activity_ts", "_at"), "_at")).drop("_n", "_at")


def folded(projects: DataFrame, rows: DataFrame, vector: str, order: list[str], alpha: float, dim: int = 64) -> DataFrame:
    """``projects`` with c = (1 - alpha) c + alpha x folded over the ``rows`` (slug, vector) in ``order``.

    A project without a usable centroid starts from its first row. Written in closed form: the rows' weights fall by
    (1 - alpha) from the last to the first, so the rows are summed and not walked.
    """
    from tarnwell.functions.text import usable

    w = W.partitionBy("slug")
    own = rows.where(usable(F.col(vector), dim)).join(projects.select("slug", usable(F.col("centroid_embedding"), dim).alias("_has")), "slug")
    i, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    later = F.pow(F.lit(1 - alpha), n - i)
    weight = F.when((i == 1) & ~F.col("_has"), later).otherwise(alpha * later)
    total = own.withColumn("_w", weight).groupBy("slug").agg(F.array(*[F.sum(F.col("_w") * F.col(vector)[k].cast("double")) for k in range(dim)]).alias("_x"), F.count("*").alias("_k"))
    old = F.transform("centroid_embedding", lambda v: v.cast("double"))
    new = F.when(usable(F.col("centroid_embedding"), dim), F.zip_with(old, F.col("_x"), lambda c, x: c * F.pow(F.lit(1 - alpha), F.col("_k")) + x)).otherwise(F.col("_x"))
    return projects.join(total, "slug", "left").withColumn("centroid_embedding", F.when(F.col("_k").isNull(), old).otherwise(new)).drop("_x", "_k")


def apply_overrides(projects: DataFrame, overrides: DataFrame, vector: str, order: list[str], cfg: RetrievalConfig | None = None, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(projects, log): every correction (source_id, original, slug, vector) blends into the corrected project in order; the log has a row for each."""
    cfg = cfg or RetrievalConfig()
    log = overrides.select("source_id", F.col("original").alias("original_project"), F.col("slug").alias("corrected_project"), *[F.col(c).alias(f"override_{c}") for c in order])
    return folded(projects, overrides, vector, order, cfg.ema_override, dim), log


def created(decisions: DataFrame, docs: DataFrame, projects: DataFrame, key: str, name: str, vector: str, when: str) -> DataFrame:
    """(name, slug, label, centroid_embedding, source_count, last_activity_ts, archived, created_ts): the projects that the decisions make.

    A slug that is taken, by a project or by an earlier name of the batch, goes on with -2, -3 and so on. The label is
    a marker that says it has yet to be written.
    """
    from tarnwell.functions.text import slug as slug_of

    new = decisions.where("decision = 'create'").join(docs.select(key, name, vector, when), key).withColumn("_s", slug_of(F.col(name)))
    taken = projects.select(F.regexp_replace("slug", r"-\d+$", "").alias("_s"), "slug", F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(slug, '-([0-9]+)$', 1), '') AS INT)"), F.lit(1)).alias("_k"))
    last = taken.groupBy("_s").agg(F.max("_k").alias("_last")).unionByName(projects.select(F.col("slug").alias("_s"), F.lit(1).alias("_last"))).groupBy("_s").agg(F.max("_last").alias("_last"))
    n = F.row_number().over(W.partitionBy("_s").orderBy(when, key)) + F.coalesce("_last", F.lit(0))
    out = new.join(last, "_s", "left").withColumn("_n", n)
    return out.select(F.col(name).alias("name"), F.when(F.col("_n") == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", "_n")).alias("slug"), F.lit("TODO").alias("label"), F.col(vector).alias("centroid_embedding"), F.lit(0).cast("long").alias("source_count"), F.col(when).alias("last_activity_ts"), F.lit(0).alias("archived"), F.col(when).alias("created_ts"))


def labelled(projects: DataFrame, label: str) -> DataFrame:
    """Projects whose label is filled: not empty and no TODO marker."""
    t = F.trim(F.col(label))
    return projects.where((F.coalesce(t, F.lit("")) != "") & ~F.upper(t).startswith("TODO"))
