"""Page furniture against main content, by the ratios of tag paths.

Fetched text has no tags left, so a line's path is rebuilt from what the text shows: site / opening line above it /
template of the line. The template is the line without bullets, with its digits, its site's name, the page's title,
months and weekdays replaced by marks. For each path its ratios are gathered over all pages: on how many of the pages
it stands (furniture recurs, an article's lines don't), how far its words belong to the text of its pages (a
heading's words do, a button's don't), how long its text is and how often it ends in punctuation. The ratios of a
path are smoothed towards those of its template on all sites, the more the fewer pages it has, then fused and
thresholded. Paths below an opening line that is itself furniture and whose next lines are mostly unpunctuated titles
("Most read") are teasers. At last the decision is smoothed along the page.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.session import drop_written, written

#: Names of months and weekdays (English, French, German, Spanish), as they stand in dates.
MONTHS = (
    "january february march april may june july august september october november december "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "januar februar märz juni juli oktober dezember "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()
DAYS = (
    "monday tuesday wednesday thursday friday saturday sunday lundi mardi mercredi jeudi vendredi samedi dimanche "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes sábado domingo"
).split()

#: Columns of a line. Texts of paths are 64-bit hashes, which is all that is compared, 0 for none; ``marks`` counts punctuation.
LINES = (
    "row_id long, line_no long, host long, page long, template long, head long, named boolean, blank boolean, chars int, marks int, ended boolean, "
    "titled boolean, teaser boolean, related boolean, known boolean, before long, items array<long>, shape string"
)


@functools.lru_cache(maxsize=1)
def _patterns():
    import re

    return {
        "bullet": re.compile(r"^(?:[-–—*•·>»›+]\s+)+"),
        "digits": re.compile(r"\d+(?:[.,]\d+)*"),
        "word": re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*"),
        "month": re.compile(r"\b(?:" + "|".join(MONTHS) + r")\b"),
        "day": re.compile(r"\b(?:" + "|".join(DAYS) + r")\b"),
        "space": re.compile(r"\s+"),
        "split": re.compile(r"\s*[|·»›>/]\s*|\s{2,}|\s+-\s+"),
        "ended": re.compile(r"[.!…。！]['\"”’»)\]]*$"),
        "trail": re.compile(r"\s[>›»/]\s"),
        "punct": re.compile(r"([^\w\s])"),
        "host": re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/@]*@)?(?:www\.)?([^/:?#\s]*)", re.I),
        "name": re.compile(r"(?<=\S )[A-ZÀ-ÖØ-ÞŁŚŻ][^\W\d_]*"),
        "digit": re.compile(r"\d"),
        "mark": re.compile(r"[.,;:!?…]"),
    }


def host_of(url: str | None) -> str:
    m = _patterns()["host"].match((url or "").strip())
    return m.group(1).lower() if m else ""


def page_of(url: str | None) -> str:
    """The last part of the path, without query and mark: pages fetched twice count once."""
    parts = (url or "").split("?")[0].split("#")[0].rstrip("/").split("/")
    return parts[-1].lower() if len(parts) > 3 or len(parts) == 1 else ""


def hashed(text: str) -> int:
    """A signed 64-bit hash of a text, never 0 but for the empty one."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)) or 1 if text else 0


@functools.lru_cache(maxsize=100_000)
def _line(wide: str) -> tuple:
    """What a line shows by itself, whatever page it stands on; lines that recur are read once a worker."""
    p = _patterns()
    raw = p["space"].sub(" ", wide)
    ended = bool(p["ended"].search(raw))
    bare = p["bullet"].sub("", raw).strip() or raw
    low = bare.casefold()
    cells = tuple(c for c in p["split"].split(p["bullet"].sub("", wide).strip()) if c)
    items = tuple(c.casefold() for c in cells) if len(cells) > 1 and not p["digit"].search(wide) and all(len(c) <= 20 for c in cells) else ()
    if not items and len(cells) > 1 and p["trail"].search(bare) and len(cells[0]) <= 20:
        trail = tuple(c.casefold() for c in cells[:-1])  # a breadcrumb, should these be menu items
    else:
        trail = ()
    words = tuple(w for w in p["word"].findall(low) if len(w) >= 4)
    template = p["month"].sub("\x03", p["day"].sub("\x04", p["digits"].sub("0", low)))
    dated = p["digit"].search(bare) is not None
    start = bare[0]
    many = bare.count(" ") + 1
    seps = any(s in bare for s in (": ", " - ", ", ", " : ")) or bare.endswith("?")
    marked = raw[0] in "•*" or ("|" in bare and dated)
    title = not ended and not marked and len(bare) <= 90 and (start.isupper() or start.isdigit() or start in "¿«\"“") and (many >= 4 or seps or (many == 3 and bare.rsplit(" ", 1)[1][0].isupper()))
    shape = p["digits"].sub("0", p["punct"].sub(r" \1 ", p["name"].sub("N", bare))).casefold() if title else ""
    plain = start.isupper() and not dated and not marked
    marks = 0 if len(bare) < 2 else len(p["mark"].findall(bare))
    return ended, bare, low, cells, items, trail, words, template, dated, title, shape, plain, marks, tuple(hashed(c) for c in items or trail)


def read_lines(text: str, url: str | None, title: str | None) -> list[tuple]:
    """What a page's lines are, in the order of ``LINES`` from ``template`` to ``shape``; one tuple a line."""
    p = _patterns()
    host = host_of(url)
    site = " ".join(host.split(".")[0].split("-")) if host else ""
    fold = p["space"].sub(" ", title or "").strip().casefold()
    read = [_line(x) if x else None for x in (x.strip() for x in text.split("\n"))]
    count: dict[str, list[int]] = {}
    for i, r in enumerate(read):
        if r and r[0] and len(r[1]) > 60:
            for w in set(r[6]):
                count.setdefault(w, []).append(i)
    for w in set(p["word"].findall(fold)):
        count.setdefault(w, []).append(-1)
    out, before = [], 0
    for i, r in enumerate(read):
        if r is None:
            out.append((0, 0, False, True, 0, 0, False, False, False, False, False, before, [], ""))
            continue
        ended, bare, low, cells, items, trail, words, t, dated, teaser, shape, plain, marks, hashes = r
        titled = bool(fold) and (low == fold or (len(low) >= 12 and (fold.startswith(low) or low.startswith(fold))))
        last = cells[-1].casefold() if cells else ""
        crumb = len(cells) > 1 and bool(fold) and not titled and len(last) >= 4 and (fold.startswith(last) or last == fold) and cells[0].casefold() != fold
        row = len(items) >= 4 and not ended  # many short cells without figures: a menu in one line
        if len(fold) >= 4 and fold in low or len(site) >= 4 and site in low:
            own = low.replace(fold, "\x01") if len(fold) >= 4 else low
            t = p["month"].sub("\x03", p["day"].sub("\x04", p["digits"].sub("0", own.replace(site, "\x02") if len(site) >= 4 else own)))
        # names inside a line with figures or the site's name vary from site to site
        head, named = "", False
        if "0" in t or "\x02" in t:
            h = bare
            at = h.casefold().find(site) if site else -1
            if at >= 0 and len(h.casefold()) == len(h):
                h = h[:at] + "\x02" + h[at + len(site) :]
            head = p["digits"].sub("0", p["name"].sub("N", h)).casefold()
            named = "\x02" in head
        related = bool(words) and sum(1 for w in words if (c := count.get(w)) and (len(c) > 1 or c[0] != i)) >= 0.5 * len(words)
        key = hashed(t)
        teaser = teaser and not titled
        dated = "0" in t
        out.append((key, hashed(head), named, False, len(bare), marks, ended, titled, teaser, related, crumb or (row and not related), before, list(hashes), shape if teaser else "~" if plain and not dated else ""))
        before = key
    return out


def lines(pages: DataFrame) -> DataFrame:
    """One row a line of every page; see ``LINES``. Re-delivered rows count once, null texts have no lines."""
    src = pages.where("row_id is not null and text is not null").select("row_id", "source_url", "source_title", "text").dropDuplicates(["row_id"])

    names = [c.split()[0] for c in LINES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in LINES.split(", ")]

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for row, url, title, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = read_lines(text, url, title)
                n = len(got)
                for c, v in zip(cols, ([row] * n, range(1, n + 1), [hashed(host_of(url))] * n, [hashed(page_of(url) or (title or ""))] * n, *zip(*got, strict=True)), strict=True):
                    c.extend(v)
                if len(cols[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
                    cols = [[] for _ in names]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return src.mapInArrow(run, LINES)


def site_pages(rows: DataFrame) -> DataFrame:
    """(host, of): the pages of each site."""
    return rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("of"))


def path_ratios(rows: DataFrame, column: str, prior: float, pages: DataFrame) -> DataFrame:
    """(column, n, hosts, share, related, ended, length, marks): for a part of the paths, its pages on all sites, its share of its sites' pages, and its text."""
    own = rows.where(f"not blank and {column} != 0")
    seen = own.groupBy(column, "host", "page").agg(F.max(F.col("related").cast("int")).alias("r"), F.max(F.col("ended").cast("int")).alias("e"), F.max("chars").alias("c"), F.max("marks").alias("m"))
    by_host = seen.groupBy(column, "host").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in "recm"])
    ratio = lambda x: F.sum(x) / F.sum("n")
    return (
        by_host.join(pages, "host").groupBy(column)
        .agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), (F.sum("n") / F.sum(F.col("of") + prior)).alias("share"), ratio("r").alias("related"), ratio("e").alias("ended"), ratio("c").alias("length"), ratio("m").alias("marks"))
    )


PATH = ["host", "before", "template"]


def smoothed_paths(rows: DataFrame, general: DataFrame, pages: DataFrame, prior: float) -> DataFrame:
    """(host, before, template, n, share, related, ended, length, marks) of the paths whose template is in ``general``.

    Relation, punctuation and length of a path are drawn towards its template's on all sites, by the weight of
    ``prior`` pages; its share and its pages are the greater of the path's own and of the template's.
    """
    own = rows.where("not blank").join(general.select("template"), "template", "left_semi")
    seen = own.groupBy(*PATH, "page").agg(F.max(F.col("related").cast("int")).alias("r"), F.max(F.col("ended").cast("int")).alias("e"), F.max("chars").alias("c"), F.max("marks").alias("m"))
    p = seen.groupBy(*PATH).agg(F.count("*").alias("k"), *[F.sum(x).alias(x) for x in "recm"]).join(general, "template").join(pages, "host")
    drawn = lambda x, whole: ((F.col(x) + prior * F.col(whole)) / (F.col("k") + prior)).alias(whole)
    return p.select(*PATH, F.greatest("k", "n").alias("n"), F.greatest(F.col("k") / (F.col("of") + prior), F.col("share")).alias("share"), drawn("r", "related"), drawn("e", "ended"), drawn("c", "length"), drawn("m", "marks"))


def furniture(
    pages: DataFrame, often: float = 0.12, seldom: float = 0.008, seldom_ended: float = 0.02, unrelated: float = 0.2, least: int = 3, prior: float = 8.0, opens: float = 0.6, menu_sites: int = 3, heading: float = 0.5, always: float = 0.9, common_word: float = 0.01,
) -> DataFrame:
    """(row_id, line_no) of the lines of ``pages`` that aren't part of the article; see the module.

    ``pages`` has row_id, source_url, source_title and text. Blank lines are no furniture. Null URLs share one
    nameless site, null titles match nothing. A page that is all furniture gives all its lines, an empty one none.
    """
    rows = written(lines(pages), "lines")
    of = written(site_pages(rows), "sites")
    # punctuation and length fused: text in sentences, for which more is asked than for labels
    prose = F.col("ended") * F.least(F.lit(1.0), (F.col("length") + 20 * F.col("marks")) / 60) > 0.5
    rate = F.when(prose, seldom_ended).otherwise(seldom)
    recurring = ((F.col("share") >= often) & (F.col("related") < 0.6)) | ((F.col("related") <= unrelated) & (F.col("share") >= rate) & (F.col("n") >= least + 2))
    general = written(path_ratios(rows, "template", prior, of).where((F.col("n") >= least) & (F.col("share") >= min(often, seldom) / 2)).drop("hosts"), "templates")
    flagged = written(smoothed_paths(rows, general, of, 4 * prior).where(F.col("n") >= least).where(recurring).select(*PATH, F.lit(True).alias("f1")), "paths")
    # of site-wide lines with names and figures every site has one wording; bylines and table rows have many
    wordings = rows.where("not blank and head != 0").select("head", "host", "template").distinct().groupBy("head").agg((F.count("*") / F.count_distinct("host")).alias("wordings"))
    own_name = rows.where("named").select("head", F.lit(True).alias("named")).distinct()
    constant = F.col("named") & (F.col("wordings") <= 1.5) & (F.col("share") >= F.when(F.col("ended") > 0.5, seldom_ended).otherwise(seldom))
    phrase = (F.col("share") >= often) & ((F.col("wordings") <= 1.5) | (F.col("ended") > 0.5))
    h = (
        path_ratios(rows, "head", prior, of).where((F.col("n") >= least + 2) & (F.col("hosts") >= 2)).join(wordings, "head").join(own_name, "head", "left").withColumn("named", F.coalesce("named", F.lit(False)))
        .where((F.col("related") <= F.when(F.col("named"), unrelated).otherwise(0.05)) & (constant | phrase)).select("head", F.lit(True).alias("f2"))
    )
    menu = (
        rows.where("size(items) > 1 and not related").select("host", F.explode("items").alias("item")).distinct()
        .groupBy("item").agg(F.count("*").alias("sites")).where(F.col("sites") >= menu_sites).select(F.col("item").alias("template"), F.lit(True).alias("f3"))
    )
    inside = (
        rows.where("size(items) > 1").select("row_id", "line_no", F.explode("items").alias("template"))
        .join(menu, "template", "left").groupBy("row_id", "line_no").agg((F.count("f3") == F.count("*")).alias("f4"))
    )
    marked = (
        rows.where("not blank").drop("items", "page", "named", "marks")
        .join(flagged, PATH, "left").join(h, "head", "left").join(menu, "template", "left").join(inside, ["row_id", "line_no"], "left")
        .withColumn("furniture", ~F.col("titled") & (F.coalesce("f1", "f2", "f3", F.lit(False)) | F.coalesce("f4", F.lit(False)) | F.col("known")))
        .select("row_id", "line_no", "template", "before", "chars", "ended", "titled", "teaser", "related", "shape", "furniture")
    )
    marked = marked_table = written(marked, "marked")
    # shapes of titles keep the words that many titles share; one word in a hundred leaves a few hundred at most
    titles = marked.where("teaser and not titled and not furniture").select(F.array_distinct(F.split("shape", " +")).alias("w"))
    many = titles.count()
    kept = [r["w"] for r in titles.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(common_word * many)).select("w").collect()]
    known = F.array(*[F.lit(w) for w in kept]) if kept else F.array().cast("array<string>")
    marked = marked.withColumn("shape", F.when(F.col("teaser"), F.array_join(F.transform(F.split("shape", " +"), lambda w: F.when(F.array_contains(known, w), w).otherwise(F.lit("_"))), " ")).otherwise(F.col("shape")))
    # opening lines: furniture, and what follows them is mostly a title that is not itself furniture
    opening = (
        marked.where("before != 0").groupBy("before").agg(F.avg((F.col("teaser") & ~F.col("furniture") & ~F.col("titled")).cast("int")).alias("p"), F.count("*").alias("n"))
        .join(flagged.select(F.col("template").alias("before")), "before", "left_semi").where((F.col("p") >= opens) & (F.col("n") >= least)).select(F.col("before").alias("template"), F.lit(True).alias("opens"))
    )
    page = marked.join(opening, "template", "left").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "furniture", F.coalesce("opens", F.lit(False)).alias("opens"), "teaser", "titled", "ended", "related", "chars", "shape"))).alias("rows"))

    def run(batches):
        for b in batches:
            edges, cells = b.column(1).offsets.to_pylist(), b.column(1).values
            no, furn, opens_, teaser, titled, ended, related, chars, shape = (cells.field(c).to_pylist() for c in ("line_no", "furniture", "opens", "teaser", "titled", "ended", "related", "chars", "shape"))
            out: list[list] = [[], [], [], [], []]
            for row, lo, hi in zip(b.column(0).to_pylist(), edges, edges[1:], strict=False):
                bad, below, under = furn[lo:hi], [False] * (hi - lo), False
                for i in range(lo, hi):
                    if furn[i]:
                        under = opens_[i]
                    elif under and teaser[i]:
                        below[i - lo] = True
                    else:
                        under = False
                n = hi - lo
                for i in range(n):  # smoothing: a short stray line among furniture
                    j = lo + i
                    if not bad[i] and shape[j] == "~" and not ended[j] and not titled[j] and not related[j] and chars[j] <= 60:
                        bad[i] = i > 0 and (bad[i - 1] or below[i - 1]) and (i == n - 1 or bad[i + 1])
                for i in range(n):
                    if bad[i] or below[i] or (teaser[lo + i] and not titled[lo + i]):
                        for c, v in zip(out, (row, no[lo + i], bad[i], below[i], shape[lo + i]), strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["row_id", "line_no", "bad", "below", "shape"])

    walked = written(page.mapInArrow(run, "row_id long, line_no long, bad boolean, below boolean, shape string"), "walked")
    # the last path: below an opening line / shape of the line; headings have shapes that stand elsewhere too
    shapes = walked.where("not bad and shape not in ('', '~')").groupBy("shape").agg(F.avg(F.col("below").cast("int")).alias("under"), F.count("*").alias("n"))
    common = shapes.where(F.col("n") >= least + 2)
    final = walked.join(common.select("shape", "under"), "shape", "left")
    teaser_ = F.when(F.col("below"), F.coalesce(F.col("under") >= heading, F.lit(True))).otherwise(F.coalesce(F.col("under") >= always, F.lit(False)))
    out = written(final.where(F.col("bad") | teaser_).select("row_id", "line_no"), "furniture")
    for t in (rows, of, general, flagged, marked_table, walked):
        drop_written(t)
    return out


def main_text(pages: DataFrame, **options) -> DataFrame:
    """(row_id, text): the article alone, its lines joined as they stood; null where nothing of the page is article."""
    bad = furniture(pages, **options).withColumn("bad", F.lit(True))
    src = pages.where("row_id is not null").select("row_id", "text").dropDuplicates(["row_id"])
    kept = src.select("row_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("line_no", (F.col("k") + 1).cast("long")).join(bad, ["row_id", "line_no"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    whole = kept.groupBy("row_id").agg(text.alias("text"))
    return src.select("row_id").join(whole, "row_id", "left").select("row_id", F.when(F.trim("text") != "", F.col("text")).alias("text"))
