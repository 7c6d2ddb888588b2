"""Variant spellings of the names of people and organisations: trie join, then order and form of the parts.

A name is read into parts: its anchor (the surname, or the place an organisation is named for) and the rest (given
names and initials; kind of organisation and field). Anchors are joined by a trie join: sharded by their first and
last halves, one of which an edit leaves alone, each shard's anchors stand in a trie that a Levenshtein automaton
walks to list all neighbours within the bound. Names whose anchors are linked are then compared part by part, in any
order of the parts, with nicknames, initials, abbreviations, acronyms and one slip of the pen. An abbreviated form
that fits two entities of its anchor belongs to neither.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.llm.components import components
from tarnwell.session import written

#: Words before and after a person's name.
TITLES = set("dr prof rev mr mrs ms miss mx sir dame lady lord professor doctor reverend phd md msc bsc ma ba dphil esq jr sr ii iii iv ed eds hon fr".split())
#: Words that say nothing about an organisation.
IDLE = set("the of for and de la le du des der die das von und y & a an in at on".split())
LEGAL = set("inc ltd llc plc gmbh ag ev registered incorporated limited corp sa bv".split())
#: Words before a surname that belong to it and are often left out or cut off.
PARTICLES = set("de del della di da dos das la le du der den ten ter van von zu bin ibn al el af av".split())
#: Kinds of organisation and how they are shortened.
KINDS = {
    "university": "univ uni", "society": "soc", "institute": "inst instn", "museum": "mus", "foundation": "found fdn fndn fnd", "department": "dept dep dpt",
    "company": "co comp cmpy", "cooperative": "coop", "committee": "comm cttee cmte cte", "council": "coun cncl", "association": "assoc assn ass asn",
    "laboratory": "lab labs laboratories", "college": "coll", "academy": "acad", "centre": "ctr center cntr", "library": "lib", "union": "un", "trust": "tr", "bureau": "bur", "agency": "agcy", "office": "off", "school": "sch", "organization": "org organisation",
}
#: Common short forms of given names.
NICKNAMES = {
    "alexander": "alex sandy sasha al xander", "anthony": "tony ant", "cassandra": "cass cassie sandra sandy", "christopher": "chris kit topher", "deborah": "deb debbie debs", "edward": "ed ned ted eddie teddy",
    "elizabeth": "liz beth lizzie betty eliza betsy libby", "frederick": "fred freddie freddy", "gabriella": "gabby gabi ella gaby", "harold": "hal harry", "isabella": "izzy bella isa bell", "josephine": "jo josie",
    "katherine": "kate kathy katie kit kat kay kitty", "leonard": "len leo lenny", "margaret": "maggie peggy meg marge greta", "matthew": "matt mat", "nicholas": "nick nico nicky klaus", "ottoline": "otto ottie lina",
    "patricia": "pat trish patty tricia", "philippa": "pip pippa phil", "quentin": "quin quint", "quirin": "quin", "rafael": "raf rafa rafe", "richard": "dick rick rich ricky", "robert": "bob rob bert bobby robbie",
    "susannah": "sue susie suzy sanna sukie", "theodore": "ted theo teddy", "ulrich": "uli ulli", "victoria": "vicky tori vic vicki", "william": "bill will billy liam", "yolanda": "yoli yola", "zachary": "zack zach zac",
    "matilda": "tilly", "james": "jim jamie", "john": "jack johnny", "thomas": "tom tommy", "charles": "charlie chuck", "george": "georgie", "henry": "harry hank", "joseph": "joe", "samuel": "sam", "daniel": "dan danny",
    "michael": "mike mick", "benjamin": "ben", "andrew": "andy drew", "rebecca": "becky", "catherine": "cathy kate cath", "eleanor": "nell ellie", "dorothy": "dot dolly", "barbara": "barb babs", "jennifer": "jen jenny", "jessica": "jess",
}
_SPECIAL = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
_OCR = str.maketrans({"0": "o", "1": "l", "5": "s", "3": "e"})


@functools.lru_cache(maxsize=1)
def _short() -> tuple[dict[str, set[str]], dict[str, str]]:
    nick: dict[str, set[str]] = defaultdict(set)
    for full, shorts in NICKNAMES.items():
        for s in shorts.split():
            nick[s].add(full)
    kind = {w: full for full, shorts in KINDS.items() for w in (full, *shorts.split())}
    return dict(nick), kind


def plain(text: str) -> str:
    """Lower case, without accents; letters without decomposition by their usual stand-in."""
    t = "".join(ch for ch in unicodedata.normalize("NFKD", text.replace("’", "'")) if not unicodedata.combining(ch))
    return t.lower().translate(_SPECIAL)


def seen_as(word: str) -> str:
    """The word with letters that a scanner confuses made one."""
    return word.replace("rn", "m").replace("vv", "w")


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (a swap of neighbours is one edit), ``most`` + 1 if above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most and min(row) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


class Trie:
    """A trie of words, walked with a Levenshtein automaton whose state is a row of the distance table."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def near(self, word: str, most: int) -> list[tuple[str, int]]:
        """(w, distance) of all words within ``most`` edits of ``word``, swaps of neighbours being one edit."""
        out: list[tuple[str, int]] = []
        n = len(word)
        stack = [(child, ch, list(range(n + 1)), None, "") for ch, child in self.root.items() if ch]
        if "" in self.root and n <= most:
            out.append(("", n))
        while stack:
            node, ch, row, before, last = stack.pop()
            new = [row[0] + 1]
            for j in range(1, n + 1):
                v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != ch))
                if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == ch:
                    v = min(v, before[j - 2] + 1)
                new.append(v)
            if min(new) > most and min(row) > most:
                continue
            if "" in node and new[n] <= most:
                out.append((node[""], new[n]))
            stack += [(child, c, new, row, ch) for c, child in node.items() if c]
        return out


def bound(word: str, short: int = 5) -> int:
    """Edits allowed in an anchor: none in one of under ``short`` letters, where a single edit makes another name, else one."""
    return 0 if len(word) < short else 1


def trie_join(words: DataFrame, column: str = "word") -> DataFrame:
    """(a, b): all pairs of distinct words within ``bound`` edits of each other, a < b; nulls are left out.

    An edit leaves the first or the last half of a word alone, so words meet in shards of (length of the half, half).
    Words under five letters only equal themselves. A shard holds words of one half only, whatever the corpus.
    """
    w = words.where(F.col(column).isNotNull()).select(F.col(column).alias("w")).distinct().where(F.char_length("w") >= 5)
    halves = F.array_distinct(F.transform(F.array(*[F.floor((F.char_length("w") + d) / 2).cast("int") - 1 for d in (-1, 0, 1)]), lambda n: F.greatest(n, F.lit(1))))
    keyed = w.select("w", F.explode(halves).alias("n")).select("w", F.explode(F.array(F.concat_ws(":", F.lit("a"), "n", F.expr("left(w, n)")), F.concat_ws(":", F.lit("z"), "n", F.expr("right(w, n)")))).alias("shard"))
    # the words are short and the walks are long: as many tasks as the session has partitions, not as few as the bytes would fill
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = keyed.repartition(tasks, "shard").withColumn("many", F.count("*").over(W.partitionBy("shard"))).where("many > 1").select("shard", "w")

    def run(table: pa.Table) -> pa.Table:
        own = sorted(set(table["w"].to_pylist()))
        trie = Trie(own)
        a, b = [], []
        for x in own:
            for y, d in trie.near(x, bound(x)):
                if x < y and d:
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return spread.groupBy("shard").applyInArrow(run, "a string, b string").distinct()


def read_name(name: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """(kind, readings): kind is person, org or other; a reading is (anchor, other parts in order).

    A person written without a comma has two readings, surname last and surname first. Anchors of any length count;
    particles of a surname are left out. What is read as neither is "other": such names are linked where they are
    spelled alike, case, accents, spacing and punctuation aside (see ``link``).
    """
    _, kinds = _short()
    raw = plain(name).strip()
    if ":" in raw:
        return "other", []
    caps = {w for w in re.findall(r"\b[A-Z]{2,5}\b", name)} if not name.isupper() else set()
    t = re.sub(r"\bco-?op\b", "coop", raw)
    t = re.sub(r"\be\.\s*v\.?(?=\W|$)", " ev ", t)
    comma = [x.strip() for x in t.split(",") if x.strip()]
    tok = lambda s: [w.translate(_OCR) if re.search(r"[a-z]", w) and not re.fullmatch(r"\d+[a-z]{0,2}", w) else w for w in re.findall(r"[^\W_]+(?:'[^\W_]+)*", s)]
    words = tok(t)
    core = [w for w in words if w not in IDLE and w not in LEGAL]
    if not core:
        return "other", []
    has_kind = [w for w in core if w in kinds or any(len(w) > 4 and distance(w, k, 1) <= 1 for k in KINDS)]
    acronym = core[-1] if len(core) == 2 and core[-1].upper() in caps and len(core[-1]) >= 3 and core[0].upper() not in caps and core[-1] not in ("phd",) else ""
    if acronym and not (acronym == "msc" and "MSc" in name):
        return "org", [(core[0], [acronym])]
    if has_kind and len(core) >= 3:
        first = core[0] in has_kind
        anchor = core[-1] if first else core[0]
        rest = core[:-1] if first else core[1:]
        return "org", [(anchor, rest)]
    if len(has_kind) == 1 and len(core) == 2 and "," not in t and core[-1] in has_kind and core[-1] not in TITLES:
        return "org", [(core[0], [_kind_of(core[1])])]  # two words, the second a kind: Tate Museum, Tate Mus.
    if name.strip().isupper() and len(core) == 1 and 2 <= len(core[0]) <= 6 and core[0].isalpha():
        return "org", [(core[0], ["="])]  # an acronym alone names what is written so
    if has_kind or any(w in IDLE - PARTICLES and len(w) > 1 for w in words):
        # a kind and a place with words between them, or a title of several words: an organisation by all its words
        if spelled(name) and (len(core) >= 3 or (has_kind and len(core) == 2)):
            return "org", [(core[-1], core[:-1])]
    parts = [tok(x) for x in comma]
    parts = [[w for w in p if w not in TITLES and w not in LEGAL] for p in parts]
    # particles go: "Ludwig von Mises" and "Mises, Ludwig" are read alike
    bare = [[w for k, w in enumerate(p) if w not in PARTICLES or len(p) == 1 or (k == 0 and len(p) == 2 and len(parts) == 1)] for p in parts]
    parts = [p for p in bare if p]
    flat = [w for p in parts for w in p]
    if any(w.isdigit() for w in flat) or (flat and re.search(r"\d", flat[-1])):
        return "other", []
    if len(parts) == 2 and len(parts[0]) <= 2 and any(len(w) > 1 for w in parts[0]):
        return "person", [(parts[0][-1], parts[1])] if len(parts[0]) == 1 else [(parts[0][-1], parts[1] + parts[0][:-1])]
    full = [i for i, w in enumerate(flat) if len(w) > 1]
    if not 2 <= len(flat) <= 6 or not full or (len(flat) >= 4 and len(full) > 2 and not any(w[:1].isupper() for w in re.findall(r"[^\W_]+", name)[1:])):
        return "other", []
    ends = sorted({0, len(flat) - 1} & set(full))
    return "person", [(flat[i], flat[:i] + flat[i + 1 :]) for i in reversed(ends)]


def given_fits(form: str, full: str) -> bool:
    """Whether a written given name can stand for ``full``: itself, an initial, a start, a nickname or a slip."""
    nick, _ = _short()
    if form == full or (len(form) == 1 and full[:1] == form):
        return True
    if full in nick.get(form, ()):
        return True
    if len(form) >= 3 and len(full) > len(form) and full.startswith(form):
        return True
    return len(form) >= 4 and len(full) >= 4 and form not in nick and (distance(form, full, 1) <= 1 or seen_as(form) == seen_as(full))


def _kind_of(w: str) -> str:
    _, kinds = _short()
    if w in kinds:
        return kinds[w]
    return next((k for k in KINDS if len(w) > 4 and distance(w, k, 1) <= 1), "")


def resolve_people(forms: list[tuple[int, str, list[str]]], givens: set[str]) -> list[int]:
    """A cluster for each (weight, anchor, other parts) of linked anchors; parts are given name and middle initials.

    Full given names make the people; short forms join the one they fit, told apart by middle initials if need be.
    """
    nick, _ = _short()
    heads: dict[str, list[int]] = {}
    label = [-1] * len(forms)
    is_full = lambda g: len(g) > 2 and g not in nick and (g in givens or g in NICKNAMES)
    for i, (_, _, rest) in enumerate(forms):
        if rest and is_full(rest[0]):
            heads.setdefault(rest[0], []).append(i)
    people = sorted(heads)
    for k, g in enumerate(people):
        for i in heads[g]:
            label[i] = k
    middles: list[set[str]] = [{r[0] for i in heads[g] for r in forms[i][2][1:2]} for g in people]
    rest_of = [i for i in range(len(forms)) if label[i] < 0 and forms[i][2]]

    def choose(parts: list[str]) -> int:
        fits = [k for k, g in enumerate(people) if given_fits(parts[0], g)]
        if len(parts) > 1:
            middle = parts[1][0]
            agree = [k for k in fits if middle in middles[k]]
            fits = agree or [k for k in fits if not middles[k]] or ([] if len(fits) > 1 else fits)
        elif len(fits) > 1 and len(parts[0]) > 1:
            fits = [k for k in fits if distance(parts[0], people[k], 1) <= 1] or fits
        return fits[0] if len(fits) == 1 else -1

    for i in sorted(rest_of, key=lambda i: -len(forms[i][2][0])):
        label[i] = choose(forms[i][2])
    # short forms of a name that nobody here has in full: the one full name that they can stand for makes a person
    pool = givens | set(NICKNAMES)
    for i in rest_of:
        g = forms[i][2][0]
        if label[i] < 0 and len(g) > 2 and not any(given_fits(g, p) for p in people):
            sure = {x for x in pool if given_fits(g, x)}
            if len(sure) == 1:
                full = sure.pop()
                label[i] = len(people)
                people.append(full)
                middles.append({r[0] for r in forms[i][2][1:2]})
                for j in rest_of:
                    if label[j] < 0 and len(forms[j][2][0]) > 1 and given_fits(forms[j][2][0], full):
                        label[j] = label[i]
                        middles[-1] |= {r[0] for r in forms[j][2][1:2]}
    for i in rest_of:
        if label[i] < 0 and len(forms[i][2][0]) == 1:
            label[i] = choose(forms[i][2])
    # what fits nobody: alike forms belong together
    free: list[tuple[str, str, int]] = []
    for i in rest_of:
        if label[i] >= 0:
            continue
        g, m = forms[i][2][0], (forms[i][2][1][0] if len(forms[i][2]) > 1 else "")
        if any(given_fits(g, p) for p in people):
            label[i] = -2 - i  # ambiguous: nobody's
            continue
        hit = next((k for h, hm, k in free if (given_fits(g, h) or given_fits(h, g)) and (not m or not hm or m == hm)), None)
        if hit is None:
            hit = len(people) + len(free)
            free.append((g, m, hit))
        label[i] = hit
    for i in range(len(forms)):
        if label[i] == -1:
            label[i] = -2 - i
    return label


def org_fits(a: list[str], b: list[str]) -> bool:
    """Whether the kinds and fields of two organisations of one anchor are the same."""
    if len(b) == 1 and len(a) > 1:
        a, b = b, a
    if len(a) == 1 and len(b) > 1:
        kinds = [w for w in b if _kind_of(w)]
        fields = [w for w in b if not _kind_of(w)]
        letters = [w[0] for w in fields] + [_kind_of(w)[0] for w in kinds]
        return sorted(a[0]) == sorted(letters) and a[0][-1] == letters[-1]
    if len(a) == 1:
        return a == b
    ka, kb = {_kind_of(w) for w in a} - {""}, {_kind_of(w) for w in b} - {""}
    fa, fb = [w for w in a if not _kind_of(w)], [w for w in b if not _kind_of(w)]
    if ka != kb or len(fa) != len(fb):
        return False
    same = lambda x, y: x == y or (min(len(x), len(y)) >= 2 and (x.startswith(y) or y.startswith(x))) or (min(len(x), len(y)) >= 3 and distance(x, y, 1) <= 1)
    left = list(fb)
    for x in fa:
        y = next((y for y in left if same(x, y)), None)
        if y is None:
            return False
        left.remove(y)
    return True


def resolve_orgs(forms: list[tuple[int, str, list[str]]]) -> list[int]:
    """A cluster for each form; an acronym that fits two organisations is nobody's.

    Forms that fit any form of an organisation belong to it, so two slips of one name meet through the name itself.
    """
    groups: list[list[list[str]]] = []
    place: dict[tuple[str, ...], int] = {}
    for rest in sorted({tuple(f[2]) for f in forms if len(f[2]) > 1}):
        fits = [k for k, g in enumerate(groups) if g and any(org_fits(list(rest), h) for h in g)]
        if not fits:
            groups.append([])
            fits = [len(groups) - 1]
        home, *others = fits
        groups[home].append(list(rest))
        for k in others:
            groups[home] += groups[k]
            groups[k] = []
    for k, g in enumerate(groups):
        for h in g:
            place[tuple(h)] = k
    single: dict[str, int] = {}
    label = []
    for i, (_, _, rest) in enumerate(forms):
        if len(rest) > 1:
            label.append(place[tuple(rest)])
            continue
        fits = [k for k, g in enumerate(groups) if any(org_fits(rest, h) for h in g)]
        if not fits:
            label.append(single.setdefault(rest[0] if rest else "", len(groups) + len(single)))
        else:
            label.append(fits[0] if len(fits) == 1 else -2 - i)
    return label


def spelled(name: str) -> str:
    """What is left of a name that can't be read: its words in order; empty unless each longer word is capitalised."""
    words = re.findall(r"[^\W_]+", name)
    if not words or ":" in name or any(w[0].islower() and len(w) > 3 for w in words) or any(ch.isdigit() for ch in name):
        return ""
    return " ".join(plain(w) for w in words)


def link(entities: DataFrame, key: str = "id", name: str = "name", common: int = 3) -> DataFrame:
    """(key, cluster) of each row that names a person or an organisation.

    Rows are told apart by the name alone, whatever their type and project. Re-delivered rows (one key) count once;
    null or empty names have no row. Names of another shape have one if they are written in capitalised words, and
    are linked to those spelled alike only. Rows of one spelling are folded before they are
    compared, so a name that fills a third of the table is one form.
    """
    rows = entities.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("name")).dropDuplicates(["key"])

    def read(batches):
        for b in batches:
            out: dict[str, list] = {"name": [], "kind": [], "option": [], "anchor": [], "rest": []}
            for n in b.column(0).to_pylist():
                kind, readings = read_name(n)
                if not readings and (alike := spelled(n)):
                    kind, readings = "other", [(alike, [])]
                for k, (anchor, rest) in enumerate(readings):
                    for c, v in zip(out, (n, kind, k, anchor, rest), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({"name": pa.array(out["name"], pa.string()), "kind": pa.array(out["kind"], pa.string()), "option": pa.array(out["option"], pa.int32()), "anchor": pa.array(out["anchor"], pa.string()), "rest": pa.array(out["rest"], pa.list_(pa.string()))})

    forms = written(rows.groupBy("name").agg(F.count("*").alias("weight")).select("name").mapInArrow(read, "name string, kind string, option int, anchor string, rest array<string>"), "forms")
    # which token is the given name: given names go with many surnames, surnames with few given names
    sure = forms.where("kind = 'person' and size(rest) > 0").select("name", F.col("anchor").alias("s"), F.col("rest")[0].alias("g")).where("char_length(g) > 2")
    partners = written(sure.select(F.col("g").alias("t"), F.col("s").alias("o")).groupBy("t").agg(F.count_distinct("o").alias("n")), "partners")
    # a slip or a short form of a given name counts as much as the name
    slips = trie_join(partners.select(F.col("t").alias("word")))
    either = slips.unionByName(slips.select(F.col("b").alias("a"), F.col("a").alias("b")))
    starts = partners.select(F.col("t").alias("b"), F.explode(F.expr("transform(sequence(3, greatest(3, char_length(t) - 1)), k -> left(t, k))")).alias("a")).where("a != b")
    kin = written(either.unionByName(starts).join(partners.select(F.col("t").alias("b"), F.col("n").alias("nb")), "b").groupBy(F.col("a").alias("t")).agg(F.max("nb").alias("nb")).join(partners.select("t"), "t", "left_semi"), "kin")
    worth = partners.join(kin, "t", "left").select(F.col("t").alias("anchor"), F.greatest("n", F.coalesce("nb", F.lit(0))).alias("as_given"))
    short = sorted(set(NICKNAMES) | set(_short()[0]))
    ranked = (
        forms.where("kind = 'person'").join(worth, "anchor", "left")
        .select("name", "kind", "option", "anchor", "rest", (F.coalesce("as_given", F.lit(0)) + F.when(F.col("anchor").isin(short), 1_000_000).otherwise(0)).alias("n"))
    )
    one = ranked.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("n", "option"))).where("r = 1").select("name", "kind", "anchor", "rest")
    people = written(one, "people")
    seen = written(people.where("size(rest) > 0 and char_length(rest[0]) > 2").groupBy(F.col("rest")[0].alias("g")).agg(F.count_distinct("anchor").alias("n")), "given")
    # a token that is the start of a much commoner one, or a slip away from it, is no given name in full
    given = written(seen.where(F.col("n") >= common).join(kin.withColumnRenamed("t", "g"), "g", "left").where(F.coalesce("nb", F.lit(0)) < 4 * F.col("n")).select("g"), "given")
    every = people.unionByName(forms.where("kind = 'org'").select("name", "kind", "anchor", "rest"))
    anchors = every.select("kind", "anchor").distinct()
    ids = written(anchors.select("kind", "anchor", F.xxhash64("kind", "anchor").alias("aid")), "anchors")
    alike = F.regexp_replace(F.regexp_replace("anchor", "rn", "m"), "vv", "w")
    scanned = ids.withColumn("alike", alike).withColumn("first", F.min("aid").over(W.partitionBy("kind", "alike"))).where("first != aid").select(F.col("first").alias("a"), F.col("aid").alias("b"))
    near = scanned
    for k in ("person", "org"):
        p = trie_join(ids.where(F.col("kind") == k).select(F.col("anchor").alias("word"))).select(F.xxhash64(F.lit(k), "a").alias("a"), F.xxhash64(F.lit(k), "b").alias("b"))
        near = near.unionByName(p)
    label = components(near)
    block = ids.join(label, ids.aid == label.id, "left").select("kind", "anchor", F.coalesce("label", "aid").alias("block"))
    known = every.join(block, ["kind", "anchor"]).join(given.withColumnRenamed("g", "first").withColumn("common", F.lit(True)), F.col("rest")[0] == F.col("first"), "left").select("block", "kind", "name", "anchor", "rest", F.coalesce("common", F.lit(False)).alias("common"))

    def settle(t: pa.Table) -> pa.Table:
        got = t.to_pylist()
        block_, kind = got[0]["block"], got[0]["kind"]
        shapes: dict[tuple, int] = {}
        for r in got:
            shapes.setdefault((r["anchor"], *r["rest"]), len(shapes))
        forms_ = [(1, s[0], list(s[1:])) for s in shapes]
        labels = resolve_orgs(forms_) if kind == "org" else resolve_people(forms_, {r["rest"][0] for r in got if r["common"]})
        return pa.table({"name": pa.array([r["name"] for r in got], pa.string()), "cluster": pa.array([f"{kind}:{block_}:{labels[shapes[(r['anchor'], *r['rest'])]]}" for r in got], pa.string())})

    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clusters = known.repartition(tasks, "block", "kind").groupBy("block", "kind").applyInArrow(settle, "name string, cluster string")
    clusters = clusters.unionByName(forms.where("kind = 'other'").select("name", F.concat(F.lit("other:"), "anchor").alias("cluster")))
    return rows.join(clusters, "name").select(F.col("key").alias(key), "cluster")


def linked_pairs(clusters: DataFrame, key: str = "id") -> DataFrame:
    """(a, b), a < b: every pair of rows of one cluster."""
    a, b = clusters.select(F.col(key).alias("a"), "cluster"), clusters.select(F.col(key).alias("b"), "cluster")
    return a.join(b, "cluster").where("a < b").select("a", "b")
