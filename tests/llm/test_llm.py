"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import boilerplate, cluster, components, encode, history, names, pack, reading, split, vectors

HAVE = os.path.exists(encode.TOKENIZER)


# 1: batches against all history


def sources_and_chunks(spark, bodies, given=None):
    """One source a body (None: no chunks), a day apart; bodies are cut into chunks of a paragraph."""
    src = [(i, f"p{i}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), (given or {}).get(i), "x") for i in range(1, len(bodies) + 1)]
    ch = [(100 * i + k, i, k, part, "clash") for i, b in enumerate(bodies, 1) if b is not None for k, part in enumerate(b.split("\n\n"))]
    s = spark.createDataFrame(src + src[:1], "id long, file_path string, ingest_ts timestamp_ntz, content_hash string, extra string")
    c = spark.createDataFrame(ch + ch[:1], "id long, source_id long, chunk_index int, content string, extra string")
    return s, c


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(["lock", "gate", "water", "old", "new", "repair", "stone", "bell", "yard", "note"]) + str(r.randrange(400)) for _ in range(n))


def test_history(spark):
    a, b, c = text(1), text(2), text(3)
    edited = a.split()
    for k in range(0, 120, 12):
        edited[k] = f"other{k}"
    half = a.split()[:60] + text(9, 60).split()
    bodies = [a + "\n\n" + b, c, a.upper().replace(" ", "  ") + ".\n\n" + b, b + "\n\n" + a, " ".join(edited) + "\n\n" + b, None, None, "  ", "", " ".join(half), c + " one more", "...", "..."]
    given = {2: "sha256:" + hashlib.sha256(c.encode()).hexdigest().upper(), 6: hashlib.sha256(c.encode()).hexdigest(), 8: history.EMPTY}
    s, ch = sources_and_chunks(spark, bodies, given)
    want = {(3, 1), (4, 1), (5, 1), (6, 2), (11, 2), (13, 12)}
    whole = history.against_history(s, ch)
    assert {(r["id"], r["first"]) for r in whole.collect()} == want
    daily = history.against_history(s, ch, [dt.datetime(2024, 1, d) for d in (4, 9)], most_runs=2)  # with compaction
    assert {(r["id"], r["first"]) for r in daily.collect()} == want


def test_history_of_nothing(spark):
    s, c = sources_and_chunks(spark, ["a b c"])
    assert history.against_history(s.limit(0), c).count() == 0
    assert history.against_history(s, c.limit(0)).count() == 0


def test_history_goes_on_from_saved_state(spark, tmp_path):
    s, c = sources_and_chunks(spark, [text(1), text(2), text(1) + " more"])
    h = history.History(spark, f"file://{tmp_path}/h")
    h.add(history.fingerprints(s.where("id < 3"), c))
    h.save()
    again = history.History.load(spark, f"file://{tmp_path}/h")
    assert [tuple(r) for r in again.add(history.fingerprints(s.where("id = 3"), c)).collect()] == [(3, 1)]


@pytest.mark.parametrize("share,same", [(0.9, True), (0.7, False)])
def test_same_body(share, same):
    a = history.words_of(text(5, 300))
    k = int(300 * share)
    b = np.concatenate([a[k // 2 : k], a[: k // 2], history.words_of(text(6, 300 - k))])  # two blocks that changed places
    assert history.same_body(a, b) is same and history.same_body(b, a) is same


def test_large_family_finds_its_first(spark):
    base = text(4, 200)
    bodies = [base] + [base + f" tail{i}" for i in range(40)]
    s, c = sources_and_chunks(spark, bodies)
    assert {r["first"] for r in history.against_history(s, c, window=2).collect()} == {1}


def test_drifting_family_finds_each_first(spark):
    def body(k):  # each body shares a tenth less with the first; those three steps apart repeat each other no more
        return text(70, 300).split()[: 300 - 30 * k] + [w for j in range(k) for w in text(80 + j, 30).split()]

    steps = [" ".join(body(k)) for k in range(8)]
    bodies = [steps[k] + f" end{k}x{i}" for i in range(5) for k in range(8)]
    s, c = sources_and_chunks(spark, bodies)
    w = [history.words_of(b) for b in bodies]
    want = {}
    for i in range(len(bodies)):
        first = next((j for j in range(i) if history.same_body(w[j], w[i])), None)  # as the operator asks
        if first is not None:
            want[i + 1] = first + 1
    got = {r["id"]: r["first"] for r in history.against_history(s, c, window=4).collect()}
    assert got == want


def test_windows_cross_the_borders_of_ranges(spark):
    rows = [(0, 5, i // 40, 0, i, i % 3 == 0) for i in range(400)] + [(1, 7, 0, 0, i, True) for i in range(0, 400, 50)]
    d = spark.createDataFrame(rows, "key_no int, k0 long, k1 long, k2 long, id long, new boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in history.windows(d.repartition(8), 5, agree=1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(i, j) for i in range(400) for j in range(i + 1, min(400, i + 6)) if i % 3 == 0 or j % 3 == 0}
    own = list(range(0, 400, 50))
    assert got == want | {(own[a], own[b]) for a in range(8) for b in range(a + 1, min(8, a + 6))}


def test_a_batch_opens_few_ranges(spark):
    r = random.Random(1)
    bodies = [text(r.randrange(10**6), 60) for _ in range(240)]
    bodies += [bodies[k] + " again" for k in range(5)]
    s, c = sources_and_chunks(spark, bodies)
    h = history.History(spark, rows_a_range=8, most_ranges=512, measure=True)
    h.add(history.fingerprints(s.where("id <= 120"), c), 120)
    h.add(history.fingerprints(s.where("id > 120 and id <= 240"), c), 120)
    h.rows_read.clear()
    found = h.add(history.fingerprints(s.where("id > 240"), c), 5)
    assert {tuple(x) for x in found.collect()} == {(240 + k, k) for k in range(1, 6)}
    assert h.rows_read["runs"] < 0.6 * 240 * history.KEYS and h.rows_read["names"] < 100 and h.rows_read["classes"] < 200 and h.rows_read["prints"] < 400  # three looks


# 2: variant spellings


def test_automaton_equals_brute_force():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcde") for _ in range(r.randrange(3, 8))) for _ in range(300)})
    trie = names.Trie(words)
    for w in words[:60]:
        assert sorted(trie.near(w, 1)) == sorted((x, d) for x in words if (d := names.distance(w, x, 1)) <= 1)


def test_trie_join_is_complete(spark):
    r = random.Random(5)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(5, 9))) for _ in range(150)}
    got = {tuple(x) for x in names.trie_join(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and names.distance(a, b, 1) == 1}


def test_names(spark):
    rows = [
        "Theodore Numbovifen", "Numbovifen, Ted", "Theo. Numbovifen", "Hana Numbovifen", "NUMBOVIFEN, T. K.", "Dr. Theod0re Numbovifen, PhD", "Numbovifen Theodore", "Theodore Numbovfien",
        "Gumstam Choral Music Cooperative", "The Gumstam Choral Music Coop", "Gumstam CMC", "Cooperative for Choral Music of Gumstam", "Gumstam Choral Music Council", "Gumstam Grain Storage Society",
        "Numbovifen", None, "", "Sampling of the lake: note 3", "steady sluice ratio 2k", "Łucja Øby", "Lucja Oby", "Theodore Other", "Theodore Elsewhere", "Theodore Third", "Hana Other", "Hana Elsewhere", "Hana Third",
    ]
    d = spark.createDataFrame([(i, n, "PERSON", "c") for i, n in enumerate(rows)] + [(0, rows[0], "PERSON", "c")], "id long, name string, type string, cluster string")
    got = {tuple(r) for r in names.linked_pairs(names.link(d)).collect()}
    people, club = [0, 1, 2, 4, 5, 6, 7], [8, 9, 11]
    want = {(a, b) for g in (people, club, [19, 20]) for a in g for b in g if a < b}
    assert {p for p in got if 10 not in p} == want
    assert not {p for p in got if 10 in p}  # CMC fits the cooperative and the council


def test_short_and_unusual_names(spark):
    rows = [
        "Bruce Lee", "Lee, Bruce", "B. Lee", "Kim Wu", "Wu, Kim", "Madonna", "MADONNA", "Bo Li", "Li, Bo", "Ludwig von Mises", "Mises, Ludwig", "Maria del Carmen Garcia Lopez", "Lopez, Maria Carmen Garcia",
        "Jean-Luc van den Berg", "Berg, Jean-Luc van den", "IBM", "IBM", "Tate Museum", "Tate Mus.", "World Health Organization", "World Health Organisation", "Museum of Modern Art", "Museum of Modern Art", "sampling of the lake", "sampling of the lake", "Anna Kim",
    ]
    d = spark.createDataFrame(list(enumerate(rows)), "id long, name string")
    got = {tuple(r) for r in names.linked_pairs(names.link(d)).collect()}
    want = {(0, 1), (0, 2), (1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16), (17, 18), (19, 20), (21, 22)}
    assert got == want


def test_names_of_nothing(spark):
    d = spark.createDataFrame([], "id long, name string")
    assert names.link(d).count() == 0
    assert names.link(spark.createDataFrame([(1, None), (2, "")], "id long, name string")).count() == 0


# 4 and 6: vectors


def blobs(n, groups, seed=0, dim=64):
    r = np.random.default_rng(seed)
    c = r.standard_normal((groups, dim))
    return np.repeat(np.arange(groups), n), (c[np.repeat(np.arange(groups), n)] / 8 + r.standard_normal((n * groups, dim)) * 0.1).astype(np.float32)


BAD = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0] * 63, [None] + [1.0] * 63]


def test_clusters(spark):
    g, x = blobs(80, 4)
    rows = [(i, "home" if k == 0 and i != 3 else f"p{k}", x[i].tolist(), 1) for i, k in enumerate(g.tolist())] + [(1000 + i, "p1", v, 1) for i, v in enumerate(BAD)]
    d = spark.createDataFrame(rows + rows[:2] + [(None, "p", rows[0][2], 1)], "id long, project string, embedding array<float>, cos int")
    out = cluster.cluster(d)
    got = out.collect()
    assert len(got) == 320 and {r["id"] for r in got} == set(range(320))
    assert len({r["g"] for r in got if r["g"] is not None}) == 4
    assert [(r["id"], r["project"]) for r in cluster.misfiled(out).collect()] == [(3, "home")]
    top = cluster.typical(out, 2).collect()
    assert len(top) == 8 and {r["size"] for r in top} == {80}


def test_all_groups_of_a_bucket_are_paired(spark):
    _, x = blobs(12, 60, 3)
    x = x[np.random.default_rng(4).permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sets = cluster.set_of(x, 256, 16)
    keys = cluster.bands_of(sets, 64, 256, 1, 1)[:, 0]
    want, leaders = set(), {}
    for i, (k, s) in enumerate(zip(keys.tolist(), (set(s) for s in sets.tolist()), strict=True)):
        a = next((a for a, o in leaders.setdefault(k, []) if len(s & o) >= 2 * 16 * 0.35 / 1.35), None)
        if a is None:
            leaders[k].append((i, s))
        else:
            want.add((a, i))
    d = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, vec binary")
    assert {tuple(r) for r in cluster.verified_pairs(d, 64, 256, 16, 1, 1, 0.35).collect()} == want
    assert max(len(v) for v in leaders.values()) > 4


def test_all_that_is_similar_in_a_bucket_is_joined():
    r = np.random.default_rng(6)
    key = np.sort(r.integers(0, 3, 900))
    sets = np.zeros((900, 256), bool)
    for s in sets:
        s[r.integers(0, 18) + r.permutation(26)[:16]] = True  # each like those a few places beside it
    bits = np.packbits(sets, axis=1).view(np.int64)
    cols = [np.zeros(900, np.int32), key, r.permutation(900), *(np.ascontiguousarray(bits[:, i]) for i in range(4))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["band", "bucket", "id", "f0", "f1", "f2", "f3"])
    like = (sets.astype(int) @ sets.T.astype(int) >= 11) & (key[:, None] == key)
    similar = {(int(cols[2][i]), int(cols[2][j])) for i, j in zip(*np.nonzero(like), strict=True)}

    def parts(pairs):
        of = list(range(900))
        for a, b in pairs:
            if of[a] != of[b]:
                of = [of[a] if x == of[b] else x for x in of]
        return len(set(of))

    def pairs(**options):
        return [p for b in cluster.led_pairs([batch], 11, rows=64, leaders=50, **options) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]

    led, every = pairs(), pairs(whole=True)
    assert set(every) <= similar and set(led) <= set(every) and len(every) < 2 * 900
    assert parts(every) == parts(similar) < parts(led)


def test_groups_past_the_leaders_are_found(spark):
    r = np.random.default_rng(5)
    g = np.repeat(np.arange(11), 20)
    x = (r.standard_normal((11, 64))[g] / 8 + r.standard_normal((220, 64)) * 0.03).astype(np.float32)
    d = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id long, vec binary")
    centre = np.stack([x[g == k].mean(axis=0) for k in range(11)])
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    loose = cluster.group_means(d, tight=1.1, leaders=1)  # no component is tight; a medoid a round
    small = cluster.group_means(d, least=100, leaders=2, passes=0)  # all components are small
    for means in (loose, small):
        assert len(means) == 11 and ((centre @ means.T).max(axis=1) > 0.95).all()


def test_clusters_of_little(spark):
    d = spark.createDataFrame([(1, "p", [1.0] * 64)], "id long, project string, embedding array<float>")
    assert [r["g"] for r in cluster.cluster(d).collect()] == [None]
    assert cluster.cluster(d.limit(0)).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 7)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_hilbert_curve_is_one():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    at = grid[np.argsort(vectors.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(at, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours in the grid


def test_nearest_vectors(spark):
    _, x = blobs(150, 3, 1)
    x[10], x[11] = x[9], x[9] * 7  # copies, one of another length
    rows = [(i, "t", v.tolist(), 0.0) for i, v in enumerate(x)] + [(900 + i, "t", v, 0.0) for i, v in enumerate(BAD)]
    d = spark.createDataFrame(rows + rows[:3], "id long, kind string, embedding array<float>, cos double")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {i: set(np.argsort(-s[i])[:10].tolist()) for i in range(len(x))}
    got: dict[int, set] = {}
    for r in vectors.knn(d, "id", "embedding", "kind", k=10, curves=8, block=64, span=2).collect():
        got.setdefault(r["id_a"], set()).add(r["id_b"])
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * 10 * len(want)
    assert {tuple(r)[1:] for r in vectors.mutual(vectors.knn(d, "id", "embedding", "kind", floor=0.999)).collect()} == {(9, 10), (9, 11), (10, 11)}


def test_many_copies_of_one_vector(spark):
    d = spark.createDataFrame([(i, "t", [1.0] * 64) for i in range(40)], "id long, kind string, embedding array<float>")
    pairs = {tuple(r)[1:] for r in vectors.mutual(vectors.knn(d, "id", "embedding", "kind", floor=0.9)).collect()}
    # each row's ten nearest are the smallest other ids; only 0 to 10 name each other
    assert pairs == {(a, b) for a in range(11) for b in range(a + 1, 11) if not (a == 10 or b == 10) or b == 10 and a < 10}
    assert vectors.knn(d.limit(0), "id", "embedding", "kind").count() == 0


def test_every_copy_has_its_neighbours(spark):
    rows = [(i, "t", [1.0] * 64) for i in range(40)] + [(50, "t", [1.0] * 63 + [2.0]), (3, "other", [1.0] * 64)]
    d = spark.createDataFrame(rows + rows[:20], "id long, kind string, embedding array<float>")
    want = {i: [j for j in range(11) if j != i][:10] for i in range(40)} | {50: list(range(10))}
    for every in (None, 5):
        got: dict[int, list] = {}
        for r in vectors.knn(d, "id", "embedding", "kind", query_every=every).where("space = 't'").orderBy("id_a", "rank").collect():
            got.setdefault(r["id_a"], []).append(r["id_b"])
        assert got == {i: w for i, w in want.items() if not every or i % every == 0}


# 5: boilerplate


def test_furniture(spark):
    rows = []
    for site in ("alpha-post.example", "beta-news.example"):
        for k in range(30):
            body = f"The {'gate lock weir pond bell'.split()[k % 5]}{k} of the town was repaired in {1900 + k} because the water had risen over the old stone wall."
            t = f"News | Archive | Contact\nStory {site[:4]} number {'abcdefghij'[k % 10]}{k}\nBy Ann O{chr(97 + k % 26)}{chr(97 + k // 26)}ther\n\n{body}\n{body.replace('repaired', 'rebuilt')}\nMost read\n> What Jo{k} learned from a weir{k}\n> Why the pond{k} matters in Town{k}\nBack to top\nCopyright {2000 + k % 3} {site.split('.')[0].replace('-', ' ').title()}"
            rows.append((len(rows), f"https://www.{site}/a/s{k}", f"Story {site[:4]} number {'abcdefghij'[k % 10]}{k}", t, "clash"))
    rows += [(500, None, None, None, "x"), (501, None, None, "", "x"), (502, "https://alpha-post.example/z", None, "News | Archive | Contact\nBack to top", "x")]
    d = spark.createDataFrame(rows + rows[:1], "row_id long, source_url string, source_title string, text string, host string")
    got = {}
    for r in boilerplate.furniture(d).collect():
        got.setdefault(r["row_id"], []).append(r["line_no"])
    assert all(sorted(got[i]) == [1, 7, 8, 9, 10, 11] for i in range(60)) and sorted(got[502]) == [1, 2] and 500 not in got and 501 not in got
    main = {r["row_id"]: r["text"] for r in boilerplate.main_text(d).collect()}
    assert main[0].startswith("Story alph") and "Most read" not in main[0] and main[502] is None
    assert boilerplate.furniture(d.limit(0)).count() == 0


def test_long_notices_are_furniture(spark):
    notice = "We and our partners store cookies on your device to personalise advertising, measure audiences and develop services; by continuing you consent to this processing, which you may withdraw whenever you like under privacy settings, where every vendor, purpose, retention period and legitimate interest is listed."
    assert len(notice) >= 300
    rows = []
    for k in range(30):
        word = "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(6))
        body = f"The {word} lock of the town was repaired because the water had risen over the old {word} wall. " * 4
        named = f"Alpha Post {notice}" if k % 2 else notice
        rows.append((k, f"https://alpha-post.example/a/s{k}", f"Story {word}", f"Story {word}\n{body.strip()}\nThe water at the {word} wall has risen over the town lock before, and was repaired.\n{named}"))
    d = spark.createDataFrame(rows, "row_id long, source_url string, source_title string, text string")
    assert {tuple(r) for r in boilerplate.furniture(d).collect()} == {(k, 4) for k in range(30)}


# 7: splitting


@pytest.mark.parametrize("t", ["x" * 7000, "a " * 1200, ("w" * 30 + " ") * 300, "\n\n".join("word " * 60 for _ in range(20)), "x" * 3000 + " " + "y " * 900, " " * 10 + "z" * 2001, "。".join("长" * 90 for _ in range(60))])
def test_pieces(t):
    p = split.cut(t)
    assert len(p) > 1
    seen = set()
    for a, b in p:
        assert b - a <= 2000 and len(t[a:b].split()) <= 350 and t[a:b] == t[a:b].strip()
        seen.update(range(a, b))
    assert all(i in seen or t[i].isspace() for i in range(len(t)))
    assert all(0 <= b - a2 <= 200 or a2 >= b for (_, b), (a2, _) in zip(p, p[1:], strict=False))


def test_valleys_decide():
    one, two = "the lock gate of the canal was repaired. " * 18, "bread dough rises in the warm oven. " * 20
    (_, end), *_ = split.cut(one + two, max_chars=1000, overlap=0)
    assert (one + two)[:end].rstrip() == one.rstrip()


def test_limits_and_numbers(spark):
    rows = [(1, 9, 0, "x" * 2000), (2, 9, 1, " " + "y" * 2001 + " "), (3, 9, 2, "a " * 350), (4, 9, 3, "a " * 351), (5, 9, 4, None), (6, 9, None, "z"), (2, 9, 1, " " + "y" * 2001 + " ")]
    d = spark.createDataFrame(rows, "id long, source_id long, chunk_index int, content string").withColumn("piece", F.lit(1))
    got = split.rechunk(d).collect()
    assert {r["chunk_id"] for r in got} == {2, 4}
    assert sorted((r["chunk_id"], r["new_index"]) for r in got) == [(2, 1), (2, 2), (4, 4), (4, 5)]
    assert split.split_oversized(d.limit(0)).count() == 0


# 8 and 9: tokens and containers


@pytest.mark.skipif(not HAVE, reason="no tokenizer files")
def test_encoding_by_windows_equals_whole(spark):
    r = random.Random(2)
    parts = ["word", " ", "  ", "\n", "don't", "42", "é漢字", "…", "<|endoftext|>", " ", "\t", "x" * 30, "'s", "!!"]
    texts = [None, "", "   ", *("".join(r.choice(parts) for _ in range(n)) for n in (5, 60, 400, 900)), "q" * 3000, " " * 3000, "漢" * 1500]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    enc = encode.encoder(encode.TOKENIZER)
    want = {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    for window, overlap in ((65_536, 512), (200, 40), (64, 16)):
        assert {x["doc_id"]: list(x["ids"]) for x in encode.encode(d, window=window, overlap=overlap).collect()} == want
    back = {x["doc_id"]: x["text"] for x in encode.decode(encode.encode(d)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert encode.encode(d.limit(0)).count() == 0
    assert base64.b64decode("aGk=") == b"hi"


def check_plan(counts, capacity):
    p = pack.plan(counts, capacity)
    used: Counter = Counter()
    for sizes, n in p:
        assert sum(sizes) <= capacity and n > 0
        for s in sizes:
            used[s] += n
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(n for _, n in p)


def test_plans():
    r = random.Random(1)
    for _ in range(200):
        c = Counter(r.randint(1, 50) for _ in range(r.randint(0, 60)))
        total = sum(k * v for k, v in c.items())
        assert check_plan(c, 50) <= max(1, total / 50 * 1.35 + 1) or not total
    assert check_plan(Counter({60: 10, 40: 10}), 100) == 10 and check_plan(Counter({50: 7}), 100) == 4


def test_packing(spark):
    sizes = [0, None, 1, 100, 100, 250, 99, 51, 49, 30, 30, 30, -3] + [10] * 40
    d = spark.createDataFrame([(i, s, 5) for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container int")
    got = pack.pack(d, capacity=100).collect()
    by = Counter()
    for r in got:
        if r["container"] is not None:
            by[r["container"]] += r["size"]
    assert max(by.values()) <= 100 and sum(by.values()) == sum(s for s in sizes if s and s > 0)
    assert sorted(r["part"] for r in got if r["doc_id"] == 5) == [0, 1, 2]
    assert {r["doc_id"] for r in got if r["container"] is None} == {0, 1, 12} and {r["doc_id"] for r in got} == set(range(len(sizes)))
    assert pack.pack(d.limit(0), capacity=100).count() == 0


# 10: reading level


def test_syllables():
    want = {"the": 1, "make": 1, "table": 2, "wanted": 2, "walked": 1, "idea": 3, "creation": 3, "heterogeneous": 6, "I": 1, "rhythm": 1}
    assert {w: reading.syllables(w) for w in want if abs(reading.syllables(w) - want[w]) > 1} == {}


def test_levels(spark):
    easy, hard = "The cat sat on the mat. We ran to the big red barn. ", "Institutional parameterisation necessitates methodological commensurability, notwithstanding heterogeneous interdependence. "
    docs = [(i, easy * 8 if i % 2 else hard * 8, "en", "x") for i in range(60)] + [(100, None, "en", "x"), (101, "short text", "en", "x"), (102, "1 " * 50, "en", "x"), (103, easy * 3000, "en", "x")]
    d = spark.createDataFrame(docs + docs[:1], "doc_id long, text string, lang string, band string")
    labels = spark.createDataFrame([(i, f"r{k}", 3 + k % 2 if i % 2 else 14 + k % 2, dt.datetime(2024, 1, 1)) for i in range(40) for k in range(2)] + [(0, "r9", None, dt.datetime(2024, 1, 1)), (1, "r9", 99, dt.datetime(2024, 1, 1))], "doc_id long, rater string, grade int, rated_ts timestamp_ntz")
    got = {r["doc_id"]: r["band"] for r in reading.levels(d, reading.fit(d, labels)).collect()}
    assert all(got[i] == ("easy" if i % 2 else "hard") for i in range(60)) and set(got) == {*range(60), 102, 103} and got[102] == "easy" and got[103] == "easy"
    assert reading.fit(d, labels.limit(0)) == {} and reading.levels(d.limit(0), {}).count() == 0
    assert reading.levels(d, {}).count() == 63


def test_monotone_rises():
    r = np.random.default_rng(0)
    x = r.random(500)
    gx, gy = reading.monotone(x, 5 * x + r.standard_normal(500))
    assert all(a <= b for a, b in zip(gy, gy[1:], strict=False)) and all(a <= b for a, b in zip(gx, gx[1:], strict=False))
