"""Hand-computed cases of the core operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnwell.config import RetrievalConfig, load_config
from tarnwell.functions.text import cosine, slug
from tarnwell.operators import chunking, citations, evaluate, fulltext, fusion, governance, graph, research, routing, vector
from tarnwell.sources import extract, sinks
from tarnwell.streaming import transcripts


def test_config_is_tolerant():
    c = load_config('{"$note": 1, "limit": 5, "rrf_weights": {"bm25": 1}, "other": 2}')
    assert c.limit == 5 and c.rrf_weights == {"bm25": 1.0, "vector": 0.4, "graph": 0.35} and c.overfetch == 40
    assert load_config("{broken") == RetrievalConfig() == load_config(None) == load_config('{"limit": "x"}')
    assert len(RetrievalConfig().ablations()) == 7


def test_chunk_sizes():
    assert chunking.index_chunks("x" * 99) == [] and len(chunking.index_chunks("x" * 100)) == 1
    assert [len(c) for c in chunking.index_chunks("x" * 2000)] == [2000]
    assert [len(c) for c in chunking.index_chunks("x" * 5000)] == [2000, 2000, 1000]
    # 499 + 2 + 501 are within the target by the first part's accounting, 1 more isn't
    assert len(chunking.index_chunks("a" * 499 + "\n\n" + "b" * 499)) == 1
    assert len(chunking.index_chunks("a" * 499 + "\n\n" + "b" * 500)) == 2
    text = "Word one two. " * 400
    assert all(100 <= len(c) <= 2000 for c in chunking.index_chunks(text))
    assert chunking.cap("aaaa. bbbb, cc dd", 12)[0] == "aaaa. bbbb,"


def test_fenced_code_never_splits():
    t = "one\n\n```\na\n\nb\n```\n\ntwo"
    assert chunking.paragraphs(t) == ["one", "```\na\n\nb\n```", "two"]
    assert chunking.research_chunks("p" * 2000 + "\n\nq", 500) == ["p" * 2000, "q"]


def test_decompose():
    assert chunking.decompose("Why is it so? How was it made then?") == ["Why is it so?", "How was it made then?"]
    assert chunking.decompose("Too short. No.") == ["Too short. No."]
    long = "explain how the lock gate was repaired in winter and describe who paid for all of the timber"
    assert len(chunking.decompose(long)) == 2


def test_cosine_and_codec(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0]), (2, [1.0, 0.0], [2.0, 0.0]), (3, [1.0, 0.0], [1.0])], "id long, a array<double>, b array<double>")
    assert [r[0] for r in d.orderBy("id").select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]
    v = spark.createDataFrame([(1, [0.5, 1.5]), (2, None)], "id long, v array<float>")
    assert vector.from_blob(vector.to_blob(v, "v", 2), "v", 2).orderBy("id").collect() == v.orderBy("id").collect()
    with pytest.raises(Exception, match="vector of 2 parts"):
        vector.to_blob(v, "v", 3).collect()


def test_moving_centroid_is_the_fold(spark):
    rows = [(1, i, [float(i), 1.0]) for i in range(1, 6)]
    got = vector.moving_centroids(spark.createDataFrame(rows, "g int, i int, v array<double>"), "g", "i", "v", 0.1, 2).first()["centroid"]
    c = 1.0
    for i in range(2, 6):
        c = 0.9 * c + 0.1 * i
    assert got[0] == pytest.approx(c) and got[1] == pytest.approx(1.0)


def test_softmax_and_margin(spark):
    d = spark.createDataFrame([(1, "a", 0.70), (1, "b", 0.55), (2, "a", 0.69), (3, "a", 0.9)], "id int, label string, p double")
    g = {r["id"]: r["passes"] for r in routing.gate(d, "id", "label", "p").collect()}
    assert g == {1: True, 2: False, 3: False}  # equality passes; a single label never does
    s = vector.softmax(d, "id", "p", "q").groupBy("id").agg(F.round(F.sum("q"), 9)).collect()
    assert {x[1] for x in s} == {1.0}


def test_porter_words():
    want = {"caresses": "caress", "ponies": "poni", "running": "run", "hopping": "hop", "relational": "relat", "conditional": "condit", "happy": "happi", "sky": "sky", "agreed": "agre", "probate": "probat", "controlling": "control", "generalizations": "gener"}
    assert {w: fulltext.porter(w) for w in want} == want
    assert fulltext.fold("Élan runs") == "elan run"


def test_phrase_needs_order(spark):
    d = spark.createDataFrame([(1, "a b c a b"), (2, "b a"), (3, None), (4, "A, B!")], "id long, t string")
    assert {r["id"]: r["tf"] for r in fulltext.phrase_tf(d, "id", "t", "a b").collect()} == {1: 2, 4: 1}


def test_rrf(spark):
    mk = lambda ids: spark.createDataFrame([(i, r) for r, i in enumerate(ids, 1)], "id long, rank int")
    got = {r["id"]: r["rrf_score"] for r in fusion.rrf([mk([1, 2]), mk([2, 3]), mk([])], [0.4, 0.6, 0.35], "id").collect()}
    assert got[2] == pytest.approx(0.4 / 62 + 0.6 / 61) and got[1] == pytest.approx(0.4 / 61) and set(got) == {1, 2, 3}
    with pytest.raises(ValueError, match="weights"):
        fusion.rrf([mk([1])], [1.0, 2.0], "id")
    one = spark.createDataFrame([("a", 2 / 61), ("b", 0.0221)], "q string, s double")
    assert {r["q"]: r["skip"] for r in fusion.skips(one, "q", "s").collect()} == {"a": True, "b": False}
    assert [r["id"] for r in fusion.first_list([mk([]), mk([7, 8])], "id").orderBy("rank").collect()] == [7, 8]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 10, 1), ("q", 11, 2), ("q", 12, 3)], "query_id string, item long, rank int")
    expected = spark.createDataFrame([("q", 11), ("q", 11), ("q", 99), ("r", 1)], "query_id string, item long")
    m = {r["query_id"]: r for r in evaluate.metrics(ranked, expected).collect()}
    assert m["q"]["mrr"] == 0.5 and m["q"]["recall"] == 0.5 and m["r"]["ndcg"] == 0.0
    assert m["q"]["ndcg"] == pytest.approx((1 / 1.5849625) / (1 + 1 / 1.5849625), rel=1e-6)
    runs = spark.createDataFrame([(1, 0.50), (2, 0.45), (3, 0.41)], "run int, m double")
    assert [r["run"] for r in evaluate.drops(runs, "run", ["m"], 0.0499).collect()] == [2]


def test_graph_first_writer_wins(spark):
    old = spark.createDataFrame([("a", "Old")], "k string, name string").withColumn("at", F.lit(0))
    new = spark.createDataFrame([("a", "New", 1), ("b", "First", 2), ("b", "Second", 3)], "k string, name string, at int")
    assert sorted(r["name"] for r in graph.upsert_first(old, new, ["k"], "at").collect()) == ["First", "Old"]


def test_research_records(spark):
    t = "x" * 200
    rows = [({"id": "s1_c1", "section": "s1", "url": "u", "title": "t", "extract": t},), ({"chunk_id": "", "id": "s1_c2", "section_id": "s1", "url": "u", "title": "t", "text": t[:199]},), ({"id": "z"},)]
    got = [r["reason"] for r in research.normalise(spark.createDataFrame(rows, "r map<string,string>")).collect()]
    assert got == [None, "short text", "missing section_id,source_url,source_title,text"]
    d = spark.createDataFrame([("f", "s1", "s1_c1", 1), ("f", "s1", "s1_c1", 2), ("f", "s2", "sX_c9", 3), ("g", "s1", "odd", 4)], "f string, section_id string, chunk_id string, i int")
    assert [r["chunk_id"] for r in research.renumber(d, "f", ["i"]).orderBy("i").collect()] == ["s1_c1", "s1_c2", "s2_c1", "odd"]
    o = spark.createDataFrame([("s10", "s10_c1"), ("s2", "s2_cfoo"), ("s2", "s2_c3"), ("sX", "y")], "s string, c string")
    assert [r["c"] for r in o.orderBy(*research.reading_order(F.col("s"), F.col("c"))).collect()] == ["s2_c3", "s2_cfoo", "s10_c1", "y"]


def test_section_response(spark):
    good = "Here it is.\n---BEGIN_SECTION---\n\nBody [s3_c1].\n\n---END_SECTION---\n---BEGIN_SUMMARY---\nSum.\n---END_SUMMARY---\n---METADATA---\nWord_Count: 3\ndistinct_chunks_cited: one\nchunk_ids_cited: s3_c1, , s3_c2\nnote: kept: so\nno line\nnote: last\n---END_METADATA---\n"
    rows = [(1, good, "s3"), (2, good.replace("---END_SUMMARY---", ""), "s3"), (3, good, "three"), (4, " \n", "s3"), (5, good.replace("Body [s3_c1].", ""), " s3 "), (6, good.replace("Sum.", " "), "s3"), (7, None, "s3")]
    got = research.parse_response(spark.createDataFrame(rows, "i int, t string, sid string"), "t", F.col("sid")).orderBy("i").collect()
    assert [r["problem"] for r in got] == [None, "missing summary", "section id", "empty response", "empty section", "empty summary", "empty response"]
    r = got[0]
    assert r["body"] == "Body [s3_c1]." and r["summary"] == "Sum." and r["word_count"] == 3 and r["distinct_chunks_cited"] is None and r["chunk_ids_cited"] == ["s3_c1", "s3_c2"]
    assert r["metadata"] == {"word_count": "3", "distinct_chunks_cited": "one", "chunk_ids_cited": "s3_c1, , s3_c2", "note": "last"}


def test_front_matter(spark):
    d = spark.createDataFrame([('---\ntopic: "A: b"\ncost: null\ntopic: again\n---\nx',), ("no front",), (None,)], "t string")
    assert [r[0] for r in d.select(research.front_matter(F.col("t"))).collect()] == [{"topic": "A: b", "cost": "null"}, None, None]


def test_stitched_documents_keep_the_contract(spark):
    sections = spark.createDataFrame([("r", i, t, b) for i, (t, b) in enumerate([("Context", "word " * 3100 + "[s1_c1]"), ("One", "x [s2_c1]"), ("Two", " y "), ("Gaps & Caveats", "z"), ("Lost", None)])], "run string, ord int, title string, body string")
    chunks = spark.createDataFrame([("r", "s1_c1", "s1", "https://a.example", "A | b", "2025-01-02T03:04:05Z"), ("r", "s2_c1", "s2", "https://a.example", None, None)], "run string, chunk_id string, section_id string, source_url string, source_title string, fetched_at string")
    cited = spark.createDataFrame([("r", "s1_c1"), ("r", "s2_c1")], "run string, chunk_id string")
    n = spark.createDataFrame([("r", "judge", "PARTIAL", 2), ("r", "judge", "SUPPORTED", 5), ("r", "fuzzy", "PASS", 9), ("r", "other", "X", 1)], "run string, stage string, verdict string, n int")
    d = research.stitch(sections, research.sources_table(chunks, cited, "run"), "run", F.lit("Locks"), "2025-02-01", counters=n)
    v = research.validate(d, "run", "document").first()
    assert v["errors"] == [] and v["warnings"] == []
    t = d.first()["document"]
    assert t.startswith('---\ntopic: "Locks"\ndate: "2025-02-01"\nresearch_tool: "in-session"\ncost: null\nsources_count: 1\n---\n\n## Context\n\n') and "Lost" not in t
    assert "| s1_c1 | https://a.example | A \\| b | 2025-01-02 |\n" in t and t.endswith("### Fuzzy\n  - PASS: 9\n\n### Judge\n  - SUPPORTED: 5\n  - PARTIAL: 2\n")


def test_merge_of_searchers(spark):
    t = "x" * 250
    rec = lambda c, s, **k: {"chunk_id": c, "section_id": s, "source_url": "u", "source_title": "t", "text": t} | k
    rows = [("r", 1, rec("s1_c1", "s1")), ("r", 2, rec("s1_c1", "s1")), ("r", 3, rec("s10_c1", "s10", date="d")), ("r", 4, rec("s2_c1", "s2", text="short")), ("q", 5, rec("s2_c7", "s2"))]
    plan = spark.createDataFrame([(r, i, f"s{n}") for r in "qr" for i, n in enumerate((1, 2, 10))], "run string, ord int, section_id string")
    c, p, bad = research.merge(spark.createDataFrame(rows, "run string, at int, r map<string,string>"), plan, "run", ["at"])
    assert [(r["run"], r["chunk_id"], r["place"], r["fetched_at"]) for r in c.orderBy("at").collect()] == [("r", "s1_c1", 1, "2026-01-01T00:00:00Z"), ("r", "s1_c2", 2, "2026-01-01T00:00:00Z"), ("r", "s10_c1", 3, "d"), ("q", "s2_c7", 1, "2026-01-01T00:00:00Z")]
    assert {r["run"]: (r["framing"], r["with_chunks"], r["total"]) for r in p.collect()} == {"r": (["s2"], ["s1", "s10"], 3), "q": (["s1", "s10"], ["s2"], 1)}
    assert [r["reason"] for r in bad.collect()] == ["short text"]


def test_contract(spark):
    head = "---\ntopic: t\ndate: d\nresearch_tool: r\ncost: null\nsources_count: 1\n---\n"
    body = "## Context\n" + "word " * 3000 + "[s1_c1]\n## A\nx\n## B\ny\n## Gaps & Caveats\nz\n## Sources\n| s1_c1 | https://e.example | T | 2025-01-01 |\n"
    docs = [(1, head + body), (2, body), (3, head + body.replace("[s1_c1]", "[s1_c2]")), (4, head.replace("sources_count: 1", "sources_count: one") + "text")]
    v = {r["k"]: r for r in research.validate(spark.createDataFrame(docs, "k int, t string"), "k", "t").collect()}
    assert v[1]["errors"] == [] and v[1]["warnings"] == []
    assert v[2]["errors"] == ["front matter missing"]
    assert v[3]["errors"] == ["citations without source"] and v[3]["warnings"] == ["unused sources"]
    assert {"sources_count no integer", "no sections", "too short"} <= set(v[4]["errors"])


def test_citations(spark):
    t = "First one. Second claim here [s1_c2, s3_c4]\n\n# Third [s1_c1]"
    got = citations.citations(spark.createDataFrame([(1, t), (2, None)], "k int, t string"), "k", "t").orderBy("position", "chunk_id").collect()
    assert [(r["chunk_id"], r["claim"]) for r in got] == [("s1_c2", "Second claim here [s1_c2, s3_c4]"), ("s3_c4", "Second claim here [s1_c2, s3_c4]"), ("s1_c1", "Third [s1_c1]")]
    assert citations.partial_ratio("lock gate", "the old lock gate was new") == 100.0 and citations.partial_ratio("", "") == 100.0
    c = spark.createDataFrame([("f", "a", "the lock gate", 0), ("f", "b", "zzz", 1), ("f", "none", "x", 2)], "f string, chunk_id string, claim string, position int")
    ch = spark.createDataFrame([("f", "a", "here the lock gate is"), ("f", "b", "qqqqqqq"), ("f", "d", "zzz there")], "f string, chunk_id string, text string")
    v = citations.verdicts(c, ch, "f")
    assert {r["chunk_id"]: r["verdict"] for r in v.collect()} == {"a": "PASS", "b": "FAIL", "none": "MISSING_CHUNK"}
    assert {r["chunk_id"]: r["other"] for r in citations.substitutes(v, ch, "f").collect()}["b"] == "d"
    r = citations.report(v, "f").first()
    assert (r["total"], r["needs_judge"], r["needs_substitution"], r["clean"]) == (3, 1, 2, False)


def test_redaction(spark):
    assert [governance.pattern_problem(p) for p in ("", "a/../b", "/x", "C:\\x", "a/.git/b", "a/*.md")] == ["pattern_empty", "pattern_traversal", "pattern_traversal", "pattern_traversal", "pattern_internal", None]
    d = spark.createDataFrame([("a/x.md",), ("a/b/y.md",), ("c.md",), (".obsidian/z.md",), ("ab/x.md",), (None,)], "path string")
    n = lambda p: governance.matched(d, "path", p).count()
    assert [n("a/*.md"), n("a/**"), n("?.md"), n("a"), n("a/"), n("a/b/y.md"), n("a/b"), n("**/z.md"), n("x")] == [1, 2, 1, 2, 2, 1, 1, 0, 0]
    commits = spark.createDataFrame([("c1", "a/x.md"), ("c2", "a/x.md"), ("c2", "c.md")], "commit string, path string")
    assert governance.preview(d, "path", "a", commits=commits).first().asDict() == {"pattern": "a", "files": 2, "escalate": True, "commits": 2}
    kept, stones = governance.redact(d, "path", "a/**", "now")
    assert kept.count() == 6 and stones.count() == 2
    assert governance.redact(d, "path", "a/**", "now", dry_run=False)[0].count() == 4


def test_audit(spark):
    rows = [("Bash", "git status"), ("Bash", "git push"), ("Bash", "ls; rm"), ("Bash", "uv run x"), ("Bash", "ls"), ("Read", None), ("Bash", " "), ("Bash", "git show HEAD:x"), ("Bash", "GIT Diff"), ("Bash", "git commit -m x"), ("Bash", "git commit x"), ("Bash", "echo $(x)"), ("bash", "python a/Scripts/x.py")]
    d = spark.createDataFrame(rows, "tool string, cmd string").withColumn("v", governance.audit(F.col("tool"), F.col("cmd"), F.lit(None).cast("string"), "vault"))
    assert [r["v"] for r in d.collect()] == ["allow", "unsafe_git", "compound_command", "allow", "unauthorized_shell", "allow", "allow", "allow", "allow", "allow", "unsafe_git", "compound_command", "allow"]
    paths = [("papers/x.md", "allow"), ("papers/../x.md", "path_boundary_violation"), ("a/../papers/x", "allow"), ("Papers\\y.md", "allow"), ("papersx/y", "path_boundary_violation"), ("/papers/./z", "allow"), (None, "allow"), ("../papers/x", "allow")]
    d = spark.createDataFrame(paths, "path string, want string").withColumn("v", governance.audit(F.lit("Write"), F.lit(None).cast("string"), F.col("path"), "papers"))
    assert [r["v"] for r in d.collect()] == [w for _, w in paths]


def test_pages_and_labels(spark):
    d = spark.createDataFrame([("P", "article", "T: x", "body", None, ["a", "b"]), ("P", "blog", "T", "b", "", []), ("P", "article", " ", "b", "", []), ("P", "journal", "Day?", "  # Own\nx", "https://e.example", None)], "project string, source_type string, title string, body string, source string, tags array<string>")
    good, bad = sinks.pages(d)
    assert [r["reason"] for r in bad.collect()] == ["unknown source_type blog", "missing title"]
    got = {r["file_name"]: r["value"] for r in good.collect()}
    assert got["T x.md"] == '---\ncreated: 2025-01-01\nsource_title: "T: x"\nsource_type: article\ntags: [a, b]\n---\n\n# T: x\n\nbody'
    assert got["Day.md"] == '---\ncreated: 2025-01-01\nsource: "https://e.example"\nsource_title: Day?\nsource_type: journal\ntags: []\n---\n\n# Own\nx'
    labels = spark.createDataFrame([("a" * 19,), ("a" * 20,), ("TODO " + "a" * 30,), (None,), ("a" * 301,)], "l string")
    assert [r[0] for r in labels.select(sinks.label_problem(F.col("l"))).collect()] == ["too short", None, "placeholder", "empty", "too long"]


def test_rebuild(spark, tmp_path):
    long = "The lock gate was repaired in winter because the water had risen over the old stone wall of the yard. "
    docs = spark.createDataFrame([(1, "p", long * 3), (2, "q", None)], "source_id long, project string, text string")
    projects = spark.createDataFrame([("p",)], "slug string")
    n = sinks.rebuild(docs, projects, f"file://{tmp_path}/x", "v1", "lock gate")
    assert n["chunks"] == 1 and n["projects"] == 1 and sinks.current(spark, f"file://{tmp_path}/x/projects").count() == 1
    with pytest.raises(ValueError, match="doesn't answer"):
        sinks.rebuild(docs.limit(0), projects, f"file://{tmp_path}/x", "v2", "lock gate")
    assert spark.read.text(f"file://{tmp_path}/x/current").first()[0] == "v1"


def test_publish_keeps_the_last_good_version(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.publish(spark.range(3), root, "v1")
    with pytest.raises(ValueError, match="empty"):
        sinks.publish(spark.range(0), root, "v2")
    assert sinks.current(spark, root).count() == 3


def test_html():
    t = extract.html_text("<head><title>x</title></head><p>a<br>b</p><script>if (1) '</p>'</script><div>c &amp; d</div><ul><li>e</li></ul>")
    assert t == "a" "b\nc & d\ne"


def test_files_and_searchers(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.html").write_text("<p>x</p><p>y</p>")
    (tmp_path / "index.md").write_text("meta")
    got = {r["name"]: r["text"] for r in extract.read_files(spark, str(tmp_path), meta=["index"]).collect()}
    assert got == {"a.md": "hello", "b.html": "x\ny"}
    s = tmp_path / "s"
    s.mkdir()
    (s / "searcher_1.json").write_text('{"chunks": [{"id": 1}, {"id": 2}]}')
    (s / "searcher_2.json").write_text('[{"id": 3}]')
    assert extract.read_searchers(spark, f"{s}/searcher_*.json").count() == 3
    (s / "searcher_3.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="neither a list"):
        extract.read_searchers(spark, f"{s}/searcher_*.json").collect()


def test_transcripts(spark):
    lines = [("s", 1, '{"role": "user", "content": "hi"}'), ("s", 2, "{bad"), ("s", 3, '{"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "b"}]}}')]
    m = transcripts.messages(spark.createDataFrame(lines, "session string, line_no int, value string"))
    assert {r["role"]: r["text"] for r in transcripts.last_turns(m).collect()} == {"user": "hi", "assistant": "a\nb"}
    d = spark.createDataFrame([(1, "We decided on *oak* beams. I'll use no"), (2, None)], "k int, t string")
    assert {r["decision"] for r in transcripts.decisions(d, "k", "t").collect()} == {"oak beams"}


def test_project_name(spark):
    rows = [("<title>The Unreasonable Effectiveness of Recurrent Neural Networks</title>",), ("# Notes on the RNN",), ("Grey Heron saw Blue Boat",), ("nothing here",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(routing.project_name(F.col("t"), "20250101")).collect()]
    assert got == ["Recurrent Neural Networks", "Notes RNN", "Grey Heron Blue", "Untitled Project 20250101"]


def test_links_and_orphans(spark):
    d = spark.createDataFrame([("A", "see [[B|alias]] and [[C#h]]"), ("B", "[[A]]"), ("D", ""), ("index", "[[D]]")], "n string, t string").withColumn("at", F.to_timestamp_ntz(F.lit("2024-12-30")))
    assert {tuple(r) for r in governance.links(d, "n", "t").collect()} == {("A", "B"), ("A", "C"), ("B", "A"), ("index", "D")}
    assert governance.orphans(d.where("n != 'index'"), "n", "t", "at", F.to_timestamp_ntz(F.lit("2025-01-01"))).collect()[0].asDict() == {"n": "D", "soft": True}


def test_slug(spark):
    d = spark.createDataFrame([("Hello, World!",), ("--",), (None,), ("a" * 49 + " b",)], "t string")
    assert [r[0] for r in d.select(slug(F.col("t"))).collect()] == ["hello-world", "project", "project", "a" * 49]


def test_routing_decisions(spark):
    unit = lambda i, j=None, b=0.0: [1.0 if k == i else b if k == j else 0.0 for k in range(4)]
    docs = spark.createDataFrame([(1, unit(0)), (2, unit(1)), (3, unit(0, 1, 0.6)), (4, None)], "id long, v array<double>")
    proj = lambda rows: spark.createDataFrame(rows, "slug string, centroid_embedding array<double>, archived int")
    run = lambda p, **k: {r["id"]: (r["decision"], r["reason"], r["slug"]) for r in routing.decide(docs, "id", "v", p, dim=4, **k).collect()}
    assert set(run(proj([])).values()) == {("create", "first", None)} == set(run(proj([("x", unit(0), 1)])).values())
    assert set(run(proj([("a", None, 0)])).values()) == {("create", "cosine", None)}
    one = run(proj([("a", unit(0), 0)]))
    assert one[1] == ("file", "cosine", "a") and one[2] == ("create", "cosine_cold_start", None) and one[3] == ("file", "cosine", "a") and one[4] == ("create", "cosine", None)
    labels = spark.createDataFrame([(2, "a", 0.9), (2, "b", 0.3), (1, "a", 0.9), (1, "b", 0.8)], "id long, label string, p double")
    two = proj([("a", unit(0), 0), ("b", unit(2), 0)])
    got = run(two, labels=labels)
    assert got[2] == ("file", "zsc", "a") and got[1] == ("file", "cosine", "a") and got[4] == ("create", "cosine", None)
    assert run(two, labels=labels.where("label = 'a'"))[2] == ("create", "cosine", None)
    full = two.withColumn("source_count", F.lit(2)).withColumn("last_activity_ts", F.lit(None).cast("int"))
    at = docs.withColumn("at", F.col("id").cast("int"))
    p = {r["slug"]: r for r in routing.filed(full, at, routing.decide(docs, "id", "v", two, labels=labels, dim=4), "id", "v", "at", dim=4).collect()}
    assert p["a"]["source_count"] == 5 and p["a"]["last_activity_ts"] == 3 and p["a"]["centroid_embedding"][1] == pytest.approx(0.06) and p["b"]["source_count"] == 2


def test_overrides_fold_in_order(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "slug string, centroid_embedding array<double>")
    rows = [(1, "b", "a", [0.0, 1.0], 1), (2, "b", "a", [2.0, 2.0], 2), (3, "a", "b", [4.0, 4.0], 1), (4, "a", "b", [0.0, 2.0], 2), (5, "a", "b", None, 3), (6, "a", "zz", [1.0, 1.0], 1)]
    new, log = routing.apply_overrides(p, spark.createDataFrame(rows, "source_id long, original string, slug string, v array<double>, at int"), "v", ["at"], dim=2)
    got = {r["slug"]: r["centroid_embedding"] for r in new.collect()}
    assert got["a"] == pytest.approx([0.8 * 0.8 + 0.4, 0.8 * 0.2 + 0.4]) and got["b"] == pytest.approx([3.2, 3.6]) and log.count() == 6


def test_created_projects(spark):
    d = spark.createDataFrame([(1, "Lock Gates", [1.0], 1), (2, "lock gates!", [1.0], 2), (3, "New", [1.0], 3)], "id long, n string, v array<double>, at int")
    dec = d.select("id", F.lit("create").alias("decision"))
    p = spark.createDataFrame([("lock-gates",), ("lock-gates-2",)], "slug string")
    assert {r["slug"]: r["label"] for r in routing.created(dec, d, p, "id", "n", "v", "at").collect()} == {"lock-gates-3": "TODO", "lock-gates-4": "TODO", "new": "TODO"}


def test_graph_store(spark):
    ent, rel = "array<struct<name string, type string, description string>>", "array<struct<source string, target string, verb string>>"
    rows = [(2, "p", [("Ann  Lee", "person", "late"), ("Gate", "THING", "x")], [("Ann Lee", "Mill", "built")]), (1, "p", [("ann lee", "PERSON", "first"), ("Mill", "Organization", None), ("", "PERSON", "")], [("Ann Lee", "MILL", " Built "), ("Ann Lee", "Mill", ""), ("Ann Lee", "Gate", "saw")])]
    e, links, edges = graph.store(spark.createDataFrame(rows, f"id long, project string, entities {ent}, relations {rel}"), "id")
    assert {(r["normalized_name"], r["name"], r["description"]) for r in e.collect()} == {("ann lee", "ann lee", "first"), ("mill", "Mill", None)}
    assert {(r["id"], r["normalized_name"]) for r in links.collect()} == {(1, "ann lee"), (2, "ann lee"), (1, "mill")}
    assert [(r["source"], r["target"], r["relationship"], r["weight"]) for r in edges.collect()] == [("ann lee", "mill", "built", 1.0)]
    none = lambda c: F.lit(None).cast(ent)
    d = graph.cascade(spark.createDataFrame([("Ann saw",), ("x",)], "t string"), "t", none, lambda c: F.transform(graph.capitalised(c), lambda x: F.struct(x.alias("name"), F.lit("PERSON").alias("type"), F.lit(None).cast("string").alias("description"))))
    assert [[x["name"] for x in r["entities"]] for r in d.collect()] == [["Ann"], []]


def test_names_of_files(spark):
    from tarnwell.functions.text import dated_title, folder_name

    t = [("the History OF the Lock: gates and the AI",), ("  ...  ",), ("x" * 70,), ("word " * 20,)]
    got = [r[0] for r in spark.createDataFrame(t, "t string").select(dated_title(F.col("t"), "2025-01-01")).collect()]
    assert got == ["The History of the Lock Gates and the Ai - 2025-01-01.md", "Research - 2025-01-01.md", "X" + "x" * 59 + " - 2025-01-01.md", " ".join(["Word"] * 12) + " - 2025-01-01.md"]
    assert spark.createDataFrame([('"My: *Notes*"',)], "t string").select(folder_name(F.col("t"))).first()[0] == "My Notes"


def test_weekly_guards(spark):
    q = spark.createDataFrame([(1,)], "query_id int")
    runs = spark.sql("select timestamp_ntz'2025-01-01' as run_ts")
    f = evaluate.skip_reason
    assert [f(runs, q, "2025-01-09", q), f(runs, q, "2025-01-05", q), f(runs, q.limit(0), "2025-01-09", q), f(runs, q, "2025-01-09", q.limit(0)), f(runs, q, "2025-01-09", q, False), f(None, q, "2025-01-09", q)] == [None, "recent run", "no questions", "no collection", "no evaluator", None]
    m = spark.createDataFrame([("full", 0.5), ("no_x", 0.3)], "run string, ndcg double")
    assert {r["run"]: r["ndcg_delta"] for r in evaluate.deltas(m).collect()} == {"full": 0.0, "no_x": -0.2}


def test_markers_and_registry(spark):
    e = spark.sql("select * from values ('compact', 's1', timestamp_ntz'2025-01-01 10:00:00'), ('stop', 's1', timestamp_ntz'2025-01-01 11:00:00') as t(kind, session, at)")
    assert [r["value"] for r in transcripts.checkpoints(e, "kind", "session", "at").collect()] == ["\n---\n\n## [2025-01-01 10:00:00] PRE-COMPACT CHECKPOINT | session=s1\n"]
    p = spark.createDataFrame([("r", "write section_id: s3 now", 1), ("r", "section_id: s3", 2), ("r", "other", 3), (None, "section_id: s1", 4)], "run string, prompt string, at int")
    reg = transcripts.started(p, "run", "prompt", "at")
    assert {(r["section_id"], r["started_at"], r["status"]) for r in transcripts.closed(reg, spark.createDataFrame([("r", "s3")], "run string, section_id string"), "run").collect()} == {("s3", 1, "started"), ("s3", 2, "completed")}


def test_chunks_under_sections(spark):
    c = spark.createDataFrame([("r", "a", "q1"), ("r", "b", "q2"), ("r", "c", None)], "run string, chunk_id string, sub_question_origin string")
    o = spark.createDataFrame([("r", "s1", ["q1", "q1"]), ("r", "s2", ["q1", "q2"])], "run string, section_id string, source_routing_hints array<string>")
    assert {(r["chunk_id"], r["section"]) for r in chunking.routed(c, o, "run").collect()} == {("a", "s1"), ("a", "s2"), ("b", "s2")}


def test_tags(spark):
    d = spark.createDataFrame([("a", ["#Person", "x"]), ("b", ["y"]), ("c", None), ("d", ["paper", "concept"])], "n string, tags array<string>")
    assert [tuple(r) for r in governance.tagged(d, "n", "tags").collect()] == [("a", ["person"]), ("d", ["concept", "paper"])]
