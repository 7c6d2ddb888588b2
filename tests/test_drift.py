"""Schemas that drift: edge cases by hand."""

from __future__ import annotations

import json

from tarnwell.operators import drift

COLS = "raw_id long, searcher string, file_name string, written_ts timestamp_ntz, record_no int, payload string, field string"


def raw(spark, files):
    import datetime as dt

    rows, n = [], 0
    for k, (name, payloads) in enumerate(files):
        for p in payloads:
            n += 1
            rows.append((n, "s", name, dt.datetime(2024, 1, 1 + k), n, p if isinstance(p, str) or p is None else json.dumps(p), "clash"))
    return spark.createDataFrame(rows + rows[:1], COLS)  # one row delivered again, and a column that clashes


def found(spark, files):
    return {(r["file_name"], r["field"], r["change"]) for r in drift.changes(raw(spark, files)).collect()}


def test_changes(spark):
    text = "A long passage of the page. " * 10
    a = {"chunk_id": "s1_c1", "text": text, "fetched_at": "2024-01-01T00:00:00Z", "notes": None}
    b = {"id": 1001, "text": text, "fetched_at": 1704067200, "score": 0.5}
    c = {"chunks": [{"id": 1001, "body": text, "fetched_at": None, "score": True}], "searcher": "s"}
    got = found(spark, [("f1", [a, "{broken"]), ("f2", [b, None]), ("f3", [c])])
    assert got == {("f2", "id", "renamed"), ("f2", "fetched_at", "retyped"), ("f2", "notes", "removed"), ("f2", "score", "added"), ("f3", "body", "renamed"), ("f3", "score", "retyped")}


def test_unknown_names_go_by_content(spark):
    got = found(spark, [("f1", [{"source_url": "https://a.example/x"}]), ("f2", [{"where_from": "https://a.example/y"}]), ("f3", [{"agent": "a"}])])
    assert got == {("f2", "where_from", "renamed"), ("f3", "where_from", "removed"), ("f3", "agent", "added")}


def test_nothing_readable(spark):
    assert found(spark, [("f1", ["{x", None, "3", "[]"])]) == set()
    assert drift.changes(spark.createDataFrame([], COLS)).count() == 0


def test_consistent(spark):
    rec = [{"id": {"s": "s2", "c": 3}, "url": "https://a.example", "date": {"day": "2025-02-07", "clock": "18:44"}, "topic": ["Why was it so?"], "body": "b"}, {"id": 4001, "fetched_at": 1742567662000, "sub_question_origin": 3}]
    got = drift.consistent(raw(spark, [("f", [rec[0]]), ("g", [rec[1]])])).orderBy("raw_id").collect()
    assert [got[0][c] for c in drift.CANONICAL] == ["s2_c3", "s2", "https://a.example", None, "2025-02-07T18:44:00Z", "Why was it so?", "b"]
    assert (got[1]["chunk_id"], got[1]["section_id"], got[1]["fetched_at"], got[1]["sub_question_origin"]) == ("s4_c1", "s4", "2025-03-21T14:34:22Z", "3")


def test_versions(spark):
    v = drift.versions(raw(spark, [("f1", [{"a": 1}]), ("f2", [{"a": 2}]), ("f3", [{"a": "x"}]), ("f4", [{"a": 1}])])).orderBy("version").collect()
    assert [(r["first_file"], r["files"]) for r in v] == [("f1", 2), ("f3", 1), ("f4", 1)] and v[0]["fingerprint"] == v[2]["fingerprint"]
