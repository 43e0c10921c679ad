"""JSON scans and sinks on small invented files."""

import json

from quillrock.sources import scans, sinks


def put(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_taxonomy_and_aliases(spark, tmp_path):
    path = put(tmp_path / "t.json", {"categories": [{"id": "deed", "bn": "দলিল", "aliases": ["dolil", "deed"], "sources": ["s1"], "mvp_priority": 1}, {"id": "bare", "bn": None}]})
    t = scans.taxonomy(spark, path)
    assert [(r["pos"], r["id"], r["mvp_priority"]) for r in t.orderBy("pos").collect()] == [(0, "deed", 1), (1, "bare", None)]
    assert [(r["category"], r["alias"], r["pos"]) for r in scans.aliases(t, named=True).orderBy("pos").collect()] == [("deed", "dolil", 0), ("deed", "deed", 1), ("deed", "দলিল", 2)]
    assert [r["alias"] for r in scans.aliases(t).orderBy("pos").collect()] == ["dolil", "deed"]


def test_lists(spark, tmp_path):
    assert scans.patterns(spark, put(tmp_path / "p.json", {"patterns": [{"id": "p1", "category": "deed", "source_date": "2020-01-02"}]})).first()["source_date"].year == 2020
    assert scans.questions(spark, put(tmp_path / "q.json", {"questions": [{"id": "q1", "must_contain": ["a"]}]})).first()["must_contain"] == ["a"]
    assert scans.offices(spark, put(tmp_path / "o.json", {"offices": [{"office_id": "x", "accept_categories": ["deed"]}]})).first()["accept_categories"] == ["deed"]


def test_records_and_broken_files(spark, tmp_path):
    put(tmp_path / "a.json", {"category": "deed", "fees": [{"fee_key": "f", "amount_bdt": 10}], "unknown": 1})
    (tmp_path / "b.json").write_text("{", encoding="utf-8")
    rows = scans.records(spark, str(tmp_path / "*.json"), broken=True).cache().collect()
    assert sorted(((r["category"], r["_corrupt_record"] is not None) for r in rows), key=str) == [("deed", False), (None, True)]


def test_pdf_catalogue(spark, tmp_path):
    path = put(tmp_path / "c.json", {"a": ["1", "2", "3", "4", "5"], "b": []})
    assert [r["url"] for r in scans.pdf_catalogue(spark, path).orderBy("pos").collect()] == ["1", "2", "3", "4"]


def test_cache_scan(spark, tmp_path):
    (tmp_path / "x_1.body").write_bytes(b"<p>a</p>")
    put(tmp_path / "x_1.json", {"url": "http://a", "status": 200})
    r = scans.fetched(spark, str(tmp_path / "*.body"), str(tmp_path / "*.json")).collect()
    assert [(x["url"], bytes(x["body"])) for x in r] == [("http://a", b"<p>a</p>")]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "records")
    sinks.write_records(spark.createDataFrame([("a", 1), ("b", 1)], "category string, n int"), at)
    sinks.write_records(spark.createDataFrame([("b", 2)], "category string, n int"), at)
    assert sorted((r["category"], r["n"]) for r in spark.read.parquet(at).collect()) == [("a", 1), ("b", 2)]
    report = str(tmp_path / "report")
    for n in (1, 2):
        sinks.write_report(spark.createDataFrame([(n,)], "n int"), report, "2026-01-01")
    assert [r["n"] for r in spark.read.json(report).collect()] == [2]
    assert sinks.gate(spark.createDataFrame([], "n int")) and not sinks.gate(spark.createDataFrame([(1,)], "n int"))
