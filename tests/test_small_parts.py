"""Small operators, scans and sinks that no query reaches."""

import datetime

from pyspark.sql import functions as F

from quillrock.functions import fees, lang
from quillrock.operators import agent, audit, evaluate, html
from quillrock.sources import scans, sinks


def test_lists_with_marks_anywhere(spark):
    rows = ["(1) first of the papers 2) second of the papers", "no list", "no list but longer text", "", None, "1) " + "x" * 500]
    got = [r.d for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", fees.split_docs(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got[0] == ["(1) first of the papers", "2) second of the papers"] and got[1] == [] and got[2] == [rows[2]] and got[3] in ([], None) and got[4] is None and [len(x) for x in got[5]] == [400]


def test_amounts_as_sources_write_them(spark):
    df = spark.createDataFrame([("5 টাকা, ৳ 7 and tk. 9 or 11/- BDT; ১২ items",)], "t string")
    found = lambda p: df.select(F.regexp_extract_all("t", F.lit(p), 0)).first()[0]
    assert found(fees.SWEPT) == ["5 টাকা"] and len(found(fees.WRITTEN)) == 4 and found(fees.SCANNED) == ["11", "১২"]


def test_labels_by_language(spark):
    df = spark.createDataFrame([({"en": "Deed", "bn": "দলিল"}, "bn"), ({"en": "Deed", "bn": ""}, "bn"), ({"en": "Deed"}, "fr")], "m map<string,string>, l string")
    assert [r[0] for r in df.select(lang.pick(F.col("m"), F.col("l"))).collect()] == ["দলিল", "Deed", "Deed"]


def test_order_and_stages(spark):
    scored = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "b", "x")], "score int, label string, target string")
    assert [tuple(r) for r in html.in_order(scored).collect()] == [(2, "b", "x"), (2, "a", "y"), (1, "a", "x")]
    out = agent.in_turn(scored, lambda d: d.withColumn("p", F.col("score") + 1), lambda d: d.withColumn("q", F.col("p") * 2))
    assert {(r.score, r.q) for r in out.collect()} == {(1, 4), (2, 6)}
    assert scored.select(agent.clipped_json(F.struct("score", "label"), 10)).first()[0] == '{"score":1'


def test_has(spark):
    df = spark.createDataFrame([("The FEE is 5",), ("none",), (None,)], "t string")
    assert [bool(r[0]) for r in df.select(evaluate.has(F.lower("t"), ["fee"])).collect()] == [True, False, False]


def test_scans_and_sinks(spark, tmp_path):
    day = datetime.date
    seen = spark.createDataFrame([("a", day(2026, 1, 1), "x"), ("a", day(2026, 1, 5), "y"), ("a", day(2026, 2, 1), "z"), ("b", day(2026, 2, 2), "w")], "url string, run_date date, sha string")
    seen.write.parquet(f"{tmp_path}/facts")
    assert [(r.url, r.sha) for r in scans.last_facts(spark, f"{tmp_path}/facts", "2026-02-01").collect()] == [("a", "y")]
    fetched = spark.createDataFrame([("u", b"x", datetime.datetime(2026, 1, 2, 3))], "url string, body binary, fetched_at timestamp")
    sinks.write_raw(fetched, f"{tmp_path}/raw")
    assert spark.read.parquet(f"{tmp_path}/raw").where("day = '2026-01-02'").count() == 1
    sinks.write_trace(spark.createDataFrame([(1, "t", "{}", "r", "more")], "step int, tool string, args string, result string, other string"), f"{tmp_path}/trace")
    assert sorted(spark.read.json(f"{tmp_path}/trace").columns) == ["args", "result", "step", "tool"]
    sinks.write_not_found(spark.createDataFrame([("c", "why", "2026")], "category string, reason string, at string"), f"{tmp_path}/none")
    assert spark.read.json(f"{tmp_path}/none").first()["reason"] == "why"
    sinks.write_drafts(spark.createDataFrame([("c", "citizens", "source_read"), ("d", " ", "source_read")], "category string, audience_check string, status string"), f"{tmp_path}/drafts")
    assert [(r.category, r.status) for r in spark.read.parquet(f"{tmp_path}/drafts").collect()] == [("c", "unverified")]


def test_candidates_of_pages_that_share_an_address(spark):
    """Links that tie in score and place have one order, however the rows come."""
    rows = [("u", 0, label, f"http://o.org/{label}", 2) for label in ("b", "a", "c")]
    got = [[(r["label"], r["rank"]) for r in audit.top_candidates(spark.createDataFrame(x, "url string, pos int, label string, target string, score int").coalesce(1), "th", "que").orderBy("rank").collect()] for x in (rows, rows[::-1])]
    assert got[0] == got[1] == [("a", 1), ("b", 2), ("c", 3)]
