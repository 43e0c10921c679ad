"""Operators of answers, fonts, agents, drift and records on small rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrock.functions import embed, fees, fonts
from quillrock.operators import agent, audit, classify, compose, drift, html, records
from quillrock.sources import scans, sinks


def test_vat_is_decided_part_by_part(spark):
    cells = [(1, "ক) এক ১০০/- টাকা (ভ্যাটসহ) (খ) দুই ২০০/- টাকা"), (2, "৩০০ টাকা + ১৫% ভ্যাট"), (3, "৩০০ টাকা"), (4, "বিনামূল্যে"), (5, None)]
    got = {r.id: r.p for r in spark.createDataFrame(cells, "id int, c string").select("id", fees.parse_fees(F.col("c")).alias("p")).collect()}
    assert [(f.amount, f.vat) for f in got[1].fees] == [(100, True), (200, None)]
    assert [(f.amount, f.vat) for f in got[2].fees] == [(300, False)] and got[3].fees[0].vat is None
    assert [(f.amount, f.vat) for f in got[4].fees] == [(0, True)]
    assert got[5].fees == [] and got[5].note == "empty fee cell"


def test_drift_reports_facts_only(spark):
    facts = "url string, updated date, amounts array<bigint>, text_sha1 string"
    before = spark.createDataFrame([("a", None, [1, 2], "x"), ("b", None, [], "x"), ("c", None, [5], "x"), ("d", None, [1], "x")], facts)
    after = spark.createDataFrame([("a", None, [2, 3], "y"), ("b", None, [], "y"), ("c", None, [5], "x"), ("e", None, [9], "z")], facts).withColumn("updated", F.when(F.col("url").isin("a", "c"), F.lit("2024-01-01").cast("date")))
    seen = drift.compared(before, after)
    assert {r.url: r.status for r in seen.collect()} == {"a": "changed", "b": "text", "c": "changed", "e": "new"}
    assert {(r.url, r.kind, tuple(r.removed), tuple(r.added)) for r in drift.findings(seen).collect()} == {("a", "source_date", (), ()), ("a", "amounts", (1,), (3,)), ("c", "source_date", (), ())}


def test_page_text_is_nfc(spark):
    pages = spark.createDataFrame([("u", "<p>য়</p>"), ("v", "<p>য়</p>")], "url string, html string")
    assert len({r.text_sha1 for r in html.page_facts(pages).collect()}) == 1


def test_login_wall_needs_a_password_field(spark):
    pages = spark.createDataFrame([(1, "<p>sign in</p>"), (2, "<input type='password'>"), (3, "<a href='x.pdf?v=1'>p</a><a href='y.PDF#2'>q</a><a href='./x.pdf?v=1'>r</a>"), (4, "<b type=password>"), (5, None)], "page_id int, html string").withColumn("url", F.lit("http://h/d/"))
    got = {r.page_id: r for r in html.signals(pages).collect()}
    assert {k: (r.login_wall, r.n_pdf) for k, r in got.items() if k < 5} == {1: (False, 0), 2: (True, 0), 3: (False, 2), 4: (False, 0)}
    assert got[3].pdfs == ["http://h/d/x.pdf?v=1", "http://h/d/y.PDF#2"] and not got[1].redirected and got[5].visible_chars == 0


def test_closure_goes_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "src int, dst int")
    assert audit.closure(chain).where("src = 0").count() == 100


def test_decode_longest_first():
    d = fonts.Decoder({"ab": "ক", "a": "খ", "b": "গ", "e": "ে"})
    assert d.decode("aba (cid:7)")[0] == "কখ (cid:7)"
    text, share = d.decode("eab§(cid:1)")
    assert text == "কে§(cid:1)" and share == pytest.approx(1 - 2 / 4)
    assert fonts.logical("েকা") == "কো" and fonts.logical("িক্ত") == "ক্তি" and fonts.raised_r("কর্") == "র্ক"
    # inside words of three clusters as well
    assert fonts.raised_r("কমর্ক") == "কর্মক" and fonts.raised_r("ধমর্ীয়") == "ধর্মীয়" and fonts.raised_r("কাযর্ালয়") == "কার্যালয়"
    assert fonts.Decoder({}).decode("a – b")[1] == pytest.approx(2 / 3)  # a long dash is no ASCII mark


def test_legacy_column(spark):
    got = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string").select("id", fonts.decode(F.col("t"), {"a": "ক", "b": "খ"}).alias("d")).collect()
    assert {r.id: None if r.d is None else r.d.text for r in got} == {1: "কখ", 2: None}


def test_character_maps(spark):
    stream = "2 beginbfchar <01> <0995> <02> <> endbfchar 3 beginbfrange <10> <12> <0041> <20> <21> [<0061> <00620063>] <30> <2F> <0041> endbfrange"
    assert fonts.character_map(stream) == {1: "ক", 16: "A", 17: "B", 18: "C", 32: "a", 33: "bc"}
    maps = fonts.character_maps(spark.createDataFrame([("f", stream), ("g", None)], "font string, stream string"))
    glyphs = fonts.glyph_texts(spark.createDataFrame([("f", 1, "uni0996"), ("f", 16, "uni0041"), ("f", 99, "uni09C7"), ("f", 5, "glyph5")], "font string, gid int, name string"))
    assert {tuple(r) for r in fonts.corrections(maps, glyphs).collect()} == {("f", 1, "ক", "খ"), ("f", 99, None, "ে")}
    names = spark.createDataFrame([("f", "a", "x"), ("f", "b", "y")], "font string, name string, text string")
    rules = spark.createDataFrame([("f", ["a", "b"], "ab"), ("f", ["ab", "a"], "aba"), ("f", ["missing"], "no"), ("f", ["b"], "a"), ("f", ["a", "a"], "aa")], "font string, parts array<string>, name string")
    assert {r.name: r.text for r in fonts.substituted(names, rules).collect()} == {"a": "x", "b": "y", "ab": "xy", "aba": "xyx", "aa": "xx"}


def test_embeddings_are_unit_and_repeatable(spark):
    df = spark.createDataFrame([(1, "a text"), (2, "a text"), (3, None), (4, "")], "id int, t string")
    got = {r.id: r.v for r in df.select("id", embed.embed(F.col("t"), "query", embed.HashedGrams(16)).alias("v")).collect()}
    assert got[1] == got[2] and got[3] is None and np.isclose(np.linalg.norm(got[1]), 1)


def test_registry_answers_every_call(spark):
    reg = agent.Registry({"div": agent.Tool(lambda a, b=1: a / b, "quotient", {"a": "number", "b": "number"}, ("b",))})
    assert reg.call("div", {"a": 4, "b": 2}) == (True, 2) and reg.call("div", {"a": 4}) == (True, 4)
    assert [reg.call(*x)[0] for x in (("no", {}), ("div", {}), ("div", {"a": "x"}), ("div", {"a": 1, "c": 2}), ("div", {"a": 1, "b": 0}))] == [False] * 5
    assert reg.schema()[0]["parameters"]["required"] == ["a"]
    plan = agent.Queue([("div", {"a": i}) for i in (1, 2, 1, 3)], lambda n, a, r: [("div", {"a": 9})])
    trace = agent.episode(spark, reg, plan, most=3).orderBy("step").collect()
    assert [json.loads(r.args)["a"] for r in trace] == [1, 2, 3] and agent.shown("x" * 10, 4) == "xxxx … [6 more]"


def test_resolve_without_hits_or_profiles(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7, 0.7]), (3, [0.0, 0.1])], "qid int, qvec array<double>")
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "category string, pvec array<double>")
    hits = spark.createDataFrame([], "qid int, category string, alias string")
    assert {r.qid: r.category for r in classify.resolve(q, hits, p).collect()} == {1: "a", 2: "unknown_service", 3: "unknown_service"}
    both = spark.createDataFrame([(3, "a", "x"), (3, "b", "y"), (2, "b", "y")], "qid int, category string, alias string")
    assert {r.qid: (r.category, r.method) for r in classify.resolve(q, both, p).collect()} == {1: ("a", "embedding"), 2: ("b", "alias"), 3: ("b", "alias+embedding")}


def test_index_and_checklists(spark, tmp_path):
    sinks.write_index(spark.createDataFrame([("a", 1), ("b", 2)], "category string, id int"), f"{tmp_path}/i")
    assert [r.id for r in scans.index(spark, f"{tmp_path}/i", ["b"]).collect()] == [2]
    (tmp_path / "c.json").write_text(json.dumps({"x": ["d1", "d2"], "y": ["d3"]}))
    assert {(r.section, r.pos, r.doc) for r in scans.checklists(spark, f"{tmp_path}/c.json", {"x": "If asked"}).collect()} == {("x", 0, "If asked: d1"), ("x", 1, "If asked: d2"), ("y", 0, "d3")}


def test_ungrounded_both_ways(spark):
    p = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta epsilon"), (3, "zeta")], "id int, t string")
    d = spark.createDataFrame([("see alpha beta here",), ("delta",), (None,)], "t string")
    assert [r.id for r in audit.ungrounded(p, "id", "t", d, "t", block=2).collect()] == [3]


def test_details_and_acceptance(spark):
    df = spark.createDataFrame([("a<details><summary>s</summary>in</details>b", "costs 5", "FEE 5"), ("plain", "costs 6", "FEE 5"), ("plain", "for a child of 6: 5", "FEE 5"), ("plain", "৬ and 5", None)], "md string, g string, f string")
    r = df.select(compose.unfolded(F.col("md")).alias("u"), compose.accepted(F.col("g"), F.col("f")).alias("ok")).collect()
    assert tuple(r[0].u) == ("a", "s", "in", "b") and r[0].ok == "costs 5" and r[1].u.before == "plain" and r[1].ok is None
    asked = [x.ok for x in df.select(compose.accepted(F.col("g"), F.col("f"), F.lit("my child is 6")).alias("ok")).collect()]
    assert asked == ["costs 5", "costs 6", "for a child of 6: 5", None]


def test_warnings_of_an_empty_table(spark):
    empty = spark.createDataFrame([], records.RECORD)
    assert records.warnings(empty, F.current_date()).count() == 0 and {r.severity: r.n for r in records.severities(empty, empty).collect()} == {"error": 0, "warning": 0}
