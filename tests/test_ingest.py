"""Record builders, schema compiler, streamed re-scrapes, addresses and routing on small and odd rows."""

import datetime
import json
import random
from decimal import Decimal
from urllib.parse import unquote, urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillrock.functions import fonts, urls
from quillrock.operators import builders, conform, drift, records
from quillrock.plans import ingest
from quillrock.streaming import rescrape

PAGE = "doc_id long, kind string, url string, html string, updated date"


def built(spark, rows, rules):
    return {r.doc_id: r for r in builders.cut(spark.createDataFrame(rows, PAGE), builders.rule_table(spark, rules)).collect()}


def test_rows_belong_to_the_last_mark_before_them(spark):
    rule = builders.text_rule("k", "r", r"(\w+) costs (\S+)", "{s1} {r1}", "{s1}/{r1}/{n}", r"costs ([০-৯\d,]+)", r"Part (\w+):")
    text = "x costs 1 <b>Part A:</b> y costs 1,200 z costs ৩৪ Part B: w costs ask Part C: Part D: v costs 0"
    got = built(spark, [(1, "k", "u", text, None), (2, "k", "u", "no marks: y costs 3", None), (3, "k", "u", None, None), (4, "other", "u", text, None), (5, None, "u", text, None)], [rule])
    assert [(f.fee_key, f.label, f.amount) for f in got[1].fees] == [("a_y", "A/y/01", 1200), ("a_z", "A/z/02", 34), ("b_w", "B/w/03", None), ("d_v", "D/v/04", 0)]
    assert got[1].fees[2].raw_text == "w costs ask"
    assert all(got[i].fees == [] and got[i].required_docs == [] for i in (2, 3, 4, 5))


def test_rules_of_tables(spark):
    page = "<table><tr><td>১</td><td>A</td><td>৫০ টাকা</td></tr><tr><td>২</td><td>B</td><td>বিনা ফিসে</td></tr><tr><td>৩</td><td>C</td><td>?</td></tr><tr><td>৪</td><td>D</td></tr><tr><td>x</td><td>E</td><td>9 টাকা</td></tr></table>"
    rules = [builders.table_rule("k", "a", "a_{n}", first=builders.TABLE_ROW), builders.table_rule("k", "b", "b_{n}", term="E", ord=1), builders.docs_rule("k", "d", "^৩", 1, 3, ord=2)]
    got = built(spark, [(1, "k", "u", page, None)], rules)[1]
    assert [(f.fee_key, f.label, f.amount) for f in got.fees] == [("a_01", "A", 50), ("a_02", "B", 0), ("a_03", "C", None), ("b_01", "E", 9)]
    assert got.required_docs == ["C"]


def test_records_keep_what_is_unread(spark):
    rules = builders.rule_table(spark, [builders.text_rule("k", "r", r"costs (\S+)", "f{n}", "fee", r"costs (\d+)")])
    heads = spark.createDataFrame([("k", "c", "S", "s", "O", None, None, None, None), ("bare", "d", "S", "s", "O", None, None, None, "closed")], "kind string, category string, service_name_en string, service_name_bn string, office string, apply_portal string, contact string, steps array<struct<step:string,where:string>>, why string")
    df = spark.createDataFrame([(1, "k", "u", "costs 5 costs x", datetime.date(2026, 1, 2)), (2, "bare", "u", "costs 5", datetime.date(2026, 1, 2)), (3, "k", "u", "", None)], PAGE)
    rec = builders.records(builders.cut(df, rules), heads, F.lit("2026-02-01"), "me")
    got = {r.doc_id: r for r in rec.collect()}
    assert [(f.amount_bdt, f.raw_text, f.verification.status) for f in got[1].fees] == [(Decimal("5.00"), None, "source_read"), (None, "costs x", "unverified")]
    assert got[2].verification.status == "unverified" and got[2].verification.method == "closed" and got[2].source_last_updated is None and got[2].fees == []
    assert got[3].notes == ["not ingestible yet: nothing could be read"] and got[3].variants == []
    want = StructType.fromDDL(records.RECORD)
    assert {f.name: f.dataType.simpleString() for f in rec.drop("doc_id").schema} == {f.name: f.dataType.simpleString() for f in want}


def kinds(x):
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}[type(x)]


def is_kind(x, kind):
    return kinds(x) == "number" and float(x).is_integer() if kind == "integer" else kinds(x) == kind


def breaks(x, s, at, root):
    """A plain validator of the compiled keywords."""
    if "$ref" in s:
        for part in s["$ref"][2:].split("/"):
            root2 = root if part == s["$ref"][2:].split("/")[0] else root2  # noqa: F821
            root2 = root2[part]
        return breaks(x, root2, at, root)
    out, under = [], lambda k: f"{at}/{k}" if at else str(k)
    types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    if types and not any(is_kind(x, t) for t in types):
        out.append((at, "type"))
    if "enum" in s and not any(kinds(x) == kinds(v) and x == v for v in s["enum"]):
        out.append((at, "enum"))
    if isinstance(x, str):
        out += [(at, "minLength")] * (len(x) < s.get("minLength", 0)) + [(at, "maxLength")] * (len(x) > s.get("maxLength", 99))
    if kinds(x) == "number":
        out += [(at, "minimum")] * (x < s.get("minimum", -1e9)) + [(at, "exclusiveMaximum")] * (x >= s.get("exclusiveMaximum", 1e9))
    if isinstance(x, list):
        out += [(at, "minItems")] * (len(x) < s.get("minItems", 0))
        for i, v in enumerate(x):
            out += breaks(v, s.get("items", {}), under(i), root)
    if isinstance(x, dict):
        out += [(at, "required") for k in s.get("required", []) if k not in x]
        for k, v in x.items():
            if k in s.get("properties", {}):
                out += breaks(v, s["properties"][k], under(k), root)
            elif s.get("additionalProperties") is False:
                out.append((at, "additionalProperties"))
            elif isinstance(s.get("additionalProperties"), dict):
                out += breaks(v, s["additionalProperties"], under(k), root)
    return out


SCHEMA = {
    "title": "t", "type": "object", "required": ["a", "b"], "additionalProperties": False,
    "properties": {
        "a": {"type": ["integer", "null"], "minimum": -1, "exclusiveMaximum": 5}, "b": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/d"}}, "c": {"enum": ["x", 1, None, True]},
        "e": {"type": "object", "additionalProperties": {"type": "string", "minLength": 1, "maxLength": 2}},
    },
    "definitions": {"d": {"type": "object", "required": ["k"], "properties": {"k": {"type": "boolean"}, "n": {"type": "number"}}}},
}


def test_compiled_schema_against_a_plain_validator(spark):
    rng = random.Random(2)
    leaf = lambda: rng.choice([None, True, False, 0, 1, 1.0, 2.5, -3, 7, "x", "", "long", "é"])

    def value(depth):
        r = rng.random()
        if depth == 0 or r < 0.4:
            return leaf()
        return [value(depth - 1) for _ in range(rng.randrange(3))] if r < 0.6 else {rng.choice("abcdekn"): value(depth - 1) for _ in range(rng.randrange(4))}

    def near():
        x = {"a": rng.choice([1, None, 4, 5, -2, "x"]), "b": [{"k": leaf(), "n": leaf()} if rng.random() < 0.8 else leaf() for _ in range(rng.randrange(3))], "c": leaf(), "e": {"p": leaf(), "q": leaf()}, "z": 1}
        return {k: v for k, v in x.items() if rng.random() < 0.8}

    texts = [near() if rng.random() < 0.7 else value(3) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(texts)], "path long, body string")
    got = sorted((r.path, r.at, r.rule) for r in conform.check(df, SCHEMA).collect())
    assert got == sorted((i, *b) for i, x in enumerate(texts) for b in breaks(x, SCHEMA, "", SCHEMA)) and len(got) > 400


def test_texts_that_are_no_json(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, ""), (4, '{"a": 1, "a": 2}'), (5, "null"), (6, '{"a": 1, "b": [{"k": true}]}')], "path int, body string")
    assert {(r.path, r.rule) for r in conform.check(df, SCHEMA).collect()} == {(1, "broken"), (2, "broken"), (3, "broken"), (4, "broken"), (5, "type")}
    assert conform.check(df.where("false"), SCHEMA).count() == 0


def test_schemas_that_cannot_be_compiled(spark):
    v = F.try_parse_json(F.lit("1"))
    loop = {"$ref": "#/definitions/d", "definitions": {"d": {"properties": {"x": {"$ref": "#/definitions/d"}}}}}
    for schema in (loop, {"oneOf": []}, {"$ref": "http://x"}, {"type": "thing"}, {"items": [{}]}, {"enum": [[1]]}):
        with pytest.raises(ValueError):
            conform.breaches(v, schema)


def test_schema_of_a_record_accepts_built_records(spark, tmp_path):
    schema = ingest.record_schema()
    (tmp_path / "s.json").write_text(json.dumps(schema))
    assert conform.schema_of(spark, f"{tmp_path}/s.json") == schema
    body = F.to_json(F.struct(*records.FIELDS), {"ignoreNullFields": "false"})
    texts = ingest.built(spark, "/root/testdata/sf0.001").select(F.col("doc_id").alias("path"), body.alias("body"))
    assert conform.check(texts, schema).count() == 0
    assert {(r.at, r.rule) for r in conform.check(texts.where("path = 0").withColumn("body", F.replace("body", F.lit('"source_read"'), F.lit('"read"'))), schema).collect()} >= {("verification/status", "enum"), ("fees/0/verification/status", "enum")}


FACT = "url string, updated date, amounts array<long>, text_sha1 string, visited timestamp"


def test_streamed_changes(spark, tmp_path):
    at = lambda d: datetime.datetime(2026, 1, d)
    day = datetime.date(2026, 1, 1)
    visits, out, progress = (f"{tmp_path}/{x}" for x in ("visits", "out", "progress"))
    put = lambda rows: spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(visits)
    first = [("a", day, [1, 2], "x", at(1)), ("b", None, None, "x", at(1)), ("c", day, [5], "x", at(1)), (None, day, [1], "x", at(1)), ("d", day, [1], "x", None)]
    put(first)
    seen = lambda: sorted(((r.url, r.visited.day, r.status, r.kind, tuple(r.removed), tuple(r.added)) for r in rescrape.run(spark, visits, out, progress).collect()), key=str)
    new = [("a", 1, "new", None, (), ()), ("b", 1, "new", None, (), ()), ("c", 1, "new", None, (), ())]
    assert seen() == new
    # a replay, a late visit, two visits of a page at once, a page with both changes, only another text, nothing new
    second = [*first, ("a", None, [2, 3], "y", at(5)), ("a", None, [2, 3], "y", at(6)), ("a", day, [9], "z", at(4)), ("b", None, [], "y", at(3)), ("c", day, [5, 5], "x", at(3)), ("b", day, [7], "q", at(2))]
    put(second)
    want = [
        ("a", 4, "changed", "amounts", (1, 2), (9,)), ("a", 5, "changed", "amounts", (9,), (2, 3)), ("a", 5, "changed", "source_date", (), ()), ("a", 6, "identical", None, (), ()), ("b", 2, "changed", "amounts", (), (7,)), ("b", 2, "changed", "source_date", (), ()),
        ("b", 3, "changed", "amounts", (7,), ()), ("b", 3, "changed", "source_date", (), ()), ("c", 3, "identical", None, (), ()),
    ]
    assert sorted((x for x in seen() if x not in new), key=str) == sorted(want, key=str)
    put(second)  # all of it replayed
    assert len(seen()) == len(new) + len(want)


def test_streamed_changes_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    day = lambda: rng.choice([None, datetime.date(2026, 1, rng.randrange(1, 4))])
    rows = lambda d: [(f"u{i}", day(), [rng.randrange(3) for _ in range(rng.randrange(3))], rng.choice("xy"), datetime.datetime(2026, 1, d)) for i in range(60) if rng.random() < 0.9]
    one, two = (spark.createDataFrame(rows(d), FACT) for d in (1, 2))
    facts = lambda df: df.withColumn("amounts", F.array_sort(F.array_distinct("amounts"))).drop("visited")
    want = sorted((r.url, r.kind, str(r.was), str(r.now), r.removed, r.added) for r in drift.findings(drift.compared(facts(one), facts(two))).collect())
    for i, df in enumerate((one, two, one)):
        df.write.mode("append").parquet(f"{tmp_path}/v")
        got = rescrape.findings(rescrape.run(spark, f"{tmp_path}/v", f"{tmp_path}/o", f"{tmp_path}/p"))
        if i:
            assert sorted((r.url, r.kind, str(r.was), str(r.now), r.removed, r.added) for r in got.collect()) == want


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(1)
    seg, bits = ["a", "b.html", "..", ".", "c d", "é"], ["%E0%A6%95", "%", "%4", "%41", "%zz", "+", " ", "é", "%FF", "%25", "%2B", "%%%"]
    rows = []
    for _ in range(1500):
        base = "http://h.example.org" + rng.choice(["", "/", "/x/y", "/x/y/", "/x/../z/q.html"]) + rng.choice(["", "?q=1", "?q=1#f", "#f"])
        href = "/".join(rng.choice(seg) for _ in range(rng.randrange(0, 6))) + rng.choice(["", "/", "?a=b/../c", "#t", "?x#y"])
        rows.append((base, rng.choice([href, "/" + href, "//o.org/p", "https://z.org/q", "?k=v", "#top", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))))
    df = spark.createDataFrame(rows, "b string, h string, t string")
    for r in df.withColumns({"to": urls.resolve(F.col("b"), F.col("h")), "u": urls.unquote(F.col("t"))}).collect():
        assert r.u == unquote(r.t) and (r.to == urljoin(r.b, r.h) or r.h.startswith("//") or "/../" in r.h[:4])


def test_routes(spark):
    rows = [(1, "plain text " * 9, True, False), (2, "†‡¶¸©®" * 9, True, False), (3, "short", True, False), (4, None, True, False), (5, "x" * 99, False, False), (6, "বাংলা " * 20, True, None), (7, "বাংলা " * 20, True, True), (8, "xkcd qwrt " * 30, True, False)]
    df = spark.createDataFrame(rows, "id int, text string, is_pdf boolean, corrected boolean")
    got = {r.id: (r.encoding, r.decoded is not None) for r in fonts.routed(df, {}, "text", "is_pdf", "corrected").collect()}
    assert got == {1: ("plain", True), 2: ("legacy_bijoy", False), 3: ("empty", False), 4: ("empty", False), 5: ("not_a_pdf", False), 6: ("plain", True), 7: ("nikosh_cmap", True), 8: ("legacy_unknown", False)}
    plan = fonts.routed(df, {}, "text", "is_pdf", "corrected").where("encoding = 'plain'")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan or "encoding" in plan


def one_at_a_time(seeds, links, rows, read, fees, most, rules):
    """A category's queue worked through action by action: (tool, arg) in order, and the outcome."""
    plan, seen, trace, got, source = [("discover_links", u, None) for u in seeds if u], set(), [], [], None
    while plan and len(trace) < most:
        tool, arg, extra = plan.pop(0)
        if (tool, arg) in seen:
            continue
        seen.add((tool, arg))
        trace.append((tool, arg))
        if tool == "discover_links":
            plan += [("extract_tables", u, None) for u in links.get(arg, [])]
        elif tool == "extract_tables":
            plan += [("detect", to, None) for to in rows.get(arg, [])]
        elif tool == "detect" and arg in read and read[arg][0]:
            plan.insert(0, ("decode", arg, None))
        elif tool in ("decode", "decode_wider"):
            lines = read[arg][1 if tool == "decode" else 2]
            if lines:
                source = arg
                plan += [("parse_fee", x, None) for x in lines[:6]]
            elif tool == "decode" and read[arg][3]:
                plan.insert(0, ("decode_wider", arg, None))
        elif tool == "parse_fee":
            got += fees[arg]
    waiting = [x for x in plan if (x[0], x[1]) not in seen]
    outcome = "budget" if waiting or len(trace) >= most else "save_draft" if source and got else "give_up"
    return trace, outcome, source, got


@pytest.mark.parametrize("most", [15, 6])
def test_all_categories_at_once_are_as_one_at_a_time(spark, most):
    from quillrock.functions import fees as fee_functions
    from quillrock.operators import ingestion

    rng = random.Random(5)
    names = ["charter list", "list of transfer", "fee list", "other", "list"]
    page = lambda i: "".join(f"<a href='/p{rng.randrange(12)}'>{rng.choice(names)}</a>" for _ in range(rng.randrange(5))) + "<table>" + "".join(f"<tr><td>{rng.choice(['alpha', 'beta', 'ফি', 'no'])}</td><td><a href='{rng.choice(['x.html', f'/d{rng.randrange(6)}.pdf'])}'>g</a><a href='/d{rng.randrange(8)}.pdf'>h</a></td></tr>" for _ in range(rng.randrange(2, 5))) + "</table>"
    pages = spark.createDataFrame([(f"http://o.org/p{i}", page(i)) for i in range(9)], "url string, html string")
    lines = ["সেবা ১০ টাকা", "সেবা ২০ টাকা", "৫ ভাগের ৬ টাকা", "হার ৭", "plain words about an office and what it does"]
    body = lambda: "\n".join([lines[4], *(rng.choice(lines[:4]) for _ in range(rng.randrange(4)))])
    bodies = spark.createDataFrame([(f"http://o.org/d{i}.pdf", body() + "\n" + lines[4] * 9, i != 3, False) for i in range(7)], "url string, text string, is_pdf boolean, corrected boolean")
    cats = [(f"c{i}", rng.choice([["alpha"], ["beta", ""], []]), [f"http://o.org/p{rng.randrange(11)}" for _ in range(rng.randrange(4))] + [None]) for i in range(25)]
    categories = spark.createDataFrame(cats, "category string, terms array<string>, seeds array<string>")
    rules = ingest.AGENT_RULES
    trace = ingestion.actions(categories, pages, bodies, None, rules, most)
    found = {r.category: r for r in ingestion.outcomes(categories, trace, most).collect()}
    by = {}
    for r in sorted(trace.collect(), key=lambda r: r.step):
        by.setdefault(r.category, []).append((r.tool, r.arg))
    # what each page and document gives, from the rounds' own parts, one category at a time
    alone = lambda c: spark.createDataFrame([c], "category string, terms array<string>, seeds array<string>")
    everything = alone(("x", [""], [f"http://o.org/p{i}" for i in range(11)]))
    links = {}
    for i in range(11):
        one = ingestion._candidates(ingestion._seeds(alone(("x", [], [f"http://o.org/p{i}"]))), pages, rules).orderBy("k2").collect()
        links[f"http://o.org/p{i}"] = [r.arg for r in one]
    texts = {}
    for r in pages.select("url", F.posexplode(F.flatten(ingestion.html.table_preview(F.col("html"), chars=80))).alias("k", "r")).collect():
        to = [urljoin(r.url, x) for x in r.r.links[:2]]
        texts.setdefault(r.url, []).append((r.k, " ".join(r.r.cells), next((x for x in to if x.lower().endswith(".pdf")), None)))
    all_docs = spark.createDataFrame([(f"http://o.org/d{i}.pdf",) for i in range(9)], "arg string")
    read = {r.url: (r.encoding in ("plain", "legacy_bijoy", "nikosh_cmap"), r.lines1, r.lines2, r.n_lines) for r in ingestion._decoded(all_docs, bodies, {}, rules).collect()}
    cells = spark.createDataFrame([(x,) for x in lines], "t string").select("t", fee_functions.parse_fees(F.col("t"))["fees"].alias("f"))
    fees_of = {r.t: [f.amount for f in r.f if f.amount is not None] for r in cells.collect()}
    assert everything.count() == 1
    import re

    outcomes = set()
    for name, terms, seeds in cats:
        rows = {u: [to for _, text, to in sorted(v) if to and (any(t and t in text for t in terms) or re.search(rules.fee_words, text))] for u, v in texts.items()}
        want, outcome, source, got = one_at_a_time(seeds, links, rows, read, fees_of, most, rules)
        assert by.get(name, []) == want, name
        assert (found[name].outcome, found[name].source_url, [f.amount for f in found[name].fees]) == (outcome, source, got)
        outcomes.add(outcome)
    assert len(outcomes) >= 2
    assert {r.category for r in ingestion.as_drafts(ingestion.outcomes(categories, trace, most)).collect()} == {c for c, r in found.items() if r.outcome == "save_draft"}
    assert ingestion.tombstones(ingestion.outcomes(categories, trace, most), F.current_timestamp()).count() == sum(r.outcome == "give_up" for r in found.values())


def test_fetched_pages_from_cache_and_tree(spark, tmp_path):
    from quillrock.sources import fetch

    site, cache, listed = tmp_path / "site", f"{tmp_path}/cache", f"{tmp_path}/urls"
    for host, path, body in (("a", "x.html", "ax"), ("a", "y.pdf", "ay"), ("b", "x.html", "bx")):
        (site / host).mkdir(parents=True, exist_ok=True)
        (site / host / path).write_text(body)
    at = lambda host, path: f"file://{site}/{host}/{path}"
    urls = [at("a", "x.html"), at("a", "y.pdf"), at("a", "none.html")]
    fetch.write_list(spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string"), listed)
    fetch.register(spark)
    read = lambda **o: {r.url: r for r in spark.read.format("fetched_pages").options(urls=listed, cache=cache, fetcher="quillrock.sources.fetch:file_tree", **o).load().collect()}
    got = read()
    assert {u: (r.status, bytes(r.body), r.from_cache) for u, r in got.items()} == {urls[0]: (200, b"ax", False), urls[1]: (200, b"ay", False), urls[2]: (404, b"", False)}
    (site / "a" / "x.html").write_text("newer")
    again = read()
    assert bytes(again[urls[0]].body) == b"ax" and all(r.from_cache for r in again.values()) and again[urls[0]].fetched_at == got[urls[0]].fetched_at
    forced = read(force="true")
    assert bytes(forced[urls[0]].body) == b"newer" and not forced[urls[0]].from_cache and bytes(read()[urls[0]].body) == b"newer"
    assert {r.error for r in read(force="true", per_host="1").values()} == {None, "host parked"}
    assert set(spark.read.format("fetched_pages").options(urls=listed, cache=f"{tmp_path}/empty").load().select("error").distinct().toPandas()["error"]) == {"LookupError: no fetcher was named"}


def test_visits_are_a_join_with_the_cache(spark, tmp_path):
    from quillrock.sources import fetch

    (tmp_path / "x.html").write_text("page")
    here, gone, old = f"file://{tmp_path}/x.html", f"file://{tmp_path}/none", "http://h/old"
    cache = spark.createDataFrame([(old, 200, old, "text/html", b"kept", datetime.datetime(2026, 1, 1))], "url string, status int, final_url string, content_type string, body binary, fetched_at timestamp")
    urls = spark.createDataFrame([(here,), (gone,), (old,), (old,), (None,)], "url string")
    run = lambda **o: {r.url: (r.status, None if r.body is None else bytes(r.body), r.from_cache, r.error) for r in fetch.visited(urls, cache, "quillrock.sources.fetch:file_tree", **o).collect()}
    assert run() == {here: (200, b"page", False, None), gone: (404, b"", False, None), old: (200, b"kept", True, None)}
    assert run(force=True)[old][:3] == (404, b"", False)


def test_hosts_are_parked():
    from quillrock.sources import fetch

    host = fetch.Host(lambda u: (503, u, "", b"") if "bad" in u else (200, u, "", b""), per_host=9)
    assert [host.get(f"http://h/{x}").get("error") for x in ("bad1", "ok", "bad2", "bad3", "ok2")] == [None, None, None, None, "host parked"]


def test_every_string_is_normalised(spark):
    from quillrock.functions import deep

    a, b = "e\u0301\u09df", "\u00e9\u09af\u09bc"
    rows = [(a, [a, None], [(a, [a]), None], {a: [a], "k": None}, (1, a), 5), (None, None, [], None, None, None), ("x", [], [(None, None)], {}, (2, None), 6)]
    kind = "s string, l array<string>, n array<struct<p:string,q:array<string>>>, m map<string,array<string>>, t struct<i:int,u:string>, k int"
    df = spark.createDataFrame(rows * 3, kind).coalesce(1)
    got = [tuple(r) for r in deep.deep_nfc(df).collect()]
    fix = lambda v: b if v == a else tuple(map(fix, v)) if isinstance(v, tuple) else [fix(x) for x in v] if isinstance(v, list) else {fix(k): fix(x) for k, x in v.items()} if isinstance(v, dict) else v
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, tuple) else [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    assert [plain(r) for r in got] == [fix(r) for r in rows] * 3
    assert deep.deep_nfc(df).schema.simpleString() == df.schema.simpleString() and deep.deep_nfc(df.where("false")).count() == 0
    assert deep.deep_nfc(df.limit(2)).count() == 2


def test_addresses_to_ask_for(spark):
    rows = ["http://h.org/a b?q=é", "http://ঢাকা.example/সেবা?x=১#f", "http://h.org/%E0%A6%95", "http://h.org/plain?a=b&c=%20", None, "http://[bad", "x y"]
    got = [r.u for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select("i", urls.to_uri(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got[0] == "http://h.org/a%20b?q=%C3%A9" and got[2:5] == [rows[2], rows[3], None] and got[6] == "x%20y"
    assert got[1].isascii() and got[1].startswith("http://xn--") and got[1].endswith("#f") and got[5] is None
