"""Reference operators on literal rows, and every catalogue query against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrock.functions import dates, fees, text
from quillrock.plans import audits, catalogue, ingest, planted  # noqa: F401  these register their queries
from quillrock.streaming import feedback, rate_limit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        return
    out = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    rows = [dict(zip(names, r, strict=True)) for r in out.fetchall()]
    assert got == sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)


def test_age_words(spark):
    got = [r[0] for r in spark.createDataFrame([(90,), (364,), (365,), (731,)], "d int").select(dates.age_text(F.col("d"))).collect()]
    assert got == ["90 days ago", "364 days ago", "about 1 year, 0 days ago", "about 2 years, 1 days ago"]


def test_numbers(spark):
    got = spark.createDataFrame([("BDT 4,025 and 007, ৩৪৫ and 0",)], "t string").select(text.number_set(F.col("t"))).first()[0]
    assert sorted(got) == ["0", "345", "4025", "7"]


def test_clip_and_slug(spark):
    r = spark.createDataFrame([("abcdef", "http://x.org/a b?c")], "t string, u string").select(text.clip(F.col("t"), 3), text.slug(F.col("u"))).first()
    assert r[0] == "abc …" and r[1].startswith("x.org_a_b_c_") and len(r[1]) == 20


def model(t):
    """Items of a numbered list, in plain Python."""
    import re

    t = " ".join(t.split())
    marks, want = [], 1
    for m in re.finditer(r"(?:^|(?<=[\s;।]))([০-৯]{1,2})\)", t):
        if int(m[1]) == want:
            marks.append(m.start())
            want += 1
    if not marks:
        return [t] if t else []
    return [p for a, b in zip(marks, [*marks[1:], len(t)], strict=True) if len(p := t[a:b].strip()) > 12]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["১) ", "২) ", "৩) ", "৭) ", "some words here ", "x; ", "১২ ", "- "]), max_size=12).map("".join), min_size=1, max_size=20))
def test_numbered_lists(spark, cells):
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(fees.split_numbered(F.col("c"))).collect()]
    assert got == [model(c) for c in cells]


def test_feedback_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [("2026-01-01 00:00:00", "q", "n", "a" * 900)]
    spark.createDataFrame(rows, "at string, query string, note string, answer string").write.json(str(source))
    stream = feedback.review_queue(spark.readStream.schema(feedback.SCHEMA).json(str(source)))
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    r = spark.read.parquet(str(out)).first()
    assert len(r.answer_excerpt) == 500 and r.status == "unreviewed"


def test_rate_limit(spark, tmp_path):
    rows = [("a", 0, 0.0, 200, None, 0.0), ("a", 1, 2.0, 200, None, 0.0), ("b", 0, 0.0, 429, None, 0.0), ("b", 1, 100.0, 429, None, 0.0), ("b", 2, 200.0, 200, None, 0.0)]
    rows += [("c", i, 10.0 * i, 200, None, 0.0) for i in range(26)]
    schema = "host string, seq long, ts double, status int, retry_after double, jitter double"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.json(source)
    q = rate_limit.limit(spark.readStream.schema(schema).json(source)).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.host, r.seq): (r.verdict, r.wait) for r in spark.table("limited").collect()}
    assert got[("a", 0)][0] == "ALLOW" and got[("a", 1)] == ("WAIT", 4.0)
    assert got[("b", 0)] == ("WAIT", 20.0) and got[("b", 1)][0] == "PARKED" and got[("b", 2)][0] == "PARKED"
    assert got[("c", 24)][0] == "ALLOW" and got[("c", 25)][0] == "PARKED"
