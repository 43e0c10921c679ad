"""What is done once a row, and texts that are looked at once."""

import numpy as np
from pyspark.sql import functions as F

from quillrock.functions import embed, fonts
from quillrock.operators import conform, tools


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_once_by_both_tools(spark, tmp_path):
    bodies = spark.createDataFrame([("u", "plain words about an office and its service, in a line", True, False)], "url string, text string, is_pdf boolean, corrected boolean")
    bodies.write.parquet(f"{tmp_path}/bodies")
    pages = spark.createDataFrame([], "url string, html string")
    calls = spark.createDataFrame([(1, "detect_pdf", {"url": "u"}), (2, "decode_pdf", {"url": "u"})], "call_id int, tool string, args map<string,string>")
    got = tools.answer(calls, pages, spark.read.parquet(f"{tmp_path}/bodies"))
    assert plan(got).count("parquet") == 1 and sorted((r.tool, r.ok) for r in got.collect()) == [("decode_pdf", True), ("detect_pdf", True)]


def test_routing_is_one_pass(spark, tmp_path):
    spark.createDataFrame([("x",)], "text string").write.parquet(f"{tmp_path}/t")
    assert plan(fonts.routed(spark.read.parquet(f"{tmp_path}/t"), {})).count("parquet") == 1


def test_decoder_makes_no_step_a_character():
    d = fonts.Decoder({"a": "ক", "ab": "খ", "]": "গ"})
    assert len(d.longer.findall("x" * 500)) == 0 and not hasattr(d, "token")
    assert d.decode("aab](cid:7)é z") == ("কখগ(cid:7)é z", 1 - 2 / 6)


def test_distinct_grams_are_hashed_once(monkeypatch):
    asked, real = [], embed.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(embed.xxhash, "xxh3_64_intdigest", lambda x: asked.append(x) or real(x))
    got = embed.HashedGrams(16)(["ab " * 300, "ab ab"])
    assert len(asked) == len(set(asked)) < 20
    want = np.zeros(16)
    for n in (2, 3):
        for j in range(7 - n + 1):
            h = real(" ab ab "[j : j + n])
            want[h % 16] += 1 if h >> 63 else -1
    assert np.array_equal(got[1], want)


def test_type_of_a_value_is_told_once(spark):
    schema = {"type": "object", "properties": {"a": {"type": ["string", "null"], "minLength": 1}}, "additionalProperties": False}
    df = spark.createDataFrame([(1, '{"a": "", "b": 1}')], "path int, body string")
    got = conform.check(df, schema)
    assert plan(got).count("schemaOfVariant(") == 2
    assert sorted((r["at"], r["rule"]) for r in got.collect()) == [("", "additionalProperties"), ("a", "minLength")]
