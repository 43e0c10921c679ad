"""A cell is cleaned once, however many of its figures are asked for."""

from pyspark.sql import functions as F

from quillrock.functions import fees


def test_cell_is_cleaned_once(spark):
    df = spark.createDataFrame([("ক) ছোট ৫২০/-টাকা (ভ্যাটসহ) (খ) বড় ৬২০/- টাকা",), ("",), (None,), ("বিনামূল্যে",)], "c string")
    read = df.select(fees.parse_fee_cell(F.col("c")).alias("p")).select("p.amounts", "p.outcome")
    assert [(r.amounts, r.outcome) for r in read.collect()] == [([520, 620], "split"), ([], "empty"), ([], "empty"), ([0], "free")]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)") <= 4
