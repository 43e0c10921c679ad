"""NFC: what does not meet Python is what it would not change."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillrock.functions import text


def test_nfc_of_all_points_and_pairs(spark):
    rng = random.Random(5)
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    odd = [p for p in points if unicodedata.combining(chr(p)) or unicodedata.decomposition(chr(p))] + [*range(0x1100, 0x1200), *range(0x980, 0xA00)]
    cases = [f"a{chr(p)}b" for p in points[:200_000:7] + odd] + ["".join(chr(rng.choice(odd if rng.random() < 0.8 else points)) for _ in range(4)) for _ in range(60_000)]
    for p in odd:
        d = unicodedata.normalize("NFD", chr(p))
        cases += [d, f"x{d}y"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", text.nfc(F.col("t")).alias("t"))
    wrong = [(cases[r.i], r.t) for r in df.collect() if r.t != unicodedata.normalize("NFC", cases[r.i])]
    assert not wrong


def test_settled_text_stays_in_the_engine(spark):
    one = spark.createDataFrame([("TK 100 হাল নাগাদ 5 মার্চ 2021 déjà",), (None,)], "t string")
    assert one.where(F.col("t").rlike(text._unsettled())).count() == 0
    assert [r.t for r in one.select(text.nfc(F.col("t")).alias("t")).collect()] == ["TK 100 হাল নাগাদ 5 মার্চ 2021 déjà", None]
    assert not re.search("é", one.first().t)
