"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Base kinds (email, ip, card, phone) are fixed by pattern and check and always reported. IBANs (mod 97) and
US social security numbers are added where their score reaches `least`. Built-in functions only, one pass,
no shuffle. The patterns are written with possessive repeats and look-behinds that keep the leftmost
matches but make one pass over long runs.

Odd cases: null text counts as empty; ids may be null or repeat, rows stay one to one; extra columns are ignored; spans
that begin together stand in the order of the kinds; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import joined, none_of, with_matches

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Strings of which every match of the kind holds one.
MARKS = {"email": ("@",), "ip": (".",), "phone": ("+",)}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span without context, and words that raise it (fixed values).
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|courriel|correo|kontakt",
    "ip": "address|server|host|login|adresse",
    "card": "card|credit|visa|carte|karte|tarjeta|payment",
    "phone": "phone|call|tel|mobile|telefon|llamar",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "struct<start:long,rank:int,end:long,kind:string,score:double>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN's digits, A as 10 to Z as 35, its first four characters moved to the end."""
    s = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(s, 5, 64), F.left(s, F.lit(4)))
    code = lambda c: F.ascii(c)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(code(c) >= 65, (a * 100 + code(c) - 55) % 97).otherwise((a * 10 + code(c) - 48) % 97))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda m: F.length(digits(m)).between(14, 19) & F.call_function("luhn_check", digits(m)),
    "phone": lambda m: F.length(digits(m)).between(10, 15),
    "iban": lambda m: mod97(m) == 1,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9..)|-00-|0000$"),
}


def _spans(kind: str, rank: int) -> Column:
    near = lambda x: F.concat_ws(" ", x["before"], x["after"]).rlike(f"(?i){CONTEXT[kind]}")
    shape = lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"),
        (F.lit(SCORES[kind]) + F.when(near(x), F.lit((1 - SCORES[kind]) / 2)).otherwise(F.lit(0.0))).alias("score"),
    )
    return F.coalesce(F.transform(F.filter(f"m_{kind}", lambda x: CHECKS[kind](x["m"])), shape), none_of(SPAN))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 48, least: float = 0.5) -> DataFrame:
    """One row per input row: id, base and spans as arrays of (start, rank, end, kind, score)."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = with_matches(df, "text", PATTERNS, context, MARKS)
    base, more = [], []
    for rank, kind in enumerate(PATTERNS):
        spans = _spans(kind, rank)
        (base if kind in BASE else more).append(spans)
    df = df.select("id", F.concat(*base).alias("base"), F.concat(*more).alias("more"))
    return df.select("id", "base", F.concat("base", F.filter("more", lambda x: x["score"] >= least)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind, of="base": F.size(F.filter(of, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count("iban", "spans"), count("ssn", "spans"), F.round(F.array_max(F.transform("spans", lambda x: x["score"])), 3).alias("max_score"),
    )
