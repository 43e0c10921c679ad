"""Text of legacy fonts: substitution of code points, order of vowel signs, coverage, character maps of PDF fonts.

Tables are given by the caller: a mapping of source strings to Unicode. Greedy matching has no built-in function,
so these run in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import squeeze

#: Bengali signs that are written before their consonant, two-part signs by their tail, and the mark that joins consonants (fixed values).
BEFORE = "িেৈ"
TAILS = {"া": "ো", "ৗ": "ৌ"}
JOIN = "্"
#: A consonant, and a cluster of consonants (fixed ranges).
LETTER = "[ক-হৎড়-য়]"
CLUSTER = f"{LETTER}(?:{JOIN}{LETTER})*"
#: What an extractor writes for a glyph that it cannot map (fixed format).
GLYPH = re.compile(r"\(cid:\d+\)")
#: ASCII marks that legacy text holds as they are (fixed values).
MARKS = set(" \t\n\r.,:;()[]/%-\"'")
#: Code points that only legacy fonts put into Latin text (fixed values).
JUNK = "[†‡¶¸©®÷¤×Ÿ„‹›Œž¥£¢±º»½¾]"
#: Known share of glyphs from which a decoded text is taken.
ENOUGH = 0.7

_VISUAL = re.compile(f"([{BEFORE}])({CLUSTER})([{''.join(TAILS)}]?)")


def logical(text: str) -> str:
    """Visual to logical order: a sign before a cluster goes behind it; with a tail both make one sign."""

    def turn(m: re.Match) -> str:
        sign, cluster, tail = m.groups()
        if tail and sign == "ে":
            return cluster + TAILS[tail]
        return cluster + sign + tail

    return _VISUAL.sub(turn, text)


_REPH = re.compile(f"({CLUSTER})([া-ৌ]*)র{JOIN}")


def raised_r(text: str) -> str:
    """The joined r that is typed behind the cluster it is spoken before, put before it, inside a word as at its end."""
    return _REPH.sub(lambda m: f"র{JOIN}{m[1]}{m[2]}", text)


class Decoder:
    """Longest match first; markers of unmapped glyphs stay as they are and count as unknown, each once."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        longer = sorted((k for k in table if len(k) > 1), key=len, reverse=True)
        self.longer = re.compile(f"({'|'.join([GLYPH.pattern, *map(re.escape, longer)])})")
        self.single = str.maketrans({k: v for k, v in table.items() if len(k) == 1})
        self.unknown = re.compile(f"[^\\s0-9A-Za-z{''.join(map(re.escape, sorted(MARKS.union(k for k in table if len(k) == 1))))}]")

    def decode(self, text: str) -> tuple[str, float]:
        """Text in logical order and NFC, and the share of glyphs that were known."""
        # longer keys and markers are cut out first; what lies between has one character a key
        parts = self.longer.split(text)
        unknown = len(self.unknown.findall("".join(parts[::2]))) + sum(p not in self.table for p in parts[1::2])
        total = len("".join(GLYPH.sub("", text).split()))
        parts[::2] = [p.translate(self.single) for p in parts[::2]]
        parts[1::2] = [self.table.get(p, p) for p in parts[1::2]]
        plain = raised_r(logical("".join(parts)))
        return unicodedata.normalize("NFC", plain), 1.0 - unknown / max(total, 1)


def decode(text: Column, table: dict[str, str]) -> Column:
    """Struct (text, coverage)."""

    @F.pandas_udf("text string, coverage double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(table)
        for s in batches:
            yield pd.DataFrame([(None, None) if x is None else decoder.decode(x) for x in s], columns=["text", "coverage"])

    return run(text)


@F.pandas_udf(StringType())
def to_logical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else logical(x))


def unmapped(line: Column) -> Column:
    """Whether a line holds a glyph that nobody decoded; no amount may be read from it."""
    return line.contains("(cid:")


def encoding(text: Column, is_pdf: Column | None = None, corrected: Column | None = None, least: int = 40) -> Column:
    """One of not_a_pdf, empty, legacy_bijoy, legacy_unknown, plain, nikosh_cmap, by the script of a text.

    is_pdf: whether the body it came from is a PDF (None: it is no matter); corrected: whether its fonts have glyphs whose
    map is wrong, which alone tells a Bengali text with a broken map from a plain one.
    """
    size = F.greatest(F.length(text), F.lit(1))
    bengali = F.regexp_count(text, F.lit("[\u0980-\u09ff]")) / size
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), 0)
    wordish = F.size(F.filter(words, lambda x: x.rlike("[aeiouAEIOU]") & (F.length(x) <= 14))) / F.greatest(F.size(words), F.lit(1))
    kind = (
        F.when(text.isNull() | (F.length(squeeze(text)) < least), "empty")
        .when((bengali < 0.05) & (F.regexp_count(text, F.lit(JUNK)) > 5), "legacy_bijoy")
        .when((bengali < 0.05) & (F.size(words) >= 20) & (wordish < 0.55), "legacy_unknown")
        .when((bengali >= 0.05) & F.coalesce(F.lit(False) if corrected is None else corrected, F.lit(False)), "nikosh_cmap").otherwise("plain")
    )
    return kind if is_pdf is None else F.when(~F.coalesce(is_pdf, F.lit(False)), "not_a_pdf").otherwise(kind)


def readable(kind: Column) -> Column:
    """Classes that a decoder exists for."""
    return kind.isin("nikosh_cmap", "legacy_bijoy", "plain")


def routed(texts: DataFrame, table: dict[str, str], text: str = "text", is_pdf: str | None = None, corrected: str | None = None) -> DataFrame:
    """texts with `encoding`, `decoded` (null: refused) and `coverage` (of legacy text), each class read by its own decoder.

    One pass, in which a text is classified once; plain text never meets Python, which is given nulls in its place.
    """
    kind = encoding(F.col(text), None if is_pdf is None else F.col(is_pdf), None if corrected is None else F.col(corrected))
    named = texts.withColumn("encoding", kind)
    of = lambda x: F.when(F.col("encoding") == x, F.col(text))
    read = named.withColumns({"__v": to_logical(of("nikosh_cmap")), "__d": decode(of("legacy_bijoy"), table)})
    plain = F.when(F.col("encoding") == "plain", F.col(text)).when(F.col("encoding") == "nikosh_cmap", F.col("__v")).when(F.col("__d.coverage") >= ENOUGH, F.col("__d.text"))
    return read.withColumns({"decoded": plain, "coverage": F.col("__d.coverage")}).drop("__v", "__d")


def _text_of(digits: str) -> str:
    """UTF-16 code units in hexadecimal, padded in front to whole units."""
    digits = digits.zfill(-(-len(digits) // 4) * 4)
    return "".join(chr(int(digits[i : i + 4], 16)) for i in range(0, len(digits), 4))


_BLOCK = re.compile(r"begin(bfchar|bfrange)(.*?)end\1", re.S)
_PAIR = re.compile(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>")
_RANGE = re.compile(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])")


def character_map(stream: str) -> dict[int, str]:
    """Code to text of a ToUnicode stream: single codes, ranges that count up, ranges with a list. Later entries win."""
    out: dict[int, str] = {}
    singles = [m[2] for m in _BLOCK.finditer(stream) if m[1] == "bfchar"]
    ranges = [m[2] for m in _BLOCK.finditer(stream) if m[1] == "bfrange"]
    for body in singles:
        out.update((int(code, 16), _text_of(to)) for code, to in _PAIR.findall(body))
    for body in ranges:
        for low, high, first, listed in _RANGE.findall(body):
            start, end = int(low, 16), int(high, 16)
            if first:
                base = _text_of(first)
                steps = range(min(end - start + 1, 65536) if end - start < 65536 else 0)
                out.update((start + i, base[:-1] + chr(ord(base[-1]) + i)) for i in steps if ord(base[-1]) + i < 0x110000)
            else:
                out.update((start + i, _text_of(x)) for i, x in enumerate(re.findall(r"<([0-9A-Fa-f]+)>", listed)))
    return out


def character_maps(streams: DataFrame) -> DataFrame:
    """streams (font, stream) -> font, code, text: one row an entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(font, code, to) for font, s in zip(b["font"], b["stream"], strict=True) if s is not None for code, to in sorted(character_map(s).items())]
            yield pd.DataFrame(rows, columns=["font", "code", "text"])

    return streams.select("font", "stream").mapInPandas(run, "font string, code long, text string")


def glyph_texts(glyphs: DataFrame) -> DataFrame:
    """glyphs (font, gid, name) -> font, gid, text of glyphs whose name states their code point."""
    code = F.regexp_extract("name", "^uni([0-9A-Fa-f]{4})$", 1)
    return glyphs.where(code != "").select("font", "gid", chr_of(F.conv(code, 16, 10).cast("int")).alias("text"))


def chr_of(code: Column) -> Column:
    """The character of a code point below 65536; Spark's char() stops at 255."""
    two = F.lpad(F.hex(code), 4, "0")
    return F.decode(F.unhex(two), "UTF-16BE")


def substituted(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(font, name, text) closed under substitutions: rules (font, parts array<string>, name) give a glyph the joined text of its parts.

    A glyph keeps the text that it has; of several rules that fit in a round the least text counts. Fonts are small;
    rounds go on until one adds nothing.
    """
    known = names.select("font", "name", "text").distinct().cache()
    size = known.count()
    each = rules.select("font", "parts", F.col("name").alias("to"), F.posexplode("parts").alias("pos", "name"))
    while True:
        got = each.join(known, ["font", "name"]).groupBy("font", "parts", "to").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
        whole = got.where(F.size("t") == F.size("parts")).select("font", F.col("to").alias("name"), F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))
        new = whole.groupBy("font", "name").agg(F.min("text").alias("text")).join(known, ["font", "name"], "left_anti")
        wider = known.unionByName(new).cache()
        n = wider.count()
        known.unpersist()
        if n == size:
            return wider
        known, size = wider, n


def corrections(maps: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(font, code, was, text): what the font says where its character map says otherwise or nothing."""
    j = glyphs.select("font", F.col("gid").alias("code"), "text").join(maps.select("font", "code", F.col("text").alias("was")), ["font", "code"], "left")
    return j.where(~F.col("was").eqNullSafe(F.col("text"))).select("font", "code", "was", "text")
