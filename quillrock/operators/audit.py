"""Audits of sources, link candidates, tables by header, closures and frontiers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fees import SCANNED, whole


def robots_rules(body: Column) -> Column:
    """Struct (closed, n_disallow, delay) of a robots file: whole site closed, rules, crawl delay in seconds."""
    lines = F.transform(F.split(F.lower(body), "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    rules = F.filter(lines, lambda x: x.rlike(r"^disallow\s*:\s*\S"))
    return F.struct(
        F.exists(rules, lambda x: x.rlike(r"^disallow\s*:\s*/$")).alias("closed"),
        F.size(rules).cast("long").alias("n_disallow"),
        F.regexp_extract(F.lower(body), r"crawl-delay\s*:\s*(\d+)", 1).try_cast("int").alias("delay"),
    )


def usable_sources(categories: DataFrame, audit: DataFrame) -> DataFrame:
    """categories (id, sources) x audit (id, reachable, final_url, url): address of each reachable source."""
    wanted = categories.select(F.col("id").alias("category"), F.explode("sources").alias("source"))
    seen = audit.where("reachable").select(F.col("id").alias("source"), F.coalesce("final_url", "url").alias("url"))
    return wanted.join(seen, "source").select("category", "source", "url")


def source_problems(categories: DataFrame, audit: DataFrame) -> DataFrame:
    """(category, source, problem): sources without an audit, and audited ones that cannot be reached."""
    wanted = categories.select(F.col("id").alias("category"), F.explode("sources").alias("source"))
    j = wanted.join(audit.select(F.col("id").alias("source"), F.lit(True).alias("audited"), "reachable"), "source", "left")
    problem = F.when(F.col("audited").isNull(), "not_audited").when(~F.coalesce("reachable", F.lit(False)), "unreachable")
    return j.select("category", "source", problem.alias("problem")).where("problem is not null")


def top_candidates(links: DataFrame, good: str, bad: str, keep: int = 6, boost: int = 10) -> DataFrame:
    """links (url, pos, label, target, score): the best `keep` a page; labels like `bad` go, labels like `good` gain.

    Where several pages share an address, links of equal score and place follow by target, then label.
    """
    label = F.lower("label")
    scored = links.where(~label.rlike(bad)).withColumn("score", F.col("score") + F.when(label.rlike(good), boost).otherwise(0))
    w = Window.partitionBy("url").orderBy(F.col("score").desc(), "pos", "target", "label")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def header_columns(header: Column, words: dict[str, str]) -> Column:
    """Struct of the place (from 0) of the first header cell that matches each name's pattern; null if none does."""

    def first(pattern: str) -> Column:
        at = F.array_position(F.transform(header, lambda c: F.lower(c).rlike(pattern)), True)
        return F.when(at > 0, at.cast("int") - 1)

    return F.struct(*(first(p).alias(name) for name, p in words.items()))


def widest_table(tables: DataFrame, needed: tuple[str, ...], least: int = 3) -> DataFrame:
    """tables (id, table_no, rows): per id the table with most rows, the first of equals, whose header has all words."""
    header = F.transform(F.get("rows", F.lit(0)), F.lower)
    named = lambda word: F.exists(header, lambda c: c.contains(word))
    fits = reduce(and_, map(named, needed), F.size("rows") >= least)
    best = F.max_by(F.struct("table_no", F.size("rows").alias("n_rows")), F.struct(F.size("rows"), -F.col("table_no")))
    return tables.where(fits).groupBy("id").agg(best.alias("b")).select("id", "b.table_no", "b.n_rows")


def named_rows(rows: DataFrame, terms: DataFrame, fee_words: str) -> DataFrame:
    """Rows (id, text) that name a term or a fee. Terms are a curated table: that bounds the broadcast."""
    hit = rows.join(F.broadcast(terms.where("term <> ''")), F.contains(F.lower("text"), F.col("term")), "left_semi")
    return hit.unionByName(rows.where(F.lower("text").rlike(fee_words))).distinct()


def ungrounded(passages: DataFrame, id_col: str, text_col: str, docs: DataFrame, doc_col: str, head: int = 60, block: int = 20_000) -> DataFrame:
    """Ids of the passages that share no head with any document: neither text holds the first `head` characters of the other.

    Passages go to the executors in blocks of a bounded number, each an automaton of their heads that takes one pass over the
    documents, and one of the documents' heads over them; no pair of a passage and a document is formed unless it holds.
    """
    import ahocorasick
    import pandas as pd

    spark, found = passages.sparkSession, None
    spare = passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    blocks = max(1, -(-spare.count() // block))
    spare = spare.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    for i in range(blocks):
        sent = spark.sparkContext.broadcast([(r["id"], r["t"]) for r in spare.where(F.col("b") == i).collect()])

        def run(batches, sent=sent):
            heads, owners = ahocorasick.Automaton(), {}
            for key, t in sent.value:
                owners.setdefault(t[:head], []).append(key)
            for h, keys in owners.items():
                if h:
                    heads.add_word(h, keys)
            everywhere = set(owners.get("", ()))
            if len(heads):
                heads.make_automaton()
            hit: set = set()
            for d in batches:
                texts = d["t"].dropna()
                for t in texts if len(heads) else ():
                    for _, keys in heads.iter(t):
                        hit.update(keys)
                if len(texts):
                    hit |= everywhere
                short = ahocorasick.Automaton()
                for h in {t[:head] for t in texts}:
                    if h:
                        short.add_word(h, h)
                    else:
                        hit.update(k for k, _ in sent.value)
                if len(short):
                    short.make_automaton()
                    hit.update(k for k, t in sent.value if k not in hit and next(short.iter(t), None))
            yield pd.DataFrame({"id": sorted(hit)})

        kind = spare.schema["id"].dataType.simpleString()
        got = docs.select(F.col(doc_col).alias("t")).mapInPandas(run, f"id {kind}").distinct()
        found = got if found is None else found.unionByName(got)
    return spare.select("id").join(found, "id", "left_anti").select(F.col("id").alias(id_col))


def frontier(wanted: DataFrame, seen: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Actions that have not been taken, each once, the first of equals."""
    first = wanted.groupBy(*keys).agg(F.min(place).alias(place))
    return first.join(seen.select(*keys).distinct(), keys, "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) pairs reachable over edges (src, dst); each round doubles the reach, until one adds nothing.

    For maps of one font, which are small. A round's table is let go when the next one stands.
    """
    reach = edges.select("src", "dst").distinct().cache()
    size = reach.count()
    while True:
        step = reach.select(F.col("src"), F.col("dst").alias("mid")).join(reach.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        wider = reach.unionByName(step).distinct().cache()
        n = wider.count()
        reach.unpersist()
        if n == size:
            return wider
        reach, size = wider, n


def fee_table_amounts(markdown: Column) -> Column:
    """Amounts of the rows of an answer's fee table, as written there without commas; free is 0."""
    section = F.regexp_extract(markdown, r"(?s)### Fees\n(.*?)(?:\n\n|$)", 1)
    rows = F.filter(F.split(section, "\n"), lambda r: r.rlike(r"^\|.*\|$"))
    last = F.transform(rows, lambda r: F.trim(F.regexp_extract(r, r"\|([^|]*)\|$", 1)))
    number = lambda c: F.when(c == "Free", F.lit(0).cast("long")).otherwise(F.replace(F.regexp_extract(c, r"([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("long"))
    return F.filter(F.transform(last, number), lambda x: x.isNotNull())


def unsupported_amounts(printed: DataFrame, known: DataFrame) -> DataFrame:
    """Printed amounts (category, amount) that no record of the category holds."""
    return printed.join(known.select("category", "amount").distinct(), ["category", "amount"], "left_anti")


def scanned_amounts(lines: DataFrame, floor: float = 0.8) -> DataFrame:
    """(id, amount, reported): every number of two digits or more in recognised lines (id, line, confidence); below the floor it is kept but not reported."""
    found = lines.select("id", "confidence", F.explode(F.regexp_extract_all("line", F.lit(SCANNED), 0)).alias("x"))
    return found.select("id", whole(F.col("x")).alias("amount"), (F.col("confidence") >= floor).alias("reported"))
