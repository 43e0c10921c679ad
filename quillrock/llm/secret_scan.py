"""Secret scans: candidates by pattern, judged by how widely their hashes are owned.

Base candidates are fixed by three patterns. Further candidates (private-key headers, vendor tokens, signed
web tokens, long mixed strings) are reported only if they look live: a hash that fewer than
`copied_owners` owners and fewer than `copied_repos` repositories hold. A hash that more of either hold is a
widely copied example. A repository counts once for each of its owners. The counts cover the whole corpus. Built-in functions only; secret values never leave the scan, only their hashes.

Odd cases: null text counts as empty; null owners and repositories are one owner and one repository;
repeated rows are reported each, and count once towards ownership; extra columns are ignored; spans that begin
together stand in the order of the kinds; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_join
from .spans import joined, none_of, with_matches

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in their order, then the added ones.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "pem": r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----",
    "vendor": r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,})",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "mixed": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}",
}
#: Strings of which every match of the kind holds one.
MARKS = {"access": ("AKIA",), "pem": ("-----BEGIN ",), "vendor": ("gh", "xox", "AIza", "sk_live_"), "jwt": ("eyJ",)}
BASE = ("assign", "access", "hex")
CANDIDATE = "struct<start:long,rank:int,end:long,kind:string,hash:long>"


def _found(kind: str, rank: int) -> Column:
    """Candidates of one kind; a match that fails its check is dropped."""
    spans = F.col(f"m_{kind}")
    value = (lambda x: F.regexp_extract(x["m"], ASSIGN, 2)) if kind == "assign" else (lambda x: x["m"])
    if kind == "assign":
        spans = F.filter(spans, lambda x: F.length(value(x)) >= 6)
    if kind == "mixed":
        spans = F.filter(spans, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]"))
    shape = lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), F.xxhash64(value(x)).alias("hash")
    )
    return F.coalesce(F.transform(spans, shape), none_of(CANDIDATE))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(id, owner, repo, row, found): found holds every candidate with the hash of its value."""
    df = docs.select(
        F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    df = with_matches(df, "text", PATTERNS, marks=MARKS)
    found = [_found(kind, rank) for rank, kind in enumerate(PATTERNS)]
    return df.select("id", "owner", "repo", F.monotonically_increasing_id().alias("row"), F.concat(*found).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos, uses) over all candidates. Each step shuffles what the one before has summed."""
    each = found.select("owner", "repo", F.explode("found.hash").alias("hash")).groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", copied_owners: int = 3, copied_repos: int = 4) -> DataFrame:
    """One row per input row: id, base and spans as arrays of (start, rank, end, kind), n_copied, n_live, max_owners, max_repos."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.table(candidates(docs, id_col, text_col, owner_col, repo_col), "found")
    owned = ownership(found)
    each = found.where(F.size("found") > 0).select("id", "row", F.explode("found").alias("f")).select("id", "row", F.col("f.hash").alias("hash"), "f")
    judged = split_join(each, owned, "hash", F.col("row"), "left")
    live = (F.col("owners") < copied_owners) & (F.col("repos") < copied_repos)
    span = F.struct(F.col("f.start"), F.col("f.rank"), F.col("f.end"), F.col("f.kind"))
    base = F.col("f.rank") < len(BASE)
    per = judged.groupBy("id", "row").agg(
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(base | live, span)).alias("spans"),
        F.count(F.when(~live, 1)).alias("n_copied"),
        F.count(F.when(live, 1)).alias("n_live"),
        F.max("owners").alias("max_owners"),
        F.max("repos").alias("max_repos"),
    )
    kind = "struct<start:long,rank:int,end:long,kind:string>"
    zero = F.lit(0).cast("long")
    rest = found.where(F.size("found") == 0).select("id", "row", none_of(kind).alias("base"), none_of(kind).alias("spans"), zero.alias("n_copied"), zero.alias("n_live"), zero.alias("max_owners"), zero.alias("max_repos"))
    return per.unionByName(rest).drop("row")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_copied", "n_live", "max_owners", "max_repos")
