"""Fetching as a source: addresses by host, answered from the cache of raw bodies, else asked for.

Two forms of one thing. `visited` is a join: addresses that the cache holds never meet Python, the others go to the
fetcher host by host. The format "fetched_pages" is the same as a Spark source, for caches and lists that lie in a
folder that driver and executors can open; its partitions are hosts. A fetcher is a function named as
"module:function" that takes an address and gives (status, final address, content type, body); what it raises is an
answer with an error. Nothing here opens a network connection by itself.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, host string, status int, final_url string, content_type string, body binary, bytes long, fetched_at timestamp, from_cache boolean, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Requests that a run makes of one host; further addresses are answered by an error (fixed value).
PER_HOST = 25
BLOCKED = (403, 429, 503)


def fetcher_of(name: str) -> Callable[[str], tuple[int, str, str, bytes]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Host:
    """One host's requests: a budget, a pause between them, and a stop after `blocks` refusals in a row."""

    def __init__(self, ask: Callable, per_host: int = PER_HOST, pause: float = 0.0, blocks: int = 2):
        self.ask, self.left, self.pause, self.blocks, self.refused, self.last = ask, per_host, pause, blocks, 0, None

    def get(self, url: str) -> dict:
        out = {"url": url, "host": urlsplit(url).netloc, "from_cache": False, "fetched_at": datetime.now(UTC).replace(tzinfo=None)}
        if self.left <= 0 or self.refused >= self.blocks:
            return out | {"error": "host parked"}
        if self.last is not None and self.pause:
            time.sleep(max(0.0, self.pause - (time.monotonic() - self.last)))
        self.left, self.last = self.left - 1, time.monotonic()
        try:
            status, final, kind, body = self.ask(url)
        except Exception as e:  # an answer, so that one page does not end a run
            return out | {"error": f"{type(e).__name__}: {e}"}
        self.refused = self.refused + 1 if status in BLOCKED else 0
        return out | {"status": status, "final_url": final, "content_type": kind, "body": body, "bytes": len(body)}


def visited(urls: DataFrame, cache: DataFrame, fetcher: str, force: bool = False, **limits) -> DataFrame:
    """SCHEMA of urls (url): those of `cache` (url, status, final_url, content_type, body, fetched_at), one row an address, and the fetcher's answers to the rest.

    force: the fetcher answers all. Each address is asked for once; a host's addresses are asked for in one task, in order.
    What is new can be added to the cache (sinks.write_raw).
    """
    wanted = urls.where("url is not null").select("url").distinct()
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    known = wanted.join(cache, "url").withColumns({"host": host, "bytes": F.octet_length("body").cast("long"), "from_cache": F.lit(True), "error": F.lit(None).cast("string")}).select(*NAMES)
    missing = wanted if force else wanted.join(cache.select("url"), "url", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts, get = {}, fetcher_of(fetcher)
        for pdf in batches:
            rows = [hosts.setdefault(h, Host(get, **limits)).get(u) for h, u in zip(pdf["host"], pdf["url"], strict=True)]
            yield pd.DataFrame(rows, columns=NAMES, dtype=object).replace({float("nan"): None})

    asked = missing.select("url", host.alias("host")).repartition("host").sortWithinPartitions("host", "url").mapInPandas(ask, SCHEMA)
    return asked if force else known.unionByName(asked)


def write_list(urls: DataFrame, path: str) -> None:
    """Addresses (url) as the format's list: a folder with a part for each host."""
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    urls.where("url is not null").select(host.alias("host"), "url").distinct().repartition("host").write.mode("overwrite").partitionBy("host").text(path)


def cached_at(cache: str, url: str) -> str:
    """Where a body lies: by host, named by the address's hash; what is known of it stands beside it as JSON."""
    return os.path.join(cache, quote(urlsplit(url).netloc, "") or "_", hashlib.sha1(url.encode()).hexdigest())


class HostPart(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class FetchedPages(DataSource):
    """spark.read.format("fetched_pages").options(urls=..., cache=..., fetcher="module:function", force="false", per_host="25", pause="6").load()"""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)


class FetchReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.cache, self.fetcher = options["urls"], options["cache"], options.get("fetcher")
        self.force = options.get("force", "false").lower() == "true"
        self.limits = {"per_host": int(options.get("per_host", PER_HOST)), "pause": float(options.get("pause", 0))}

    def partitions(self) -> list[InputPartition]:
        """Only the hosts' names reach the driver."""
        return [HostPart(os.path.join(self.urls, x)) for x in sorted(os.listdir(self.urls)) if x.startswith("host=")] or [HostPart("")]

    def read(self, partition: HostPart) -> Iterator[tuple]:
        host = None
        names = sorted(x for x in os.listdir(partition.folder) if not x.startswith((".", "_"))) if partition.folder else []
        for name in names:
            with open(os.path.join(partition.folder, name), encoding="utf-8") as lines:
                for url in map(str.rstrip, lines):
                    at = cached_at(self.cache, url)
                    row = None if self.force else self._known(at)
                    if row is None:
                        host = host or Host(fetcher_of(self.fetcher) if self.fetcher else _nothing, **self.limits)
                        row = host.get(url)
                        self._keep(at, row)
                    yield tuple(row.get(c) for c in NAMES)

    def _known(self, at: str) -> dict | None:
        if not (os.path.exists(at) and os.path.exists(f"{at}.json")):
            return None
        with open(f"{at}.json", encoding="utf-8") as f, open(at, "rb") as b:
            body, known = b.read(), json.load(f)
        return known | {"body": body, "bytes": len(body), "from_cache": True, "fetched_at": datetime.fromisoformat(known["fetched_at"])}

    def _keep(self, at: str, row: dict) -> None:
        """Body and JSON appear whole or not at all: a task that is run twice or lost leaves no half of either."""
        if row.get("error") or row.get("body") is None:
            return
        os.makedirs(os.path.dirname(at), exist_ok=True)
        known = {k: v for k, v in row.items() if k not in ("body", "bytes", "from_cache")} | {"fetched_at": row["fetched_at"].isoformat()}
        for path, data in ((at, row["body"]), (f"{at}.json", json.dumps(known, ensure_ascii=False).encode())):
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)


def _nothing(url: str):
    raise LookupError("no fetcher was named")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FetchedPages)


def file_tree(url: str) -> tuple[int, str, str, bytes]:
    """A fetcher over a local tree: file://root/host-less paths, or `QUILLROCK_SITE`/host/path for others; for tests and mirrors."""
    p = urlsplit(url)
    path = unquote(p.path) if p.scheme == "file" else os.path.join(os.environ.get("QUILLROCK_SITE", "."), p.netloc, unquote(p.path).strip("/") or "index.html")
    if not os.path.isfile(path):
        return 404, url, "", b""
    with open(path, "rb") as f:
        return 200, url, "application/pdf" if path.endswith(".pdf") else "text/html", f.read()
