"""A bounded agent over tables: a registry of tools that never raise, policies, a trace.

An episode is a small driver loop (a step names one tool call); what a tool does may be a whole Spark job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "step int, tool string, args string, ok boolean, result string"
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


@dataclass
class Tool:
    """A function, what it is for, and the kinds of its arguments by name; those in `optional` may be left out."""

    run: Callable[..., Any]
    about: str
    args: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()


class Registry:
    """Tools by name. `call` answers every call: an unknown tool, wrong arguments and a raising tool are results as well."""

    def __init__(self, tools: dict[str, Tool]):
        self.tools = dict(tools)

    def schema(self) -> list[dict]:
        """JSON schemas of all tools."""
        shape = lambda t: {"type": "object", "properties": {a: {"type": k} for a, k in t.args.items()}, "required": [a for a in t.args if a not in t.optional]}
        return [{"name": name, "description": t.about, "parameters": shape(t)} for name, t in sorted(self.tools.items())]

    def call(self, name: str, args: dict[str, Any]) -> tuple[bool, Any]:
        tool = self.tools.get(name)
        if tool is None:
            return False, f"unknown tool {name}; known: {', '.join(sorted(self.tools))}"
        odd = [a for a in args if a not in tool.args] + [a for a in tool.args if a not in tool.optional and a not in args]
        odd += [a for a, k in tool.args.items() if a in args and not isinstance(args[a], KINDS[k])]
        if odd:
            return False, f"{name}: wrong or missing arguments {', '.join(sorted(set(odd)))}"
        try:
            return True, tool.run(**args)
        except Exception as e:  # the agent reads the failure and goes on
            return False, f"{type(e).__name__}: {e}"


class Policy(Protocol):
    def next_action(self) -> tuple[str, dict[str, Any]] | None:
        """The next call, or None to stop."""

    def observe(self, name: str, args: dict[str, Any], ok: bool, result: Any) -> None: ...


class Queue:
    """A policy that works through planned calls, each once; `follow` may plan more from a result."""

    def __init__(self, planned: list[tuple[str, dict[str, Any]]], follow: Callable[[str, dict, Any], list[tuple[str, dict]]] | None = None):
        self.waiting, self.follow, self.taken = list(planned), follow, set()

    def next_action(self):
        while self.waiting:
            name, args = self.waiting.pop(0)
            key = name, json.dumps(args, sort_keys=True, default=str)
            if key not in self.taken:
                self.taken.add(key)
                return name, args
        return None

    def observe(self, name, args, ok, result):
        if ok and self.follow:
            self.waiting += self.follow(name, args, result)


def shown(result: Any, chars: int = 4000) -> str:
    """A result as JSON, cut with a mark that says how much is missing."""
    text = result if isinstance(result, str) else json.dumps(result, ensure_ascii=False, default=str)
    return text if len(text) <= chars else f"{text[:chars]} … [{len(text) - chars} more]"


def episode(spark: SparkSession, registry: Registry, policy: Policy, most: int = 15, chars: int = 4000) -> DataFrame:
    """The trace of at most `most` steps."""
    rows = []
    while len(rows) < most and (action := policy.next_action()) is not None:
        name, args = action
        ok, result = registry.call(name, args)
        policy.observe(name, args, ok, result)
        rows.append((len(rows), name, json.dumps(args, ensure_ascii=False, sort_keys=True, default=str), ok, shown(result, chars)))
    return spark.createDataFrame(rows, TRACE)


def retried(attempts: DataFrame, blocked: tuple[int, ...] = (403, 429, 503)) -> DataFrame:
    """attempts (url, seq, status) -> url, tries, status, outcome: a blocked first answer is asked for once more.

    outcome: 'ok' at once, 'recovered' by the second try, 'blocked' by both, 'waiting' where the second is still due,
    'failed' for any other status. Later attempts don't count.
    """
    two = attempts.groupBy("url").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "status"))), 1, 2).alias("a"))
    status = lambda i: F.get("a", F.lit(i))["status"]
    stopped = lambda c: F.coalesce(c.isin(*blocked), F.lit(False))
    good = lambda c: c.between(200, 399)
    again = stopped(status(0))
    last = F.when(again & status(1).isNotNull(), status(1)).otherwise(status(0))
    outcome = F.when(good(status(0)), "ok").when(again & status(1).isNull(), "waiting").when(again & good(status(1)), "recovered").when(again & stopped(status(1)), "blocked").otherwise("failed")
    return two.select("url", F.when(again & status(1).isNotNull(), 2).otherwise(1).alias("tries"), last.alias("status"), outcome.alias("outcome"))


def clipped_json(row: Column, chars: int) -> Column:
    return F.left(F.to_json(row), F.lit(chars))


def lines_with(text: Column, part: str, most: int = 120) -> Column:
    """The first lines that hold a part."""
    return F.slice(F.filter(F.split(text, "\n"), lambda x: x.contains(part)), 1, most)


def in_turn(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A pipeline of stages, each of which adds its columns to the table of questions."""
    for stage in stages:
        df = df.transform(stage)
    return df
