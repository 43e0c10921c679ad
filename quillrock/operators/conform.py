"""Conformance of JSON texts to a JSON schema, compiled into columns.

A schema (draft 7) becomes one expression over the parsed value of a text: an array of breaches, each with the path of
the value, the rule that it breaks and what the rule says. Everything is decided in the text's own row, so a file of any number
of records is one scan. A text is read as JSON in full: unknown keys, values of a wrong kind and missing ones are all seen, which
a typed read would turn to null or drop.

Known keywords: type, enum, const, required, properties, additionalProperties, items, minItems, maxItems, minLength,
maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, allOf, $ref into the same schema. A schema that uses another one is refused,
and so is a $ref that leads into itself, since its expression would have no end. Formats, titles and descriptions assert nothing.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fees import once
from . import records as R

BREACH = "array<struct<path:string,rule:string,detail:string>>"
SILENT = {"$schema", "$id", "title", "description", "default", "examples", "format", "definitions", "$comment"}
#: A kind of JSON and how the engine names the types of its values.
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}


def schema_of(spark: SparkSession, path: str) -> dict:
    """A schema file: one small document of configuration."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _none() -> Column:
    return F.array().cast(BREACH)


def _breach(path: Column, rule: str, detail: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def _if(bad: Column, path: Column, rule: str, detail: str) -> Column:
    return F.when(bad, _breach(path, rule, detail)).otherwise(_none())


def _cast(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def is_kind(v: Column, kind: str, name: Column) -> Column:
    """Whether a value, present, whose type has this name, is of a kind; 1.0 is an integer."""
    if kind == "integer":
        n = _cast(v, "decimal(38,18)")
        return is_kind(v, "number", name) & F.coalesce(n == F.floor(n), F.lit(False))
    if kind not in KINDS:
        raise ValueError(f"unknown type {kind!r}")
    found = [name.startswith(x) for x in KINDS[kind]]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def _equals(v: Column, value, name: Column) -> Column:
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return is_kind(v, "boolean", name) & (_cast(v, "boolean") == value)
    if isinstance(value, (int, float)):
        return is_kind(v, "number", name) & (_cast(v, "decimal(38,18)") == F.lit(Decimal(str(value))))
    if isinstance(value, str):
        return is_kind(v, "string", name) & (_cast(v, "string") == value)
    raise ValueError("enum and const of arrays or objects are not compiled")


def _target(root: dict, ref: str) -> dict:
    if not ref.startswith("#/"):
        raise ValueError(f"$ref {ref!r} leads out of the schema")
    at = root
    for part in ref[2:].split("/"):
        at = at[part.replace("~1", "/").replace("~0", "~")]
    return at


def _and(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def breaches(v: Column, schema: dict | bool, path: Column | None = None, root: dict | None = None, within: tuple[str, ...] = ()) -> Column:
    """array<struct<path, rule, detail>> of a variant that is there; paths are joined by '/', the whole value's is empty."""
    path = F.lit("") if path is None else path
    if schema is True or schema == {}:
        return _none()
    if schema is False:
        return _breach(path, "false", "nothing is allowed here")
    root = schema if root is None else root
    if "$ref" in schema:  # draft 7: its neighbours are ignored
        if schema["$ref"] in within:
            raise ValueError(f"$ref {schema['$ref']!r} leads into itself")
        return breaches(v, _target(root, schema["$ref"]), path, root, (*within, schema["$ref"]))
    unknown = set(schema) - SILENT - {
        "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "allOf",
    }
    if unknown:
        raise ValueError(f"keywords not compiled: {sorted(unknown)}")
    return once(F.call_function("schema_of_variant", v), lambda name: _found(v, schema, path, root, within, name))


def _found(v: Column, schema: dict, path: Column, root: dict, within: tuple[str, ...], name_of: Column) -> Column:
    """breaches() of a value whose type's name is known; each value and each object's map is computed once."""
    down = lambda x, p, s: once(x, lambda x: breaches(x, s, p, root, within))
    _is = lambda v, kind: is_kind(v, kind, name_of)
    under = lambda part: F.when(path == "", part).otherwise(F.concat(path, F.lit("/"), part))
    found = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = _is(v, kinds[0])
        for k in kinds[1:]:
            ok = ok | _is(v, k)
        found.append(_if(~ok, path, "type", " or ".join(kinds)))
    for name in ("enum", "const"):
        if name in schema:
            values = schema[name] if name == "enum" else [schema[name]]
            ok = F.lit(False)
            for x in values:
                ok = ok | _equals(v, x, name_of)
            found.append(_if(~ok, path, name, json.dumps(values if name == "enum" else values[0], ensure_ascii=False)))
    for s in schema.get("allOf", []):
        found.append(down(v, path, s))

    text, number = _is(v, "string"), _is(v, "number")
    length = F.length(_cast(v, "string"))
    value = _cast(v, "decimal(38,18)")
    bound = lambda name: F.lit(Decimal(str(schema[name])))
    limits = {
        "minLength": lambda: _and(text, length < schema["minLength"]), "maxLength": lambda: _and(text, length > schema["maxLength"]),
        "pattern": lambda: _and(text, ~_cast(v, "string").rlike(schema["pattern"])),
        "minimum": lambda: _and(number, value < bound("minimum")), "maximum": lambda: _and(number, value > bound("maximum")),
        "exclusiveMinimum": lambda: _and(number, value <= bound("exclusiveMinimum")), "exclusiveMaximum": lambda: _and(number, value >= bound("exclusiveMaximum")),
        "minItems": lambda: _and(_is(v, "array"), F.size(_cast(v, "array<variant>")) < schema["minItems"]), "maxItems": lambda: _and(_is(v, "array"), F.size(_cast(v, "array<variant>")) > schema["maxItems"]),
    }
    found += [_if(F.coalesce(bad(), F.lit(False)), path, name, str(schema[name])) for name, bad in limits.items() if name in schema]

    known, must, more = schema.get("properties", {}), schema.get("required", []), schema.get("additionalProperties", True)

    def inside(fields: Column, keys: Column) -> Column:
        of = [F.when(F.array_contains(keys, key), _none()).otherwise(_breach(path, "required", key)) for key in must]
        of += [F.when(F.array_contains(keys, key), down(F.element_at(fields, F.lit(key)), under(F.lit(key)), s)).otherwise(_none()) for key, s in known.items() if s not in (True, {})]
        others = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>")))
        if more is False:
            of.append(F.transform(others, lambda k: F.struct(path.alias("path"), F.lit("additionalProperties").alias("rule"), k.alias("detail"))))
        elif more not in (True, {}):
            of.append(F.flatten(F.transform(others, lambda k: down(F.element_at(fields, k), under(k), more))))
        return F.concat(*of) if of else _none()

    if known or must or more not in (True, {}):
        found.append(F.when(_is(v, "object"), once(_cast(v, "map<string,variant>"), lambda fields: once(F.map_keys(fields), lambda keys: inside(fields, keys)))).otherwise(_none()))

    items = schema.get("items", True)
    if isinstance(items, list):
        raise ValueError("items by place are not compiled")
    if items not in (True, {}):
        each = F.flatten(F.transform(_cast(v, "array<variant>"), lambda x, i: down(x, under(i.cast("string")), items)))
        found.append(F.when(_is(v, "array"), each).otherwise(_none()))
    return F.concat(*found) if found else _none()


def check(texts: DataFrame, schema: dict, key: str = "path", text: str = "body") -> DataFrame:
    """(key, at, rule, detail): a row for every breach of every text; rule 'broken' for one that is no JSON or repeats a key."""
    v = F.col("__v")
    found = F.when(v.isNull(), _breach(F.lit(""), "broken", "no JSON")).otherwise(breaches(v, schema))
    one = texts.select(key, F.try_parse_json(F.col(text)).alias("__v")).select(key, F.explode(found).alias("b"))
    return one.select(key, F.col("b.path").alias("at"), F.col("b.rule").alias("rule"), F.col("b.detail").alias("detail"))


def validate(texts: DataFrame, schema: dict, valid: DataFrame, today: Column, words: tuple[str, ...] = (), exempt: str = "", days: int = R.STALE_DAYS, key: str = "path", text: str = "body") -> DataFrame:
    """The whole validation run: (key, severity, rule, detail) of every text.

    The schema's breaches, categories that are not `valid` (id), texts of the curated table (words), the rules of fees and
    sources, and warnings for old or undated sources. A broken text has only that error; one that breaks the schema is
    still read as far as its fields can be.
    """
    named = texts.select(F.col(key).alias("__k"), F.from_json(text, R.RECORD).alias("r"), F.lower(F.col(text)).alias("blob")).where(F.try_parse_json(F.col(text)).isNotNull())
    # the rules of records tell a record by its category: here that is the text's key, and its own category stands beside it
    rec = named.select(F.col("__k").alias("category"), F.col("r.category").alias("filed"), *[F.col(f"r.{c}").alias(c) for c in R.FIELDS if c != "category"])
    row = lambda df, severity: df.select(F.col("category").alias(key), F.lit(severity).alias("severity"), "rule", F.lit("").alias("detail"))
    formal = check(texts, schema, key, text).select(key, F.lit("error").alias("severity"), F.concat(F.lit("schema:"), "rule").alias("rule"), F.concat_ws(" ", F.nullif("at", F.lit("")), "detail").alias("detail"))
    filed = rec.join(valid.select(F.col("id").alias("filed")).distinct(), "filed", "left_anti").select(F.col("category").alias(key), F.lit("error").alias("severity"), F.lit("unknown_category").alias("rule"), F.coalesce("filed", F.lit("?")).alias("detail"))
    broken = R.broken_rules(rec)
    hits = F.filter(F.array(*(F.lit(w.lower()) for w in words)).cast("array<string>"), lambda w: F.contains(F.col("blob"), w))
    scam = named.where(~F.contains("blob", F.lit(exempt)) if exempt else F.lit(True)).select(F.col("__k").alias(key), F.explode(hits).alias("detail")).select(key, F.lit("error").alias("severity"), F.lit("scam_text").alias("rule"), "detail")
    return formal.unionByName(filed).unionByName(row(broken, "error")).unionByName(scam).unionByName(row(R.warnings(rec, today, days), "warning"))


def schema_from(kind, required: tuple[str, ...] = (), never_null: tuple[str, ...] = (), enums: dict[str, list] | None = None, at: str = "") -> dict:
    """A closed schema of an engine type: objects with its fields only, values of its kinds or null.

    required, never_null and the keys of enums name fields by their dotted place, such as "fees.verification.status".
    """
    name = kind.typeName()
    if name == "struct":
        fields = {f.name: f"{at}.{f.name}".lstrip(".") for f in kind.fields}
        out = {"type": "object", "additionalProperties": False, "properties": {f.name: schema_from(f.dataType, required, never_null, enums, fields[f.name]) for f in kind.fields}}
        must = [f for f, place in fields.items() if place in required]
        out |= {"required": must} if must else {}
    elif name == "array":
        out = {"type": "array", "items": schema_from(kind.elementType, required, (*never_null, at), enums, at)}
    else:
        kinds = {"string": "string", "date": "string", "timestamp": "string", "boolean": "boolean", "integer": "integer", "long": "integer"}
        out = {"type": kinds.get(name, "number")}
    if at in (enums or {}):
        out["enum"] = enums[at]
    if at and at not in never_null:
        out["type"] = [out["type"], "null"]
    return out
