"""Typed properties from frontmatter: kinds, values, registry and filters."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KIND_OPERATORS, KIND_SUFFIX, KIND_TYPE
from .text import hex_key

DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}(T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d))?$"
SAFE_INTEGER = 2**53 - 1
KEY_ARRAYS = ("property_keys", "null_property_keys", "empty_list_property_keys")


def date_value(text: Column) -> Column:
    """Instant of a calendar-valid ISO date or zoned timestamp (seconds optional), else null; milliseconds, UTC."""
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    clock = F.regexp_extract(text, r"T(\d{2}:\d{2}(?::\d{2})?)", 1)
    whole = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    millis = F.rpad(F.regexp_extract(text, r"\.(\d{1,3})", 1), 3, "0")
    zone = F.regexp_replace(F.regexp_extract(text, r"(Z|[+-]\d{2}:\d{2})$", 1), "^Z$", "+00:00")
    offset = (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int")) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    local = F.unix_seconds(day.cast("timestamp")) + F.substring(whole, 1, 2).cast("int") * 3600 + F.substring(whole, 4, 2).cast("int") * 60 + F.substring(whole, 7, 2).cast("int")
    exact = F.timestamp_millis((local - offset * 60) * 1000 + millis.cast("int"))
    return F.when(text.rlike(DATE_SHAPE) & day.isNotNull(), F.when(F.length(text) == 10, F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")))).otherwise(exact))


def date_text(text: Column) -> Column:
    """ISO-8601 in UTC with milliseconds, else null. The session's time zone must be UTC."""
    return F.date_format(date_value(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_date(text: Column) -> Column:
    return date_value(text).isNotNull()


def property_kind(value_json: Column) -> Column:
    """Kind of a property from its JSON value; null for ``null`` and the empty list, which have none."""
    v = F.try_parse_json(value_json)
    shape = F.schema_of_variant(v)
    number = r"^(BIGINT|DECIMAL\(.*\)|DOUBLE|FLOAT)$"
    text = F.try_variant_get(v, "$", "string")
    real = F.try_variant_get(v, "$", "double")
    unsafe = (real == F.floor(real)) & (F.abs(real) > SAFE_INTEGER)
    items = F.from_json(value_json, "array<string>")
    element = F.regexp_extract(shape, r"^ARRAY<(.*)>$", 1)
    listed = (
        F.when(F.exists(items, F.isnull), "textArray")
        .when((element == "STRING") & F.forall(items, is_date), "dateArray")
        .when(element == "STRING", "textArray")
        .when(element.rlike(number), "numberArray")
        .when(element == "BOOLEAN", "booleanArray")
        .otherwise("textArray")
    )
    return (
        F.when((shape == "VOID") | (shape == "ARRAY<VOID>") & (F.size(items) == 0), F.lit(None).cast("string"))
        .when(F.startswith(shape, F.lit("ARRAY<")), listed)
        .when(shape == "STRING", F.when(is_date(text), "date").otherwise("text"))
        .when(shape.rlike(number), F.when(unsafe, F.raise_error(F.lit("unsafe integer property"))).otherwise("number"))
        .when(shape == "BOOLEAN", "boolean")
        .otherwise("json")
    )


def physical_name(key: Column, kind: Column) -> Column:
    suffix = F.create_map(*[F.lit(x) for pair in KIND_SUFFIX.items() for x in pair])
    stem = F.when(F.octet_length(key) <= 80, hex_key(key)).otherwise(F.concat(F.lit("h"), F.sha2(key, 256)))
    return F.concat(F.lit("p_"), stem, F.lit("_"), F.element_at(suffix, kind))


def _number_text(x: float) -> str:
    """A number as scripts print it: no exponent from 1e-6 up to 1e21, no trailing ``.0``."""
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits = repr(float(x))
    mantissa, _, power = digits.partition("e")
    if not power:
        return digits
    n = int(power)
    if -7 < n < 0:
        sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
        return f"{sign}0.{'0' * (-n - 1)}{mantissa.replace('.', '')}"
    return f"{mantissa}e{'+' if n > 0 else '-'}{abs(n)}"


def canonical_json(value) -> str:
    """JSON text with keys sorted by UTF-16 units at every level and no spaces."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number_text(float(value))
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json_text(value: pd.Series) -> pd.Series:
    """Canonical text of JSON objects; Spark's own writer neither sorts keys nor prints numbers alike."""
    return value.map(lambda s: None if s is None else canonical_json(json.loads(s)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_items(value: pd.Series) -> pd.Series:
    """Items of JSON lists as canonical text each; a null item is the text ``null``, a text keeps its quotes."""
    return value.map(lambda s: None if s is None else [canonical_json(x) for x in json.loads(s)])


def property_map(json_text: Column) -> Column:
    """The properties of a note as a map from key to JSON value; whatever characters a key has, it is no path."""
    return F.from_json(json_text, "map<string,variant>")


def explode_properties(notes: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """A row for each property: id, key, key_hex, value (JSON), kind, physical_name; kind is null for null and []. A note without properties has no row."""
    keyed = notes.select(id_col, F.explode(property_map(F.col(json_col))))
    typed = keyed.select(id_col, "key", hex_key(F.col("key")).alias("key_hex"), F.to_json("value").alias("value"))
    return typed.withColumn("kind", property_kind(F.col("value"))).withColumn("physical_name", physical_name(F.col("key"), F.col("kind")))


def typed_columns(notes: DataFrame, json_col: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    """``notes`` with one typed column for each registered field (key, kind, physical name), and the three key arrays.

    Row by row, without a shuffle; a note without a property, or without any, has null there and stays.
    """
    properties = notes.withColumn("_map", F.coalesce(property_map(F.col(json_col)), F.create_map().cast("map<string,variant>")))
    texts = properties.withColumn("_json", F.transform_values("_map", lambda _, v: F.to_json(v)))
    keys = {key for key, _, _ in fields}
    kinds = texts.withColumn("_kinds", F.struct(*[property_kind(F.col("_json")[key]).alias(key.encode().hex() or "_") for key in sorted(keys)])) if keys else texts
    kind_of = lambda key: F.col("_kinds")[key.encode().hex() or "_"]
    typed = {name: F.when(kind_of(key) == kind, _value(F.col("_json")[key], kind)) for key, kind, name in fields}
    named = lambda test: F.sort_array(F.transform(F.map_keys(F.map_filter("_json", test)), hex_key))
    arrays = {
        "property_keys": named(lambda k, v: F.lit(True)),
        "null_property_keys": named(lambda k, v: v == "null"),
        "empty_list_property_keys": named(lambda k, v: v == "[]"),
    }
    return kinds.withColumns(typed | arrays).drop("_map", "_json", "_kinds")


def registry(properties: DataFrame) -> DataFrame:
    """Distinct (key, kind) with their physical names; two keys under one name are an error."""
    found = properties.where("kind is not null").select("key", "kind", "physical_name").distinct()
    owners = found.groupBy("physical_name").agg(F.count_distinct("key").alias("keys"), F.collect_set(F.struct("key", "kind")).alias("held"))
    checked = F.when(F.col("keys") == 1, F.col("held")).otherwise(F.raise_error(F.lit("two property keys share a column")))
    return owners.select(F.explode(checked).alias("f"), "physical_name").select("f.key", "f.kind", "physical_name")


def key_arrays(properties: DataFrame, id_col: str) -> DataFrame:
    """Per note: property_keys, null_property_keys and empty_list_property_keys (hex keys, sorted)."""
    when = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("key_hex"))))
    nothing = F.col("kind").isNull()
    return properties.groupBy(id_col).agg(
        when(F.lit(True)).alias("property_keys"), when(nothing & (F.col("value") == "null")).alias("null_property_keys"), when(nothing & (F.col("value") == "[]")).alias("empty_list_property_keys")
    )


def _value(value_json: Column, kind: str) -> Column:
    """A property's value by its kind, from its JSON."""
    v = F.try_parse_json(value_json)
    text = F.try_variant_get(v, "$", "string")
    if kind == "date":
        return date_value(text)
    if kind == "dateArray":
        return F.transform(F.from_json(value_json, "array<string>"), date_value)
    if kind in ("json", "text"):
        return value_json if kind == "json" else text
    if kind == "textArray":
        items = F.from_json(value_json, "array<string>")
        plain = (F.regexp_extract(F.schema_of_variant(v), r"^ARRAY<(.*)>$", 1) == "STRING") & ~F.exists(items, F.isnull)
        return F.when(plain, items).otherwise(json_items(F.when(~plain, value_json)))
    if kind.endswith("Array"):
        return F.from_json(value_json, KIND_TYPE[kind].simpleString())
    return F.try_variant_get(v, "$", KIND_TYPE[kind].simpleString())


def wide_properties(properties: DataFrame, fields: list[tuple[str, str, str]], id_col: str) -> DataFrame:
    """One typed column for each registered field (key, kind, physical name), from exploded properties: one pass, one shuffle. From whole notes, ``typed_columns`` needs none."""
    of = lambda key, kind: (F.col("key") == key) & (F.col("kind") == kind)
    picks = [F.max_by(F.when(of(key, kind), _value(F.col("value"), kind)), F.when(of(key, kind), 1)).alias(name) for key, kind, name in fields]
    return properties.groupBy(id_col).agg(*picks)


@dataclass(frozen=True)
class PropertyFilter:
    key: str
    kind: str
    operator: str
    value: object = None


def compile_filters(filters: list[PropertyFilter], fields: dict[tuple[str, str], str]) -> Column | None:
    """Conjunction over wide property columns and the key arrays; None for no filter.

    ``fields`` maps (key, kind) to the physical column. ``ne`` holds for notes that lack the property.
    """
    tests = []
    for f in filters:
        hexed = f.key.encode().hex()
        if f.operator not in KIND_OPERATORS[f.kind]:
            raise ValueError(f"{f.operator} does not apply to {f.kind}")
        if f.operator in ("missing", "null", "empty"):
            held = {"missing": "property_keys", "null": "null_property_keys", "empty": "empty_list_property_keys"}[f.operator]
            has = F.coalesce(F.array_contains(held, hexed), F.lit(False))
            tests.append(~has if f.operator == "missing" else has)
            continue
        if (f.key, f.kind) not in fields:
            raise ValueError(f"property {f.key} ({f.kind}) is not registered")
        if f.value is None:
            raise ValueError(f"a {f.operator} filter needs a value")
        col = F.col(fields[f.key, f.kind])
        if f.operator in ("containsAny", "containsAll"):
            wanted = F.array(*map(F.lit, f.value)).cast(KIND_TYPE[f.kind])
            tests.append(F.coalesce(F.arrays_overlap(col, wanted) if f.operator == "containsAny" else F.size(F.array_except(wanted, col)) == 0, F.lit(False)))
            continue
        value = F.lit(f.value).cast(KIND_TYPE[f.kind])
        tests.append({"eq": col == value, "ne": ~col.eqNullSafe(value), "gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[f.operator])
    return reduce(and_, tests) if tests else None


def parse_filter_value(text: str, kind: str):
    """Value of a filter box by kind; timestamps must name their seconds here. Raises ValueError on bad input."""
    import re
    from datetime import datetime

    def one(item: str, base: str):
        if base == "number":
            x = float(item)
            if not math.isfinite(x) or (x == int(x) and abs(x) > SAFE_INTEGER):
                raise ValueError("number out of range")
            return x
        if base == "boolean":
            if item not in ("true", "false"):
                raise ValueError("expected true or false")
            return item == "true"
        if base == "date":
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2}))?", item):
                raise ValueError("expected a date, or a timestamp with seconds and zone")
            return datetime.fromisoformat(item.replace("Z", "+00:00"))
        return item

    if kind == "json":
        return canonical_json(json.loads(text))
    if kind.endswith("Array"):
        return [one(x.strip(), kind.removesuffix("Array")) for x in text.split(",") if x.strip()]
    return one(text.strip() if kind != "text" else text, kind)


def presets_to_json(presets: dict[str, list[PropertyFilter]]) -> str:
    """Named filter lists as JSON, sorted by name; times are written as ISO texts."""
    if any(not name.strip() for name in presets):
        raise ValueError("a preset needs a name")
    return json.dumps({n: [[f.key, f.kind, f.operator, f.value] for f in fs] for n, fs in presets.items()}, sort_keys=True, default=lambda t: {"at": t.isoformat()})


def presets_from_json(text: str) -> dict[str, list[PropertyFilter]]:
    """Filter lists as ``presets_to_json`` wrote them; an unknown kind, or an operator that its kind does not allow, is an error."""
    from datetime import datetime

    found = json.loads(text, object_hook=lambda o: datetime.fromisoformat(o["at"]) if set(o) == {"at"} and isinstance(o["at"], str) else o)
    presets = {name: [PropertyFilter(*f) for f in filters] for name, filters in found.items()}
    for f in (f for filters in presets.values() for f in filters):
        if f.operator not in KIND_OPERATORS.get(f.kind, ()):
            raise ValueError(f"{f.operator} does not apply to {f.kind}")
    return presets
