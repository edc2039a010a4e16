"""Rules for stored rows: each fault by name, good rows served, bad ones set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_unit

#: Fixed value: greatest length of an identity.
IDENTITY_LENGTH = 512


def identity(value: Column) -> Column:
    """Whether a value is a name of 1 to 512 characters without NUL."""
    return F.coalesce(F.length(value).between(1, IDENTITY_LENGTH) & ~F.contains(value, F.lit("\0")), F.lit(False))


def note_rules(dims: int) -> dict[str, Column]:
    """What must hold for a stored note."""
    return {"note_id": identity(F.col("note_id")), "snapshot_id": identity(F.col("snapshot_id")), "path": identity(F.col("path")), "vector": is_unit(F.col("vector"), dims)}


def passage_rules(dims: int | None = None) -> dict[str, Column]:
    """What must hold for a stored passage: names, text, ranges of characters, lines and tokens, and with ``dims`` the vector."""
    ordered = lambda low, high, least: F.coalesce((F.col(low) >= 0) & (F.col(high) - F.col(low) >= least), F.lit(False))
    rules = {
        "note_id": identity(F.col("note_id")),
        "snapshot_id": identity(F.col("snapshot_id")),
        "passage_index": F.coalesce(F.col("passage_index") >= 0, F.lit(False)),
        "body": F.col("body").isNotNull(),
        "characters": ordered("start", "end", 0),
        "lines": ordered("start_line", "end_line", 0),
        "tokens": F.col("start_token").isNull() & F.col("end_token").isNull() | ordered("start_token", "end_token", 1),
    }
    return rules | ({} if dims is None else {"vector": is_unit(F.col("vector"), dims)})


def with_faults(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``faults``: the names of the rules that a row breaks, in their order; empty for a good row. Row by row, without a shuffle."""
    broken = F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return rows.withColumn("faults", F.filter(broken, F.isnotnull))


def fault_counts(rows: DataFrame) -> DataFrame:
    """(fault, rows) over ``with_faults``: how many rows have each fault; combined before the shuffle."""
    return rows.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("rows"))


def whole_notes(notes: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, passages) of ``with_faults`` without faults: a note goes if it or any of its passages has one, so no note is served in part."""
    bad = notes.where(F.size("faults") > 0).select("note_id").unionByName(passages.where(F.size("faults") > 0).select("note_id")).distinct()
    kept = lambda df: df.where(F.size("faults") == 0).drop("faults").join(bad, "note_id", "left_anti")
    return kept(notes), kept(passages)


def missing_columns(table: DataFrame, wanted: dict[str, str]) -> list[str]:
    """What a generation's table lacks of the columns (name, type) that its readers name: missing ones and those of another type."""
    held = {f.name: f.dataType.simpleString() for f in table.schema}
    return [f"{name}: {held.get(name, 'missing')} instead of {kind}" for name, kind in wanted.items() if held.get(name) != kind]
