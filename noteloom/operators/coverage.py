"""Whether the passages of notes cover their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_SEGMENTS


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units, in which spans are counted: characters beyond the basic plane are two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def span_coverage(passages: DataFrame, notes: DataFrame, note: str, text: str, most: int | None = MAX_SEGMENTS) -> DataFrame:
    """(note_id, spans, contiguous, complete, lines) for every note: a span begins where the last one ended and is as
    long as its body, the bodies joined are the text, and lines are counted from 0 by line feeds.

    A blank text needs no passage, any other without one is not complete; a null text counts as empty. More passages
    than ``most``, those that a note may have, are not complete either; without it any number may be. A note's bodies are joined in one row, bounded as its text is.
    """
    w = Window.partitionBy("note_id").orderBy("passage_index")
    breaks = F.regexp_count("body", F.lit("\n"))
    line = F.coalesce(F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joins = (F.col("start") == F.coalesce(F.lag("end").over(w), F.lit(0))) & (F.col("end") - F.col("start") == utf16_units(F.col("body")))
    told = passages.select("note_id", "passage_index", "body", joins.alias("joins"), ((F.col("start_line") == line) & (F.col("end_line") == line + breaks)).alias("told"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_index", "body"))), lambda p: p["body"]), "")
    held = told.groupBy("note_id").agg(F.count("*").alias("spans"), F.min("joins").alias("joins"), F.min("told").alias("told"), body.alias("body"))
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = notes.select(F.col(note).cast("string").alias("note_id"), whole.alias("_text"))
    blank = F.col("spans").isNull() & (F.regexp_replace("_text", r"(?U)\s", "") == "")
    yes = F.lit(True)
    few = yes if most is None else F.col("spans") <= most
    return texts.join(held, "note_id", "left").select(
        "note_id",
        F.coalesce("spans", F.lit(0)).alias("spans"),
        F.coalesce("joins", yes).alias("contiguous"),
        (blank | F.coalesce((F.col("body") == F.col("_text")) & few, F.lit(False))).alias("complete"),
        F.coalesce("told", yes).alias("lines"),
    )
