"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Law ``rows``: shard sizes differ by at most one row, and shard and slot of a row can be computed from its row number,
the row count and the seed alone. DataFrame operations only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROUND_KEYS = (0x2545F491, 0x1B873593, 0x5BD1E995, 0x165667B1, 0x27D4EB2F, 0x3C6EF372)
MASK = 0x7FFFFFFF
MULT_A, MULT_B = 1103515245, 668265261
#: The grid exceeds the row count by less than its side, so a walk of this length ends but for a chance under 1e-20.
MAX_WALK = 24


def grid(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest near-square grid with a*b >= n."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute_once(x: Column, a: int, b: int) -> Column:
    """One pass of the generalised Feistel network over the grid: a bijection of [0, a*b)."""

    def mix(v: Column, key: Column) -> Column:
        t = (v * F.lit(MULT_A) + key).bitwiseAND(F.lit(MASK))
        t = F.transform(F.array(t), lambda y: y.bitwiseXOR(F.shiftright(y, 15)))[0]
        t = (t * F.lit(MULT_B)).bitwiseAND(F.lit(MASK))
        return F.transform(F.array(t), lambda y: y.bitwiseXOR(F.shiftright(y, 13)))[0]

    rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(b if i % 2 else a).cast("long").alias("side")) for i, k in enumerate(ROUND_KEYS)])
    start = F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(
        rounds,
        start,
        lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + mix(s["r"], k["key"]), k["side"]).cast("long").alias("r")),
        lambda s: s["l"] * F.lit(b) + s["r"],
    )


def permuted(x: Column, n: int) -> Column:
    """Place of row number ``x`` after the shuffle of ``n`` rows: permute, and walk the cycle while outside [0, n)."""
    a, b = grid(n)
    first = permute_once(x, a, b)
    steps = min(a * b - n, MAX_WALK)
    if not steps:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda p, _: F.when(p < n, p).otherwise(permute_once(p, a, b)))
    return F.transform(F.array(walked), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk did not end"))))[0].cast("long")


def row_numbers(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """Global row numbers from 0 in the order of the given columns (nulls first), without a single-task sort.

    Rows equal in all those columns take adjacent numbers in any order; they may spread over partitions, so that no
    repeated value fills one task.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    kept = materialize(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition of the range exchange: bounded by their number, not by the data.
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return kept.withColumn("_part", part.cast("long")).join(F.broadcast(offsets), "_part").withColumn(number, F.col("_start") + row).drop("_part", "_start", "_at")


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot for every row of ``docs`` under the law ``rows``.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard (null), row_number.
    Row numbers follow the id, then the text's hash: rows with a null id come first, repeated rows keep a row each, a
    null text has size 8 and a null checksum. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    )
    rows = row_numbers(base, ["doc_id", "_hash"], "row_number")
    n = rows.count()
    place = permuted(F.col("row_number"), max(n, 1))
    return rows.withColumn("_place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"_place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
