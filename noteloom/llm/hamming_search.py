"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits, each with a table of its own: written once, bucketed by the segment's value, so
that a step shuffles its probes alone and reads one segment. Once segments 0 to j have been probed at radius s and the
others at s - 1, every code within distance S*s + j has been met (S segments), for a code further off differs too much
in each. The radii grow segment by segment, and a query is done as soon as its k-th verified distance is covered in that
sense.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _delete, drop_materialized, materialize, partitions, shared_dir, tidy

SEGMENT_BITS, WORD_BITS = 16, 64
#: Ranks of one code's rows are taken in this many parts first, so that a repeated vector fills no single task.
SALT = 64
#: Codes of one bucket of a segment's table; a task holds one bucket in memory while probes stream past (about 100 bytes a code).
BUCKET_CODES = 250_000
#: Radii up to this are probed in the first step, in all segments.
FIRST_RADIUS = 2


def sign_code(vector: Column, width: int) -> Column:
    """Code of a vector of up to ``width`` numbers as 64-bit words: bit i is set where component i is above zero, and is not where there is none; null for null."""
    bit = lambda i: F.when(F.coalesce(F.get(vector, F.lit(i)) > 0, F.lit(False)), F.lit((1 << (i % WORD_BITS)) - (1 << WORD_BITS if i % WORD_BITS == 63 else 0))).otherwise(F.lit(0)).cast("long")
    words = [reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(at, min(at + WORD_BITS, width))]) for at in range(0, width, WORD_BITS)]
    return F.when(vector.isNotNull(), F.array(*words))


def distance(a: Column, b: Column, words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(words)]).cast("int")


def segment(code: Column, j: int) -> Column:
    word, shift = divmod(j * SEGMENT_BITS, WORD_BITS)
    return F.shiftrightunsigned(code[word], shift).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def schedule(segments: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Steps as (probes, covered distance); a probe is (segment, radius). Small radii are probed together, larger ones a segment at a time."""
    steps = [([(j, s) for j in range(segments) for s in range(FIRST_RADIUS + 1)], segments * FIRST_RADIUS + segments - 1)]
    return steps + [([(j, s)], segments * s + j) for s in range(FIRST_RADIUS + 1, SEGMENT_BITS + 1) for j in range(segments)]


def masks(radii: list[int]) -> Column:
    """All segment values with as many bits set as one of the radii says, 12,870 at most for one; a constant of the plan."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << SEGMENT_BITS) - 1)), lambda x: F.bit_count(x).isin(radii))


def _first(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)


def _write_index(codes: DataFrame, segments: int, n: int) -> tuple[str, str]:
    """Name and folder of the table (segment, key, code, ids), a part for each segment, bucketed by key."""
    spark = codes.sparkSession
    name = f"noteloom_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    buckets = max(partitions(codes), -(-n // BUCKET_CODES))
    keyed = codes.select("code", "ids", F.explode(F.array(*[F.struct(F.lit(j).alias("segment"), segment(F.col("code"), j).alias("key")) for j in range(segments)])).alias("s")).select("s.segment", "s.key", "code", "ids")
    keyed.repartition(buckets, "key").write.partitionBy("segment").bucketBy(buckets, "key").option("path", folder).saveAsTable(name)
    return name, folder


@tidy
def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows nearest to each query by Hamming distance: query_id, rank, id, distance.

    ``rows`` has id and code, ``queries`` has query_id and code; a code is a long or an array of longs, of one length in
    both. Equal distances are ordered by id (nulls first). Rows and queries without a code take no part; a repeated
    query counts once, repeated rows are rows of their own; extra columns are not read. With fewer than k rows all are
    returned.
    """
    spark = rows.sparkSession
    code = lambda df: (F.col("code") if df.schema["code"].dataType.typeName() == "array" else F.array("code")).alias("code")
    rows = rows.where("code is not null").select("id", code(rows))
    queries = queries.where("code is not null").select("query_id", code(queries)).distinct()
    # The k least ids of each distinct code stand for its rows: ranked in salted parts, then together.
    salted = _first(rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT))), ["code", "_salt"], [F.col("id")], k)
    least = _first(salted.drop("_rank"), ["code"], [F.col("id")], k)
    codes = materialize(least.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("id", "_rank"))).alias("ids")))
    wanted = min(k, rows.limit(k).count())
    if not wanted or queries.isEmpty():
        kind = rows.schema["id"].dataType.simpleString()
        return queries.where("false").select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("id"), F.lit(0).alias("distance"))
    stats = codes.agg(F.count("*"), F.max(F.size("code"))).first()
    words = stats[1]
    segments = words * WORD_BITS // SEGMENT_BITS
    name, folder = _write_index(codes, segments, stats[0])

    asked = materialize(queries.groupBy("code").agg(F.collect_list("query_id").alias("query_ids")).withColumn("q", F.monotonically_increasing_id()))
    # A query's bound is its k-th verified distance so far: what lies further off is dropped in the join itself.
    active = materialize(asked.select("q", F.col("code").alias("at"), F.lit(words * WORD_BITS).alias("bound")))
    best, done = None, []
    for probes, cover in schedule(segments):
        if active.isEmpty():
            break
        spread = active.repartition(partitions(active), "q")
        met = []
        for j in sorted({j for j, _ in probes}):
            flips = masks([s for i, s in probes if i == j])
            keyed = spread.select("q", "at", "bound", F.explode(flips).alias("flip")).withColumn("key", segment(F.col("at"), j).bitwiseXOR(F.col("flip")))
            table = spark.table(name).where(F.col("segment") == j).select("key", "code", "ids").hint("shuffle_hash")
            apart = distance(F.col("at"), F.col("code"), words)
            near = keyed.alias("p").join(table.alias("t"), (F.col("p.key") == F.col("t.key")) & (apart <= F.col("bound")))
            met.append(near.select("q", apart.alias("distance"), "code", F.explode("ids").alias("i")).select("q", "distance", "i.id", "code", F.col("i._rank").alias("_copy")))
        if best is not None:
            met.append(best.join(active.select("q"), "q", "left_semi").drop("_rank"))
        # Segments meet a code up to once each: equal rows share a rank, and one of them stays. All this needs one exchange by query.
        order = Window.partitionBy("q").orderBy("distance", "id", "code", "_copy")
        ranked = reduce(DataFrame.unionByName, met).withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= k)
        now = materialize(ranked.dropDuplicates(["q", "_rank"]))
        full = now.where(F.col("_rank") == wanted).select("q", "distance")
        done.append(now.select("q", "_rank", "id", "distance").join(full.where(F.col("distance") <= cover).select("q"), "q", "left_semi"))
        after = active.join(full, "q", "left").where(F.col("distance").isNull() | (F.col("distance") > cover))
        after = materialize(after.select("q", "at", F.coalesce("distance", "bound").alias("bound")))
        drop_materialized(active)
        active, best = after, now
    result = reduce(DataFrame.unionByName, done)
    answers = materialize(result.join(asked.select("q", F.explode("query_ids").alias("query_id")), "q").select("query_id", F.col("_rank").alias("rank"), "id", "distance"))
    spark.sql(f"drop table {name}")
    _delete(spark, folder)
    return answers


def search_embeddings(embeddings: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Nearest rows by sign code for the stated query set: every row whose id is divisible by ``every``, against all rows.

    Vectors may have any number of components; a shorter one has no bits beyond its end, and null vectors take no part.
    """
    width = embeddings.agg(F.max(F.size(vector_col))).first()[0] or 1
    coded = embeddings.select(F.col(id_col).alias("id"), sign_code(F.col(vector_col), max(width, 1)).alias("code"))
    return nearest(coded, coded.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "code"), k)
