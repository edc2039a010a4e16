"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``. A session on one machine may do without and gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_dir(spark.sparkContext.applicationId)


@lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="noteloom-")


#: Folders that each running operator has written, innermost last.
_written: list[list[str]] = []


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deletes the tables that an operator has written, at its end, save those that its result still reads; all of them if it fails."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _written.append([])
        try:
            result = operator(*args, **kwargs)
        except BaseException:
            for folder in _written.pop():
                _delete(SparkSession.active(), folder)
            raise
        folders = _written.pop()
        needed = {f.rsplit("/", 2)[1] for f in result.inputFiles()}
        for folder in folders:
            if folder.rsplit("/", 1)[1] not in needed:
                _delete(result.sparkSession, folder)
            elif _written:
                _written[-1].append(folder)
        return result

    return run


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses no data.

    Spark also learns the table's true size, so later joins are planned on a measured figure.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noteloom-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """The frame itself, after a bound in bytes on the session's Arrow batches: ten thousand long texts are too much for one.

    The setting is read when the frame runs, which may be after the operator returns, so it stays; one that is smaller
    already is left as it is.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    as_bytes = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(conf.get(key, "64m")) > as_bytes(size):
        conf.set(key, size)
    return df


def release_memory() -> None:
    """Give freed memory back to the system at a task's end: Python workers live on from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``materialize`` returned and that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/noteloom-" in folder:
                _delete(df.sparkSession, folder)


#: Up to this many rows of keys (about 60 bytes each) are broadcast to the documents that they pick out.
BROADCAST_KEYS = 500_000


def keys_beside(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if its counted rows are few; beyond, the join that it enters shuffles the documents once."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


#: Slots of a bit map for each hash, and bounds of its size in bits (64 kB, 2 MB as a constant of the plan).
SLOTS, LEAST_BITS, MOST_BITS = 64, 1 << 19, 1 << 24


def _bit_words(hashes: DataFrame, n: int) -> np.ndarray:
    """64-bit words with a bit for each value of ``hash``; their number is bounded, whatever the number ``n`` of values."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(n, 1) * SLOTS).bit_length()))
    slot = F.pmod("hash", F.lit(bits))
    rows = hashes.select(F.shiftright(slot, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
    words = np.zeros(bits // 64, np.int64)
    for batch in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():  # MOST_BITS / 64 rows at most
        words[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return words


def bit_map(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A constant array of 64-bit words with a bit for each value of ``hash``, and its number of bits."""
    words = _bit_words(hashes, n)
    return F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<long>"), 64 * len(words)


def bit_map_row(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """The same as the only value of a table, which a plan reads once, so that neither the plan nor what Spark tells of it
    at every step spells the words out. It may not stand in a lambda."""
    words = _bit_words(hashes, n)
    row = pa.table({"words": pa.array([words], pa.list_(pa.int64()))})
    return hashes.sparkSession.createDataFrame(row).scalar(), 64 * len(words)


def in_bit_map(hash_: Column, words: Column, bits: int) -> Column:
    """Whether a hash's bit is set: true for every hash in the map, and for few others while it is sparse."""
    slot = hash_.bitwiseAND(F.lit(bits - 1))
    word = F.get(words, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def rows_without(docs: DataFrame, gone: DataFrame, own: dict[str, Column]) -> DataFrame:
    """The rows of ``docs``, all columns, whose key is not in ``gone``, a written table of distinct keys; nulls equal nulls.

    ``own`` gives the documents' expression, under the alias ``d``, for each key column of ``gone``. A bit map of the
    keys, with two bits a key and of bounded size, lets nearly all rows that stay pass. The keys of the others meet
    ``gone`` exactly, and those that are not in it are spared by name. So the plan is one at every size, the documents
    are not shuffled, and keys are shuffled only of rows that go and of some few others; where the map is too small for
    the keys, of all rows. ``docs`` is read twice and must give the same rows each time.
    """
    probes = [lambda *key, p=p: F.xxhash64(F.lit(p), *key) for p in (11, 12)]
    hashes = gone.select(F.explode(F.array(*[p(*own) for p in probes])).alias("hash"))
    words, bits = bit_map_row(hashes, 2 * gone.count())
    hit = in_bit_map(probes[0](*own.values()), words, bits) & in_bit_map(probes[1](*own.values()), words, bits)
    rows = docs.alias("d")
    same = lambda here, there: F.expr(" and ".join(f"{here}.{k} <=> {there}.{k}" for k in own))
    hits = rows.where(hit).select(*[c.alias(k) for k, c in own.items()])
    spared = materialize(hits.alias("h").join(gone.alias("g"), same("h", "g"), "left_anti").distinct().withColumn("spared", F.lit(True)))
    own_key = F.lit(True)
    for k, c in own.items():
        own_key = own_key & c.eqNullSafe(F.col(f"s.{k}"))
    joined = rows.join(keys_beside(spared).alias("s"), hit & own_key, "left").where(~hit | F.col("s.spared").isNotNull())
    return joined.select(*[F.col(f"d.`{c.replace('`', '``')}`") for c in docs.columns])


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a text (null has its own): rows of one text share them, whatever their ids."""
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, for calls that must name a number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def words(text) -> "F.Column":
    """Array of the words of a text column: maximal runs without white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
