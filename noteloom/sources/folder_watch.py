"""A change source: what happened to the files of a folder, told from one listing to the next.

A poll lists the folder, hashes the files that are new or look changed, and writes a numbered step: the listing, and the
changes since the step before. Steps are written under another name and then renamed, so there are no half steps, and of
two pollers one wins. Spark's file stream reads the steps' changes, with its own offsets: a stream that is killed and
started again goes on where it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .files import file_digest
from .store import SnapshotStore

LISTING = "path string, length long, modified timestamp, digest string"
CHANGES = "path string, op string, old_path string, revision long, note_id string, digest string"
#: Where a file stands between two renames when files change places.
HELD = ".held/"


def _hashed(files: DataFrame) -> DataFrame:
    """Adds the digest to (path, length, modified, uri); files that can't be read are left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(digest=frame["uri"].map(file_digest)).drop(columns="uri")

    return files.select("path", "length", "modified", "uri").mapInPandas(read, LISTING).where("digest is not null")


def _placed(files: DataFrame) -> DataFrame:
    """(digest, path, place): the file's number among those of one digest, by name and then path, in an order of hashes.

    It is counted in up to 65,536 parts for each digest, told by hashes of name and path, so copies of one text, such as
    empty files, are numbered in many tasks.
    """
    name, path = F.md5(F.element_at(F.split("path", "/"), -1)), F.md5("path")
    parted = files.select("digest", "path", name.alias("_name"), F.concat(F.substring(name, 1, 3), F.substring(path, 1, 1)).alias("_part"))
    sizes = parted.groupBy("digest", "_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("digest", "_part", (F.sum("_n").over(Window.partitionBy("digest").orderBy("_part")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("digest", "_part").orderBy("_name", "path"))
    return parted.withColumn("_in", inside).join(starts, ["digest", "_part"]).select("digest", "path", (F.col("_start") + F.col("_in")).alias("place"))


def listing_changes(before: DataFrame, after: DataFrame, step: int) -> DataFrame:
    """What turns one listing (path, digest; each path once) into another, as rows for ``apply_changes``.

    A text that left one path and came to another is a rename; of several equal ones the first that left goes with the
    first that came, in the order of ``_placed``. Other new texts at a path are a create where nothing was or what was
    there moved away, else a modify; what is left is a delete. A step has revisions 2 * step and 2 * step + 1: files
    first leave, those whose new path is still taken to ``HELD``, from where they come in the second, so files may
    change places in any way. A copy beside its original is a create. Null digests count as no file.
    """
    was, now = (df.where("digest is not null").select("path", F.col("digest").alias(name)) for df, name in ((before, "was"), (after, "now")))
    differ = was.join(now, "path", "full").where("not (was <=> now)")
    left, came = (_placed(differ.where(f"{side} is not null").select("path", F.col(side).alias("digest"))) for side in ("was", "now"))
    pairs = left.select("digest", "place", F.col("path").alias("old_path")).join(came, ["digest", "place"]).select("digest", "old_path", "path")
    told = differ.join(pairs.select("path", "old_path"), "path", "left").join(pairs.select(F.col("old_path").alias("path"), F.col("path").alias("new_path")), "path", "left")
    op = (
        F.when(F.col("old_path").isNotNull(), "rename")
        .when(F.col("now").isNotNull() & (F.col("was").isNull() | F.col("new_path").isNotNull()), "create")
        .when(F.col("now").isNotNull(), "modify")
        .when(F.col("new_path").isNull(), "delete")
    )
    first, second = F.lit(2 * step).cast("long"), F.lit(2 * step + 1).cast("long")
    row = lambda path, op, old, revision: F.struct(path.alias("path"), op.alias("op"), old.cast("string").alias("old_path"), revision.alias("revision"))
    path, old, none, held = F.col("path"), F.col("old_path"), F.lit(None), F.concat(F.lit(HELD), "path")
    rename = F.lit("rename")
    rows = (
        F.when((F.col("op") == "rename") & F.col("was").isNotNull(), F.array(row(held, rename, old, first), row(path, rename, held, second)))
        .when(F.col("op") == "rename", F.array(row(path, rename, old, first)))
        .otherwise(F.array(row(path, F.col("op"), none, F.when(F.col("op") == "create", second).otherwise(first))))
    )
    note = F.when(F.col("op") == "create", F.sha2(F.concat_ws("\0", "path", F.col("revision").cast("string")), 256))
    listed = told.withColumn("op", op).where("op is not null").select(F.explode(rows).alias("row"), "now").select("row.*", F.when(F.col("row.op") != "delete", F.col("now")).alias("digest"))
    return listed.select("path", "op", "old_path", "revision", note.alias("note_id"), "digest")


class FolderWatch:
    """Steps of one folder's files, kept below ``state`` in storage that all executors share.

    A file is hashed again when its length or time of change differs from the listing before; ``always_hash`` reads all
    files at each poll, for storage whose times can't be trusted. A file that vanishes while it is read is taken for
    gone, and one that can't be read too, until a later poll reads it.
    """

    def __init__(self, spark: SparkSession, root: str, state: str, glob: str = "*.md", always_hash: bool = False):
        self.spark, self.root, self.state, self.glob, self.always_hash = spark, root.rstrip("/"), state.rstrip("/"), glob, always_hash
        self._files = SnapshotStore(spark, self.state)

    def _at(self, step: int, table: str = "") -> str:
        return f"{self.state}/step-{step:010d}" + (f"/{table}" if table else "")

    def step(self) -> int:
        """Number of the last step; 0 before the first poll."""
        return max((int(n[5:]) for n in self._files.names(self.state) if n.startswith("step-")), default=0)

    def listing(self, step: int | None = None) -> DataFrame:
        """The files as a step saw them, the last one unless named; listings before the last two are deleted."""
        step = self.step() if step is None else step
        return self.spark.read.schema(LISTING).parquet(self._at(step, "listing")) if step else self.spark.createDataFrame([], LISTING)

    def _present(self) -> DataFrame:
        """(path, length, modified, uri) of the files that are there; no content is read."""
        found = self.spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=self.glob, ignoreMissingFiles="true").load(self.root)
        base = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "", self.root).lstrip("/") + "/"
        path = F.substring_index("path", base, -1) if base != "/" else F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/*", "")
        return found.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("path").alias("uri"))

    def poll(self) -> int:
        """Look at the folder once; the number of the step that now is the last. Nothing is written if no file looks changed."""
        step = self.step()
        before, present = self.listing(step), self._present()
        same: Column = F.lit(False) if self.always_hash else F.expr("length <=> _length and modified <=> _modified")
        known = before.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"), "digest")
        seen = present.join(known, "path", "left").withColumn("_same", F.col("digest").isNotNull() & same)
        if step and not self.always_hash and seen.where("not _same").isEmpty() and before.join(present, "path", "left_anti").isEmpty():
            return step
        new = f"{self.state}/new-{uuid.uuid4().hex}"
        fresh = _hashed(seen.where("not _same"))
        seen.where("_same").select(*fresh.columns).unionByName(fresh).write.parquet(f"{new}/listing")
        listed = self.spark.read.schema(LISTING).parquet(f"{new}/listing")
        changes = listing_changes(before, listed, step + 1)
        changes.write.parquet(f"{new}/changes")
        if self.always_hash and step and self.spark.read.schema(CHANGES).parquet(f"{new}/changes").isEmpty():
            self._files.delete(new)
            return step
        if self._files.place(new, self._at(step + 1)) and step > 1:
            self._files.delete(self._at(step - 1, "listing"))
        return self.step()

    def changes(self, step: int) -> DataFrame:
        """One step's changes."""
        return self.spark.read.schema(CHANGES).parquet(self._at(step, "changes"))

    def stream(self) -> DataFrame:
        """Changes of all steps, from the first, as a stream."""
        return self.spark.readStream.schema(CHANGES).parquet(f"{self.state}/step-*/changes")

    def polling(self, checkpoint: str) -> DataStreamWriter:
        """A writer that polls at each beat; its trigger sets how often: ``.trigger(processingTime="5 seconds").start()``."""
        beat = self.spark.readStream.format("rate").load()
        return beat.writeStream.foreachBatch(lambda batch, number: self.poll()).option("checkpointLocation", checkpoint)
