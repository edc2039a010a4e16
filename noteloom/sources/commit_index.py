"""Search indexes that follow a snapshot store: one segment for each commit, built once and never changed."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SnapshotStore


class CommitIndex(ABC):
    """Segments below the store's folder, named by the commits that they index.

    A commit's segment holds what the commit added. A note that a later commit replaces or drops is left out when older
    segments are read, as the store leaves out its rows. Readers name the commits of one manifest, so an index is always
    that of one snapshot. Segments are built under another name and then renamed: a lost job leaves no half segment, and
    of two builders one wins.
    """

    KIND: str

    def __init__(self, store: SnapshotStore, generation: int):
        self.store, self.generation, self.spark = store, generation, store.spark
        self.root = f"{store.root}/{self.KIND}/generation={generation}"
        self._kinds: dict[str, str] | None = None

    @abstractmethod
    def build(self, folder: str, commit: str, before: list[str]) -> None:
        """Write the segment of a commit that follows the commits ``before``."""

    def refresh(self) -> list[str]:
        """Build the segments that are missing; returns the commits of the newest manifest."""
        commits = self.store.commits(self.generation)
        for i, commit in enumerate(commits):
            if not self.store.exists(f"{self.root}/{commit}"):
                folder = f"{self.root}/new-{uuid.uuid4().hex}"
                self.build(folder, commit, commits[:i])
                self.store.place(folder, f"{self.root}/{commit}")
        return commits

    def vacuum(self) -> list[str]:
        """Delete segments of commits that the newest manifest no longer names, as after a compaction; returns them. Call it when no older reader is left."""
        old = sorted(set(self.store.names(self.root)) - set(self.store.commits(self.generation)))
        for name in old:
            self.store.delete(f"{self.root}/{name}")
        return old

    def schema(self, name: str) -> str | None:
        """Columns of a table that may have no rows and so no files; null lets the files say."""
        return None

    def table(self, name: str, commits: list[str]) -> DataFrame:
        """One table of the given commits' segments, with ``segment``: a commit's place among them."""
        columns = self.schema(name)
        reader = self.spark.read.schema(columns) if columns else self.spark.read
        parts = [reader.parquet(f"{self.root}/{commit}/{name}").withColumn("segment", F.lit(i)) for i, commit in enumerate(commits)]
        return reduce(DataFrame.unionByName, parts)

    def kinds(self, commits: list[str], *names: str) -> list[str]:
        """Types of the store's passage columns."""
        if self._kinds is None:
            self._kinds = {f.name: f.dataType.simpleString() for f in self.store.read_at("passages", self.generation, commits[-1:]).schema}
        return [self._kinds[n] for n in names]

    def live(self, rows: DataFrame, commits: list[str]) -> DataFrame:
        """Rows (segment, note_id, ...) whose note no later commit replaces or drops."""
        if len(commits) == 1:
            return rows
        gone = reduce(DataFrame.unionByName, [self.store.gone(self.generation, commit).select(F.col("note_id").alias("_gone"), F.lit(i).alias("_by")) for i, commit in enumerate(commits) if i])
        last = gone.groupBy("_gone").agg(F.max("_by").alias("_by"))
        return rows.join(last, (F.col("note_id") == F.col("_gone")) & (F.col("segment") < F.col("_by")), "left_anti")
