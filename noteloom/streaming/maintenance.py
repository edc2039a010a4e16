"""Keeping a store up to date with a folder from a stream of change notices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.admission import PathPolicy
from ..operators.embedding import Embedder
from ..plans.indexing import adopt_policy, reconcile, stored_policy, stored_state
from ..sources.notes import vault_policy
from ..sources.store import ATTEMPTS, Fence, SnapshotStore, StaleWork
from ..sources.tombstones import Tombstones
from .changes import apply_changes

PATHS = "path string, note_id string"


def maintain(notices: DataFrame, root: str, store: SnapshotStore, embedder: Embedder, checkpoint: str, policy: PathPolicy | None = PathPolicy(), vault: str = "vault", generation: int | None = 1, late: bool = False, wait: float | None = None) -> DataStreamWriter:
    """A writer that reconciles the store with the folder at each batch of notices; start it with the trigger of your choice.

    The rows of ``notices`` only say that something changed; what did is told by comparing the folder with the store,
    so a lost, repeated or late notice does no harm. A batch's number is its revision in the store's fence: a batch that
    is repeated after a crash finds its revision stored and is refused at the commit, and so is work that was begun
    before the generation was invalidated (``SnapshotStore.invalidate``), which is then done anew.
    Notes buried in the store's ``Tombstones`` are removed from all generations before anything else; readers' leases
    are waited for up to ``wait`` seconds. Numbers rise within one checkpoint. With a new checkpoint, invalidate the
    generation first. Without a generation,
    each batch goes to the one that is served then. Without a policy each batch takes the one that the store keeps
    (``watch_policy``); before there is one everything stays closed.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        Tombstones(store).settle(wait)
        target = stored_state(store).active if generation is None else generation
        for _ in range(ATTEMPTS):
            fence = store.fence(target)
            if number <= fence.revision:
                return
            # Read after the fence: a policy that is adopted from now on makes this work stale, and it is done anew.
            now = policy if policy is not None else stored_policy(store) or PathPolicy(valid=False)
            try:
                reconcile(batch.sparkSession, root, store, embedder, now, vault, target, late, Fence(fence.epoch, number))
                return
            except StaleWork:
                continue
        raise StaleWork(f"generation {target} was invalidated again and again")

    return notices.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def watch_policy(notices: DataFrame, root: str, store: SnapshotStore, embedder: Embedder, checkpoint: str, folders: list[str] = [], files: list[str] = [], vault: str = "vault", late: bool = False) -> DataStreamWriter:  # noqa: B006
    """A writer that keeps the store under the folder's ignore files and the given exclusions, looked at anew at each batch of notices.

    What changed is told by comparing with the policy that the store keeps, so lost, repeated and late notices do no
    harm, and a batch that comes again after a crash ends what the first began. Only notes that a change may concern
    are read.
    """

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            spark = batch.sparkSession
            adopt_policy(spark, root, store, embedder, vault_policy(spark, root, folders, files), vault, late)

    return notices.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


class PathMap:
    """Which note stands at which path, kept from a stream of changes: one table for each batch, below ``root``.

    A batch's table is written under another name and then renamed to the batch's number. A batch that comes again after
    a crash finds its table and changes nothing. Tables before the last two are deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = SnapshotStore(spark, self.root)

    def batches(self) -> list[int]:
        return sorted(int(n[6:]) for n in self._files.names(self.root) if n.startswith("batch-"))

    def _at(self, number: int) -> str:
        return f"{self.root}/batch-{number:010d}"

    def read(self) -> DataFrame:
        """(path, note_id) after the last batch."""
        held = self.batches()
        return self.spark.read.schema(PATHS).parquet(self._at(held[-1])) if held else self.spark.createDataFrame([], PATHS)

    def apply(self, changes: DataFrame, number: int) -> None:
        """Take in one batch, unless its table is there already."""
        held = self.batches()
        if held and held[-1] >= number:
            return
        new = f"{self.root}/new-{uuid.uuid4().hex}"
        apply_changes(self.read(), changes).write.parquet(new)
        self._files.place(new, self._at(number))
        for old in held[:-1]:
            self._files.delete(self._at(old))

    def follow(self, changes: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer that applies each batch of a stream of changes, such as ``FolderWatch.stream``."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
