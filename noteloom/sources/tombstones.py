"""Notes that are to be removed for good, remembered until no generation holds them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .store import TOMBSTONES, SnapshotError, SnapshotStore


class Tombstones:
    """Batches of note ids below the store's folder.

    As long as a batch lies there, the store writes none of its notes, whoever asks for it, so purges go before other
    work. ``settle`` removes the notes from all generations and then the batch; after a crash in between the batch is
    still there, and settling again goes on. A note that is created anew later, under the same id, is stored again.
    """

    def __init__(self, store: SnapshotStore):
        self.store, self.spark, self.root = store, store.spark, f"{store.root}/{TOMBSTONES}"

    def bury(self, ids: DataFrame) -> str:
        """Remember notes (note_id) as a new batch, whole or not at all; returns its name."""
        name, new = uuid.uuid4().hex, f"{self.store.root}/new-{uuid.uuid4().hex}"
        ids.select("note_id").where("note_id is not null").distinct().write.parquet(new)
        if not self.store.exists(self.root):
            self.store.make(self.root)
        self.store.place(new, f"{self.root}/{name}")
        return name

    def batches(self) -> list[str]:
        return sorted(self.store.names(self.root))

    def pending(self) -> DataFrame:
        """Ids of the notes that are not yet known to be gone everywhere."""
        return self._ids(self.batches())

    def _ids(self, batches: list[str]) -> DataFrame:
        reader = self.spark.read.schema("note_id string")
        return reader.parquet(*(f"{self.root}/{b}" for b in batches)).distinct() if batches else self.spark.createDataFrame([], "note_id string")

    def settle(self, wait: float | None = None) -> dict[int, int]:
        """Remove all pending notes from every generation: number of served notes removed, by generation that held any in a file.

        Work begun before is made stale first. Generations are looked at again until all are clean, so one that was begun
        meanwhile is cleaned too; one whose files hold none of the notes is not rewritten. Readers' leases are waited for
        as in ``SnapshotStore.purge``; if they last longer, the batches stay.
        """
        batches, removed = self.batches(), {}
        if not batches:
            return removed
        ids = self._ids(batches)
        for number in self.store.generations():
            self.store.invalidate(number)
        while held := [g for g in self.store.generations() if self.store.holds(g, ids)]:
            if again := set(held) & set(removed):
                raise SnapshotError(f"purged notes came back in generations {sorted(again)}")
            for number in held:
                removed[number] = self.store.purge(number, ids, wait=wait)
        for batch in batches:
            self.store.delete(f"{self.root}/{batch}")
        return removed
