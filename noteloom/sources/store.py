"""Versioned note and passage tables as Parquet, with manifests that name what is served.

A generation is a list of commits: the first holds its tables, later ones the notes that changed, and the ids of those
that they replace or drop. Data are written first; a new manifest is then put in place under the next number, which
fails if another writer was faster. Readers see a whole manifest or the one before. A lost job leaves at most unnamed
folders behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .validation import note_rules, passage_rules, whole_notes, with_faults

#: Commits of a generation before it is rewritten as one, manifests kept for slow readers, and tries of a writer among others.
MOST_COMMITS, KEPT_MANIFESTS, ATTEMPTS = 16, 4, 20
#: The manifest's entries for fences, for the index's state and for the policy, beside the generations.
FENCES, STATE, POLICY = "fences", "state", "policy"
#: Folders beside the tables: readers' leases, rows that broke a rule, notes to be removed for good.
LEASES, QUARANTINE, TOMBSTONES = "leases", "quarantine", "tombstones"
#: Seconds that a lease lasts unless it is renewed, and that pass between two looks at the leases.
LEASE_SECONDS, LEASE_POLL = 600.0, 0.2
#: Folders of the indexes that follow a generation's commits.
INDEXES = ("keywords", "vectors/notes", "vectors/passages")


class SnapshotError(RuntimeError):
    """Stored rows do not match what was to be stored."""


class StaleWork(RuntimeError):
    """Work was begun before everything was invalidated, or is no newer than what is stored: it must not be stored."""


class ReadersRemain(SnapshotError):
    """What was purged is served no more, but readers still hold files of replaced commits; sweep later."""


class Lease:
    """A reader's hold on a generation's commits: their files stay until it ends or runs out."""

    def __init__(self, store: SnapshotStore, generation: int, seconds: float):
        self.store, self.generation, self.seconds, self._name = store, generation, seconds, None
        for _ in range(ATTEMPTS):
            self.commits = store.commits(generation)
            self._put()
            # Whoever replaces commits looks for leases after the exchange of manifests, so a lease that was there before is seen.
            if store.commits(generation) == self.commits:
                return
            self.end()
        raise SnapshotError("other writers kept changing the manifest")

    def _put(self) -> None:
        old, self.until = self._name, time.time() + self.seconds
        self._name = f"{self.store._leases(self.generation)}/{uuid.uuid4().hex}.json"
        self.store.put(self._name, json.dumps({"until": self.until, "commits": self.commits}))
        if old:
            self.store.delete(old)

    def renew(self) -> None:
        """Hold on for another term; an error if this one has run out, as files may be gone."""
        if time.time() >= self.until:
            raise SnapshotError("the lease has run out")
        self._put()

    def end(self) -> None:
        self.store.delete(self._name)

    def read(self, kind: str) -> DataFrame:
        """The generation's table as it was when the lease began."""
        return self.store.read_at(kind, self.generation, self.commits)


@dataclass(frozen=True)
class Fence:
    """What a writer knew when it began: the generation's epoch, and the revision of its own work. Revisions of an epoch only rise."""

    epoch: int
    revision: int


def _next_epoch(held: dict, generation: int, revision: int = -1) -> dict:
    """The manifest with a new epoch for a generation, in which nothing above ``revision`` is stored yet."""
    epoch, _ = held.get(FENCES, {}).get(str(generation), [0, -1])
    return held | {FENCES: held.get(FENCES, {}) | {str(generation): [epoch + 1, revision]}}


class SnapshotStore:
    """Tables ``notes`` and ``passages`` for each generation below a folder that all executors share."""

    KINDS = ("notes", "passages")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(root))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self) -> tuple[int, dict]:
        """Number of the newest manifest and, by generation, its commits, oldest first."""
        versions = self._versions()
        if not versions:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/manifest-{versions[-1]}.json", wholetext=True).first()[0]
        return versions[-1], json.loads(text)

    def _change(self, change: Callable[[dict], dict]) -> None:
        """Put a changed manifest in place; if another writer was faster, change that one's instead."""
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for _ in range(ATTEMPTS):
            version, held = self._manifest()
            name = f"{self.root}/new-{uuid.uuid4().hex}"
            self.put(name, json.dumps(change(held), sort_keys=True))
            new = self._path(name)
            try:
                files.rename(files.makeQualified(new), files.makeQualified(self._path(f"{self.root}/manifest-{version + 1}.json")), never)
                for old in self._versions()[:-KEPT_MANIFESTS]:
                    self._fs.delete(self._path(f"{self.root}/manifest-{old}.json"), False)
                return
            except Py4JJavaError as e:
                self._fs.delete(new, False)
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
        raise SnapshotError("other writers kept changing the manifest")

    def place(self, built: str, name: str) -> bool:
        """Give a finished folder its name; if another writer was faster, the folder is deleted and the answer is false."""
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(files.makeQualified(self._path(built)), files.makeQualified(self._path(name)), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            self._fs.delete(self._path(built), True)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False

    def put(self, name: str, text: str) -> None:
        """Write a small file."""
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def exists(self, folder: str) -> bool:
        return self._fs.exists(self._path(folder))

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def generations(self) -> list[int]:
        return sorted(int(g) for g in self._manifest()[1] if g not in (FENCES, STATE, POLICY))

    def state(self) -> dict:
        """The small state that is kept in the manifest; empty before the first is stored."""
        return self._manifest()[1].get(STATE, {})

    def change_state(self, change: Callable[[dict], dict]) -> dict:
        """Store a changed state and return it. If another writer was faster, the change is made to that one's state; an error in ``change`` stores nothing."""
        stored: dict = {}

        def within(held: dict) -> dict:
            nonlocal stored
            stored = change(held.get(STATE, {}))
            return held | {STATE: stored}

        if not self.exists(self.root):
            self.make(self.root)
        self._change(within)
        return stored

    def policy(self) -> dict:
        """The policy that is kept in the manifest; empty before the first is stored."""
        return self._manifest()[1].get(POLICY, {})

    def change_policy(self, change: Callable[[dict], dict], stop: int | None = None) -> None:
        """Store a changed policy. In the same exchange a new epoch begins for the generation ``stop``, so fenced work that was begun under the policy before is refused. It leaves revision -1 to the policy's own work, before a stream's batch 0."""

        def within(held: dict) -> dict:
            new = held | {POLICY: change(held.get(POLICY, {}))}
            return new if stop is None else _next_epoch(new, stop, -2)

        if not self.exists(self.root):
            self.make(self.root)
        self._change(within)

    def fence(self, generation: int) -> Fence:
        """The generation's epoch and the revision stored last in it (-1: none)."""
        return Fence(*self._manifest()[1].get(FENCES, {}).get(str(generation), [0, -1]))

    def invalidate(self, generation: int) -> int:
        """Begin a new epoch: fenced work that was begun before is refused at its commit. Returns the epoch."""
        self._change(lambda held: _next_epoch(held, generation))
        return self.fence(generation).epoch

    def _commit(self, generation: int, commit: str, fence: Fence | None, change: Callable[[dict], dict]) -> None:
        """Name a written commit in the manifest if its fence still stands there; else its files go, and the work is stale.

        The fence is compared in the same exchange of manifests that names the commit, so no older writer comes between.
        """

        def fenced(held: dict) -> dict:
            if fence is None:
                return change(held)
            epoch, revision = held.get(FENCES, {}).get(str(generation), [0, -1])
            if fence.epoch != epoch or fence.revision <= revision:
                raise StaleWork(f"epoch {fence.epoch}, revision {fence.revision} came after epoch {epoch}, revision {revision}")
            return change(held) | {FENCES: held.get(FENCES, {}) | {str(generation): [fence.epoch, fence.revision]}}

        try:
            self._change(fenced)
        except StaleWork:
            for kind in (*self.KINDS, "gone"):
                self.delete(self._at(kind, generation, commit))
            raise

    def _commits(self, generation: int) -> list[str]:
        held = self._manifest()[1].get(str(generation))
        if held is None:
            raise SnapshotError(f"generation {generation} does not exist")
        return held

    def _at(self, kind: str, generation: int, commit: str) -> str:
        return f"{self.root}/{kind}/generation={generation}/commit={commit}"

    def read(self, kind: str, generation: int) -> DataFrame:
        """One generation's table; partition pruning is by the folder. A row counts unless a later commit replaces or drops its note."""
        return self.read_at(kind, generation, self._commits(generation))

    def commits(self, generation: int) -> list[str]:
        """Names of a generation's commits, oldest first: a snapshot that ``read_at`` reads whatever others write meanwhile."""
        return list(self._commits(generation))

    def gone(self, generation: int, commit: str) -> DataFrame:
        """Ids of the notes that a commit replaces or drops; the first commit has no such table."""
        return self.spark.read.parquet(self._at("gone", generation, commit))

    def read_at(self, kind: str, generation: int, commits: list[str]) -> DataFrame:
        """A generation's table as it was after the last of these commits."""
        parts = [self.spark.read.parquet(self._at(kind, generation, commits[-1]))]
        gone = None
        for older, newer in zip(commits[-2::-1], commits[:0:-1]):
            ids = self.gone(generation, newer)
            gone = ids if gone is None else gone.unionByName(ids).distinct()
            parts.append(self.spark.read.parquet(self._at(kind, generation, older)).join(gone, "note_id", "left_anti"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _buried(self) -> DataFrame | None:
        """Ids of notes that are to be removed for good; none as a rule."""
        batches = self.names(f"{self.root}/{TOMBSTONES}")
        return self.spark.read.schema("note_id string").parquet(*(f"{self.root}/{TOMBSTONES}/{b}" for b in batches)).distinct() if batches else None

    def _put_tables(self, generation: int, notes: DataFrame, passages: DataFrame) -> tuple[str, list[DataFrame]]:
        commit = uuid.uuid4().hex
        for kind, df in zip(self.KINDS, (notes, passages)):
            df.write.parquet(self._at(kind, generation, commit))
        return commit, [self.spark.read.parquet(self._at(k, generation, commit)) for k in self.KINDS]

    def _write(self, generation: int, notes: DataFrame, passages: DataFrame) -> str:
        if (buried := self._buried()) is not None:
            notes, passages = (df.join(buried, "note_id", "left_anti") for df in (notes, passages))
        commit, tables = self._put_tables(generation, notes, passages)
        verify_snapshot(*tables)
        return commit

    def _held_to_rules(self, generation: int, commit: str, dims: int | None) -> str:
        """The written commit if no row breaks a rule, or none are asked for; else one of the whole notes alone, with all rows of the others in quarantine."""
        if dims is None:
            return commit
        tables = [self.spark.read.parquet(self._at(k, generation, commit)) for k in self.KINDS]
        judged = [with_faults(df, {n: r for n, r in rules.items() if n not in ("path", "vector") or n in df.columns}) for df, rules in zip(tables, (note_rules(dims), passage_rules(dims)))]
        bad = [df.where(F.size("faults") > 0).select("note_id") for df in judged]
        if all(df.isEmpty() for df in bad):
            return commit
        named = bad[0].unionByName(bad[1]).distinct()
        good, _ = self._put_tables(generation, *whole_notes(*judged))
        for kind, df in zip(self.KINDS, judged):
            df.alias("r").join(named.alias("b"), F.expr("r.note_id <=> b.note_id"), "left_semi").write.parquet(f"{self._quarantine(kind, generation)}/commit={good}")
        for kind in self.KINDS:
            self.delete(self._at(kind, generation, commit))
        return good

    def _quarantine(self, kind: str, generation: int) -> str:
        return f"{self.root}/{QUARANTINE}/{kind}/generation={generation}"

    def quarantined(self, kind: str, generation: int) -> DataFrame | None:
        """Rows that are not served because they, or others of their note, broke a rule, with ``faults``; None if there never were any."""
        folder = self._quarantine(kind, generation)
        parts = [self.spark.read.parquet(f"{folder}/{n}") for n in self.names(folder)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def publish(self, generation: int, notes: DataFrame, passages: DataFrame, fence: Fence | None = None, dims: int | None = None) -> None:
        """Replace a generation's tables as a pair; the written rows are verified before they are served. ``StaleWork`` if the fence has fallen.

        With ``dims``, the width of the vectors, rows are held to the rules of ``validation``: notes of which a row
        breaks one are not served, and all their rows go to the quarantine with the names of the rules. Rows that do not
        match as a pair, such as those without a note_id, are an error as ever. Notes that wait
        to be removed for good (``Tombstones``) are not written.
        """
        commit = self._held_to_rules(generation, self._write(generation, notes, passages), dims)
        self._commit(generation, commit, fence, lambda held: held | {str(generation): [commit]})

    def upsert(self, generation: int, notes: DataFrame, passages: DataFrame, purge: DataFrame | None = None, fence: Fence | None = None, dims: int | None = None) -> None:
        """Replace the snapshots of the given notes and drop those in ``purge`` (note_id), writing these notes alone. ``StaleWork`` if the fence has fallen.

        ``dims`` is as in ``publish``; of a note that broke a rule the snapshot before is still served.
        """
        if generation not in self.generations():
            return self.publish(generation, notes, passages, fence, dims)
        commit = self._held_to_rules(generation, self._write(generation, notes, passages), dims)
        gone = self.spark.read.parquet(self._at("notes", generation, commit)).select("note_id")
        (gone if purge is None else gone.unionByName(purge.select("note_id"))).distinct().write.parquet(self._at("gone", generation, commit))
        self._commit(generation, commit, fence, lambda held: held | {str(generation): [*held[str(generation)], commit]})
        if len(self._commits(generation)) > MOST_COMMITS:
            self.compact(generation)

    def compact(self, generation: int) -> None:
        """Rewrite a generation as one commit; commits that others have added meanwhile stay on top. Old files are kept for readers until the generation is dropped."""
        commits = self._commits(generation)
        whole = self._write(generation, *(self.read(k, generation) for k in self.KINDS))

        def change(held: dict) -> dict:
            now = held[str(generation)]
            if now[: len(commits)] != commits:
                raise SnapshotError("the generation was replaced while it was compacted")
            return held | {str(generation): [whole, *now[len(commits) :]]}

        self._change(change)

    def purge(self, generation: int, ids: DataFrame, fence: Fence | None = None, wait: float | None = None) -> int:
        """Remove notes for good: they are no longer served, their rows are in no file, and the number of notes removed is returned.

        The generation is rewritten without them and read back; only then files of replaced commits go, and with them
        the search indexes' segments of these, and the notes' rows in quarantine. Readers with a lease (``reading``) are
        waited for, up to ``wait`` seconds (by default as long as a lease lasts); then ``ReadersRemain``. A reader
        without a lease that still reads the old files fails, and may begin anew. Unknown ids (note_id) are no error.
        """
        named = ids.select("note_id").distinct()
        served = self.read("notes", generation).join(named, "note_id", "left_semi").count()
        none = [self.read(kind, generation).limit(0) for kind in self.KINDS]
        self.upsert(generation, *none, purge=named, fence=fence)
        self.compact(generation)
        for kind in self.KINDS:
            if not self.read(kind, generation).join(named, "note_id", "left_semi").isEmpty():
                raise SnapshotError(f"purged rows are still among the {kind}")
            folder = self._quarantine(kind, generation)
            if old := self.names(folder):
                self.quarantined(kind, generation).join(named, "note_id", "left_anti").write.parquet(f"{folder}/commit={uuid.uuid4().hex}")
                for name in old:
                    self.delete(f"{folder}/{name}")
        end = time.time() + (LEASE_SECONDS if wait is None else wait)
        while self.leased(generation) - set(self.commits(generation)):
            if time.time() >= end:
                raise ReadersRemain(f"readers hold replaced commits of generation {generation}")
            time.sleep(LEASE_POLL)
        self.sweep(generation)
        return served

    def holds(self, generation: int, ids: DataFrame) -> bool:
        """Whether any file of a generation holds rows of these notes (note_id), served or not."""
        named = ids.select("note_id").distinct()
        folders = [f"{folder}/{n}" for kind in self.KINDS for folder in (f"{self.root}/{kind}/generation={generation}", self._quarantine(kind, generation)) for n in self.names(folder)]
        rows = [self.spark.read.parquet(f).select("note_id") for f in folders]
        return bool(rows) and not reduce(DataFrame.unionByName, rows).join(named, "note_id", "left_semi").isEmpty()

    def _leases(self, generation: int) -> str:
        return f"{self.root}/{LEASES}/generation={generation}"

    @contextmanager
    def reading(self, generation: int, seconds: float = LEASE_SECONDS) -> Iterator[Lease]:
        """A lease on the generation's commits: a purge or sweep leaves their files until the block ends, or the time runs out without ``renew``. Clocks of the machines should agree within a few seconds."""
        lease = Lease(self, generation, seconds)
        try:
            yield lease
        finally:
            lease.end()

    def leased(self, generation: int) -> set[str]:
        """Commits that readers hold; leases that have run out are deleted."""
        folder, held = self._leases(generation), set()
        names = [n for n in self.names(folder) if n.endswith(".json")]
        if not names:
            return held
        files = self.spark.read.schema("until double, commits array<string>").option("ignoreMissingFiles", True).json([f"{folder}/{n}" for n in names])
        for row in files.select("until", "commits", F.input_file_name().alias("at")).collect():  # one small row a reader
            if row["until"] <= time.time():
                self.delete(f"{folder}/{row['at'].rsplit('/', 1)[1]}")
            else:
                held.update(row["commits"])
        return held

    def sweep(self, generation: int) -> list[str]:
        """Delete the files of commits that neither the newest manifest nor a reader's lease names; returns these commits. Work that is being written is not named yet: sweep when no writer is at work."""
        named, swept = set(self.commits(generation)) | self.leased(generation), set()
        for kind in (*self.KINDS, "gone"):
            folder = f"{self.root}/{kind}/generation={generation}"
            for name in self.names(folder):
                if name.removeprefix("commit=") not in named:
                    self.delete(f"{folder}/{name}")
                    swept.add(name.removeprefix("commit="))
        for index in INDEXES:
            folder = f"{self.root}/{index}/generation={generation}"
            for name in set(self.names(folder)) - named:
                self.delete(f"{folder}/{name}")
        return sorted(swept)

    def drop(self, generation: int) -> None:
        """Forget a generation, then delete its files; an unknown one is no error."""
        if generation in self.generations():
            self._change(lambda held: {g: c for g, c in held.items() if g != str(generation)})
        for kind in (*self.KINDS, "gone", *INDEXES, *(f"{QUARANTINE}/{k}" for k in self.KINDS)):
            self.delete(f"{self.root}/{kind}/generation={generation}")

    def vectors(self, generation: int, keys: list[tuple[str, str]]) -> DataFrame:
        """Vectors of 1 to 31 (note_id, snapshot_id) keys with their request position; each must exist once."""
        from ..schema import GRAPH_KEYS

        if not 1 <= len(keys) <= GRAPH_KEYS or len(set(keys)) != len(keys):
            raise ValueError("ask for 1 to 31 different keys")
        wanted = self.spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "position int, note_id string, snapshot_id string")
        found = self.read("notes", generation).join(F.broadcast(wanted), ["note_id", "snapshot_id"]).select("position", "note_id", "snapshot_id", "vector")
        if found.count() != len(keys):
            raise SnapshotError("stored vectors do not match the keys")
        return found.orderBy("position")

    def passages_of(self, generation: int, note_id: str, snapshot_id: str) -> DataFrame:
        return ordered_passages(self.read("passages", generation), {"note_id": note_id, "snapshot_id": snapshot_id}, "passage_index")


def ordered_passages(passages: DataFrame, scope: dict, index: str) -> DataFrame:
    """Passages whose columns have the given values, in the order of their index."""
    return passages.where(reduce(and_, (F.col(c) == v for c, v in scope.items()))).orderBy(index)


def page(df: DataFrame, order: str | list[str], number: int, size: int = 64) -> DataFrame:
    """One page of an ordered table."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).offset(number * size).limit(size)


def contiguity(passages: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, n, contiguous): whether each group's indices are 0 to n-1, told from aggregates alone."""
    ok = (F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*"))
    return passages.groupBy(*keys).agg(F.count("*").alias("n"), ok.alias("contiguous"))


def verify_snapshot(notes: DataFrame, passages: DataFrame) -> None:
    """Each note once, with at least one passage, contiguous and of the same snapshot; else an error."""
    repeated = notes.groupBy("note_id").count().where("count > 1")
    broken = contiguity(passages, ["note_id", "snapshot_id"], "passage_index").where("not contiguous")
    lone = notes.join(passages, ["note_id", "snapshot_id"], "left_anti").unionByName(passages.select("note_id", "snapshot_id").join(notes, ["note_id", "snapshot_id"], "left_anti"), allowMissingColumns=True)
    for what, bad in (("a note is stored twice", repeated), ("passages are incomplete", broken), ("notes and passages do not match", lone)):
        if not bad.isEmpty():
            raise SnapshotError(what)


def in_scope(vault: str, generation: int, fingerprint: str) -> Column:
    return (F.col("vault_id") == vault) & (F.col("generation") == generation) & (F.col("fingerprint") == fingerprint)
