"""From a folder of notes to served snapshots: change detection, reconcile and the whole index plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.properties import KEY_ARRAYS, explode_properties, registry, typed_columns
from ..functions.text import object_id, passage_id, snapshot_id, tag_ancestors
from ..lineage import cut
from ..operators.admission import IgnoreFile, PathPolicy, admission, affected, below
from ..operators.chunking import chunk_notes
from ..operators.embedding import Embedder, embed_late, embed_notes, embed_passages
from ..sources.notes import parse_notes, read_markdown
from ..schema import PASSAGE_SCHEMA
from ..sources.store import Fence, SnapshotError, SnapshotStore, StaleWork, in_scope

#: Columns of a passage that depend on its note's body alone.
PASSAGE_COLUMNS = (*PASSAGE_SCHEMA.names, "vector")


def index_actions(current: DataFrame, manifest: DataFrame, fingerprint: str) -> DataFrame:
    """Adds ``action``: ``noop`` for the same snapshot, ``metadata`` for the same body, else ``embed``.

    ``current`` has note_id, snapshot_id, body_hash; the manifest also committed and its own fingerprint.
    """
    old = manifest.select("note_id", F.col("snapshot_id").alias("_s"), F.col("body_hash").alias("_b"), F.col("fingerprint").alias("_f"), F.col("committed").alias("_c"))
    same_model = F.col("_f").eqNullSafe(fingerprint) & F.coalesce("_c", F.lit(False))
    action = F.when(same_model & (F.col("_s") == F.col("snapshot_id")), "noop").when(same_model & (F.col("_b") == F.col("body_hash")), "metadata").otherwise("embed")
    return current.join(old, "note_id", "left").withColumn("action", action).drop("_s", "_b", "_f", "_c")


def stale_notes(path_map: DataFrame, admitted: DataFrame, present: DataFrame) -> DataFrame:
    """Mapped paths that are no longer admitted, with ``forget`` where the file itself is gone (exclusion keeps the mapping)."""
    stale = path_map.join(admitted.select("path"), "path", "left_anti")
    return stale.join(present.select("path", F.lit(True).alias("_here")), "path", "left").withColumn("forget", F.col("_here").isNull()).drop("_here")


def complete(admitted: DataFrame, manifest: DataFrame, generation: int, fingerprint: str) -> DataFrame:
    """One row: whether every admitted note is served at this generation and model."""
    served = manifest.where(F.col("servable") & (F.col("generation") == generation) & (F.col("fingerprint") == fingerprint)).select("note_id", F.lit(True).alias("_ok"))
    return admitted.join(served, "note_id", "left").agg(F.coalesce(F.bool_and(F.coalesce("_ok", F.lit(False))), F.lit(True)).alias("complete"))


@dataclass
class IndexState:
    """The small state that outlives a run: the generation that is served, all numbers ever given, and a generation that is being built for another model."""

    active: int = 1
    known: list[int] = field(default_factory=lambda: [1])
    fingerprint: str = ""
    building: int | None = None
    building_fingerprint: str = ""

    def migrated(self, fingerprint: str) -> IndexState:
        """The state for a model: a new generation above all known ones if the model changed; the same state if not."""
        if fingerprint == self.fingerprint:
            return self
        known = sorted({*self.known, self.active})
        new = known[-1] + 1
        return IndexState(new, [*known, new], fingerprint)

    def begun(self, fingerprint: str) -> IndexState:
        """The state while a generation for this model is built beside the served one. One begun for the same model goes on; one for another model is given up, and so is any if the served model is asked for again."""
        if fingerprint == self.fingerprint:
            return IndexState(self.active, self.known, self.fingerprint)
        if self.building and fingerprint == self.building_fingerprint:
            return self
        new = self.migrated(fingerprint)
        return IndexState(self.active, new.known, self.fingerprint, new.active, fingerprint)

    def switched(self) -> IndexState:
        """The state once the generation that was built is served."""
        return IndexState(self.building, self.known, self.building_fingerprint)


def stored_state(store: SnapshotStore) -> IndexState:
    """The state in the store's manifest; without one, the newest generation under its rows' model, or a fresh state."""
    held = store.state()
    return IndexState(**held) if held else _first_state(store)


def _first_state(store: SnapshotStore) -> IndexState:
    generations = store.generations()
    if not generations:
        return IndexState()
    row = store.read("notes", generations[-1]).select("fingerprint").first()
    return IndexState(generations[-1], generations, row[0] if row else "")


@dataclass(frozen=True)
class IndexResult:
    notes: DataFrame
    passages: DataFrame
    rejected: DataFrame


def _admitted(spark: SparkSession, root: str, policy: PathPolicy, vault: str, generation: int, within: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Admitted notes with their identities, and all notes with the admission's verdict; only notes below some directories if these are named."""
    files = read_markdown(spark, root)
    judged = admission(parse_notes(files if within is None else files.where(below(F.col("path"), within))), policy)
    admitted = judged.where("admitted").withColumn("body_hash", F.sha2("canonical", 256))
    snapshot = snapshot_id(F.col("body_hash"), F.col("properties_json"), F.col("tags"), F.col("path"), F.lit(generation))
    return admitted.withColumns({"note_id": F.sha2(F.concat(F.lit(vault), F.lit("\0"), F.col("path")), 256), "snapshot_id": snapshot, "tag_ancestors": tag_ancestors(F.col("tags"))}), judged


def _note_rows(notes: DataFrame, fields: list[tuple[str, str, str]], scope: dict) -> DataFrame:
    """Stored notes: identity, vector, tags, key arrays and a typed column for each registered property."""
    held = typed_columns(notes, "properties_json", fields).withColumns(scope)
    own = ["note_id", "snapshot_id", "path", "title", "body_hash", "mode", "vector", "properties_json", *KEY_ARRAYS, "tags", "tag_ancestors", *scope, *(f[2] for f in fields)]
    return held.select(own)


def _passage_rows(passages: DataFrame, notes: DataFrame, fields: list[tuple[str, str, str]], vault: str) -> DataFrame:
    """Stored passages: their own columns with identity, tags and properties of their note, so a filtered search reads one table."""
    of_note = ["note_id", "snapshot_id", "path", "title", "tags", "tag_ancestors", *KEY_ARRAYS, "vault_id", "generation", "fingerprint", *(f[2] for f in fields)]
    joined = passages.select("note_id", "frontmatter_lines", *[c for c in PASSAGE_COLUMNS if c != "note_id"]).join(notes.select(of_note), "note_id")
    return joined.withColumn("object_id", object_id(F.concat_ws("\0", F.lit(vault), F.lit("passage"), "snapshot_id", F.concat_ws("|", "note_id", "passage_id"))))


def _embedded(notes: DataFrame, embedder: Embedder, late: bool, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Notes with their vectors, and their passages with vectors and the notes' frontmatter_lines.

    Both are written before they are used, so that each note meets the model once and is cut once. ``old`` passages of
    the same notes and model lend their vectors to unchanged bodies; in late mode a vector depends on its whole window,
    so none is reused.
    """
    whole = cut(notes.join(embed_notes(notes, "note_id", "canonical", embedder), "note_id"))
    passages = cut(chunk_notes(notes, "note_id", "canonical", embedder.context_limit, embedder.count, embedder.encode if late else None, late))
    held = passages.join(embed_late(notes, passages, "note_id", "canonical", embedder), ["note_id", "passage_index"]) if late else embed_passages(passages, embedder, old)
    return whole, cut(held).join(notes.select("note_id", "frontmatter_lines"), "note_id")


def _fields(notes: DataFrame) -> list[tuple[str, str, str]]:
    """Registered properties: a row for each key and kind, as many as the columns they become."""
    return sorted((r["key"], r["kind"], r["physical_name"]) for r in property_registry(notes).collect())


def build_index(spark: SparkSession, root: str, embedder: Embedder, policy: PathPolicy = PathPolicy(), vault: str = "vault", generation: int = 1, late: bool = False) -> IndexResult:
    """Plan of a full index: admitted notes and their passages with vectors, and the notes that were kept out with reasons."""
    notes, judged = _admitted(spark, root, policy, vault, generation)
    notes = cut(notes)
    scope = {"vault_id": F.lit(vault), "generation": F.lit(generation), "fingerprint": F.lit(embedder.fingerprint)}
    fields = _fields(notes)
    whole, passages = _embedded(notes, embedder, late)
    rows = _note_rows(whole, fields, scope)
    return IndexResult(rows, _passage_rows(passages, rows.drop("vector"), fields, vault), judged.where("not admitted").select("path", "reason", "deferred"))


def index_vault(spark: SparkSession, root: str, store: SnapshotStore, embedder: Embedder, fence: Fence | None = None, **options) -> IndexResult:
    """Build and publish in one go."""
    result = build_index(spark, root, embedder, **options)
    store.publish(options.get("generation", 1), result.notes, result.passages, fence, embedder.dims)
    return result


def reconcile(spark: SparkSession, root: str, store: SnapshotStore, embedder: Embedder, policy: PathPolicy = PathPolicy(), vault: str = "vault", generation: int = 1, late: bool = False, fence: Fence | None = None, within: list[str] | None = None) -> dict[str, int]:
    """Bring a served generation up to date with a folder: number of notes by action.

    Notes whose snapshot is served are left alone; those whose body is, but not their path, tags or properties, keep
    their vectors and passages under the new snapshot; others are embedded, but for passages whose body they had before;
    notes that are no longer admitted go. Only changed notes are written. An unknown generation is built in whole. With
    a fence, work that became stale meanwhile is refused as it is stored. With ``within`` only notes at or below these
    paths are looked at, and no other file is read.
    """
    if generation not in store.generations():
        index_vault(spark, root, store, embedder, fence, policy=policy, vault=vault, generation=generation, late=late)
        return {"embed": store.read("notes", generation).count()}
    notes, _ = _admitted(spark, root, policy, vault, generation, within)
    served, old_passages = store.read("notes", generation), store.read("passages", generation)
    if within is not None:
        served = served.where(below(F.col("path"), within))
    acted = cut(index_actions(notes, served.select("note_id", "snapshot_id", "body_hash", "fingerprint", F.lit(True).alias("committed")), embedder.fingerprint))
    purge = served.select("note_id").join(acted.select("note_id"), "note_id", "left_anti")
    counts = {r["action"]: r["n"] for r in acted.groupBy("action").agg(F.count("*").alias("n")).collect()} | {"purge": purge.count()}
    fields = _fields(acted)
    scope = {"vault_id": F.lit(vault), "generation": F.lit(generation), "fingerprint": F.lit(embedder.fingerprint)}
    moved = acted.where("action = 'metadata'")
    changed = acted.where("action = 'embed'")
    siblings = old_passages.where(F.col("fingerprint") == embedder.fingerprint).join(changed.select("note_id"), "note_id", "left_semi")
    new_rows, new_passages = _embedded(changed, embedder, late, siblings.select("body", "vector", "passage_index"))
    kept_rows = moved.join(served.select("note_id", "mode", "vector"), "note_id")
    kept_passages = old_passages.select(*PASSAGE_COLUMNS).join(moved.select("note_id", "frontmatter_lines"), "note_id")
    rows = _note_rows(new_rows.unionByName(kept_rows), fields, scope)
    passages = _passage_rows(new_passages.select("frontmatter_lines", *PASSAGE_COLUMNS).unionByName(kept_passages.select("frontmatter_lines", *PASSAGE_COLUMNS)), rows.drop("vector"), fields, vault)
    if counts.get("embed") or counts.get("metadata") or counts["purge"]:
        store.upsert(generation, rows, passages, purge, fence, embedder.dims)
    return counts


def update_index(spark: SparkSession, root: str, store: SnapshotStore, embedder: Embedder, policy: PathPolicy = PathPolicy(), vault: str = "vault", late: bool = False) -> IndexState:
    """Bring the store up to date with folder and model, and return its state.

    With the model that is served, the served generation is reconciled. With another one, a new generation is built
    while the old one is served; it is reconciled once more, for what changed meanwhile, and then served by one exchange
    of manifests, after which all other generations are dropped. The state lies in the manifest. After a crash at any
    step some whole generation is served, and the same call goes on: what was built is kept, and leftovers are dropped.
    ``StaleWork`` if the generation was invalidated meanwhile, or another model was asked for.
    """
    first = _first_state(store)
    state = IndexState(**store.change_state(lambda held: asdict((IndexState(**held) if held else first).begun(embedder.fingerprint))))
    number = state.building or state.active

    def bring() -> None:
        fence = store.fence(number)
        reconcile(spark, root, store, embedder, policy, vault, number, late, Fence(fence.epoch, fence.revision + 1))

    bring()
    if state.building:
        bring()

        def switch(held: dict) -> dict:
            now = IndexState(**held)
            if now.building != number:
                raise StaleWork(f"generation {number} is no longer the one to build")
            return asdict(now.switched())

        state = IndexState(**store.change_state(switch))
    for other in store.generations():
        if other != state.active:
            store.drop(other)
    return state


def follow_policy(spark: SparkSession, root: str, store: SnapshotStore, embedder: Embedder, before: PathPolicy, after: PathPolicy, vault: str = "vault", late: bool = False, fence: Fence | None = None) -> dict[str, int]:
    """Bring the served generation under a changed policy: number of notes by action. Only notes that the change may concern are read.

    ``vault_policy`` reads the policy of now. A policy that could not be read (``valid`` false) closes everything.
    """
    where = affected(before, after)
    if not where:
        return {}
    return reconcile(spark, root, store, embedder, after, vault, stored_state(store).active, late, fence, where)


def _policy(held: dict | None) -> PathPolicy | None:
    if held is None:
        return None
    controls = tuple(IgnoreFile(c["directory"], c["source"], tuple(c["lines"])) for c in held["controls"])
    return PathPolicy(tuple(held["folders"]), tuple(held["files"]), controls, tuple(held["failed"]), held["valid"])


def stored_policy(store: SnapshotStore) -> PathPolicy | None:
    """The policy that the store's index is under, or is being brought under; None before the first."""
    return _policy(store.policy().get("current"))


def adopt_policy(spark: SparkSession, root: str, store: SnapshotStore, embedder: Embedder, policy: PathPolicy, vault: str = "vault", late: bool = False) -> dict[str, int]:
    """Make a policy the store's own and bring the served generation under it: number of notes by action.

    The policy is stored first, together with the one before and a new epoch, so work begun under the old policy can't
    be stored any more. Then only notes that the change may concern are read; the first policy concerns all. After a
    crash the next call, whatever its policy, first ends the change that was begun. The policy that is there already
    changes nothing.
    """
    counts: dict[str, int] = {}

    def follow() -> None:
        held, number = store.policy(), stored_state(store).active
        fence = store.fence(number)
        before, after = _policy(held["before"]), _policy(held["current"])
        where = None if before is None else affected(before, after)
        if where is None or where:
            done = reconcile(spark, root, store, embedder, after, vault, number, late, Fence(fence.epoch, fence.revision + 1), where)
            counts.update({k: counts.get(k, 0) + n for k, n in done.items()})
        store.change_policy(lambda now: {k: v for k, v in now.items() if k != "before"} if now == held else now)

    if "before" in store.policy():
        follow()
    if stored_policy(store) != policy:
        store.change_policy(lambda now: {"current": asdict(policy), "before": now.get("before", now.get("current"))}, stored_state(store).active)
        follow()
    return counts


def served(store: SnapshotStore, kind: str, vault: str, fingerprint: str) -> DataFrame:
    """Rows of the served generation, for searches with a model; an error if another model is served, whose vectors say nothing beside this one's."""
    state = stored_state(store)
    if state.fingerprint != fingerprint:
        raise SnapshotError(f"served is the model {state.fingerprint!r}, asked is {fingerprint!r}")
    return store.read(kind, state.active).where(in_scope(vault, state.active, fingerprint))


def purge_everywhere(store: SnapshotStore, ids: DataFrame) -> dict[int, int]:
    """Remove notes (note_id) for good from every generation: number removed by generation.

    Work that was begun before, on any generation or the one being built, is refused at its commit, so it can't bring
    the notes back; what is begun later reads the folder, where they are gone or kept out.
    """
    for number in {*stored_state(store).known, *store.generations()}:
        store.invalidate(number)
    return {number: store.purge(number, ids) for number in store.generations()}


def property_registry(notes: DataFrame) -> DataFrame:
    """Registry of all properties of the notes: (key, kind, physical_name)."""
    return registry(explode_properties(notes, "note_id", "properties_json"))


def passage_ids(passages: DataFrame) -> DataFrame:
    return passages.withColumn("passage_id", passage_id(F.col("passage_index"), F.col("start"), F.col("end")))
