"""Change streams: last write wins, trailing debounce, tombstones. Each works on batch and streaming frames alike unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import cut
from ..schema import DEBOUNCE_SECONDS, EVENT_TEXT_CAP


def last_write_wins(changes: DataFrame, key: str, revision: str, columns: list[str]) -> DataFrame:
    """The row of the greatest revision for each key, of equal revisions that of the greatest values; combined before the shuffle."""
    newest = F.max(F.struct(revision, *columns)).alias("_row")
    return changes.groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}").alias(c) for c in (revision, *columns)])


def retained_text(text: str) -> F.Column:
    """The event's own text if short enough to keep, else null: the file is read again later."""
    return F.when(F.length(text) <= EVENT_TEXT_CAP, F.col(text))


def debounce_sessions(changes: DataFrame, key: str, ts: str, gap_seconds: int = DEBOUNCE_SECONDS, payload: str | None = None) -> DataFrame:
    """One row for each burst of changes of a key: its first and last change, its size, and the last payload (the greatest of equal times).

    On a stream, put a watermark on ``ts`` first; a burst comes out once the watermark passes its quiet time.
    """
    last = [F.max_by(payload, F.struct(ts, payload)).alias(payload)] if payload else []
    bursts = changes.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.max(ts).alias("last_change"), F.count("*").alias("changes"), *last)
    return bursts.select(key, F.col("w.start").alias("first_change"), "last_change", "changes", *([payload] if payload else []))


def open_bursts(spark: SparkSession, checkpoint: str, key: str, payload: str | None = None) -> DataFrame:
    """Bursts that a stopped stream of ``debounce_sessions`` still holds in its state, in the same columns: what its watermark has not closed."""
    held = spark.read.format("statestore").load(checkpoint).select("value.*")
    last = [F.col("valueWithExtremumOrdering").alias(payload)] if payload else []
    return held.select(key, F.col("session_window.start").alias("first_change"), F.col("max").alias("last_change"), F.col("count").alias("changes"), *last)


def debounce_stream(changes: DataFrame, key: str, ts: str, payload: str, gap_seconds: int = DEBOUNCE_SECONDS, known: str | None = None) -> DataFrame:
    """Trailing debounce on a watermarked stream, by event time: each change restarts its key's clock.

    With ``known`` (a boolean column), the first change of an unknown key comes out at once. State holds one pending
    change for each key. Late changes, older than the pending one, are dropped.
    """
    schema = changes.schema
    kind = schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [key, "at", payload]
        if state.hasTimedOut:
            at, held = state.get
            state.remove()
            yield pd.DataFrame([(group[0], pd.Timestamp(at, unit="us"), held)], columns=names)
            return
        rows = pd.concat(list(frames)).sort_values([ts, payload])
        at, held = state.get if state.exists else (None, None)
        out = []
        for row in rows.to_dict("records"):
            now = int(row[ts].value // 1000)
            if at is not None and now < at:
                continue
            if at is None and known and not row[known]:
                out.append((group[0], row[ts], row[payload]))
                continue
            if at is not None and now >= at + gap_seconds * 1_000_000:
                out.append((group[0], pd.Timestamp(at, unit="us"), held))
            at, held = now, row[payload]
        if at is not None:
            state.update((at, held))
            state.setTimeoutTimestamp(max(at // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return changes.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, {payload} string", "at long, held string", "append", GroupStateTimeout.EventTimeTimeout)


def debounce_arrivals(changes: DataFrame, key: str, order: str, payload: str, gap_seconds: float = DEBOUNCE_SECONDS, known: str | None = None) -> DataFrame:
    """Trailing debounce on a stream by the clock: a key's newest change comes out once none has arrived for the gap.

    ``order`` (a whole number, such as a revision) says which of a key's changes is the newest; an older one that arrives
    late restarts the clock but is not kept. With ``known`` (a boolean column) the first change of an unknown key that
    nothing is held for comes out at once. The stream wakes by itself: as long as it runs, each trigger lets out what is
    due, with or without new changes; so under ``availableNow`` it would never end, and ``once`` takes in what is there
    and lets out what is due. State holds one change for each key, so a payload should be short: see
    ``retained_text``. After a restart, what was held is let out when its time has come.
    """
    kinds = {c: changes.schema[c].dataType.simpleString() for c in (key, order, payload)}
    names = [key, order, payload]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(group[0], *held)], columns=names)
            return
        rows = pd.concat(list(frames)).sort_values([order, payload])
        at_once = known and not state.exists and not rows[known].iloc[0]
        waiting = [(int(o), p) for o, p in zip(rows[order], rows[payload])][1 if at_once else 0 :]
        if state.exists:
            waiting.append(tuple(state.get))
        if waiting:
            state.update(max(waiting, key=lambda w: w[0]))
            state.setTimeoutDuration(int(gap_seconds * 1000))
        yield rows.iloc[:1][names] if at_once else pd.DataFrame([], columns=names)

    return changes.groupBy(key).applyInPandasWithState(step, ", ".join(f"{n} {k}" for n, k in kinds.items()), f"newest long, held {kinds[payload]}", "append", GroupStateTimeout.ProcessingTimeTimeout)


def held_arrivals(spark: SparkSession, checkpoint: str, key: str, order: str, payload: str) -> DataFrame:
    """What a stopped stream of ``debounce_arrivals`` still holds, in its columns."""
    held = spark.read.format("statestore").load(checkpoint).select("key.*", "value.groupState.*")
    return held.select(F.col(held.columns[0]).alias(key), F.col("newest").alias(order), F.col("held").alias(payload)).where(f"{order} is not null")


def live_rows(changes: DataFrame, key: str, revision: str, deleted: F.Column) -> DataFrame:
    """The newest row of each key that is no tombstone."""
    columns = [c for c in changes.columns if c not in (key, revision)]
    return last_write_wins(changes.withColumn("_gone", deleted), key, revision, [*columns, "_gone"]).where("not _gone").drop("_gone")


def apply_changes(path_map: DataFrame, changes: DataFrame) -> DataFrame:
    """Path-to-note mapping (path, note_id) after all changes in the order of their revisions.

    ``changes`` has path, op (create, modify, rename, delete), old_path, revision and note_id for created notes. A
    rename carries the note of its old path to the new one, whose former note goes; a delete drops the mapping; a
    modification leaves it. Equal revisions are taken in the order of op, path and old path; of
    creates alike in all of these the least note_id counts.

    The last change at a path says what is there: nothing, a created note, or what a rename brought. A rename points to
    the change that came before it at its old path, and pointers are followed in doubling steps.
    """
    own = changes.where("op in ('create', 'rename', 'delete') and not (op = 'rename' and old_path <=> path)").groupBy("revision", "op", "path", "old_path").agg(F.min("note_id").alias("note_id"))
    own = own.withColumn("at", F.struct("revision", "op", "path", "old_path"))
    kind = F.when(F.col("op") == "create", "note").when(F.col("op") == "rename", "move").otherwise("none")
    here = own.select("path", "at", kind.alias("kind"), F.when(F.col("op") == "create", F.col("note_id")).alias("note_id"))
    left = own.where("op = 'rename'").select(F.col("old_path").alias("path"), "at", F.lit("left").alias("kind"), F.lit(None).cast(path_map.schema["note_id"].dataType).alias("note_id"))
    touches = here.unionByName(left)
    before = F.lag(F.struct("kind", "note_id", "at")).over(Window.partitionBy("path").orderBy("at"))
    moves = touches.withColumn("before", before).where("kind = 'left'")
    first = path_map.select("path", F.col("note_id").alias("first"))
    moves = moves.join(first, "path", "left").select(
        "at", F.when(F.col("before").isNull(), F.col("first")).when(F.col("before.kind") == "note", F.col("before.note_id")).alias("note_id"), F.when(F.col("before.kind") == "move", F.col("before.at")).alias("next")
    )
    moves = cut(moves)
    while not moves.where("next is not null").isEmpty():
        further = moves.select(F.col("at").alias("next"), F.col("note_id").alias("found"), F.col("next").alias("after"))
        joined = moves.alias("m").join(further.alias("f"), F.expr("m.next = f.next"), "left")
        moves = cut(joined.select("m.at", F.coalesce("m.note_id", "f.found").alias("note_id"), F.col("f.after").alias("next")))
    last = touches.groupBy("path").agg(F.max_by(F.struct("kind", "note_id", "at"), "at").alias("last"))
    brought = last.join(moves.select("at", F.col("note_id").alias("brought")), F.col("last.at") == F.col("at"), "left")
    changed = brought.select("path", F.when(F.col("last.kind") == "note", F.col("last.note_id")).when(F.col("last.kind") == "move", F.col("brought")).alias("note_id"))
    return path_map.select("path", "note_id").join(last.select("path"), "path", "left_anti").unionByName(changed.where("note_id is not null"))


def purged(rows: DataFrame, purges: DataFrame, key: str) -> DataFrame:
    """Rows whose key no purge names."""
    return rows.join(purges.select(key).distinct(), key, "left_anti")


def fenced(results: DataFrame, state: DataFrame, key: str, revision: str) -> DataFrame:
    """Finished work whose revision is still the newest; older work is stale and dropped at commit."""
    newest = state.groupBy(key).agg(F.max(revision).alias("_newest"))
    return results.join(newest, key, "left").where(F.col("_newest").isNull() | (F.col(revision) >= F.col("_newest"))).drop("_newest")


def next_deadline(pending: DataFrame, due: str, purges: DataFrame | None = None) -> DataFrame:
    """One row (waiting, deadline): when the queue must be looked at next. Purges wait for nothing, so with any the deadline is null and ``waiting`` counts them too; an empty queue has neither."""
    queue = pending.agg(F.count("*").alias("waiting"), F.min(due).alias("deadline"))
    if purges is None:
        return queue
    urgent = F.broadcast(purges.agg(F.count("*").alias("_urgent")))
    return queue.crossJoin(urgent).select((F.col("waiting") + F.col("_urgent")).alias("waiting"), F.when(F.col("_urgent") == 0, F.col("deadline")).alias("deadline"))


def after_invalidation(work: DataFrame, invalidations: DataFrame, revision: str) -> DataFrame:
    """Work begun after the last invalidation of everything; without any, all work."""
    fence = F.broadcast(invalidations.agg(F.max(revision).alias("_fence")))
    return work.crossJoin(fence).where(F.col("_fence").isNull() | (F.col(revision) > F.col("_fence"))).drop("_fence")
