"""Packing of documents into sequences of one window by non-negative least squares over length combinations.

A document's full windows are sequences of their own; what is left of it, its tail, is shorter than the window. Tails are
packed by their histogram alone, which has as many entries as the window has tokens, however many documents there are:
combinations of up to three lengths that fill a window exactly are enumerated, non-negative least squares says how often
each is to be repeated, and the repeats are rounded. What they leave over is packed greedily, longest first, and only
there a tail is cut, to fill the last gap of a sequence. The last tokens of all go into sequences of a power of two.

Which tail of a length goes where is a matter of its rank among the tails of that length. Ranks come from counts by
partition and length, so nothing is sorted and no ids are shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder, groups
from .common import drop_materialized, in_small_batches, keys_beside, materialize, release_memory, tidy

#: Rounds of the least-squares solver, and the gradient (in tails) below which a combination isn't worth adding.
ROUNDS, LEAST_GRADIENT = 80, 0.25


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """All ways to fill the window with two or three of the lengths, longest first; a missing third is 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = []
    for a in sorted(map(int, lengths), reverse=True):
        rest = window - a
        b = np.arange(min(a, rest), (rest + 1) // 2 - 1, -1)
        b = b[b > 0]
        c = rest - b
        fits = there[b] & ((c == 0) | there[c])
        found.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], axis=1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)


def least_squares(combos: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the combinations that bring the tails used nearest to ``wanted`` (by length) in squares.

    An active-set method: in each round combinations that share no length and promise most are added, and the least
    squares over the chosen ones are solved anew, stepping back to zero where a repeat would become negative.
    """
    window = len(wanted) - 1
    x, chosen = np.zeros(len(combos)), np.zeros(0, np.int64)

    def columns(at: np.ndarray) -> np.ndarray:
        a = np.zeros((window + 1, len(at)))
        for part in combos[at].T:
            np.add.at(a, (part, np.arange(len(at))), 1.0)
        a[0] = 0
        return a

    for _ in range(ROUNDS):
        left = wanted - np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=window + 1)
        left[0] = 0
        gradient = left[combos].sum(axis=1)
        gradient[chosen] = 0
        order = np.flatnonzero(gradient > max(LEAST_GRADIENT, gradient.max() / 8))
        if not len(order):
            break
        order = order[np.argsort(-gradient[order], kind="stable")]
        taken, new = np.zeros(window + 1, bool), []
        for i in order.tolist():
            parts = combos[i]
            if not taken[parts].any():
                taken[parts[parts > 0]] = True
                new.append(i)
        chosen = np.append(chosen, new)
        while len(chosen):
            a = columns(chosen)
            z = np.linalg.solve(a.T @ a + 1e-7 * np.eye(len(chosen)), a.T @ wanted)
            low = z <= 0
            if not low.any():
                x[:] = 0
                x[chosen] = z
                break
            now = x[chosen]
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            now = now + step * (z - now)
            x[:] = 0
            x[chosen] = np.maximum(now, 0)
            chosen = chosen[~(low & (now <= 1e-9))]
            x[np.setdiff1d(np.flatnonzero(x), chosen)] = 0
    return x


@dataclass
class Plan:
    """Where tails go. Tails are numbered by length, then by rank; row i of ``of`` to ``offset`` says that the tails
    numbered of .. of+count-1 have their tokens start .. start+length-1 at ``offset`` of the sequences sequence ..
    sequence+count-1. ``first`` is the number of the first tail of each length."""

    first: np.ndarray
    of: np.ndarray
    count: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, ends, rows): tails from bounds[i] to the next bound have the pieces rows[ends[i-1]:ends[i]], by start."""
        bounds = np.unique(np.concatenate([self.of, self.of + self.count]))
        low, high = np.searchsorted(bounds, self.of), np.searchsorted(bounds, self.of + self.count)
        rows = np.repeat(np.arange(len(self.of)), high - low)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        at = np.repeat(low, high - low) + within
        order = np.lexsort((self.start[rows], at))
        return bounds, np.cumsum(np.bincount(at, minlength=len(bounds))), rows[order]


class _Stock:
    """Tails that are not placed yet: for each length the runs (first tail, how many, first token) that have it."""

    def __init__(self, counts: np.ndarray, first: np.ndarray) -> None:
        self.counts = counts.astype(np.int64)
        self.runs = [deque([(int(f), int(n), 0)] if n else []) for f, n in zip(first, counts)]
        self.placed: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def take(self, length: int, n: int) -> list[tuple[int, int, int]]:
        self.counts[length] -= n
        got = []
        while n:
            of, count, start = self.runs[length].popleft()
            if count > n:
                self.runs[length].appendleft((of + n, count - n, start))
                count = n
            got.append((of, count, start))
            n -= count
        return got

    def fill(self, parts: list[int], times: int, cut_to: int = 0) -> None:
        """``times`` sequences of these lengths; of the last part only ``cut_to`` tokens if that is given, the rest stays in stock."""
        offset = 0
        for i, length in enumerate(parts):
            used = cut_to if cut_to and i == len(parts) - 1 else length
            sequence = self.sequences
            for of, count, start in self.take(length, times):
                self.placed.append((of, count, start, used, sequence, offset))
                if used < length:
                    self.runs[length - used].append((of, count, start + used))
                    self.counts[length - used] += count
                sequence += count
            offset += used
        self.sequences += times


def plan(histogram: np.ndarray) -> Plan:
    """A place for every tail; ``histogram[length]`` counts the tails of a length below the window, its size is the window."""
    window = len(histogram)
    first = np.append(0, np.cumsum(histogram[1:]))
    first = np.append(0, first[:-1]) if window > 1 else np.zeros(1, np.int64)
    stock = _Stock(np.append(0, histogram[1:]), first)
    combos = combinations(window, np.flatnonzero(stock.counts))
    x = least_squares(combos, np.append(stock.counts, 0).astype(float)) if len(combos) else np.zeros(0)
    for i in np.argsort(-x, kind="stable").tolist():
        repeats = int(round(x[i]))
        if not repeats:
            break
        parts = [int(p) for p in combos[i] if p]
        times = min(repeats, *(int(stock.counts[p]) // parts.count(p) for p in parts))
        if times:
            stock.fill(parts, times)
    _greedy(stock, window)
    placed = np.array(stock.placed, np.int64).reshape(-1, 6).T
    return Plan(first, *placed, sequences=stock.sequences)


def _greedy(stock: _Stock, window: int) -> None:
    """Pack what is in stock: the longest first, then the longest that fit, and a cut of the shortest that does not to close the gap."""
    lengths = np.arange(window)
    tokens = int(stock.counts @ lengths)
    while tokens:
        size = window
        while size > tokens:  # the last tokens: the greatest power of two that they fill
            size = 1 << (tokens.bit_length() - 1)
        left, parts, gap, cut_to = stock.counts.copy(), [], size, 0
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if len(fits):
                part = int(fits[-1])
            else:
                part = gap + int(np.flatnonzero(left[gap:])[0])
                cut_to = gap
            parts.append(part)
            left[part] -= 1
            gap -= min(part, gap)
        times = min(int(stock.counts[p]) // parts.count(p) for p in parts)
        times = max(1, min(times, tokens // size)) if size == window else 1
        stock.fill(parts, times, cut_to)
        tokens -= size * times


_TOKENS = "doc_tokens long, ids binary, part int, tail int, nth long, windows long"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    """Ids of a task's documents; its number; and of the documents before in the task, how many have a tail of this length and how many windows they fill."""
    part, known = TaskContext.get().partitionId(), encoder(path, end_id)
    seen, windows = np.zeros(window, np.int64), 0
    for batch in batches:
        ids_of, texts = batch.column(0), batch.column(1).to_pylist()
        at = 0
        for group in groups(texts):
            ids, counts = known.encode(group)
            tails = counts % window
            nth = np.empty(len(group), np.int64)
            for i, tail in enumerate(tails.tolist()):
                nth[i] = seen[tail]
                seen[tail] += 1
            full = counts // window
            before = windows + np.cumsum(full) - full
            windows += int(full.sum())
            yield pa.RecordBatch.from_arrays(
                [ids_of.slice(at, len(group)), pa.array(counts, pa.int64()), _binary(ids, counts), pa.array(np.full(len(group), part), pa.int32()), pa.array(tails, pa.int32()), pa.array(nth), pa.array(before)],
                ["doc_id", "doc_tokens", "ids", "part", "tail", "nth", "windows"],
            )
            at += len(group)
    release_memory()


def _binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ids as little-endian unsigned 32-bit numbers, a value for each run."""
    offsets = np.append(0, np.cumsum(counts)).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())


def _lay(batches: Iterator[pa.RecordBatch], plan: Plan, window: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each document: its full windows, then those of its tail."""
    bounds, ends, rows = plan.pieces()
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    for batch in batches:
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        total, tail, number = column("doc_tokens"), column("tail"), plan.first[column("tail")] + column("nth")
        full = total // window
        doc = np.repeat(np.arange(len(total)), full)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        sequence = plan.sequences + column("windows")[doc] + nth
        whole = (doc, nth * window, np.full(len(doc), window), sequence, np.zeros(len(doc), np.int64))
        with_tail = np.flatnonzero(tail)
        run = np.searchsorted(bounds, number[with_tail], side="right") - 1
        pieces = ends[run] - begins[run] if len(run) else run
        doc = np.repeat(with_tail, pieces)
        at = rows[np.repeat(begins[run], pieces) + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)] if len(doc) else doc
        cut = (doc, full[doc] * window + plan.start[at], plan.length[at], plan.sequence[at] + number[doc] - plan.of[at], plan.offset[at])
        doc, start, length, sequence, offset = (np.concatenate(pair) for pair in zip(whole, cut))
        order = np.lexsort((start, doc))
        doc, start, length, sequence, offset = (v[order] for v in (doc, start, length, sequence, offset))
        # Sorted by document and start, the pieces are the documents' ids in their order, each exactly once.
        held = batch.column("ids")
        ids = np.concatenate([np.frombuffer(v.as_buffer(), "<u4") for v in held]) if len(held) else np.zeros(0, "<u4")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), _binary(ids, length), pa.array(total[doc]), pa.array(sequence), pa.array(offset)],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
    release_memory()


@tidy
def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's tokens are the ids of its whole text by the byte-level BPE file ``tokenizer`` (without special tokens
    added), then ``end_id``; a null or empty text has the end id alone. Each token lies in exactly one piece; ``ids``
    are a piece's tokens as little-endian unsigned 32-bit numbers. The pieces of a sequence are gapless from offset 0
    and hold ``window`` tokens, but for at most a few last sequences, which hold a power of two. Tails of one length
    are placed by partition and row of the scan; repeated rows and null ids are documents of their own; an empty table
    gives no rows; other columns are not read.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two of at least 2")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    encoded = in_small_batches(texts).mapInArrow(partial(_encode, path=tokenizer, end_id=end_id, window=window), f"doc_id {kind}, {_TOKENS}")
    tokens = materialize(encoded, compression="zstd")
    # By partition and length: how many tails of that length the partitions before have.
    here = materialize(tokens.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {window}")).alias("full")))
    histogram = np.zeros(window, np.int64)
    for row in here.groupBy("tail").agg(F.sum("n").alias("n")).collect():  # a row for each length
        histogram[row["tail"]] = row["n"]
    start, before = 0, []
    for row in here.groupBy("part").agg(F.sum("full").alias("full")).orderBy("part").collect():  # a row for each partition
        before.append((row["part"], start))
        start += row["full"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, windows_before long"))
    sofar = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(here.select("part", "tail", F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias("base")).join(offsets, "part"))
    placed = tokens.join(keys_beside(bases), ["part", "tail"]).select(
        "doc_id", "doc_tokens", "ids", "tail", (F.col("nth") + F.col("base")).alias("nth"), (F.col("windows") + F.col("windows_before")).alias("windows")
    )
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return in_small_batches(placed).mapInArrow(partial(_lay, plan=plan(histogram), window=window), schema)
