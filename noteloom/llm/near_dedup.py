"""Near-duplicate documents by Order MinHash, verified by banded alignment.

For each of ``SKETCHES`` hash functions a document gives the two least of its five-word runs (labelled by occurrence,
so that repeats count), kept in text order: sketches agree for texts that agree in content and in order. Documents that
share a sketch are candidates; they are near duplicates where the word edit distance is at most a fifth of the longer
text. Equal texts are one class from the start. Groups are the connected components of verified pairs. Bucket mates
meet the bucket's lead first; all pairs that leads leave in different groups are compared by counts of hashed words, a
lower bound of the distance, and verified unless that bound excludes them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, keys_beside, materialize, partitions, release_memory, rows_without, text_key, tidy
from .components import connected_components
from .sharding import row_numbers
from .text_hash import mix, run_hashes, seeds, word_hashes

WORDS = 5
SKETCHES = 32
#: Words of a text, and pairs of neighbouring words, are each counted in this many bins (a byte each); the counts of two texts bound their edit distance below.
BINS = 256
#: Hash values of a text that are held at once, 8 bytes each.
VALUES = 1 << 20
#: Word bits of the band's columns that are held at once.
MASK_BITS = 1 << 28
#: Pairs with one lead that a task verifies together, and for which the lead's text is sent once.
PAIRS_OF_LEAD = 256
#: Lots by which leads of buckets are drawn.
LOTS = 4
#: Members of a bucket are compared in blocks of about this many members and bytes of text, each pair of blocks on its own.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Up to this many ids (24 bytes each) are broadcast to pick the texts that need verification.
BROADCAST_IDS = 1_000_000
_SEEDS = seeds(SKETCHES, 3000)[:, None]
_LEFT, _RIGHT, _ROW = (np.uint64(int(x) | 1) for x in seeds(3, 4000))


def order_minhash(text: str) -> np.ndarray | None:
    """The sketches of a text as signed 64-bit keys; a text of fewer than five words is one run, one without words has none."""
    words = word_hashes(text.split())
    if not len(words):
        return None
    runs = run_hashes(words, WORDS)
    if not len(runs):
        runs = run_hashes(words, len(words))
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    labelled = mix(runs)
    if not fresh.all():
        at = np.arange(len(runs))
        occurrence = np.empty(len(runs), np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        labelled = mix(runs + occurrence * _ROW)
    first, second = np.empty(SKETCHES, np.int64), np.empty(SKETCHES, np.int64)
    # As many functions at once as give a million values, one at least.
    step = max(1, min(SKETCHES, VALUES // len(runs)))
    for at in range(0, SKETCHES, step):
        some = slice(at, min(at + step, SKETCHES))
        value = labelled[None, :] ^ _SEEDS[some]
        value *= _LEFT
        value ^= value >> np.uint64(32)
        value *= _RIGHT
        first[some] = second[some] = value.argmin(axis=1)
        if len(runs) > 1:
            value[np.arange(len(value)), first[some]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            second[some] = value.argmin(axis=1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    return mix(mix(runs[low] * _LEFT + np.arange(SKETCHES, dtype=np.uint64)) + runs[high] * _RIGHT).view(np.int64)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is greater.

    Bit-parallel over a band of 2*most + 1 diagonals: bit d of each vector stands for row j - most + d of column j.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (2 * most)
    rise, fall = ((1 << most) - 1) << (most + 1), 0
    goal = most + m - n
    distance = max(m - n, 0)
    where: dict[object, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    block = max(16, MASK_BITS // (width + min(n, 4096)))
    for begin in range(1, n + 1, block):
        # Rows that the band meets in these columns, as bits of the words in these columns alone.
        stop = min(begin + block, n + 1)
        low, high = max(0, begin - most - 1), min(m, stop + most)
        masks = {x: _mask(where[x], low, high) for x in set(b[begin - 1 : stop - 1]) if x in where}
        for j in range(begin, stop):
            hit = masks.get(b[j - 1], 0)
            shift = j - most - 1 - low
            hit = (hit >> shift if shift > 0 else hit << -shift) & full
            if j == 1:
                up, fall = (rise >> 1) | top, 0
            else:
                up = rise | top
            flat = ((((hit & up) + up) ^ up) | hit | fall) & full
            more = fall | (full & ~(flat | up))
            less = flat & up
            distance += not (flat >> goal) & 1
            if distance > most:
                return most + 1
            # The window moves on by a row, so the row above is at the same bit.
            moved = flat >> 1
            rise = less | (full & ~(moved | more))
            fall = moved & more
    return distance


def _mask(places: list[int], low: int, high: int) -> int:
    """Bits of the places from ``low`` on and below ``high``, the lowest first."""
    some = places[bisect_left(places, low) : bisect_left(places, high)]
    if len(some) < 64:
        return sum(1 << (i - low) for i in some)
    bits = np.zeros(high - low, np.uint8)
    bits[np.array(some) - low] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def near(a: list[str], b: list[str], similarity: float = 0.8) -> bool:
    """Whether the word edit distance is at most (1 - similarity) of the longer text; equal ends are cut off first."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    # Words that one text lacks must each be edited.
    shared = sum((Counter(a) & Counter(b)).values())
    if max(len(a), len(b)) - shared > most:
        return False
    most = min(most, max(len(a), len(b)))
    band = 64
    while band < most:  # near copies end in a narrow band
        if banded_distance(a, b, band) <= band:
            return True
        band *= 4
    return banded_distance(a, b, most) <= most


def _sketched(docs: DataFrame) -> DataFrame:
    """id, h1, h2, sketch of every row; the text's own columns are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = [None if (s := order_minhash(t.as_py())) is None else s for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sketch, pa.list_(pa.int64()))], ["id", "h1", "h2", "sketch"])
        release_memory()

    kind = docs.schema["id"].dataType.simpleString()
    return in_small_batches(docs).mapInArrow(run, f"id {kind}, h1 long, h2 long, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) of nodes whose texts are near duplicates.

    The pairs of a lead v are dealt to groups of about ``PAIRS_OF_LEAD``; a group gets the lead's text once, first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: list[str] = []
        for batch in batches:
            u, v, keep = batch.column(1).to_pylist(), batch.column(0).to_pylist(), []
            for i in range(batch.num_rows):
                words = batch.column(2)[i].as_py().split()
                if u[i] is None:
                    lead = words
                else:
                    keep.append((u[i], v[i])) if near(words, lead, similarity) else None
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in keep], pa.int64()) for k in range(2)], ["u", "v"])
        release_memory()

    pairs = materialize(pairs)
    leads = pairs.groupBy("v").agg(F.ceil(F.count("*") / PAIRS_OF_LEAD).cast("int").alias("groups"))
    members = pairs.join(leads, "v").select("v", F.pmod(F.xxhash64("u"), F.col("groups")).cast("int").alias("group"), "u")
    # Few pairs would be broadcast, many not: the texts are dealt by node at every size.
    texts = texts.hint("merge")
    members = members.join(texts, members["u"] == texts["node"]).select("v", "group", "u", "text")
    heads = leads.select("v", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(None).cast("long").alias("u"))
    heads = heads.join(texts, heads["v"] == texts["node"]).select("v", "group", "u", "text")
    dealt = heads.unionByName(members).repartition(partitions(pairs), "v", "group").sortWithinPartitions("v", "group", "u")
    return in_small_batches(dealt.select("v", "u", "text")).mapInArrow(run, "u long, v long")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs (u, v, key) of each member of a bucket (node, at, key) with the bucket's lead v; linear in the bucket's size.

    Leads are drawn by lot, one of ``LOTS`` by the sketch's place: the buckets of a large group then have several leads
    in common, so a member far from one of them meets others, and pairs repeat from bucket to bucket.
    """
    lead = F.min_by("node", F.xxhash64("node", F.pmod("at", F.lit(LOTS)))).alias("v")
    leads = materialize(rows.groupBy("key").agg(lead, F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(leads, "key").where("node <> v").select(F.col("node").alias("u"), "v", "key")


def word_counts(text: str) -> bytes:
    """Numbers of a text's words and pairs of neighbouring words by hash, each in ``BINS`` bins of a byte; counts above 255 are 255."""
    words = word_hashes(text.split())
    binned = [np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) for h in (words, run_hashes(words, 2))]
    return np.minimum(np.concatenate(binned), 255).astype(np.uint8).tobytes()


def possible_pairs(node: np.ndarray, part: np.ndarray, size: np.ndarray, counts: np.ndarray, side: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of different parts that may be near duplicates, as greater node, lesser node, least distance.

    Rows of side 0 meet those of side 1; without a side 1 they meet each other. An edit changes one word and two pairs
    of neighbours of each text, so the counts that one text has beyond the other, of words or half of those of pairs,
    bound the distance below; bounding counts to a byte lowers that bound only.
    """
    order = np.argsort(size, kind="stable")
    node, part, size, counts, side = node[order], part[order], size[order], counts[order], side[order]
    single, double = np.ascontiguousarray(counts[:, :BINS]), np.ascontiguousarray(counts[:, BINS:])
    singles, doubles = single.sum(axis=1, dtype=np.int64), double.sum(axis=1, dtype=np.int64)
    alone = not side.any()
    to = np.arange(len(node)) if alone else np.flatnonzero(side == 1)
    to_size, to_part = size[to], part[to]
    for i in np.flatnonzero(side == 0):
        # Texts whose lengths differ too much are no near duplicates; alone, each pair is met from its longer text.
        low = np.searchsorted(to_size, int(similarity * size[i] - 1e-6))
        high = i if alone else np.searchsorted(to_size, int(size[i] / similarity + 1e-6) + 1, side="right")
        j = to[low:high][to_part[low:high] != part[i]]
        if not len(j):
            continue
        limit = ((1 - similarity) * np.maximum(size[j], size[i]) + 1e-9).astype(np.int64)
        apart = np.maximum(singles[j], singles[i]) - np.minimum(single[j], single[i]).sum(axis=1, dtype=np.int64)
        ok = apart <= limit
        j, apart, limit = j[ok], apart[ok], limit[ok]
        if len(j):
            pairs = np.maximum(doubles[j], doubles[i]) - np.minimum(double[j], double[i]).sum(axis=1, dtype=np.int64)
            apart = np.maximum(apart, (pairs + 1) // 2)
            ok = apart <= limit
            j, apart = j[ok], apart[ok]
        if len(j):
            yield np.maximum(node[j], node[i]), np.minimum(node[j], node[i]), apart


def _mixed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Those (key, node) whose bucket has members of several parts, as key, node, part."""
    members = materialize(_label(rows.select("key", "node"), parts, "node", "part"))
    mixed = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    return materialize(members.join(mixed, "key", "left_semi"))


def link_members(part: list[int], side: list[int], keys: list[list[int]], texts: list[str], key: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Places (i, j) of near duplicates that join different parts, likeliest pair first; as many as joins, at most.

    Members of side 0 meet those of side 1, or each other if there is none. A pair with several buckets in common is
    compared in that of the least key alone.
    """
    n = len(part)
    words = [t.split() for t in texts]
    counts = np.frombuffer(b"".join(map(word_counts, texts)), np.uint8).reshape(n, -1)
    found = list(possible_pairs(np.arange(n), np.array(part), np.array([len(w) for w in words]), counts, np.array(side), similarity))
    if not found:
        return
    one, two, apart = (np.concatenate([f[k] for f in found]) for k in range(3))
    head: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := head.get(x, x)) != x:
            head[x] = head.get(up, up)
            x = up
        return x

    held = [frozenset(k) for k in keys]
    for at in np.argsort(apart, kind="stable").tolist():
        i, j = int(one[at]), int(two[at])
        a, b = top(part[i]), top(part[j])
        if a != b and key == min(held[i] & held[j]) and near(words[i], words[j], similarity):
            head[a] = b
            yield i, j


def _linked(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) that join the parts of a bucket's members (key, node, part), all pairs compared.

    A bucket's members are dealt into blocks, bounded in number and in bytes, and each pair of blocks is a task's work:
    counts of words exclude most pairs, and the others are verified there and then, so only edges leave the task.
    """
    sized = materialize(rows.join(texts.select("node", F.octet_length("text").alias("bytes")), "node"))
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    keys = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))
    dealt = sized.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each member goes to the pairs of its own block with every block of the bucket.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "part")
    dealt = dealt.join(texts.join(keys, "node"), "node").select("key", "b0", "b1", "side", "node", "part", "keys", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> pa.RecordBatch:
            side, node, part, keys, texts = zip(*held)
            pairs = [(node[i], node[j]) for i, j in link_members(part, side, keys, texts, group[0], similarity)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["u", "v"])

        group, held = None, []
        for batch in batches:
            for key, b0, b1, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, b0, b1) != group:
                    if len(held) > 1:
                        yield edges()
                    group, held = (key, b0, b1), []
                held.append(member)
        if len(held) > 1:
            yield edges()
        release_memory()

    return in_small_batches(dealt.repartition(partitions(rows), "key", "b0", "b1").sortWithinPartitions("key", "b0", "b1")).mapInArrow(run, "u long, v long")


def _label(rows: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the component of a node column; a node without verified pairs is its own."""
    return rows.join(parts.select(F.col("node").alias(node), F.col("component").alias("_part")), node, "left").withColumn(name, F.coalesce("_part", F.col(node))).drop("_part")


def _classes(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, h1, h2), and for each distinct text (h1, h2) its part, class_id and copy_id."""
    h1, h2 = text_key(F.col(text_col))
    source = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    rows = materialize(_sketched(source.withColumn("text", F.coalesce("text", F.lit("")))))
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("copy_id"), F.first("sketch").alias("sketch"))
    nodes = materialize(row_numbers(classes, ["copy_id", "h1", "h2"], "node"))

    keyed = nodes.where("sketch is not null").select("node", F.posexplode("sketch").alias("at", "key"))
    first = materialize(_stars(keyed))
    pairs = first.groupBy("u", "v").agg(F.count("*").alias("shared"))
    best = materialize(pairs.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("shared"), "v"))))

    # The finer buckets' members are among the same nodes, so their texts are all that will be needed.
    needed = materialize(first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "copy_id", "h1", "h2"), "node"))
    n_needed = needed.count()
    wanted = F.broadcast(needed) if n_needed <= BROADCAST_IDS else needed
    texts = materialize(source.alias("s").join(wanted.alias("w"), F.expr("s.id <=> w.copy_id and s.h1 = w.h1 and s.h2 = w.h2")).select("w.node", "s.text"))
    if texts.count() > n_needed:  # rows of one id and one text
        texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")))

    # Each node meets its likeliest representative first; other pairs are verified only where they would join groups.
    edges = materialize(_verified(best.where("_r = 1").select("u", "v"), texts, similarity))
    parts = materialize(connected_components(edges))
    open_pairs = _label(_label(best.where("_r > 1").select("u", "v"), parts, "u", "pu"), parts, "v", "pv").where("pu <> pv").select("u", "v")
    edges = materialize(edges.unionByName(_verified(open_pairs, texts, similarity)))
    parts = materialize(connected_components(edges))

    # Members that their leads left in different groups are compared among themselves.
    rest = _mixed(first.select("key", F.col("u").alias("node")), parts)
    if not rest.isEmpty():
        edges = materialize(edges.unionByName(_linked(rest, texts, similarity)))
        parts = materialize(connected_components(edges))

    named = _label(nodes.select("node", "h1", "h2", "copy_id"), parts, "node", "part")
    heads = materialize(named.groupBy("part").agg(F.min("copy_id").alias("class_id"), F.min("node").alias("head")))
    return rows.select("id", "h1", "h2"), materialize(named.join(heads, "part").select("h1", "h2", "part", "class_id", "copy_id"))


@tidy
def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id (the least id of its class of near duplicates), copy_id (the least id with an equal text).

    A null text equals other null texts only and is nobody's near duplicate; neither is a text without words, but equal
    texts always share a class. Null ids stay null and name no class that has another id. Repeated rows give a row
    each. An empty table gives no rows; other columns are not read.
    """
    rows, classes = _classes(docs, similarity, id_col, text_col)
    return rows.join(classes, ["h1", "h2"]).select(F.col("id").alias("doc_id"), "class_id", "copy_id")


@tidy
def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Exactly one row of each class of near duplicates, with all columns: that of the least id, nulls last.

    Rows are told apart by id and text, not by id alone, so a text under another's id stays. Of several rows with the
    same id and text one stays, by a hash of their JSON, so columns may be maps too. Null texts are one class, and so are empty ones. An
    empty table gives no rows.
    """
    rows, classes = _classes(docs, similarity, "doc_id", "text")
    named = rows.join(classes.select("h1", "h2", "part"), ["h1", "h2"])
    counted = materialize(named.groupBy("part", "id", "h1", "h2").agg(F.count("*").alias("n")))
    one = counted.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("one")).select("one.*")
    # The chosen are found again by their own id and text, not by class: a large class fills no task.
    chosen = counted.alias("c").join(one.alias("o"), F.expr("c.id <=> o.id and c.h1 = o.h1 and c.h2 = o.h2"), "left").select("c.*", F.col("o.none").isNotNull().alias("stays"))
    # Most rows stay, so those that go are named; rows that stand several times are looked at by themselves.
    marked = materialize(chosen.where("not stays or n > 1").select(F.col("id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "stays"))
    h1, h2 = text_key(F.col("d.text"))
    single = rows_without(docs, marked.drop("stays"), {"_id": F.col("d.doc_id"), "_h1": h1, "_h2": h2})
    repeated = materialize(marked.where("stays"))
    if repeated.isEmpty():
        return single
    same = F.expr("d.doc_id <=> m._id") & (h1 == F.col("m._h1")) & (h2 == F.col("m._h2"))
    several = docs.alias("d").join(keys_beside(repeated).alias("m"), same).select(F.struct("d.*").alias("row"), "m._id", "m._h1", "m._h2", F.xxhash64(F.to_json(F.struct("d.*"))).alias("_at"))
    return single.unionByName(several.groupBy("_id", "_h1", "_h2").agg(F.min_by("row", "_at").alias("row")).select("row.*"))
