"""Phrase collocations by contiguous pattern growth.

Every occurrence of a frequent pair of words projects a pointer: the occurrence with the words that follow it, as far as
all pairs on the way are frequent and the phrase itself may be. Sorted pointers are dealt over tasks by range, so the
pointers of a prefix are one run and a task grows its prefixes depth-first: the run of a prefix falls apart into the runs of
its right extensions. A prefix whose run lies within one task is counted there and abandoned below the support; one whose
run goes on in the next task is counted in parts, which are added up. So a common prefix is cut over tasks as the data asks
for, and no task holds more than its share.

Which words and pairs are frequent is told to tasks by two bit maps of fixed size, and which longer phrases may be by a
third, made of hashed counts whose number is bounded too. They let a few rare ones through and lose none; every count that
is used is exact. So pointers are made of phrases that are frequent, nearly all, and not of all runs of frequent pairs,
which a fixed support lets grow much faster than the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import in_small_batches, materialize, partitions, release_memory, tidy

#: Fixed characters of the contract: ends of pieces, and white space between words.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 5
NO_LANG = "und"
#: Words of a pointer are joined by the least byte, so that sorted pointers keep each prefix together; a NUL within a word
#: is written as a comma meanwhile, which no word can hold.
JOIN, NUL_AS = b"\x00", b","
#: Bits of the maps of frequent words and pairs: 8 MB each.
MAP_BITS = 1 << 26
WORD_OF_MAP = 64
#: Hashed counts of longer phrases that a task holds: about one for each occurrence of a frequent pair in all texts, within
#: these bounds (64 MB at a byte each); so many go into a row.
LEAST_SLOTS, MOST_SLOTS, SLOTS_OF_ROW = 1 << 16, 1 << 26, 1 << 16
#: Bytes of text that a task counts at a time; a piece that is longer is taken whole.
BLOCK_BYTES = 4 << 20
#: Pointers of one task of the growth, which holds them in memory (about 200 bytes each).
TASK_POINTERS = 1_000_000
#: Words or pointers that a task may hold counts of before it gives them out.
HELD_PHRASES = 400_000
#: Keys of pairs of words, likewise (each block's distinct ones count).
HELD_PAIRS = 3_000_000
#: A language's candidates are ranked in this many parts first.
RANK_PARTS = 64

_KIND = np.zeros(256, np.int8)
_KIND[list(WORD_ENDS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_PLAIN = bytes.maketrans(PIECE_ENDS + b"\x00", b" " * len(PIECE_ENDS) + NUL_AS)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of a batch, short texts of one language together, long ones cut where a piece ends."""
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        groups.setdefault(lang, []).append(text)
    for lang, texts in groups.items():
        whole = b"\n".join(texts).lower()
        at = 0
        while at < len(whole):
            end = at + BLOCK_BYTES
            if end < len(whole):
                rest = np.flatnonzero(_KIND[np.frombuffer(whole, np.uint8, min(BLOCK_BYTES, len(whole) - end), end)] == 2)
                while not len(rest) and end + BLOCK_BYTES < len(whole):
                    end += BLOCK_BYTES
                    rest = np.flatnonzero(_KIND[np.frombuffer(whole, np.uint8, min(BLOCK_BYTES, len(whole) - end), end)] == 2)
                end = end + int(rest[0]) + 1 if len(rest) else len(whole)
            yield lang, whole[at:end]
            at = end


def _words(block: bytes) -> list[bytes]:
    return block.translate(_PLAIN).split()


def _pieces(block: bytes) -> np.ndarray:
    """For each word of a block the number of its piece."""
    kind = _KIND[np.frombuffer(block, np.uint8)]
    start = kind == 0
    start[1:] &= kind[:-1] != 0
    return np.cumsum(kind == 2, dtype=np.int32)[start]


class _Numbers(dict):
    """Numbers for words, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(block: bytes) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of a block, and the number of each word in it."""
    numbers = _Numbers()
    words = _words(block)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return list(numbers), ids


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second
    return mixed ^ (mixed >> np.uint64(32))


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A key of 40 bits for a pair of words, by their hashes. Pairs that share one are counted as one here, so a map may let a rare pair through."""
    return _mixed(first, second) & np.uint64((1 << 40) - 1)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(len(bits) * WORD_OF_MAP)
    return (bits[(at // np.uint64(WORD_OF_MAP)).astype(np.int64)] >> (at % np.uint64(WORD_OF_MAP))) & np.uint64(1) == 1


def _rows(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])


_ROWS = "lang string, phrase binary, f long"


class _Held:
    """Counts of phrases by language over a task's blocks, given out each time that many are held."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[bytes, int]] = {}

    def add(self, lang: str, phrases: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = self.counts.setdefault(lang, {})
        for phrase, n in zip(phrases, counts.tolist()):
            known[phrase] = known.get(phrase, 0) + n
        if sum(map(len, self.counts.values())) > HELD_PHRASES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for lang, known in self.counts.items():
            yield _rows(lang, list(known), np.fromiter(known.values(), np.int64, len(known)))
        self.counts = {}


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts with their counts."""
    held = _Held()
    for lang, block in chain.from_iterable(map(_blocks, batches)):
        words, ids = _numbered(block)
        yield from held.add(lang, words, np.bincount(ids, minlength=len(words)))
    yield from held.rest()
    release_memory()


def _pairs(lang: str, block: bytes, frequent: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, their numbers in the block, their hashes, and whether word i and the next are one piece's and in the map of words."""
    words, ids = _numbered(block)
    hashes = _hashes(lang, words)
    piece = _pieces(block)
    known = _held(frequent, hashes)[ids] if len(words) else np.zeros(0, bool)
    together = np.zeros(len(ids), bool)
    together[:-1] = (piece[1:] == piece[:-1]) & known[1:] & known[:-1]
    return words, ids, hashes, together


def count_pairs(batches: Iterator[pa.RecordBatch], frequent: bytes) -> Iterator[pa.RecordBatch]:
    """Keys of pairs of neighbouring words that are both in the map, with their counts, given out each time that many are held."""
    frequent = np.frombuffer(frequent, np.uint64)
    keys, counts, held = [], [], 0

    def rows() -> pa.RecordBatch:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)  # below 2^53 within a task
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total)], ["key", "f"])

    for lang, block in chain.from_iterable(map(_blocks, batches)):
        _, ids, hashes, together = _pairs(lang, block, frequent)
        at = np.flatnonzero(together)
        found, n = np.unique(_pair_key(hashes[ids[at]], hashes[ids[at + 1]]), return_counts=True)
        keys.append(found)
        counts.append(n)
        held += len(found)
        if held > HELD_PAIRS:
            yield rows()
            keys, counts, held = [], [], 0
    if held:
        yield rows()
    release_memory()


def _places(lang: str, block: bytes, frequent: np.ndarray, frequent_pairs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their numbers in the block, their hashes, whether word i and the next are a pair in the map, and where they are."""
    words, ids, hashes, together = _pairs(lang, block, frequent)
    at = np.flatnonzero(together)
    together[at] = _held(frequent_pairs, _pair_key(hashes[ids[at]], hashes[ids[at + 1]]))
    return words, ids, hashes, together, np.flatnonzero(together)


def _longer(ids: np.ndarray, hashes: np.ndarray, together: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For three words and each more, whether pairs in the map lead that far from the places, and keys of the phrases there."""
    padded, going = np.append(ids, np.zeros(LONGEST, np.int64)), np.append(together, np.zeros(LONGEST, bool))
    key = _mixed(hashes[ids[at]], hashes[ids[at + 1]])
    goes = np.ones(len(at), bool)
    for n in range(3, LONGEST + 1):
        goes = goes & going[at + n - 2]
        key = _mixed(key, hashes[padded[at + n - 1]])
        yield goes, key


def count_longer(batches: Iterator[pa.RecordBatch], frequent: bytes, frequent_pairs: bytes, slots: int, support: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of phrases of three words or more whose pairs are in the map, by slots of their hashes, each up to the support."""
    frequent, frequent_pairs = np.frombuffer(frequent, np.uint64), np.frombuffer(frequent_pairs, np.uint64)
    counts = np.zeros(slots, np.min_scalar_type(support))
    for lang, block in chain.from_iterable(map(_blocks, batches)):
        _, ids, hashes, together, at = _places(lang, block, frequent, frequent_pairs)
        if len(at):
            keys = np.concatenate([key[goes] for goes, key in _longer(ids, hashes, together, at)])
            found, n = np.unique((keys % np.uint64(slots)).astype(np.int64), return_counts=True)
            counts[found] = np.minimum(counts[found] + n, support)
    for row, part in enumerate(np.split(counts, -(-slots // SLOTS_OF_ROW))):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["row", "counts"])
    del counts
    release_memory()


def _supported(rows: pa.Table, support: int) -> pa.Table:
    """Bits of the slots of one row that have the support over all tasks."""
    total = 0
    for counts in rows["counts"]:
        total = total + np.frombuffer(counts.as_buffer(), np.min_scalar_type(support)).astype(np.int64)
    return pa.table([rows["row"][:1], pa.array([np.packbits(total >= support, bitorder="little").tobytes()], pa.binary())], ["row", "bits"])


def _longer_map(texts: DataFrame, maps: dict[str, bytes], places: int, support: int) -> bytes:
    """Map of the phrases of three words or more that may have the support, by their keys."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << places.bit_length()))
    support = max(support, 1)  # a slot without an occurrence is not told apart from none
    counts = texts.mapInArrow(partial(count_longer, slots=slots, support=support, **maps), "row int, counts binary")
    # A group has one row of each task.
    parts = counts.groupBy("row").applyInArrow(lambda rows: _supported(rows, support), "row int, bits binary")
    bits = np.zeros((-(-slots // SLOTS_OF_ROW), min(slots, SLOTS_OF_ROW) // 8), np.uint8)
    for chunk in parts.toArrow().to_batches():  # MOST_SLOTS / 8 bytes at most
        for row, part in zip(chunk.column("row").to_pylist(), chunk.column("bits").to_pylist()):
            bits[row] = np.frombuffer(part, np.uint8)
    return bits.tobytes()


def project(batches: Iterator[pa.RecordBatch], frequent: bytes, frequent_pairs: bytes, longer: bytes) -> Iterator[pa.RecordBatch]:
    """Pointers of a task's texts: for each place of a frequent pair, the longest phrase from there that the maps hold, up to five words; equal ones together."""
    frequent, frequent_pairs, longer = (np.frombuffer(m, np.uint64) for m in (frequent, frequent_pairs, longer))
    held = _Held()
    for lang, block in chain.from_iterable(map(_blocks, batches)):
        words, ids, hashes, together, at = _places(lang, block, frequent, frequent_pairs)
        if not len(at):
            continue
        # Pointers are told apart a word at a time: code of the words so far, times the words there are, plus the next.
        padded = np.append(ids, np.full(LONGEST, -1))
        _, code = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True)
        goes, length = np.ones(len(at), bool), np.full(len(at), 2)
        for n, (leads, key) in enumerate(_longer(ids, hashes, together, at), 3):
            goes = goes & leads
            goes[goes] = _held(longer, key[goes])
            length += goes
            _, code = np.unique(code * (len(words) + 1) + np.where(goes, padded[at + n - 1] + 1, 0), return_inverse=True)
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        start = at[first]
        names = np.array(words, dtype=object)
        columns = [names[padded[start + i]].tolist() for i in range(LONGEST)]
        phrases = [JOIN.join(p[:n]) for p, n in zip(zip(*columns), length[first].tolist())]
        yield from held.add(lang, phrases, counts)
    yield from held.rest()
    release_memory()


def grow(batches: Iterator[pa.RecordBatch], support: int) -> Iterator[pa.RecordBatch]:
    """Counts of the prefixes of a task's sorted pointers, grown to the right depth-first.

    A prefix whose run may go on in a neighbouring task (it heads the task's first or last pointer) is given out
    whatever its count; others are given out, and grown further, only with the support.
    """
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())]))
    if not table.num_rows:
        return
    langs, phrases = table["lang"].to_pylist(), [p.split(JOIN) for p in table["phrase"].to_pylist()]
    upto = np.append(0, np.cumsum(table["f"].to_numpy()))
    edges = [(langs[i], phrases[i]) for i in (0, -1)]
    found: dict[str, tuple[list[bytes], list[int]]] = {}

    def extend(lang: str, prefix: list[bytes], low: int, high: int) -> None:
        depth = len(prefix)
        n = int(upto[high] - upto[low])
        open_ended = any(lang == name and prefix == edge[:depth] for name, edge in edges)
        if depth and n < support and not open_ended:
            return
        if depth > 1:
            names, counts = found.setdefault(lang, ([], []))
            names.append(JOIN.join(prefix))
            counts.append(n)
        if depth == LONGEST:
            return
        while low < high and len(phrases[low]) == depth:  # pointers that end here come first
            low += 1
        while low < high:
            word, end = phrases[low][depth], low + 1
            while end < high and phrases[end][depth] == word:
                end += 1
            extend(lang, [*prefix, word], low, end)
            low = end

    low = 0
    while low < len(langs):
        high = low + 1
        while high < len(langs) and langs[high] == langs[low]:
            high += 1
        extend(langs[low], [], low, high)
        low = high
    for lang, (names, counts) in found.items():
        yield _rows(lang, names, np.array(counts))
    release_memory()


def _word_keys(langs: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([int(_hashes(lang, [word])[0] % np.uint64(MAP_BITS)) for lang, word in zip(langs, words)], dtype="int64")


def _bit_map(keys: DataFrame) -> bytes:
    """Map of one column of keys: as many 64-bit words as MAP_BITS allows, whatever the number of keys."""
    at = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(MAP_BITS)).alias("at"))
    parts = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    bits = np.zeros(MAP_BITS // WORD_OF_MAP, np.int64)
    for chunk in parts.toArrow().to_batches():  # at most MAP_BITS / 64 rows
        bits[chunk.column("word").to_numpy()] = chunk.column("bits").to_numpy()
    return bits.view(np.uint64).tobytes()


def _total(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _parts(phrase: Column, longest: int) -> Column:
    """Cuts of an array of words: k, its first k words and the rest."""
    ks = F.filter(F.array(*[F.lit(k) for k in range(1, longest)]), lambda k: k < F.size(phrase))
    return F.transform(ks, lambda k: F.struct(k.alias("k"), F.slice(phrase, F.lit(1), k).alias("first"), F.slice(phrase, k + 1, F.size(phrase) - k).alias("rest")))


def _within(phrase: Column, longest: int) -> Column:
    """Shorter runs of two words or more within an array of words."""
    spans = [(i, n) for n in range(2, longest) for i in range(longest - n + 1)]
    fits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in spans]), lambda s: (s["n"] < F.size(phrase)) & (s["i"] + s["n"] <= F.size(phrase)))
    return F.array_distinct(F.transform(fits, lambda s: F.slice(phrase, s["i"] + 1, s["n"])))


def count_phrases(docs: DataFrame, support: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words per language (lang, n), and frequent words and phrases (lang, phrase as binary, f), both written tables."""
    lang, text = F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    texts = in_small_batches(docs.select(lang, text))
    counted = materialize(_total(texts.mapInArrow(count_words, _ROWS)))
    sizes = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    words = materialize(counted.where(F.col("f") >= support))
    known = _bit_map(words.select(pandas_udf(_word_keys, "long")("lang", "phrase")))
    pairs = texts.mapInArrow(partial(count_pairs, frequent=known), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
    pairs = materialize(pairs.where(F.col("f") >= support))
    maps = {"frequent": known, "frequent_pairs": _bit_map(pairs.select("key"))}
    # One task a core: what a task gives out from here on is by phrase, so more tasks would give each phrase more often.
    shares = texts.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    longer = _longer_map(shares, maps, pairs.agg(F.sum("f")).first()[0] or 0, support)
    pointers = materialize(shares.mapInArrow(partial(project, longer=longer, **maps), _ROWS))
    # Equal pointers of different blocks may be many: the salt lets a range end between them.
    tasks = partitions(pointers, -(-pointers.count() // TASK_POINTERS))
    dealt = pointers.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(tasks, "lang", "phrase", "salt").sortWithinPartitions("lang", "phrase")
    grown = _total(dealt.select("lang", "phrase", "f").mapInArrow(partial(grow, support=support), _ROWS))
    return sizes, words, materialize(grown.where(F.col("f") >= support))


@tidy
def mine_phrases(docs: DataFrame, support: int = 100, absorbed: int = 100, scale: int = 1000, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to five words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is a run of words of one piece of a text; it is a candidate from ``support`` occurrences. Its score is the
    lowest of floor(scale * a * n / (l * r)) over its cuts in two, the first of equals counting. A candidate goes where a
    longer one holds it and has ``absorbed`` percent of its occurrences. Ties are ordered by occurrences, then by the
    phrase's UTF-8 bytes. A null text is empty, a null language ``und``; repeated rows count as often as they are there;
    an empty table gives no rows; other columns are not read. Numbers must stay below 10^19, and scale * a * n below
    10^38; otherwise the arithmetic fails rather than round.
    """
    sizes, words, phrases = count_phrases(docs, support)
    # The candidates hold their words as an array, which tells any two phrases apart; NULs come back here.
    as_words = F.transform(F.split(F.col("phrase").cast("string"), "\\x00"), lambda w: F.replace(w, F.lit(NUL_AS.decode()), F.lit("\x00")))
    counted = words.unionByName(phrases).select("lang", as_words.alias("words"), "f")
    candidates = materialize(phrases.select("lang", as_words.alias("words"), F.col("f").alias("a")))
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(_within(F.col("words"), LONGEST)).alias("words"), "a")
    absorbers = longer.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    # Written tables look small beside their rows in memory: none of these joins may gather a side at the driver.
    kept = candidates.join(absorbers.hint("merge"), ["lang", "words"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer")

    cuts = kept.select("lang", "words", "a", F.explode(_parts(F.col("words"), LONGEST)).alias("cut")).select("lang", "words", "a", "cut.*")
    # A common word is a part of many phrases: its rows are dealt over as many keys as there are salts.
    salts = 16
    salt = F.pmod(F.xxhash64("words"), F.lit(salts)).cast("int")
    sides = counted.select("lang", F.col("words").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    left, right = (sides.select("lang", F.col("part").alias(part), "salt", F.col("f").alias(name)).hint("merge") for part, name in (("first", "l"), ("rest", "r")))
    scored = cuts.withColumn("salt", salt).join(left, ["lang", "first", "salt"]).join(right, ["lang", "rest", "salt"]).drop("salt")
    scored = scored.join(sizes, "lang")
    long = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("score", F.call_function("div", (long("a") * long("n") * F.lit(scale)).cast("decimal(38,0)"), (long("l") * long("r")).cast("decimal(38,0)")))
    least = scored.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best"))
    flat = least.select("lang", F.array_join("words", " ").alias("phrase"), *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    part = ranked(flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))), ["lang", "part"]).drop("part", "rank")
    return ranked(part, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
