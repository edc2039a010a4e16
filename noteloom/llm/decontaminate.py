"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so similarity is the item's containment in the document. Items are put into
partitions by their number of shingles (powers of two). An item's signature holds its least shingle hashes: all of them
in the small partitions, ``SIGNATURE`` in the others. A document's signature holds those of its shingle hashes that some
partition's signatures can hold. A pair is a candidate if the signatures share as many hashes as its partition asks for:
that number follows from the containment and the partition's size. Candidates are verified by exact shingle
containment. DataFrame operations only.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_map, in_bit_map, materialize, rows_without, text_key, tidy

WORDS = 5
#: Hashes of a signature; an item of fewer shingles has them all.
SIGNATURE = 32
#: Chance that a pair of the required containment shares too few hashes of its signatures.
MISS = 1e-9
#: Up to this many signature hashes (24 bytes each) are broadcast; beyond, the join is shuffled by hash.
BROADCAST_HASHES = 200_000


def item_words(text: Column) -> Column:
    """Words for matching: runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words: Column, size: Column, make) -> Column:
    """Values of ``make`` over all runs of ``size`` words; words and size are bound first, so that they are computed once."""
    starts = lambda b: F.when(F.size(b["w"]) >= b["k"], F.sequence(F.lit(1), F.size(b["w"]) - b["k"] + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(F.struct(words.alias("w"), size.alias("k"))), lambda b: F.transform(starts(b), lambda i: make(F.slice(b["w"], i, b["k"]))))[0]


def shingles(words: Column, sizes: list[int], make) -> Column:
    """Values of ``make`` over the runs of each of the given sizes, repeats included."""
    if len(sizes) == 1:
        return _windows(words, F.lit(sizes[0]), make)
    return F.transform(F.array(words), lambda w: F.concat(*[_windows(w, F.lit(k), make) for k in sizes]))[0]


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def least_matches(size: int, threshold: float) -> int:
    """Hashes that the signature of an item of up to ``size`` shingles shares with a document that holds ``threshold`` of them, but for a chance of ``MISS``."""
    held = size - int((1 - threshold) * size + 1e-9)
    chance, total = 0.0, comb(size, SIGNATURE)
    for k in range(SIGNATURE + 1):
        chance += comb(held, k) * comb(size - held, SIGNATURE - k) / total if k <= held and SIGNATURE - k <= size - held else 0.0
        if chance > MISS:
            return max(k, 1)
    return SIGNATURE


def signatures(items: DataFrame, threshold: float) -> DataFrame:
    """item, hash, need: the signature of each item (item, hashes) and the number of its hashes that a document must hold.

    Small partitions (up to ``SIGNATURE`` shingles) need exactly what containment asks for; each larger partition's need
    is that of its upper bound, up to 2**40 shingles.
    """
    sized = items.select("item", F.size("hashes").alias("n"), F.sort_array("hashes").alias("hashes")).where("n > 0")
    partition = F.ceil(F.log2("n")).cast("int")
    whole = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    need = F.when(F.col("n") <= SIGNATURE, F.greatest(whole, F.lit(1)))
    top = SIGNATURE.bit_length() - 1
    for p in range(top + 1, 41):
        # Beyond 4,096 shingles the chance changes no more in its first nine digits' power.
        need = need.when(partition == p, F.lit(least_matches(1 << min(p, 12), threshold)))
    return sized.select("item", F.explode(F.slice("hashes", 1, SIGNATURE)).alias("hash"), need.alias("need"))


def _search(docs: DataFrame, benchmark: DataFrame, threshold: float, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """h1, h2, item_id, containment for the texts of ``docs``, each distinct text once."""
    words = item_words(F.col(item_text_col))
    items = benchmark.select(F.col(item_col).alias("item_id"), words.alias("words")).where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id())
    own = F.least(F.size("words"), F.lit(WORDS))
    hashed = _windows(F.col("words"), own, F.xxhash64)
    items = materialize(items.select("item", "item_id", own.alias("size"), F.array_distinct(hashed).alias("hashes"), F.array_distinct(_windows(F.col("words"), own, _text)).alias("shingles")))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [WORDS]  # five rows at most
    signed = materialize(signatures(items, threshold))
    n = signed.count()
    sieve, bits = bit_map(signed, n)

    h1, h2 = text_key(F.col(text_col))
    source = docs.select(h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    # An inner explode would compute the array a second time, to test its size.
    kept = F.array_distinct(F.filter(shingles(item_words(F.col("text")), sizes, F.xxhash64), lambda h: in_bit_map(h, sieve, bits)))
    met = source.select("h1", "h2", F.explode_outer(kept).alias("hash")).join(F.broadcast(signed) if n <= BROADCAST_HASHES else signed, "hash")
    shared = met.groupBy("h1", "h2", "item").agg(F.count_distinct("hash").alias("shared"), F.first("need").alias("need"))
    pairs = materialize(shared.where("shared >= need").select("h1", "h2", "item"))

    # Shingles of the candidate texts meet those of their items under the key of both, so no common shingle gathers rows.
    wanted = pairs.join(items.select("item", F.explode("shingles").alias("shingle")), "item")
    texts = source.join(pairs.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    held = texts.select("h1", "h2", F.explode_outer(F.array_distinct(shingles(item_words(F.col("text")), sizes, _text))).alias("shingle"))
    found = wanted.join(held, ["h1", "h2", "shingle"]).groupBy("h1", "h2", "item").agg(F.count_distinct("shingle").alias("found"))
    share = F.col("found") / F.size("shingles")
    return found.join(items.select("item", "item_id", "shingles"), "item").select("h1", "h2", "item_id", share.alias("containment")).where(F.col("containment") >= threshold - 1e-9)


@tidy
def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item of whose distinct five-word shingles it holds ``threshold`` or more.

    Returns doc_id, item_id, containment. Words are runs of letters and digits in lower case. An item of fewer than five
    words has one shingle, all of its words. Null texts and texts without words match nothing, on either side. Repeated
    rows of an id give one pair with the greatest containment; null ids stay null. Empty tables give no rows; other
    columns are not read.
    """
    found = materialize(_search(docs, benchmark, threshold, text_col, item_col, item_text_col))
    h1, h2 = text_key(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), h1.alias("h1"), h2.alias("h2"))
    return rows.join(found, ["h1", "h2"]).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


@tidy
def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all columns) whose own text holds no test item.

    Rows are judged by their text: a clean row stays even under the id of a contaminated one, and each repeat of a
    contaminated text goes. Null and empty texts stay. An empty benchmark removes nothing.
    """
    found = materialize(_search(docs, benchmark, threshold, "text", "item_id", "text").select("h1", "h2").distinct())
    return rows_without(docs, found, dict(zip(("h1", "h2"), text_key(F.col("d.text")))))
