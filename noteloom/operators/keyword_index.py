"""Inverted index for keyword search: postings bucketed by term, in blocks with upper bounds, so that blocks can be skipped.

The passages of a commit are cut into lots of like length. A block holds the postings of one term in one lot, and the
greatest counts and least lengths in it, which bound any of its scores whatever the collection's averages become. All
terms have the same lots, so a lot's bounds add up to the most that a passage in it can score. A search scores the lots
that promise most, and then those whose bound reaches the k-th score found; the others can't hold a better passage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.commit_index import CommitIndex
from ..sources.store import SnapshotStore
from .retrieval import B, FIELD_WEIGHTS, K1, query_terms

#: Buckets of terms (folders of a segment), and passages of a lot as a power of two.
BUCKETS, LOT_BITS = 64, 6
#: Lots scored first, for each 1 << LOT_BITS passages wanted.
FIRST_LOTS = 4
#: Bounds and scores are sums of doubles in different orders.
MARGIN = 1e-9


@dataclass(frozen=True)
class KeywordHits:
    """The best passages (note_id, passage_id, score), and how many lots with a term of the query there are and were scored."""

    hits: DataFrame
    lots: int
    scored: int


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _in_field(terms: str, field: int) -> Column:
    return F.transform(terms, lambda w: F.struct(w.alias("term"), F.lit(field).alias("field")))


class KeywordIndex(CommitIndex):
    """BM25F over a store's passages, equal to ``keyword_scores`` over the same rows."""

    KIND = "keywords"

    def __init__(self, store: SnapshotStore, generation: int, fields: dict[str, float] | None = None):
        super().__init__(store, generation)
        self.fields = fields or FIELD_WEIGHTS

    def _lengths(self, passages: DataFrame) -> DataFrame:
        split = passages.select("note_id", "passage_id", *[words(F.col(f)).alias(f) for f in self.fields])
        return split.withColumn("lengths", F.array(*[F.size(f) for f in self.fields]))

    def _postings(self, split: DataFrame, *keys: str) -> DataFrame:
        """(keys, note_id, passage_id, term, lengths, counts): a row for each passage and term of it."""
        each = F.concat(*[_in_field(f, i) for i, f in enumerate(self.fields)])
        tokens = split.select(*keys, "note_id", "passage_id", "lengths", F.explode(each).alias("t")).select(*keys, "note_id", "passage_id", "lengths", "t.*")
        counts = F.array(*[F.count_if(F.col("field") == i).cast("int") for i in range(len(self.fields))])
        return tokens.groupBy(*keys, "note_id", "passage_id", "lengths", "term").agg(counts.alias("counts"))

    def _statistics(self, split: DataFrame, postings: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
        """Passages and total lengths as one row, and passages of each term; negative for rows that go."""
        totals = split.agg((F.count("*") * sign).alias("n"), *[(F.coalesce(F.sum(F.col("lengths")[i]), F.lit(0)) * sign).alias(f) for i, f in enumerate(self.fields)])
        return totals, postings.groupBy("term").agg((F.count("*") * sign).alias("df"))

    def schema(self, name: str) -> str | None:
        note, passage = self.kinds(self.store.commits(self.generation), "note_id", "passage_id")
        return {
            "blocks": f"term string, lot long, entries array<struct<note_id: {note}, passage_id: {passage}, counts: array<int>, lengths: array<int>>>, most array<int>, least array<int>, bucket int",
            "terms": "term string, df long, bucket int",
        }.get(name)

    def build(self, folder: str, commit: str, before: list[str]) -> None:
        split = self._lengths(self.store.read_at("passages", self.generation, [commit]))
        # Passages of like length share a lot, so that a block's least lengths are near those of all its passages.
        total = reduce(add, (F.col("lengths")[i] for i in range(len(self.fields))))
        dealt = split.withColumn("total", total).repartitionByRange("total", "note_id", "passage_id").sortWithinPartitions("total", "note_id", "passage_id")
        lots = dealt.withColumn("lot", F.shiftright(F.monotonically_increasing_id(), LOT_BITS))
        postings = self._postings(lots, "lot")
        width = range(len(self.fields))
        blocks = postings.groupBy("term", "lot").agg(
            F.collect_list(F.struct("note_id", "passage_id", "counts", "lengths")).alias("entries"),
            F.array(*[F.max(F.col("counts")[i]) for i in width]).alias("most"),
            F.array(*[F.min(F.col("lengths")[i]) for i in width]).alias("least"),
        )
        blocks.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "lot").write.partitionBy("bucket").parquet(f"{folder}/blocks")
        totals, terms = self._statistics(split, self._postings(split), 1)
        if before:
            # What the commit takes away from the snapshot before it.
            old = self.store.read_at("passages", self.generation, before).join(self.store.gone(self.generation, commit), "note_id", "left_semi")
            lost = self._lengths(old)
            fewer, less = self._statistics(lost, self._postings(lost), -1)
            totals, terms = totals.unionByName(fewer), terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        totals.coalesce(1).write.parquet(f"{folder}/totals")
        terms.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{folder}/terms")

    def _of_terms(self, table: DataFrame, terms: Sequence[str]) -> DataFrame:
        """Rows of the terms, from their buckets alone."""
        spark = table.sparkSession
        numbers = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term"))).distinct().collect()]
        return table.where(F.col("bucket").isin(numbers) & F.col("term").isin(list(terms)))

    def search(self, query: str, k: int, allowed: DataFrame | None = None, tie: Sequence[str] = ("passage_id", "note_id")) -> KeywordHits:
        """The k best passages of the newest snapshot by BM25F of the query's distinct terms, ties by the given columns.

        With ``allowed`` (note_id, passage_id) only those passages count; the collection's statistics stay those of all.
        """
        if k < 1:
            raise ValueError("a limit must be positive")
        commits = self.refresh()
        terms = query_terms(query)
        blocks = self.table("blocks", commits)
        entry = blocks.schema["entries"].dataType.elementType
        none = self.spark.createDataFrame([], f"note_id {entry['note_id'].dataType.simpleString()}, passage_id {entry['passage_id'].dataType.simpleString()}, score double")
        totals = self.table("totals", commits).agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in self.fields]).first()
        known = self._of_terms(self.table("terms", commits), terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect() if terms else []
        if not known:
            return KeywordHits(none, 0, 0)
        df = {r["term"]: r["df"] for r in known}
        terms = [t for t in terms if t in df]
        n = totals["n"]
        averages = [totals[f] / n or 1.0 for f in self.fields]
        idf = F.create_map(*[F.lit(x) for t in terms for x in (t, log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))])
        order = F.create_map(*[F.lit(x) for i, t in enumerate(terms) for x in (t, i)])

        def part(counts: Column, lengths: Column) -> Column:
            """A term's share of a score."""
            tf = reduce(add, (F.lit(w) * counts[i] / (F.lit(1 - B) + F.lit(B) * lengths[i] / F.lit(averages[i])) for i, w in enumerate(self.fields.values())))
            return idf[F.col("term")] * tf / (F.lit(K1) + tf)

        mine = self._of_terms(blocks, terms)
        lots = mine.groupBy("segment", "lot").agg(F.sum(part(F.col("most"), F.col("least"))).alias("bound"))

        def scored(some: DataFrame) -> DataFrame:
            entries = mine.join(some.select("segment", "lot"), ["segment", "lot"], "left_semi").select("segment", "term", F.explode("entries").alias("e")).select("segment", "term", "e.*")
            kept = self.live(entries, commits)
            if allowed is not None:
                kept = kept.join(allowed.select("note_id", "passage_id"), ["note_id", "passage_id"], "left_semi")
            # Shares are added in the order of the query's terms, as a plain scan adds them.
            shares = kept.groupBy("note_id", "passage_id").agg(F.sort_array(F.collect_list(F.struct(order[F.col("term")].alias("i"), part(F.col("counts"), F.col("lengths")).alias("s")))).alias("shares"))
            return shares.select("note_id", "passage_id", F.aggregate("shares", F.lit(0.0), lambda t, s: t + s["s"]).alias("score"))

        def best(found: DataFrame) -> DataFrame:
            return found.orderBy(F.desc("score"), *tie).limit(k)

        first = FIRST_LOTS * (1 + (k >> LOT_BITS))
        lead = [(r["segment"], r["lot"]) for r in lots.orderBy(F.desc("bound"), "segment", "lot").limit(first).collect()]
        leading = F.broadcast(self.spark.createDataFrame(lead, "segment int, lot long"))
        ahead = best(scored(leading)).collect()
        found = self.spark.createDataFrame(ahead, none.schema)
        floor = ahead[-1]["score"] * (1 - MARGIN) if len(ahead) == k else 0.0
        rest = lots.join(leading, ["segment", "lot"], "left_anti")
        counts = rest.agg(F.count("*"), F.count_if(F.col("bound") >= floor)).first()
        if counts[1]:
            found = best(found.unionByName(scored(rest.where(F.col("bound") >= floor))))
        return KeywordHits(found, len(lead) + counts[0], len(lead) + counts[1])
