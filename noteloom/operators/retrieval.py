"""Nearest notes and passages, keyword scores, fusion, grouping and the result cut."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import checked_similarity, cosine_to
from ..schema import CANDIDATE_CAP, RESULT_CAP, SEARCH_BUDGETS

#: BM25F parameters of the public literature, and the weights of the fields.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 2.0, "heading": 1.0, "body": 1.0}


def candidate_limit(k: int) -> int:
    if k < 1:
        raise ValueError("a limit must be positive")
    return min(k, CANDIDATE_CAP)


def stored_vector(table: DataFrame, key: Column, vector: str) -> list[float]:
    """The vector of exactly one row; none or several are an error."""
    found = table.where(key).select(vector).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"expected one reference row, found {len(found)}")
    return [float(x) for x in found[0][0]]


def nearest(table: DataFrame, query: list[float], vector: str, where: Column | None = None) -> DataFrame:
    """Adds ``score``, the checked cosine to one vector. Filters come first, so that the scan prunes before any arithmetic."""
    kept = table if where is None else table.where(where)
    return kept.withColumn("score", checked_similarity(cosine_to(F.col(vector), query)))


def ranked(candidates: DataFrame, tie: list[str], limit: int) -> DataFrame:
    """Best scores first, ties by the given columns, cut to the candidate limit: one bounded top-k, no full sort."""
    return candidates.orderBy(F.desc("score"), *tie).limit(candidate_limit(limit))


def note_connections(notes: DataFrame, reference, note: str, vector: str, where: Column | None = None, limit: int = 90) -> DataFrame:
    """Notes by cosine to the reference note, which is left out."""
    query = stored_vector(notes, F.col(note) == reference, vector)
    others = F.col(note) != reference
    return ranked(nearest(notes, query, vector, others if where is None else others & where).select(note, "score"), [note], limit)


def passage_connections(passages: DataFrame, reference, note: str, passage: str, vector: str, where: Column | None = None, limit: int = 90) -> DataFrame:
    """Passages of other notes by cosine to one passage; notes are not grouped here, the result cut does that."""
    found = passages.where(F.col(passage) == reference).select(note, vector).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"expected one reference passage, found {len(found)}")
    others = F.col(note) != found[0][0]
    scored = nearest(passages, [float(x) for x in found[0][1]], vector, others if where is None else others & where)
    return ranked(scored.select(note, passage, "score"), [note, passage], limit)


def best_per_note(candidates: DataFrame, note: str, tie: list[str]) -> DataFrame:
    """The best candidate of each note (MaxSim)."""
    w = Window.partitionBy(note).orderBy(F.desc("score"), *tie)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def group_by_note(candidates: DataFrame, note: str, snapshot: str) -> DataFrame:
    """The greatest score of each note; two snapshots of one note are an error."""
    one = F.when(F.min(snapshot).eqNullSafe(F.max(snapshot)), F.max("score")).otherwise(F.raise_error(F.lit("a note has competing snapshots")))
    return candidates.groupBy(note).agg(F.min(snapshot).alias(snapshot), one.alias("score"))


def visible(candidates: DataFrame, note: str, tie: list[str], limit: int = RESULT_CAP) -> DataFrame:
    """Finite scores, one row a note, the best thirty, with their rank from 1.

    The candidates are bounded by the candidate cap, and the ranks run over thirty rows.
    """
    finite = candidates.where(~F.isnan("score") & (F.abs("score") < float("inf")))
    cut = best_per_note(finite, note, tie).orderBy(F.desc("score"), *dict.fromkeys([note, *tie])).limit(limit)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *dict.fromkeys([note, *tie]))))


def current(candidates: DataFrame, manifest: DataFrame, keys: list[str], purges: DataFrame, note: str) -> DataFrame:
    """Candidates whose identity the manifest serves and whose note waits for no purge.

    Run before the top-k, so no growing candidate budget is needed to fill the page.
    """
    return candidates.join(manifest.where("servable").select(*keys), keys, "left_semi").join(purges.select(note), note, "left_anti")


@dataclass(frozen=True)
class Escalated:
    """Admitted rows, how many candidates were taken, and whether there was nothing more to take."""

    hits: DataFrame
    taken: int
    exhausted: bool


def escalating(scored: DataFrame, key: str, admit: Callable[[DataFrame], DataFrame], budgets: Sequence[int] = SEARCH_BUDGETS, wanted: int = RESULT_CAP) -> Escalated:
    """The best admitted rows where admission can't be joined before the top-k, as when it asks something outside.

    ``scored`` has a unique key and finite scores; ``admit`` keeps some of the rows it is given. Each budget takes the
    candidates below the last (score, key) taken, so no candidate is scored into a result twice; it ends when enough are
    admitted, when there are no more, or at the last budget, which bounds what the driver holds.
    """
    spark, order = scored.sparkSession, [F.desc("score"), F.col(key)]
    kept, taken, last, exhausted = [], 0, None, False
    for budget in budgets:
        below = scored if last is None else scored.where((F.col("score") < F.lit(last["score"])) | (F.col("score") == F.lit(last["score"])) & (F.col(key) > F.lit(last[key])))
        window = below.orderBy(*order).limit(candidate_limit(budget) - taken).collect()
        exhausted = len(window) < candidate_limit(budget) - taken
        taken += len(window)
        if window:
            kept += admit(spark.createDataFrame(window, scored.schema)).select(scored.columns).collect()
            last = window[-1]
        if exhausted or len(kept) >= wanted:
            break
    best = spark.createDataFrame(kept, scored.schema).orderBy(*order).limit(wanted)
    return Escalated(best, taken, exhausted)


def keyword_scores(passages: DataFrame, query: str, fields: dict[str, float] | None = None) -> DataFrame:
    """Adds ``score``: BM25F of the query's distinct terms over the weighted fields; rows without a term are dropped.

    Collection statistics are one aggregate over the whole table, a row of bounded width; the scores need no shuffle.
    """
    fields = fields or FIELD_WEIGHTS
    terms = query_terms(query)
    if not terms:
        return passages.withColumn("score", F.lit(0.0)).limit(0)
    tokens = passages.withColumns({f"_w_{f}": words(F.col(f)) for f in fields})
    counts = {f"_n_{f}_{i}": F.size(F.filter(f"_w_{f}", _is(t))) for f in fields for i, t in enumerate(terms)}
    counted = tokens.withColumns(counts | {f"_len_{f}": F.size(f"_w_{f}") for f in fields})
    has = [reduce(add, (F.col(f"_n_{f}_{i}") for f in fields)) > 0 for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("n"), *[F.avg(f"_len_{f}").alias(f) for f in fields], *[F.count(F.when(h, 1)).alias(f"df{i}") for i, h in enumerate(has)]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = reduce(add, (F.lit(w) * F.col(f"_n_{f}_{i}") / (F.lit(1 - B) + F.lit(B) * F.col(f"_len_{f}") / F.lit(stats[f] or 1.0)) for f, w in fields.items()))
        df = stats[f"df{i}"]
        idf = F.ln(F.lit(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * tf / (F.lit(K1) + tf)
    return counted.withColumn("score", score).where("score > 0").select(*passages.columns, "score")


def query_terms(query: str) -> list[str]:
    """Distinct words of a query, in order."""
    return list(dict.fromkeys(w for w in _split(query) if w))


def _is(term: str):
    return lambda w: w == term


def _split(text: str) -> list[str]:
    out, run = [], []
    for c in text.lower():
        if c.isalnum():
            run.append(c)
        else:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)]


def relative_scores(window: DataFrame) -> DataFrame:
    """Scores of one candidate window on [0, 1]: min-max; a constant window is all ones."""
    whole = Window.partitionBy(F.lit(0))
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    return window.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))))


def fuse(keyword: DataFrame, vector: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """Relative-score fusion of two candidate windows: (key, score). A row absent from one side has 0 there."""
    a = relative_scores(keyword).select(key, F.col("score").alias("_k"))
    b = relative_scores(vector).select(key, F.col("score").alias("_v"))
    joined = a.join(b, key, "full")
    return joined.select(key, (F.lit(1 - alpha) * F.coalesce("_k", F.lit(0.0)) + F.lit(alpha) * F.coalesce("_v", F.lit(0.0))).alias("score"))


def hybrid(passages: DataFrame, query: str, query_vector: list[float], passage: str, vector: str, where: Column | None = None, limit: int = 300, alpha: float = 0.5) -> DataFrame:
    """Hybrid search over passages: the best ``limit`` by keyword and by vector, fused, cut again: (passage, score)."""
    n = candidate_limit(limit)
    kept = passages if where is None else passages.where(where)
    keyword = keyword_scores(kept, query).select(passage, "score").orderBy(F.desc("score"), passage).limit(n)
    close = nearest(kept, query_vector, vector).select(passage, "score").orderBy(F.desc("score"), passage).limit(n)
    return fuse(keyword, close, passage, alpha).orderBy(F.desc("score"), passage).limit(n)


def group_hits(hits: DataFrame, note: str, passage: str) -> DataFrame:
    """Notes of fused hits: (note, score, passages), the note's best score and its passages from best to least.

    Hits are bounded by the candidate cap. A passage that appears twice is an error.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(passage).alias("p"))))
    once = F.when(F.count(passage) == F.count_distinct(passage), ordered).otherwise(F.raise_error(F.lit("a passage appears twice")))
    return hits.groupBy(note).agg(F.max("score").alias("score"), F.transform(once, lambda x: x["p"]).alias("passages"))


def candidate_count(passages: DataFrame, note: str) -> DataFrame:
    """One row: candidate passages and the notes that they are of."""
    return passages.agg(F.count("*").alias("candidates"), F.count_distinct(note).alias("notes"))


def fresh_titles(results: DataFrame, files: DataFrame, note: str, title: str) -> DataFrame:
    """Listed results under the titles that their files have now; a note without a file keeps the title it was stored with.

    Results are at most thirty, which is checked, so they go to the files and the files are not shuffled.
    """
    if results.count() > RESULT_CAP:
        raise ValueError("at most thirty results are listed")
    now = files.join(F.broadcast(results.select(note)), note, "left_semi").groupBy(note).agg(F.max(title).alias("_now"))
    return results.join(now, note, "left").withColumn(title, F.coalesce("_now", title)).select(results.columns)
