"""The registered queries over the note operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import properties as P
from .functions import text as X
from .functions import vectors as V
from .lineage import shared_folder
from .operators import graph as G
from .operators import retrieval as R
from .operators.admission import IgnoreFile, PathPolicy, admission, manual_exclusion, path_reason, readmit
from .operators.chunking import chunk_notes
from .operators.coverage import span_coverage as covered
from .operators.embedding import HashingEmbedder, embed_late, reuse_vectors
from .operators.keyword_index import KeywordIndex
from .operators.vector_index import VectorIndex
from .plans import indexing as I
from .sources import folder_watch as L
from .sources import store as S
from .sources import validation as N
from .sources.tombstones import Tombstones
from .streaming import changes as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(c: Column | str, n: int = 6) -> Column:
    """Rounded, with zero always unsigned."""
    return F.round(c, n) + F.lit(0.0)


# --- Retrieval over vectors: embeddings are notes; a label is a property, or a note whose passages they are.

_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"""
with scored as (
  select b.vec_id, round({_COS}, 6) as score, {_COS} as raw from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id <> 0)
select vec_id, score, row_number() over (order by raw desc, vec_id)::int as rank from scored qualify rank <= 30""")
def note_connections(spark: SparkSession, d: str) -> DataFrame:
    found = R.note_connections(_t(spark, d, "embeddings"), 0, "vec_id", "embedding")
    return R.visible(found, "vec_id", []).select("vec_id", rounded("score").alias("score"), "rank")


@query(f"""
select b.vec_id, round({_COS}, 6) as score from embeddings a, embeddings b
where a.vec_id = 0 and b.vec_id <> 0 and b.label >= 3 and b.label <> 7 order by {_COS} desc, b.vec_id limit 90""")
def note_connections_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = P.compile_filters([P.PropertyFilter("label", "number", "gte", 3), P.PropertyFilter("label", "number", "ne", 7)], {("label", "number"): "label"})
    return R.note_connections(_t(spark, d, "embeddings"), 0, "vec_id", "embedding", where).select("vec_id", rounded("score").alias("score"))


@query(f"""
with hits as (
  select b.label as note_id, b.vec_id as passage_id, {_COS} as raw from embeddings a, embeddings b
  where a.vec_id = 0 and b.label <> a.label order by raw desc, b.label, b.vec_id limit 300)
select note_id, passage_id, round(raw, 6) as score, row_number() over (order by raw desc, note_id)::int as rank from (
  select * from hits qualify row_number() over (partition by note_id order by raw desc, passage_id) = 1)""")
def passage_connections_maxsim(spark: SparkSession, d: str) -> DataFrame:
    passages = _t(spark, d, "embeddings").select(F.col("label").alias("note_id"), F.col("vec_id").alias("passage_id"), "embedding")
    hits = R.passage_connections(passages, 0, "note_id", "passage_id", "embedding", limit=300)
    return R.visible(hits, "note_id", ["passage_id"]).select("note_id", "passage_id", rounded("score").alias("score"), "rank")


_LITERAL = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_LITERAL}::double[]), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], {_LITERAL}::double[]) desc, vec_id limit 90")
def near_vector(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(R.nearest(_t(spark, d, "embeddings"), _LITERAL, "embedding").select("vec_id", "score"), ["vec_id"], 90).select("vec_id", rounded("score").alias("score"))


@query(f"""
with top as (
  select vec_id, label, list_cosine_similarity(embedding::double[], {_LITERAL}::double[]) as s from embeddings order by s desc, vec_id limit 1200)
select vec_id, round(s, 6) as score from top where label = 3 order by s desc, vec_id limit 30""")
def escalating_results(spark: SparkSession, d: str) -> DataFrame:
    """The best thirty notes that an outside admission keeps (here: one label), found by growing budgets."""
    e = _t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    scored = R.nearest(e, _LITERAL, "embedding").select("vec_id", "label", "score")
    return R.escalating(scored, "vec_id", lambda rows: rows.where("label = 3")).hits.select("vec_id", rounded("score").alias("score"))


@query("""
with rows as (
  select case when doc_id % 11 = 0 then repeat('x', 513) when doc_id % 13 = 0 then '' else doc_id::varchar end as note_id, case when doc_id % 5 = 0 then null else text end as body,
    case when doc_id % 7 = 0 then n_chars + 1 else 0 end as s, n_chars as e from documents),
faults as (
  select unnest(list_filter([case when length(note_id) not between 1 and 512 then 'note_id' end, case when body is null then 'body' end, case when e < s then 'characters' end], lambda f: f is not null)) as fault from rows)
select fault, count(*) as rows from faults group by fault""")
def row_faults(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break which rule, over documents as passages with faults put in."""
    every = lambda n: F.pmod("doc_id", F.lit(n)) == 0
    name = F.when(every(11), F.repeat(F.lit("x"), 513)).when(every(13), F.lit("")).otherwise(F.col("doc_id").cast("string"))
    rows = _t(spark, d, "documents").select(
        name.alias("note_id"), F.lit("s").alias("snapshot_id"), F.lit(0).alias("passage_index"), F.when(~every(5), F.col("text")).alias("body"),
        F.when(every(7), F.col("n_chars") + 1).otherwise(F.lit(0)).alias("start"), F.col("n_chars").alias("end"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(None).cast("int").alias("start_token"), F.lit(None).cast("int").alias("end_token"),
    )
    return N.fault_counts(N.with_faults(rows, N.passage_rules()))


@query(f"select a.vec_id as source, b.vec_id as target, round({_COS}, 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("target"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("source"), "target", rounded(V.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("select label, n, round(score, 6) as score from (select b.label, count(*) as n, max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as score from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id <> 0 group by b.label)")
def grouped_best_score(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").withColumn("snapshot_id", F.lit("s"))
    scored = R.nearest(e, R.stored_vector(e, F.col("vec_id") == 0, "embedding"), "embedding", F.col("vec_id") != 0)
    counts = scored.groupBy("label").agg(F.count("*").alias("n"))
    return R.group_by_note(scored, "label", "snapshot_id").join(counts, "label").select("label", "n", rounded("score").alias("score"))


_LISTED = f"""
listed as (
  select b.vec_id, b.embedding, {_COS} as score, row_number() over (order by {_COS} desc, b.vec_id)::int as rank
  from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id <> 0 qualify rank <= 30)"""
_EDGES = _LISTED + """,
edges as (
  select a.vec_id as source, b.vec_id as target, a.rank as sr, b.rank as tr, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine
  from listed a join listed b on a.rank < b.rank)"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return R.visible(R.note_connections(_t(spark, d, "embeddings"), 0, "vec_id", "embedding"), "vec_id", [])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.complete_graph(_listed(spark, d), _t(spark, d, "embeddings"), "vec_id", ["vec_id"], "embedding")


@query(f"with {_LISTED} select 0::bigint as source, vec_id as target, round(score, 6) as cosine from listed")
def star_graph(spark: SparkSession, d: str) -> DataFrame:
    g = G.star_graph(_listed(spark, d), 0, "vec_id")
    return g.select(F.col("source").cast("long").alias("source"), "target", rounded("cosine").alias("cosine"))


@query(f"with {_EDGES} select source, target, round(cosine, 6) as cosine from edges")
def complete_graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("source", "target", rounded("cosine").alias("cosine"))


@query(f"with {_EDGES} select source, target, round(cosine, 6) as cosine from edges where cosine >= 0.2")
def edges_above_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_above(_edges(spark, d), 0.2).select("source", "target", rounded("cosine").alias("cosine"))


@query(f"""
with {_LISTED}, n as (select count(*) as n from listed),
placed as (
  select vec_id, rank, case when n <= 10 then 105.0 when rank <= 10 then 60.0 else 116.0 end as r,
    -pi() / 2 + (case when rank <= 10 then rank - 1 else rank - 11 end) * 2 * pi() / (case when rank <= 10 then least(n, 10) else greatest(1, n - 10) end) as t
  from listed, n)
select vec_id, rank, round(180 + cos(t) * r, 3) + 0.0 as x, round(140 + sin(t) * r, 3) + 0.0 as y from placed""")
def ring_layout(spark: SparkSession, d: str) -> DataFrame:
    return G.ring_layout(_listed(spark, d), "vec_id").select("vec_id", "rank", rounded("x", 3).alias("x"), rounded("y", 3).alias("y"))


@query(f"""
with {_EDGES}, n as (select count(*) as n from listed),
placed as (
  select vec_id, rank, case when n <= 10 then 105.0 when rank <= 10 then 60.0 else 116.0 end as r,
    -pi() / 2 + (case when rank <= 10 then rank - 1 else rank - 11 end) * 2 * pi() / (case when rank <= 10 then least(n, 10) else greatest(1, n - 10) end) as t
  from listed, n),
spots as (select vec_id, 180 + cos(t) * r as x, 140 + sin(t) * r as y from placed)
select source, target, round(a.x, 3) + 0.0 as x1, round(a.y, 3) + 0.0 as y1, round(b.x, 3) + 0.0 as x2, round(b.y, 3) + 0.0 as y2
from edges join spots a on a.vec_id = source join spots b on b.vec_id = target""")
def placed_edges(spark: SparkSession, d: str) -> DataFrame:
    placed = G.placed_edges(_edges(spark, d), G.ring_layout(_listed(spark, d), "vec_id"), "vec_id")
    return placed.select("source", "target", *[rounded(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""
with {_LISTED}
select vec_id, rank, coalesce('doc-' || doc_id, 'stored-' || vec_id) as title from listed left join documents on doc_id = vec_id""")
def fresh_titles(spark: SparkSession, d: str) -> DataFrame:
    listed = _listed(spark, d).select("vec_id", "rank", F.concat(F.lit("stored-"), F.col("vec_id").cast("string")).alias("title"))
    files = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"))
    return R.fresh_titles(listed, files, "vec_id", "title")


@query(f"""
with {_EDGES}, ends as (
  select source as note, target as other, cosine, sr, tr from edges union all select target, source, cosine, sr, tr from edges)
select note, other, round(cosine, 6) as cosine from ends qualify row_number() over (partition by note order by cosine desc, sr, tr) = 1""")
def strongest_pair(spark: SparkSession, d: str) -> DataFrame:
    return G.strongest_pairs(_edges(spark, d)).select("note", "other", rounded("cosine").alias("cosine"))


@query("""
with sums as (
  select label, pos, sum(embedding[pos]::double) as s from embeddings, range(1, 65) r(pos) group by label, pos),
norms as (select label, sqrt(sum(s * s)) as n from sums group by label)
select label, (pos - 1)::int as pos, round(s / n, 5) + 0.0 as value from sums join norms using (label)""")
def aggregate_vectors_by_label(spark: SparkSession, d: str) -> DataFrame:
    summed = V.aggregate_vectors(_t(spark, d, "embeddings"), ["label"], "embedding", 64)
    return summed.select("label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", rounded("value", 5))


@query("""
with tokens as (select label, row_number() over (partition by label order by vec_id) - 1 as t, embedding from embeddings),
ranges(passage_index, a, b) as (values (0, 1, 5), (1, 5, 11)),
means as (
  select label, passage_index, pos, avg(embedding[pos]::double) as m from tokens join ranges on t >= a and t < b, range(1, 65) r(pos) group by all),
norms as (select label, passage_index, sqrt(sum(m * m)) as n from means group by all)
select label, passage_index, (pos - 1)::int as pos, round(m / n, 5) + 0.0 as value from means join norms using (label, passage_index)""")
def token_range_pool(spark: SparkSession, d: str) -> DataFrame:
    tokens = _t(spark, d, "embeddings").withColumn("t", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    plan = [(0, 1, 5), (1, 5, 11)]
    labels = tokens.select("label").distinct()
    ranges = labels.select("label", F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, ("passage_index", "start_token", "end_token"))]) for p in plan])).alias("r")).select("label", "r.*")
    pooled = V.pool_ranges(tokens, ranges, "label", "t", "embedding", 64)
    return pooled.select("label", "passage_index", F.posexplode("vector").alias("pos", "value")).withColumn("value", rounded("value", 5))


@query("select vec_id, len(embedding) = 64 and abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) <= 1e-4 as valid from embeddings")
def unit_vector_check(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", V.is_unit(F.col("embedding"), 64).alias("valid"))


# --- Keyword and hybrid search: conversations are notes, their turns passages.

_QUERY = "the then of and"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("note_id"), F.concat_ws(":", "conv_id", "turn").alias("passage_id"), F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("title"), F.col("role").alias("heading"), F.col("text").alias("body"), "turn"
    )


_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_BM25 = f"""
passages as (
  select conv_id as note_id, conv_id || ':' || turn as passage_id, {_TOKENS.format("'conv ' || conv_id")} as title, {_TOKENS.format("role")} as heading, {_TOKENS.format("text")} as body from conversations),
stats as (select count(*) as n, avg(len(title)) as lt, avg(len(heading)) as lh, avg(len(body)) as lb from passages),
terms as (select unnest(['the', 'then', 'of', 'and']) as term),
tf as (
  select note_id, passage_id, term, len(list_filter(title, lambda w: w = term)) as ct, len(list_filter(heading, lambda w: w = term)) as ch, len(list_filter(body, lambda w: w = term)) as cb,
    len(title) as nt, len(heading) as nh, len(body) as nb from passages, terms),
df as (select term, count(*) filter (ct + ch + cb > 0) as df from tf group by term),
weighed as (
  select note_id, passage_id, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf,
    2 * ct / (0.25 + 0.75 * nt / lt) + ch / (0.25 + 0.75 * nh / lh) + cb / (0.25 + 0.75 * nb / lb) as w from tf join df using (term), stats),
keyword as (
  select note_id, passage_id, sum(idf * w / (1.2 + w)) as score from weighed group by all having sum(idf * w / (1.2 + w)) > 0)"""


@query(f"with {_BM25} select passage_id, round(score, 6) as score from keyword order by keyword.score desc, passage_id limit 300")
def bm25f_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(R.keyword_scores(_passages(spark, d), _QUERY), ["passage_id"], 300).select("passage_id", rounded("score").alias("score"))


def _vault_store(spark: SparkSession, d: str, passages: DataFrame, notes: DataFrame) -> S.SnapshotStore:
    """A store of two commits: all notes without those of odd ids and with stale texts of the others' thirds, then what sets both right."""
    store = S.SnapshotStore(spark, f"{shared_folder(spark)}/noteloom-store-{uuid.uuid4().hex}")
    for stale in (True, False):
        some = F.pmod("note_id", F.lit(2)) == 0 if stale else (F.pmod("note_id", F.lit(2)) == 1) | (F.pmod("note_id", F.lit(3)) == 0)
        mark = lambda df: df.where(some).withColumn("snapshot_id", F.lit("old" if stale else "new"))
        kept = mark(passages)
        if stale:
            kept = kept.withColumn("body", F.when(F.pmod("note_id", F.lit(3)) == 0, F.concat(F.lit("stale the then "), "body")).otherwise(F.col("body")))
        store.upsert(1, mark(notes), kept)
    return store


@query(f"with {_BM25} select passage_id, round(score, 6) as score from keyword order by keyword.score desc, passage_id limit 300")
def bm25f_indexed(spark: SparkSession, d: str) -> DataFrame:
    """``bm25f_topk`` from the stored inverted index of a vault whose second commit replaces some notes."""
    passages = _passages(spark, d).withColumn("passage_index", (F.row_number().over(Window.partitionBy("note_id").orderBy("turn")) - 1).cast("int"))
    store = _vault_store(spark, d, passages, passages.select("note_id").distinct())
    found = KeywordIndex(store, 1).search(_QUERY, 300, tie=["passage_id"])
    return found.hits.select("passage_id", rounded("score").alias("score"))


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_LITERAL}::double[]), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], {_LITERAL}::double[]) desc, vec_id limit 90")
def near_vector_pruned(spark: SparkSession, d: str) -> DataFrame:
    """``near_vector`` from the pivot layout of a vault whose second commit replaces some notes."""
    e = _t(spark, d, "embeddings")
    notes = e.select(F.col("vec_id").alias("note_id"), F.col("embedding").alias("vector"))
    passages = e.select(F.col("vec_id").alias("note_id"), F.lit(0).alias("passage_index"), F.lit("p").alias("passage_id"), F.lit("").alias("body"))
    found = VectorIndex(_vault_store(spark, d, passages, notes), 1).nearest(_LITERAL, 90)
    return found.hits.select(F.col("note_id").alias("vec_id"), rounded("score").alias("score"))


_HYBRID = f"""{_BM25},
kw as (select * from keyword order by score desc, passage_id limit 300),
vec as (
  select conv_id || ':' || turn as passage_id, list_cosine_similarity(embedding::double[], {_LITERAL}::double[]) as score
  from conversations join embeddings on vec_id = (conv_id * 8 + turn) % 500 order by score desc, passage_id limit 300),
kn as (select passage_id, case when max(score) over () = min(score) over () then 1.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end as s from kw),
vn as (select passage_id, case when max(score) over () = min(score) over () then 1.0 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end as s from vec),
fused as (
  select coalesce(kn.passage_id, vn.passage_id) as passage_id, 0.5 * coalesce(kn.s, 0) + 0.5 * coalesce(vn.s, 0) as score
  from kn full join vn on kn.passage_id = vn.passage_id order by score desc, passage_id limit 300)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    passages = _passages(spark, d).withColumn("_v", F.pmod(F.col("note_id") * 8 + F.col("turn"), F.lit(500))).join(vectors, "_v")
    return R.hybrid(passages, _QUERY, _LITERAL, "passage_id", "embedding", limit=300)


@query(f"with {_HYBRID} select passage_id, round(score, 6) as score from fused")
def hybrid_fusion_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("passage_id", rounded("score").alias("score"))


@query(f"""
with {_HYBRID}, hits as (select split_part(passage_id, ':', 1)::bigint as note_id, passage_id, round(score, 9) as score from fused)
select note_id, round(max(score), 6) as score, string_agg(passage_id, ',' order by score desc, passage_id) as passages from hits group by note_id order by max(score) desc, note_id limit 30""")
def hybrid_grouped_notes(spark: SparkSession, d: str) -> DataFrame:
    hits = _hybrid(spark, d).select(F.split("passage_id", ":")[0].cast("long").alias("note_id"), "passage_id", F.round("score", 9).alias("score"))
    notes = R.group_hits(hits, "note_id", "passage_id")
    return notes.orderBy(F.desc("score"), "note_id").limit(30).select("note_id", rounded("score").alias("score"), F.array_join("passages", ",").alias("passages"))


@query("with hits as (select conv_id || ':' || turn as passage_id from conversations) select count(*) as candidates, count(distinct split_part(passage_id, ':', 1)) as notes from hits")
def candidate_count(spark: SparkSession, d: str) -> DataFrame:
    return R.candidate_count(_passages(spark, d), "note_id")


# --- Passage tables.


@query("select turn as passage_index, role as heading, text as body from conversations where conv_id = 3")
def passage_list_ordered(spark: SparkSession, d: str) -> DataFrame:
    return S.ordered_passages(_t(spark, d, "conversations"), {"conv_id": 3}, "turn").select(F.col("turn").alias("passage_index"), F.col("role").alias("heading"), F.col("text").alias("body"))


@query("select conv_id, turn, text from conversations where conv_id >= 0 order by conv_id, turn limit 64 offset 64")
def passage_page(spark: SparkSession, d: str) -> DataFrame:
    return S.page(_t(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], 1)


@query("select conv_id, count(*) as n, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as contiguous from conversations group by conv_id")
def passage_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return S.contiguity(_t(spark, d, "conversations"), ["conv_id"], "turn")


@query("""
with lens as (select conv_id, turn, length(text) as n, length(text) - length(replace(text, chr(10), '')) as nl from conversations)
select conv_id, turn, coalesce(sum(n) over w, 0)::bigint as start_offset, coalesce(sum(nl) over w, 0)::bigint as start_line, (coalesce(sum(nl) over w, 0) + nl)::bigint as end_line
from lens window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return X.line_spans(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""
select conv_id, turn, 'conv-' || conv_id || '.md > conv-' || conv_id || ' > ' || role || ' > Lines ' || (turn + 1) || '-' || (turn + 2) as label, 3 + greatest(0, turn - 2) as line from conversations""")
def passage_labels(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    label = X.passage_label(F.concat(name, F.lit(".md")), F.concat_ws(" / ", name, "role"), F.col("turn"), F.col("turn") + 1)
    return _t(spark, d, "conversations").select("conv_id", "turn", label.alias("label"), X.source_line(F.lit(3), F.col("turn")).alias("line"))


# --- Text, identity, tags and paths.


@query("select doc_id, '# doc-' || doc_id || chr(10) || chr(10) || text as canonical from documents")
def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.canonical_text(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text")).alias("canonical"))


@query("""
with n as (select doc_id, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then chr(65279) || '---' || chr(13) || chr(10) || 'k: 1' || chr(13) || chr(10) || '---' || chr(13) || chr(10) else '---' || chr(10) || '---' || chr(10) end || text as md, text from documents)
select doc_id, sha256(text) as body_hash, case doc_id % 3 when 1 then 'k: 1' || chr(13) || chr(10) end as front from n""")
def frontmatter_split(spark: SparkSession, d: str) -> DataFrame:
    lead = F.expr("case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then concat('\\uFEFF', '---\\r\\nk: 1\\r\\n---\\r\\n') else '---\\n---\\n' end")
    md = F.concat(lead, F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.sha2(X.strip_frontmatter(md), 256).alias("body_hash"), X.frontmatter(md).alias("front"))


@query("select doc_id, sha256('# doc-' || doc_id || chr(10) || chr(10) || text) as body_hash from documents")
def body_hash(spark: SparkSession, d: str) -> DataFrame:
    return canonical_text(spark, d).select("doc_id", F.sha2("canonical", 256).alias("body_hash"))


@query("""select doc_id, sha256(sha256(text) || chr(0) || '{}' || chr(0) || '["' || lang || '"]' || chr(0) || 'doc-' || doc_id || '.md' || chr(0) || '1') as snapshot_id from documents""")
def snapshot_id(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _t(spark, d, "documents").select("doc_id", X.snapshot_id(F.sha2("text", 256), F.lit("{}"), F.array("lang"), path, F.lit(1)).alias("snapshot_id"))


@query("""
with h as (select doc_id, sha256('vault' || chr(0) || 'note' || chr(0) || doc_id) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as object_id from h""")
def object_id(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.object_id(F.concat_ws("\0", F.lit("vault"), F.lit("note"), F.col("doc_id").cast("string"))).alias("object_id"))


@query("select conv_id, turn || ':' || 0 || ':' || length(text) as passage_id from conversations")
def passage_id(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", X.passage_id(F.col("turn"), F.lit(0), F.length("text")).alias("passage_id"))


_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return _t(spark, d, "pages").select("page_id", raw.alias("raw"))


@query(f"""select page_id, array_to_string(list_filter(string_split({_PATH}, '/'), lambda p: p <> '' and p <> '.'), '/') as path from pages""")
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", X.normalize_path(F.col("raw")).alias("path"))


@query(f"""
with parts as (select page_id, list_filter(string_split({_PATH}, '/'), lambda p: p <> '') as p from pages)
select page_id, unnest(list_prepend('', list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/')))) as directory from parts""")
def path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return path_normalize(spark, d).select("page_id", F.explode(X.ancestor_directories(F.col("path"))).alias("directory"))


@query(f"""
with p as (select page_id, array_to_string(list_filter(string_split({_PATH}, '/'), lambda p: p <> ''), '/') as path from pages)
select page_id, case when path like '%/en/%' and starts_with(path, 'www.') then null when starts_with(path, 'blog.tionsh.example.com/') then 'folder exclusion blog.tionsh.example.com' end as reason from p""")
def manual_exclusion_reason(spark: SparkSession, d: str) -> DataFrame:
    return path_normalize(spark, d).select("page_id", manual_exclusion(F.col("path"), ["blog.tionsh.example.com"], ["none.md"]).alias("reason"))


@query(f"""
with p as (select page_id, array_to_string(list_filter(string_split({_PATH}, '/'), lambda p: p <> ''), '/') || '.md' as path from pages)
select page_id, case when starts_with(path, 'm.') then 'Excluded by .gitignore (m.*/)' when path like '%/fr/%' then 'Excluded by .gitignore (fr/)' when ends_with(path, '.html.md') then 'Excluded by .gitignore (*.html.md)' end as reason from p""")
def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    policy = PathPolicy(controls=(IgnoreFile("", ".gitignore", ("*.html.md", "fr/", "m.*/")),))
    paths = path_normalize(spark, d).select("page_id", F.concat("path", F.lit(".md")).alias("path"))
    return paths.select("page_id", path_reason(F.col("path"), policy).alias("reason"))


@query("""
with t as (select doc_id, ['status/inbox/' || source, lang || '/notes/' || source, lang] as tags from documents)
select doc_id, array_to_string(list_distinct_ordered, ',') as ancestors from (
  select doc_id, ['status', 'status/inbox', tags[1], tags[3], tags[3] || '/notes', tags[2]] as list_distinct_ordered from t)""")
def tag_ancestors(spark: SparkSession, d: str) -> DataFrame:
    tags = X.normalize_tags(F.array(F.concat(F.lit("#Status/INBOX/"), F.col("source")), F.concat("lang", F.lit("/notes/"), "source"), F.concat(F.lit("#"), F.col("lang"))))
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.tag_ancestors(tags), ",").alias("ancestors"))


@query("select doc_id, case when doc_id % 4 = 0 then 'status/inbox' when doc_id % 4 = 1 then 'type/private/' || lang end as blocked from documents")
def blocked_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = F.expr("case doc_id % 4 when 0 then '#STATUS/INBOX' when 1 then concat('type/private/', lang) when 2 then 'status/inboxes' else 'type/privately' end")
    return _t(spark, d, "documents").select("doc_id", X.blocking_tag(X.normalize_tags(F.array("lang", tag))).alias("blocked"))


# --- Properties and filters: the events' JSON is frontmatter.


def _front(spark: SparkSession, d: str) -> DataFrame:
    """Events as notes with properties of every kind."""
    e = _t(spark, d, "events")
    made = F.expr(
        "case event_id % 6 when 0 then concat('{\"k\":', get_json_object(props, '$.k'), ',\"flag\":true}') when 1 then '{\"k\":null,\"due\":\"2024-02-29\"}'"
        " when 2 then '{\"list\":[],\"tags\":[\"a\",\"b\"]}' when 3 then concat('{\"nums\":[1,', event_id, '],\"k\":\"', event_type, '\"}') when 4 then '{\"due\":\"2026-02-30\",\"obj\":{\"b\":1,\"a\":2}}' else '{\"dates\":[\"2024-01-02\",\"2024-03-04\"],\"mix\":[1,\"x\"]}' end"
    )
    return e.select("event_id", made.alias("json"))


_PROPS = """
props as (
  select event_id, 'k' as key, props->>'$.k' as value, 'number' as kind from events where event_id % 6 = 0
  union all select event_id, 'flag', 'true', 'boolean' from events where event_id % 6 = 0
  union all select event_id, 'k', 'null', null from events where event_id % 6 = 1
  union all select event_id, 'due', '"2024-02-29"', 'date' from events where event_id % 6 = 1
  union all select event_id, 'list', '[]', null from events where event_id % 6 = 2
  union all select event_id, 'tags', '["a","b"]', 'textArray' from events where event_id % 6 = 2
  union all select event_id, 'nums', '[1,' || event_id || ']', 'numberArray' from events where event_id % 6 = 3
  union all select event_id, 'k', '"' || event_type || '"', 'text' from events where event_id % 6 = 3
  union all select event_id, 'due', '"2026-02-30"', 'text' from events where event_id % 6 = 4
  union all select event_id, 'obj', '{"a":2,"b":1}', 'json' from events where event_id % 6 = 4
  union all select event_id, 'dates', '["2024-01-02","2024-03-04"]', 'dateArray' from events where event_id % 6 = 5
  union all select event_id, 'mix', '[1,"x"]', 'textArray' from events where event_id % 6 = 5)"""


@query(f"with {_PROPS} select event_id, key, lower(hex(encode(key))) as key_hex, kind from props")
def property_kinds(spark: SparkSession, d: str) -> DataFrame:
    return P.explode_properties(_front(spark, d), "event_id", "json").select("event_id", "key", "key_hex", "kind")


@query(f"""
with {_PROPS}, suffix(kind, s) as (values ('text', 't'), ('number', 'n'), ('boolean', 'b'), ('date', 'd'), ('textArray', 'ta'), ('numberArray', 'na'), ('dateArray', 'da'), ('json', 'j'))
select distinct key, kind, 'p_' || lower(hex(encode(key))) || '_' || s as physical_name from props join suffix using (kind)""")
def property_registry(spark: SparkSession, d: str) -> DataFrame:
    return P.registry(P.explode_properties(_front(spark, d), "event_id", "json"))


_WIDE = [("k", "number", "k_n"), ("k", "text", "k_t"), ("flag", "boolean", "flag_b"), ("due", "date", "due_d"), ("tags", "textArray", "tags_ta"), ("nums", "numberArray", "nums_na")]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """Every event, with those without a property too."""
    return P.typed_columns(_front(spark, d), "json", _WIDE)


def _filter_query(name: str, f: P.PropertyFilter, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _wide(spark, d).where(P.compile_filters([f], {(k, kind): c for k, kind, c in _WIDE})).select("event_id")

    run.__name__ = name
    query(f"select event_id from events where {sql}")(run)


_K = "event_id % 6 = 0 and (props->>'$.k')::double"
for _name, _f, _sql in (
    ("filter_eq", P.PropertyFilter("k", "number", "eq", 42), f"{_K} = 42"),
    ("filter_ne", P.PropertyFilter("k", "number", "ne", 42), f"not ({_K} = 42)"),
    ("filter_gt", P.PropertyFilter("k", "number", "gt", 42), f"{_K} > 42"),
    ("filter_gte", P.PropertyFilter("k", "number", "gte", 42), f"{_K} >= 42"),
    ("filter_lt", P.PropertyFilter("k", "number", "lt", 42), f"{_K} < 42"),
    ("filter_lte", P.PropertyFilter("k", "number", "lte", 42), f"{_K} <= 42"),
    ("filter_eq_text", P.PropertyFilter("k", "text", "eq", "click"), "event_id % 6 = 3 and event_type = 'click'"),
    ("filter_date", P.PropertyFilter("due", "date", "gte", "2024-02-01"), "event_id % 6 = 1"),
    ("filter_contains_any", P.PropertyFilter("tags", "textArray", "containsAny", ["b", "z"]), "event_id % 6 = 2"),
    ("filter_contains_all", P.PropertyFilter("nums", "numberArray", "containsAll", [1, 9]), "event_id = 9"),
    ("filter_missing", P.PropertyFilter("k", "number", "missing"), "event_id % 6 not in (0, 1, 3)"),
    ("filter_null", P.PropertyFilter("k", "number", "null"), "event_id % 6 = 1"),
    ("filter_empty", P.PropertyFilter("list", "textArray", "empty"), "event_id % 6 = 2"),
):
    _filter_query(_name, _f, _sql)


@query("""
with e as (select event_id, event_id % 6 as k, date_trunc('second', ts) as ts from events)
select event_id,
  strftime(ts, '%Y-%m-') || case when k = 5 then '32' else strftime(ts, '%d') end || case k when 0 then '' when 5 then '' else strftime(ts, 'T%H:%M:%S') end
    || case k when 1 then 'Z' when 2 then '+02:30' when 3 then '.5-01:00' else '' end as value,
  case when k < 4 then strftime(case k when 0 then date_trunc('day', ts) when 1 then ts when 2 then ts - interval 150 minute else ts + interval 60 minute end, '%Y-%m-%dT%H:%M:%S') || case when k = 3 then '.500Z' else '.000Z' end end as iso
from e""")
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Times of events as dates, zoned timestamps, timestamps without a zone and days that don't exist, normalised."""
    ts, k = F.col("ts").cast("timestamp"), F.pmod("event_id", F.lit(6))
    clock = F.when(k.isin(0, 5), "").otherwise(F.date_format(ts, "'T'HH:mm:ss"))
    zone = F.when(k == 1, "Z").when(k == 2, "+02:30").when(k == 3, ".5-01:00").otherwise("")
    value = F.concat(F.date_format(ts, "yyyy-MM-"), F.when(k == 5, "32").otherwise(F.date_format(ts, "dd")), clock, zone)
    return _t(spark, d, "events").select("event_id", value.alias("value")).withColumn("iso", P.date_text(F.col("value")))


# --- Admission, currency and incremental maintenance.


@query("""
with l as (select doc_id, max(toxic) as toxic from labels group by doc_id)
select d.doc_id, case when toxic is null then 'Metadata is not ready' when toxic = 1 then 'ai_index is false' when lang = 'es' then 'Blocked tag status/inbox/es' end as reason,
  toxic is null as deferred, coalesce(toxic = 0 and lang <> 'es', false) as admitted
from documents d left join l using (doc_id)""")
def admission_reason(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").groupBy("doc_id").agg((F.max("toxic") == 0).alias("ai_index"))
    notes = _t(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("ai_index").isNotNull().alias("metadata_ready"), "ai_index", F.when(F.col("lang") == "es", F.array(F.lit("status/inbox/es"))).otherwise(F.array("lang")).alias("tags")
    )
    return admission(notes, PathPolicy()).select("doc_id", "reason", "deferred", "admitted")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after a run in which every seventh document was then edited and every fifth re-tagged."""
    docs = _t(spark, d, "documents")
    body = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("note_id"), F.concat(body, F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")).alias("snapshot_id"), body.alias("body_hash"), F.lit("m").alias("fingerprint"), (F.col("doc_id") % 13 != 0).alias("committed"), (F.col("doc_id") % 3 != 0).alias("servable"))


@query("select doc_id as note_id, case when doc_id % 11 = 0 or doc_id % 13 = 0 or doc_id % 7 = 0 then 'embed' when doc_id % 5 = 0 then 'metadata' else 'noop' end as action from documents")
def index_action(spark: SparkSession, d: str) -> DataFrame:
    now = _t(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.sha2("text", 256).alias("snapshot_id"), F.sha2("text", 256).alias("body_hash"))
    return I.index_actions(now, _manifest(spark, d), "m").select("note_id", "action")


@query("select doc_id as note_id from documents where doc_id % 11 <> 0 and doc_id % 7 <> 0 and doc_id % 5 <> 0 and doc_id % 3 <> 0 and doc_id not in (select doc_id from labels where toxic = 1)")
def current_results_semi(spark: SparkSession, d: str) -> DataFrame:
    candidates = _t(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.sha2("text", 256).alias("snapshot_id"))
    purges = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("note_id"))
    return R.current(candidates, _manifest(spark, d), ["note_id", "snapshot_id"], purges, "note_id").select("note_id")


@query("select doc_id as note_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def purge_anti(spark: SparkSession, d: str) -> DataFrame:
    purges = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("note_id"))
    return C.purged(_t(spark, d, "documents").select(F.col("doc_id").alias("note_id")), purges, "note_id")


@query("select 'doc-' || doc_id || '.md' as path, doc_id % 4 = 0 as forget from documents where doc_id % 2 = 0")
def stale_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return I.stale_notes(docs.select("path"), docs.where("doc_id % 2 = 1"), docs.where("doc_id % 4 <> 0")).select("path", "forget")


@query("select bool_and(doc_id % 11 <> 0 and doc_id % 3 <> 0) as complete from documents")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("note_id"))
    return I.complete(docs, _manifest(spark, d).withColumn("generation", F.lit(1)), 1, "m")


@query("""
with old as (select text as body, arg_max(conv_id * 1000 + turn, conv_id * 1000 + turn) as vector from conversations where conv_id % 2 = 0 group by text)
select conv_id, turn, coalesce(vector, -1) as vector, vector is not null as reused from conversations left join old on body = text""")
def reuse_vectors_by_body(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("body"))
    old = rows.where("conv_id % 2 = 0").withColumn("vector", F.col("conv_id") * 1000 + F.col("turn")).withColumn("at", F.col("vector"))
    kept, missing = reuse_vectors(rows, old, "body", "vector", "at")
    return kept.select("conv_id", "turn", "vector", F.lit(True).alias("reused")).unionByName(missing.select("conv_id", "turn", F.lit(-1).cast("long").alias("vector"), F.lit(False).alias("reused")))


_GAP = 6 * 3600


_BURSTS = f"""
with marked as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts) <= interval '{_GAP} seconds' then 0 else 1 end as fresh from events),
numbered as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from marked)
select user_id, count(*) as changes, arg_max(event_id, ts) as event_id, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from numbered group by user_id, s"""


def _burst_rows(found: DataFrame) -> DataFrame:
    return found.select("user_id", "changes", "event_id", F.unix_micros("first_change").alias("first_us"), F.unix_micros("last_change").alias("last_us"))


@query(_BURSTS)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _burst_rows(C.debounce_sessions(events, "user_id", "ts", _GAP, "event_id"))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return C.last_write_wins(_t(spark, d, "events"), "user_id", "event_id", ["event_type", "value"])


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id having arg_max(event_type, event_id) <> 'error'")
def latest_revision_tombstones(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    return C.live_rows(rows, "user_id", "event_id", F.col("event_type") == "error")


@query("""
with p as (select doc_id, doc_id % 7 as k from documents)
select case k when 0 then 'twice-' when 2 then 'once-' when 3 then 'doc-' when 4 then 'doc-' when 6 then 'swapped-' else 'doc-' end || doc_id || '.md' as path,
  case when k = 4 then -doc_id else doc_id end as note_id from p where k <> 1
union all select 'new-' || doc_id || '.md', -doc_id from p where k = 3""")
def path_changes(spark: SparkSession, d: str) -> DataFrame:
    """Paths after renames of renames, deletions of renamed notes, edits, new notes, notes replaced and names exchanged."""
    docs = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 7).alias("k"))
    name = lambda prefix: F.concat(F.lit(f"{prefix}-"), F.col("doc_id").cast("string"), F.lit(".md"))
    steps = {
        0: [("rename", "once", "doc"), ("rename", "twice", "once")],
        1: [("rename", "once", "doc"), ("delete", "once", "")],
        2: [("rename", "once", "doc"), ("modify", "once", "")],
        3: [("create", "new", ""), ("modify", "new", "")],
        4: [("delete", "doc", ""), ("create", "doc", "")],
        6: [("rename", "x", "doc"), ("rename", "swapped", "x"), ("create", "x", ""), ("delete", "x", "")],
    }
    changes = None
    for k, some in steps.items():
        for revision, (op, path, old) in enumerate(some):
            one = docs.where(F.col("k") == k).select(name(path).alias("path"), F.lit(op).alias("op"), (name(old) if old else F.lit(None).cast("string")).alias("old_path"), F.lit(revision).alias("revision"), (-F.col("doc_id")).alias("note_id"))
            changes = one if changes is None else changes.unionByName(one)
    return C.apply_changes(docs.select(name("doc").alias("path"), F.col("doc_id").alias("note_id")), changes)


@query("select e.event_id, e.user_id from events e where e.event_id >= (select max(event_id) - 500 from events s where s.user_id = e.user_id)")
def fenced_work(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").select("event_id", "user_id")
    done = events.withColumn("revision", F.col("event_id") + 500)
    return C.fenced(done, events.withColumnRenamed("event_id", "revision"), "user_id", "revision").select("event_id", "user_id")


@query(f"select count(*) as waiting, epoch_us(min(due)) as deadline_us from (select max(ts) + interval '{_GAP} seconds' as due from events group by user_id)")
def next_deadline(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    due = events.groupBy("user_id").agg((F.max("ts") + F.expr(f"interval {_GAP} seconds")).alias("due"))
    return C.next_deadline(due, "due").select("waiting", F.unix_micros("deadline").alias("deadline_us"))


@query("select event_id, user_id from events where event_id > (select coalesce(max(event_id), -1) from events where user_id = 3)")
def invalidated_work(spark: SparkSession, d: str) -> DataFrame:
    """Work begun after everything was invalidated, here by each event of one user."""
    events = _t(spark, d, "events").select("event_id", "user_id")
    return C.after_invalidation(events, events.where("user_id = 3"), "event_id")


@query("""
with paths as (select doc_id, source || '/' || doc_id || '.md' as path from documents),
judged as (
  select path, case when starts_with(path, 'src2/') then 'Excluded by folder exclusion src2'
                    when starts_with(path, 'src3/') and doc_id::varchar not like '1%' then 'Excluded by src3/.gitignore (*.md)' end as reason from paths)
select path, reason is null as admitted, false as deferred, reason from judged""")
def policy_change(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes under a changed policy: one folder is let in, one is shut out, and one's ignore file changes. Only these three are judged again."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    notes = _t(spark, d, "documents").select(path, F.lit(True).alias("metadata_ready"), F.lit(None).cast("boolean").alias("ai_index"), F.array().cast("array<string>").alias("tags"))
    control = lambda *lines: (IgnoreFile("src3", "src3/.gitignore", lines),)
    before, after = PathPolicy(("src1",), controls=control("1*.md")), PathPolicy(("src2",), controls=control("*.md", "!1*.md"))
    return readmit(admission(notes, before), before, after).select("path", "admitted", "deferred", "reason")


_FILED = """
before as (select source || '/' || doc_id || '.md' as path, sha256(coalesce(text, '')) as was from documents),
poor as (select distinct doc_id from labels where quality = 0),
toxic as (select distinct doc_id from labels where toxic = 1),
after as (
  select coalesce(lang, 'und') || '/' || doc_id || '.md' as path, sha256(coalesce(text, '')) as now from documents anti join poor using (doc_id) anti join toxic using (doc_id)
  union all select source || '/' || doc_id || '.md', sha256(coalesce(text, '') || '#') from documents semi join toxic using (doc_id) anti join poor using (doc_id)
  union all select 'chats/' || conv_id || '.md', sha256(min_by(text, turn)) from conversations group by conv_id),
differ as (select path, was, now from before full join after using (path) where was is distinct from now),
numbered as (
  select *, row_number() over (partition by digest, side order by left(md5(name), 3), left(md5(path), 1), md5(name), path) as place
  from (select path, was as digest, 'left' as side, split_part(path, '/', -1) as name from differ where was is not null
        union all select path, now, 'came', split_part(path, '/', -1) from differ where now is not null)),
pairs as (select a.path as old_path, b.path from numbered a join numbered b on a.digest = b.digest and a.place = b.place and a.side = 'left' and b.side = 'came'),
told as (select d.*, came.old_path, gone.path as new_path from differ d left join pairs came on came.path = d.path left join pairs gone on gone.old_path = d.path)"""


@query(f"""
with {_FILED}
select path, 'rename' as op, old_path, 2::bigint as revision, now as digest from told where old_path is not null and was is null
union all select '.held/' || path, 'rename', old_path, 2, now from told where old_path is not null and was is not null
union all select path, 'rename', '.held/' || path, 3, now from told where old_path is not null and was is not null
union all select path, 'create', null, 3, now from told where old_path is null and now is not null and (was is null or new_path is not null)
union all select path, 'modify', null, 2, now from told where old_path is null and now is not null and was is not null and new_path is null
union all select path, 'delete', null, 2, null from told where now is null and new_path is null""")
def listing_changes(spark: SparkSession, d: str) -> DataFrame:
    """What happens to the documents' files when they are filed by language and not by source: those of quality 0 go, toxic ones are edited where they are, and conversations come as new files."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    at = lambda folder, key: F.concat(folder, F.lit("/"), F.col(key).cast("string"), F.lit(".md")).alias("path")
    digest = lambda text: F.sha2(text, 256).alias("digest")
    text, poor, toxic = F.coalesce("text", F.lit("")), labels.where("quality = 0").select("doc_id"), labels.where("toxic = 1").select("doc_id")
    kept = docs.join(poor, "doc_id", "left_anti")
    moved = kept.join(toxic, "doc_id", "left_anti").select(at(F.coalesce("lang", F.lit("und")), "doc_id"), digest(text))
    edited = kept.join(toxic, "doc_id", "left_semi").select(at(F.col("source"), "doc_id"), digest(F.concat(text, F.lit("#"))))
    chats = _t(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select(at(F.lit("chats"), "conv_id"), digest(F.col("text")))
    before = docs.select(at(F.col("source"), "doc_id"), digest(text))
    return L.listing_changes(before, moved.unionByName(edited).unionByName(chats), 1).drop("note_id")


@query("""
with c as (select conv_id, count(*) as passages from conversations where conv_id is not null group by conv_id)
select g::int as generation, conv_id::varchar as note_id, passages from c, (values (1), (2)) t(g) where passages <= 4""")
def buried_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as notes of two generations, after those of more than four turns were buried and removed from both, with their passages."""
    turns = _t(spark, d, "conversations").where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    passages = turns.select(F.col("conv_id").cast("string").alias("note_id"), F.lit("s").alias("snapshot_id"), place.alias("passage_index"), F.coalesce("text", F.lit("")).alias("body"))
    counted = passages.groupBy("note_id").agg(F.count("*").alias("turns"))
    store = S.SnapshotStore(spark, f"{shared_folder(spark)}/noteloom-store-{uuid.uuid4().hex}")
    for generation in (1, 2):
        store.publish(generation, counted.select("note_id", F.lit("s").alias("snapshot_id")), passages)
    stones = Tombstones(store)
    stones.bury(counted.where("turns > 4"))
    stones.settle()
    held = lambda g: store.read("notes", g).join(store.read("passages", g), "note_id").groupBy("note_id").agg(F.count("*").alias("passages")).select(F.lit(g).alias("generation"), "note_id", "passages")
    return held(1).unionByName(held(2))


@query("""
with e as (select vec_id::varchar as note_id, label, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as size from embeddings),
judged as (select note_id, label, coalesce(label = 3 and abs(size - 1) > 1e-4, false) as off from e)
select note_id, case when off then 'vector' else '' end as faults, not off and label <> 5 as served from judged""")
def quarantined_notes(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as notes of one passage each, some with vectors of any length and some whose passage has no body: which are served and which are in quarantine, with the note's own faults."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("note_id"), F.lit("s").alias("snapshot_id"), "label", V.doubles(F.col("embedding")).alias("raw"))
    dims = e.select(F.size("raw")).first()
    unit = F.transform("raw", lambda x: F.try_divide(x, F.col("size")))
    notes = e.withColumn("size", V.norm(F.col("raw"))).select("note_id", "snapshot_id", F.when(F.col("label") == 3, F.col("raw")).otherwise(unit).alias("vector"))
    none = F.lit(0)
    passages = e.select(
        "note_id", "snapshot_id", none.alias("passage_index"), F.when(F.col("label") != 5, F.lit("text")).alias("body"), none.alias("start"), F.lit(4).alias("end"), none.alias("start_line"), none.alias("end_line"),
        F.lit(None).cast("int").alias("start_token"), F.lit(None).cast("int").alias("end_token"),
    )
    store = S.SnapshotStore(spark, f"{shared_folder(spark)}/noteloom-store-{uuid.uuid4().hex}")
    store.publish(1, notes, passages, dims=dims[0] if dims else 0)
    served, aside = store.read("notes", 1), store.quarantined("notes", 1)
    rows = served.select("note_id", F.lit("").alias("faults"), F.lit(True).alias("served"))
    return rows if aside is None else rows.unionByName(aside.select("note_id", F.array_join("faults", ",").alias("faults"), F.lit(False).alias("served")))


# --- Chunking and embedding: pure functions over whole notes, beyond SQL.


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"], F.lit("\n\n"))), "")
    return turns.select("conv_id", F.concat(F.lit("# conv-"), F.col("conv_id").cast("string"), F.lit("\n\n"), body).alias("text"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder()
    return chunk_notes(_t(spark, d, "documents"), "doc_id", "text", e.context_limit, e.count, whole=True)


@query("""
select doc_id::varchar as note_id, true as contiguous, true as complete, true as lines from documents""")
def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder()
    docs = _t(spark, d, "documents")
    return covered(chunk_notes(docs, "doc_id", "text", e.context_limit, e.count, whole=True), docs, "doc_id", "text", most=None).drop("spans")


@query()
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder(context_limit=512)
    return chunk_notes(_markdown(spark, d), "conv_id", "text", e.context_limit, e.count).select("note_id", "passage_index", "heading", "start", "end", "start_line", "end_line")


@query()
def late_chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder(dims=16)
    notes = _markdown(spark, d)
    passages = chunk_notes(notes, "conv_id", "text", e.context_limit, e.count, e.encode, late=True)
    return embed_late(notes, passages, "conv_id", "text", e)


@query()
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user's events from a stream that reads all there is and stops: those it closed, and those left open in its state."""
    base = f"{shared_folder(spark)}/noteloom-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    bursts = C.debounce_sessions(events, "user_id", "ts", _GAP, "event_id")
    job = bursts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    job.awaitTermination()
    closed = spark.read.schema(bursts.schema).parquet(f"{base}/out")
    return closed.unionByName(C.open_bursts(spark, f"{base}/state", "user_id", "event_id"))


@query(_BURSTS)
def stream_bursts(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``stream_debounce`` with times in microseconds, as SQL gives them."""
    return _burst_rows(stream_debounce(spark, d))


@query("select user_id, max(event_id) as event_id, arg_max(ts::varchar, event_id) as at from events group by user_id")
def stream_held(spark: SparkSession, d: str) -> DataFrame:
    """The change that a debounce by the clock holds for each user when its stream has read all there is: nothing is due before the gap."""
    base = f"{shared_folder(spark)}/noteloom-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "event_id", F.col("ts").cast("string").alias("at"))
    out = C.debounce_arrivals(events, "user_id", "event_id", "at", 24 * 3600)
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(once=True).start().awaitTermination()
    return C.held_arrivals(spark, f"{base}/state", "user_id", "event_id", "at")


@query("""
select conv_id::varchar as note_id, (sum(length(text) + length(role) + 7) + length('# conv-' || conv_id) + 2)::bigint as chars, count(*) + 1 as headings from conversations group by conv_id""")
def heading_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Length and headings of the chunked Markdown: the chunks cover every character, and headings nest."""
    e = HashingEmbedder(context_limit=100_000)
    chunks = chunk_notes(_markdown(spark, d), "conv_id", "text", e.context_limit, e.count)
    own = F.regexp_count("body", F.lit(r"(?m)^#{1,2} \S"))
    return chunks.groupBy("note_id").agg(F.sum(F.length("body")).alias("chars"), F.sum(own).alias("headings"))
