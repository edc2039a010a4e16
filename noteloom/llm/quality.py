"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Documents are halved by a hash of their text, and each half's trusted texts train a model: a document is scored by the
model of the other half, which has not seen it, trusted or not. Counts are joined order by order into probabilities.
Documents travel in blocks: a block names its distinct n-grams once, these meet the models' tables in joins that are
sharded by n-gram, and the answers go back to the block, where every position of every whole text is scored. A document
is kept if its score lies between two quantiles of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, in_small_batches, materialize, partitions, release_memory, rows_without, text_key, tidy
from .text_hash import seeds

ORDER = 4
#: Padding before a text, and its end.
BEGIN, END = "\x02", "\x03"
#: Code points of one block; a longer text is a block of its own. Within a block so many are scored at once.
BLOCK_CHARS, STEP_CHARS = 16_000_000, 500_000
#: Parts of the documents, by a hash of their text; a part is scored by the model trained on the others' trusted texts.
FOLDS = 2
#: Weight of the language's mean score, in characters: short texts are judged with care.
PRIOR_CHARS = 200
#: Quantiles of the trusted documents' scores between which a document is kept.
LOW, HIGH = 0.0002, 0.999
#: Weight of all languages' quantiles in those of a language, in documents: a language with few trusted ones leans on all.
PRIOR_DOCS = 200
#: Blocks that a task scores, two numbers for each of their n-grams at a time.
TASK_BLOCKS = 2
#: Up to this many trusted ids (16 bytes each) are broadcast; beyond, documents and ids are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_WEIGHTS = seeds(64, 5000) | np.uint64(1)


def _codes(texts: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray]:
    """Padded texts in one string, their code points, and for each n-gram window whether it predicts a character of a text."""
    joined = "".join([BEGIN * (order - 1) + t + END for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) + order for t in texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    real = np.ones(max(len(code) - order + 1, 0), bool)
    for j in range(1, order):  # a window that ends in the next text's padding predicts nothing
        cut = start[1:] - j
        real[cut[cut < len(real)]] = False
    return joined, code, real


def _keys(code: np.ndarray, order: int) -> np.ndarray:
    n = max(len(code) - order + 1, 0)
    key = np.zeros(n, np.uint64)
    for j in range(order):
        key += code[j : j + n].astype(np.uint64) * _WEIGHTS[j]
    return key


def _steps(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about STEP_CHARS, with the place of the first."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP_CHARS:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def gram_counts(texts: list[str], order: int) -> dict[str, int]:
    """Occurrences of every n-gram of the padded texts."""
    counts: dict[str, int] = {}
    for _, some in _steps(texts):
        joined, code, real = _codes(some, order)
        at = np.flatnonzero(real)
        group, _ = pd.factorize(_keys(code, order)[at])
        first = np.zeros(group.max(initial=-1) + 1, np.int64)
        first[group[::-1]] = at[::-1]
        for p, n in zip(first.tolist(), np.bincount(group, minlength=len(first)).tolist()):
            g = joined[p : p + order]
            counts[g] = counts.get(g, 0) + n
    return counts


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[int, pa.Table, list[str]]]:
    """Consecutive rows in blocks of about BLOCK_CHARS, numbered by partition and place: the same on every pass over a scan."""
    from pyspark import TaskContext

    part, k, held, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        at = 0
        for i, value in enumerate(batch.column(text_at)):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                held.append(batch.slice(at, i + 1 - at))
                yield (part << 24) + k, pa.Table.from_batches(held), texts
                at, k, held, texts, size = i + 1, k + 1, [], [], 0
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if texts:
        yield (part << 24) + k, pa.Table.from_batches(held), texts


MODELS = range(FOLDS)
#: Columns of all models, by number.
_each = lambda make: [make(m) for m in MODELS]


def train_counts(texts: DataFrame, order: int) -> DataFrame:
    """(gram, c0, c1, ...): counts of each model over all texts of ``fold``, which trains every model but its own; counted block by block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, some in _blocks(batches, 1):
            folds = rows.column(0).to_pylist()
            for fold in sorted(set(folds)):
                counts = gram_counts([t for t, f in zip(some, folds) if f == fold], order)
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["fold", "gram", "c"])
        release_memory()

    counted = in_small_batches(texts.select("fold", "text")).mapInArrow(run, "fold int, gram string, c long")
    return counted.groupBy("gram").agg(*_each(lambda m: F.sum(F.when(F.col("fold") != m, F.col("c")).otherwise(0)).alias(f"c{m}")))


@dataclass
class Models:
    """Tables by order, with a column for each model: ``grams[k]`` has (gram, p0, ...), ``backoff[k]`` has (context, gamma0, ...) for contexts of k-1 characters; null where a model has not seen it. ``unseen`` is the chance of a character that a model has not seen."""

    order: int
    grams: dict[int, DataFrame]
    backoff: dict[int, DataFrame]
    unseen: list[float]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1, d2, d3 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(min(max(d, 0.05), top) for d, top in zip((d1, d2, d3), (0.95, 1.95, 2.95)))


def fit(texts: DataFrame, order: int = ORDER) -> Models:
    """Interpolated modified Kneser-Ney models of (fold, text); lower orders count the distinct characters to the left of a gram."""
    counts = {order: materialize(train_counts(texts, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = materialize(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*_each(lambda m: F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}"))))
    lower, unseen = None, [1.0] * FOLDS
    grams, backoff = {}, {}
    for k in range(1, order + 1):
        seen = counts[k].agg(*[F.count_if(F.col(f"c{m}") == i).alias(f"n{m}{i}") for m in MODELS for i in (1, 2, 3, 4)], *_each(lambda m: F.count_if(F.col(f"c{m}") > 0).alias(f"types{m}"))).first()
        table = counts[k].withColumn("context", F.substring("gram", 1, k - 1))
        for m in MODELS:
            c, (d1, d2, d3) = F.col(f"c{m}"), discounts([seen[f"n{m}{i}"] for i in (1, 2, 3, 4)])
            table = table.withColumn(f"d{m}", F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3))
        total = lambda m: F.nullif(F.sum(f"c{m}"), F.lit(0))
        sums = table.groupBy("context").agg(*_each(lambda m: total(m).alias(f"total{m}")), *_each(lambda m: (F.sum(f"d{m}") / total(m)).alias(f"gamma{m}")))
        known = lambda m, p: F.when(F.col(f"c{m}") > 0, p).alias(f"p{m}")
        alpha = lambda m: (F.col(f"c{m}") - F.col(f"d{m}")) / F.col(f"total{m}")
        if k == 1:
            row = sums.first()
            unseen = _each(lambda m: row[f"gamma{m}"] / (seen[f"types{m}"] + 1) if row and row[f"total{m}"] else 1.0)
            grams[1] = materialize(table.crossJoin(F.broadcast(sums.drop("context"))).select("gram", *_each(lambda m: known(m, alpha(m) + unseen[m]))))
        else:
            backoff[k] = materialize(sums)
            joined = table.join(backoff[k], "context").withColumn("suffix", F.substring("gram", 2, k - 1))
            below = lower.select(F.col("gram").alias("suffix"), *_each(lambda m: F.col(f"p{m}").alias(f"below{m}")))
            grams[k] = materialize(joined.join(below, "suffix").select("gram", *_each(lambda m: known(m, alpha(m) + F.col(f"gamma{m}") * F.col(f"below{m}")))))
        lower = grams[k]
    drop_materialized(*counts.values())
    return Models(order, grams, {k: b.select("context", *_each(lambda m: f"gamma{m}")) for k, b in backoff.items()}, unseen)


def resolve(grams: DataFrame, models: Models) -> DataFrame:
    """(gram, logp0, ...) for any grams of the models' order: the highest order that has seen the end of the gram, with the back-off weights above it. A model without any text gives every character a chance of 1."""
    order = models.order
    open_ = grams.select("gram", *_each(lambda m: F.lit(1.0).alias(f"w{m}")), *_each(lambda m: F.lit(None).cast("double").alias(f"q{m}")))
    for k in range(order, 0, -1):
        end = F.substring("gram", order - k + 1, k)
        found = open_.withColumn("_end", end).join(models.grams[k].withColumnRenamed("gram", "_end"), "_end", "left")
        if k > 1:
            found = found.withColumn("_c", F.substring("gram", order - k + 1, k - 1)).join(models.backoff[k].withColumnRenamed("context", "_c"), "_c", "left")
        weight = lambda m: F.col(f"w{m}") * F.coalesce(f"gamma{m}", F.lit(1.0)) if k > 1 else F.col(f"w{m}")  # noqa: B023, E731
        open_ = found.select("gram", *_each(lambda m: weight(m).alias(f"w{m}")), *_each(lambda m: F.coalesce(f"q{m}", F.col(f"w{m}") * F.col(f"p{m}")).alias(f"q{m}")))
    return open_.select("gram", *_each(lambda m: F.ln(F.coalesce(f"q{m}", F.col(f"w{m}") * models.unseen[m])).alias(f"logp{m}")))


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Adds n_scored (characters and the end) and logp (their log probability under the model of the row's ``fold``) to the columns of ``docs`` other than text.

    ``docs`` must be read alike each time (a scan or a written table): it is read once for the n-grams of each block and
    once to score it, in the same partitions. Each distinct n-gram is looked up once; its answer goes to every block
    that asked, by (block, gram), so the commonest gather in no single task.
    """
    order, at, fold_at = models.order, docs.schema.names.index("text"), docs.schema.names.index("fold")
    rest = [c for c in docs.schema.names if c != "text"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches, at):
            grams = list(gram_counts(texts, order))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(grams), pa.int64()), pa.array(grams, pa.string())], ["block", "gram"])
        release_memory()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, _ in _blocks(batches, at):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])
        release_memory()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                answers = batch.column(1)[i].values
                known = answers.field("gram").to_pylist()
                known_key = _keys(np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32), order)[::order] if known else np.zeros(0, np.uint64)
                sort = np.argsort(known_key)
                known_key, value = known_key[sort], np.stack([np.asarray(answers.field(f"logp{m}"))[sort] for m in MODELS])
                rows = pa.ipc.open_stream(batch.column(0)[i].as_buffer()).read_all()
                texts, fold = [t or "" for t in rows.column("text").to_pylist()], np.array(rows.column(fold_at).to_pylist(), np.int64)
                total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for start, some in _steps(texts):
                    _, code, real = _codes(some, order)
                    pos = np.flatnonzero(real)
                    group, keys = pd.factorize(_keys(code, order)[pos])
                    place = np.minimum(np.searchsorted(known_key, keys), max(len(known_key) - 1, 0))
                    if not (known_key[place] == keys).all():
                        raise RuntimeError("a block has an n-gram that its first pass did not name")
                    size = np.fromiter((len(t) + order for t in some), np.int64, len(some))
                    owner = np.searchsorted(np.cumsum(size), pos, side="right")
                    total[start : start + len(some)] = np.bincount(owner, value[fold[start + owner], place[group]], len(some))
                    count[start : start + len(some)] = np.bincount(owner, minlength=len(some))
                out = rows.drop_columns(["text"]).append_column("n_scored", pa.array(count)).append_column("logp", pa.array(total))
                yield from out.combine_chunks().to_batches()
        release_memory()

    asked = materialize(in_small_batches(docs).mapInArrow(named, "block long, gram string"))
    answers = resolve(asked.select("gram").distinct(), models)
    # Few blocks to a task, so that a task's share does not grow with the table.
    tasks = max(partitions(docs), -(-asked.select("block").distinct().count() // TASK_BLOCKS))
    replies = asked.join(answers, "gram").repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("gram", *_each(lambda m: f"logp{m}"))).alias("answers"))
    joined = docs.mapInArrow(packed, "block long, payload binary").repartition(tasks, "block").join(replies, "block").select("payload", "answers")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return joined.mapInArrow(scored, f"{kinds}, n_scored long, logp double")


def _scored(docs: DataFrame, labels: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Rows of (doc_id, lang, h1, h2, n_chars, loss, offset), and the bounds of each language: (lang, low, high) and a row of all."""
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok")).where("ok").select("doc_id", F.lit(True).alias("trusted"))
    h1, h2 = text_key(F.col("text"))
    base = docs.select("doc_id", "lang", h1.alias("h1"), h2.alias("h2"), F.coalesce("text", F.lit("")).alias("text"))
    few = labels.count() <= BROADCAST_IDS
    base = base.join(F.broadcast(trusted) if few else trusted, "doc_id", "left")
    fold = F.pmod(F.col("h1"), F.lit(FOLDS)).cast("int")
    base = base.select("doc_id", "lang", "h1", "h2", F.length("text").cast("long").alias("n_chars"), F.coalesce("trusted", F.lit(False)).alias("trusted"), fold.alias("fold"), "text")
    if not few or not _plain_scan(docs):  # a shuffle may order rows anew on a second pass
        base = materialize(base)
    scored = materialize(score(base, fit(base.where("trusted").select("fold", "text"), order)))

    loss = F.coalesce(-F.col("logp") / F.greatest("n_scored", F.lit(1)), F.lit(0.0))
    scored = scored.withColumn("loss", loss)
    held = scored.where("trusted and n_chars > 0")
    means = materialize(held.groupBy("lang").agg(F.avg("loss").alias("mean")))
    overall = held.agg(F.avg("loss").alias("all_mean"))
    # Languages are as many as the column holds, so they are joined as a table.
    centred = scored.alias("s").join(means.alias("m"), F.expr("s.lang <=> m.lang"), "left").crossJoin(F.broadcast(overall)).withColumn("centre", F.coalesce("m.mean", "all_mean"))
    offset = (F.col("n_scored") * F.col("loss") + PRIOR_CHARS * F.col("centre")) / (F.col("n_scored") + PRIOR_CHARS) - F.col("centre")
    rows = materialize(centred.select("s.doc_id", "s.lang", "h1", "h2", "n_chars", "trusted", "loss", offset.alias("offset")))
    quantiles = F.percentile_approx("offset", [LOW, HIGH], 100_000)
    known = rows.where("trusted and n_chars > 0")
    every = known.agg(quantiles.alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    own = known.groupBy("lang").agg(F.count("*").alias("n"), quantiles.alias("q"))
    blend = lambda i, name: ((F.col("n") * F.col("q")[i] + PRIOR_DOCS * F.col(name)) / (F.col("n") + PRIOR_DOCS)).alias(name)
    return rows, materialize(own.crossJoin(F.broadcast(every)).select("lang", blend(0, "low"), blend(1, "high")).withColumn("any", F.lit(False)).unionByName(every.select(F.lit(None).cast("string").alias("lang"), "low", "high", F.lit(True).alias("any"))))


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the frame is a scan of files with row-wise steps at most, which Spark reads alike each time."""
    kinds = docs._jdf.queryExecution().optimizedPlan().toString()
    return all(line.strip("+-:* ").startswith(("Project", "Filter", "Relation")) for line in kinds.splitlines())


def _verdicts(docs: DataFrame, labels: DataFrame, order: int) -> DataFrame:
    rows, bounds = _scored(docs, labels, order)
    every = F.broadcast(bounds.where("any").select(F.col("low").alias("all_low"), F.col("high").alias("all_high")))
    judged = rows.alias("r").join(bounds.where("not any").alias("b"), F.expr("r.lang <=> b.lang"), "left").crossJoin(every)
    within = F.col("offset").between(F.coalesce("b.low", "all_low"), F.coalesce("b.high", "all_high"))
    return judged.select("r.doc_id", "r.lang", "h1", "h2", "n_chars", F.exp("loss").alias("perplexity"), F.coalesce((F.col("n_chars") == 0) | within, F.lit(True)).alias("keep"))


@tidy
def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang, n_chars, perplexity (per character), keep.

    Trusted documents are those whose labels are all quality 1 and toxic 0. A document is kept if its mean loss, leaning
    on its language's mean with the weight of ``PRIOR_CHARS`` characters, is between the ``LOW`` and the ``HIGH``
    quantile of its language's trusted documents; those lean on the quantiles of all languages with the weight of
    ``PRIOR_DOCS`` documents, and a language without trusted documents takes those of all. A null text counts as empty,
    and an empty text, which has nothing to judge, is kept; a null language is one of its own. Without any trusted text
    every row is kept. Repeated rows give a row each; null ids stay null and are never trusted; other columns are not
    read. A very long text is a block of its own and is scored in whole.
    """
    return _verdicts(docs, labels, order).drop("h1", "h2")


@tidy
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that the classifier keeps.

    Rows are told apart by id, language and text: junk under a good row's id, or without an id, goes, and the good row
    stays. Rows alike in all three share a verdict. Null and empty texts stay, and an empty table gives no rows.
    """
    bad = materialize(_verdicts(docs, labels, ORDER).where("not keep").select("doc_id", "lang", "h1", "h2").distinct())
    h1, h2 = text_key(F.col("d.text"))
    return rows_without(docs, bad, {"doc_id": F.col("d.doc_id"), "lang": F.col("d.lang"), "h1": h1, "h2": h2})
