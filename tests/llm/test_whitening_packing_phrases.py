"""Whitening, packing and phrases against plain versions in numpy and Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm.byte_bpe import Encoder, groups
from noteloom.llm.packing import combinations, least_squares, pack_documents, plan
from noteloom.llm.phrases import mine_phrases
from noteloom.llm.queries import QUERIES, tokenizer_path
from noteloom.llm.whitening import whiten

BPE = "byte_bpe_50k.json"


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


# --- whitening


def plain_whitening(vectors: list[list[float]], k: int):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n = len(x)
    dev = n * x - x.sum(axis=0)
    c = dev / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (dev.astype(object) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(v)


def hold_whitening(rows, ids, vectors, k=8):
    deviation, whitened, explained = plain_whitening(vectors, k)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(vectors) * len(explained)
    got = np.array([[by[i, j + 1]["whitened"] for j in range(len(explained))] for i in ids])
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert [by[i, 1]["deviation"] for i in ids] == list(deviation)
    assert np.allclose([by[ids[0], j + 1]["explained"] for j in range(len(explained))], explained, rtol=1e-9)
    assert {r["n"] for r in rows} == {len(vectors)} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_of_the_tables_equals_a_plain_version(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    hold_whitening(QUERIES["op11_svd_whitening"](spark, sf_dir).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_whitening_drops_unusable_vectors_and_reads_no_other_column(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(30, 4)) * [4, 3, 2, 1]
    rows = [(i, v.tolist(), 1, 2.0) for i, v in enumerate(good)]
    bad = [(90, None, 1, 1.0), (91, [], 1, 1.0), (92, [1.0, None, 2.0, 3.0], 1, 1.0), (93, [1.0, float("nan"), 2.0, 3.0], 1, 1.0), (94, [1.0, float("-inf"), 2.0, 3.0], 1, 1.0), (95, [1.0] * 5, 1, 1.0)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, component int, whitened double")
    hold_whitening(whiten(df).collect(), list(range(30)), good.tolist())


def test_whitening_keeps_repeats_and_null_ids_and_ends_where_the_rank_ends(spark):
    rng = np.random.default_rng(6)
    flat = [[a, 2 * a, b, a + b] for a, b in rng.integers(-9, 9, size=(20, 2)).tolist()]
    df = spark.createDataFrame([(None if i % 2 else 7, [float(c) for c in v]) for i, v in enumerate(flat)], "vec_id long, embedding array<float>")
    rows = whiten(df.union(df)).collect()
    assert len(rows) == 2 * 20 * 2 and {r["component"] for r in rows} == {1, 2} and {r["n"] for r in rows} == {40}
    assert sum(r["vec_id"] is None for r in rows) == 40 and abs(sum({r["component"]: r["explained"] for r in rows}.values()) - 1) < 1e-9


def test_whitening_of_nothing_or_of_equal_vectors_is_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], schema)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# --- packing


def hold_packing(rows, docs: list[tuple], window: int, end_id: int = 0):
    """Every token of every document in exactly one piece, and sequences without gaps; gives the lengths of the sequences."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BPE))
    wanted = Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, end_id], "<u4").tobytes()) for i, t in docs)
    # Documents may share an id: pieces of one have one start after the other and one length of the document.
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, of in pieces.items():
        whole = {}
        for r in of:
            assert r["length"] * 4 == len(r["ids"])
            whole.setdefault((r["doc_tokens"], r["start"]), []).append(bytes(r["ids"]))
        if len([d for d in docs if d[0] == i]) == 1:
            text = b"".join(ids for (_, _), (ids,) in sorted(whole.items()))
            assert wanted[i, text] == 1
    assert sum(r["length"] for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in wanted.items())
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for of in places.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    assert sorted(places) == list(range(len(places)))
    return Counter(sum(n for _, n in of) for of in places.values())


@pytest.mark.parametrize("window", [64, 1024])
def test_packing_of_the_tables_places_every_token_once(spark, sf_dir, window):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = pack_documents(docs, tokenizer_path(BPE), window=window).collect()
    lengths = hold_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], window)
    assert sum(n for size, n in lengths.items() if size < window) <= 10


def test_packing_digests_are_those_of_the_pieces(spark, sf_dir):
    tokenizer, docs = tokenizer_path(BPE), spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in pack_documents(docs, tokenizer).collect()}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in QUERIES["op12_nnls_packing"](spark, sf_dir).collect()} == whole


def test_packing_takes_nulls_empty_and_repeated_rows_and_clashing_columns(spark):
    docs = [(1, "a b c"), (1, "a b c"), (None, "word " * 3000), (2, None), (3, ""), (4, "<|endoftext|> x"), (5, "é 　 b")]
    df = spark.createDataFrame([(*d, 9, "x") for d in docs], "doc_id long, text string, part int, ids string")
    hold_packing(pack_documents(df, tokenizer_path(BPE), window=16).collect(), docs, 16)
    assert pack_documents(df.where("false"), tokenizer_path(BPE)).count() == 0


def test_least_squares_finds_exact_combinations():
    """Tails that were made of whole sequences come out as whole sequences, nearly none cut."""
    rng = np.random.default_rng(2)
    cuts = np.sort(rng.integers(1, 64, size=(500, 2)), axis=1)
    parts = np.concatenate([cuts[:, 0], cuts[:, 1] - cuts[:, 0], 64 - cuts[:, 1]])
    histogram = np.bincount(parts[(parts > 0) & (parts < 64)], minlength=64) * 100
    combos = combinations(64, np.flatnonzero(histogram))
    assert (combos.sum(axis=1) == 64).all() and len(np.unique(combos, axis=0)) == len(combos)
    x = least_squares(combos, np.append(histogram, 0).astype(float))
    used = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=65)[1:64]
    assert (x >= 0).all() and np.abs(used - histogram[1:]).sum() < 0.002 * histogram.sum()
    p = plan(histogram)
    assert p.count[p.start > 0].sum() < 0.002 * histogram.sum()


@pytest.mark.parametrize("shape", ["one length", "few", "all", "single", "none"])
def test_plan_places_each_tail_once(shape):
    rng = np.random.default_rng(3)
    histogram = np.zeros(256, np.int64)
    if shape == "one length":
        histogram[150] = 10_001
    elif shape == "few":
        histogram[[3, 100, 255]] = 7, 1000, 900
    elif shape == "all":
        histogram[1:] = rng.integers(0, 50, 255)
    elif shape == "single":
        histogram[77] = 1
    p = plan(histogram)
    bounds, ends, rows = p.pieces()
    n, sequences = int(histogram.sum()), defaultdict(list)
    lengths = np.repeat(np.arange(256), histogram)
    for tail in range(n):
        run = np.searchsorted(bounds, tail, side="right") - 1
        at = 0
        for row in rows[ends[run - 1] if run else 0 : ends[run]]:
            assert p.start[row] == at
            at += p.length[row]
            sequences[p.sequence[row] + tail - p.of[row]].append((p.offset[row], p.length[row]))
        assert at == lengths[tail]
    assert sorted(sequences) == list(range(p.sequences))
    sizes = Counter()
    for of in sequences.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        sizes[at] += 1
    assert all(size & (size - 1) == 0 for size in sizes) and sum(c for size, c in sizes.items() if size < 256) <= 8


def test_word_memory_gives_the_ids_of_whole_texts():
    import random

    encoder, rng = Encoder(tokenizer_path(BPE), 0), random.Random(3)
    signs = [*"abcXYZ  \t\n\r 　\u0085éß字🙂'.,!?019", "'s", "'ll", "<|endoftext|>", "  ", " \n "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["", "x" * 5000, " a" * 5000]
    for group in groups([t.encode() for t in texts]):
        ids, counts = encoder.encode(group)
        for text, got in zip(group, np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == [*encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids, 0]


# --- phrases


def plain_phrases(docs: list[tuple], support: int, top: int):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = tuple(w for w in re.split("[ \t]", piece) if w)
            totals[lang] += len(words)
            for n in range(1, 6):
                counts[lang].update(words[i : i + n] for i in range(len(words) - n + 1))
    rows = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def got_phrases(df, **more):
    return sorted(map(tuple, mine_phrases(df, **more).collect()))


def test_phrases_equal_a_plain_version_over_blocks_and_tasks(spark, monkeypatch):
    import random

    from noteloom.llm import phrases

    monkeypatch.setattr(phrases, "TASK_POINTERS", 40)  # hot prefixes are cut over tasks
    rng = random.Random(8)
    words = ["a", "b", "B", "c", "ü", "Ü", "\x00", "x\x00y", "\x01", "a\x01", "o'c", " "]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60)))
    docs = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(300)] + [("en", "same line here now again")] * 40 + [("en", None), (None, ""), ("fr", " .,;")]
    df = spark.createDataFrame([(i, *d, 1, "x") for i, d in enumerate(docs)], "doc_id long, lang string, text string, f int, phrase string").repartition(6)
    for support, top in ((3, 1000), (20, 7)):
        assert got_phrases(df, support=support, top=top) == plain_phrases(docs, support, top)


def test_phrases_of_long_pieces_and_no_texts(spark, monkeypatch):
    from noteloom.llm import phrases

    assert got_phrases(spark.createDataFrame([], "lang string, text string")) == []
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    docs = [("en", "go on and on " * 200), ("en", "go on. and on, " * 200), ("en", "z" * 500)]
    batch = spark.createDataFrame(docs, "lang string, text string").select("lang", F.col("text").cast("binary").alias("text")).toArrow().combine_chunks().to_batches()[0]
    assert b"".join(b for _, b in phrases._blocks(batch)) == "\n".join(t for _, t in docs).encode()
    assert all(len(phrases._words(b)) == len(phrases._pieces(b)) for _, b in phrases._blocks(batch))
    assert all(b == phrases_end(b) for _, b in list(phrases._blocks(batch))[:-1])


def phrases_end(block: bytes) -> bytes:
    """The block, if it ends where a piece does."""
    return block if block[-1:] in (b".", b",", b"\n") else b""


def test_phrases_join_no_counts_through_the_driver(spark, capsys):
    """However small the written tables look, only the languages' sizes are broadcast."""
    mine_phrases(spark.createDataFrame([("en", "a b c. " * 40)], "lang string, text string"), support=2).explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastHashJoin") <= 1 and plan.count("SortMergeJoin") >= 3


def test_pointers_are_phrases_with_the_support_and_not_all_runs_of_frequent_pairs(spark, monkeypatch):
    """Random words: all pairs are frequent, hardly any longer phrase is. Twice the texts in twice the files give no more pointers."""
    import random

    from noteloom.llm import phrases

    tables, write = [], phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df: tables.append(write(df)) or tables[-1])
    rng = random.Random(5)
    docs = [("en", " ".join(rng.choices("abcdefghijklmnopqrst", k=300)) + ". so it goes on here") for _ in range(120)]
    made = []
    for times, parts in ((1, 40), (2, 80)):
        tables.clear()
        df = spark.createDataFrame(docs, "lang string, text string")
        for _ in range(times - 1):
            df = df.union(spark.createDataFrame([("en", "so it goes on here")] * 120, "lang string, text string"))
        _, _, frequent = phrases.count_phrases(df.repartition(parts), 25)
        pointers = [t for t in tables if t.columns == ["lang", "phrase", "f"]][-2]
        made.append((pointers.count(), frequent.count()))
    tasks = spark.sparkContext.defaultParallelism
    assert all(rows <= 1.2 * found * tasks for rows, found in made)
    assert made[1][0] <= 1.2 * made[0][0]


def test_hashed_counts_of_longer_phrases_lose_none(spark, monkeypatch):
    """With fewer slots than phrases, and supports of one and two bytes, the map still lets every frequent phrase through."""
    from noteloom.llm import phrases

    monkeypatch.setattr(phrases, "MOST_SLOTS", 64)
    monkeypatch.setattr(phrases, "LEAST_SLOTS", 64)
    docs = [("en", f"a b c d e{i % 9} f. x{i % 5} y{i % 3} z w") for i in range(400)] + [(None, "a b c d. " * 300)] * 2
    df = spark.createDataFrame(docs, "lang string, text string").repartition(9)
    for support in (0, 30, 300):
        assert got_phrases(df, support=support) == plain_phrases(docs, support, 2000)


def test_word_memory_cuts_at_marks_and_line_ends_and_gives_the_ids_of_whole_texts():
    import random

    from tokenizers import Tokenizer

    r, path = random.Random(7), tokenizer_path(BPE)
    library, known = Tokenizer.from_file(path), Encoder(path, 0)
    parts = ["word", " word", "é", "×", "÷", "ß", ".", "...", "###", "'s", "'", "\n", "\n\n", "\r\n", " ", "  ", "\t", " ", "　", "\x00", "7", "´", "́", "日本", "😀", "<|endoftext|>", "Ma", " la", "-"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(5000)]
    ids, counts = known.encode([t.encode() for t in texts])
    wanted = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_marks_at_words_are_no_new_words_of_the_memory():
    """Eight words with five marks each, and lines that begin with them: the memory holds words and marks, not each word with each mark."""
    known = Encoder(tokenizer_path(BPE), 0)
    known.encode([" ".join(f"w{a}x{m}" for a in "abcdefgh" for m in (".", ",", "###", "&&&", ".\nNext")).encode()])
    assert len(known.numbers) <= 16
