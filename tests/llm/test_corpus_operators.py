import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm import common, components, decontaminate, near_dedup, quality, text_hash
from noteloom.llm.common import text_key

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, keep int"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, text, share):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def frame(spark, texts, langs=None):
    """Documents with columns that clash with names the operators add."""
    return spark.createDataFrame([(i, t, langs[k] if langs else "en", "s", len(t or ""), "g", 1) for k, (i, t) in enumerate(texts)], DOCS)


# --- Hashes, alignment, components


def test_word_hashes_depend_on_the_word_alone():
    a, b = text_hash.word_hashes("x yy zzz é yy".split()), text_hash.word_hashes("yy é".split())
    assert a[1] == a[4] == b[0] and a[3] == b[1] and len(set(a.tolist())) == 4
    assert text_hash.run_hashes(a, 5).size == 1 and text_hash.run_hashes(b, 5).size == 0
    assert len(set(text_hash.word_hashes([str(i) for i in range(200_000)]).tolist())) == 200_000


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_table():
    r = random.Random(3)
    for _ in range(3000):
        a = [r.choice("abc") for _ in range(r.randint(0, 14))]
        b = [r.choice("abc") for _ in range(r.randint(0, 14))] if r.random() < 0.5 else [c for c in a if r.random() < 0.85]
        most = r.randint(0, 15)
        assert near_dedup.banded_distance(a, b, most) == min(distance(a, b), most + 1)
        longer = max(len(a), len(b))
        assert near_dedup.near(a, b) == (distance(a, b) <= int(0.2 * longer + 1e-9))


def test_order_counts_in_the_sketch():
    r = random.Random(1)
    a = prose(r, 300)
    same = (near_dedup.order_minhash(a) == near_dedup.order_minhash(edited(r, a, 0.02))).mean()
    swapped = " ".join(a.split()[150:] + a.split()[:150])
    assert same > 0.4 and 0.3 < (near_dedup.order_minhash(a) == near_dedup.order_minhash(swapped)).mean() < 0.75
    assert near_dedup.order_minhash("  \n") is None and len(near_dedup.order_minhash("one")) == near_dedup.SKETCHES


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- Near duplicates


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(9)
    base = [prose(r, r.randint(20, 120)) for _ in range(30)]
    shared = prose(r, 60)
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(100 + i, edited(r, base[i], 0.05)) for i in range(12)] + [(200 + i, base[i]) for i in range(6)]
    texts += [(300 + i, f"{prose(r, 150)} {shared} {prose(r, 150)}") for i in range(8)]
    texts += [(400, None), (401, None), (402, ""), (403, "  "), (404, "one two"), (405, "one two"), (None, base[2]), (None, "nobody else has this text here"), (7, base[7])]
    got = near_dedup.near_duplicates(frame(spark, texts).repartition(4)).collect()
    assert len(got) == len(texts)
    words = {i: (t or "").split() for i, t in texts if i is not None}
    group = {x.doc_id: x.class_id for x in got if x.doc_id is not None}
    for a in words:
        for b in words:
            if words[a] and words[b] and near_dedup.near(words[a], words[b]):
                assert group[a] == group[b], (a, b)
    assert group[400] == group[401] == 400 and group[402] == 402 and group[404] == group[405] == 404
    assert len({group[300 + i] for i in range(8)}) == 8
    assert {x.copy_id for x in got if x.doc_id is None} == {2, None}
    kept = near_dedup.keep_one(frame(spark, texts))
    ids = [x.doc_id for x in kept.collect()]
    assert kept.columns == frame(spark, texts).columns and 200 not in ids and 101 not in ids and 0 in ids and ids.count(7) == 1 and ids.count(None) == 1
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_exactly_one_row_of_each_class_stays(spark):
    """Null, repeated and clashing ids, against classes by comparison of all pairs."""
    r = random.Random(23)
    base = [prose(r, 60) for _ in range(12)]
    texts = [(i % 5 if i % 3 else None, t) for i, t in enumerate(base)]  # ids shared by unique texts
    texts += [(1, base[0]), (None, base[1]), (None, base[1]), (8, edited(r, base[2], 0.04)), (8, base[3]), (8, base[3]), (None, None), (None, None), (4, None), (9, ""), (10, ""), (11, " \n")]
    docs = spark.createDataFrame([(i, t, k % 2, "x", "y") for k, (i, t) in enumerate(texts)], "doc_id long, text string, stays int, _id string, one string").repartition(5)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    head = list(range(len(texts)))
    for i, (_, a) in enumerate(texts):
        for j, (_, b) in enumerate(texts[:i]):
            if a == b or (a and b and a.split() and b.split() and near_dedup.near(a.split(), b.split())):
                head = [head[j] if h == head[i] else h for h in head]
    want = Counter()
    for h in set(head):
        want[min((i is None, i or 0) for (i, _), k in zip(texts, head) if k == h)] += 1
    assert Counter((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == want
    assert {x.text for x in kept.collect()} >= set(base) - {base[2]}
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_a_text_of_five_million_words():
    import resource

    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 50_000, 5_000_000)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sketch = near_dedup.order_minhash(text)
    assert len(sketch) == near_dedup.SKETCHES and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000
    a = text.split()[:300_000]
    assert near_dedup.near(a, [w for i, w in enumerate(a) if i % 4000]) and not near_dedup.near(a, a[60_001:])


def test_band_in_blocks_equals_the_full_table(monkeypatch):
    monkeypatch.setattr(near_dedup, "MASK_BITS", 1)
    r = random.Random(8)
    for _ in range(400):
        a = [r.choice("abcd") for _ in range(r.randint(0, 90))]
        b = [c for c in a if r.random() < 0.85] + [r.choice("ab")]
        assert near_dedup.banded_distance(a, b, 25) == min(distance(a, b), 26)
        assert near_dedup.near(a, b) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_a_large_group_stays_linear(spark):
    r = random.Random(5)
    base = prose(r, 80)
    texts = [(i, edited(r, base, 0.03)) for i in range(300)] + [(1000 + i, base) for i in range(300)]
    got = near_dedup.near_duplicates(frame(spark, texts))
    assert got.select("class_id").distinct().count() == 1


def linked(texts):
    """Groups of texts that a chain of near duplicates with a common sketch links, by plain comparison of all pairs."""
    words, sketch = [t.split() for t in texts], [set(near_dedup.order_minhash(t).tolist()) for t in texts]
    head = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if head[i] != head[j] and not sketch[i].isdisjoint(sketch[j]) and near_dedup.near(words[i], words[j]):
                old, new = max(head[i], head[j]), min(head[i], head[j])
                head = [new if h == old else h for h in head]
    return head


def test_a_hub_of_the_greatest_id_keeps_its_copies(spark, monkeypatch):
    r = random.Random(14)
    hub = prose(r, 200)
    texts = [edited(r, hub, 0.14) for _ in range(150)] + [hub]
    want = linked(texts)
    assert max(Counter(want).values()) > 120
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_counts_bound_the_distance():
    r = random.Random(15)
    texts = [t for base in (prose(r, 40), prose(r, 700), " ".join(["w1"] * 600)) for t in [base, *(edited(r, base, s / 40) for s in range(12))]]
    size = np.array([len(t.split()) for t in texts])
    counts = np.frombuffer(b"".join(map(near_dedup.word_counts, texts)), np.uint8).reshape(len(texts), -1)
    at = np.arange(len(texts))
    for side in (np.zeros(len(texts), int), at % 2):
        got = {(int(u), int(v)) for us, vs, _ in near_dedup.possible_pairs(at, at, size, counts, side, 0.8) for u, v in zip(us, vs)}
        for i in range(len(texts)):
            for j in range(i):
                if (not side.any() or side[i] != side[j]) and near_dedup.near(texts[i].split(), texts[j].split()):
                    assert (i, j) in got


# --- Decontamination


def words_of(text):
    return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def contained(texts, items):
    """(place of the text, place of the item): containment, by comparison of all pairs."""
    out = {}
    for a, (_, t) in enumerate(texts):
        for b, (_, x) in enumerate(items):
            w = words_of(x)
            k = min(5, len(w))
            if k and (share := len(shingles(w, k) & shingles(words_of(t), k)) / len(shingles(w, k))) >= 0.8 - 1e-9:
                out[a, b] = share
    return out


def test_decontamination_against_all_pairs(spark):
    r = random.Random(11)
    items = [(i, prose(r, r.randint(6, 60))) for i in range(20)] + [(90, "too short"), (91, None), (None, prose(r, 20)), (3, "Zyx"), (92, "")]
    texts = [(i, f"{prose(r, 200)} {edited(r, items[i % 20][1], (i % 5) * 0.02).upper()}. {prose(r, 3000 if i == 4 else 50)}") for i in range(40)]
    texts += [(50, None), (51, ""), (None, items[22][1]), (52, "a text too-short for more"), (7, items[8][1]), (7, "clean text under a soiled id"), (None, "clean text without an id"), (53, "it says zyx"), (54, "zyxt")]
    texts += [texts[0], texts[0], texts[43]]
    bench = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    pairs = contained(texts, items)
    expect = defaultdict(float)
    for (a, b), share in pairs.items():
        key = texts[a][0], items[b][0]
        expect[key] = max(expect[key], share)
    docs = frame(spark, texts).withColumn("_h1", F.lit(0)).withColumn("item", F.lit(1))
    got = decontaminate.find_contamination(docs, bench)
    assert {(x.doc_id, x.item_id): pytest.approx(x.containment) for x in got.collect()} == expect and len(expect) > 10 and (53, 3) in expect and (52, 90) in expect
    kept = decontaminate.remove_contaminated(docs, bench)
    soiled = {a for a, _ in pairs}
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter(row for a, row in enumerate(texts) if a not in soiled)
    assert (7, "clean text under a soiled id") in {(x.doc_id, x.text) for x in kept.collect()}
    assert kept.columns == docs.columns
    assert decontaminate.find_contamination(frame(spark, []), bench).count() == 0
    assert decontaminate.find_contamination(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(frame(spark, texts), bench.limit(0)).count() == len(texts)


@pytest.mark.parametrize("wide", [False, True])
def test_decontamination_finds_every_size(spark, monkeypatch, wide):
    """Recall over items of 1 to 60 and of 400 words, at any containment near the threshold, with the joins broadcast or shuffled."""
    if wide:
        monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(400 if i >= 235 else 1 + i % 60))) for i in range(240)]
    texts = []
    for i, t in items:
        w, n = t.split(), len(t.split())
        gone = r.randint(0, max(0, n // 4))
        cut = w[: n - gone] if i % 2 else w[gone:]
        texts.append((i, " ".join([*(r.choice(vocabulary) for _ in range(150)), *cut, *(r.choice(vocabulary) for _ in range(100))])))
    pairs = contained(texts, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): pytest.approx(x.containment) for x in decontaminate.find_contamination(frame(spark, texts), bench).collect()}
    assert got == pairs and len(pairs) > 200


def test_a_long_text_and_matches_needed():
    assert decontaminate.least_matches(64, 0.8) > decontaminate.least_matches(4096, 0.8) >= 9
    n, held, draws = 64, 52, 20_000
    r = random.Random(3)
    assert min(sum(x < held for x in r.sample(range(n), decontaminate.SIGNATURE)) for _ in range(draws)) >= decontaminate.least_matches(64, 0.8)


# --- Quality


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        s = quality.BEGIN * (order - 1) + t + quality.END
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: quality.discounts([sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]) for k in counts}
    d = lambda k, c: cut[k][min(c, 3) - 1] if c else 0
    total, saved = defaultdict(Counter), defaultdict(Counter)
    for k, held in counts.items():
        for g, c in held.items():
            total[k][g[:-1]] += c
            saved[k][g[:-1]] += d(k, c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        ctx = g[:-1]
        if ctx not in total[k]:
            return p(g[1:])
        c = counts[k].get(g, 0)
        return (c - d(k, c)) / total[k][ctx] + saved[k][ctx] / total[k][ctx] * p(g[1:])

    return p


def test_models_equal_the_plain_one(spark):
    r = random.Random(13)
    trains = [["".join(r.choice("ab c\néx") for _ in range(r.randint(0, 60))) for _ in range(40)] for _ in range(2)]
    texts = trains[0][:5] + ["", "zzz", "a\x02b\x03", "é🪴 ab", "ab" * 3000]
    models = quality.fit(spark.createDataFrame([(1 - m, t) for m, some in enumerate(trains) for t in some], "fold int, text string").repartition(3), 3)
    df = spark.createDataFrame([(i, m, t) for i, t in enumerate(texts) for m in (0, 1)], "i int, fold int, text string").coalesce(1)
    plain = [plain_model(t, 3) for t in trains]
    for x in quality.score(df, models).collect():
        s = quality.BEGIN * 2 + texts[x.i] + quality.END
        logs = [math.log(plain[x.fold](s[k : k + 3])) for k in range(len(s) - 2)]
        assert x.n_scored == len(logs) and x.logp == pytest.approx(sum(logs), rel=1e-9)
    assert sum(plain[0]("ab" + c) for c in "ab c\néx\x03") == pytest.approx(1, abs=0.2)


def plain_judge(rows, trusted, folds, order):
    """The contract of judge by dictionaries: rows are (id, text, lang), folds the half of each row's text."""
    texts = [t or "" for _, t, _ in rows]
    good = [i in trusted for i, _, _ in rows]
    models = [plain_model([t for t, g, f in zip(texts, good, folds) if g and f != k], order) for k in range(2)]
    loss = []
    for t, f in zip(texts, folds):
        s = quality.BEGIN * (order - 1) + t + quality.END
        n = len(s) - order + 1
        loss.append(-sum(math.log(models[f](s[k : k + order])) for k in range(n)) / n)
    own = defaultdict(list)
    for (_, t, lang), g, x in zip(rows, good, loss):
        if g and t:
            own[lang].append(x)
    every = [x for some in own.values() for x in some]
    mean = lambda lang: sum(own.get(lang, every)) / len(own.get(lang, every))
    off = [((len(t) + 1) * x + 200 * mean(lang)) / (len(t) + 201) - mean(lang) for t, x, (_, _, lang) in zip(texts, loss, rows)]
    pick = lambda some, p: sorted(some)[max(math.ceil(p * len(some)), 1) - 1]
    held = [(lang, o) for (_, t, lang), g, o in zip(rows, good, off) if g and t]
    bounds = {}
    for lang in {x[2] for x in rows}:
        mine, all_ = [o for k, o in held if k == lang], [o for _, o in held]
        bounds[lang] = [(len(mine) * (pick(mine, p) if mine else 0) + 200 * pick(all_, p)) / (len(mine) + 200) for p in (quality.LOW, quality.HIGH)]
    return [not t or bounds[lang][0] <= o <= bounds[lang][1] for t, o, (_, _, lang) in zip(texts, off, rows)], loss


def test_verdicts_equal_the_plain_judge(spark, monkeypatch):
    """Quantiles wide enough to reject many, few trusted documents in one language and none in another; null, empty and long texts; shared and null ids."""
    monkeypatch.setattr(quality, "LOW", 0.05)
    monkeypatch.setattr(quality, "HIGH", 0.9)
    r = random.Random(29)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    letters = {"en": "abcd e", "de": "efgh i", None: "xyz w", "odd'\\lang": "abxy "}
    rows = [(i, make(letters[lang], r.randint(3, 90)), lang) for i, lang in enumerate(["en"] * 60 + ["de"] * 25 + [None] * 12 + ["odd'\\lang"] * 6)]
    rows += [(200, make("#$%! ", 80), "en"), (None, make("#$%! ", 80), "en"), (None, rows[3][1], "en"), (3, make("#$%! ", 80), "en"), (201, None, "en"), (202, "", "de"), (203, "a" * 700, "en"), (204, make(letters["en"], 60_000), "en"), rows[5], rows[5]]
    trusted = set(range(0, 40)) | {61, 62} | set(range(86, 90))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(200, 0, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    trusted.discard(4)
    docs = frame(spark, [(i, t) for i, t, _ in rows], [lang for _, _, lang in rows])
    folds = [x.f for x in docs.coalesce(1).select(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(2)).alias("f")).collect()]
    keep, loss = plain_judge(rows, trusted, folds, 3)
    got = quality.judge(docs, labels, 3).collect()
    tidy = lambda some: sorted(some, key=repr)
    assert tidy((x.doc_id, x.lang, x.n_chars, round(math.log(x.perplexity), 6), x.keep) for x in got) == tidy((i, lang, len(t or ""), round(p, 6), k) for (i, t, lang), k, p in zip(rows, keep, loss))
    assert 5 < sum(not k for k in keep) < len(rows) / 2
    monkeypatch.setattr(quality, "ORDER", 3)
    kept = quality.keep_good(docs, labels)
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter((i, t) for (i, t, _), k in zip(rows, keep) if k)
    assert kept.columns == docs.columns and quality.keep_good(docs.limit(0), labels).count() == 0


def test_blocks_and_steps_do_not_change_scores(spark, monkeypatch):
    texts = ["abc " * k for k in range(30)]
    whole = quality.gram_counts(texts, 4)
    monkeypatch.setattr(quality, "STEP_CHARS", 10)
    assert quality.gram_counts(texts, 4) == whole


def test_classifier_on_held_out_junk(spark):
    r = random.Random(17)
    syllables = ["the", "an", "er", "in", "on", "re", "st"]
    good = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))
    junk = lambda n: " ".join(f"{good(1).upper()}!!###" for _ in range(n))
    texts = [(i, good(r.randint(20, 80))) for i in range(600)] + [(1000 + i, junk(30)) for i in range(40)] + [(2000, None), (2001, ""), (2002, "the"), (None, good(30)), (5, good(40))]
    langs = [None if i % 50 == 0 else "en" for i in range(len(texts))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 500)] + [(i, 0, 0) for i in range(1000, 1020)] + [(3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, texts, langs)
    got = quality.judge(df, labels).collect()
    assert len(got) == len(texts)
    good_kept = np.mean([x.keep for x in got if x.doc_id is not None and x.doc_id < 1000])
    assert good_kept > 0.97 and not any(x.keep for x in got if x.doc_id and 1000 <= x.doc_id < 2000)
    assert all(x.keep for x in got if x.doc_id in (None, 2000, 2001))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id between 1000 and 1999").count() == 0
    assert quality.judge(df.limit(0), labels).count() == 0
    assert all(x.keep for x in quality.judge(df, labels.limit(0)).collect())


# --- Pipeline


def test_pipeline_equals_its_parts(spark, tmp_path):
    import corpus_pipeline
    from noteloom.llm import pii
    from noteloom.llm.queries import tokenizer_path

    r = random.Random(19)
    item = prose(r, 30)
    base = [prose(r, 60) + (f" mail a.b{i}@example.com" if i % 2 else "") for i in range(60)]
    texts = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(r, base[i], 0.03)) for i in range(5)] + [(200, f"{base[9]} {prose(r, 60)} {item}"), (201, f"{prose(r, 90)} mail a.b9@example.com"), (202, "###$$$ " * 60)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(202, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    anchors = pii.automaton()
    got = {x.doc_id: x.n_tokens for x in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: len(sp.encode(pii.redact_text(t, anchors))) for i, t in texts if i < 100 or i == 201}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_keep_one_takes_repeated_rows_with_maps(spark):
    """Of repeated rows one stays whole, whatever the types of the other columns."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, {"a": 1}, [{"k": None}]), (1, text, {"a": 2}, None), (1, text, None, []), (2, text, {}, None), (3, "other words", None, None), (3, "other words", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, l array<map<string,string>>")
    kept = near_dedup.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3] and all((r["doc_id"], r["text"], r["m"], r["l"]) in rows for r in kept)
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_rows_without_is_exact_though_its_bit_map_is_full(spark, monkeypatch):
    """Rows go by their exact key, nulls among them, also where most bits of the map are set; columns of any name stay."""
    rows = [(i % 300 if i % 7 else None, f"text {i % 90}" if i % 11 else None, {"d": i}, i) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d struct<d:long>, `spared.x` long")
    keys = {(r[0], r[1]) for r in rows[::5]}
    h1, h2 = text_key(F.col("text"))
    gone = spark.createDataFrame(sorted(keys, key=str), "doc_id long, text string").select("doc_id", h1.alias("h1"), h2.alias("h2"))
    own = dict(zip(("h1", "h2"), text_key(F.col("d.text")))) | {"doc_id": F.col("d.doc_id")}
    expected = sorted(r[3] for r in rows if (r[0], r[1]) not in keys)
    for least, most, broadcast in ((1 << 19, 1 << 24, 500_000), (64, 64, 500_000), (256, 512, 1)):
        monkeypatch.setattr(common, "LEAST_BITS", least)
        monkeypatch.setattr(common, "MOST_BITS", most)
        monkeypatch.setattr(common, "BROADCAST_KEYS", broadcast)
        kept = common.rows_without(docs, common.materialize(gone), own)
        assert kept.columns == docs.columns and sorted(r["spared.x"] for r in kept.collect()) == expected
    assert common.rows_without(docs, gone.limit(0), own).count() == len(rows)
    assert common.rows_without(docs.limit(0), gone, own).count() == 0


def test_a_failed_operator_leaves_no_tables(spark):
    folder = common.shared_dir(spark)

    @common.tidy
    def failing():
        common.materialize(spark.range(3))
        raise ValueError("stop")

    before = set(os.listdir(folder))
    with pytest.raises(ValueError):
        failing()
    assert set(os.listdir(folder)) == before


def test_plans_do_not_spell_out_bit_maps(spark, capsys):
    """Spark keeps the text of every plan at the driver: a map of all keys must not be in it."""
    docs = spark.range(5000).selectExpr("id as doc_id")
    gone = common.materialize(spark.range(0, 5000, 7).selectExpr("id as k"))
    left = common.rows_without(docs, gone, {"k": F.col("d.doc_id")})
    left.explain(True)
    assert len(capsys.readouterr().out) < 50_000
    assert left.count() == 5000 - 715 and left.where("doc_id % 7 = 0").count() == 0
