"""Quality, toxicity and language: edge cases, defined results, held-out accuracy."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import language, quality, toxicity, words
from palimpsest.llm.common import text_bytes
from palimpsest.llm.words import hash_word, tokens

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_word_hashes_match_plain_ones():
    raw, offsets = text_bytes(pa.array(["Hello, wörld", None, "", "it's x"]))
    t = tokens(raw, offsets)
    words = [raw[a:b].tobytes().decode() for a, b in zip(t.start, t.end)]
    assert words == ["Hello", ",", "wörld", "it", "'", "s", "x"]
    assert t.bounds.tolist() == [0, 3, 3, 3, 7]
    assert [hash_word(w) for w in words] == t.hashes().tolist()
    assert hash_word("wör"[:3]) == t.hashes(4)[2]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language_held_out(tables):
    docs, _ = tables
    got = {r.doc_id: r for r in language.op8_language(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    mine = [got[i].lang_pred == c for i, c in truth.items() if held(i)]
    assert sum(mine) / len(mine) >= 0.98


def test_language_does_not_see_held_out_labels(tables):
    docs, _ = tables
    wrong = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = {tuple(r) for r in language.op8_language(docs).collect()}
    assert {tuple(r) for r in language.op8_language(wrong).collect()} == a


def test_language_edges(odd_docs, no_docs, tables):
    model = language.train(tables[0])
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.classify(odd_docs, model).collect()}
    none = {i for i, c, s in got if c == "und"}
    assert none == {0, 1, 2, 3, 13, 15, 17} and all(s == 0 for i, c, s in got if c == "und")
    assert language.classify(no_docs, model).count() == 0
    assert {r.lang_pred for r in language.op8_language(no_docs).collect()} == set()
    nothing = language.op8_language(odd_docs.withColumn("lang", odd_docs.kept)).collect()
    assert {r.lang_pred for r in nothing} == {"6", "und"}
    kept = language.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - len(none)


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.op7_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    pairs = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if held(r.doc_id) and r.doc_id in got]
    one, zero = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    assert np.mean([a > b for a in one for b in zero]) > 0.75
    assert np.mean([(s >= 0.5) == bool(t) for s, t in pairs]) > 0.9


def test_toxicity_edges(odd_docs, no_docs, tables):
    model = toxicity.train(*tables)
    rows = toxicity.score_texts(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[0] == same[1] and same[5] == same[6]
    assert toxicity.op7_toxicity(no_docs, tables[1]).count() == 0
    assert {r.score for r in toxicity.op7_toxicity(odd_docs, tables[1].limit(0)).collect()} == {0.0}


def plain_hash(raw, table=words.LOW):
    h, p = 0, 1
    for b in raw:
        h, p = (h + int(words._VALUE[table[b]]) * p) & M64, p * words._BASE & M64
    return plain_mix(h)


MARKS = rb"!-/:-@\[-`{-~"


def plain_toxic_features(text, lexicon, begins):
    """The features of one text, token by token."""
    raw = text.encode()
    low = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    found = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[" + MARKS + rb"]+", raw)]
    kinds = [bool(re.match(rb"[0-9A-Za-z\x80-\xff]", raw[a:b])) for a, b in found]
    you = {plain_hash(w.encode()) for w in toxicity._YOU}
    n = max(1, sum(kinds))
    weights, eithers, begun, hashes, yours = [], [], [], [], []
    for (a, b), word in zip(found, kinds):
        h = plain_hash(raw[a:b])
        weight, begin = lexicon.get(h, 0) if word else 0, False
        for k in toxicity.PREFIXES:
            key = plain_hash(raw[a : a + k]) ^ (k * 0x9E3779B97F4A7C15 & M64)
            if word and b - a > k and key in begins:
                begin, weight = True, max(weight, begins[key])
        weights.append(weight)
        begun.append(begin)
        eithers.append(word and h in lexicon or begin)
        hashes.append(h)
        yours.append(word and h in you)
    near = sum(e and any(yours[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, e in enumerate(eithers))
    leet = bytes(toxicity._LEET[b] for b in raw)
    disguise = disguised = 0
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff@$!*]+", raw):
        odd = re.search(rb"[0-9" + MARKS + rb"]", m.group())
        disguise += bool(odd)
        disguised += bool(odd) and plain_hash(raw[m.start() : m.end()], toxicity._LEET) in lexicon
    assert len(leet) == len(low) == len(raw)
    upper, size = sum(65 <= b < 91 for b in raw), max(1, len(raw))
    letters = max(1, upper + sum(97 <= b < 123 or b >= 128 for b in raw))
    shouting = sum(w and b - a > 2 and all(65 <= c < 91 for c in raw[a:b]) for (a, b), w in zip(found, kinds))
    same = sum(raw[i] == raw[i - 1] == raw[i - 2] and bool(re.match(rb"[0-9A-Za-z\x80-\xff]", raw[i : i + 1])) for i in range(2, len(raw)))
    share = lambda test: sum(map(test, raw)) / size
    strong = sum(w > toxicity.STRONG for w in weights)
    return [
        math.log1p(n), sum(eithers), sum(eithers) / n, sum(weights), max([w for w, e in zip(weights, eithers) if e], default=0), len({h for h, e in zip(hashes, eithers) if e}),
        sum(begun), sum(begun) / n, strong, strong / n, near, sum(yours) / n,
        disguised, upper / letters, shouting / n, len(re.findall(rb"[" + MARKS + rb"]", raw)) / size,
        share(lambda b: b == 33), share(lambda b: b == 63), share(lambda b: 48 <= b < 58), disguise / n, same / size, share(lambda b: b >= 128), letters / n,
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["idiot", "Idiots ", "1d10t", "tr@sh", "TRASH", " you ", "du", " ", "nice", "aaa", "a", "!!", "?", "é", "sch", "schwachkopf", "\n", "42", "-", "u"]), max_size=25).map("".join), max_size=5))
def test_toxicity_features_by_brute_force(texts):
    lexicon = {hash_word(w): x for w, x in (("idiot", 3.0), ("trash", 5.0), ("schwach", 1.0))}
    begins = {plain_hash(w) ^ (len(w) * 0x9E3779B97F4A7C15 & M64): x for w, x in ((b"idio", 2.0), (b"schwa", 4.5))}
    made = toxicity.Lexicon(*(part for table in (lexicon, begins) for part in (np.array(sorted(table), np.uint64), np.array([table[k] for k in sorted(table)]))))
    got = toxicity.features(*text_bytes(pa.array(texts, pa.string())), made)
    want = np.array([plain_toxic_features(t, lexicon, begins) for t in texts], np.float32).reshape(-1, len(toxicity.NAMES))
    assert got.shape == want.shape
    for k, name in enumerate(toxicity.NAMES):
        assert np.allclose(got[:, k], want[:, k], atol=1e-6), (name, got[:, k], want[:, k])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abC 1.é\n-z"), max_size=12), max_size=6))
def test_language_features_by_brute_force(texts):
    got = language.features(*text_bytes(pa.array(texts, pa.string())))
    for row, text in zip(got, texts):
        raw = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalpha() else 32 for b in text.encode())
        total = np.zeros(language.BUCKETS)
        for size, seed in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for i in range(len(raw) - size + 1):
                if raw[i : i + size].strip():
                    total[(int.from_bytes(raw[i : i + size], "big") * seed & 0xFFFFFFFF) >> 20] += 1
        total = np.sqrt(total)
        assert np.allclose(row, total / max(1e-9, math.sqrt((total**2).sum())), atol=1e-6)


def test_language_vote_by_brute_force():
    rng = np.random.default_rng(5)
    families = {"x": ["a", "b", "c"], "y": ["d"], "z": ["e", "f"]}
    between = {p: rng.standard_normal(5) for names in (sorted(families), *families.values()) for i, a in enumerate(names) for p in [(a, b) for b in names[i + 1 :]]}
    model = language.Model(families, between)
    x = rng.standard_normal((300, 4))
    langs, scores = model.predict(x)

    def winner(row, names):
        margins = {a: [] for a in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                m = float(row @ between[a, b][:-1] + between[a, b][-1])
                margins[a].append(m)
                margins[b].append(-m)
        won = {a: sum(m > 0 for m in margins[a]) + 1e-3 * sum(map(math.tanh, margins[a])) for a in names}
        best = max(names, key=lambda a: won[a])
        return best, 1 / (1 + math.exp(-4 * min(margins[best]))) if margins[best] else 1.0

    for row, lang, score in zip(x, langs, scores):
        family, sure = winner(row, sorted(families))
        best, more = winner(row, families[family])
        assert lang == best and abs(score - sure * more) < 1e-9


def test_isotonic_by_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(2, 40)
        s = np.array([rng.randint(0, 12) for _ in range(n)], float)
        y = np.array([rng.random() < v / 12 for v in s], float)
        knots, values = toxicity.isotonic(s, y)
        assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
        fit = np.interp(s, knots, values)
        # the least squares non-decreasing fit by its min-max formula
        u = np.unique(s)
        mean = lambda a, b: y[(s >= a) & (s <= b)].mean()
        want = np.array([max(min(mean(a, b) for b in u if b >= v) for a in u if a <= v) for v in s])
        assert np.abs(fit - want).max() < 0.06


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = toxicity.boost(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def test_quality_counts_by_brute_force(spark, odd_docs):
    good = spark.createDataFrame([(5,), (9,)], "doc_id long")
    got = quality.count_models(odd_docs, good)
    want = np.zeros_like(got)
    for r in odd_docs.select("doc_id", "text").collect():
        for k, (ids, _) in enumerate(quality.ngrams(*text_bytes(pa.array([r.text], pa.string())))):
            for b in ids:
                want[0, k, b] += 1
                want[1, k, b] += r.doc_id in (5, 9)
    assert (got == want).all()


M64 = (1 << 64) - 1


def plain_mix(h):
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 29
    return h * 0x94D049BB133111EB & M64


def plain_grams(text, bits=16):
    """Buckets of both tracks, with loops over tokens, from the module's description."""
    found = [m.group() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())]
    h = [hash_word(t.decode()) for t in found]
    shape = []
    for i, t in enumerate(found):
        word = t[:1].isalnum() or t[0] >= 128
        repeat = word and (h[i] in h[max(0, i - 2) : i])
        shape.append(77 if repeat else min((len(t) + 3) // 4, 9) if word else h[i])
    out = [[], []]

    def add(track, value, seed):
        out[track].append(plain_mix((value & M64) ^ (seed * 0x9E3779B97F4A7C15 & M64)) >> (64 - bits))

    for i in range(len(found)):
        add(0, h[i], 1)
        add(1, shape[i], 3)
        if i:
            add(0, plain_mix(h[i]) + h[i - 1], 2)
            two = plain_mix(shape[i] + 1 & M64) + shape[i - 1] & M64
            add(1, two, 4)
            if i > 1:
                add(1, plain_mix(two) + shape[i - 2], 5)
    return out


def plain_noise(doc_id, text):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    seed = seed if text is None else xxhash.xxh64_intdigest(text.encode(), seed)
    u = (xxhash.xxh64_intdigest(struct.pack("<i", 17), seed) % (1 << 52) + 0.5) / (1 << 52)
    return -math.log(-math.log(u))


def test_quality_weights_and_draw_by_brute_force(spark, odd_docs, tables):
    """Weights, noise and the k drawn, recounted with plain loops."""
    docs = tables[0].select("doc_id", "text").where("doc_id < 120").unionByName(odd_docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(k, k % 3 != 0) for k in range(0, 120, 2)], "doc_id long, good boolean").selectExpr("doc_id", "int(good) AS quality")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {k for k in range(0, 120, 2) if k % 3}
    raw, target = [Counter(), Counter()], [Counter(), Counter()]
    grams = [plain_grams(t) for _, t in rows]
    for (i, _), g in zip(rows, grams):
        for k in (0, 1):
            raw[k].update(g[k])
            if i in good:
                target[k].update(g[k])
    share = [target[k].total() / raw[k].total() for k in (0, 1)]
    ratio = lambda k, b: math.log((target[k][b] + 10) / ((max(raw[k][b] - 1, 0)) * share[k] + 10))
    weights = [sum(ratio(k, b) for k in (0, 1) for b in g[k]) if g[0] else None for g in grams]
    keys = [None if w is None else w + plain_noise(*r) for w, r in zip(weights, rows)]
    order = sorted((k for k in keys if k is not None), reverse=True)
    for size in (None, 7, 60, 10_000):
        k = size or sum(w is not None and w >= 0 for w in weights)
        least = order[min(k, len(order)) - 1]
        want = sorted(((i, t, w, x, x is not None and x >= least) for (i, t), w, x in zip(rows, weights, keys)), key=str)
        found = quality.op4_quality(docs, labels, size).join(docs.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")))
        got = sorted({(r.doc_id, r.text, r.log_weight, r.gumbel_key, r.kept) for r in found.collect()}, key=str)
        want = [w for k, w in enumerate(want) if not k or w[:2] != want[k - 1][:2]]
        assert [(g[0], g[4]) for g in got] == [(w[0], w[4]) for w in want]
        for g, w in zip(got, want):
            assert (g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) < 1e-6 * (1 + abs(w[2])) and abs(g[3] - w[3]) < 1e-6 * (1 + abs(w[3])))


def test_threshold_is_the_kth_largest(spark):
    rng = random.Random(4)
    for n, ties in ((1, 1), (50, 1), (3000, 1), (400, 40)):
        rows = [(1 - rng.random() * 5, rng.random() * 10) for _ in range(n)] * ties
        weights = spark.createDataFrame([*rows, (None, 99.0)], "log_weight double, noise double").repartition(3)
        for temper, k in ((1.0, None), (2.0, max(1, len(rows) // 3))):
            keys = sorted((w / temper + g for w, g in rows), reverse=True)
            want = sum(w >= 0 for w, _ in rows) if k is None else k
            assert quality.threshold(weights, k, temper) == (keys[want - 1] if want else float("inf"))
    assert quality.threshold(weights, 10**9) == min(w + g for w, g in rows)
    assert quality.threshold(weights.limit(0)) == quality.threshold(weights, 0) == float("inf")


def test_the_draw_follows_the_weights(spark):
    """Shares drawn by weight: 1 - exp(-weight / scale), within sampling error."""
    n, k = 40_000, 9_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), (F.col("id") % 5 - 2.0).alias("log_weight"))
    weights = rows.select("doc_id", "log_weight", quality._gumbel())
    least = quality.threshold(weights, k)
    drawn = dict(weights.where(quality.gumbel_key() >= least).groupBy("log_weight").count().collect())
    assert sum(drawn.values()) == k
    for w, count in drawn.items():
        p = 1 - math.exp(-math.exp(w - least))
        assert abs(count - p * n / 5) < 4 * math.sqrt(n / 5 * p * (1 - p)), (w, count, p * n / 5)
    # without replacement, in proportion: the first draws go by the weights themselves
    first = weights.orderBy(F.desc(quality.gumbel_key())).limit(400).groupBy("log_weight").count().collect()
    total = sum(math.exp(w) for w in range(-2, 3))
    assert all(abs(r["count"] - 400 * math.exp(r.log_weight) / total) < 70 for r in first)


def test_buckets_grow_with_the_corpus():
    assert [quality.bucket_bits(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 21, (1 << 21) + 1, 10**10)] == [16, 16, 16, 17, 17, 18, 22]
    raw, offsets = text_bytes(pa.array(["one two one", "x"]))
    for bits in (16, 19):
        for k, (ids, bounds) in enumerate(quality.ngrams(raw, offsets, bits)):
            assert sorted(ids[: bounds[1]].tolist()) == sorted(plain_grams("one two one", bits)[k])
        ratio = quality.Ratio(np.ones((2, 1 << bits)))
        assert ratio.log_weight(raw, offsets).tolist() == [11.0, 2.0]


def test_quality_keeps_clean_texts(tables):
    docs, labels = tables
    got = {r.doc_id: r.kept for r in quality.op4_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    good = [got[r.doc_id] for r in labels.where("quality = 1").collect()]
    bad = [got[r.doc_id] for r in labels.where("quality = 0").collect()]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    # the stage keeps the same rows, whole
    ratio = quality.train(docs, labels)
    least = quality.threshold(quality.importance(docs, ratio))
    kept = quality.keep_sampled(docs, ratio, least)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in got.items() if k}


def test_quality_edges(spark, odd_docs, no_docs, tables):
    rows = quality.op4_quality(odd_docs, tables[1]).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id for r in rows if r.log_weight is None} == {0, 1, 2, 3} and not any(r.kept for r in rows if r.doc_id in (0, 1, 2, 3))
    assert quality.op4_quality(no_docs, tables[1]).count() == 0
    plain = quality.op4_quality(odd_docs, tables[1].limit(0)).collect()
    assert all(r.kept == (r.doc_id not in (0, 1, 2, 3)) for r in plain)
    ratio = quality.Ratio(np.zeros((2, 1 << quality.BITS)))
    assert quality.keep_sampled(odd_docs, ratio, -100.0).columns == odd_docs.columns
