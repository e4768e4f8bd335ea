"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic
regression.

The lexicon (words and word beginnings that mark toxic texts) is learned from a
bounded sample of labelled rows; the trees see each of these rows through a
lexicon of the half it isn't in, and the calibration uses rows that no tree saw.  Features of a text: densities and
weights of lexicon hits, hits near second-person words, hits that appear only
once disguised letters are undone, capitals, marks, digits, repeated letters.

Null and empty texts have the features of no words and get a score like any
other; equal texts get equal scores; an empty table gives no rows; without
labels of both kinds every score is the share of toxic labels (0 if none);
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, slices, text_bytes
from .language import held_out, labelled_sample
from .words import KIND, LOW, MARK, WORD, Tokens, hash_word, per_doc, tokens

#: The most labelled rows learned from; their words bound the lexicon.
FIT_ROWS = 24_000
#: How much oftener toxic rows hold an entry, and the weight of a strong one.
RATIO, STRONG = 6.0, 4.0
#: Bytes of word beginnings that may be lexicon entries, besides whole words.
PREFIXES = (4, 5, 6, 7)
#: Tokens between a lexicon word and a second-person word that count as near.
NEAR = 6
_YOU = "you your yours yourself u ur ya du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os tus su".split()

_LEET = LOW.copy()
for _a, _b in zip("0134578@$!", "oieastbasi"):
    _LEET[ord(_a)] = ord(_b)
_LEET_KIND = KIND.copy()
_LEET_KIND[[ord(c) for c in "@$!*"]] = WORD
YOU = np.sort(np.array([hash_word(w) for w in _YOU], np.uint64))
NAMES = ["words", "hits", "density", "weight", "heaviest", "distinct", "prefix_hits", "prefix_density", "strong", "strong_density", "near_you", "you", "disguised", "capitals", "shouting", "marks", "exclaim", "question", "digits", "mixed", "stretched", "foreign", "word_bytes"]


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _salted(t: Tokens, size: int) -> np.ndarray:
    """Hashes of the beginnings of words that are longer, else of nothing known."""
    return np.where(t.end - t.start > size, t.hashes(size) ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1), np.uint64(0))


@dataclass
class Lexicon:
    words: np.ndarray
    word_weight: np.ndarray
    begins: np.ndarray
    begin_weight: np.ndarray


def features(raw: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of float32 per text, in the order of NAMES."""
    t = tokens(raw, offsets)
    docs = len(offsets) - 1
    word = t.kind == WORD
    owner = t.doc()
    hashes = t.hashes()
    n = np.maximum(per_doc(word, t.bounds), 1)
    size = np.maximum(np.diff(offsets), 1)
    found = np.where(word, member(hashes, lexicon.words), -1)
    hit = found >= 0
    weight = np.where(hit, lexicon.word_weight[found], 0) if len(lexicon.words) else np.zeros(len(found))
    begin_hit = np.zeros(len(hashes), bool)
    for k in PREFIXES:
        at = np.where(word, member(_salted(t, k), lexicon.begins), -1)
        begin_hit |= at >= 0
        if len(lexicon.begins):
            weight = np.maximum(weight, np.where(at >= 0, lexicon.begin_weight[at], 0))
    either = hit | begin_hit
    heaviest = np.zeros(docs)
    np.maximum.at(heaviest, owner[either], weight[either])
    pairs = np.unique(np.stack([owner[either].astype(np.uint64), hashes[either]]), axis=1) if either.any() else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=docs)
    you = word & (member(hashes, YOU) >= 0)
    seen = np.concatenate([[0], np.cumsum(you)])
    place = np.arange(len(you))
    low, high = np.maximum(place - NEAR, t.bounds[:-1][owner]), np.minimum(place + NEAR + 1, t.bounds[1:][owner])
    near = either & (seen[high] > seen[low])
    # words whose letters are disguised: 1d10t, tr@sh
    u = tokens(raw, offsets, _LEET, _LEET_KIND)
    odd = np.concatenate([[0], np.cumsum((KIND[raw] == MARK) | ((raw >= 48) & (raw < 58)))])
    disguise = (u.kind == WORD) & (odd[u.end] > odd[u.start])
    disguised = disguise & (member(u.hashes(), lexicon.words) >= 0)
    byte = lambda mask: _bytes(mask, offsets)
    upper = (raw >= 65) & (raw < 91)
    letters = np.maximum(byte(upper | ((raw >= 97) & (raw < 123)) | (raw >= 128)), 1)
    caps = np.concatenate([[0], np.cumsum(upper)])
    width = t.end - t.start
    shouting = word & (width > 2) & (caps[t.end] - caps[t.start] == width)
    same = np.zeros(len(raw), bool)
    if len(raw) > 2:
        same[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (KIND[raw[2:]] == WORD)
        for k in (0, 1):  # a text's first two bytes repeat nothing of the text before
            at = offsets[:-1] + k
            same[at[at < offsets[1:]]] = False
    columns = [
        np.log1p(n), per_doc(either, t.bounds), per_doc(either, t.bounds) / n, per_doc(weight, t.bounds), heaviest, distinct,
        per_doc(begin_hit, t.bounds), per_doc(begin_hit, t.bounds) / n, per_doc(weight > STRONG, t.bounds), per_doc(weight > STRONG, t.bounds) / n, per_doc(near, t.bounds), per_doc(you, t.bounds) / n,
        per_doc(disguised, u.bounds), byte(upper) / letters, per_doc(shouting, t.bounds) / n, byte(KIND[raw] == MARK) / size,
        byte(raw == 33) / size, byte(raw == 63) / size, byte((raw >= 48) & (raw < 58)) / size, per_doc(disguise, u.bounds) / n,
        byte(same) / size, byte(raw >= 128) / size, letters / n,
    ]
    return np.stack(columns, 1).astype(np.float32) if docs else np.zeros((0, len(NAMES)), np.float32)


def _bytes(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Trees:
    """Boosted trees of equal depth over binned features, and the calibration."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for d in range(depth):
                at = (1 << d) - 1 + node
                node = node * 2 + (b[rows, f[at]] > c[at])
            total += v[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values) if len(self.knots) else 1 / (1 + np.exp(-self.raw(x)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1).astype(np.uint8) if len(x) else np.zeros((0, len(edges)), np.uint8)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 48, l2: float = 1.0, least: int = 4) -> Trees:
    """Newton boosting of the logistic loss with histograms; ``least`` rows to a leaf."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = binned(x, edges).astype(np.int64)
    width, count = bins + 1, x.shape[1]
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    f = np.full(len(y), base)
    features_, cuts, leaves = [], [], []
    flat = b + np.arange(count) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        tree_f, tree_c = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, 255, np.int64)
        for d in range(depth):
            nodes = 1 << d
            key = (node[:, None] * (count * width) + flat).ravel()
            total = nodes * count * width
            hg = np.bincount(key, np.repeat(g, count), total).reshape(nodes, count, width).cumsum(2)
            hh = np.bincount(key, np.repeat(h, count), total).reshape(nodes, count, width).cumsum(2)
            rows = np.bincount(key, minlength=total).reshape(nodes, count, width).cumsum(2)
            ag, ah = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + l2) + (ag - hg) ** 2 / (ah - hh + l2) - ag**2 / (ah + l2)
            gain[(rows < least) | (rows[:, :, -1:] - rows < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            tree_f[nodes - 1 : 2 * nodes - 1] = best // width
            tree_c[nodes - 1 : 2 * nodes - 1] = np.where(gain.reshape(nodes, -1).max(1) > 1e-6, best % width, 255)
            at = nodes - 1 + node
            node = node * 2 + (b[np.arange(len(y)), tree_f[at]] > tree_c[at])
        value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        f += value[node]
        features_.append(tree_f)
        cuts.append(tree_c)
        leaves.append(value)
    return Trees(edges, np.array(features_), np.array(cuts), np.array(leaves), base, np.zeros(0), np.zeros(0))


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to s, by pooling adjacent violators;
    each block is smoothed by one row of each kind so no score is exactly 0 or 1."""
    blocks: list[list[float]] = []
    points, owner = np.unique(s, return_inverse=True)
    for value, label, rows in zip(points.tolist(), np.bincount(owner, y).tolist(), np.bincount(owner).tolist()):
        blocks.append([label, rows, value, value])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.array([v for b in blocks for v in ((b[0] + 0.05) / (b[1] + 0.1),) * 2])
    return knots, np.maximum.accumulate(values)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    share: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        return np.clip(self.trees.score(features(raw, offsets, self.lexicon)), 0, 1)


def learn_lexicons(rows: DataFrame) -> tuple[list[Lexicon], np.ndarray]:
    """Lexicons from fold 0, fold 1 and both, and the rows by [fold, label];
    ``rows`` has fold, label and text.

    Entries are keys that toxic rows hold far oftener.  Each partition counts the
    rows that hold a key, and the counts are summed by key; only keys that pass
    reach the driver, LEXICON of them at most.
    """
    names = ["clean0", "toxic0", "clean1", "toxic1"]

    def run(batches):
        keys, cells, kinds = [], [], []
        for batch in batches:
            for a, b in slices(batch.column(2)):
                raw, offsets = text_bytes(batch.column(2).slice(a, b - a))
                cell = 2 * np.array(batch.column(0).slice(a, b - a).to_pylist(), np.int64) + np.array(batch.column(1).slice(a, b - a).to_pylist(), np.int64)
                t = tokens(raw, offsets)
                owner, word = t.doc(), t.kind == WORD
                for kind, h in ((0, t.hashes()), *((k, _salted(t, k)) for k in PREFIXES)):
                    use = word & (h != 0)
                    o, k = owner[use], h[use]
                    order = np.lexsort((k, o))
                    o, k = o[order], k[order]
                    first = np.ones(len(o), bool)
                    first[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
                    keys.append(k[first])
                    cells.append(cell[o[first]])
                    kinds.append(np.full(first.sum(), kind, np.int8))
        if not keys:
            return
        key, cell, kind = np.concatenate(keys), np.concatenate(cells), np.concatenate(kinds)
        one, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        counts = np.bincount(inverse * 4 + cell, minlength=4 * len(one)).reshape(-1, 4)
        yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(kind[first].astype(np.int32)), *(pa.array(c) for c in counts.T)], ["key", "kind", *names])

    sizes = np.zeros((2, 2))
    for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.fold, r.label] = r.n
    choices = [([0], sizes[0]), ([1], sizes[1]), ([0, 1], sizes.sum(0))]

    def figures(folds, size, counts):
        toxic = sum((counts[f"toxic{f}"] for f in folds), 0)
        clean = sum((counts[f"clean{f}"] for f in folds), 0)
        return toxic, (toxic + 0.5) / (clean + 0.5) * float(size[0] / max(1, size[1])), float(max(3, size[1] // 250))

    found = rows.select("fold", "label", "text").mapInArrow(run, "key long, kind int, " + ", ".join(f"{n} long" for n in names)).groupBy("key", "kind").agg(*(F.sum(n).alias(n) for n in names))
    passes = F.lit(False)
    for folds, size in choices:
        toxic, ratio, least = figures(folds, size, {n: F.col(n) for n in names})
        passes = passes | ((toxic >= least) & (ratio > RATIO))
    # no more of these than the sample's words: each stands in toxic rows of it, several times as often as in others
    top = found.where(passes).toArrow()
    key, kind = top.column("key").to_numpy().astype(np.int64).view(np.uint64), top.column("kind").to_numpy().astype(np.int64)
    counts = {n: top.column(n).to_numpy().astype(float) for n in names}
    out = []
    for folds, size in choices:
        toxic, ratio, least = figures(folds, size, counts)
        good = (toxic >= least) & (ratio > RATIO) if len(key) and size.min() > 0 else np.zeros(len(key), bool)
        parts = []
        for which in (good & (kind == 0), good & (kind > 0)):
            order = np.argsort(key[which])
            parts += [key[which][order], np.log(np.asarray(ratio)[which])[order] if which.any() else np.zeros(0)]
        out.append(Lexicon(*parts))
    return out, sizes


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fit on at most ``most`` labelled rows that aren't held out, the same each time."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = labelled_sample(marked, "toxic", most)
    rows = id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(8)).cast("int")
    (first, second, both), sizes = learn_lexicons(rows.select((part % 2).alias("fold"), "label", "text"))

    def run(batch: pa.RecordBatch):
        for a, b in slices(batch.column(2)):
            raw, offsets = text_bytes(batch.column(2).slice(a, b - a))
            fold = np.array(batch.column(0).slice(a, b - a).to_pylist()) % 2
            # each row is described with the lexicon of the other fold
            x = np.where((fold == 0)[:, None], features(raw, offsets, second), features(raw, offsets, first)).astype(np.float32)
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["part", "label", "x"])

    got = sorted((r.part, r.label, bytes(r.x)) for r in map_arrow(rows.select(part.alias("part"), "label", "text"), run, "part int, label int, x binary").collect())
    y = np.array([g[1] for g in got], float)
    if sizes.min() < 1 or y.min() == y.max():
        return Model(both, None, float(sizes[:, 1].sum() / sizes.sum()) if sizes.sum() else 0.0)
    x = np.stack([np.frombuffer(g[2], np.float32) for g in got])
    calibrate = np.array([g[0] >= 6 for g in got])
    if len(set(y[calibrate])) < 2 or calibrate.sum() < 50 or len(set(y[~calibrate])) < 2:
        calibrate[:] = False
    trees = boost(x[~calibrate], y[~calibrate])
    if calibrate.any():
        trees.knots, trees.values = isotonic(trees.raw(x[calibrate]), y[calibrate])
    return Model(both, trees, float(y.mean()))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batch: pa.RecordBatch):
        for a, b in slices(batch.column(1)):
            scores = model.score(*text_bytes(batch.column(1).slice(a, b - a)))
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_arrow(id_and_text(docs), run, "doc_id long, score double")


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: doc_id, held_out, score, predicted."""
    found = score_texts(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
