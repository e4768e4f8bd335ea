"""Quality by importance resampling.

Two hashed n-gram models are counted: of the target (a bounded sample of rows
labelled good) and of the raw text (all rows).  The log importance of a text is the
sum, over its n-grams, of the log ratio of the two models, as it is: a likelihood
ratio, so it grows with the length of a text, in either direction.  ``temper``
divides it, which flattens the weights.  Adding Gumbel noise and keeping the k
largest sums draws k texts without replacement, each draw in proportion to the
weights of those that are left.  k is an argument; its default is the number of
texts that the target model explains at least as well as the raw one does (log
importance of 0 or more), so no share is set by hand.

N-grams are of two tracks: words (one and two), and shapes (one to three), where
a shape is a mark run as it is, a repeat of a word just seen, or a word's length
class.  Both models get twice the buckets with every eight times as many rows.

Null and empty texts have no n-grams; they are never drawn.  Equal texts have equal
weights, but noise is drawn for each row from its id and text, so repeated rows are
tied and drawn together, even where that makes a few more than k.  Rows with a null
id take part.  An empty table gives no rows; without good labels the target is the
raw text, all weights are 1, and everything with words stays.  Other columns are
ignored by ``importance`` and kept by ``keep_sampled``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, slices, text_bytes, written
from .words import MARK, WORD, mix, per_doc, tokens

#: Bits of a bucket of each track, rows up to which they are enough, and the most good
#: rows that the target model is counted on.
BITS, BITS_ROWS, FIT_ROWS = 16, 1 << 18, 20_000
TRACKS = 2


def bucket_bits(rows: int) -> int:
    """Bits of a bucket for a corpus: one more for each eight times as many rows."""
    return BITS + max(0, -(-((max(1, rows) - 1) // BITS_ROWS).bit_length() // 3))


def _bucket(h: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return (mix(h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def ngrams(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each track: buckets of all n-grams in order of text, and n + 1 bounds."""
    t = tokens(raw, offsets)
    h, owner, n = t.hashes(), t.doc(), len(t.kind)
    inside = np.zeros(n, bool)
    if n > 1:
        inside[1:] = owner[1:] == owner[:-1]
    inside2 = np.zeros(n, bool)
    if n > 2:
        inside2[2:] = owner[2:] == owner[:-2]
    back = lambda a, k: np.concatenate([a[:k], a[:-k]]) if n > k else a
    width = np.minimum((t.end - t.start + 3) // 4, 9).astype(np.uint64)
    shape = np.where(t.kind == MARK, h, width)
    again = (inside & (back(h, 1) == h)) | (inside2 & (back(h, 2) == h))
    shape = np.where(again & (t.kind == WORD), np.uint64(77), shape)
    two = mix(h) + back(h, 1)
    s2 = mix(shape + np.uint64(1)) + back(shape, 1)
    s3 = mix(s2) + back(shape, 2)
    out = []
    for grams in (((h, np.ones(n, bool), 1), (two, inside, 2)), ((shape, np.ones(n, bool), 3), (s2, inside, 4), (s3, inside2, 5))):
        ids = np.stack([_bucket(g, seed, bits) for g, _, seed in grams], 1)
        use = np.stack([u for _, u, _ in grams], 1)
        per = np.concatenate([[0], np.cumsum(use.sum(1))])
        out.append((ids[use], per[t.bounds]))
    return out


@dataclass
class Ratio:
    """Log ratio of target to raw for each bucket of each track."""

    tables: np.ndarray

    def log_weight(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log importance of each text; NaN for texts without n-grams."""
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        for table, (ids, bounds) in zip(self.tables, ngrams(raw, offsets, self.tables.shape[1].bit_length() - 1)):
            total += per_doc(table[ids], bounds)
            count += np.diff(bounds)
        return np.where(count > 0, total, np.nan)


def count_models(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Counts [raw, target] x track x bucket over all texts; partial counts are
    made map-side, so what is shuffled doesn't depend on the length of texts."""
    bits = bucket_bits(docs.count())
    size = 1 << bits

    def run(batches):
        total = np.zeros((2, TRACKS * size), np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw, offsets = text_bytes(batch.column(1).slice(a, b - a))
                is_good = np.array(batch.column(0).slice(a, b - a).to_pylist(), bool)
                for k, (ids, bounds) in enumerate(ngrams(raw, offsets, bits)):
                    mine = np.repeat(is_good, np.diff(bounds))
                    here = slice(k * size, (k + 1) * size)
                    total[0, here] += np.bincount(ids, minlength=size)
                    total[1, here] += np.bincount(ids[mine], minlength=size)
        at = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "raw", "target"])

    rows = id_and_text(docs).join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    counted = rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, TRACKS * size))
    for k, name in enumerate(("raw", "target")):
        out[k, counted.column("bucket").to_numpy()] = counted.column(name).to_numpy()
    return out.reshape(2, TRACKS, size)


#: Counts by which each bucket leans towards a ratio of 1.
LEAN = 10.0


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Smoothed log(target / raw) by track and bucket.  The raw count is less one:
    the text that is being weighed is in it, but seldom in the target."""
    raw, target = counts
    if not target.any():
        return np.zeros(raw.shape)
    share = target.sum(1, keepdims=True) / np.maximum(raw.sum(1, keepdims=True), 1)
    return np.log((target + LEAN) / (np.maximum(raw - 1, 0) * share + LEAN))


def good_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids of rows labelled good and never bad, the same each time."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return rows.select("doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Ratio:
    """Count both models, the raw one over every text."""
    return Ratio(log_ratio(count_models(docs, good_sample(labels, most))))


def importance(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """doc_id, log_weight (null: no n-grams) and noise (a Gumbel draw from id and
    text) of every row."""

    def run(batch: pa.RecordBatch):
        for a, b in slices(batch.column(1)):
            weight = ratio.log_weight(*text_bytes(batch.column(1).slice(a, b - a)))
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(weight, from_pandas=True), batch.column(2).slice(a, b - a)], ["doc_id", "log_weight", "noise"])

    return map_arrow(id_and_text(docs).select("doc_id", "text", _gumbel()), run, "doc_id long, log_weight double, noise double")


def _gumbel(id_col: str = "doc_id", text_col: str = "text"):
    uniform = (F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), F.lit(17)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return (-F.log(-F.log(uniform))).alias("noise")


def gumbel_key(temper: float = 1.0):
    """The tempered log weight and its noise; null for texts without n-grams."""
    return F.col("log_weight") / F.lit(float(temper)) + F.col("noise")


def default_size(weights: DataFrame) -> int:
    """How many texts the target model explains at least as well as the raw one."""
    return weights.where("log_weight >= 0").count()


def threshold(weights: DataFrame, k: int | None = None, temper: float = 1.0) -> float:
    """The k-th largest key: those that reach it are drawn.

    Histograms of the keys narrow the place down, so nothing is sorted and no more
    than a few thousand counts reach the driver.  Keys tied there are all drawn;
    fewer texts with n-grams than k are all drawn.
    """
    k = default_size(weights) if k is None else k
    keys = weights.select(gumbel_key(temper).alias("key")).where("key is not null")
    row = keys.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).head()
    k = min(row.n, k)
    if k <= 0:
        return float("inf")
    low, high, above = row.low, row.high, 0
    while low < high:
        step = (high - low) / 4096
        if step <= 0 or low + step == low:
            break
        bins = keys.where(F.col("key").between(low, high)).groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(4095)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b.bin):
            if above + b.n >= k:
                low, high = b.low, b.high
                break
            above += b.n
        if b.n == 1 or above + b.n == k:
            return low
    return low


def keep_sampled(docs: DataFrame, ratio: Ratio, least: float, id_col: str = "doc_id", text_col: str = "text", temper: float = 1.0) -> DataFrame:
    """The drawn rows with all their columns: those whose key reaches ``least``."""
    at = docs.columns.index(text_col)
    schema = docs.schema
    keyed = docs.select("*", _gumbel(id_col, text_col).alias(f"noise_{uuid.uuid4().hex}"))

    def run(batches):
        for batch in batches:
            noise = batch.column(len(batch.columns) - 1).to_numpy(zero_copy_only=False)
            plain, text = batch.select(list(range(len(batch.columns) - 1))), batch.column(at).cast(pa.string())
            for a, b in slices(text):
                key = ratio.log_weight(*text_bytes(text.slice(a, b - a))) / temper + noise[a:b]
                yield plain.slice(a, b - a).filter(pa.array(key >= least))  # NaN reaches nothing

    return keyed.mapInArrow(run, schema)


def op4_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, temper: float = 1.0) -> DataFrame:
    """The query: doc_id, log_weight, gumbel_key (null: no n-grams) and kept of every
    document."""
    weights = written(importance(docs, train(docs, labels)), "importance")
    least = threshold(weights, k, temper)
    return weights.select("doc_id", "log_weight", gumbel_key(temper).alias("gumbel_key"), F.coalesce(gumbel_key(temper) >= least, F.lit(False)).alias("kept"))
