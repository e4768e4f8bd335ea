"""Language identification in two steps: the family, then one-versus-one linear
support vector machines between the languages of that family.

Features are hashed stretches of two and three bytes (ASCII lowered; digits,
marks and white space are one class), square roots of their shares, scaled to
length one.  All machines are linear with squared hinge loss, fitted here.

A text that is null or has no letter is ``und`` with score 0; equal texts get
equal answers; an empty table gives no rows; other columns are ignored.  With one
learned language every text that has a letter gets it; with none, ``und``.

The score only compares learned languages.  ``keep_identified`` with a least score
also holds a text against each language's own texts: the mean log-likelihood of
its stretches, less what that language's texts have, nearer to 0 for short texts.
Texts below a cut fitted on the learned rows are in no learned language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, slices, text_bytes

#: Feature buckets, and the most labelled rows the machines are fitted on.
BUCKETS, FIT_ROWS = 4096, 4000
#: Bytes at which a text's likelihood counts by half; the share of learned rows below
#: the quantile that the cut is fitted to, and how many times as far out the cut is.
HALF_BYTES, OUTER, BEYOND = 50, 0.001, 1.6
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is"), "romance": ("fr", "es", "it", "pt", "ro", "ca"), "slavic": ("ru", "pl", "cs", "uk", "sk", "bg", "sr", "hr")}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BUCKETS float32 per text."""
    docs = len(offsets) - 1
    low = _FOLD[raw]
    total = np.zeros((docs, BUCKETS), np.float32)
    if len(raw) > 1:
        two = low[:-1] << 8 | low[1:]
        owner = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets)) * BUCKETS
        three = two[:-1] << 8 | low[2:]
        plain = low == 32
        for code, width, seed in ((two, 2, 0x9E3779B1), (three, 3, 0x85EBCA77)):
            bucket = (code * np.uint32(seed)) >> np.uint32(20)
            inside = np.ones(len(code), bool)
            for k in range(1, width):
                edge = offsets[1:-1] - k
                inside[edge[(edge >= 0) & (edge < len(code))]] = False
            blank = plain[: len(code)].copy()
            for k in range(1, width):
                blank &= plain[k : k + len(code)]
            inside &= ~blank
            total += np.bincount(owner[: len(code)][inside] + bucket[inside], minlength=docs * BUCKETS).reshape(docs, BUCKETS)
    np.sqrt(total, out=total)
    total /= np.maximum(np.sqrt((total * total).sum(1, keepdims=True)), 1e-9)
    return total


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, weight: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a linear machine for y in -1, +1; the classes
    count alike.  Accelerated gradient steps on the squared hinge loss."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    rate = np.float32(0.25)
    for k in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * share * y
        step = v + 2 * rate * np.append(miss @ x, miss.sum()).astype(np.float32) - 2 * rate * weight * v
        v = step + np.float32(k / (k + 3)) * (step - w)
        w = step
    return w


@dataclass
class Model:
    """Machines by pair: between families, and between the languages of each."""

    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]
    #: Log-likelihoods of the buckets and what own texts have on average, by language.
    profiles: list[tuple[np.ndarray, float]] = field(default_factory=list)
    cut: float = -np.inf

    def familiar(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether texts are like those of some learned language."""
        off = [_off(x, sizes, logs, usual) for logs, usual in self.profiles]
        return np.max(off, axis=0) >= self.cut if off else np.ones(len(x), bool)

    def _vote(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of all pairs (votes, then margins), and its certainty."""
        wins = np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), np.inf)
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                w = self.between[a, names[j]]
                m = x @ w[:-1] + w[-1]
                wins[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                wins[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = wins.argmax(1)
        margin = least[np.arange(len(x)), best]
        return best, np.where(np.isinf(margin), 1.0, 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30))))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        if not names:
            return ["und"] * len(x), np.zeros(len(x))
        family, score = self._vote(x, names)
        out = [""] * len(x)
        for k, name in enumerate(names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                langs = self.families[name]
                best, sure = self._vote(x[rows], langs)
                score[rows] *= sure
                for r, b in zip(rows.tolist(), best.tolist()):
                    out[r] = langs[b]
        return out, score


def _logs(x: np.ndarray) -> np.ndarray:
    """Log-likelihoods of the buckets in texts; a tenth of a text is spread evenly."""
    return np.log(((x * x).sum(0, dtype=np.float64) + 0.1 / BUCKETS) / (len(x) + 0.1)).astype(np.float32)


def _off(x: np.ndarray, sizes: np.ndarray, logs: np.ndarray, usual: float) -> np.ndarray:
    return ((x * x) @ logs - usual) * (sizes / (sizes + HALF_BYTES))


def fit_profiles(x: np.ndarray, langs: list[str], sizes: np.ndarray) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Profiles of the languages, and the cut: rows are held against profiles of the
    halves of all languages that they aren't in, and the nearest language counts."""
    own, names = np.array(langs, object), sorted(set(langs))
    half = np.zeros(len(x), int)
    for c in names:
        half[own == c] = np.arange((own == c).sum()) % 2
    profiles, off = [], np.full(len(x), -np.inf)
    for c in names:
        mine, usual = own == c, 0.0
        halves = [_logs(x[mine & (half != k)]) for k in (0, 1)]
        for k, logs in enumerate(halves):
            rows = x[mine & (half == k)]
            usual += float(((rows * rows) @ logs).sum()) / mine.sum()
        for k, logs in enumerate(halves):
            off[half == k] = np.maximum(off[half == k], _off(x[half == k], sizes[half == k], logs, usual))
        profiles.append((_logs(x[mine]), usual))
    return profiles, BEYOND * min(0.0, float(np.quantile(off, OUTER)))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Machines for the languages found; one of no known family is its own."""
    family_of = {c: name for name, codes in FAMILIES.items() for c in codes}
    families: dict[str, list[str]] = {}
    for c in sorted(set(langs)):
        families.setdefault(family_of.get(c, c), []).append(c)
    between: dict[tuple[str, str], np.ndarray] = {}

    def pairs(names: list[str], owner: np.ndarray) -> None:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                rows = np.flatnonzero((owner == a) | (owner == b))
                between[a, b] = fit_svm(x[rows], np.where(owner[rows] == a, 1, -1).astype(np.float32))

    own = np.array(langs, object)
    pairs(sorted(families), np.array([family_of.get(c, c) for c in langs], object))
    for codes in families.values():
        pairs(codes, own)
    return Model(families, between)


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` ids of rows that may be learned from, the same ones each
    time: those whose hashes are least."""
    rows = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return rows.select("doc_id", F.col(label).alias("label")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id", "label").limit(most)


def train(docs: DataFrame, lang_col: str = "lang", most: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of labelled documents (whole texts); their features
    are made by the executors, and only these reach the driver."""
    ids = labelled_sample(docs.select("doc_id", F.col(f"`{lang_col}`").cast("string").alias("lang")), "lang", most)
    rows = id_and_text(docs).join(F.broadcast(ids), "doc_id").select("label", "text")

    def run(batch: pa.RecordBatch):
        for a, b in slices(batch.column(1), 1_000_000, 500):
            x = features(*text_bytes(batch.column(1).slice(a, b - a)))
            sizes = pa.array(np.diff(text_bytes(batch.column(1).slice(a, b - a))[1]), pa.int64())
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), sizes], ["label", "x", "size"])

    got = sorted((r.label, bytes(r.x), r.size) for r in map_arrow(rows, run, "label string, x binary, size long").collect())
    if not got:
        return Model({}, {})
    x, langs = np.stack([np.frombuffer(x, np.float16).astype(np.float32) for _, x, _ in got]), [c for c, _, _ in got]
    model = fit(x, langs)
    model.profiles, model.cut = fit_profiles(x, langs, np.array([n for _, _, n in got]))
    return model


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict(model: Model, column: pa.Array, reject: bool = False) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column; ``reject``: a text that is like
    no learned language's has score 0."""
    langs: list[str] = []
    scores = [np.zeros(0)]
    for a, b in slices(column, 1_000_000, 500):
        raw, offsets = text_bytes(column.slice(a, b - a))
        x = features(raw, offsets)
        found, score = model.predict(x)
        if reject:
            score[~model.familiar(x, np.diff(offsets))] = 0.0
        for i in np.flatnonzero(~has_letter(raw, offsets)).tolist():
            found[i], score[i] = "und", 0.0
        langs += found
        scores.append(score)
    return langs, np.concatenate(scores)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = predict(model, batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(id_and_text(docs), run, "doc_id long, lang_pred string, score double")


def op8_language(docs: DataFrame) -> DataFrame:
    """The query: doc_id, held_out, lang_pred, score."""
    found = classify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language, with a score above ``least``; all columns stay.
    With a least score, texts in no learned language go, whatever the machines say."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            langs, scores = predict(model, batch.column(at).cast(pa.string()), bool(least))
            yield batch.filter(pa.array([c != "und" for c in langs]) if not least else pa.array([c != "und" and s > least for c, s in zip(langs, scores.tolist())]))

    return docs.mapInArrow(run, docs.schema)
