"""Near-duplicate vectors by spherical-cap filters.

Filter directions are random product codes: the space is rotated at random and
cut into blocks, each with its own random code words, and every combination of
words is a direction.  A vector's filters are all directions whose inner product
with it passes a threshold, found by list decoding block by block (a partial sum
that cannot reach the threshold any more is dropped).  Vectors meet at common
filters and are verified in double precision; a pair counts at its least common
filter only.  The number of directions grows with the number of vectors, so the
number of chance meetings of a vector does not.

Exact copies are one vector with a weight.  A crowded filter is cut into blocks
whose pairs are separate groups.  Groups give counts and the edges of a spanning
forest, never their pairs.

Vectors that are null, empty or zero, or hold a null or non-finite component, and
vectors with a null label link with nothing; vectors of unlike length never link
with each other.  Rows with equal vec_id are separate vectors.  A null vec_id
links, but names no component unless alone.  An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .graph import components

#: Filters a vector has about on average, filters it has at least, blocks of a code,
#: and rows of a crowded filter that are compared at once.
EXPECTED, LEAST, PARTS, CROWD = 12, 9, 4, 1500


class Codes:
    """The filter directions for vectors of one length."""

    def __init__(self, dim: int, vectors: int, seed: int = 5):
        rng = np.random.default_rng([seed, dim])
        self.parts = min(PARTS, dim)
        self.words = int(np.clip(np.ceil((4 * max(1, vectors)) ** (1 / self.parts)), 8, 128))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.parts + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            w = rng.standard_normal((self.words, b - a))
            self.books.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(self.parts))
        share = min(0.5, EXPECTED / self.words**self.parts)
        self.threshold = NormalDist().inv_cdf(1 - share) / np.sqrt(dim)
        self.step = 0.25 / np.sqrt(dim)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters of unit rows.  A row with fewer than LEAST
        gets a lower threshold, step by step."""
        turned = x @ self.turn
        scores = [turned[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)]
        rest = np.cumsum(np.stack([s.max(1) for s in scores], 1)[:, ::-1], 1)[:, ::-1]
        rest = np.concatenate([rest[:, 1:], np.zeros((len(x), 1))], 1)
        todo, threshold = np.arange(len(x)), self.threshold
        rows, codes = [], []
        need = min(LEAST, self.words**self.parts)
        while len(todo):
            owner, code, total = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
            for k, s in enumerate(scores):
                grown = total[:, None] + s[owner]
                at, word = np.nonzero(grown >= (threshold - rest[owner, k])[:, None])
                total, owner, code = grown[at, word], owner[at], code[at] * self.words + word
            enough = np.bincount(owner, minlength=len(x)) >= need
            use = enough[owner]
            rows.append(owner[use])
            codes.append(code[use])
            todo = todo[~enough[todo]]
            threshold -= self.step
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(codes) if codes else np.zeros(0, np.int64)


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    # scaled first, so that neither very large nor very small components overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _valid(vectors: DataFrame) -> DataFrame:
    """All rows: vec_id, label, vec (doubles as bytes; null: links with nothing) and dim."""

    def run(batches):
        for batch in batches:
            vecs, dims = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.zeros(0) if label is None or not v or None in v else np.array(v, "<f8")
                ok = x.any() and np.isfinite(x).all()
                vecs.append((x + 0.0).tobytes() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "label", "vec", "dim"])

    return vectors.mapInArrow(run, "vec_id long, label string, vec binary, dim int")


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row it is connected to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(ids, weight, side, x, filters, least: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside one group (or between the two blocks of one): ids of linked
    vectors, the numbers of rows they link to, and their roots in the group."""
    smaller = [f[f < least] for f in filters]
    known, where = np.unique(np.concatenate(smaller), return_inverse=True)
    met = np.zeros((len(ids), len(known)), np.float32)
    met[np.repeat(np.arange(len(ids)), [len(s) for s in smaller]), where] = 1
    met = met[:, met.sum(0) > 1]
    linked = x @ x.T >= cosine
    if met.shape[1]:
        linked &= (met @ met.T) == 0
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    got = linked @ weight
    use = got > 0
    return ids[use], got[use], ids[_forest(linked)[use]]


#: Groups up to this size are screened together, pair by pair, before any is looked at alone.
SMALL = 40


def _linked_groups(x: np.ndarray, start: np.ndarray, end: np.ndarray, cosine: float) -> np.ndarray:
    """Which of some small groups hold any pair as close as ``cosine``."""
    size = end - start
    row = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    later = np.repeat(end, size) - row - 1
    group = np.repeat(np.repeat(np.arange(len(size)), size), later)
    a = np.repeat(row, later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    out = np.zeros(len(size), bool)
    for at in range(0, len(a), 20_000):
        c = np.einsum("ij,ij->i", x[a[at : at + 20_000]], x[b[at : at + 20_000]])
        out[group[at : at + 20_000][c >= cosine - 1e-9]] = True
    return out


def compare_sorted(cosine: float):
    """Groups of a sorted partition, a batch at a time; a group that a batch cuts
    is carried over."""

    def groups(table: pa.Table):
        columns = [table.column(c).to_numpy() for c in ("place", "dim", "filter", "pair")]
        change = np.ones(len(table), bool)
        change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.flatnonzero(change)

    def work(table: pa.Table, start: np.ndarray):
        ids, weight, side, least = (table.column(c).to_numpy() for c in ("id", "n", "side", "filter"))
        dims = table.column("dim").to_numpy()
        vec, filters = table.column("vec").to_pylist(), table.column("filters").to_pylist()
        end = np.append(start[1:], len(table))
        out = [(np.zeros(0, np.int64),) * 3]
        for dim in np.unique(dims[start]).tolist():
            mine = np.flatnonzero((dims[start] == dim) & (end - start > 1))
            rows = np.flatnonzero(dims == dim)
            place = np.full(len(table), -1)
            place[rows] = np.arange(len(rows))
            x = _unit([vec[r] for r in rows.tolist()])
            small = mine[end[mine] - start[mine] <= SMALL]
            look = set(mine[end[mine] - start[mine] > SMALL].tolist())
            if len(small):
                look |= set(small[_linked_groups(x, place[start[small]], place[end[small] - 1] + 1, cosine)].tolist())
            for g in sorted(look):
                a, b = int(start[g]), int(end[g])
                out.append(compare(ids[a:b], weight[a:b], side[a:b], x[place[a] : place[a] + b - a], [np.frombuffer(f, "<i4") for f in filters[a:b]], int(least[a]), cosine))
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "links", "root"])

    def run(batches):
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table]).combine_chunks()
            if not len(table):
                continue
            start = groups(table)
            left = table.slice(start[-1])
            if len(start) > 1:
                yield work(table.slice(0, start[-1]), start[:-1])
        if left is not None and len(left) > 1:
            yield work(left, np.zeros(1, np.int64))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    valid = _valid(rows).withColumn("key", F.md5(F.concat(F.col("vec"), F.encode(F.col("label"), "UTF-8"))))
    members = written(valid.select("vec_id", "key", "label", "dim", "vec"), "vectors")
    nodes = members.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    # ids are given when the nodes are written, so no two nodes can share one
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "vector-nodes")
    sizes = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}

    def decode(batches):
        made: dict[int, Codes] = {}
        for batch in batches:
            dims = np.array(batch.column(3).to_pylist(), np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in made:
                    made[dim] = Codes(dim, sizes[dim])
                which = np.flatnonzero(dims == dim)
                for at in range(0, len(which), 1024):
                    part = batch.take(pa.array(which[at : at + 1024]))
                    owner, code = made[dim].decode(_unit(part.column(4).to_pylist()))
                    order = np.lexsort((code, owner))
                    code = code[order].astype("<i8")
                    bounds = np.searchsorted(owner[order], np.arange(len(part) + 1))
                    lists = [code[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])]  # 128 ** 4 directions at most
                    arrays = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(code))
                    yield pa.record_batch([*part.columns, pa.array(lists, pa.binary()), arrays], [*batch.schema.names, "filters", "each"])

    coded = written(nodes.select("id", "n", "label", "dim", "vec").mapInArrow(decode, "id long, n long, label string, dim int, vec binary, filters binary, each array<long>"), "vector-filters")
    light = coded.select("id", F.xxhash64("label").alias("place"), "dim", F.explode("each").alias("filter"))
    crowds = light.groupBy("place", "dim", "filter").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    blocks = F.ceil(F.col("crowd") / CROWD).cast("int")
    met = light.join(crowds, ["place", "dim", "filter"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    # a block meets itself and each other block once: group (i, j) with i <= j
    pairs = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("id", "place", "dim", "filter", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") > F.col("other"), 2).otherwise(1).alias("side"))
    heavy = pairs.join(coded.select("id", "n", "vec", "filters"), "id")
    keys = ["place", "dim", "filter", "pair"]
    found = written(heavy.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare_sorted(cosine), "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # only linked nodes have a component; the rest are their own
    linked = written(links.join(components(found.select("id", "root"), "id", "root"), "id").join(nodes.select("id", "rep"), "id"), "linked-vectors")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size"))
    named = spread_join(linked.select("id", "links", "component"), least, "component", "size", linked.count()).select("id", "links", "least", F.lit(True).alias("linked"))
    facts = nodes.select("id", "key", "n", "rep").join(named.hint("merge"), "id", "left").select("key", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    facts = written(facts, "vector-classes")
    rows = members.select("vec_id", "key")
    out = spread_join(rows, facts, "key", "n", members.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """The query: cosine of 0.98 and more, among equal labels."""
    return near_duplicates(vectors)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT r, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  WITH RECURSIVE w(r, s) AS (
    SELECT r, r FROM v UNION SELECT w.r, p.b FROM w JOIN p ON p.a = w.s
  ) SELECT w.r, min(v.vec_id) AS component_id FROM w JOIN v ON v.r = w.s GROUP BY w.r
), d AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, reach.component_id, v.vec_id = reach.component_id AS kept
FROM v LEFT JOIN d ON d.a = v.r LEFT JOIN reach ON reach.r = v.r
"""
