"""Near-duplicate texts by SimHash.

The code of a text is 256 signs of the sums of its distinct words' hashes (ASCII
lowered, marks apart), so the share of unlike bits of two texts estimates the
angle between their sets of words.  Two documents are linked if their codes
differ in at most RADIUS bits.  Documents of one code are one node with a weight:
exact copies and texts that differ in case or marks only are never compared.

Codes meet under masks of their bits; a pair is verified where its bits agree first
and counted there only.  The masks cover the radius: two codes within it agree under
one of them, whatever bits they differ in, so no link is lost at any size.
``search="scan"`` cuts the nodes into blocks; a task holds two blocks (or one) and a
share of the masks, sorts the codes into buckets by their bits under each mask and
compares all codes of a bucket, so a node isn't sent once for each mask.  The masks
are those that cost least on a sample of the codes; where none pays, as with few nodes
or many codes close together, a task compares all codes of its blocks.
``search="graph"`` sends nodes to shards, one for each mask (few nodes make one shard),
and searches a navigable small world there with beams that grow until an
audit against exact search is passed (RECALL of the links, so some may be lost), and
scans the shard if none passes (see README for why scanning is the default).  A crowded shard is cut into blocks
whose pairs are separate groups.  Groups give counts and the edges of a spanning
forest, never their pairs.

Texts without words go by their marks.  Null, empty and blank texts link with nothing and stand alone; rows with
equal ids or null ids are separate documents, repeated rows are copies; each class
keeps one row, that of the least id (null ids come last; of rows with equal ids that
of the least code, then any).  A class of null ids has a null class_id.  An empty
table gives no rows; other columns are ignored by ``near_duplicates`` and kept by
``keep_one``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import id_and_text, map_arrow, slices, spread_join, text_bytes, written
from .graph import components
from .words import WORD, mix, tokens

#: Bits of a code, unlike bits of a link at most, nodes to a shard about.
BITS, RADIUS, SHARD = 256, 46, 4096
#: What choosing the masks goes by: seconds to send a node once and to compare a
#: pair, and the share of bits that unlike texts have alike.
SENT, COMPARED, ALIKE = 5e-6, 2e-9, 0.53
#: Nodes to a block that is searched by masks, about; the same for such a search: seconds
#: to sort a node into its bucket and to compare a pair of a bucket; codes looked at to choose.
BLOCK, SORTED, MET, SEEN = 1 << 18, 4e-8, 1e-8, 20_000
#: A bucket with more codes is compared in tiles.
CROWD = 96
#: Crowded shards whose list is broadcast at most (24 bytes each).
LISTED = 100_000
#: Partitions of pairs of blocks at most; beyond, a partition has several, one after the other.
TASKS = 20_000
#: Share of the links of audited nodes that ``search="graph"`` must find in a shard.
RECALL = 0.9
_WORDS = BITS // 64
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_ODD = _SEEDS | np.uint64(1)


def codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of uint64) of texts, and whether each has any word or mark."""
    docs = len(offsets) - 1
    t = tokens(raw, offsets)
    word = t.kind == WORD
    wordless = np.bincount(t.doc()[word], minlength=docs) == 0
    word |= wordless[t.doc()]  # texts of marks alone go by their marks
    # doc in the upper bits: one sort puts the distinct words of each document together
    key = np.unique(t.doc()[word].astype(np.uint64) << np.uint64(40) | t.hashes()[word] >> np.uint64(24))
    owner, h = (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)
    bounds = np.searchsorted(owner, np.arange(docs + 1))
    sums = np.zeros((docs, BITS), np.int32)
    at = 0
    while at < docs:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 20_000, "right")) - 1)
        a, b = bounds[at], bounds[end]
        full = np.flatnonzero(np.diff(bounds[at : end + 1])) + at
        if len(full):
            each = mix(mix(h[a:b])[:, None] ^ _SEEDS)
            bits = np.unpackbits(each.view(np.uint8).reshape(-1, BITS // 8), axis=1)
            # eight bits to a word, each a byte of it, which holds the sum of 255 rows
            first, n = bounds[full] - a, np.diff(bounds)[full]
            runs = -(-n // 255)
            begin = np.cumsum(runs) - runs
            run = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(begin, runs))
            some = np.add.reduceat(bits.view(np.uint64), run, axis=0).view(np.uint8)
            sums[full] = np.add.reduceat(some, begin, axis=0, dtype=np.int32)
        at = end
    size = np.diff(bounds)
    signs = np.packbits(2 * sums > size[:, None], axis=1)
    return np.ascontiguousarray(signs).view(np.uint64).reshape(docs, _WORDS), size > 0


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unlike bits of all rows of x and all rows of y."""
    out = np.bitwise_count(x[:, :1] ^ y[None, :, 0]).astype(np.uint16)
    for k in range(1, x.shape[1]):
        out += np.bitwise_count(x[:, k : k + 1] ^ y[None, :, k])
    return out


def cover_parts(parts: int, radius: int, seed: int = 9) -> list[np.ndarray]:
    """Bit masks (tables x words) of each of several parts of the bits, of which one
    misses all bits that two codes within the radius differ in.

    Each part has a number of unlike bits that it bears; these and one more for each
    part add up to radius + 1, so one part has no more than it bears.  In a part that
    bears r each bit has a vector of r + 1 binary digits, and there is a mask for each
    vector but zero, of the bits whose product with it is odd: r vectors leave some
    vector whose products with all of them are even.  Of several draws of vectors
    the one whose masks have the most even sizes is taken.
    """
    bears = np.full(parts, radius // parts)
    bears[radius % parts + 1 :] -= 1
    rng = np.random.default_rng([seed, parts])
    found = []
    for within, bits in zip(bears.tolist(), np.array_split(np.arange(BITS), parts)):
        if within < 0:  # other parts bear the radius alone
            continue
        vectors = np.arange(1, 2 << within)
        least = np.inf
        for k in range(64):
            # vectors that all begin with 1 give masks of half of the bits each, if they are enough
            drawn = rng.permutation(vectors[vectors >= 1 << within] if k % 2 and len(bits) <= 1 << within else vectors)
            mask = np.zeros((len(vectors), BITS), np.uint8)
            mask[:, bits] = np.bitwise_count(vectors[:, None] & np.resize(drawn, len(bits))) & 1
            if (cost := (ALIKE ** mask.sum(1)).sum()) < least:
                best, least = mask, cost
        found.append(np.packbits(best, axis=1).view(np.uint64).reshape(-1, _WORDS))
    return found


def cover(parts: int, radius: int, seed: int = 9) -> np.ndarray:
    """The masks of all parts (tables x words)."""
    return np.concatenate(cover_parts(parts, radius, seed))


def samples(nodes: int, radius: int = RADIUS) -> np.ndarray:
    """Bit masks (tables x words): how nodes are sent to shards for ``search="graph"``.

    One mask of no bits, so that all nodes are one shard, or the cover that costs
    less: more masks of more bits each as the nodes grow.
    """
    best = np.zeros((1, _WORDS), np.uint64)
    least = -(-nodes // (4 * SHARD)) * SENT + nodes / 2 * COMPARED
    for parts in (24, 16, 12, 10, 8, 7):
        if (parts * (2 << radius // parts)) * SENT >= 2 * least:
            continue
        masks = cover(parts, radius)
        cost = len(masks) * SENT + nodes / 2 * COMPARED * (ALIKE ** np.bitwise_count(masks).sum(1)).sum()
        if cost < least:
            best, least = masks, cost
    return best


def _buckets(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """16 bits of a hash of each code's bits under the mask; words x codes."""
    h = np.zeros(words.shape[1], np.uint64)
    for k in np.flatnonzero(mask):
        h += (words[k] & mask[k]) * _ODD[k]
    return ((h ^ h >> np.uint64(29)) * _ODD[0] >> np.uint64(48)).astype(np.uint16)


def block_masks(seen: np.ndarray, nodes: int, radius: int = RADIUS) -> list[np.ndarray]:
    """Masks by part for blocks of so many nodes, of which ``seen`` is a sample: the
    cover that costs least, or one mask of no bits if comparing all pairs costs less.

    The pairs of a bucket are counted on the sample, so large groups of close codes,
    which meet under most masks, count as what they cost."""
    best, least = [np.zeros((1, _WORDS), np.uint64)], nodes / 2 * COMPARED
    words, n = np.ascontiguousarray(seen.T), len(seen)
    for parts in (24, 16, 12, 10, 8, 7):
        if n < 2 or parts * (1 << radius // parts) * SORTED >= least:
            continue
        masks = cover_parts(parts, radius)
        total = sum(len(m) for m in masks)
        tried = np.concatenate(masks)[:: max(1, total // 40)]
        share = sum((c * (c - 1.0)).sum() for c in (np.bincount(_buckets(words, m), minlength=1 << 16) for m in tried)) / (n * (n - 1.0))
        cost = total * (SORTED + nodes / 2 * share / len(tried) * MET)
        if cost < least:
            best, least = masks, cost
    return best


def mask_pairs(p: np.ndarray, q: np.ndarray, mask: np.ndarray, radius: int, portion: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a code of p and one of q (words x codes) within the radius that
    agree under the mask, and some that don't; of p alone, each once, if q is p."""
    same = q is p
    order = np.argsort(np.bitwise_count(mask), kind="stable")  # words of few masked bits tell most

    def laid(words: np.ndarray):
        key = _buckets(words, mask)
        by = key.argsort(kind="stable")
        return by, words[order[0]][by], words[order[1]][by], np.bincount(key, minlength=1 << 16)

    by_p, p0, p1, in_p = laid(p)
    by_q, q0, q1, in_q = (by_p, p0, p1, in_p) if same else laid(q)
    end_p, end_q = np.cumsum(in_p), np.cumsum(in_q)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # small buckets: the partners of each code of p are a range of q, many ranges at a time
    small = in_q <= CROWD
    low = np.arange(1, len(by_p) + 1) if same else np.repeat(end_q - in_q, in_p)
    each = np.maximum(np.repeat(np.where(small, end_q, 0), in_p) - low, 0)
    ends = np.cumsum(each)
    start, total = 0, int(ends[-1]) if len(ends) else 0
    for end in np.searchsorted(ends, np.arange(portion, total + portion, portion)) + 1:
        end = min(int(end), len(each))
        if end <= start:
            continue
        c = each[start:end]
        base = int(ends[start] - c[0])
        i = np.repeat(np.arange(start, end), c)
        j = (low[start:end] - (ends[start:end] - c - base))[i - start]
        j += np.arange(len(i))
        h = np.bitwise_count(p0[i] ^ q0[j])
        h += np.bitwise_count(p1[i] ^ q1[j])
        near = np.flatnonzero(h <= radius)
        left.append(i[near])
        right.append(j[near])
        start = end
    unlike, half, more = np.empty(portion, np.uint64), np.empty(portion, np.uint8), np.empty(portion, np.uint8)
    for k in np.flatnonzero(~small & (in_p > 0)).tolist():
        first, last = int(end_p[k] - in_p[k]), int(end_p[k])
        for column in range(int(end_q[k] - in_q[k]), int(end_q[k]), 4096):
            after = min(int(end_q[k]), column + 4096)
            high = max(1, min(portion // (after - column), max(16, (last - first) // 4)))
            for at in range(first, last, high):
                to = min(at + high, last)
                begin = max(column, at + 1) if same else column
                if begin >= after:
                    break
                shape = to - at, after - begin
                u, h, m = (b[: shape[0] * shape[1]].reshape(shape) for b in (unlike, half, more))
                np.bitwise_count(np.bitwise_xor(p0[at:to, None], q0[begin:after], out=u), out=h)
                h += np.bitwise_count(np.bitwise_xor(p1[at:to, None], q1[begin:after], out=u), out=m)
                i, j = np.divmod(np.flatnonzero(h <= radius), shape[1])
                use = j + begin > i + at if same else slice(None)
                left.append(i[use] + at)
                right.append(j[use] + begin)
    a, b = by_p[np.concatenate(left)], by_q[np.concatenate(right)]
    d = np.zeros(len(a), np.uint16)
    for k in range(_WORDS):
        d += np.bitwise_count(p[k][a] ^ q[k][b])
    use = d <= radius
    return a[use], b[use]


def first_met(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, masks: list[np.ndarray], part: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of p and q those that the mask, number ``at`` of its part, brings
    together, and none before it."""

    def none(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        unlike = np.zeros(len(of), np.uint64)
        for k in np.flatnonzero(mask):
            unlike |= (p[k][a[of]] ^ q[k][b[of]]) & mask[k]
        return unlike == 0

    rows = np.arange(len(a))
    rows = rows[none(masks[part][at], rows)]
    for before in masks[:part]:  # no more unlike bits in a part than it bears: they met there
        bits, unlike = np.bitwise_or.reduce(before), np.zeros(len(rows), np.uint16)
        for k in np.flatnonzero(bits):
            unlike += np.bitwise_count((p[k][a[rows]] ^ q[k][b[rows]]) & bits[k])
        rows = rows[unlike >= int(len(before)).bit_length()]
    for mask in [*masks[part][:at], *(m for before in masks[:part] for m in before)]:
        if not len(rows):
            break
        rows = rows[~none(mask, rows)]
    return a[rows], b[rows]


def block_pairs(x: np.ndarray, side: np.ndarray, masks: list[np.ndarray], radius: int, share: int = 0, shares: int = 1, most: int = 1 << 18):
    """All pairs of rows within the radius, of unlike sides if there are two, that meet
    first under one of every ``shares``-th mask, in portions."""
    if not masks[0].any():
        yield from _scan(x, side, radius)
        return
    one = np.flatnonzero(side == 1) if side.any() else np.arange(len(x))
    two = np.flatnonzero(side == 2) if side.any() else one
    p = np.ascontiguousarray(x[one].T)
    q = np.ascontiguousarray(x[two].T) if side.any() else p
    left, right, held = [], [], 0
    for part, at in [(part, at) for part, own in enumerate(masks) for at in range(len(own))][share::shares]:
        a, b = first_met(p, q, *mask_pairs(p, q, masks[part][at], radius), masks, part, at)
        left.append(one[a])
        right.append(two[b])
        held += len(a)
        if held >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


class SmallWorld:
    """A navigable small world of codes: every node is joined to the nearest that
    a beam search found when it came, those to it, and some at random."""

    def __init__(self, points: np.ndarray, degree: int = 12, beam: int = 24, seed: int = 1):
        self.points = points
        n = len(points)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, 2 * degree), -1, np.int32)
        self.length = np.full((n, 2 * degree), 9999, np.uint16)  # of each edge; no edge is longest
        self.far = rng.integers(0, max(1, n), (n, 2)).astype(np.int32)
        self.entries = rng.permutation(n)[:16]
        first = min(n, 128)
        order = np.concatenate([self.entries, np.setdiff1d(np.arange(n), self.entries)])
        self._join(order[:first], order[:first], degree)
        at = first
        self.known = np.zeros(n, bool)
        self.known[order[:first]] = True
        while at < n:
            batch = order[at : min(n, 2 * at)]
            near, _ = self.search(points[batch], beam)
            for k in range(degree):
                self._add(batch, near[:, k])
            self.known[batch] = True
            at += len(batch)
        self.known[:] = True

    def _join(self, a: np.ndarray, b: np.ndarray, degree: int) -> None:
        near = distances(self.points[a], self.points[b]).argsort(1, kind="stable")[:, 1 : degree + 1]
        for k in range(near.shape[1]):
            self._add(a, b[near[:, k]])

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        ok = (b >= 0) & (a != b)
        for x, y in ((a[ok], b[ok]), (b[ok], a[ok])):
            x, first = np.unique(x, return_index=True)
            y = y[first]
            new = (self.edges[x] != y[:, None]).all(1)
            x, y = x[new], y[new]
            d = np.bitwise_count(self.points[x] ^ self.points[y]).sum(1, dtype=np.uint16)
            slot = self.length[x].argmax(1)  # a free place, or the farthest neighbour's
            use = d < self.length[x, slot]
            self.edges[x[use], slot[use]], self.length[x[use], slot[use]] = y[use], d[use]

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query, and their distances."""
        q, n = len(queries), len(self.points)
        ids = np.full((q, beam), -1, np.int32)
        dist = np.full((q, beam), 9999, np.uint16)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, n), bool)
        new = np.broadcast_to(self.entries.astype(np.int32), (q, len(self.entries)))
        rows = np.arange(q)
        while len(rows):
            new = np.sort(new, 1)
            ok = (new >= 0) & self.known[new] & ~seen[rows[:, None], new]
            ok[:, 1:] &= new[:, 1:] != new[:, :-1]
            at, k = np.nonzero(ok)
            seen[rows[at], new[at, k]] = True
            d = np.bitwise_count(self.points[new] ^ queries[rows][:, None, :]).sum(2, dtype=np.uint16)
            d[~ok] = 9999
            all_d = np.concatenate([dist[rows], d], 1)
            best = all_d.argsort(1, kind="stable")[:, :beam]
            dist[rows] = np.take_along_axis(all_d, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(ok, new, -1)], 1), best, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], ~ok], 1), best, 1)
            rows = rows[~done[rows].all(1)]
            nxt = (~done[rows]).argmax(1)
            done[rows, nxt] = True
            node = ids[rows, nxt]
            new = np.concatenate([self.edges[node], self.far[node]], 1)
        return ids, dist


def _scan(x: np.ndarray, side: np.ndarray, radius: int, most: int = 1 << 20):
    """All pairs of rows within the radius, of unlike sides if there are two, in
    portions.  Half of the bits rule most pairs out; tiles stay in the cache."""
    high, wide = 16, 4096
    one = np.flatnonzero(side == 1) if side.any() else np.arange(len(x))
    two = np.flatnonzero(side == 2) if side.any() else one
    p, q = np.ascontiguousarray(x[one].T), np.ascontiguousarray(x[two].T)
    unlike, half, more = np.empty(high * wide, np.uint64), np.empty(high * wide, np.uint8), np.empty(high * wide, np.uint8)
    left, right, held = [], [], 0
    for at in range(0, len(one), high):
        rows = p[:, at : at + high]
        for start in range(0 if side.any() else at, len(two), wide):
            columns = q[:, start : start + wide]
            shape = rows.shape[1], columns.shape[1]
            u, h, m = (k[: shape[0] * shape[1]].reshape(shape) for k in (unlike, half, more))
            np.bitwise_count(np.bitwise_xor(rows[0][:, None], columns[0], out=u), out=h)
            h += np.bitwise_count(np.bitwise_xor(rows[1][:, None], columns[1], out=u), out=m)
            near = np.flatnonzero(h <= radius)
            a, b = np.divmod(near, shape[1])
            d = h.ravel()[near].astype(np.uint16)
            for k in range(2, _WORDS):
                d += np.bitwise_count(rows[k][a] ^ columns[k][b])
            use = d <= radius
            if not side.any():
                use &= b + start > a + at
            if use.any():
                left.append(one[a[use] + at])
                right.append(two[b[use] + start])
                held += len(left[-1])
            if held >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def scan_pairs(x: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within the radius, of unlike sides if there are two."""
    parts = [(np.zeros(0, int), np.zeros(0, int)), *_scan(x, side, radius)]
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def graph_pairs(x: np.ndarray, side: np.ndarray, radius: int, least: float = 0.995, audit: int = 64, beams: tuple[int, ...] = (32, 64, 128, 256)) -> tuple[np.ndarray, np.ndarray]:
    """The same by searching a small world.  Beams grow until queries that do have
    links, ``audit`` of them, find ``least`` of these (their own rows don't count) and
    no beam is full of hits; if none does, or too few links are seen to tell, all
    codes are scanned."""
    if len(x) <= max(beams):
        return scan_pairs(x, side, radius)
    probe = np.random.default_rng(2).permutation(len(x))[: 16 * audit]
    exact = distances(x[probe], x) <= radius
    exact[np.arange(len(probe)), probe] = False
    linked = np.flatnonzero(exact.any(1))[:audit]
    probe, links = probe[linked], int(exact[linked].sum())
    if links < audit // 4:
        return scan_pairs(x, side, radius)
    world = SmallWorld(x)
    for beam in beams:
        ids, dist = world.search(x[probe], beam)
        hit = (dist <= radius) & (ids != probe[:, None])
        if hit.sum() >= least * links and not (dist <= radius).all(1).any():
            ids, dist = world.search(x, beam)
            row, k = np.nonzero((dist <= radius) & (ids >= 0))
            a, b = np.minimum(row, ids[row, k]), np.maximum(row, ids[row, k])
            use = (a < b) & ((side[a] != side[b]) if side.any() else True)
            pair = np.unique(a[use].astype(np.int64) * len(x) + b[use])
            if not (dist <= radius).all(1).any():
                return pair // len(x), pair % len(x)
    return scan_pairs(x, side, radius)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is connected to by pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _linked(ids: np.ndarray, weight: np.ndarray, pairs) -> pa.RecordBatch:
    """Counts and a spanning forest's edges of portions of pairs of rows."""
    links, root = np.zeros(len(ids)), np.arange(len(ids))
    for a, b in pairs:
        links += np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        root = roots(len(ids), np.concatenate([a, moved]), np.concatenate([b, root[moved]]))
    use = links > 0
    return pa.record_batch([pa.array(ids[use]), pa.array(links[use].astype(np.int64)), pa.array(ids[root[use]])], ["id", "links", "root"])


def _in_groups(keys: tuple[str, ...], work):
    """``work`` on each group of a sorted partition, one at a time; a group that a batch
    cuts is carried over."""

    def run(batches):
        parts: list[pa.Table] = []
        now = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            columns = [table.column(c).to_numpy() for c in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(table)]):
                key = tuple(int(c[a]) for c in columns)
                if key != now and parts:
                    yield work(pa.concat_tables(parts).combine_chunks())
                    parts = []
                now = key
                parts.append(table.slice(a, b - a))
        if parts:
            yield work(pa.concat_tables(parts).combine_chunks())

    return run


def _graph_search(nodes: DataFrame, total: int, radius: int) -> DataFrame:
    """id, links and root of linked nodes, found in shards of the masks."""
    masks = samples(total, radius)
    block = 2 * SHARD

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, _WORDS)
        shard = np.stack([mix((code & m)[:, 0] ^ mix((code & m)[:, 1] ^ mix((code & m)[:, 2] ^ mix((code & m)[:, 3])))).view(np.int64) for m in masks], 1)
        take = np.repeat(np.arange(len(batch)), len(masks))
        return pa.record_batch([*(c.take(pa.array(take)) for c in batch.columns), pa.array(np.tile(np.arange(len(masks), dtype=np.int32), len(batch))), pa.array(shard.ravel())], ["id", "n", "code", "sample", "shard"])

    def work(table: pa.Table) -> pa.RecordBatch:
        ids, weight, side = (table.column(c).to_numpy() for c in ("id", "n", "side"))
        at = table.column("sample")[0].as_py()
        x = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(-1, _WORDS)
        a, b = graph_pairs(x, side, radius, RECALL)
        unlike, first = x[a] ^ x[b], np.ones(len(a), bool)
        for mask in masks[:at]:  # an earlier mask brought the pair together already
            first &= ((unlike & mask) != 0).any(1)
        return _linked(ids, weight, [(a[first], b[first])])

    sent = map_arrow(nodes.select("id", "n", "code"), send, "id long, n long, code binary, sample int, shard long")
    # only crowded shards are cut; their list is sent to all tasks while it is short, else joined
    hot = written(sent.groupBy("sample", "shard").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > block), "crowded-shards")
    listed = F.broadcast(hot) if hot.count() <= LISTED else hot.hint("merge")
    blocks = F.ceil(F.coalesce("crowd", F.lit(1)) / block).cast("int")
    met = sent.join(listed, ["sample", "shard"], "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    # a block meets itself and each other block once
    pairs = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("id", "n", "code", "sample", "shard", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") > F.col("other"), 2).otherwise(1).alias("side"))
    keys = ("sample", "shard", "pair")
    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_in_groups(keys, work), "id long, links long, root long")


def _scan_search(nodes: DataFrame, total: int, radius: int) -> DataFrame:
    """id, links and root of linked nodes, all of them: each two blocks of nodes and
    each share of the masks are a task."""
    step = max(1, total // SEEN)
    seen = nodes.where(F.pmod(F.xxhash64("code", F.lit(5)), F.lit(step)) == 0).select("code").toArrow().column("code").to_pylist()
    masks = block_masks(np.frombuffer(b"".join(seen), np.uint64).reshape(-1, _WORDS), min(total, BLOCK), radius)
    many = sum(len(m) for m in masks)
    blocks = max(1, -(-total // (BLOCK if masks[0].any() else 4 * SHARD)))
    pairs = blocks * (blocks + 1) // 2
    # masks are shared out while there are fewer pairs of blocks than cores need
    shares = min(-(-3 * nodes.sparkSession.sparkContext.defaultParallelism // pairs), -(-many // 16))

    def pack(batch: pa.RecordBatch):
        for at in range(0, len(batch), 1024):  # a slice is one row and goes to one block
            ids, n, code = batch.slice(at, 1024).columns
            ids = ids.to_numpy()
            own = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(blocks))
            yield pa.record_batch([pa.array([own], pa.int64()), pa.array([np.diff(ids, prepend=0).tobytes()]), pa.array([n.to_numpy().tobytes()]), pa.array([b"".join(code.to_pylist())])], ["own", "steps", "n", "codes"])

    def work(table: pa.Table) -> pa.RecordBatch:
        steps, n, codes = (table.column(c).to_pylist() for c in ("steps", "n", "codes"))
        ids = np.concatenate([np.cumsum(np.frombuffer(s, np.int64)) for s in steps])
        side = np.repeat(table.column("side").to_numpy(), [len(s) // 8 for s in steps])
        x = np.frombuffer(b"".join(codes), np.uint64).reshape(-1, _WORDS)
        return _linked(ids, np.frombuffer(b"".join(n), np.int64), block_pairs(x, side, masks, radius, table.column("task")[0].as_py() % shares, shares))

    packed = map_arrow(nodes.select("id", "n", "code"), pack, "own long, steps binary, n binary, codes binary")
    met = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pair = F.shiftright(high * (high + 1), 1) + low
    sides = met.select("steps", "n", "codes", pair.alias("pair"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") > F.col("other"), 2).otherwise(1).alias("side"))
    sent = sides.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")).select((F.col("pair") * shares + F.col("share")).alias("task"), "side", "steps", "n", "codes")
    parts = min(pairs * shares, TASKS)
    return sent.repartitionById(parts, F.pmod("task", F.lit(parts)).cast("int")).sortWithinPartitions("task").mapInArrow(_in_groups(("task",), work), "id long, links long, root long")


def _packed(text: pa.Array) -> pa.Array:
    code, some = codes(*text_bytes(text))
    return pa.array([c.tobytes() if s else None for c, s in zip(code, some.tolist())], pa.binary())


def code_table(docs: DataFrame) -> DataFrame:
    """doc_id and code (null: blank) of every whole text."""

    def run(batch: pa.RecordBatch):
        for a, b in slices(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(a, b - a), _packed(batch.column(1).slice(a, b - a))], ["doc_id", "code"])

    return map_arrow(id_and_text(docs), run, "doc_id long, code binary")


def _classes(table: DataFrame, radius: int, search: str) -> DataFrame:
    """doc_id, row, n_links, class_id and kept of a written table of doc_id, row (no
    two alike) and code."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    # ids are given when the nodes are written, so no two nodes can share one
    nodes = written(table.where("code is not null").groupBy("code").agg(first, F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "code-nodes")
    found = written({"scan": _scan_search, "graph": _graph_search}[search](nodes, nodes.count(), radius), "code-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = F.struct("first.unnamed", "first.doc_id", "code", "first.row").alias("own")
    # only linked nodes have a component; the rest are their own
    linked = written(links.join(components(found.select("id", "root"), "id", "root"), "id").join(nodes.select("id", own), "id"), "linked-nodes")
    least = linked.groupBy("component").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("size"))
    named = spread_join(linked.select("id", "links", "component"), least, "component", "size", linked.count()).select("id", "links", "least")
    facts = nodes.select("id", "code", "n", own).join(named.hint("merge"), "id", "left").select("code", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "own").alias("least"))
    facts = written(facts.select("code", "n", (F.col("n") - 1 + F.col("links")).cast("long").alias("n_links"), F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("stays")), "code-classes")
    rows = table.select("doc_id", "row", "code")
    out = spread_join(rows, facts, "code", "n", table.count()).select("doc_id", "row", "n_links", "class_id", (F.col("row") == F.col("stays")).alias("kept"))
    blank = rows.where("code is null").select("doc_id", "row", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(blank)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, search: str = "scan") -> DataFrame:
    """One row per document: doc_id, n_links (other documents linked to it
    directly), class_id (least id that links reach, itself included), kept (one row
    of each class)."""
    table = written(code_table(docs).withColumn("row", F.monotonically_increasing_id()), "codes")
    return _classes(table, radius, search).drop("row")


def op9_simhash_dedup(docs: DataFrame) -> DataFrame:
    """The query: classes of near-duplicate documents."""
    return near_duplicates(docs)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each class.

    Rows are numbered when they are written beside their codes, and leave by that
    number, so equal ids, null ids and repeated rows are told apart and no key is
    crowded.  The join is by sorting at every size: the list of rows to go grows with
    the corpus, so a plan that sends it to all tasks would only hold for small ones.
    """
    row, code = (f"{name}_{uuid.uuid4().hex}" for name in ("row", "code"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            for a, b in slices(text):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, _packed(text.slice(a, b - a))], [*batch.schema.names, code])

    schema = StructType([*numbered.schema.fields, StructField(code, BinaryType())])
    coded = written(numbered.mapInArrow(run, schema), "coded")
    table = coded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(row).alias("row"), F.col(code).alias("code"))
    gone = _classes(table, RADIUS, "scan").where("not kept").select(F.col("row").alias(row))
    return coded.join(gone.hint("merge"), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
