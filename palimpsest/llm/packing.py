"""Packing of documents into sequences: first-fit decreasing in random groups.

Documents fall into groups by a hash, so that each group is small and any group
is like any other.  In a group every full sequence's worth of a document stands
alone; what is left is placed, longest first, into the first bin with room, which
a tournament tree over bin capacities finds in logarithmic time.  Gaps of at
least ``MIN_CUT`` are then filled by cutting up the emptiest bins.

Null texts are empty documents (the end id alone); repeated rows are packed each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import token_ids, unpack_ids

#: Text bytes to a group, and the smallest gap that is worth a cut.
GROUP_BYTES, MIN_CUT = 6_000_000, 16


class Tournament:
    """Capacities of bins; each node holds the larger of its two children's."""

    def __init__(self, bins: int, room: int):
        self.base = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.base)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the leftmost bin that has it; its number."""
        tree, node = self.tree, 1
        while node < self.base:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        found = node - self.base
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left >= right else right
        return found


def pack(lengths: list[int], room: int, min_cut: int = MIN_CUT) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of such lengths."""
    out, rest = [], []
    sequence = 0
    for d, n in enumerate(lengths):
        full = n // room
        for k in range(full):
            out.append((d, k * room, room, sequence, 0))
            sequence += 1
        if n % room:
            rest.append((n % room, d, full * room))
    rest.sort(key=lambda x: -x[0])
    bins: list[list[tuple[int, int, int]]] = []
    if rest:
        tree = Tournament(len(rest), room)
        for size, d, start in rest:
            b = tree.first_fit(size)
            while b >= len(bins):
                bins.append([])
            bins[b].append((d, start, size))
    fill = [sum(p[2] for p in b) for b in bins]
    # receivers, fullest first, take from donors, emptiest first
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    last = len(order) - 1
    for at, b in enumerate(order):
        gap = room - fill[b]
        while gap >= min_cut and last > at:
            donor = bins[order[last]]
            if not donor:
                last -= 1
                continue
            d, start, size = donor.pop()
            take = min(size, gap)
            if take < size:
                donor.append((d, start, size - take))
            bins[b].append((d, start + size - take, take))
            gap -= take
    for b in bins:
        offset = 0
        for d, start, size in b:
            out.append((d, start, size, sequence, offset))
            offset += size
        sequence += bool(b)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 1, room: int = 2048, group_bytes: int = GROUP_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids if wanted.

    The number of groups follows the bytes of text, so no group outgrows a task.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n"), F.count(F.lit(1)).alias("c")).head()
    groups = 1 + max((total.n or 0) // group_bytes, total.c // 20_000)
    tokens = token_ids(docs, tokenizer, end_id).withColumn("pack", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(groups)).cast("int"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * len(names) + [pa.binary()] * with_ids

    def run(key, table):
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("ids", "ascending")])
        sizes, ids_of = table.column("n_tokens").to_pylist(), table.column("doc_id").to_pylist()
        pieces = sorted(pack(sizes, room))
        packed, rows, current, ids = table.column("ids"), [], -1, np.zeros(0, np.uint32)
        for d, start, size, sequence, offset in pieces:
            if d != current:
                current, ids = d, unpack_ids(packed[d].as_py(), False).astype("<u4")
            raw = ids[start : start + size].tobytes()
            rows.append((ids_of[d], start, size, zlib.crc32(raw), sizes[d], key[0].as_py() << 32 | sequence, offset, *([raw] if with_ids else [])))
        columns = list(zip(*rows)) if rows else [[] for _ in kinds]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*names, *["ids"] * with_ids])

    return tokens.groupBy("pack").applyInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids)


def op5_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The query: pieces of all documents in sequences of 2048."""
    return pack_documents(docs, tokenizer)
