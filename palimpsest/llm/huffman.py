"""Token-id files: canonical, length-limited Huffman codes from global counts.

A folder of token files holds ``blocks`` (a Parquet row per block), ``codes`` (the
length of each id's code, and what a reader must know of the format) and ``parts``
(how many ids come before each part), and is read from its path alone.  A block
holds whole documents in ascending order of id; its payload is one bit stream, and
the bit position of every ``STEP``-th id is kept, so a reader decodes all these
stretches side by side with one table look-up per id.  Blocks need nothing from
each other.

Null texts are empty documents (the end id alone); equal ids keep one another's
company in a fixed order (by their token ids); a null id sorts first; an empty
table gives empty files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, pack_ids, remove_path, shared_path, token_ids, unpack_ids

#: Longest code in bits, ids between checkpoints, ids after which a block closes.
LIMIT, STEP, BLOCK = 16, 128, 65_536


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0: unused."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    level_weights, kinds = weight, []
    for _ in range(limit - 1):
        paired = level_weights[: len(level_weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, paired])
        rank = np.argsort(both, kind="stable")
        kinds.append(rank < len(weight))
        level_weights = both[rank]
    take, depth = 2 * len(weight) - 2, np.zeros(len(weight) + 1, np.int64)
    for leaf in reversed(kinds):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    out[order] = depth[:-1]
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    code, last = 0, 0
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        size = int(lengths[i])
        code <<= size - last
        codes[i], last = code, size
        code += 1
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and the bit positions (uint32) of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    total = int(end[-1]) if len(end) else 0
    # each code lies in one 32-bit window of two 16-bit words; bits never overlap, so sums are unions
    window = codes[ids].astype(np.uint64) << (32 - (begin & 15) - size).astype(np.uint64)
    word = begin >> 4
    n = (total >> 4) + 2
    high = np.bincount(word, (window >> np.uint64(16)).astype(np.float64), n)
    low = np.bincount(word + 1, (window & np.uint64(0xFFFF)).astype(np.float64), n)
    words = (high[:n] + low[:n]).astype(np.uint16)
    return words.astype(">u2").tobytes()[: (total + 7) // 8], begin[::STEP].astype("<u4").tobytes()


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each window of LIMIT bits: id << 5 | length."""
    table = np.zeros(1 << LIMIT, np.uint32)
    for i in np.flatnonzero(lengths).tolist():
        size = int(lengths[i])
        first = int(codes[i]) << (LIMIT - size)
        table[first : first + (1 << (LIMIT - size))] = i << 5 | size
    return table


def decode_blocks(payloads: list[bytes], marks: list[bytes], counts: list[int], table: np.ndarray, step: int = STEP) -> np.ndarray:
    """Ids of some blocks, one after another; all stretches advance together."""
    if not sum(counts):
        return np.zeros(0, np.uint32)
    lanes, starts, sizes, base, parts = [], [], [], 0, []
    done = 0
    for payload, mark, n in zip(payloads, marks, counts):
        at = np.frombuffer(mark, "<u4").astype(np.int64)
        lanes.append(at + base * 8)
        starts.append(done + np.arange(len(at)) * step)
        sizes.append(np.minimum(step, n - np.arange(len(at)) * step))
        parts += [payload, b"\0" * (4 - len(payload) % 2)]
        base += len(payload) + 4 - len(payload) % 2
        done += n
    words = np.frombuffer(b"".join(parts), ">u2").astype(np.uint32)
    window = words[:-1] << 16 | words[1:]
    at, start, size = np.concatenate(lanes), np.concatenate(starts), np.concatenate(sizes)
    grid = np.empty((step, len(at)), np.uint32)
    last = len(window) * 16 - 1
    for k in range(step):
        bits = (window[np.minimum(at, last) >> 4] >> (16 - (at & 15)).astype(np.uint32)) & 0xFFFF
        hit = table[bits]
        grid[k] = hit >> 5
        at += hit & 31
    return grid.T[np.arange(step) < size[:, None]]


def _counts(total: np.ndarray) -> bytes:
    used = np.flatnonzero(total)
    return used.astype("<i4").tobytes() + total[used].astype("<i8").tobytes()


def count_ids(tallies: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, from the tallies of the parts (see ``sorted_blocks``),
    which are summed by the tasks that hold them first."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n = len(x) // 12
                total[np.frombuffer(x, "<i4", n)] += np.frombuffer(x, "<i8", n, 4 * n)
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    found = tallies.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


_SORTED = "part int, block int, first long, n_tokens long, doc_ids binary, nulls int, lens binary, ids binary"
_STORED = "part int, block int, first long, n_tokens long, doc_ids binary, nulls int, lens binary, marks binary, payload binary"


def sorted_blocks(tokens: DataFrame, bounds: list[int], wide: bool, size: int) -> DataFrame:
    """Whole documents in ascending order, gathered into blocks of ids.

    Partitions are ranges of doc_id, whose bounds come from a sketch of that
    column; ``first`` counts the ids of the partition before the block.  Each
    partition ends with its tally: block -1, ``first`` all its ids, and in place of
    ids how often each occurs.
    """
    edges = np.array(bounds, np.int64)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).fill_null(-(2**63)).to_numpy()
        part = np.searchsorted(edges, keys, "right").astype(np.int32)
        return pa.record_batch([pa.array(part), *batch.columns], ["part", *batch.schema.names])

    def gather(batches) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        docs, lens, ids, held = [], [], [], 0
        total = np.zeros(size, np.int64)

        def flush():
            nonlocal total
            whole = np.concatenate(ids)
            total += np.bincount(whole, minlength=size)
            nulls = sum(d is None for d in docs)
            row = [part, block, first, len(whole), np.array([d or 0 for d in docs], "<i8").tobytes(), nulls, np.array(lens, "<u4").tobytes(), pack_ids(whole, wide)]
            return record(row)

        def record(row):
            return pa.RecordBatch.from_pydict({f.name: pa.array([v], f.type) for f, v in zip(schema, row)})

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.int32()), ("lens", pa.binary()), ("ids", pa.binary())])
        for batch in batches:
            for d, n, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                docs.append(d)
                lens.append(n)
                ids.append(unpack_ids(packed.as_py(), wide))
                held += n
                if held >= BLOCK:
                    yield flush()
                    block, first = block + 1, first + held
                    docs, lens, ids, held = [], [], [], 0
        if docs:
            yield flush()
            first += held
        if first:
            yield record([part, -1, first, 0, b"", 0, b"", _counts(total)])

    placed = map_arrow(tokens, place, "part int, doc_id long, n_tokens long, ids binary")
    ordered = placed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(gather, _SORTED)


def range_bounds(ids: DataFrame, parts: int) -> list[int]:
    """Ascending bounds that cut a column of ids into about equal parts."""
    if parts < 2:
        return []
    cuts = ids.select(F.expr(f"percentile_approx(doc_id, array({','.join(f'{i / parts:.8f}D' for i in range(1, parts))}), 10000)").alias("q")).head()
    return sorted(set(cuts.q or []))


def write_files(docs: DataFrame, path: str, tokenizer: str, size: int, end_id: int | None) -> None:
    """Encode every text and write the folder; ids are below ``size``."""
    spark, wide = docs.sparkSession, size > 65_536
    bounds = range_bounds(docs.select("doc_id"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch = shared_path(spark, "token-blocks")
    sorted_blocks(token_ids(docs, tokenizer, end_id, wide), bounds, wide, size).write.option("compression", "none").parquet(scratch)
    found = spark.read.schema(_SORTED).parquet(scratch)
    tallies, blocks = found.where("block < 0"), found.where("block >= 0")
    lengths = code_lengths(count_ids(tallies, size))
    codes = canonical_codes(lengths)

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(len(batch)):
            payload, marks = encode_block(unpack_ids(batch.column(7)[i].as_py(), wide), lengths, codes)
            yield pa.record_batch([*(c.slice(i, 1) for c in batch.columns[:7]), pa.array([marks], pa.binary()), pa.array([payload], pa.binary())], ["part", "block", "first", "n_tokens", "doc_ids", "nulls", "lens", "marks", "payload"])

    map_arrow(blocks, pack, _STORED).write.option("compression", "none").parquet(f"{path}/blocks")
    # one row per partition, so the driver may add them up
    sums, before, starts = dict(tallies.select("part", "first").collect()), 0, []
    for p in sorted(sums):
        starts.append((p, before))
        before += sums[p]
    remove_path(spark, scratch)
    one = spark.range(1).coalesce(1)
    one.select(F.lit(LIMIT).alias("limit"), F.lit(STEP).alias("step"), F.lit(bytearray(lengths.tobytes())).alias("lengths")).write.parquet(f"{path}/codes")
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")


def read_files(spark: SparkSession, path: str, fold=None, kind: str = "binary") -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit), decoded
    from the folder; ``fold`` maps a document's ids to what is returned instead."""
    fold = fold or (lambda ids: ids.astype("<u4").tobytes())
    stored = spark.read.schema(_STORED).parquet(f"{path}/blocks")
    head = spark.read.parquet(f"{path}/codes").head()
    if head.limit != LIMIT:
        raise ValueError(f"codes of up to {head.limit} bits")
    step, lengths = head.step, np.frombuffer(bytes(head.lengths), np.uint8)
    starts = dict(spark.read.parquet(f"{path}/parts").collect())  # a row per partition
    arrow = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def run(batches):
        table = decode_table(lengths, canonical_codes(lengths))
        for batch in batches:
            for at in range(0, len(batch), 8):
                part = batch.slice(at, 8).to_pydict()
                ids = decode_blocks(part["payload"], part["marks"], part["n_tokens"], table, step)
                docs, begins, sizes, values, done = [], [], [], [], 0
                for k in range(len(part["part"])):
                    keys, lens = np.frombuffer(part["doc_ids"][k], "<i8").tolist(), np.frombuffer(part["lens"][k], "<u4").tolist()
                    keys[: part["nulls"][k]] = [None] * part["nulls"][k]
                    start = starts[part["part"][k]] + part["first"][k]
                    for d, n in zip(keys, lens):
                        docs.append(d)
                        begins.append(start)
                        sizes.append(n)
                        values.append(fold(ids[done : done + n]))
                        start, done = start + n, done + n
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, arrow)], ["doc_id", "start", "n_tokens", "ids"])

    return stored.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {kind}")


def op2_token_files(docs: DataFrame, tokenizer: str, size: int = 50_257, end_id: int | None = 0) -> DataFrame:
    """The query: doc_id, start, n_tokens and ids_crc32, all from the files read back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write_files(docs, path, tokenizer, size, end_id)
    return read_files(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long").withColumnRenamed("ids", "ids_crc32")
