"""What the operators of this subpackage share: the shared folder, Arrow maps,
packed id lists, and hashes of words taken straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch as shared_path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_path`` once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there: lineage ends,
    and a lost executor costs nothing that was done before."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys with more than this share of the rows, and more rows than a task minds, are
#: joined by a list sent to all tasks; the share bounds the list by its inverse.
HOT_SHARE, HOT_ROWS = 1e-4, 100_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with facts, of which each key has one, without a task for
    one key: ``weight`` says how many rows a key has, ``total`` how many there are.

    Hot keys (10,000 at most, whatever the tables hold) are sent to all tasks, so
    their rows stay where they are; all others are joined by sorting, and everything
    is where no key is hot.  Null keys join with nothing.
    """
    many, bound = facts.hint("merge"), max(total * HOT_SHARE, HOT_ROWS)
    hot = F.col(weight) > bound
    if total <= bound or not facts.where(hot).limit(1).count():
        return rows.join(many, key)
    few = facts.where(hot)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(many.where(~hot), key))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so others can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def slices(column: pa.Array, most: int = 1_000_000, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most so many bytes and rows, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    ends = np.cumsum(_sizes(column))
    at, before = 0, 0
    while at < n:
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield at, end
        at, before = end, int(ends[end - 1])


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets; null texts are empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pack_ids(ids: np.ndarray, wide: bool) -> bytes:
    """Ids as compressed byte planes: two of 16-bit ids, or four."""
    import zstandard

    planes = 4 if wide else 2
    raw = ids.astype("<u4" if wide else "<u2").view(np.uint8).reshape(-1, planes).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_ids(packed: bytes, wide: bool) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    planes = 4 if wide else 2
    return np.ascontiguousarray(raw.reshape(planes, -1).T).reshape(-1).view("<u4" if wide else "<u2").astype(np.uint32)


_CODERS: dict = {}


def coder(path: str):
    """The encoder of a vocabulary file, made once per worker."""
    from .bpe import BPE

    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = BPE(path)
    return _CODERS[path]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int | None, wide: bool = False) -> DataFrame:
    """doc_id, n_tokens and packed ids of every whole text, ``end_id`` appended.

    Texts are encoded once, here; nulls are empty.  ``wide`` is for vocabularies
    of 65,536 ids and more.
    """

    def run(batch: pa.RecordBatch):
        bpe = coder(tokenizer)
        text = batch.column(1)
        for a, b in slices(text, 2_000_000):
            ids, offsets = bpe.encode(text.slice(a, b - a).to_pylist())
            tail = np.array([] if end_id is None else [end_id], np.uint32)
            out, sizes = [], np.diff(offsets) + len(tail)
            bounds = offsets.tolist()
            for i in range(b - a):
                out.append(pack_ids(np.concatenate([ids[bounds[i] : bounds[i + 1]], tail]), wide))
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_arrow(id_and_text(docs), run, "doc_id long, n_tokens long, ids binary")
