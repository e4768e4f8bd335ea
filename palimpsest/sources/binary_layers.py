"""Layers as single binary files: a header, runs of file positions, chunk counts
and lengths, then the codes, each table by itself.

All numbers are little-endian: version (1 byte), commit and parent (64 bytes of
ASCII, NUL-padded), runs of 16-bit numbers (n: the next n positions are there,
-n: they are not, 0: the end), 16-bit counts per file, 16-bit lengths per chunk,
zero bytes up to a multiple of 32, then 256 bytes a chunk.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VERSION, CODE, RUN, LONGEST = 2, 256, 32_767, 65_535


def runs_of(positions: list[int]) -> list[int]:
    """Runs for ascending positions; longer ones are split."""
    out, at = [], 0

    def add(sign: int, n: int) -> None:
        while n:
            part = min(n, RUN)
            out.append(sign * part)
            n -= part

    k = 0
    while k < len(positions):
        end = k
        while end + 1 < len(positions) and positions[end + 1] == positions[end] + 1:
            end += 1
        if positions[k] < at:
            raise ValueError("positions must ascend")
        add(-1, positions[k] - at)
        add(1, end - k + 1)
        at, k = positions[end] + 1, end + 1
    return [*out, 0]


def positions_of(runs: list[int]) -> list[int]:
    out, at = [], 0
    for n in runs:
        if n > 0:
            out += range(at, at + n)
        at += abs(n)
    return out


def write_layer(commit: str, parent: str | None, entries: list[tuple[int, list[tuple[int, bytes | None]]]]) -> bytes:
    """The file of a layer; entries are (position, [(length, code)]), a missing
    code is an unfilled slot.  Lengths of more than 65,535 bytes don't fit."""
    if any(b[0] <= a[0] for a, b in zip(entries, entries[1:])):
        raise ValueError("positions must ascend")
    counts, chunks = [len(c) for _, c in entries], [x for _, c in entries for x in c]
    if any(n > LONGEST for n in [*counts, *(n for n, _ in chunks)]):
        raise ValueError("a count or length doesn't fit into 16 bits")
    head = struct.pack("<B64s64s", VERSION, commit.encode(), (parent or "").encode())
    head += np.array(runs_of([p for p, _ in entries]), "<i2").tobytes() + np.array(counts, "<u2").tobytes() + np.array([n for n, _ in chunks], "<u2").tobytes()
    return head + b"\0" * (-len(head) % 32) + b"".join((c or b"").ljust(CODE, b"\0") for _, c in chunks)


def read_header(data: bytes) -> tuple[int, str, str | None]:
    version, commit, parent = struct.unpack_from("<B64s64s", data)
    text = lambda b: b.split(b"\0")[0].decode("ascii")
    return version, text(commit), text(parent) or None


def read_layer(data: bytes) -> tuple[int, str, str | None, list[tuple[int, int, int, int, bytes | None]]]:
    """Version, commit, parent and rows (position, chunk, offset, length, code);
    ValueError for another version or a file that is cut short."""
    if len(data) < 129:
        raise ValueError("no header")
    version, commit, parent = read_header(data)
    if version != VERSION:
        raise ValueError(f"version {version}")
    runs, at = [], 129
    while True:
        if at + 2 > len(data):
            raise ValueError("the runs don't end")
        (n,) = struct.unpack_from("<h", data, at)
        at += 2
        if not n:
            break
        runs.append(n)
    positions = positions_of(runs)
    try:
        counts = np.frombuffer(data, "<u2", len(positions), at).tolist()
        at += 2 * len(positions)
        lengths = np.frombuffer(data, "<u2", sum(counts), at).astype(np.int64)
    except ValueError as e:
        raise ValueError("the file is cut short") from e
    at += 2 * len(lengths)
    at += -at % 32
    if at + CODE * len(lengths) > len(data):
        raise ValueError("the file is cut short")
    rows, k = [], 0
    for position, n in zip(positions, counts):
        offset = 0
        for j in range(n):
            code = data[at + CODE * k : at + CODE * (k + 1)]
            rows.append((position, j, offset, int(lengths[k]), code if any(code) else None))
            offset += int(lengths[k])
            k += 1
    return version, commit, parent, rows


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder: path, commit, parent, version (null: unreadable), bytes and
    error (null: none), as ``gc_plan`` takes them.  A file of another version has its
    version alone; one that can't be read is named by its path.  Empty files aren't
    seen, since Spark's file source leaves them out."""
    names = ["path", "commit", "parent", "version", "bytes", "error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for name, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                try:
                    version, commit, parent, _ = read_layer(data)
                    rows.append((name, commit, parent, version, size, None))
                except (ValueError, struct.error) as e:
                    known = data[0] if data and data[0] != VERSION else None
                    rows.append((name, name.rsplit("/", 1)[-1], None, known, size, str(e)))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.mapInArrow(run, "path string, commit string, parent string, version int, bytes long, error string")


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all readable layer files of a folder: commit, parent, pos,
    chunk_index, byte_offset, chunk_len, code as 64-bit words (null: unfilled).  What
    can't be read has no chunks here; ``read_headers`` says which files those are."""
    names = ["commit", "parent", "pos", "chunk_index", "byte_offset", "chunk_len", "code"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                try:
                    _, commit, parent, rows = read_layer(data.as_py())
                except ValueError:
                    continue
                cells = [(commit, parent, *r[:4], None if r[4] is None else np.frombuffer(r[4], ">i8").tolist()) for r in rows]
                columns = list(zip(*cells)) if cells else [[] for _ in names]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "commit string, parent string, pos long, chunk_index long, byte_offset long, chunk_len long, code array<long>")
