"""Incremental indexing: plans, reuse, resumption, compaction, batches, totals."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import filled
from ..functions.text import TOKEN, count_tokens
from .snapshot import is_text

BATCH_INPUTS, BATCH_TOKENS = 128, 110_000
#: Requests under way at once, and tokens they may hold in a minute.
CONCURRENT, RATE_TOKENS = 8, 2_800_000
#: Ids to a group of texts that are packed into requests in their order.
GROUP_IDS = 256
_TOKEN = re.compile(TOKEN)


class Embedder(Protocol):
    """Turns texts into vectors; made once per task."""

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """The offline default: each word counts up at one of ``dim`` places and down at
    another, both by its hash."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                row[h % self.dim] += 1
                row[(h >> 16) % self.dim] -= 1
        return out


class RateLimiter:
    """Lets a number of tokens pass in any window of seconds; more have to wait.  A
    request beyond the limit waits for an empty window, then passes alone."""

    def __init__(self, tokens: int, seconds: float = 60.0, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.tokens, self.seconds, self.now, self.sleep = tokens, seconds, now, sleep
        self.passed: deque[tuple[float, int]] = deque()
        self.held = 0

    def take(self, tokens: int) -> None:
        while True:
            at = self.now()
            while self.passed and at >= self.passed[0][0] + self.seconds:
                self.held -= self.passed.popleft()[1]
            if not self.passed or self.held + tokens <= self.tokens:
                break
            # never so little that a clock can't show it
            self.sleep(max(1e-3, self.passed[0][0] + self.seconds - at))
        self.passed.append((at, tokens))
        self.held += tokens


class LimitedEmbedder:
    """Another embedder within a rate.  Each of ``tasks`` tasks that run at once has an
    equal share of it, so together they keep the rate without talking to each other."""

    def __init__(self, inner: Embedder, tokens: int = RATE_TOKENS, tasks: int = CONCURRENT, seconds: float = 60.0):
        self.inner, self.share, self.seconds = inner, max(1, tokens // tasks), seconds
        self.limiter: RateLimiter | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "limiter": None}  # clocks are of one process

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        self.limiter = self.limiter or RateLimiter(self.share, self.seconds)
        self.limiter.take(sum(max(1, len(_TOKEN.findall(t))) for t in texts))
        return self.inner.embed_documents(texts)


def embed(rows: DataFrame, embedder: Embedder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and embedding (array<float>) of each text; a null text is an empty one."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BATCH_INPUTS):
                part = batch.slice(at, BATCH_INPUTS)
                vectors = embedder.embed_documents([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} long, embedding array<float>")


def delta_files(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """The files of a snapshot that changed since the parent layer."""
    return listing.join(changes.where("kind = 'changed'").select("path"), "path", "left_semi")


def delta_plan(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """path and action of a delta layer: chunk a changed file; a tombstone hides
    one that was deleted, or changed into something that isn't indexed."""
    content = F.col("text").cast("binary")
    ok = F.col("text").isNotNull() & (F.octet_length(content) > 0) & is_text(content)
    return changes.join(listing.select("path", ok.alias("ok")), "path", "left").select("path", F.when((F.col("kind") == "changed") & F.col("ok"), "chunk").otherwise("tombstone").alias("action"))


def reuse_codes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Codes of old chunks for new ones of the same path and bytes.

    Both have path, chunk_index and text; old has code.  Unfilled codes aren't
    reused; of equal old texts the last wins."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    last = old.where(filled(F.col("code"))).select("path", digest.alias("digest"), "chunk_index", "code").groupBy("path", "digest").agg(F.max_by("code", "chunk_index").alias("code"))
    return new.select("path", "chunk_index", digest.alias("digest")).join(last, ["path", "digest"]).select("path", "chunk_index", "code")


def pending_slots(skeleton: DataFrame, done: DataFrame) -> DataFrame:
    """Slots that still need a code."""
    keys = ["commit", "doc_id", "chunk_index"]
    return skeleton.where(~F.coalesce(filled(F.col("code")), F.lit(False))).select(*keys).join(done.select(*keys), keys, "left_anti")


def compact(chunks: DataFrame, snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """One root layer for a snapshot: each file's chunks from the newest layer that
    holds it and that no newer one replaced (chunks and changes carry seq)."""
    there = chunks.join(snapshot.select("doc_id", "path"), "doc_id")
    newest = there.groupBy("doc_id").agg(F.min("seq").alias("seq"))
    kept = there.join(newest, ["doc_id", "seq"])
    newer = changes.select(F.col("path").alias("p"), F.col("seq").alias("s"))
    return kept.join(newer, (F.col("path") == F.col("p")) & (F.col("s") < F.col("seq")), "left_anti").select("doc_id", "path", "chunk_index", "seq", "code")


def layout(lengths: DataFrame, group: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Byte offsets of chunks from their lengths."""
    w = Window.partitionBy(*group).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select(*group, "chunk_index", F.coalesce(F.sum("chunk_len").over(w), F.lit(0)).cast("long").alias("byte_offset"), "chunk_len")


def batches(rows: list[tuple[int, int]], inputs: int = BATCH_INPUTS, tokens: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Greedy requests of (id, tokens): one closes before it would pass a limit;
    an input beyond the limit goes alone."""
    held, size = [], 0
    for i, t in rows:
        if held and (len(held) >= inputs or size + t > tokens):
            yield held
            held, size = [], 0
        held.append(i)
        size += t
    if held:
        yield held


def embed_batches(files: DataFrame, inputs: int = BATCH_INPUTS, tokens: int = BATCH_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Requests of each group of GROUP_IDS neighbouring ids, packed in order of id: grp,
    batch (from 0), n_inputs, n_tokens.  The same however the rows are partitioned.
    Null ids are grouped by their texts, in groups below 0."""

    def run(found: pa.Table) -> pa.Table:
        rows = sorted(zip(found.column("id").to_pylist(), found.column("tokens").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        done = list(batches([(t, t) for _, t in rows], inputs, tokens))
        columns = [[found.column("grp")[0].as_py()] * len(done), list(range(len(done))), [len(d) for d in done], [sum(d) for d in done]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["grp", "batch", "n_inputs", "n_tokens"])

    group = F.coalesce(F.floor(F.col(key) / GROUP_IDS), -1 - F.pmod(F.xxhash64(F.col(text)), F.lit(4096)))
    rows = files.select(F.col(key).alias("id"), group.cast("long").alias("grp"), count_tokens(F.col(text)).alias("tokens"))
    return rows.groupBy("grp").applyInArrow(run, "grp long, batch long, n_inputs long, n_tokens long")
