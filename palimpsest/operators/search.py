"""Exhaustive Hamming search over layers, with shadowing and directory filters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.codes import filled, hamming_to
from ..functions.paths import DirFilter
from ..storage import stored

#: How equal distances are ordered: newer layers first, then position and chunk.
ORDER = ("dist", "seq", "pos", "chunk_index")


def topk(vectors: DataFrame, query: list[int], n: int) -> DataFrame:
    """The n nearest filled codes; ties by id."""
    found = vectors.where(filled(F.col("code"))).select("vec_id", hamming_to(F.col("code"), query).alias("dist"))
    return found.orderBy("dist", "vec_id").limit(n)


def search_table(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """The n nearest codes of each query row (query_id, query).  Queries are a
    small table of checked size, sent to every part of the codes.

    A query without a code is at no distance (null) from all."""
    return _ranked(_near(queries, vectors, n), n)


def search_blocks(queries: DataFrame, vectors: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """``search_table`` for any number of queries: as many blocks of them as keep each
    under ``most``, every block against all codes.  Queries of one id stay together."""
    queries = stored(queries, "queries")
    parts = queries.sparkSession.sparkContext.defaultParallelism
    vectors = stored(vectors.select("vec_id", "code").repartition(parts), "codes")
    total, blocks = queries.count(), 1
    count = total
    # hashing fills blocks unevenly: more of them until the largest fits; search_table refuses
    # a single id with more rows than that
    while count > most and blocks <= total:
        blocks = max(blocks + 1, -(-count * blocks // most))
        sizes = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).count()
        count = sizes.agg(F.max("count")).head()[0]
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = _near(queries.where(block == 0), vectors, n)
    for k in range(1, blocks):
        found = found.unionByName(_near(queries.where(block == k), vectors, n))
    return _ranked(found, n)


def _ranked(found: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


#: Distances that a task works out at once.
TILE = 1 << 18


def _words(codes: pa.Array) -> np.ndarray:
    """Codes, a row each."""
    sizes = pc.min_max(pc.list_value_length(codes)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError("codes differ in length")
    return codes.flatten().to_numpy().view(np.uint64).reshape(len(codes), sizes["min"] or 0)


def _near(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """query_id, vec_id and dist: what may be among the n nearest of each query, n rows
    at most from each part of the vectors.  A part is passed once, in the order of ids,
    and only the n nearest so far are kept, so memory doesn't grow with the pairs."""
    rows = queries.select("query_id", "query").limit(10_001).toArrow()
    if len(rows) > 10_000:
        raise ValueError("search_table takes 10,000 queries at once; send larger sets in blocks")
    query_ids, blank = rows.column("query_id").combine_chunks(), rows.column("query").is_null().to_numpy()
    asked = np.flatnonzero(~blank)
    codes = _words(rows.column("query").drop_null().combine_chunks())
    far = 64 * codes.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query, in order: the distance and, in the lower 36 bits, the place in the part
        best, ids, seen = np.full((len(asked), n), far << 36), [], 0
        for batch in batches:
            if not len(batch):
                continue
            words = _words(batch.column(1))
            if len(asked) and words.shape[1] != codes.shape[1]:
                raise ValueError("codes differ in length")
            step, few = max(1, TILE // len(batch)), max(512, 4 * n)
            for a in range(0, len(asked), step):
                _meet(best[a : a + step], codes[a : a + step], words[:few], seen)
                _meet(best[a : a + step], codes[a : a + step], words[few:], seen + few)
            ids.append(batch.column(0))
            seen += len(batch)
        if not seen:
            return
        held = pa.concat_arrays(ids)
        query, k = np.nonzero(best >> 36 < far)
        found = best[query, k]
        yield pa.record_batch([query_ids.take(pa.array(asked[query])), held.take(pa.array(found & (1 << 36) - 1)), pa.array(found >> 36)], ["query_id", "vec_id", "dist"])
        first = np.arange(min(n, seen))
        for q in np.flatnonzero(blank):
            yield pa.record_batch([query_ids.take(pa.array(np.full(len(first), q))), held.take(pa.array(first)), pa.nulls(len(first), pa.int64())], ["query_id", "vec_id", "dist"])

    fields = [queries.schema["query_id"], vectors.schema["vec_id"]]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("dist", LongType())])
    return vectors.where(filled(F.col("code"))).select("vec_id", "code").sortWithinPartitions("vec_id").mapInArrow(run, schema)


def _meet(best: np.ndarray, codes: np.ndarray, words: np.ndarray, begin: int) -> None:
    """Put into ``best`` what is nearer: of equally near ones the first stays."""
    n, far = best.shape[1], 64 * codes.shape[1] + 1
    dist = np.zeros((len(codes), len(words)), np.min_scalar_type(far))
    for w in range(codes.shape[1]):
        dist += np.bitwise_count(codes[:, w, None] ^ words[None, :, w])
    query, k = np.nonzero(dist < (best[:, -1:] >> 36).astype(dist.dtype))
    if not len(query):
        return
    of = np.arange(len(best))[:, None] * (far + 1)
    keys = np.concatenate([(best + (of << 36)).ravel(), (of[query, 0] + dist[query, k] << 36) + (begin + k)])
    keys.sort()
    least = np.searchsorted(keys, of << 36) + np.arange(n)
    best[:] = keys[least] - (of << 36)


def topk_per_layer(chunks: DataFrame, query: list[int], n: int) -> DataFrame:
    """The n nearest filled slots of each layer (commit, seq)."""
    scanned = chunks.where(filled(F.col("code"))).select("commit", "seq", "pos", "chunk_index", hamming_to(F.col("code"), query).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("commit").orderBy("dist", "pos", "chunk_index"))
    return scanned.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def resolve_paths(hits: DataFrame, listing: DataFrame) -> DataFrame:
    """Hits with the paths of their positions; positions unknown there are dropped."""
    return hits.join(listing.select("commit", "pos", "path"), ["commit", "pos"])


def shadowed(hits: DataFrame, changes: DataFrame) -> DataFrame:
    """Hits whose file no newer layer changed or deleted (changes: path, seq)."""
    newer = changes.select(F.col("path").alias("shadow_path"), F.col("seq").alias("shadow_seq"))
    return hits.join(newer, (F.col("path") == F.col("shadow_path")) & (F.col("shadow_seq") < F.col("seq")), "left_anti")


def chain_search(chunks: DataFrame, listing: DataFrame, changes: DataFrame, query: list[int], per_layer: int, n: int, dirs: DirFilter | None = None, mode: str = "post") -> DataFrame:
    """Top n over a chain.  ``post`` cuts each layer to ``per_layer`` first and
    filters what is left; ``pre`` filters first and finds more."""
    accept = (dirs or DirFilter()).column(F.col("path"))
    if mode == "pre":
        allowed = shadowed(resolve_paths(chunks, listing), changes).where(accept)
        hits = resolve_paths(topk_per_layer(allowed, query, per_layer), listing)
    else:
        hits = shadowed(resolve_paths(topk_per_layer(chunks, query, per_layer), listing), changes).where(accept)
    return hits.orderBy(*ORDER).limit(n)


def incomplete_commits(chunks: DataFrame) -> DataFrame:
    """Layers with an unfilled slot, and how many."""
    return chunks.groupBy("commit").agg(F.count_if(~F.coalesce(filled(F.col("code")), F.lit(False))).alias("unfilled")).where("unfilled > 0")


def incomplete_files(chunks: DataFrame) -> DataFrame:
    """Files with an unfilled slot."""
    return chunks.groupBy("commit", "doc_id").agg(F.bool_or(~F.coalesce(filled(F.col("code")), F.lit(False))).alias("incomplete")).where("incomplete").select("commit", "doc_id")


class Reranker(Protocol):
    """Scores texts for a query, higher is better; made once per task."""

    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class WordShare:
    """The offline default: the share of the query's words that a text holds."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        words = list(dict.fromkeys(query.lower().split()))
        held = [set(t.lower().split()) for t in texts]
        return [sum(w in h for w in words) / max(1, len(words)) for h in held]


def rerank(hits: DataFrame, query_words: list[str], k: int) -> DataFrame:
    """The k best of (idx, text) by the share of query words a text holds; ties by idx."""
    words = F.split(F.lower("text"), r"[^a-z]+")
    wanted = F.array(*map(F.lit, query_words))
    score = F.size(F.array_intersect(F.array_distinct(words), wanted)) / float(max(1, len(query_words)))
    ranked = hits.select("idx", score.alias("score")).orderBy(F.desc("score"), "idx").limit(k)
    return ranked
