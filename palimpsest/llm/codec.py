"""Encoding and decoding of text columns by forced-boundary splitting.

Null texts are empty (no ids, empty decoded text); repeated ids and texts give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import coder, id_and_text, map_arrow, slices


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""

    def run(batch: pa.RecordBatch):
        bpe = coder(tokenizer)
        for a, b in slices(batch.column(1), 2_000_000):
            ids, offsets = bpe.encode(batch.column(1).slice(a, b - a).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype("int32")))
            yield pa.record_batch([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the decoded text of each list of ids; a null list is empty."""

    def run(batch: pa.RecordBatch):
        import numpy as np

        bpe = coder(tokenizer)
        texts = [bpe.decode(np.array(x or [], np.uint32)) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(tokens.select("doc_id", "ids"), run, "doc_id long, text string")


def op6_bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The query: n_tokens and hashes of the ids and of the text decoded from them."""

    def run(batch: pa.RecordBatch):
        bpe = coder(tokenizer)
        for a, b in slices(batch.column(1), 2_000_000):
            ids, offsets = bpe.encode(batch.column(1).slice(a, b - a).to_pylist())
            raw, bounds = ids.astype("<u4").tobytes(), offsets.tolist()
            ids_sha = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(bounds, bounds[1:])]
            text_sha = [hashlib.sha256(bpe.decode_bytes(ids[x:y])).hexdigest() for x, y in zip(bounds, bounds[1:])]
            sizes = [y - x for x, y in zip(bounds, bounds[1:])]
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_and_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
