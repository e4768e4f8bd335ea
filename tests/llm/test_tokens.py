import hashlib
import json
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import codec, huffman, packing
from palimpsest.llm.bpe import BPE

BYTE, WORD = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
_MADE = {}


def made(path):
    if path not in _MADE:
        _MADE[path] = (BPE(path), Tokenizer.from_file(path))
    return _MADE[path]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(list("aeit's  \n\t.,!-01éßΣ")), st.characters(codec="utf-8", categories=["L", "N", "P", "S", "Z", "M"], max_codepoint=0x2FFF)), max_size=40), max_size=6))
def test_encoder_equals_library(path, texts):
    bpe, library = made(path)
    ids, offsets = bpe.encode(texts)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert bpe.decode(ids[a:b]) == library.decode(want, skip_special_tokens=False)


def test_forced_cuts_lie_in_no_token():
    bpe, _ = made(WORD)
    for token in bpe.token_bytes[:40_000:7]:
        body = token.removesuffix(b"</w>")
        assert not any(bpe.forced[a << 8 | b] for a, b in zip(body, body[1:]))


def test_long_and_short_merges_agree():
    bpe, _ = made(BYTE)
    rng = random.Random(2)
    for _ in range(100):
        raw = bytes(rng.choice(b"abethino-=") for _ in range(rng.randint(1, 47)))
        ids = [bpe.first_ids[b] for b in raw]
        assert bpe._short(list(ids)) == bpe._long(list(ids)) == np.frombuffer(bpe.merge_many([raw], np.array([True]))[0], np.uint32).tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300), st.integers(10, 16))
def test_code_lengths_are_limited_and_optimal(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit).astype(int)
    used = [i for i, c in enumerate(counts) if c]
    assert all((lengths[i] > 0) == (counts[i] > 0) for i in range(len(counts)))
    if len(used) > 1:
        assert sum(2.0 ** -lengths[i] for i in used) == 1
        assert max(lengths) <= limit
        import heapq

        heap, cost = [counts[i] for i in used], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        got = sum(counts[i] * lengths[i] for i in used)
        assert got >= cost and (got == cost or limit < 20)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=1200))
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    counts = np.bincount(ids, minlength=401)
    counts[7] += 1
    lengths = huffman.code_lengths(counts)
    codes = huffman.canonical_codes(lengths)
    payload, marks = huffman.encode_block(ids, lengths, codes)
    table = huffman.decode_table(lengths, codes)
    assert huffman.decode_blocks([payload, payload], [marks, marks], [len(ids)] * 2, table).tolist() == ids.tolist() * 2


def test_token_files(odd_docs, no_docs, texts):
    library = made(BYTE)[1]
    got = huffman.op2_token_files(odd_docs, BYTE).collect()
    want = sorted([(-1 if i is None else i, library.encode(t, add_special_tokens=False).ids + [0]) for i, t in texts])
    assert len(got) == len(want)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None if i < 0 else i for i, _ in want]
    at = 0
    for r, (_, ids) in zip(rows, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert huffman.op2_token_files(no_docs, BYTE).count() == 0


def test_a_second_session_reads_the_folder_by_its_path(spark, odd_docs, texts, tmp_path):
    path = "file://" + str(tmp_path / "tokens")
    huffman.write_files(odd_docs, path, BYTE, 50_257, 0)
    reader = "import sys; from pyspark.sql import SparkSession as S; s = S.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); from palimpsest.llm.huffman import read_files as r; [print('row', x.doc_id, x.start, x.n_tokens, bytes(x.ids).hex()) for x in r(s, sys.argv[1]).orderBy('start').collect()]"
    found = subprocess.run([sys.executable, "-c", reader, path], capture_output=True, text=True, timeout=200)
    rows = [line.split(" ") for line in found.stdout.splitlines() if line.startswith("row ")]
    library = made(BYTE)[1]
    want = Counter((str(i), np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes().hex()) for i, t in texts)
    assert Counter((r[1], r[4]) for r in rows) == want, found.stderr[-2000:]
    ends = np.cumsum([int(r[3]) for r in rows])
    assert [int(r[2]) for r in rows] == [0, *ends[:-1].tolist()]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_the_whole_corpus_equal_the_librarys(path):
    """Every text of sf0.1, as op2 and op5 encode them."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()]
    bpe, library = made(path)
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        ids, offsets = bpe.encode(part)
        for want, a, b in zip(library.encode_batch(part, add_special_tokens=False), offsets, offsets[1:]):
            assert ids[a:b].tolist() == want.ids


def test_added_tokens_of_any_form(tmp_path):
    """Added tokens that share no beginning, and one that is looked for after normalising."""
    spec = json.loads(Path(WORD).read_text("utf-8"))
    more = [dict(spec["added_tokens"][0], id=49408 + k, content=c, normalized=n) for k, (c, n) in enumerate((("[pad]", False), ("étiq", True)))]
    spec["added_tokens"] += more
    file = tmp_path / "tokenizer.json"
    file.write_text(json.dumps(spec), "utf-8")
    bpe, library = BPE(str(file)), Tokenizer.from_file(str(file))
    for t in ("a [pad] b", "[PAD]", "x ÉTIQ y", "étiq", "e\u0301tiq", "<|endoftext|>", "pad tiq"):
        ids, _ = bpe.encode([t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip_query(odd_docs, no_docs, texts):
    library = made(WORD)[1]
    want = Counter()
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, codec.op6_bpe_round_trip(odd_docs, WORD).collect())) == want
    assert codec.op6_bpe_round_trip(no_docs, WORD).count() == 0
    both = codec.decode_ids(codec.encode_texts(odd_docs, BYTE), BYTE).collect()
    assert Counter(tuple(r) for r in both) == Counter(texts)


def test_tournament_is_first_fit():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(1, 60)
        tree, bins = packing.Tournament(n, 100), [100] * n
        for _ in range(n):
            size = rng.randint(1, 100)
            want = next(k for k, room in enumerate(bins) if room >= size)
            bins[want] -= size
            assert tree.first_fit(size) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=80))
def test_pack_places_each_token_once(lengths):
    pieces = packing.pack(lengths, 2048)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, size, sequence, offset in pieces:
        assert size > 0
        by_doc[d].append((start, size))
        by_sequence[sequence].append((offset, size))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc[d]):
            assert start == at
            at += size
        assert at == n
    loose = 0
    for rows in by_sequence.values():
        at = 0
        for offset, size in sorted(rows):
            assert offset == at
            at += size
        assert at <= 2048
        loose += 2048 - at >= packing.MIN_CUT
    assert loose <= 1


def test_packing_query(odd_docs, no_docs, texts):
    library = made(WORD)[1]
    want, got = Counter(), defaultdict(list)
    for i, t in texts:
        want[i, tuple(library.encode(t, add_special_tokens=False).ids + [1])] += 1
    rows = packing.pack_documents(odd_docs, WORD, with_ids=True).collect()
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and r.length * 4 == len(r.ids) for r in rows)
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r.length for r in rows) == total
    for r in rows:
        got[r.doc_id, r.start].append(tuple(np.frombuffer(r.ids, "<u4").tolist()))
    # each document's pieces, end to end, give its ids; of repeated rows each as often
    for i in {i for i, _ in want}:
        whole, copies = [ids for (k, ids), n in want.items() if k == i for _ in range(n)], Counter()
        for (k, start), pieces in got.items():
            if k == i:
                copies.update((start, p) for p in pieces)
        for ids in whole:
            at = 0
            while at < len(ids):
                p = next(p for (start, p), n in copies.items() if n and start == at and ids[at : at + len(p)] == p)
                copies[at, p] -= 1
                at += len(p)
        assert not +copies
    assert packing.op5_packing(no_docs, WORD).count() == 0
