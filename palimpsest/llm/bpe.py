"""Byte-pair encoding of whole columns, vectorised.

Texts of a batch are joined into one code-point array.  Pre-token starts are
found with array operations, then every pre-token is cut further at *forced
boundaries*: a pair of adjacent bytes that occurs inside no vocabulary entry can
never end up inside one token, so no merge can reach across it and the two sides
encode independently.  The resulting fragments are dictionary-encoded, each
distinct fragment is merged once (and remembered, up to ``CACHE`` entries per
worker), and ids are gathered back in text order.

Only the two vocabulary layouts described by ``BPE.__init__`` are accepted.
Texts that hold the literal of an added token go through the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Remembered fragments per worker; beyond it fragments are merged again.
CACHE = 250_000
#: Characters of text that are worked on at once.
SLICE = 2_000_000

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_EDGE_CP = 0x110000


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point; one more entry for the edge between documents."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(_EDGE_CP + 1, OTHER, np.uint8)
    for cp in range(0x110000):
        if (k := kinds.get(unicodedata.category(chr(cp))[0])) is not None:
            table[cp] = k
    table[_SPACES] = SPACE
    table[_EDGE_CP] = EDGE
    return table


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _binary_parts(array: pa.Array) -> tuple[bytes, list[int]]:
    """The bytes and offsets under a binary array."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return (array.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), offsets.tolist()


class PairTable:
    """Merge rank of a pair of ids, for arrays of pairs: two hash tables of one
    probe each, the second for keys that collide in the first."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in ranks], np.uint64)
        values = np.array([r for r, _ in ranks.values()], np.int32)
        self.levels = []
        for bits in (20, 18, 18, 18):
            rng = np.random.default_rng(bits)
            for _ in range(400):
                mult = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
                slot = (keys * mult) >> np.uint64(64 - bits)
                _, first = np.unique(slot, return_index=True)
                if bits == 20 or len(first) == len(keys):
                    break
            table_keys, table_values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, self.NONE, np.int32)
            table_keys[slot[first]], table_values[slot[first]] = keys[first], values[first]
            self.levels.append((mult, np.uint64(64 - bits), table_keys, table_values))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
            if not len(keys):
                return
        raise ValueError("no collision-free table found")

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(keys.shape, self.NONE, np.int32)
        for mult, shift, table_keys, table_values in self.levels:
            slot = (keys * mult) >> shift
            np.copyto(out, table_values[slot], where=table_keys[slot] == keys)
        return out


class BPE:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    Accepted: byte-level BPE without a normalizer and with the library's own
    split (``spaced``), or with white space dropped, lower case and a word-end
    suffix.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.spaced = spec.get("normalizer") is None
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or self.spaced == bool(self.suffix):
            raise ValueError(f"unsupported vocabulary layout: {path}")
        self.added = [t["content"] for t in spec["added_tokens"]]
        #: what all added tokens begin with, so that most texts are ruled out by one look
        self.hint = os.path.commonprefix(self.added)
        self.late = any(t.get("normalized") for t in spec["added_tokens"])
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.first_ids = [vocab.get(c, -1) for c in alphabet]
        self.final_ids = [vocab.get(c + self.suffix, -1) for c in alphabet]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.pairs = PairTable(self.ranks)
        self.merged = np.zeros(len(merges), np.int64)
        for r, new in self.ranks.values():
            self.merged[r] = new
        self.token_bytes = [b""] * size
        inside = np.zeros(65536, bool)
        for token, i in vocab.items():
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            raw = bytes(back[c] for c in body) if all(c in back for c in body) else body.encode()
            self.token_bytes[i] = raw + (self.suffix.encode() if body is not token else b"")
            for a, b in zip(raw, raw[1:]):
                inside[a << 8 | b] = True
        for t in spec["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()
        self.size = size
        self.forced = ~inside
        self._first, self._final = np.array(self.first_ids, np.int64), np.array(self.final_ids, np.int64)
        self._caches: tuple[dict, dict] = ({}, {})
        self._library = None
        self._texts: list[str] | None = None
        self._spelled: list[bytes] | None = None

    # -- the tokenizers library, for texts with added tokens and for tests

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    # -- fragments

    def fragment_ids(self, raw: bytes, final: bool) -> list[int]:
        """Ids of one fragment; ``final``: it ends a pre-token."""
        ids = [self.first_ids[b] for b in raw]
        if final and self.suffix:
            ids[-1] = self.final_ids[raw[-1]]
        return self._short(ids) if len(ids) < 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        ranks, none = self.ranks, (1 << 60, 0)
        found = [ranks.get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = ranks.get((ids[i], ids[i + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for runs of any length."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -2
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_many(self, frags: list[bytes], final: np.ndarray) -> list[bytes]:
        """Ids (uint32 bytes) of many fragments: those of one length are merged
        together, one merge of each a round, lowest rank and leftmost first."""
        out: list[bytes] = [b""] * len(frags)
        lengths = np.fromiter(map(len, frags), np.int64, len(frags))
        for size in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == size)
            if size > 40:
                for r in rows.tolist():
                    out[r] = np.array(self.fragment_ids(frags[r], bool(final[r])), np.uint32).tobytes()
                continue
            raw = np.frombuffer(b"".join([frags[r] for r in rows.tolist()]), np.uint8).reshape(-1, size)
            ids = self._first[raw]
            if self.suffix:
                ids[:, -1] = np.where(final[rows], self._final[raw[:, -1]], ids[:, -1])
            rank = self.pairs(ids[:, :-1], ids[:, 1:])
            while True:
                width = ids.shape[1]
                if width > 1:
                    best = rank.argmin(1)
                    low = rank[np.arange(len(best)), best]
                    stop = low == PairTable.NONE
                else:
                    stop = np.ones(len(ids), bool)
                if stop.any():
                    buf, step = ids[stop].astype(np.uint32).tobytes(), width * 4
                    for k, r in enumerate(rows[stop].tolist()):
                        out[r] = buf[k * step : k * step + step]
                    if stop.all():
                        break
                    go = ~stop
                    rows, ids, rank, best, low = rows[go], ids[go], rank[go], best[go], low[go]
                line = np.arange(len(best))
                ids[line, best] = self.merged[low]
                cols = np.arange(width - 1)
                ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
                rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= best[:, None]), 1)
                for at in (best - 1, best):
                    ok = (at >= 0) & (at < width - 2)
                    r, c = line[ok], at[ok]
                    rank[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
        return out

    # -- batches

    def normalise(self, text: str) -> str:
        if self.spaced or not text:
            return text
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers character by character, without the final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and n + 1 offsets; a null text is an empty one."""
        parts, counts, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                size += len(texts[end] or "")
                end += 1
            ids, n = self._encode_slice([t or "" for t in texts[at:end]])
            parts.append(ids)
            counts.append(n)
            at = end
        offsets = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets

    def has_added(self, text: str) -> bool:
        """Whether an added token's literal may occur, before normalising or after."""
        if not self.added:
            return False
        if self.hint in text and any(a in text for a in self.added):
            return True
        return self.late and any(a in self.normalise(text) for a in self.added)

    def _encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = {i for i, t in enumerate(texts) if self.has_added(t)}
        ids, n = self._plain(["" if i in special else self.normalise(t) for i, t in enumerate(texts)])
        if special:
            cut = np.split(ids, np.cumsum(n)[:-1])
            for i in special:
                cut[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                n[i] = len(cut[i])
            ids = np.concatenate(cut)
        return ids, n

    def _starts(self, cps: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Whether a pre-token (or dropped run) begins at each character."""
        n = len(cps)
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start |= cls == EDGE
        glued = None
        if self.spaced:
            blank = cls == SPACE
            last = np.zeros(n, bool)
            last[:-1] = blank[:-1] & (cls[1:] < SPACE)
            start |= last
            glued = last & (cps == 32)
            start[1:] &= ~glued[:-1]
        else:
            start |= cls == NUMBER
        quotes = np.flatnonzero((cps[:-1] == 39) & start[:-1] & (cls[1:] == LETTER))
        if len(quotes):
            one = cps[quotes + 1]
            two = cps[np.minimum(quotes + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quotes), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for which, width in ((short, 2), (long & ~short, 3)):
                q = quotes[which]
                start[q + 1] = False
                if width == 3:
                    start[q + 2] = False
                start[q[q + width < n] + width] = True
        return start

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join([*texts, ""])  # an edge after each document
        raw = joined.encode("utf-8", "replace")
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ascii_only = len(raw) == len(joined)
        cps = data.astype(np.uint32) if ascii_only else np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).copy()
        edges = np.cumsum([len(t) + 1 for t in texts]) - 1
        cps[edges] = _EDGE_CP
        cls = char_classes()[cps]
        start = self._starts(cps, cls)
        if ascii_only:
            at, edge_at = np.flatnonzero(start), edges
        else:
            byte_at = np.flatnonzero((data & 0xC0) != 0x80)
            at, edge_at = byte_at[start], byte_at[edges]
        word = np.zeros(len(data) + 1, bool)
        word[at] = True
        word[-1] = True
        cut = word.copy()
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        cut[1:-1] |= self.forced[pair]
        cut[edge_at] = True
        cut[edge_at + 1] = True
        where = np.flatnonzero(cut)
        begin, end = where[:-1], where[1:]
        n = len(begin)
        keep = np.ones(n, bool)
        edge_frag = np.searchsorted(begin, edge_at)
        keep[edge_frag] = False
        if not self.spaced:
            kinds = np.zeros(len(data), bool)
            kinds[at] = cls[start] == SPACE
            keep &= ~(kinds[begin] & word[begin])
            # later fragments of a dropped run follow its first one
            if len(data) and (dropped := word[begin] & kinds[begin]).any():
                owner = np.maximum.accumulate(np.where(word[begin], np.arange(n), 0))
                keep &= ~dropped[owner]
        array = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(raw)])
        coded = array.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.suffix:
            index = index * 2 + word[end]
        used = np.zeros(len(coded.dictionary) * (2 if self.suffix else 1), bool)
        used[index[keep]] = True
        rows = np.flatnonzero(used)
        spelled, bounds = _binary_parts(coded.dictionary)
        mid, fin = self._caches
        values: list[bytes] = []
        new_keys, new_at = [], []
        for r in rows.tolist():
            d = r >> 1 if self.suffix else r
            key = spelled[bounds[d] : bounds[d + 1]]
            v = (fin if r & 1 or not self.suffix else mid).get(key)
            if v is None:
                new_keys.append(key)
                new_at.append(len(values))
            values.append(v)
        if new_keys:
            final = rows[new_at] & 1 == 1 if self.suffix else np.ones(len(new_keys), bool)
            room = CACHE - len(mid) - len(fin)
            for key, at, f, v in zip(new_keys, new_at, final.tolist(), self.merge_many(new_keys, final)):
                values[at] = v
                if room > 0 and len(key) < 64:
                    (fin if f else mid)[key] = v
                    room -= 1
        flat = np.frombuffer(b"".join(values), np.uint32)
        sizes = np.zeros(len(used), np.int64)
        sizes[rows] = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        offset = np.zeros(len(used), np.int64)
        offset[rows] = np.cumsum(sizes[rows]) - sizes[rows]
        count = np.where(keep, sizes[index], 0)
        done = np.cumsum(count)
        total = int(done[-1])
        ids = flat[np.repeat(offset[index] - (done - count), count) + np.arange(total)]
        per_doc = np.diff(done[edge_frag], prepend=0)
        return ids, per_doc

    # -- decoding

    def token_texts(self) -> list[str]:
        """Vocabulary entries as the file spells them, by id."""
        if self._texts is None:
            vocab = self.library.get_vocab(with_added_tokens=True)
            self._texts = [""] * self.size
            for token, i in vocab.items():
                self._texts[i] = token
        return self._texts

    def decode(self, ids: np.ndarray) -> str:
        """The library's ``decode(ids, skip_special_tokens=False)``: byte-level
        vocabularies give their bytes back; a file without a decoder section
        gives the entries' own spelling, joined with spaces."""
        return self.decode_bytes(ids).decode("utf-8")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        if self.spaced:
            table = self.token_bytes
            return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").encode()
        if self._spelled is None:
            self._spelled = [t.encode() for t in self.token_texts()]
        table = self._spelled
        return b" ".join([table[i] for i in ids.tolist()])
