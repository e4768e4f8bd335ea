"""Secrets in text: pattern matches, and candidates confirmed by their structure.

Base kinds are plain patterns.  Further kinds are reported only once a candidate
decodes: base64 (also wrapped over lines, with or without marks around it) or hex
that is a private key in DER with lengths that nest exactly, an OpenSSH key of
length-prefixed fields, a marked block whose header names a cipher and its vector, or
a signed token whose header is JSON that names an algorithm.

Null texts are empty (no spans); positions are code points, ends exclusive; texts
are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "pem", "der", "openssh")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
# how "{" begins in base64 before a quote or any white space that JSON allows
_HEADS = ("eyI", "eyJ", "eyA", "ewo", "ew0", "ewk")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e(?:y[AIJ]|w[0ko])[A-Za-z0-9_-]{5,})\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
_PEM_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*: *[^\n]*\n")
_CIPHER = re.compile(r"DEK-Info: *[A-Z0-9-]+,(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-Za-z0-9+/]{19,}|b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]*)(?:\r?\n[A-Za-z0-9+/]+)*={0,2}")
_UPPER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
_OPENSSH = b"openssh-key-v1\0"
_HEX_OPENSSH = re.compile(r"(?<![0-9A-Fa-f])" + _OPENSSH.hex() + r"[0-9a-f]+", re.IGNORECASE | re.ASCII)


def _from_base64(text: str) -> bytes | None:
    body = text.rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, body's begin, body's end) of items that fill a range exactly, or None."""
    out = []
    while begin < end:
        if end - begin < 2:
            return None
        tag, size, body = data[begin], data[begin + 1], begin + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or body + width > end:
                return None
            size = int.from_bytes(data[body : body + width], "big")
            body += width
        if body + size > end:
            return None
        out.append((tag, body, body + size))
        begin = body + size
    return out


def is_private_der(data: bytes) -> bool:
    """Whether the bytes are exactly one private key: PKCS#1, DSA, SEC 1 or PKCS#8."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = der_items(data, *outer[0][1:])
    if not inner or len(inner) < 3:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] != 0x02 or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 1:
        return False
    if len(tags) >= 6 and all(t == 0x02 for t in tags[:6]):
        return True
    if tags[1] == 0x04:
        return inner[1][2] - inner[1][1] >= 16
    if tags[1] == 0x30 and tags[2] == 0x04:
        names = der_items(data, *inner[1][1:])
        return bool(names) and names[0][0] == 0x06
    return False


def is_openssh(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key whose fields fit."""
    return openssh_size(data) > 0


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH private key that data begins with; 0 if it is none."""
    if not data.startswith(_OPENSSH):
        return 0
    at = len(_OPENSSH)
    for _ in range(3):  # cipher, key derivation and its options
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data):
        return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys + 1):  # public keys, then the private part
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else 0


def der_size(data: bytes) -> int:
    """Bytes of the DER item that data begins with, as its header says."""
    if len(data) < 6 or not data[1] & 0x80:
        return 2 + data[1] if len(data) > 1 else 0
    width = data[1] & 0x7F
    return 2 + width + int.from_bytes(data[2 : 2 + width], "big") if 1 <= width <= 4 else 0


def is_token_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _is_marked_key(kind: str, body: str) -> bool:
    """Whether what stands between the marks of a private key is one."""
    body = body.replace("\\r", "").replace("\\n", "\n").replace("\r", "")
    plain = _PEM_LINE.sub("", body)
    raw = _from_base64(re.sub(r"\s", "", plain))
    if not raw:
        return False
    if is_private_der(raw) or is_openssh(raw):
        return True
    if "ENCRYPTED" in kind:
        return der_items(raw, 0, len(raw)) is not None
    return plain != body and _CIPHER.search(body) is not None and len(raw) % 8 == 0


def _wrapped(m: re.Match) -> list[tuple[int, int, int]]:
    """The key that a stretch of base64, over one line or more, begins with."""
    lines, at, letters, places = m[0].rstrip("=").split("\n"), m.start(), [], []
    for line in lines:
        bare = line.rstrip("\r")
        letters.append(bare)
        places.append((at, len(bare)))
        at += len(line) + 1
    joined = "".join(letters)
    raw = _from_base64(joined[: len(joined) // 4 * 4 if len(joined) % 4 == 1 else None])
    if raw is None:
        return []
    ssh = raw.startswith(_OPENSSH)
    size = openssh_size(raw) if ssh else der_size(raw)
    if not 16 <= size <= len(raw) or not (ssh or is_private_der(raw[:size])):
        return []
    # as many characters as those bytes take, and the padding behind them
    need = -(-size * 4 // 3)
    for begin, n in places:
        if need <= n:
            end = begin + need
            break
        need -= n
    text = m.string
    while end < len(text) and text[end] == "=" and end - begin < n + 2:
        end += 1
    return [(m.start(), 6 if ssh else 5, end)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose structure holds."""
    out = []
    if any(head in text for head in _HEADS):
        out += [(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if is_token_header(m[1])]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 4, m.end()) for m in _PEM.finditer(text) if _is_marked_key(m[1], m[2])]
    for m in _BASE64.finditer(text):
        out += _wrapped(m)
    if "30" in text:
        for m in _UPPER_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and is_private_der(bytes.fromhex(m[0])):
                out.append((m.start(), 5, m.end()))
    if "70656" in text:  # digits alone, so either case has them
        for m in _HEX_OPENSSH.finditer(text):
            if len(m[0]) % 2 == 0 and is_openssh(bytes.fromhex(m[0])):
                out.append((m.start(), 6, m.end()))
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base_spans(text) + confirmed_spans(text))])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind."""
    out, at, open_kind, open_end = [], 0, -1, -1
    for a, k, b in sorted(base_spans(text) + confirmed_spans(text)):
        if a < open_end:
            open_end = max(open_end, b)
            continue
        if open_kind >= 0:
            out.append(f"[{KINDS[open_kind]}]")
            at = open_end
        out.append(text[at:a])
        open_kind, open_end = k, b
    if open_kind < 0:
        return text
    return "".join([*out, f"[{KINDS[open_kind]}]", text[open_end:]])


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, secrets in the text replaced; null stays null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(batch.schema, columns)]))

    return docs.mapInArrow(lambda batches: map(run, batches), docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def op10_secrets(docs: DataFrame) -> DataFrame:
    """The query: counts, a digest of the base spans, and all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, spans = ([], [], []), [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(1 for s in base if s[1] == k))
            shas.append(hashlib.sha256(spelled(base).encode()).hexdigest())
            spans.append(spelled(sorted(base + confirmed_spans(text))))
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(id_and_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
