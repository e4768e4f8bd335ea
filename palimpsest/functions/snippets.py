"""Byte ranges of files as text: slices, line numbers, staleness, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_slice(content: Column, offset: Column, length: Column) -> Column:
    """Bytes of a range: whole, cut at the end, or empty beyond it."""
    return F.substring(content, offset.cast("int") + 1, length.cast("int"))


def as_text(content: Column) -> Column:
    """Bytes as text; ill-formed stretches become replacement characters."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def start_line(content: Column, offset: Column) -> Column:
    """1 + line feeds before an offset; offsets beyond the end count as the end."""
    head = F.substring(content, 1, offset.cast("int")).cast("string")
    return (F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def numbered(text: Column, first: Column) -> Column:
    """Each line after its right-aligned number and a bar.  A closing line feed
    stays and starts no line; empty text is one empty line."""
    ends = text.endswith("\n")
    body = F.when(ends, F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text)
    lines = F.split(body, "\n", -1)
    width = F.length((first + F.size(lines) - 1).cast("string"))
    rows = F.transform(lines, lambda s, i: F.concat(F.lpad((first + i).cast("string"), width, F.lit(" ")), F.lit(" | "), s))
    return F.concat(F.array_join(rows, "\n"), F.when(ends, F.lit("\n")).otherwise(F.lit("")))


def staleness(chunk: Column, offset: Column, disk: Column) -> Column:
    """missing, current, moved or modified: how a chunk fares in the file on disk."""
    here = F.substring(disk, offset.cast("int") + 1, F.octet_length(chunk))
    return F.when(disk.isNull(), "missing").when(here == chunk, "current").when((F.octet_length(chunk) > 0) & F.contains(disk, chunk), "moved").otherwise("modified")


def format_bytes(n: Column) -> Column:
    """B, KB or MB with one decimal, by 1024."""
    kb = F.format_string("%.1f KB", n / 1024.0)
    mb = F.format_string("%.1f MB", n / 1048576.0)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)
