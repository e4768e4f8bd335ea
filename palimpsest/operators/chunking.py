"""Splitting files into byte ranges that fit a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.syntax import PARSERS, Node, Parser
from ..functions.text import TOKEN

BUDGET = 430
_TOKEN = re.compile(TOKEN)


def regex_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def line_table(data: bytes) -> list[tuple[int, int, int, bool]]:
    """(start, end with line feed, indent, blank) of each line."""
    out, at = [], 0
    for line in data.split(b"\n"):
        end = min(at + len(line) + 1, len(data))
        if at < end:
            bare = line.lstrip(b" \t")
            lead = line[: len(line) - len(bare)]
            out.append((at, end, len(lead) + 3 * lead.count(b"\t"), not bare.strip(b"\r")))
        at = end
    return out


def break_score(before: tuple, after: tuple) -> int:
    return 100 * (before[3] or after[3]) + max(0, 50 - 5 * after[2])


def chunk_lines(data: bytes, budget: int = BUDGET, count: Callable[[str], int] = regex_tokens) -> list[tuple[int, int]]:
    """Contiguous (offset, length) ranges that cover the file, cut at the best line
    end before the budget is passed; of equal breaks the latest.  One line is
    never cut.  An empty file has none."""
    if not data:
        return []
    lines = line_table(data)
    costs = [count(data[a:b].decode("utf-8", "replace")) for a, b, _, _ in lines]
    out, first, begin = [], 0, 0
    held = sum(costs[:1])
    best, best_score = -1, -1
    # held: tokens of lines first..i
    for i in range(1, len(lines)):
        score = break_score(lines[i - 1], lines[i])
        held += costs[i]
        if held > budget:
            cut = best if best >= 0 and lines[best][1] > begin else i - 1 if best < 0 and i > first and lines[i - 1][0] > begin else -1
            if cut >= 0:
                end = lines[cut][1] if cut == best else lines[cut][0]
                new = cut + 1 if cut == best else cut
                out.append((begin, end - begin))
                held -= sum(costs[first:new])
                first, begin, best, best_score = new, end, -1, -1
                continue
        if i > first and (best < 0 or score >= best_score):
            best, best_score = i - 1, score
    out.append((begin, len(data) - begin))
    return out


def from_ranges(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Contiguous (offset, length) chunks from (start, end) ranges in order: what an
    earlier range holds already goes, gaps join the chunk before them."""
    starts: list[int] = []
    reached = 0
    for a, b in ranges:
        if b <= reached or b <= a:
            continue
        starts.append(max(a, reached) if starts else 0)
        reached = b
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], size])] if size else []


def blank_lines(gap: bytes) -> int:
    """Line feeds before which their line holds only blanks, tabs and returns."""
    return sum(not line.strip(b" \t\r") for line in gap.split(b"\n")[:-1])


def boundary_score(data: bytes, end: int, start: int) -> int:
    """How good a break between two siblings is: 0 if no blank line parts them (the
    rest of the first one's line counts as one), else 100 and more with each."""
    blanks = blank_lines(data[end:start]) if start > end else 0
    return 99 + blanks if blanks > 1 else 0


def node_ranges(node: Node, data: bytes, budget: int, count: Callable[[str], int] = regex_tokens) -> list[tuple[int, int]]:
    """(start, end) ranges of a syntax tree, from the top down.

    A node that fits is one range and a leaf that doesn't is cut by lines.  Else
    siblings are gathered until one more would pass the budget, and parted at the best
    boundary since the last break (of equals the latest), or there if there is none.
    Small siblings of a group that is too large are merged, large ones cut further.
    """
    cost = lambda n: count(data[n.start : n.end].decode("utf-8", "replace"))

    def cut(node: Node) -> list[tuple[int, int]]:
        if cost(node) <= budget:
            return [(node.start, node.end)]
        children = node.children
        if not children:
            return [(node.start + a, node.start + a + n) for a, n in chunk_lines(data[node.start : node.end], budget, count)]
        costs = [cost(c) for c in children]
        before = [0, *accumulate(costs)]
        out: list[tuple[int, int]] = []

        def emit(first: int, last: int) -> None:
            if before[last] - before[first] <= budget:
                out.append((children[first].start, children[last - 1].end))
                return
            begin, held = len(out), 0
            for k in range(first, last):
                if costs[k] > budget:
                    out.extend(cut(children[k]))
                    held = 0
                elif len(out) > begin and held + costs[k] <= budget:
                    out[-1], held = (out[-1][0], children[k].end), held + costs[k]
                else:
                    out.append((children[k].start, children[k].end))
                    held = costs[k]

        first, best, best_score = 0, None, 0
        for k in range(1, len(children)):
            score = boundary_score(data, children[k - 1].end, children[k].start)
            if before[k + 1] - before[first] > budget:
                # past the budget: break at the best boundary, or here
                at = k if best is None else best
                emit(first, at)
                best, best_score = (k, score) if k > at and score > 0 else (None, 0)
                first = at
            elif score >= best_score:
                best, best_score = k, score
        emit(first, len(children))
        return out

    return cut(node)


def chunk_code(path: str, data: bytes, budget: int = BUDGET, parsers: dict[str, Parser] | None = None) -> list[tuple[int, int]]:
    """Contiguous (offset, length) chunks by the syntax tree that a parser for the
    path's extension gives, or by lines if there is none or it can't read the file.
    Overlaps go to the earlier range, gaps to the chunk before."""
    ext = path.rsplit(".", 1)[-1]
    parser = (PARSERS if parsers is None else parsers).get(ext)
    tree = parser(data) if parser and data else None
    if tree is None:
        return chunk_lines(data, budget)
    return from_ranges(node_ranges(tree, data, budget), len(data)) or [(0, len(data))]


def _chunk_rows(keys: list, texts: list, cut: Callable[[int, bytes], list[tuple[int, int]]], key: str) -> pa.RecordBatch:
    rows = []
    for at, (k, t) in enumerate(zip(keys, texts)):
        data = (t or "").encode()
        rows += [(k, i, a, n, regex_tokens(data[a : a + n].decode("utf-8", "replace"))) for i, (a, n) in enumerate(cut(at, data))]
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "chunk_index", "byte_offset", "chunk_len", "n_tokens"])


def chunk_files(files: DataFrame, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: key, chunk_index, byte_offset, chunk_len, n_tokens."""

    def run(batches):
        for batch in batches:
            yield _chunk_rows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lambda _, data: chunk_lines(data, budget), key)

    return files.select(key, text).mapInArrow(run, f"{key} long, chunk_index int, byte_offset long, chunk_len long, n_tokens long")


def chunk_code_files(files: DataFrame, budget: int = BUDGET, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """The same by the syntax of each file's language, as its path names it."""

    def run(batches):
        for batch in batches:
            paths = batch.column(1).to_pylist()
            yield _chunk_rows(batch.column(0).to_pylist(), batch.column(2).to_pylist(), lambda at, data: chunk_code(paths[at] or "", data, budget), key)

    return files.select(key, path, text).mapInArrow(run, f"{key} long, chunk_index int, byte_offset long, chunk_len long, n_tokens long")
