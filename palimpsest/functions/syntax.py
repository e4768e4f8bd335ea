"""Syntax trees of source files, as far as cutting them into chunks needs them.

Python is read by its own parser.  Languages with braces are scanned for strings,
comments and brackets: an item ends with its block or a semicolon, and the items in a
block are the children of the item that holds it.  Ruby is read by indentation.  A
parser gives None for what it can't read.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from .text import GRAMMARS


@dataclass
class Node:
    """A byte range and the nodes inside it, in order."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)


Parser = Callable[[bytes], Node | None]

#: Blocks nested deeper than this are leaves.
DEPTH = 60


def _line_starts(data: bytes) -> list[int]:
    return [0, *(m.end() for m in re.finditer(rb"\n", data))]


def python_tree(data: bytes) -> Node | None:
    """Statements, those of a statement's blocks below it; decorators belong to what
    they decorate."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = _line_starts(data)

    def node(found: ast.AST, depth: int) -> Node:
        first = min([found, *getattr(found, "decorator_list", [])], key=lambda n: (n.lineno, n.col_offset))
        start = lines[first.lineno - 1] + first.col_offset
        if first is not found:
            start = data.rfind(b"@", 0, start) if data.rfind(b"@", 0, start) >= 0 else start
        inside = [c for name in ("body", "handlers", "orelse", "finalbody", "cases") for c in getattr(found, name, []) or []] if depth < DEPTH else []
        inside = [c.body[0] if isinstance(c, ast.match_case) else c for c in inside] if all(hasattr(c, "lineno") or c.body for c in inside) else []
        end = lines[found.end_lineno - 1] + found.end_col_offset
        children = [node(c, depth + 1) for c in inside]
        return Node(start, end, children)

    root = Node(0, len(data), [node(s, 1) for s in module.body])
    _add_heads(root)
    return root


_BRACES = re.compile(
    rb"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`|[{}()\[\];]""",
    re.S,
)
_CLOSES = {b"}": b"{", b")": b"(", b"]": b"["}


def brace_tree(data: bytes) -> Node | None:
    """Items of a language whose blocks stand in braces; comments before an item are
    items.  None if the brackets don't match."""
    root = Node(0, len(data))
    stack: list[tuple[bytes, Node]] = [(b"", root)]
    begin: list[int | None] = [None]  # where the open item of each block starts
    at = 0

    def skip(a: int, b: int) -> int:
        """The first visible byte of a range, or its end."""
        while a < b and data[a] in b" \t\r\n":
            a += 1
        return a

    def touch(a: int, b: int) -> None:
        if begin[-1] is None and (a := skip(a, b)) < b:
            begin[-1] = a

    def close(end: int) -> None:
        """End the open item of the block on top."""
        start = begin[-1]
        if start is not None and end > start:
            top = stack[-1][1]
            # blocks that were read since the item began are its children
            own = [c for c in top.children if c.start >= start]
            top.children = [c for c in top.children if c.start < start]
            top.children.append(Node(start, end, [x for c in own for x in (c.children or [c])]))
        begin[-1] = None

    for m in _BRACES.finditer(data):
        what, a, b = m.group(), m.start(), m.end()
        touch(at, a)
        at = b
        if what[:2] in (b"//", b"/*"):
            if begin[-1] is None and stack[-1][0] in (b"", b"{"):
                stack[-1][1].children.append(Node(a, b))
            continue
        if begin[-1] is None and what not in (b"}", b")", b"]", b";"):
            begin[-1] = a
        if what in (b"{", b"(", b"["):
            stack.append((what, Node(a, b)))
            begin.append(None)
            if len(stack) > 10 * DEPTH:
                return None
        elif what in _CLOSES:
            if stack[-1][0] != _CLOSES[what]:
                return None
            if what == b"}":
                close(skip_back(data, a))
            _, block = stack.pop()
            begin.pop()
            block.end = b
            if what == b"}" and len(stack) <= DEPTH:
                if block.children:
                    stack[-1][1].children.append(block)
                if stack[-1][0] in (b"", b"{") and data[skip(b, len(data)) : skip(b, len(data)) + 1] not in (b";", b",", b")", b"."):
                    close(b)
        elif what == b";" and stack[-1][0] in (b"", b"{"):
            if begin[-1] is None:
                begin[-1] = a
            close(b)
    touch(at, len(data))
    if len(stack) > 1:
        return None
    close(skip_back(data, len(data)))
    _add_heads(root)
    return root


def skip_back(data: bytes, end: int) -> int:
    while end and data[end - 1] in b" \t\r\n":
        end -= 1
    return end


def indent_tree(data: bytes) -> Node | None:
    """Lines, with the further indented lines after each (and a closing ``end``) below it."""
    root = Node(0, len(data))
    stack: list[tuple[int, Node]] = [(-1, root)]
    for start, stop in zip(lines := _line_starts(data), [*lines[1:], len(data)]):
        line = data[start:stop]
        bare = line.strip()
        if not bare:
            continue
        indent = len(line) - len(line.lstrip())
        end = skip_back(data, stop)
        while stack[-1][0] > indent or (stack[-1][0] == indent and bare != b"end"):
            stack.pop()
        for _, above in stack:
            above.end = max(above.end, end) if above is not root else above.end
        if stack[-1][0] == indent:  # the end of what the line above opened
            stack.pop()
            continue
        node = Node(start, end)
        stack[-1][1].children.append(node)
        if len(stack) <= DEPTH:
            stack.append((indent, node))
    _add_heads(root)
    return root


def _add_heads(root: Node) -> None:
    """What stands in a node before its first child becomes a child, so that it isn't
    left to the chunk before when the node is cut."""
    todo = [root]
    while todo:
        node = todo.pop()
        todo += node.children
        if node is not root and node.children and node.children[0].start > node.start:
            node.children.insert(0, Node(node.start, node.children[0].start))


_BY_GRAMMAR: dict[str, Parser] = {"python": python_tree, "ruby": indent_tree}
#: The parser of each extension that has one.
PARSERS: dict[str, Parser] = {ext: _BY_GRAMMAR.get(name, brace_tree) for name, exts in GRAMMARS.items() for ext in exts}
