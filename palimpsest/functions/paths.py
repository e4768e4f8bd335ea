"""Directory filters over slash-separated paths."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: str) -> str | None:
    """A directory as filters hold it; None for the root and for nothing."""
    out = posixpath.normpath(path.strip("/")) if path.strip("/") else "."
    return None if out == "." or out.startswith("..") else out


def relative_to(path: str, root: str, cwd: str) -> str | None:
    """A user's directory relative to the repository: absolute ones against the
    root, others against the working directory, then the root.  None if outside;
    the root itself is the empty string."""

    base = posixpath.normpath(root).rstrip("/") + "/"

    def inside(absolute: str) -> str | None:
        absolute = posixpath.normpath(absolute)
        if absolute.rstrip("/") + "/" == base:
            return ""
        return absolute[len(base) :] if absolute.startswith(base) else None

    if path.startswith("/"):
        return inside(path)
    found = inside(posixpath.join(cwd, path))
    return found if found is not None else inside(posixpath.join(root, path))


@dataclass(frozen=True)
class DirFilter:
    """Paths under some included directory (any, if none is named) and no excluded one.

    ``nothing``: directories were named but all lie outside, so nothing matches.
    """

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    nothing: bool = False

    @classmethod
    def of(cls, include: list[str], exclude: list[str], root: str = "/", cwd: str = "/") -> DirFilter:
        wanted = [relative_to(d, root, cwd) for d in include if d.strip()]
        inc = tuple(n for d in wanted if d and (n := normalise(d)))
        everything = any(d == "" for d in wanted)
        exc = tuple(n for d in exclude if d.strip() and (r := relative_to(d, root, cwd)) and (n := normalise(r)))
        return cls(() if everything else inc, exc, bool(wanted) and not everything and not inc)

    def column(self, path: Column) -> Column:
        under = lambda d: (path == d) | path.startswith(d + "/")
        out = F.lit(not self.nothing)
        if self.include:
            some = F.lit(False)
            for d in self.include:
                some = some | under(d)
            out = out & some
        for d in self.exclude:
            out = out & ~under(d)
        return out
