"""Command line: python -m palimpsest [--home DIR] init|add|alias|index|search|status|gc|drop|debug ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine, Registry, clean_dirs
from .functions.paths import DirFilter
from .operators.chunking import BUDGET, chunk_code
from .session import local_session
from .sources.git_repo import GitRepo


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest", description="Search over versioned files.")
    top.add_argument("--home", default=str(Path.home() / ".palimpsest"), help="folder of the registry and the layers")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="make an empty registry")
    add = sub.add_parser("add", help="register a repository")
    add.add_argument("name")
    add.add_argument("path")
    alias = sub.add_parser("alias", help="name several repositories, or show what a name stands for")
    alias.add_argument("name")
    alias.add_argument("repos", nargs="*")
    index = sub.add_parser("index", help="publish a layer for a commit")
    index.add_argument("names", nargs="*")
    index.add_argument("--commit")
    index.add_argument("--compact", action="store_true", help="one layer of everything")
    find = sub.add_parser("search", help="best chunks for a query")
    find.add_argument("name")
    find.add_argument("query")
    find.add_argument("--commit")
    find.add_argument("--worktree", help="search from the commit of this worktree")
    find.add_argument("--top", type=int, default=10)
    find.add_argument("--dir", action="append", default=[])
    find.add_argument("--exclude-dir", action="append", default=[])
    find.add_argument("--filter-first", action="store_true", help="filter directories before each layer is cut")
    debug = sub.add_parser("debug", help="show what would be indexed")
    debug.add_argument("what", choices=["files", "chunk"])
    debug.add_argument("path", help="a repository; a file, or - for what is typed in")
    debug.add_argument("--as", dest="name", help="the file name whose syntax is meant")
    debug.add_argument("--budget", type=int, default=BUDGET)
    for name in ("status", "gc", "drop"):
        each = sub.add_parser(name)
        each.add_argument("names", nargs="*")
        if name == "gc":
            each.add_argument("--dry-run", action="store_true")
    return top


def debug_files(path: str) -> list[str]:
    """Each tracked file of a repository: indexed, skipped (binary or empty) or
    unreadable, and how many of each."""
    git = GitRepo.discover(path)
    paths, out, count = git.staged(), [], {"indexed": 0, "skipped": 0, "unreadable": 0}
    for name in paths:
        file = Path(git.root) / name
        data = file.read_bytes() if file.is_file() else None
        state = "unreadable" if data is None else "indexed" if data and b"\0" not in data[:8192] else "skipped"
        count[state] += 1
        out.append(f"{state} {name}")
    return [*out, f"{len(paths)} tracked, " + ", ".join(f"{n} {s}" for s, n in count.items())]


def debug_chunk(path: str, name: str | None, budget: int) -> list[str]:
    """A file's chunks between rulers, numbered, with their ranges."""
    data = sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()
    out = []
    for k, (a, n) in enumerate(chunk_code(name or path, data, budget), 1):
        out += [f"--- chunk {k} ({a}, {n})", data[a : a + n].decode("utf-8", "replace")]
    return [*out, "---"]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run one command; what it printed, line by line."""
    a = parser().parse_args(args)
    home = Path(a.home)
    home.mkdir(parents=True, exist_ok=True)
    registry, out = Registry.load(home / "registry.toml"), []
    if a.command == "debug":
        return debug_files(a.path) if a.what == "files" else debug_chunk(a.path, a.name, a.budget)
    if a.command == "init":
        if not registry.path.exists():
            registry.save()
        return [str(registry.path)]
    if a.command == "add":
        registry.add(a.name, a.path)
        return [f"{a.name}: {registry.repos[a.name]}"]
    if a.command == "alias":
        if a.repos:
            registry.alias(a.name, a.repos)
        return [f"{a.name}: {' '.join(registry.expand([a.name]))}"]
    engine = Engine(spark or local_session(), f"file://{home}/layers")
    for name in registry.expand([a.name] if a.command == "search" else a.names):
        if a.command == "drop":
            engine.drop(name)
            out.append(f"{name}: dropped")
            continue
        if a.command == "status":
            s = engine.status(name)
            out.append(f"{name}: {s['layers']} layers, {s['chunks']} chunks, {s['size']}, latest {(s['latest'] or '-')[:12]}")
            continue
        git = GitRepo.discover(registry.repos[name])
        if a.command == "index":
            done = engine.index(name, git, a.commit, a.compact, lambda n, of: print(f"{name}: {n} of {of} chunks", file=sys.stderr))
            out.append(f"{name}: {done['commit'][:12]} " + ("is up to date" if done["already_up_to_date"] else f"{done['files']} files, {done['chunks']} chunks, {done['embedded']} embedded"))
        elif a.command == "gc":
            gone, orphans = engine.gc(name, git, a.dry_run)
            out += [f"{name}: {c[:12]} {reason}" for c, reason in gone]
            out += [f"{name}: {c[:12]} stays without {p[:12]}" for c, p in orphans]
        else:
            tree = git.worktree(a.worktree) if a.worktree else git
            dirs = DirFilter.of(clean_dirs(a.dir), clean_dirs(a.exclude_dir), git.root, str(Path.cwd()))
            found = engine.search(name, tree, a.query, a.commit, a.top, dirs, "pre" if a.filter_first else "post")
            out += [f"the index is {found.behind} commits behind"] * bool(found.behind)
            out += [f"the index of {', '.join(c[:12] for c in found.incomplete)} is incomplete"] * bool(found.incomplete)
            out += [f"{name} {k} · {r['path']} ({r['offset']}, {r['length']}) [{r['score']:.4f}] {r['state']}\n{r['text']}" for k, r in enumerate(found.results, 1)]
    return out


if __name__ == "__main__":
    print("\n".join(main()))
