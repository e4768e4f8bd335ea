"""A git repository as a source, through the ``git`` program."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_blobs(root: str, commit: str, paths: Iterable[str]) -> Iterator[bytes | None]:
    """Contents of files at a commit, in order; None where there is none."""
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        assert p.stdin and p.stdout
        for path in paths:
            if "\n" in path:  # the protocol is by lines
                found = subprocess.run(["git", "-C", root, "cat-file", "blob", f"{commit}:{path}"], capture_output=True)
                yield None if found.returncode else found.stdout
                continue
            p.stdin.write(f"{commit}:{path}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) != 3:
                yield None
                continue
            data = p.stdout.read(int(head[2]))
            p.stdout.read(1)
            yield data if head[1] == b"blob" else None
        p.stdin.close()


@dataclass(frozen=True)
class GitRepo:
    """A repository, found from any folder inside it."""

    root: str

    @classmethod
    def discover(cls, path: str) -> GitRepo:
        found = subprocess.run(["git", "-C", path, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
        if found.returncode:
            raise ValueError(f"{path} is in no repository")
        return cls(found.stdout.strip())

    def _run(self, *args: str) -> str:
        found = subprocess.run(["git", "-C", self.root, *args], capture_output=True)
        if found.returncode:
            raise ValueError(found.stderr.decode("utf-8", "replace").strip())
        return found.stdout.decode("utf-8")

    def resolve(self, spec: str | None = None) -> str:
        """The commit that a name stands for; HEAD if none is given."""
        return self._run("rev-parse", "--verify", "--quiet", f"{spec or 'HEAD'}^{{commit}}").strip()

    def listing(self, commit: str) -> list[str]:
        """Paths at a commit, in order of their bytes; a path's position is its rank."""
        return sorted(filter(None, self._run("ls-tree", "-r", "-z", "--name-only", commit).split("\0")), key=str.encode)

    def staged(self) -> list[str]:
        """Paths of the staging index, in order of their bytes; a path in conflict once."""
        rows = filter(None, self._run("ls-files", "--stage", "-z").split("\0"))
        return sorted({r.split("\t", 1)[1] for r in rows}, key=str.encode)

    def history(self, commit: str) -> list[tuple[str, str | None]]:
        """(commit, first parent) of a commit and its ancestors, nearest first."""
        rows = [line.split() for line in self._run("log", "--format=%H %P", commit).splitlines()]
        return [(r[0], r[1] if len(r) > 1 else None) for r in rows]

    def changes(self, old: str, new: str) -> list[tuple[str, str]]:
        """(path, changed or deleted) between two commits; a rename is both."""
        parts = self._run("diff", "--name-status", "--no-renames", "-z", old, new).split("\0")
        return [(p, "deleted" if k == "D" else "changed") for k, p in zip(parts[::2], parts[1::2])]

    def worktrees(self) -> list[tuple[str, str]]:
        """(name, path) of the linked worktrees, the main one as main."""
        paths = [line[9:] for line in self._run("worktree", "list", "--porcelain").splitlines() if line.startswith("worktree ")]
        return [("main" if k == 0 else Path(p).name, p) for k, p in enumerate(paths)]

    def worktree(self, name: str) -> GitRepo:
        """A worktree by its name, its path or its folder's name."""
        for known, path in self.worktrees():
            if name in (known, path, Path(path).name):
                return GitRepo(path)
        raise ValueError(f"no worktree {name}")

    def files(self, spark: SparkSession, commit: str, paths: list[str] | None = None) -> DataFrame:
        """path and content (bytes; null if unreadable), read by the tasks.  The
        repository's folder must be there for every executor."""
        root = self.root

        def run(batches):
            for batch in batches:
                names = batch.column(0).to_pylist()
                yield pa.record_batch([batch.column(0), pa.array(list(read_blobs(root, commit, names)), pa.binary())], ["path", "content"])

        wanted = self.listing(commit) if paths is None else paths
        return spark.createDataFrame([(p,) for p in wanted], "path string").mapInArrow(run, "path string, content binary")
