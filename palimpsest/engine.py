"""Index repositories commit by commit and search them."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codes, snippets
from .functions.paths import DirFilter
from .operators import chunking, search
from .operators.indexing import BATCH_INPUTS, CONCURRENT, Embedder, HashingEmbedder, reuse_codes
from .operators.layers import drop_layers, gc_orphans, gc_plan, walk_on_driver
from .operators.search import Reranker, WordShare
from .sources.git_repo import GitRepo, read_blobs
from .sources.virtual_repo import VERSION

CANDIDATES = 200
#: Chunks that are embedded between two points an interrupted index resumes from.
PORTION = 20_000
#: Results that may be asked for, and directories.
TOP, MOST_TOP, MOST_DIRS = 10, 50, 50


def clean_top(top: float | None) -> int:
    """A whole number from 1 to MOST_TOP; TOP for nothing and what is no number."""
    return TOP if top is None or top != top or top in (float("inf"), float("-inf")) else min(max(int(top), 1), MOST_TOP)


def clean_dirs(dirs: list | None) -> list[str]:
    """The first MOST_DIRS texts that aren't blank, trimmed."""
    return [d.strip() for d in dirs or [] if isinstance(d, str) and d.strip()][:MOST_DIRS]


@dataclass
class Found:
    """What a search gives: results, how many commits the index is behind, and the
    commits whose layers have chunks without codes."""

    results: list[dict]
    behind: int
    incomplete: list[str]


@dataclass
class Registry:
    """Named repositories and aliases of several, kept in a TOML file."""

    path: Path
    repos: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Registry:
        """A missing file is an empty registry."""
        path = Path(path)
        data = tomllib.loads(path.read_text("utf-8")) if path.exists() else {}
        return cls(path, {r["name"]: r["path"] for r in data.get("repos", [])}, {a["name"]: list(a["repos"]) for a in data.get("aliases", [])})

    def save(self) -> None:
        quote = lambda s: json.dumps(s, ensure_ascii=False)
        out = [f"[[repos]]\nname = {quote(n)}\npath = {quote(p)}\n" for n, p in sorted(self.repos.items())]
        out += [f"[[aliases]]\nname = {quote(n)}\nrepos = [{', '.join(map(quote, r))}]\n" for n, r in sorted(self.aliases.items())]
        self.path.write_text("\n".join(out), "utf-8")

    def add(self, name: str, path: str) -> None:
        if name in self.repos:
            raise ValueError(f"{name} is there already")
        self.repos[name] = GitRepo.discover(path).worktrees()[0][1]
        self.save()

    def alias(self, name: str, repos: list[str]) -> None:
        if unknown := [r for r in repos if r not in self.repos]:
            raise ValueError(f"unknown: {', '.join(unknown)}")
        self.aliases[name] = repos
        self.save()

    def expand(self, names: list[str]) -> list[str]:
        """Repositories that names and aliases stand for; all, if there is no name."""
        out = [r for n in names or sorted(self.repos) for r in self.aliases.get(n, [n])]
        if unknown := [r for r in out if r not in self.repos]:
            raise ValueError(f"unknown: {', '.join(unknown)}")
        return list(dict.fromkeys(out))


class Engine:
    """The layers of repositories under one folder of any file system Spark knows."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, dim: int = 64, budget: int = chunking.BUDGET, reranker: Reranker | None = None, concurrent: int = CONCURRENT):
        self.spark, self.root, self.dim, self.budget, self.concurrent = spark, root.rstrip("/"), dim, budget, concurrent
        self.embedder = embedder or HashingEmbedder(dim)
        self.reranker = reranker or WordShare()

    def _path(self, path: str):
        """The path and its file system."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def _whole(self, path: str) -> bool:
        """Whether a folder was written to its end."""
        return self._exists(f"{path}/_SUCCESS")

    def _bytes(self, path: str) -> int:
        p, fs = self._path(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def layers(self, repo: str) -> DataFrame:
        """commit, parent, version, files, chunks of the published layers."""
        schema = "parent string, version int, files long, chunks long, written timestamp, commit string"
        path = f"{self.root}/{repo}/layers"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def _parents(self, repo: str) -> dict[str, str | None]:
        return {r.commit: r.parent for r in self.layers(repo).where(F.col("version") == VERSION).select("commit", "parent").collect()}

    def _table(self, repo: str, kind: str, chain: list[str]) -> DataFrame:
        """Rows of a chain's layers with seq, 0 the newest."""
        found = self.spark.read.option("basePath", f"{self.root}/{repo}/{kind}").parquet(*(f"{self.root}/{repo}/{kind}/commit={c}" for c in chain))
        order = F.create_map(*[F.lit(x) for k, c in enumerate(chain) for x in (c, k)])
        return found.withColumn("commit", F.col("commit").cast("string")).withColumn("seq", order[F.col("commit")].cast("long"))

    def _chunk(self, files: DataFrame) -> DataFrame:
        budget = self.budget

        def run(batches):
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for batch in batches:
                rows = []
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if data and b"\0" not in data[:8192]:
                        rows += [(path, k, a, n, data[a : a + n]) for k, (a, n) in enumerate(chunking.chunk_code(path, data, budget))]
                columns = list(zip(*rows)) if rows else [[] for _ in kinds]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "chunk_index", "byte_offset", "chunk_len", "text"])

        return files.mapInArrow(run, "path string, chunk_index long, byte_offset long, chunk_len long, text binary")

    def _embed(self, chunks: DataFrame) -> DataFrame:
        embedder = self.embedder

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), BATCH_INPUTS):
                    part = batch.slice(at, BATCH_INPUTS)
                    vectors = embedder.embed_documents([t.decode("utf-8", "replace") for t in part.column(2).to_pylist()])
                    yield pa.record_batch([part.column(0), part.column(1), pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))], ["path", "chunk_index", "v"])

        rows = chunks.select("path", "chunk_index", "text").mapInArrow(run, "path string, chunk_index long, v array<float>")
        return rows.select("path", "chunk_index", codes.quantise("v", self.dim).alias("code"))

    def index(self, repo: str, git: GitRepo, spec: str | None = None, compact: bool = False, progress: Callable[[int, int], None] | None = None) -> dict:
        """Publish a layer for a commit: of what changed since its nearest indexed
        ancestor, or of everything.  Codes of unchanged chunks are reused.

        Chunks are cut once and staged; what has no code yet is embedded in portions,
        ``concurrent`` tasks at once, and ``progress`` is told how many chunks are done
        and how many there are.  A run that was stopped leaves its staged portions, and
        the next one embeds only what they lack.
        """
        commit = git.resolve(spec)
        parents = self._parents(repo)
        near = next((c for c, _ in git.history(commit) if c in parents and c != commit), None)
        base = None if compact else near
        if commit in parents and not (compact and parents[commit]):
            return {"commit": commit, "already_up_to_date": True}
        changes = git.changes(base, commit) if base else [(p, "changed") for p in git.listing(commit)]
        if base and not changes:
            return {"commit": commit, "already_up_to_date": True}
        home = f"{self.root}/{repo}"
        staged = f"{home}/staged/{commit}-{base or 'all'}-{self.budget}-{self.dim}"
        if not self._whole(f"{staged}/chunks"):
            self._chunk(git.files(self.spark, commit, [p for p, k in changes if k == "changed"])).write.mode("overwrite").parquet(f"{staged}/chunks")
        chunks = self.spark.read.parquet(f"{staged}/chunks")
        if not self._whole(f"{staged}/codes/portion=-1"):
            self._reused(repo, parents, commit if commit in parents else near, chunks).write.mode("overwrite").parquet(f"{staged}/codes/portion=-1")
        self._fill(staged, chunks, progress)
        rows = chunks.join(self._codes(staged).drop("portion"), ["path", "chunk_index"], "left")
        rows.write.mode("overwrite").parquet(f"{staged}/rows")  # what is read for reuse may be replaced below
        drop_layers(self.spark, f"{home}/layers", [commit])
        drop_layers(self.spark, f"{home}/chunks", [commit])
        final, files = self._path(f"{home}/chunks/commit={commit}")
        files.mkdirs(final.getParent())
        if not files.rename(self._path(f"{staged}/rows")[0], final):
            raise OSError(f"{final} could not be published")
        self.spark.createDataFrame(changes, "path string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{home}/changes/commit={commit}")
        counts = self._table(repo, "chunks", [commit]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"), F.count_if(codes.filled(F.col("code"))).alias("done")).head()
        layer = self.spark.range(1).select(F.lit(base).cast("string").alias("parent"), F.lit(VERSION).alias("version"), F.lit(counts.files).cast("long").alias("files"), F.lit(counts.n).cast("long").alias("chunks"), F.current_timestamp().alias("written"))
        layer.write.mode("overwrite").parquet(f"{home}/layers/commit={commit}")  # last: this publishes the rest
        self._path(staged)[1].delete(self._path(f"{home}/staged")[0], True)
        return {"commit": commit, "already_up_to_date": False, "is_delta": base is not None, "files": counts.files, "chunks": counts.n, "embedded": counts.done}

    def _codes(self, staged: str) -> DataFrame:
        return self.spark.read.schema("path string, chunk_index long, code array<long>, portion int").parquet(f"{staged}/codes")

    def _reused(self, repo: str, parents: dict[str, str | None], source: str | None, chunks: DataFrame) -> DataFrame:
        """Codes of unchanged chunks, from a layer and those below it."""
        if not source:
            return chunks.limit(0).select("path", "chunk_index", F.lit(None).cast("array<long>").alias("code"))
        old = self._table(repo, "chunks", walk_on_driver(parents, source))
        return reuse_codes(old.select("path", "chunk_index", "text", "code"), chunks)

    def _fill(self, staged: str, chunks: DataFrame, progress: Callable[[int, int], None] | None) -> None:
        """Embed the chunks that no staged portion has yet."""
        total = chunks.count()
        if not self._exists(f"{staged}/plan"):
            # which portion a chunk belongs to is settled once, so that runs agree
            pending = chunks.select("path", "chunk_index").join(self._codes(staged).select("path", "chunk_index"), ["path", "chunk_index"], "left_anti")
            self.spark.range(1).select(F.lit(-(-pending.count() // PORTION)).cast("int").alias("portions")).write.mode("overwrite").parquet(f"{staged}/plan")
        portions = self.spark.read.parquet(f"{staged}/plan").head().portions
        known = self.spark.read.schema("path string, chunk_index long, code array<long>").parquet(f"{staged}/codes/portion=-1")
        fresh = chunks.join(known.select("path", "chunk_index"), ["path", "chunk_index"], "left_anti")
        for k in range(portions):
            if not self._whole(f"{staged}/codes/portion={k}"):
                mine = fresh.where(F.pmod(F.xxhash64("path", "chunk_index"), F.lit(portions)) == k)
                self._embed(mine.repartition(self.concurrent)).write.mode("overwrite").parquet(f"{staged}/codes/portion={k}")
            if progress:
                progress(self._codes(staged).count(), total)

    def search(self, repo: str, git: GitRepo, query: str, spec: str | None = None, top: int | None = TOP, dirs: DirFilter | None = None, mode: str = "post") -> Found:
        """Best chunks for a query, from the nearest indexed ancestor of a commit and
        the layers below it."""
        commit, parents = git.resolve(spec), self._parents(repo)
        behind, start = next(((k, c) for k, (c, _) in enumerate(git.history(commit)) if c in parents), (0, None))
        if start is None:
            raise ValueError(f"no ancestor of {commit} is indexed")
        chain = walk_on_driver(parents, start)
        vector = [float(x) for x in self.embedder.embed_documents([query])[0]]
        code = list(self.spark.createDataFrame([(vector,)], "v array<float>").select(codes.quantise("v", self.dim).alias("c")).head().c)
        chunks = self._table(repo, "chunks", chain).withColumn("pos", F.col("path"))
        listing = chunks.select("commit", "pos", "path").distinct()
        hits = search.chain_search(chunks.select("commit", "seq", "pos", "chunk_index", "code"), listing, self._table(repo, "changes", chain).select("path", "seq"), code, CANDIDATES, CANDIDATES, dirs, mode)
        found = hits.join(chunks.select("commit", "path", "chunk_index", "byte_offset", "chunk_len", "text"), ["commit", "path", "chunk_index"]).orderBy(*search.ORDER).collect()
        texts = [bytes(r.text).decode("utf-8", "replace") for r in found]
        results = [{"path": r.path, "commit": r.commit, "offset": r.byte_offset, "length": r.chunk_len, "distance": r.dist, "score": score, "text": text, "state": self._state(git, r.path, r.byte_offset, bytes(r.text))} for r, text, score in zip(found, texts, self.reranker.rerank(query, texts))]
        results.sort(key=lambda r: -r["score"])
        incomplete = [r.commit for r in search.incomplete_commits(chunks).orderBy("commit").collect()]
        return Found(results[: clean_top(top)], behind, incomplete)

    @staticmethod
    def _state(git: GitRepo, path: str, offset: int, chunk: bytes) -> str:
        file = Path(git.root) / path
        if not file.is_file():
            return "missing"
        data = file.read_bytes()
        return "current" if data[offset : offset + len(chunk)] == chunk else "moved" if chunk and chunk in data else "modified"

    def read(self, git: GitRepo, commit: str, path: str) -> bytes | None:
        return next(read_blobs(git.root, commit, [path]))

    def status(self, repo: str) -> dict:
        """Layers of the version that is read, the latest of them, chunks and bytes."""
        row = self.layers(repo).where(F.col("version") == VERSION).agg(F.count(F.lit(1)).alias("layers"), F.max_by("commit", "written").alias("latest"), F.sum("chunks").alias("chunks")).head()
        size = sum(self._bytes(f"{self.root}/{repo}/{kind}") for kind in ("layers", "chunks", "changes"))
        return {"layers": row.layers, "latest": row.latest, "chunks": row.chunks or 0, "bytes": size, "size": self.spark.range(1).select(snippets.format_bytes(F.lit(size))).head()[0]}

    def _all_layers(self, repo: str) -> DataFrame:
        """commit, parent, version (null: unreadable) and bytes of every layer folder."""
        path, kinds = f"{self.root}/{repo}/layers", "commit string, parent string, version int, bytes long"
        p, fs = self._path(path)
        rows = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            name = status.getPath().getName()
            if not name.startswith("commit="):
                continue
            try:
                head = self.spark.read.schema("parent string, version int").parquet(f"{path}/{name}").head()
            except Exception as e:  # noqa: BLE001 - whatever a broken file raises, it is collected as unreadable
                if "commit=" not in str(e) and "parquet" not in str(e).lower():
                    raise
                head = None
            rows.append((name[7:], head and head.parent, head and head.version, self._bytes(f"{self.root}/{repo}/chunks/{name}")))
        return self.spark.createDataFrame(rows, kinds)

    def gc(self, repo: str, git: GitRepo, dry_run: bool = False) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        """Drop layers that can't be read, are of another version, or whose commit the
        repository has no more: (commit, reason) of each; and (commit, parent) of the
        layers that stay without what they build on."""

        def there(commit: str) -> bool:
            try:
                return bool(git.resolve(commit))
            except ValueError:
                return False

        layers = self._all_layers(repo)
        known = self.spark.createDataFrame([(r.commit,) for r in layers.select("commit").collect() if there(r.commit)], "commit string")
        gone = sorted((r.commit, r.reason) for r in gc_plan(layers, known).collect())
        orphans = sorted((r.commit, r.parent) for r in gc_orphans(layers, known).collect())
        if gone and not dry_run:
            for kind in ("layers", "chunks", "changes"):
                drop_layers(self.spark, f"{self.root}/{repo}/{kind}", [c for c, _ in gone])
        return gone, orphans

    def drop(self, repo: str) -> None:
        """Delete everything kept for a repository."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{repo}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
