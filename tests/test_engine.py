"""A real repository from end to end."""

import subprocess
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Engine, Registry, clean_dirs, clean_top
from palimpsest.functions.paths import DirFilter
from palimpsest.operators.indexing import HashingEmbedder
from palimpsest.sources.git_repo import GitRepo, read_blobs


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@e", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "work"
    (root / "src").mkdir(parents=True)
    git(tmp_path, "init", "-q", str(root))
    (root / "src/a.py").write_text("alpha beta\n" * 30)
    (root / "src/b.py").write_text("gamma delta\n" * 30)
    (root / "z.bin").write_bytes(b"\0\1\2")
    (root / "empty").write_text("")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    return root


class Counting(HashingEmbedder):
    """Notes each text it embeds in a file, since tasks run elsewhere."""

    def __init__(self, log):
        super().__init__(64)
        self.log = str(log)

    def embed_documents(self, texts):
        with open(self.log, "a") as f:
            f.writelines(f"{len(t)}\n" for t in texts)
        return super().embed_documents(texts)


def test_git_source(spark, repo):
    g = GitRepo.discover(str(repo / "src"))
    head = g.resolve()
    assert g.listing(head) == ["empty", "src/a.py", "src/b.py", "z.bin"] and g.history(head) == [(head, None)]
    assert list(read_blobs(g.root, head, ["z.bin", "no", "empty"])) == [b"\0\1\2", None, b""]
    assert {r.path: bytes(r.content) for r in g.files(spark, head).collect()}["src/b.py"] == b"gamma delta\n" * 30
    git(repo, "mv", "src/a.py", "src/c.py")
    git(repo, "commit", "-qam", "two")
    assert sorted(g.changes(head, g.resolve())) == [("src/a.py", "deleted"), ("src/c.py", "changed")]
    assert g.worktrees()[0][0] == "main"
    with pytest.raises(ValueError):
        g.resolve("nothing")


def test_index_and_search(spark, repo, tmp_path):
    log = tmp_path / "log"
    embedded = lambda: len(log.read_text().split()) if log.exists() else 0
    engine, g = Engine(spark, f"file://{tmp_path}/index", Counting(log), budget=20), GitRepo.discover(str(repo))
    with pytest.raises(ValueError):
        engine.search("r", g, "alpha")
    first = engine.index("r", g)
    assert not first["is_delta"] and first["files"] == 2 and first["chunks"] == first["embedded"] == embedded() > 2
    assert engine.index("r", g)["already_up_to_date"]
    found = engine.search("r", g, "alpha beta", top=3)
    results = found.results
    assert found.behind == 0 and found.incomplete == [] and len(results) == 3 and {r["path"] for r in results} == {"src/a.py"} and {r["state"] for r in results} == {"current"}
    assert engine.search("r", g, "alpha", dirs=DirFilter.of(["docs"], [])).results == []

    (repo / "src/a.py").write_text("alpha beta\n" * 29 + "omega\n")
    (repo / "src/b.py").unlink()
    git(repo, "commit", "-qam", "two")
    assert engine.search("r", g, "gamma").behind == 1
    before = embedded()
    second = engine.index("r", g)
    assert second["is_delta"] and 0 < embedded() - before < second["chunks"] == second["embedded"]
    paths = {r["path"] for r in engine.search("r", g, "gamma delta", top=50).results}
    assert paths == {"src/a.py"}  # the deleted file's chunks are shadowed
    before = embedded()
    third = engine.index("r", g, compact=True)
    assert not third["is_delta"] and not third["already_up_to_date"] and third["chunks"] == third["embedded"] and embedded() == before
    assert engine.index("r", g, compact=True)["already_up_to_date"]
    assert {r["path"] for r in engine.search("r", g, "gamma delta", top=50).results} == {"src/a.py"}
    assert engine.status("r")["layers"] == 2 and engine.status("r")["latest"] == second["commit"]

    git(repo, "commit", "-q", "--allow-empty", "-m", "same")
    assert engine.index("r", g)["already_up_to_date"]
    git(repo, "reset", "-q", "--hard", "HEAD~2")
    git(repo, "reflog", "expire", "--expire=now", "--all")
    git(repo, "gc", "-q", "--prune=now")
    assert engine.gc("r", g, dry_run=True) == engine.gc("r", g) == ([(second["commit"], "commit_gone")], []) and engine.gc("r", g) == ([], [])
    assert engine.status("r")["layers"] == 1
    engine.drop("r")
    assert engine.status("r") == {"layers": 0, "latest": None, "chunks": 0, "bytes": 0, "size": "0 B"}


class Failing(Counting):
    """Stops at a text, while a file stands."""

    def __init__(self, log, stop):
        super().__init__(log)
        self.stop = str(stop)

    def embed_documents(self, texts):
        if Path(self.stop).exists() and any("gamma" in t for t in texts):
            raise RuntimeError("stopped")
        return super().embed_documents(texts)


def test_an_interrupted_index_resumes(spark, repo, tmp_path, monkeypatch):
    from palimpsest import engine as module

    monkeypatch.setattr(module, "PORTION", 4)
    log, stop, told = tmp_path / "log", tmp_path / "stop", []
    stop.write_text("")
    engine, g = Engine(spark, f"file://{tmp_path}/index", Failing(log, stop), budget=20, concurrent=2), GitRepo.discover(str(repo))
    (repo / "src/a.py").write_text("alpha beta\n" * 300)
    git(repo, "commit", "-qam", "more")
    with pytest.raises(Exception, match="stopped"):
        engine.index("r", g, progress=lambda n, of: told.append((n, of)))
    assert engine.status("r")["layers"] == 0
    (staged,) = (tmp_path / "index/r/staged").iterdir()
    kept, before = engine._codes(f"file://{staged}").count(), len(log.read_text().split())
    assert kept > 0
    stop.unlink()
    done = engine.index("r", g, progress=lambda n, of: told.append((n, of)))
    assert done["chunks"] == done["embedded"] and told[-1] == (done["chunks"],) * 2
    assert len(log.read_text().split()) - before == done["chunks"] - kept  # whole portions weren't embedded again
    assert not (tmp_path / "index/r/staged").exists() or not list((tmp_path / "index/r/staged").iterdir())


def test_collection_by_reason(spark, repo, tmp_path):
    engine, g = Engine(spark, f"file://{tmp_path}/index", budget=20), GitRepo.discover(str(repo))
    one = engine.index("r", g)["commit"]
    (repo / "src/a.py").write_text("omega\n")
    git(repo, "commit", "-qam", "two")
    two = engine.index("r", g)["commit"]
    layers = tmp_path / "index/r/layers"
    for part in (layers / f"commit={one}").glob("*.parquet"):
        part.write_bytes(b"no parquet")
    spark.range(1).select(F.lit(None).cast("string").alias("parent"), F.lit(1).alias("version")).write.parquet(f"file://{layers}/commit=feed")
    spark.range(1).select(F.lit(None).cast("string").alias("parent"), F.lit(2).alias("version")).write.parquet(f"file://{layers}/commit=beef")
    gone, orphans = engine.gc("r", g)
    assert gone == sorted([(one, "unreadable"), ("feed", "obsolete_version"), ("beef", "commit_gone")]) and orphans == []
    assert engine.status("r")["layers"] == 1 and engine.status("r")["latest"] == two and engine.status("r")["bytes"] > 0


def test_arguments_are_cleaned():
    assert [clean_top(x) for x in (None, float("nan"), float("inf"), 0, -3, 7.9, 10**9)] == [10, 10, 10, 1, 1, 7, 50]
    assert clean_dirs([" a ", "", None, 3, "b"]) == ["a", "b"] and clean_dirs(None) == [] and len(clean_dirs(["x"] * 99)) == 50


def test_staged_files_worktrees_and_debugging(repo, tmp_path, monkeypatch, capsys):
    from palimpsest.__main__ import main

    g = GitRepo.discover(str(repo))
    (repo / "new").write_text("x")
    git(repo, "add", "new")
    assert g.staged() == ["empty", "new", "src/a.py", "src/b.py", "z.bin"]
    git(repo, "worktree", "add", "-q", str(tmp_path / "side"))
    assert g.worktree("side").root == str(tmp_path / "side") and g.worktree("main").root == str(repo)
    with pytest.raises(ValueError):
        g.worktree("none")
    (repo / "src/b.py").unlink()
    home = ["--home", str(tmp_path / "home")]
    assert main([*home, "debug", "files", str(repo)])[-1] == "5 tracked, 2 indexed, 2 skipped, 1 unreadable"
    assert main([*home, "debug", "chunk", str(repo / "src/a.py"), "--as", "a.txt", "--budget", "40"])[0].startswith("--- chunk 1 (0, ")
    assert main([*home, "init"]) == main([*home, "init"]) == [str(tmp_path / "home/registry.toml")]


def test_registry(tmp_path, repo):
    registry = Registry.load(tmp_path / "r.toml")
    registry.add("a", str(repo / "src"))
    with pytest.raises(ValueError):
        registry.add("a", str(repo))
    with pytest.raises(ValueError):
        registry.alias("x", ["none"])
    registry.alias('b"é', ["a"])
    again = Registry.load(tmp_path / "r.toml")
    assert again.repos == {"a": str(repo)} and again.aliases == {'b"é': ["a"]}
    assert again.expand([]) == again.expand(['b"é', "a"]) == ["a"]
    with pytest.raises(ValueError):
        again.expand(["c"])


def test_hashing_embedder_is_stable():
    e = HashingEmbedder(64)
    assert np.array_equal(e.embed_documents(["a b", ""])[0], e.embed_documents(["b A"])[0])
    assert not e.embed_documents([""]).any()


def test_command_line(spark, repo, tmp_path):
    from palimpsest.__main__ import main

    run = lambda *args: main(["--home", str(tmp_path / "home"), *args], spark)
    assert run("add", "a", str(repo)) == [f"a: {repo}"]
    assert run("alias", "all", "a") == ["all: a"] == run("alias", "all")
    assert run("status") == ["a: 0 layers, 0 chunks, 0 B, latest -"]
    assert run("index")[0].endswith("2 files, 2 chunks, 2 embedded") and run("index", "all")[0].endswith("is up to date")
    found = run("search", "all", "gamma", "--dir", str(repo / "src"), "--top", "1")
    assert len(found) == 1 and "src/b.py (0, 360) [1.0000] current" in found[0]
    assert run("search", "a", "gamma", "--dir", "/etc") == []
    assert run("gc", "--dry-run") == [] and run("drop", "a") == ["a: dropped"]
