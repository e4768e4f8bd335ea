"""Index layers: chains, publishing, filling, totals, status, collection."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.virtual_repo import VERSION
from ..storage import stored


#: Rows of history that the driver walks in memory; longer ones are walked by a task.
DRIVER_ROWS = 1_000_000


def ancestors(history: DataFrame, start: str) -> DataFrame:
    """commit and depth (the fewest steps to it) of a commit and all its ancestors that
    are in the history: rows of commit and parent, one for each parent.

    Each commit is met once, however many ways lead to it, so merges and circles do
    no harm and depth has no limit.  History is metadata and small next to what it
    describes: up to DRIVER_ROWS rows are walked on the driver.  Beyond, commits are
    numbered by joins, and one task walks the numbers: the steps of a walk depend on
    each other, and it needs about 30 bytes a row.  A null parent is a root; an unknown
    start gives no rows.
    """
    edges = history.select("commit", "parent").where("commit is not null")
    return _walked_on_driver(edges, start) if edges.count() <= DRIVER_ROWS else _walked_in_a_task(edges, start)


def _walked_on_driver(edges: DataFrame, start: str) -> DataFrame:
    rows = edges.toArrow()
    names = pc.unique(rows.column("commit"))
    known = rows.filter(pc.is_in(rows.column("parent"), names))
    child, parent = (pc.index_in(known.column(c), names).to_numpy().astype(np.int64) for c in ("commit", "parent"))
    at = pc.index_in(pa.scalar(start, names.type), names).as_py()
    met, depth = _walk(child << 32 | parent, len(names), at) if at is not None else (np.empty(0, np.int32),) * 2
    return edges.sparkSession.createDataFrame(pa.table({"commit": names.take(pa.array(met)), "depth": pa.array(depth, pa.int64())}), "commit string, depth long")


def _walked_in_a_task(edges: DataFrame, start: str) -> DataFrame:
    spark, edges = edges.sparkSession, stored(edges, "history")
    # a number is the place in its part, after the commits of the parts before
    placed = stored(edges.select("commit").distinct().select("commit", F.monotonically_increasing_id().alias("place")), "commits")
    part, before, total = F.shiftright("place", 33), [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], total))
        total += r["count"]
    shifts = F.broadcast(spark.createDataFrame(before, "part long, shift long"))
    numbers = placed.withColumn("part", part).join(shifts, "part").select("commit", (F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("shift")).alias("k"))
    first = numbers.where(F.col("commit") == F.lit(start)).head()
    above = numbers.select(F.col("commit").alias("parent"), F.col("k").alias("above"))
    links = stored(edges.join(numbers, "commit").join(above, "parent").select(F.shiftleft("k", 32).bitwiseOR(F.col("above")).alias("link")), "links")
    many, at = links.count(), first.k if first else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, end = np.empty(many, np.int64), 0
        for batch in batches:
            held[end : end + len(batch)] = batch.column(0).to_numpy()
            end += len(batch)
        met, depth = _walk(held, total, at)
        for k in range(0, len(met), 1 << 16):
            yield pa.record_batch([pa.array(x[k : k + (1 << 16)], pa.int64()) for x in (met, depth)], ["k", "depth"])

    if at is None or not many:
        return spark.createDataFrame([] if at is None else [(start, 0)], "commit string, depth long")
    walked = stored(links.coalesce(1).mapInArrow(run, "k long, depth long"), "walked")
    return numbers.join(walked, "k").select("commit", "depth")


def _walk(links: np.ndarray, total: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a commit and its ancestors, the nearest first, and the fewest steps to
    each.  Of ``total`` commits; a link is the number of one and below it, in the lower
    32 bits, that of a parent.  Links are sorted in place."""
    links.sort()
    begins = memoryview(np.searchsorted(links, np.arange(total + 1, dtype=np.int64) << 32))
    parents = memoryview(links.astype(np.int32))  # the lower bits
    depths = np.full(total, -1, np.int32)
    depth, met, at = memoryview(depths), array("i", [start]), 0
    depth[start] = 0
    while at < len(met):
        commit = met[at]
        at += 1
        for k in range(begins[commit], begins[commit + 1]):
            if depth[parents[k]] < 0:
                depth[parents[k]] = depth[commit] + 1
                met.append(parents[k])
    found = np.frombuffer(met, np.int32)
    return found, depths[found]


def chain_start(commits: DataFrame, indexed: DataFrame, start: str, strict: bool = False) -> DataFrame:
    """The nearest indexed ancestor of a commit (itself too, unless ``strict``):
    commit and commits_behind.  Of equally near ones the least name; none: no row."""
    found = ancestors(commits, start).where(F.col("depth") >= int(strict)).join(indexed.select("commit").distinct(), "commit")
    return found.select("commit", F.col("depth").alias("commits_behind")).orderBy("commits_behind", "commit").limit(1)


def chain_walk(layers: DataFrame, start: str) -> DataFrame:
    """commit and seq (0: newest) of the layers from one to its root or a gap."""
    return ancestors(current(layers), start).select("commit", F.col("depth").alias("seq"))


def walk_on_driver(parents: dict[str, str | None], start: str) -> list[str]:
    """The same over a small map; a commit met twice ends the walk."""
    out: dict[str, None] = {}
    while start in parents and start not in out:
        out[start] = None
        start = parents[start] or ""
    return list(out)


def current(layers: DataFrame) -> DataFrame:
    """Layers of the version that is read; others count as absent."""
    return layers.where(F.col("version") == VERSION)


def fill_merge(skeleton: DataFrame, embedded: DataFrame) -> DataFrame:
    """Slots with the codes written for them so far (commit, doc_id, chunk_index)."""
    return skeleton.join(embedded.select("commit", "doc_id", "chunk_index", F.col("code").alias("new")), ["commit", "doc_id", "chunk_index"], "left").withColumn("code", F.coalesce("new", "code")).drop("new")


def write_layer(chunks: DataFrame, path: str, commit: str) -> None:
    """Publish one layer: rows are written beside it, then moved in place.

    Two chunks of one slot are an error.  A layer without chunks is published too.
    """
    spark = chunks.sparkSession
    if chunks.groupBy("doc_id", "chunk_index").count().where("count > 1").limit(1).count():
        raise ValueError("a slot occurs twice")
    staged, final = f"{path}/_staging/{commit}", f"{path}/commit={commit}"
    chunks.drop("commit").write.mode("overwrite").parquet(staged)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.Path(final), True)
    if not fs.rename(jvm.Path(staged), jvm.Path(final)):
        raise OSError(f"{final} could not be published")


def drop_layers(spark: SparkSession, path: str, commits: list[str] | None = None) -> int:
    """Delete layers (all, if none is named) and what was staged; how many went."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm.Path(path)):
        return 0
    gone = 0
    for status in fs.listStatus(jvm.Path(path)):
        name = status.getPath().getName()
        if name.startswith("commit=") and (commits is None or name[7:] in commits):
            gone += fs.delete(status.getPath(), True)
    fs.delete(jvm.Path(f"{path}/_staging"), True)
    return gone


def gc_plan(layers: DataFrame, commits: DataFrame) -> DataFrame:
    """Layers to delete and why; what hangs off them isn't deleted with them."""
    known = commits.select("commit", F.lit(True).alias("known")).distinct()
    marked = layers.join(known, "commit", "left")
    reason = F.when(F.col("version").isNull(), "unreadable").when(F.col("version") != VERSION, "obsolete_version").when(F.col("known").isNull(), "commit_gone")
    return marked.withColumn("reason", reason).where("reason is not null").select("commit", "parent", "reason", "bytes")


def gc_orphans(layers: DataFrame, commits: DataFrame) -> DataFrame:
    """Kept layers whose parent goes because its commit is gone."""
    plan = gc_plan(layers, commits)
    kept = layers.join(plan.select("commit"), "commit", "left_anti")
    gone = plan.where("reason = 'commit_gone'").select(F.col("commit").alias("parent"))
    return kept.join(gone, "parent").select("commit", "parent")


def expand_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name and repo: an alias gives its repositories, another name itself."""
    return names.join(aliases.withColumnRenamed("alias", "name"), "name", "left").select("name", F.explode_outer(F.coalesce("repos", F.array("name"))).alias("repo")).where("repo is not null")
