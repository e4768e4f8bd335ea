"""File snapshots: listing, positions, text files, differences, reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.snippets import as_text, byte_slice
from ..storage import stored


def positions(files: DataFrame, group: str = "commit", order: str = "path") -> DataFrame:
    """The rows with ``pos``, their rank from 0 by bytes of path within a commit.

    Paths are cut into ranges, ranked within each, and shifted by the counts of
    the ranges before; so no task sorts a whole snapshot.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(files.repartitionByRange(parts, group, order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(group, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(group, "range", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(group, "range").orderBy(order))
    return ranged.withColumn("rank", rank).join(shifts, [group, "range"]).withColumn("pos", (F.col("rank") - 1 + F.col("before")).cast("long")).drop("rank", "before", "range")


def is_text(content):
    """Whether no NUL byte is among the first 8192."""
    return ~F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def text_files(files: DataFrame) -> DataFrame:
    """Files that are indexed: readable, not empty, not binary."""
    content = F.col("text").cast("binary")
    return files.where(F.col("text").isNotNull() & (F.octet_length(content) > 0) & is_text(content))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and kind (changed: new or with other content; deleted), by digests of
    the content, so texts are not compared or shuffled."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    a = old.select("path", digest.alias("before"))
    b = new.select("path", digest.alias("after"))
    kind = F.when(F.col("after").isNull(), "deleted").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("path", kind.alias("kind"))


def changes(files: DataFrame, chain: list[tuple[str, str]]) -> DataFrame:
    """commit, path, kind of each (commit, parent) pair of a short chain."""
    out = None
    for commit, parent in chain:
        part = tree_diff(files.where(F.col("commit") == parent), files.where(F.col("commit") == commit)).select(F.lit(commit).alias("commit"), "path", "kind")
        out = part if out is None else out.unionByName(part)
    return out


def read_ranges(refs: DataFrame, files: DataFrame) -> DataFrame:
    """The bytes (as text) of (commit, path, offset, length) references."""
    content = F.col("text").cast("binary")
    return refs.join(files.select("commit", "path", "text"), ["commit", "path"]).withColumn("snippet", as_text(byte_slice(content, F.col("offset"), F.col("length")))).drop("text")
