"""A small history of files over the driver's tables, which hold no repository.

Commits c0 <- c1 <- c2; their snapshots differ by files added, edited and removed.
Beside them a long history of a commit for each row of ``part``, with merges, and the
layers of its older part, some of them of other versions, cut off or left over from
commits that are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import quantise

VERSION = 2
REPOS = [("alpha", "/srv/alpha"), ("beta", "/srv/beta"), ("gamma", "/srv/gamma")]
ALIASES = [("both", ["alpha", "beta"]), ("none", [])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_name(k: Column) -> Column:
    return F.md5(k.cast("string"))


def _gone(k: Column) -> Column:
    return F.md5(F.concat(F.lit("gone"), k.cast("string")))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k of every commit of the history, the oldest first."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))


def newest(spark: SparkSession, sf_dir: str) -> int:
    return numbers(spark, sf_dir).agg(F.max("k")).head()[0] or 0


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit and parent, a row for each parent: the commit before, and every tenth is
    a merge with the one 13 before."""
    k, all_k = F.col("k"), numbers(spark, sf_dir)
    merges = all_k.where((k % 10 == 0) & (k > 13)).select(commit_name(k).alias("commit"), commit_name(k - 13).alias("parent"))
    return all_k.select(commit_name(k).alias("commit"), F.when(k > 1, commit_name(k - 1)).alias("parent")).unionByName(merges)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, parent, version (null: unreadable), bytes and mtime of layers: of every
    third commit of the older seven tenths, and of some commits that are gone."""
    k, n, all_k = F.col("k"), newest(spark, sf_dir), numbers(spark, sf_dir)
    parent = F.when((k % 50 == 4) & (k <= 160), _gone(k - 1)).when(k > 3, commit_name(k - 3))
    version = F.when((k % 61 == 0) & (k < 400), 1).when((k % 67 != 0) | (k >= 400), VERSION)
    own = all_k.where((k % 3 == 1) & (k <= n * 7 // 10)).select(commit_name(k).alias("commit"), parent.alias("parent"), version.alias("version"), (k * 1000 + 7).alias("bytes"), k.alias("mtime"))
    left = all_k.where((k % 50 == 3) & (k <= n // 2)).select(_gone(k).alias("commit"), F.lit(None).cast("string").alias("parent"), F.lit(VERSION).alias("version"), k.alias("bytes"), k.alias("mtime"))
    return own.unionByName(left)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and commit: HEAD, a tag for every hundredth commit, and names of lost ones."""
    k, n, all_k = F.col("k"), newest(spark, sf_dir), numbers(spark, sf_dir)
    tags = all_k.where(k % 100 == 0).select(F.concat(F.lit("v"), k.cast("string")).alias("name"), commit_name(k).alias("commit"))
    head = all_k.where(k == n).select(F.lit("HEAD").alias("name"), commit_name(k).alias("commit"))
    return tags.unionByName(head).unionByName(all_k.where(k % 150 == 3).select(F.concat(F.lit("lost"), k.cast("string")).alias("name"), _gone(k).alias("commit")))


#: Characters to a piece of a file, of which a file has five at most.
PIECE = 200


def pieces(files: DataFrame) -> DataFrame:
    """The five chunks a file may have: chunk_index, offset (bytes) and piece (never
    empty) beside the columns of files; the last holds all that is left."""
    at = lambda i: F.substring("text", i * PIECE + 1, PIECE if i < 4 else 1 << 30)
    each = F.array(*(F.struct(F.lit(i).alias("chunk_index"), F.octet_length(F.substring("text", 1, i * PIECE)).cast("long").alias("offset"), at(i).alias("piece")) for i in range(5)))
    return files.select("*", F.explode(each).alias("e")).select(*files.columns, "e.*").where("piece <> ''")


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and text of every document."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.format_string("%06d", "doc_id"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, doc_id, path and text of the three snapshots, from one scan."""
    d = F.col("doc_id")
    edit1 = F.when(d % 7 == 3, F.concat("text", F.lit("\nrev c1"))).otherwise(F.col("text"))
    edit2 = F.when(d % 11 == 4, F.concat("text", F.lit("\nrev c2"))).otherwise(edit1)

    def version(commit: str, there: Column, text: Column) -> Column:
        return F.when(there, F.struct(F.lit(commit).alias("commit"), text.alias("text")))

    versions = F.array_compact(F.array(version("c0", d % 10 != 9, F.col("text")), version("c1", ((d % 10 != 9) | (d % 20 == 9)) & (d % 31 != 5), edit1), version("c2", (d % 31 != 5) & (d % 29 != 8), edit2)))
    return base_files(spark, sf_dir).select("doc_id", "path", F.explode(versions).alias("v")).select("v.commit", "doc_id", "path", "v.text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and its 64-bit code."""
    return table(spark, sf_dir, "embeddings").select("vec_id", quantise("embedding", 64).alias("code"))


def chunks(spark: SparkSession, sf_dir: str, changed: DataFrame) -> DataFrame:
    """commit, doc_id, chunk_index and code (null: not embedded yet) of all layers.

    ``changed`` has (commit, doc_id) of files a delta layer holds.
    """
    codes = vectors(spark, sf_dir)
    n = codes.count()
    held = files(spark, sf_dir).where("commit = 'c0'").select("commit", "doc_id").unionByName(changed.select("commit", "doc_id"))
    slots = codes.select(F.col("vec_id").alias("slot"), F.expr("vec_id div 5").alias("doc_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"))
    source = F.when(F.col("commit") == "c0", F.col("slot")).when(F.col("commit") == "c1", (F.col("slot") * 7 + 13) % n).otherwise((F.col("slot") * 11 + 29) % n)
    missing = (F.col("commit") == "c1") & (F.col("slot") % 97 == 0)
    placed = slots.join(held, "doc_id").withColumn("vec_id", source).withColumn("missing", missing)
    return placed.join(codes, "vec_id").select("commit", "doc_id", "chunk_index", F.when(~F.col("missing"), F.col("code")).alias("code"))
