"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_path, shared_path, spread_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the least id that links reach) of every id on an edge.

    Each round hooks every node to the least of its neighbours, first from the
    larger side, then from the smaller, until the edges are stars.  Minima are
    combined map-side, and nodes with very many edges get theirs by a short list
    sent to all tasks, so no task holds all edges of one node; each round is written
    to the shared folder, which cuts the lineage.  Loops and null ends are ignored;
    an empty list gives no rows.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    current = clean.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
    path, mark = None, None
    while True:
        old, path = path, shared_path(spark, "components")
        current.write.parquet(path)
        current = spark.read.schema(current.schema).parquet(path)
        if old:
            remove_path(spark, old)
        row = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40))).alias("h")).head()
        if mark == (row.n, row.h):
            return current.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component")).unionByName(current.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        mark = (row.n, row.h)
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")).select("u", F.least("u", "m").alias("m"), "edges")
        large = spread_join(current.select(F.col("hi").alias("v"), F.col("lo").alias("u")), least, "u", "edges", row.n).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("edges"))
        small = spread_join(large, low, "hi", "edges", row.n).select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        current = small.select("e.hi", "e.lo").where("hi <> lo").distinct()
