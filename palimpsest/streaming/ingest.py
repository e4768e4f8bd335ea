"""Streams: layers appended as they arrive, and the token rate of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds of the sliding window and tokens it may hold.
WINDOW_S, RATE_TOKENS = 60, 2_800_000


def append_layers(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append streamed chunks (commit and others) to a table by commit.  A batch
    that is run again writes its own folder again, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.repartition("commit").write.mode("overwrite").partitionBy("commit").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_rates(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Tokens per tumbling minute of a stream (ts, tokens); ts becomes a timestamp,
    as watermarks need."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{WINDOW_S} seconds").alias("w")).agg(F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), "tokens")


def rate_window(events: DataFrame) -> DataFrame:
    """event_id, tokens of the 60 s up to its time (an event just 60 s old has
    left), and whether they are within the rate.  ``events``: event_id, ts, tokens.

    Tokens are summed by time first; windows then run within minutes, each of
    which also holds the sums of the minute before, so no task gets the whole
    stream and one busy instant is one row.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    sums = events.groupBy(micros.alias("t")).agg(F.sum("tokens").alias("tokens"))
    minute = F.floor(F.col("t") / (WINDOW_S * 1_000_000)).cast("long")
    own = sums.withColumn("minute", minute).withColumn("own", F.lit(True))
    both = own.unionByName(own.select("t", "tokens", (F.col("minute") + 1).alias("minute"), F.lit(False).alias("own")))
    w = Window.partitionBy("minute").orderBy("t").rangeBetween(-(WINDOW_S * 1_000_000 - 1), 0)
    used = both.withColumn("used", F.sum("tokens").over(w)).where("own").select("t", "used")
    return events.select("event_id", micros.alias("t")).join(used, "t").select("event_id", F.col("used").cast("long").alias("tokens_60s"), (F.col("used") <= RATE_TOKENS).alias("within_rate"))
