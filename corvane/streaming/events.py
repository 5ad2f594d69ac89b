"""Event streams with Structured Streaming: the batch queries of the ledger as streams over files, with state and late data bounded.

Each function takes a streaming DataFrame (user_id, event_id, event_type, ts, value) and returns one; `run` drives a bounded stream to its
end (availableNow) into a folder and gives the result back as a batch, which is how the queries and tests use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.session import shared_dir, ship


def source(spark: SparkSession, folder: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """The files of a table as a stream; a pattern, since the table may be one file or a folder of them."""
    ship(spark)
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{table[:-1]}[{table[-1]}].parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once; its identity is kept for as long as late copies may come."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event of a bounded stream once, however late: its identity is kept to the end."""
    return events.dropDuplicates(["user_id", "event_id"])


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def fenced(events: DataFrame, current: DataFrame) -> DataFrame:
    """Events of the current generation of their stream; current: (user_id, current), read anew by each micro-batch's join."""
    return events.join(current, "user_id").where(F.col("generation") >= F.col("current")).drop("current")


STAGES = "user_id long, stages string, n long"


def completed_stages(events: DataFrame) -> DataFrame:
    """After each micro-batch, the kinds of events that a stream has seen so far, for resuming it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, n = state.get if state.exists else ("", 0)
        kinds = {x for x in seen.split(",") if x}
        for b in batches:
            kinds |= set(b["event_type"].dropna())
            n += len(b)
        state.update((",".join(sorted(kinds)), n))
        yield pd.DataFrame({"user_id": [key[0]], "stages": [",".join(sorted(kinds))], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, STAGES, "seen string, n long", "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a bounded stream to its end. append goes to a file sink; complete and update keep the last result of each micro-batch."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint")
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", f"{at}/out")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out"))
    q = writer.start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
