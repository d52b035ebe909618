"""The daily marts over streams of files: event-time windows with a watermark, late data, deduplication, sessions and upserts by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, lateness: str = "12 hours", files: int | None = None) -> DataFrame:
    """A stream of Parquet files of events, each event once within the watermark; at most so many files a batch."""
    reader = spark.readStream.schema(EVENT) if files is None else spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files)
    rows = reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def daily(rows: DataFrame) -> DataFrame:
    """day, event_type, n and value of each day: the batch and the stream run the same plan."""
    day = F.window("ts", "1 day")
    return rows.groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "n", "value")


def sliding(rows: DataFrame, length: str = "7 days", step: str = "1 day") -> DataFrame:
    return rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "event_type", "n")


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def incidents(hits: DataFrame, days: int = 7) -> DataFrame:
    """user_id, event_id, ts and incident of each hit of a stream: a hit within so many days of the last one belongs to the same incident, else it opens the next.

    The state of a key is its last hit and its number of incidents, whatever came before; a hit that arrives late, before the last one, belongs to the incident that is open.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap = days * 86_400_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        at = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        before = np.maximum.accumulate(np.concatenate(([at[0] - gap - 1 if last is None else last], at)))
        fresh = at - before[:-1] > gap
        state.update((int(before[-1]), int(n + fresh.sum())))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "incident": n + np.cumsum(fresh)})

    told = hits.select("user_id", "event_id", "ts").groupBy("user_id")
    return told.applyInPandasWithState(step, "user_id long, event_id long, ts timestamp, incident long", "last long, n long", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that has arrived, batch by batch in order, and ends; a restart goes on where the checkpoint says."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_available(df: DataFrame, checkpoint: str, save) -> None:
    """Calls save(batch, batch_id) for each micro-batch; save must bear being called twice with one id."""
    df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
