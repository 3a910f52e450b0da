"""Sessions of users over a stream of events: gaps, late rows, and state that is let go."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.scratch import Scratch
from kinfold.sources.tables import stream_files

#: The time of the row that ends a stream: later than any event.
END = datetime(9999, 1, 1)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """key, session_start, session_end (its last event), n_events, total_value: runs of a key's events with less than `gap` from
    one to the next. On a stream, rows that come `late` behind the latest one may be left out, and a session that can't grow
    any more is given out and forgotten. Rows with a null key or time are in none."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    found = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n_events"), F.sum(value).alias("total_value"))
    return found.drop("w")


def run(spark: SparkSession, path: str, root: str | None = None, files: int = 1, end: bool = True, **options) -> DataFrame:
    """The sessions of a folder of event files, read as a stream, so many files at a time. Started again with its folder `root` it
    goes on from its checkpoint with what is new. end: the stream is over; a last row, far in the future, moves the
    watermark past all sessions."""
    root = root or f"{Scratch(spark).root}/sessions"
    schema = spark.read.parquet(path).schema
    key, ts = options.get("key", "user_id"), options.get("ts", "ts")
    nothing = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    nothing.limit(0).write.mode("append").parquet(f"{root}/end")
    rows = stream_files(spark, path, files).unionByName(spark.readStream.schema(schema).parquet(f"{root}/end"))

    def go() -> None:
        writer = sessions(rows, **options).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()

    go()
    if end:
        nothing.withColumn(key, F.lit(-1).cast(schema[key].dataType)).withColumn(ts, F.lit(END).cast(schema[ts].dataType)).write.mode("append").parquet(f"{root}/end")
        go()
    return spark.read.parquet(f"{root}/out").where(F.col("session_end") < F.lit(END))
