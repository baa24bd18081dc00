"""Streams: city-day counts that late posts still reach, and posts seen for the first time.

Both keep keyed state under a watermark and end with the input (``availableNow``) or run on; a run that starts
again from the same checkpoint folder goes on where the last one stopped, and reads no file twice. Rows later than the watermark are
left out, as the watermark says; null event times and null keys take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalis.sources.scratch import fresh_folder


def streaming_city_day(posts: DataFrame, event_time: str = "ts", late: str = "1 day") -> DataFrame:
    """Per city and day: positives and posts, final once the watermark has passed the day."""
    days = posts.withWatermark(event_time, late).groupBy(F.window(event_time, "1 day").alias("w"), "city")
    return days.agg(F.sum(F.col("indicator").cast("int")).alias("heat_posts"), F.count("*").alias("observed_posts")).select("city", F.to_date("w.start").alias("date"), "heat_posts", "observed_posts")


def streaming_first_seen(posts: DataFrame, key: str, event_time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first post of ``key`` within the watermark; its repeats are dropped."""
    return posts.where(F.col(key).isNotNull()).withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def streaming_spells(posts: DataFrame, key: str, event_time: str = "ts", quiet: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Spells of activity of ``key``: its posts with less than ``quiet`` between neighbours, in event time.

    A custom state holds the open spells of a key (start, end, first post, count); late posts may lengthen a spell, start one or
    join two, and a spell is given out once the watermark has left its end behind by ``quiet``. Of posts at a spell's first
    moment the least ``row_index`` counts as the first.
    """
    gap = int(pd.Timedelta(quiet).total_seconds() * 1_000_000)
    kept = "first array<long>, last array<long>, row array<long>, posts array<long>"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spells = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches if not state.hasTimedOut else ():
            spells += [(int(t), int(t), int(r), 1) for t, r in zip(b["at"], b["row_index"], strict=True)]
        joined: list[tuple] = []
        for s in sorted(spells, key=lambda s: (s[0], s[2])):
            if joined and s[0] - joined[-1][1] < gap:
                a = joined[-1]
                joined[-1] = a[0], max(a[1], s[1]), a[2], a[3] + s[3]
            else:
                joined.append(s)
        passed = state.getCurrentWatermarkMs() * 1000
        open_ = [s for s in joined if s[1] + gap > passed]
        if open_:
            state.update(tuple(map(list, zip(*open_, strict=True))))
            state.setTimeoutTimestamp(-(-(min(s[1] for s in open_) + gap) // 1000))
        elif state.exists:
            state.remove()
        done = [s for s in joined if s[1] + gap <= passed]
        if done:
            yield pd.DataFrame([(k[0], *s) for s in done], columns=[key, "first", "last", "row", "posts"])

    named = posts.where(F.col(key).isNotNull()).select(key, F.col(event_time).alias("ts"), F.unix_micros(event_time).alias("at"), F.col("row_index").cast("long").alias("row_index"))
    out = f"{key} {posts.schema[key].dataType.simpleString()}, first long, last long, row long, posts long"
    found = named.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, out, kept, "append", "EventTimeTimeout")
    return found.select(key, F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), F.col("row").alias("first_row"), "posts")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what there is and stop; a later run with the same checkpoint goes on from here."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    """The parquet files of a folder, or one file, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The rows a stream gives until its input ends."""
    folder = fresh_folder(spark, name)
    run_to_end(stream, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
