"""Streaming forms of the replays: sessions, pacing, caches and single flight.

Event time is the column ts, a TIMESTAMP. Rows with a null time or key belong to no session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.session import scratch


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The events table of a scale folder as a stream, with ts as a zoned time that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # the table is a folder of part files, or one file of the scale folder
    rows = source.parquet(f"{sf_dir}/events.parquet") if folder else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, events: sessions that a pause of gap ends."""
    window = F.session_window("ts", gap).alias("w")
    return events.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late).groupBy(key, window).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def paced(requests: DataFrame, key: str, interval: float) -> DataFrame:
    """key, t, start: starts within a key are interval seconds apart, in order of arrival; a key's next start is the state."""
    return _replayed(requests, key, lambda t, free: (max(t, free), max(t, free) + interval), "start double")


def anchored(requests: DataFrame, key: str, span: float) -> DataFrame:
    """key, t, hit: a row before anchor + span is a hit; a miss sets the anchor, hits do not move it. In order of arrival."""
    return _replayed(requests, key, lambda t, until: (True, until) if t < until else (False, t + span), "hit boolean")


def _replayed(requests: DataFrame, key: str, rule: Callable[[float, float], tuple], out: str) -> DataFrame:
    """rule(t, a key's number) gives the row's value and the key's next number, which is the state."""
    name = out.split()[0]

    def run(group: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get[0] if state.exists else float("-inf")
        for chunk in chunks:
            times, values = chunk["t"].tolist(), []
            for t in times:
                value, kept = rule(t, kept)
                values.append(value)
            yield pd.DataFrame({key: [group[0]] * len(times), "t": times, name: values})
        state.update((kept,))

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, "t").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t double, {out}", "kept double", "append", GroupStateTimeout.NoTimeout)


def settle(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now; its last result (complete) or all its rows (append), from the shared scratch folder.

    complete keeps every group's state, which a finite replay needs to see its last sessions; an endless stream runs in append
    mode, where the watermark bounds the state and a session comes out once it is closed."""
    spark = stream.sparkSession
    out, marks = scratch(spark, "stream"), scratch(spark, "stream-marks")

    def put(batch: DataFrame, n: int) -> None:
        # a repeated batch replaces its own files, so a restart doubles nothing
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/n={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no batch came
        return spark.createDataFrame([], stream.schema)
    done = spark.read.schema(stream.schema).parquet(out)
    return done.select(*stream.columns)
