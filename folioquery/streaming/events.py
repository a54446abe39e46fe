"""The event stream: an NDJSON source and sink, windows with watermarks, sessions, span pairing, tail sampling and span export."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def work_dir(spark: SparkSession) -> str:
    """A new folder for streams' checkpoints and outputs, in the shared folder of the cluster where it names one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def write_log(events: DataFrame, path: str) -> None:
    """Append events as NDJSON shards."""
    events.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str | StructType = EVENT) -> tuple[DataFrame, DataFrame]:
    """(events, torn): the lines of an NDJSON log; lines that do not parse are set aside."""
    fields = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    lines = spark.read.text(path).select(F.from_json("value", fields + ", _corrupt_record string").alias("e"))
    return lines.where("e._corrupt_record IS NULL").select("e.*").drop("_corrupt_record"), lines.where("e._corrupt_record IS NOT NULL").select("e._corrupt_record")


def stream_table(spark: SparkSession, path: str, files: int | None = 8) -> DataFrame:
    """A parquet table read as a stream, `files` files a batch; None takes the whole table in one batch, so that no row can be late."""
    import os

    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", name).parquet(folder)
    # Watermarks need instants; wall-clock columns are read in the session's time zone.
    return rows.withColumns({n: F.col(n).cast("timestamp") for n, t in rows.dtypes if t == "timestamp_ntz"})


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into a parquet table (exactly once, by its checkpoint) and read that; complete results keep the last batch."""
    spark = stream.sparkSession
    base = work_dir(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, cents): counts and sums per window; complete results on a stream."""
    w = F.window("ts", width)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """(start, n): counts per sliding window."""
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap of `gap` or more."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def pair_spans(starts: DataFrame, ends: DataFrame, key: str, most: str = "1 hour") -> DataFrame:
    """(key, start_id, end_id, started, ended): each end with the starts of its key before it, within `most`; the state of a stream join is bounded by it.

    starts and ends are (key, id, ts). For streams the watermarks let old rows go.
    """
    a = starts.select(F.col(key), F.col("id").alias("start_id"), F.col("ts").alias("started"))
    b = ends.select(F.col(key).alias("k"), F.col("id").alias("end_id"), F.col("ts").alias("ended"))
    if starts.isStreaming:
        a, b = a.withWatermark("started", most), b.withWatermark("ended", most)
    return a.join(b, (F.col(key) == F.col("k")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {most}"))).drop("k")


def otlp(rows: DataFrame) -> DataFrame:
    """(trace_id, span_id, name, start_ns, end_ns, status): events as OTLP spans; a trace is a user, value is seconds x 1000, an error has status 2."""
    start = F.unix_micros("ts") * 1000 if dict(rows.dtypes)["ts"] == "timestamp" else F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    id_ = lambda c: F.md5(F.col(c).cast("string"))
    return rows.select(id_("user_id").alias("trace_id"), F.substring(id_("event_id"), 1, 16).alias("span_id"), F.col("event_type").alias("name"), start.alias("start_ns"), (start + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("end_ns"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"))


def tail_sample(events: DataFrame, key: str, keep_all, percent: int) -> DataFrame:
    """Events of every key that keep_all marks, and of `percent` in a hundred of the other keys, chosen by hash: the sampling operator."""
    marked = events.where(keep_all).select(key).distinct()
    chosen = F.pmod(F.xxhash64(F.col(key)), F.lit(100)) < percent
    return events.where(chosen).unionByName(events.where(~chosen).join(marked, key, "left_semi"))


def export_batches(stream: DataFrame, send: Callable[[list[dict], int], None], at_most: int = 512):
    """A running query that hands rows to `send` in lists of at most `at_most`, on the executors; the checkpoint is the cursor."""
    base = work_dir(stream.sparkSession)

    def deliver(batch: DataFrame, epoch: int) -> None:
        def part(rows) -> None:
            held: list[dict] = []
            for r in rows:
                held.append(r.asDict(recursive=True))
                if len(held) == at_most:
                    send(held, epoch)
                    held = []
            if held:
                send(held, epoch)

        batch.foreachPartition(part)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{base}/cursor").trigger(availableNow=True).start()
