"""Stream sources and sinks.

Production reads and writes message topics (``format("kafka")``): the
value is UTF-8 JSON, decoded with a declared schema; the message
timestamp is the event time.  Any other streaming format (files) reads
JSON rows with the same schema, or with the option ``messages`` whole
messages (key, value, timestamp) as a topic holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import MESSAGE_SCHEMA


def read_json_stream(spark: SparkSession, schema: T.StructType, fmt: str = "kafka",
                     path: str | None = None, options: dict | None = None,
                     ts_col: str = "ts") -> DataFrame:
    """Decode a JSON message stream; the result has ``schema`` plus ``ts``."""
    opts = dict(options or {})
    messages = str(opts.pop("messages", "false")).lower() == "true"
    if fmt == "kafka" or messages:
        if messages:
            raw = spark.readStream.format(fmt).schema(MESSAGE_SCHEMA).options(**opts).load(path)
        else:
            opts.setdefault("startingOffsets", "latest")
            raw = spark.readStream.format("kafka").options(**opts).load()
        body = F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"})
        return raw.select(body.alias("m"), F.col("timestamp").alias(ts_col)).select("m.*", ts_col)
    full = schema if ts_col in schema.fieldNames() else T.StructType(
        schema.fields + [T.StructField(ts_col, T.TimestampType())])
    reader = spark.readStream.format(fmt).schema(full).options(**opts)
    return reader.load(path) if path else reader.load()


def to_messages(df: DataFrame, key: str = "request_id", stamp: bool = False) -> DataFrame:
    """key/value columns for a message sink: value = JSON of the row.  With
    ``stamp`` also the time, which a broker would add (file topics)."""
    cols = [c for c in df.columns]
    out = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*cols)).alias("value")]
    return df.select(*out, *([F.current_timestamp().alias("timestamp")] if stamp else []))


def write_stream(df: DataFrame, fmt: str, checkpoint: str, path: str | None = None,
                 options: dict | None = None, trigger: dict | None = None,
                 output_mode: str = "append"):
    """Start a streaming write; the checkpoint makes it restartable and
    exactly-once for idempotent sinks."""
    w = (df.writeStream.format(fmt).outputMode(output_mode)
           .option("checkpointLocation", checkpoint).options(**(options or {})))
    if path:
        w = w.option("path", path)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
