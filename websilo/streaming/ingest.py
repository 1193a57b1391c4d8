"""Archives that arrive or grow in a folder, as a stream of records.

The stream source (``sources.stream``) passes on records as files hold them to their ends.
Captures are counted in windows of event time with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators.grammar import to_untyped
from ..operators.semantic import to_semantic_header
from ..sources.warc import register


def stream_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Raw records of the archives below a folder as they arrive, each once; a restart goes on from its checkpoint."""
    register(spark)
    return spark.readStream.format("warc").option("bodies", str(bodies).lower()).load(path)


def captures_by_window(raw: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, record_type, n, bytes): records in windows of their dates; records later than the watermark are left out."""
    records = to_semantic_header(to_untyped(raw)).where(F.col("error").isNull())
    timed = records.select(F.col("date")["ts"].alias("ts"), "record_type", F.length("body").alias("size")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width), "record_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return counted.select(F.col("window")["start"].alias("start"), "record_type", "n", "bytes")


def first_captures(raw: DataFrame, late: str = "1 day") -> DataFrame:
    """Responses whose payload digest wasn't seen before within the watermark (keyed state)."""
    records = to_semantic_header(to_untyped(raw)).where(F.col("error").isNull() & (F.col("record_type") == "response"))
    keyed = records.select(F.col("date")["ts"].alias("ts"), "record_id", "target_uri", v.digest_key(F.col("payload_digest")).alias("key"))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])
