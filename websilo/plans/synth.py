"""Archive records made from the test tables, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as body_fields
from ..operators.render import build, exchange, render
from ..sources.warc import read_warc, write_warc
from ..storage import new_folder, settled

PER_FILE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as there are cores, by columns, where it has fewer: a table may be a single row group."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *by)


def urn(key: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(key.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def key(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def day(column: str) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col(column)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def field_list(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("name"), v.alias("value")) for n, v in values.items()])


def response_bytes() -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html")).cast("binary")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered records with (file_no, place): one warcinfo for each 50 pages, then request, response and metadata of each."""
    pages = table(spark, sf_dir, "pages").withColumn("file_no", F.floor(F.col("page_id") / PER_FILE))
    request = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("\r\n\r\n")).cast("binary")
    events = exchange(
        pages, request=request, response=response_bytes(), target_uri=F.col("url"), date=day("page_id"),
        ids=(urn(key("q", "page_id")), urn(key("r", "page_id")), urn(key("m", "page_id"))), warcinfo_id=urn(key("i", "file_no")),
        ip_address=F.lit("192.0.2.7"), fetch_time_ms=F.col("page_id") % 97 + 3, keep=["file_no", "page_id"])
    rows = events.withColumn("place", (F.col("page_id") % PER_FILE) * 3 + F.col("seq") + 1)
    infos = pages.groupBy("file_no").agg(F.min("page_id").alias("page_id"))
    infos = build(infos, "warcinfo", keep=["file_no", "page_id"], record_id=urn(key("i", "file_no")), date=day("page_id"),
                  filename=F.concat(F.lit("part-"), F.col("file_no").cast("string"), F.lit(".warc")),
                  body_fields=field_list(software=F.lit("websilo/1.0"), operator=F.lit("Ada <ada@example.org>")))
    both = rows.drop("seq").unionByName(infos.withColumn("place", F.lit(0)), allowMissingColumns=True)
    return render(both)


def as_raw(rendered: DataFrame) -> DataFrame:
    """Rendered records as a table of raw records: file by file_no, index by place."""
    return settled(_as_raw(rendered))


def _as_raw(rendered: DataFrame) -> DataFrame:
    return rendered.select(
        F.concat(F.lit("part-"), F.lpad(F.col("file_no").cast("string"), 6, "0"), F.lit(".warc")).alias("file"), F.col("place").cast("long").alias("record_index"),
        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), "version", "headers", "content_length", "body",
        F.lit(None).cast("struct<level: string, code: string, field: string, message: string>").alias("error"))


def archive(spark: SparkSession, sf_dir: str, compression: str = "gzip") -> str:
    """The captures written as an archive; its folder."""
    path = new_folder(spark, "archive")
    rows = captures(spark, sf_dir).repartition("file_no").sortWithinPartitions("file_no", "place")
    write_warc(rows, path, compression, level=1)
    return path


def captured(spark: SparkSession, sf_dir: str, bodies: bool = True, compression: str = "gzip") -> DataFrame:
    """The captures, written as an archive and read back."""
    return read_warc(spark, archive(spark, sf_dir, compression), bodies)


__all__ = ["archive", "as_raw", "body_fields", "captured", "captures", "day", "field_list", "key", "settled", "spread", "table", "urn"]
