"""Verification of whole archives: structure, ids, references, segments, digests, compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..sources.warc import read_warc
from ..storage import settled
from .digests import check_digests
from .grammar import get, to_untyped
from .graph import EDGE_FIELDS
from .merge import normal_id
from .semantic import to_semantic

#: What may be wrong: a record at one of the three levels, its digests, its id (missing, or another record's), a
#: reference to no record of these files, a series of segments, or a gzip member that isn't one record.
CHECKS = ("structure", "digest", "id", "reference", "segment", "compression")


def narrow(spark: SparkSession, path: str, compression: str = "auto") -> DataFrame:
    """A row for each record with what the checks need of it, and no block; files are read once."""
    raw = read_warc(spark, path, compression=compression, members=True)
    targets = F.concat(*[F.transform(F.filter("headers", _is(n)), lambda h: normal_id(h["value"])) for n in EDGE_FIELDS])
    raw = raw.withColumns({"header_id": normal_id(get("WARC-Record-ID")), "targets": F.filter(targets, lambda t: t.isNotNull())})
    checked = check_digests(to_semantic(to_untyped(raw)))
    return settled(checked.select(
        "file", "record_index", "header_id", "targets", "members_begun", "starts_member", F.col("error")["message"].alias("fault"), F.col("error")["level"].alias("level"),
        F.coalesce("block_digest_error", "payload_digest_error")["message"].alias("digest_fault"),
        "record_type", "segment_number", "segment_origin_id", "segment_total_length", F.length("body").cast("long").alias("size"), v.bare_uri(F.col("record_id")).alias("record_id")))


def _is(name: str):
    return lambda h: F.lower(h["name"]) == name.lower()


def verify(spark: SparkSession, path: str, compression: str = "auto") -> DataFrame:
    """(file, record_index, record_id, check, message): every fault that is found, over all files together.

    References may lead into other files; each distinct target is looked up once, so a
    record that many refer to is no hot key.  A member's number comes from the reader: a
    record must begin a member, and only one may have begun since the last record.
    """
    rows = narrow(spark, path, compression)
    found = lambda df, check, message: df.select("file", "record_index", F.col("header_id").alias("record_id"), F.lit(check).alias("check"), message.alias("message"))
    structure = found(rows.where("fault IS NOT NULL"), "structure", F.col("fault"))
    digest = found(rows.where("fault IS NULL AND digest_fault IS NOT NULL"), "digest", F.col("digest_fault"))
    packed = found(rows.where("NOT starts_member OR members_begun <> 1"), "compression", F.when(
        F.col("starts_member"), F.concat((F.col("members_begun") - 1).cast("string"), F.lit(" members without a record of their own come before"))).otherwise("the record begins inside of a member"))
    named = rows.where("header_id IS NOT NULL")
    counts = named.groupBy("header_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "record_index")).alias("first"))
    again = named.join(counts.where("n > 1"), "header_id").where(F.struct("file", "record_index") != F.col("first"))
    ids = found(again, "id", F.concat(F.lit("record "), F.col("first")["record_index"].cast("string"), F.lit(" of "), F.col("first")["file"], F.lit(" has the same id"))).unionByName(
        found(rows.where("header_id IS NULL AND coalesce(level, '') NOT IN ('stream', 'raw')"), "id", F.lit("the record has no id")))
    refers = rows.select("file", "record_index", "header_id", F.explode("targets").alias("target"))
    nowhere = refers.select("target").distinct().join(counts.select(F.col("header_id").alias("target")), "target", "left_anti")
    reference = found(refers.join(nowhere, "target"), "reference", F.concat(F.lit("no record has the id "), F.col("target")))
    return structure.unionByName(digest).unionByName(packed).unionByName(ids).unionByName(reference).unionByName(segments(rows))


def segments(rows: DataFrame) -> DataFrame:
    """Faults of series: told at the series' last record."""
    key = F.when(F.col("record_type") == "continuation", F.col("segment_origin_id")).otherwise(F.col("record_id"))
    at = F.struct(F.col("segment_number").cast("long").alias("n"), "file", "record_index", "header_id", F.col("segment_total_length").cast("decimal(20,0)").alias("total"))
    series = rows.where("fault IS NULL AND segment_number IS NOT NULL").groupBy(key.alias("series")).agg(
        F.count(F.lit(1)).alias("parts"), F.countDistinct("segment_number").alias("numbers"), F.max(at).alias("last"), F.min("segment_number").cast("long").alias("first"),
        F.sum("size").cast("decimal(20,0)").alias("bytes"), F.count("segment_total_length").alias("totals"))
    last = F.col("last")
    why = (F.when(F.col("first") != 1, "the series has no origin").when(F.col("numbers") < F.col("parts"), "a number of the series stands there twice")
           .when(F.col("numbers") < last["n"], "the series has a gap").when(last["total"].isNull() & (last["n"] > 1), "the last segment gives no total length")
           .when(last["total"] != F.col("bytes"), F.concat(F.lit("the segments have "), F.col("bytes").cast("string"), F.lit(" bytes, not "), last["total"].cast("string")))
           .when(F.col("totals") > 1, "more than the last segment gives a total length"))
    return series.where(why.isNotNull()).select(last["file"].alias("file"), last["record_index"].alias("record_index"), last["header_id"].alias("record_id"),
                                                F.lit("segment").alias("check"), why.alias("message"))
