"""Merging archives: equal warcinfo records become one, and references follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..storage import settled
from .grammar import get, where_type

#: Fields that don't make warcinfo records differ, and fields that refer to records.
INCIDENTAL = ("WARC-Record-ID", "WARC-Date", "WARC-Filename", "WARC-Block-Digest", "Content-Length")
REFERENCES = ("WARC-Concurrent-To", "WARC-Warcinfo-ID", "WARC-Refers-To", "WARC-Segment-Origin-ID")


def normal_id(value: Column) -> Column:
    """An id without white space and angle brackets; null if nothing is left."""
    t = v.trim_space(v.latin(value), " \t\r\n\f")
    bare = F.regexp_replace(t, r"\A<([\s\S]*)>\z", "$1")
    return F.when(bare != "", bare)


def _key(raw: DataFrame) -> Column:
    kept = F.filter("headers", lambda h: ~F.lower(h["name"]).isin(*[n.lower() for n in INCIDENTAL]))
    pairs = F.array_sort(F.transform(kept, lambda h: F.struct(F.lower(h["name"]).alias("n"), v.trim_space(v.latin(h["value"]), " \t\r\n\f").alias("t"))))
    return F.struct(F.col("version").alias("version"), pairs.alias("fields"), F.sha2("body", 256).alias("block"))


def merge_plan(raw: DataFrame) -> DataFrame:
    """(file_seq, record_index, record_id, n, keep_seq, keep_index, keep_id, first): a row for each warcinfo record.

    Of equal ones the earliest dated is kept (undated last, then the first to come),
    and stands where the first of them stood (``first``).
    """
    info = where_type(raw, "warcinfo").select(
        "file_seq", "record_index", normal_id(get("WARC-Record-ID")).alias("record_id"),
        v.date(v.trim_space(v.latin(get("WARC-Date"))), F.col("version")).alias("date"), _key(raw).alias("key"))
    place = F.struct("file_seq", "record_index")
    order = F.struct(F.col("date").isNull().alias("undated"), F.col("date")["ts"].alias("ts"), F.col("date")["nanos"].alias("nanos"), "file_seq", "record_index")
    groups = info.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min_by(F.struct("file_seq", "record_index", "record_id"), order).alias("keep"))
    joined = info.join(groups, "key")
    return joined.select(
        "file_seq", "record_index", "record_id", "n", F.col("keep")["file_seq"].alias("keep_seq"), F.col("keep")["record_index"].alias("keep_index"),
        F.col("keep")["record_id"].alias("keep_id"), (F.col("first") == place).alias("first"), F.col("first").alias("group"))


def redirects(plan: DataFrame) -> DataFrame:
    """(record_id, keep_id): dropped ids and what they become; of several groups that drop an id, the first to come wins."""
    dropped = plan.where((F.col("n") > 1) & F.col("record_id").isNotNull() & (F.struct("file_seq", "record_index") != F.struct("keep_seq", "keep_index"))
                         & (F.col("record_id") != F.coalesce("keep_id", F.lit(""))))
    return dropped.groupBy("record_id").agg(F.min_by("keep_id", "group").alias("keep_id"))


def merge(raw: DataFrame) -> DataFrame:
    """The merged records in order of (file_seq, record_index); a kept warcinfo record takes its group's first place.

    raw has ``file_seq``, the order of its files.  References in the four referring
    fields to dropped ids become one blank and the kept id in angle brackets.  The
    plan is one row for each warcinfo record; bodies are not shuffled for it.
    """
    plan = merge_plan(raw)
    to = settled(redirects(plan))
    info = where_type(raw, "warcinfo")
    kept = info.select(F.col("file_seq").alias("keep_seq"), F.col("record_index").alias("keep_index"), "version", "headers", "content_length", "body")
    slots = plan.where("first").select("file_seq", "record_index", "keep_seq", "keep_index").join(kept, ["keep_seq", "keep_index"])
    other = raw.where(~F.coalesce(F.lower(v.trim_space(v.latin(get("WARC-Type")))) == "warcinfo", F.lit(False)))
    columns = ["file_seq", "record_index", "version", "headers", "content_length", "body"]
    return redirect(other.select(*columns).unionByName(slots.select(*columns)), to)


def redirect(records: DataFrame, to: DataFrame, bound: int = 1_000, most_bytes: int = 1 << 20) -> DataFrame:
    """records with references to ``record_id`` replaced by ``keep_id``; a small table is looked up in the row itself."""
    refers = [n.lower() for n in REFERENCES]
    n, size = to.limit(bound + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("record_id") + F.coalesce(F.octet_length("keep_id"), F.lit(0))), F.lit(0))).first()
    if n == 0:
        return records
    if n <= bound and size <= most_bytes:  # a map of checked size, sent once; it is searched in turn, so it is short
        table = F.broadcast(to.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("record_id", "keep_id"))).alias("_to")))
        new = lambda h: F.try_element_at(F.col("_to"), normal_id(h["value"]))
        changed = F.transform("headers", lambda h: F.struct(h["name"].alias("name"), F.when(
            F.lower(h["name"]).isin(*refers) & new(h).isNotNull(), F.concat(F.lit(" <"), new(h), F.lit(">")).cast("binary")).otherwise(h["value"]).alias("value")))
        return records.join(table, F.lit(True), "left").withColumn("headers", changed).drop("_to")
    # only referring lines are joined, and records without any stay as they are
    lines = records.select("file_seq", "record_index", F.posexplode("headers").alias("i", "h")).where(F.lower(F.col("h")["name"]).isin(*refers))
    lines = lines.select("file_seq", "record_index", "i", normal_id(F.col("h")["value"]).alias("record_id")).where(F.col("record_id").isNotNull())
    found = lines.join(to.where(F.col("keep_id").isNotNull()), "record_id").groupBy("file_seq", "record_index").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "keep_id"))).alias("_to"))
    at = lambda i: F.try_element_at(F.col("_to"), i)
    changed = F.transform("headers", lambda h, i: F.struct(h["name"].alias("name"), F.when(
        at(i).isNotNull(), F.concat(F.lit(" <"), at(i), F.lit(">")).cast("binary")).otherwise(h["value"]).alias("value")))
    return records.join(found, ["file_seq", "record_index"], "left").withColumn("headers", changed).select(*records.columns)


def in_order(files: DataFrame, names: list[str]) -> DataFrame:
    """files with file_seq, the place of each row's file in names; the names are a table, not a part of the plan."""
    order = files.sparkSession.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "file string, file_seq int")
    return files.join(order, "file", "left")


def first_by_id(records: DataFrame) -> DataFrame:
    """One row for each record id, the first to come."""
    w = Window.partitionBy("record_id").orderBy("file_seq", "record_index")
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
