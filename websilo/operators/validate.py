"""Validation of archives at the three levels, with a tally for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .digests import check_digests
from .grammar import to_untyped
from .semantic import to_semantic

LEVELS = ("raw", "untyped", "record")


def judged(raw: DataFrame, level: str, digests: bool = True) -> DataFrame:
    """(file, record_index, error's message and code or null) at a level; the record level checks digests too."""
    out = raw
    if level in ("untyped", "record"):
        out = to_untyped(out)
    if level == "record":
        out = to_semantic(out)
        if digests:
            out = check_digests(out)
            out = out.withColumn("error", F.coalesce("error", "block_digest_error", "payload_digest_error"))
    return out.select("file", "record_index", F.col("error")["message"].alias("message"), F.col("error")["code"].alias("code"))


def judged_at_all(raw: DataFrame) -> DataFrame:
    """(file, record_index, level, message, code) of every record at every level, reading it once."""
    out = raw.withColumn("_raw", F.col("error"))
    out = to_untyped(out).withColumn("_untyped", F.col("error"))
    out = check_digests(to_semantic(out))
    record = F.coalesce("error", "block_digest_error", "payload_digest_error")
    each = zip(LEVELS, (F.col("_raw"), F.col("_untyped"), record))
    told = F.array(*[F.struct(F.lit(n).alias("level"), e["message"].alias("message"), e["code"].alias("code")) for n, e in each])
    return out.select("file", "record_index", F.inline(told))


def _tally(judgements: DataFrame) -> DataFrame:
    by_file = judgements.groupBy("file", "level").agg(
        F.count(F.when(F.col("message").isNull(), 1)).alias("records"), F.count("message").alias("errors"),
        F.coalesce(F.max(F.col("code") == "Source"), F.lit(False)).alias("unread"))
    return by_file.select("file", "level", "records", "errors", F.when(F.col("unread"), "error").when(
        (F.col("errors") == 0) & (F.col("records") > 0), "passed").otherwise("failed").alias("status"))


def validate(raw: DataFrame, level: str) -> DataFrame:
    """(file, level, records, errors, status): a file without records fails, as one with errors does.

    A grammar or record fault costs its record; a framing fault is a file's last row.
    A file whose source couldn't be read on has the status error.
    """
    return _tally(judged(raw, level).withColumn("level", F.lit(level)))


def expected(results: DataFrame, files: DataFrame) -> DataFrame:
    """results of validate, and of each of files (file) that has none a row of each level with the status unavailable."""
    levels = results.select("level").distinct()
    missing = files.select("file").distinct().join(results.select("file").distinct(), "file", "left_anti").join(F.broadcast(levels), F.lit(True))
    none = F.lit(0).cast("long")
    return results.unionByName(missing.select("file", "level", none.alias("records"), none.alias("errors"), F.lit("unavailable").alias("status")))


def summary(results: DataFrame) -> DataFrame:
    """(level, passed, failed, error, unavailable, success): files by status for each level, and over all (level null); success: all passed."""
    of = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("passed", "failed", "error", "unavailable")]
    return results.rollup("level").agg(*of, (F.count(F.lit(1)) == F.count(F.when(F.col("status") == "passed", 1))).alias("success"))


def validate_all(raw: DataFrame) -> DataFrame:
    """``validate`` at every level, in one pass."""
    return _tally(judged_at_all(raw))


def messages(raw: DataFrame, level: str) -> DataFrame:
    """(file, position, message): positions count from 1 over all rows."""
    return judged(raw, level).where(F.col("message").isNotNull()).select("file", (F.col("record_index") + 1).alias("position"), "message")


def segment_faults(records: DataFrame) -> DataFrame:
    """(origin_id, segments, last, problem): series of segments with a gap, a repeat or no origin."""
    ok = records.where(F.col("error").isNull() & F.col("segment_number").isNotNull())
    key = F.when(F.col("record_type") == "continuation", F.col("segment_origin_id")).otherwise(F.col("record_id"))
    series = ok.groupBy(key.alias("origin_id")).agg(
        F.count(F.lit(1)).alias("segments"), F.countDistinct("segment_number").alias("numbers"),
        F.max("segment_number").cast("long").alias("last"), F.min("segment_number").cast("long").alias("first"))
    why = F.when(F.col("first") != 1, "no origin").when(F.col("numbers") < F.col("segments"), "repeated segment").when(F.col("numbers") < F.col("last"), "missing segment")
    return series.select("origin_id", "segments", "last", why.alias("problem")).where(F.col("problem").isNotNull())
