"""Exports of records as CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.http import strict_json
from .digests import with_payload


def short_id(uri: Column) -> Column:
    """A urn's path without its scheme; other ids whole."""
    return F.when(F.lower(uri).startswith("urn:"), F.regexp_replace(F.substring(uri, F.lit(5), F.length(uri)), r"[?#].*$", "")).otherwise(uri)


def csv_rows(records: DataFrame) -> DataFrame:
    """(file, record_index, type, date, record_id, target_uri); reading an unreadable record fails the job."""
    ok = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("record "), F.col("record_index").cast("string"), F.lit(": "), F.col("error")["message"])))
    return records.select("file", "record_index", F.coalesce(ok.cast("string"), F.col("record_type")).alias("type"),
                          v.show_date(F.col("date"), F.col("version")).alias("date"), short_id(F.col("record_id")).alias("record_id"),
                          F.coalesce("target_uri", F.lit("")).alias("target_uri"))


def write_csv(records: DataFrame, path: str) -> None:
    """CSV files with a header, in order of file and place across files."""
    rows = csv_rows(records).orderBy("file", "record_index").select("type", "date", "record_id", "target_uri")
    rows.write.option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def json_lines(records: DataFrame) -> DataFrame:
    """(file, record_index, record_id, line, error): payloads of records that declare JSON, one line each."""
    subtype = F.lower(F.col("identified_payload_type")["subtype"])
    declared = F.col("error").isNull() & ((subtype == "json") | subtype.endswith("+json"))
    chosen = with_payload(v.held(records, _declared=declared).where("_declared").drop("_declared"))
    text = F.col("payload").cast("string")
    line = F.regexp_replace(text, r"\r?\n\z", "")
    at = F.concat(F.lit("record "), F.col("record_index").cast("string"), F.lit(" ("), F.col("record_id"), F.lit("): "))
    why = (
        F.when(F.col("payload_error").isNotNull(), "cannot extract the payload").when(F.col("payload").isNull(), "the record type has no payload")
        .when(~strict_json(F.col("payload")), "the payload is not JSON").when(line.contains("\n"), "the payload spans more than one line")
    )
    out = chosen.withColumn("_why", why)
    return out.select("file", "record_index", "record_id", F.when(F.col("_why").isNull(), line).alias("line"),
                      F.when(F.col("_why").isNotNull(), F.concat(at, F.col("_why"))).alias("error"))


def write_json_lines(records: DataFrame, path: str) -> None:
    """Text files of lines; a payload that can't be one fails the job."""
    rows = json_lines(records).orderBy("file", "record_index")
    rows.select(F.coalesce("line", F.raise_error(F.col("error")).cast("string")).alias("value")).write.text(path)
