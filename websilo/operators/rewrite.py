"""Rewriting warcinfo records, and copies of archives in other compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as body_fields
from ..functions import values as v
from .canonicalize import canonical


def split_two(value: Column, separator: str, terminator: str = "") -> Column:
    """struct(head, tail) of ``head<separator>tail<terminator>``; the tail is null if there is none."""
    cut = value if not terminator else F.when(value.endswith(terminator), F.substring(value, F.lit(1), F.length(value) - len(terminator)))
    has = F.coalesce(cut.contains(separator), F.lit(False))
    at = F.instr(cut, separator)
    head = F.when(has, F.substring(cut, F.lit(1), at - 1)).otherwise(value)
    return F.struct(head.alias("head"), F.when(has, F.substring(cut, at + len(separator), F.length(cut))).alias("tail"))


def set_two(df: DataFrame, name: str, head: Column | None, tail: Column | None, separator: str, terminator: str, part: str) -> DataFrame:
    """df with the given parts of a field's value set in ``_fields`` and the others kept; ``_why`` if a tail alone has none to replace."""
    if head is None and tail is None:
        return df
    df = df.withColumn("_now", body_fields.get(F.col("_fields"), name))
    df = df.withColumn("_now", split_two(F.col("_now"), separator, terminator))
    now = F.col("_now")
    df = df.withColumns({"_head": now["head"] if head is None else head, "_tail": now["tail"] if tail is None else tail})
    value = F.when(F.col("_tail").isNotNull(), F.concat("_head", F.lit(separator), "_tail", F.lit(terminator))).otherwise(F.col("_head"))
    lacks = F.lit(None).cast("string") if head is not None else F.when(now["tail"].isNull(), F.lit(f"the {name} field has no {part} to replace"))
    df = df.withColumn("_lacks", lacks)
    df = df.withColumns({"_value": F.when(F.col("_lacks").isNull(), value), "_why": F.coalesce("_why", "_lacks")})
    return df.withColumn("_fields", body_fields.put(F.col("_fields"), name, F.col("_value"))).drop("_now", "_head", "_tail", "_value", "_lacks")


def rewrite_warcinfo(records: DataFrame, filename: str | None = None, software: tuple[str | None, str | None] = (None, None),
                     operator: tuple[str | None, str | None] = (None, None), collection: str | None = None) -> DataFrame:
    """records (semantic, with headers and body) with values set in every warcinfo record; others are as they were.

    The length is measured anew, and the block digest computed under its declared
    algorithm (SHA-256 if that is unknown or there was none).  ``rewrite_error`` says
    why a record couldn't be changed.
    """
    info = F.coalesce((F.col("record_type") == "warcinfo") & F.col("error").isNull(), F.lit(False))
    lit = lambda x: None if x is None else F.lit(x)
    # a column for each step, so that none is computed twice
    out = records.withColumns({"_fields": F.when(info, F.col("body_fields")), "_why": F.lit(None).cast("string")})
    out = set_two(out, "software", *map(lit, software), "/", "", "version")
    out = set_two(out, "operator", *map(lit, operator), " <", ">", "email address")
    if collection is not None:
        out = out.withColumn("_fields", body_fields.put(F.col("_fields"), "isPartOf", F.lit(collection)))
    no_fields = F.when(F.col("body_fields").isNull(), F.lit("the block is not application/warc-fields"))
    out = out.withColumn("rewrite_error", F.when(info, F.coalesce(no_fields, "_why"))).drop("_why")
    go = info & F.col("rewrite_error").isNull()
    out = out.withColumn("_body", F.when(go, body_fields.render(F.col("_fields")))).drop("_fields")
    known = F.coalesce(F.col("block_digest")["algorithm"].isin("md5", "sha1", "sha256"), F.lit(False))
    digest = F.when(known, v.labelled(F.col("block_digest")["algorithm"], v.computed(F.col("block_digest")["algorithm"], F.col("_body")))).otherwise(
        F.concat(F.lit("sha256:"), F.sha2("_body", 256)))
    new = {"WARC-Block-Digest": digest, "Content-Length": F.length("_body").cast("string")}
    if filename is not None:
        new["WARC-Filename"] = F.lit(filename)
    kept = F.filter("headers", lambda h: ~F.lower(h["name"]).isin(*[n.lower() for n in new]))
    added = F.array(*[F.struct(F.lit(n).alias("name"), F.concat(F.lit(" "), t).cast("binary").alias("value")) for n, t in new.items()])
    # conditions rather than a filter: a filter would be pushed down, and its long expression be spelt out again
    out = out.withColumn("_go", go)
    pick = lambda new, old: F.when(F.col("_go"), new).otherwise(F.col(old))
    return out.withColumns({
        "headers": pick(canonical(F.concat(kept, added)), "headers"), "body": pick(F.col("_body"), "body"),
        "content_length": pick(F.length("_body").cast("decimal(20,0)"), "content_length")}).drop("_body", "_go")


def compress(raw: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Write raw records with a gzip member for each; (records, bytes) written."""
    from ..sources.warc import write_warc

    return write_warc(raw, path, "gzip", level).agg(F.count("length").alias("records"), F.sum("length").alias("bytes"))
