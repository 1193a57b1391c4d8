"""Payloads and the digests that records declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.http import holds_http, with_entity_body
from .grammar import error


def with_payload(records: DataFrame) -> DataFrame:
    """records with ``payload`` and ``payload_error``: the block of resources and conversions, the entity body of HTTP
    requests and responses, null for others."""
    kind = F.col("record_type")
    http = kind.isin("request", "response") & holds_http(kind, F.col("target_uri"), F.col("content_type"))
    out = records.withColumn("_message", F.when(http, F.col("body")))
    out = with_entity_body(out, "_message", "_entity")
    return out.withColumns({
        "payload": F.when(kind.isin("resource", "conversion"), F.col("body")).when(http, F.col("_entity")["body"]),
        "payload_error": F.when(http, F.col("_entity")["error"]),
    }).drop("_message", "_entity")


def _compare(declared: Column, content: Column, what: str) -> Column:
    actual = v.computed(declared["algorithm"], content)
    shown = F.concat(declared["label"], F.lit(":"), declared["value"])
    stored = v.decoded(declared)
    name = what.capitalize()
    bad = error("block", f"Malformed{name}Digest", None, F.concat(
        F.lit(f"The {what} digest `"), shown, F.lit("` can't come from its algorithm.")))
    off = error("block", f"{name}DigestMismatch", None, F.concat(
        F.lit(f"Declared {what} digest `"), shown, F.lit("`, computed `"), v.labelled(declared["algorithm"], actual), F.lit("`.")))
    return F.when(declared.isNotNull() & actual.isNotNull(), F.when(stored.isNull(), bad).when(stored != actual, off))


def check_digests(records: DataFrame) -> DataFrame:
    """records with ``block_digest_error`` and ``payload_digest_error``.

    Unknown algorithms aren't checked.  Payloads of segments, of truncated records
    and under other transfer-codings aren't either; a message that can't be read
    is a fault where a payload digest is declared.
    """
    out = with_payload(records)
    whole = F.col("segment_number").isNull() & F.col("truncated").isNull() & F.col("payload_digest").isNotNull()
    unread = F.col("payload_error").isNotNull() & ~F.col("payload_error").contains("transfer-coding")
    broken = error("block", "Payload", None, F.concat(F.lit("Unreadable payload: "), F.col("payload_error")))
    return out.withColumns({
        "block_digest_error": _compare(F.col("block_digest"), F.col("body"), "block"),
        "payload_digest_error": F.when(whole, F.when(unread, broken).when(
            F.col("payload").isNotNull(), _compare(F.col("payload_digest"), F.col("payload"), "payload"))),
    })


def sha1_digest(content: Column) -> Column:
    return v.labelled("sha1", v.computed(F.lit("sha1"), content))


def sha256_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def add_sha1_digests(records: DataFrame) -> DataFrame:
    """records with sha1 block digests, and payload digests of requests and responses, where there were none."""
    out = with_payload(records)
    add = lambda old, content, when: F.when(F.col(old).isNull() & when, v.let(sha1_digest(content), v.digest)).otherwise(F.col(old))
    return out.withColumns({
        "block_digest": add("block_digest", F.col("body"), F.lit(True)),
        "payload_digest": add("payload_digest", F.col("payload"), F.col("record_type").isin("request", "response") & F.col("payload").isNotNull()),
    })
