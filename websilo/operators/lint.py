"""Lint: rules on single records and on the order of records in a file, by window functions.

The state of a file reaches back two records and on to the next, besides the
nearest warcinfo record before, so lag, lead and a running last express it.
Windows run over files: a file is one group, as its records have an order, and
only the few narrow columns below are shuffled and sorted, not blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as body_fields
from ..functions import values as v
from ..functions.http import holds_http
from ..schema import FIELDS_MEDIA_TYPE, REQUEST_MEDIA_TYPE, RESPONSE_MEDIA_TYPE
from .canonicalize import rank

_MEDIA = {"warcinfo": ("warc-fields", None, FIELDS_MEDIA_TYPE), "metadata": ("warc-fields", None, FIELDS_MEDIA_TYPE),
          "request": ("http", "request", REQUEST_MEDIA_TYPE), "response": ("http", "response", RESPONSE_MEDIA_TYPE),
          "revisit": ("http", "response", RESPONSE_MEDIA_TYPE)}


def _show_media(m):
    return F.concat(m["type"], F.lit("/"), m["subtype"], F.array_join(F.transform(
        m["parameters"], lambda p: F.concat(F.lit("; "), p["name"], F.lit("="), p["value"])), ""))


def narrow(records: DataFrame) -> DataFrame:
    """What the rules look at in each record: a few narrow columns."""
    names = F.transform("headers", lambda h: h["name"])
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), lambda i: F.struct(
        F.try_element_at(names, i).alias("a"), F.try_element_at(names, i + 1).alias("b")))
    disorder = F.try_element_at(F.filter(pairs, lambda p: p["b"].isNotNull() & (rank(p["a"]) > rank(p["b"]))), F.lit(1))
    kind = F.when(F.col("error").isNull(), F.col("record_type")).otherwise("unreadable")
    payload = F.col("record_type").isin("resource", "conversion") | (
        F.col("record_type").isin("request", "response") & holds_http(F.col("record_type"), F.col("target_uri"), F.col("content_type")))
    media = F.col("content_type")
    wrong, wanted = F.lit(False), F.lit(None).cast("string")
    for t, (subtype, message, text) in _MEDIA.items():
        fits = v.is_media_type(media, "application", subtype)
        if message:
            fits = fits & F.coalesce(F.lower(v.parameter(media, "msgtype")) == message, F.lit(False))
        wrong, wanted = F.when(F.col("record_type") == t, ~fits).otherwise(wrong), F.when(F.col("record_type") == t, text).otherwise(wanted)
    sure = lambda c: F.coalesce(c, F.lit(False))
    return records.select(
        "file", "record_index", kind.alias("kind"), "record_id", "target_uri", "warcinfo_id", "concurrent_to",
        disorder["a"].alias("early"), disorder["b"].alias("late"), sure(payload).alias("has_payload"), F.col("payload_digest").isNull().alias("no_payload_digest"),
        F.col("block_digest").isNull().alias("no_block_digest"), media.isNull().alias("no_type"),
        (F.coalesce(F.col("content_length"), F.lit(0)) > 0).alias("some"), sure(media.isNotNull() & wrong).alias("wrong_type"), wanted.alias("wanted"),
        _show_media(media).alias("media"), sure(F.size(body_fields.get_all(F.col("body_fields"), "fetchTimeMs")) > 0).alias("timed"))


def in_context(rows: DataFrame) -> DataFrame:
    """``narrow`` rows with what the rules need of the records around them, by windows over files."""
    w = Window.partitionBy("file").orderBy("record_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({
        "lag1": F.lag("kind", 1).over(w), "lag2": F.lag("kind", 2).over(w), "lead1": F.lead("kind", 1).over(w),
        "id1": F.lag("record_id", 1).over(w), "uri1": F.lag("target_uri", 1).over(w), "uri2": F.lag("target_uri", 2).over(w),
        "info": F.last(F.when(F.col("kind") == "warcinfo", F.col("record_id")), ignorenulls=True).over(before),
    })


def lint(records: DataFrame) -> DataFrame:
    """(file, record_index, place, record_id, violation, message): a row for each finding of readable records.

    records: the semantic level with ``headers``, unreadable rows included, whose
    position counts and which end a capture without a finding.  ``place`` orders the
    findings of a record; a capture left waiting is found when the next record is.
    """
    return findings(in_context(narrow(records)))


def findings(s: DataFrame) -> DataFrame:
    """The findings of ``in_context`` rows."""
    k, answer = F.col("kind"), lambda c: F.coalesce(F.col(c).isin("response", "revisit"), F.lit(False))
    readable = k != "unreadable"
    pair = k.isin("response", "revisit") & F.coalesce(F.col("lag1") == "request", F.lit(False))
    closing = (k == "metadata") & answer("lag1") & F.coalesce(F.col("lag2") == "request", F.lit(False))
    origin = F.when(closing, F.col("uri2")).otherwise(F.col("uri1"))
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    code = lambda c: say("`", c, "`")
    next_one = F.when(F.col("lead1").isNull(), "the file ends").otherwise(say("type ", code(F.col("lead1")), " comes next"))
    listed = F.when(F.size("concurrent_to") > 0, F.array_join("concurrent_to", ", ")).otherwise("none")
    nearest = F.when(F.col("info").isNull(), "none stands before it").otherwise(say("the nearest one is ", F.col("info")))
    needs = readable & (k != "warcinfo")
    linked = pair | closing
    rules = [  # in the order that a record's findings come
        ("NonCanonicalHeaderOrder", readable & F.col("late").isNotNull(), say("header order: ", code(F.col("late")), " belongs ahead of ", code(F.col("early")))),
        ("FirstRecordNotWarcinfo", (F.col("record_index") == 0) & needs, say("the file opens with type ", code(k), " instead of `warcinfo`")),
        ("MissingWarcinfoId", needs & F.col("warcinfo_id").isNull(), F.lit("no warcinfo id is given")),
        ("WrongWarcinfoId", needs & F.col("warcinfo_id").isNotNull() & ~F.col("warcinfo_id").eqNullSafe(F.col("info")),
         say("warcinfo id ", F.col("warcinfo_id"), " isn't that of the warcinfo record in force: ", nearest)),
        ("MissingPayloadDigest", readable & F.col("has_payload") & F.col("no_payload_digest"), F.lit("a payload without a payload digest")),
        ("MissingBlockDigest", readable & F.col("no_block_digest"), F.lit("a block without a block digest")),
        ("MissingContentType", readable & F.col("no_type") & F.col("some") & (k != "continuation"), F.lit("a block of undeclared media type")),
        ("WrongContentType", readable & F.col("wrong_type"), say("media type ", code(F.col("media")), " where ", code(F.col("wanted")), " is expected")),
        ("ResponseWithoutRequest", k.isin("response", "revisit") & ~pair, F.lit("no request stands just before this answer")),
        ("WrongConcurrentTo", linked & ~F.coalesce(F.col("concurrent_to") == F.array("id1"), F.lit(False)),
         say("concurrent records: expected ", F.col("id1"), " only, found ", listed)),
        ("WrongTargetUri", linked & ~F.col("target_uri").eqNullSafe(origin), say("target URI: expected ", origin, ", found ", F.coalesce(F.col("target_uri"), F.lit("none")))),
        ("MissingFetchTime", closing & ~F.col("timed"), F.lit("a capture's metadata without its fetch time")),
        ("RequestWithoutResponse", (k == "request") & ~(answer("lead1") | F.coalesce(F.col("lead1") == "unreadable", F.lit(False))),
         say("no answer comes after this request: ", next_one)),
        ("ResponseWithoutMetadata", pair & ~F.coalesce(F.col("lead1").isin("metadata", "unreadable"), F.lit(False)),
         say("no metadata comes after this answer: ", next_one)),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("place"), F.lit(n).alias("violation"), m.alias("message")))
                      for i, (n, c, m) in enumerate(rules)])
    out = s.select("file", "record_index", "record_id", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return out.select("file", "record_index", F.col("f")["place"].alias("place"), "record_id", F.col("f")["violation"].alias("violation"), F.col("f")["message"].alias("message"))


def report_lines(findings: DataFrame) -> DataFrame:
    """(file, record_index, place, line) as a tool prints them."""
    line = F.concat(F.lit("record "), F.col("record_index").cast("string"), F.lit(" ("), F.col("record_id"), F.lit("): "), F.col("message"))
    return findings.select("file", "record_index", "place", line.alias("line"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
