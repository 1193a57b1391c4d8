"""Fields, record types and table schemas of web archives."""

from __future__ import annotations

from pyspark.sql import types as T

#: The standard fields in canonical order, with the form of their values.
FIELDS = (
    ("WARC-Type", "token"),
    ("WARC-Target-URI", "uri"),
    ("WARC-Date", "date"),
    ("WARC-Record-ID", "uri"),
    ("WARC-Warcinfo-ID", "uri"),
    ("WARC-Filename", "text"),
    ("WARC-Concurrent-To", "uri"),
    ("WARC-IP-Address", "ip"),
    ("WARC-Profile", "uri"),
    ("WARC-Refers-To", "uri"),
    ("WARC-Refers-To-Target-URI", "uri"),
    ("WARC-Refers-To-Date", "date"),
    ("WARC-Segment-Origin-ID", "uri"),
    ("WARC-Segment-Number", "digits"),
    ("WARC-Segment-Total-Length", "digits"),
    ("WARC-Truncated", "token"),
    ("WARC-Identified-Payload-Type", "media_type"),
    ("WARC-Payload-Digest", "digest"),
    ("WARC-Block-Digest", "digest"),
    ("Content-Type", "media_type"),
    ("Content-Length", "digits"),
)
NAMES = tuple(n for n, _ in FIELDS)
FORM = {n.lower(): f for n, f in FIELDS}
RANK = {n.lower(): i for i, n in enumerate(NAMES)}
REPEATABLE = "WARC-Concurrent-To"
ONLY_1_1 = ("WARC-Refers-To-Target-URI", "WARC-Refers-To-Date")
#: WARC 1.1 writes these in angle brackets, 1.0 every URI.
BRACKETED_1_1 = ("WARC-Record-ID", "WARC-Warcinfo-ID", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Segment-Origin-ID")

CORE = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Block-Digest", "Content-Type", "WARC-Truncated")
_PAYLOAD = ("WARC-Payload-Digest", "WARC-Identified-Payload-Type")
_CAPTURE = ("WARC-Warcinfo-ID", *_PAYLOAD, "WARC-IP-Address", "WARC-Concurrent-To", "WARC-Segment-Number")
#: record type -> (required fields in the order they are looked for, optional fields), besides the core.
RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "warcinfo": ((), ("WARC-Filename", "WARC-Segment-Number")),
    "response": (("WARC-Target-URI",), _CAPTURE),
    "resource": (("WARC-Target-URI",), _CAPTURE),
    "request": (("WARC-Target-URI",), _CAPTURE),
    "metadata": ((), ("WARC-Target-URI", "WARC-Refers-To", *_CAPTURE)),
    "revisit": (("WARC-Target-URI", "WARC-Profile"), ("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", *_CAPTURE)),
    "conversion": (("WARC-Target-URI",), ("WARC-Warcinfo-ID", *_PAYLOAD, "WARC-Refers-To", "WARC-Segment-Number")),
    "continuation": (("WARC-Target-URI", "WARC-Segment-Number", "WARC-Segment-Origin-ID"),
                     ("WARC-Segment-Total-Length", "WARC-Warcinfo-ID", *_PAYLOAD)),
}
TYPES = tuple(RULES)
FIELDS_TYPES = ("warcinfo", "metadata")  # types whose block may be a list of named fields

IDENTICAL = (
    "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
    "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
)
NOT_MODIFIED = (
    "http://netpreserve.org/warc/1.0/revisit/server-not-modified",
    "http://netpreserve.org/warc/1.1/revisit/server-not-modified",
)
FIELDS_MEDIA_TYPE = "application/warc-fields"
REQUEST_MEDIA_TYPE = "application/http; msgtype=request"
RESPONSE_MEDIA_TYPE = "application/http; msgtype=response"
TRUNCATIONS = ("length", "time", "disconnect", "unspecified")

HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.BinaryType())])
ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("level", "code", "field", "message")])
RAW = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("record_index", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("version", T.StringType()),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("content_length", T.DecimalType(20, 0)),
    T.StructField("body", T.BinaryType()),
    T.StructField("error", ERROR),
])
NO_BODY = T.StructType([f for f in RAW if f.name != "body"])
