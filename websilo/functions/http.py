"""HTTP messages in blocks: head fields, entity bodies and rebuilt responses."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sniff import SEEN, sniffed
from .values import latin


def head(body: Column) -> Column:
    """The start line and fields, with folds joined, as ISO-8859-1 text; empty without the closing empty line."""
    # most heads end early: the whole block is only looked at where the first 8 KB have no end
    first = latin(F.substring(body, 1, 8192))
    text = F.when(F.instr(first, "\r\n\r\n") > 0, first).otherwise(latin(body))
    return F.regexp_replace(F.when(text.contains("\r\n\r\n"), F.substring_index(text, "\r\n\r\n", 1)).otherwise(F.when(text.isNotNull(), "")), "\r\n[ \t]+", " ")


def status(body: Column) -> Column:
    """The three-digit status of a response; null if the head isn't one."""
    return F.regexp_extract(head(body), r"\AHTTP/[0-9]\.[0-9] ([0-9]{3})(?: |\r\n|\z)", 1).try_cast("int")


def header(body: Column, name: str) -> Column:
    """The first field of a name; null if there is none."""
    h = head(body)
    literal = re.sub(r"([^0-9A-Za-z])", r"\\\1", name)  # names may hold characters that patterns use
    pattern = rf"(?i)\r\n{literal}[ \t]*:[ \t]*([^\r\n]*)"
    return F.when(h.rlike(pattern), F.rtrim(F.regexp_extract(h, pattern, 1), F.lit(" \t")))


def holds_http(record_type: Column, target_uri: Column, media: Column) -> Column:
    """Whether a request or response declares an HTTP message as its block."""
    is_http = media.isNull() | ((F.lower(media["type"]) == "application") & (F.lower(media["subtype"]) == "http"))
    return F.lower(target_uri).rlike("^https?:") & is_http


class PayloadError(Exception):
    pass


def split_message(message: bytes) -> tuple[bytes, str]:
    """(body, Transfer-Encoding fields joined); lines may end in LF alone."""
    at = message.find(b"\n") + 1
    coding: list[bytes] = []
    folding = False
    while at:
        end = message.find(b"\n", at)
        if end < 0:
            break
        line = message[at:end].removesuffix(b"\r")
        at = end + 1
        if not line:
            return message[at:], b",".join(coding).decode("latin-1")
        if line[:1] in b" \t":
            if folding:
                coding[-1] += b" " + line
            continue
        name, colon, value = line.partition(b":")
        folding = bool(colon) and name.rstrip(b" \t").lower() == b"transfer-encoding"
        if folding:
            coding.append(value)
    raise PayloadError("No empty line ends the head of the HTTP message.")


def entity_bytes(message: bytes) -> bytes:
    """The body of an HTTP message without chunking."""
    body, codings = split_message(message)
    names = [c.strip(" \t\r\n") for c in codings.split(",")]
    names = [c for c in names if c and c.lower() != "identity"]
    if not names:
        return body
    if [c.lower() for c in names] != ["chunked"]:
        raise PayloadError(f"The HTTP message has the transfer-coding `{codings.strip()}`: only chunked can be undone.")
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        if end < 0:
            raise PayloadError("No last chunk ends the chunked message.")
        line = body[at:end].removesuffix(b"\r")
        size = line.partition(b";")[0].strip(b" \t\r\n\x0c")
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise PayloadError(f"The chunked message has `{line.decode('utf-8', 'replace')}` where a chunk size belongs.")
        n, at = int(size, 16), end + 1
        if n == 0:
            return b"".join(out)
        if at + n > len(body) or body[at + n : at + n + 2] != b"\r\n" and body[at + n : at + n + 1] != b"\n":
            raise PayloadError("No last chunk ends the chunked message.")
        out.append(body[at : at + n])
        at += n + (2 if body[at + n : at + n + 1] == b"\r" else 1)


@F.arrow_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("error", T.StringType())]))
def _entity(blocks: pa.Array) -> pa.Array:
    out = []
    for b in blocks.to_pylist():
        try:
            out.append({"body": None if b is None else entity_bytes(b), "error": None})
        except PayloadError as e:
            out.append({"body": None, "error": str(e)})
    return pa.array(out, pa.struct([("body", pa.binary()), ("error", pa.string())]))


def with_entity_body(df: DataFrame, body: str = "body", into: str = "entity") -> DataFrame:
    """df with a struct(body, error): most messages are cut in the JVM; only those that declare a transfer-coding,
    or whose head ends otherwise than in two CRLF, go through Python."""
    b = F.col(body)
    at = F.instr(latin(b), "\r\n\r\n")
    plain = (at > 0) & ~latin(F.substring(b, F.lit(1), at + 3)).rlike(r"(?i)\n(?:transfer-encoding[ \t]*:|\r?\n(?!\z))")
    cut = F.struct(F.substring(b, at + 4, F.length(b)).alias("body"), F.lit(None).cast("string").alias("error"))
    return df.withColumn(into, F.when(plain, cut).otherwise(_entity(F.when(~plain, b))))


#: Reason phrases of common status codes.
REASONS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 206: "Partial Content", 301: "Moved Permanently",
    302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def response_block(status_code: Column, fields: Column, body: Column) -> Column:
    """An HTTP/1.1 response of a status, array<struct<name, value>> fields and a body: no transfer-coding, and one
    Content-Length that matches.  Null where the status forbids a body that isn't empty (1xx, 204, 304)."""
    reason = F.lit("")
    for code, phrase in REASONS.items():
        reason = F.when(status_code == code, phrase).otherwise(reason)
    size = F.length(body).cast("string")
    forbids = (status_code < 200) | status_code.isin(204, 304)
    lengths = F.filter(fields, lambda f: F.lower(f["name"]) == "content-length")
    match = (F.size(lengths) == 1) & (F.try_element_at(lengths, F.lit(1))["value"] == size)
    kept = F.filter(fields, lambda f: ~F.lower(f["name"]).isin("transfer-encoding", "content-length") | (match & (F.lower(f["name"]) == "content-length")))
    added = F.when(match | forbids, kept).otherwise(F.concat(kept, F.array(F.struct(F.lit("Content-Length").alias("name"), size.alias("value")))))
    lines = F.array_join(F.transform(added, lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit("\r\n"))), "")
    start = F.concat(F.lit("HTTP/1.1 "), status_code.cast("string"), F.lit(" "), reason, F.lit("\r\n"))
    return F.when(~(forbids & (F.length(body) > 0)), F.concat(F.concat(start, lines, F.lit("\r\n")).cast("binary"), body))


def request_block(method: Column, target: Column, fields: Column, body: Column) -> Column:
    """An HTTP/1.1 request; its Content-Length is set anew where a body is sent."""
    size = F.length(body)
    kept = F.filter(fields, lambda f: ~F.lower(f["name"]).isin("transfer-encoding", "content-length"))
    added = F.when(size > 0, F.concat(kept, F.array(F.struct(F.lit("Content-Length").alias("name"), size.cast("string").alias("value"))))).otherwise(kept)
    lines = F.array_join(F.transform(added, lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit("\r\n"))), "")
    return F.concat(F.concat(method, F.lit(" "), target, F.lit(" HTTP/1.1\r\n"), lines, F.lit("\r\n")).cast("binary"), body)


def payload_type(payload: Column, declared: Column, valid_json: Column) -> Column:
    """application/json if JSON is declared and valid; else by signature or container; text/plain for printable UTF-8; else null."""
    # only the first bytes of a payload go to Python
    kind = sniffed(F.substring(payload, 1, SEEN))
    out = F.when(F.lower(declared).rlike(r"^[^;]*[/+]json\s*(?:;|$)") & valid_json, "application/json").when(kind.isNotNull(), kind)
    printable = ~latin(payload).rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]") & F.is_valid_utf8(payload.cast("string"))
    low = F.lower(F.ltrim(latin(F.substring(payload, 1, 256))))
    some = (F.length(payload) > 0) & printable
    return out.when(some & low.rlike(r"^<(?:!doctype html|html)"), "text/html").when(some & low.rlike(r"^<\?xml"), "application/xml").when(some, "text/plain")


def declared_type(message: Column) -> Column:
    """The first Content-Type of an HTTP message, folds joined; null if it declares none."""
    return header(message, "Content-Type")


def with_message_type(df: DataFrame, body: str = "body", into: str = "payload_type") -> DataFrame:
    """df with the type of the payload of an HTTP message: of its entity body, whatever its chunking, and its own Content-Type."""
    out = with_entity_body(df, body, "_entity")
    payload = F.col("_entity")["body"]
    return out.withColumn(into, F.when(payload.isNotNull(), payload_type(payload, declared_type(F.col(body)), strict_json(payload)))).drop("_entity")


def body_framing(body: Column, is_request: Column, method: Column | None = None) -> Column:
    """struct(kind, length, error): how a message's body ends: none, length, chunked, or with the connection (close).

    ``method``: that of the request, for a response.  Transfer-Encoding outranks
    Content-Length; lengths that differ are an error.
    """
    h = head(body)
    fields = lambda n: F.transform(F.filter(F.split(h, "\r\n"), lambda line: F.lower(F.rtrim(F.substring_index(line, ":", 1))) == n),
                                   lambda line: F.trim(F.regexp_replace(line, r"\A[^:]*+:", "")))
    codings = F.filter(F.transform(F.split(F.array_join(fields("transfer-encoding"), ","), ","), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    lengths = F.array_distinct(F.filter(F.transform(F.split(F.array_join(fields("content-length"), ","), ","), lambda c: F.trim(c)), lambda c: c != ""))
    n = F.when(F.try_element_at(lengths, F.lit(1)).rlike(r"\A[0-9]{1,19}\z"), F.try_element_at(lengths, F.lit(1))).try_cast("long")
    code = status(body)
    bare = ~is_request & (F.coalesce(method == "HEAD", F.lit(False)) if method is not None else F.lit(False)) | ~is_request & ((code < 200) | code.isin(204, 304))
    made = lambda kind, length=None, error=None: F.struct(
        F.lit(kind).cast("string").alias("kind"), (F.lit(None).cast("long") if length is None else length).alias("length"), F.lit(error).cast("string").alias("error"))
    return (
        F.when(F.coalesce(bare, F.lit(False)), made("none"))
        .when(F.size(codings) > 0, F.when(F.element_at(codings, -1) == "chunked", made("chunked")).when(is_request, made(None, error="a request whose last transfer-coding is not chunked")).otherwise(made("close")))
        .when(F.size(lengths) > 1, made(None, error="lengths that differ"))
        .when((F.size(lengths) == 1) & n.isNull(), made(None, error="a length that is no number"))
        .when(F.size(lengths) == 1, made("length", n)).when(is_request, made("none")).otherwise(made("close"))
    )


@F.arrow_udf(T.BooleanType())
def strict_json(payload: pa.Array) -> pa.Array:
    """Whether a payload is one JSON text and nothing else (no NaN or Infinity)."""
    import json

    def refuse(name):
        raise ValueError(name)

    out = []
    for p in payload.to_pylist():
        try:
            out.append(None if p is None else (json.loads(p.decode("utf-8"), parse_constant=refuse), True)[1])
        except (ValueError, RecursionError):
            out.append(False)
    return pa.array(out, pa.bool_())
