"""Records to raw records: canonical headers with digests, and constructors of each record type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as body_fields
from ..functions import values as v
from ..schema import BRACKETED_1_1, CORE, FIELDS_MEDIA_TYPE, FORM, NAMES, ONLY_1_1, REQUEST_MEDIA_TYPE, RESPONSE_MEDIA_TYPE, RULES
from .digests import sha1_digest, sha256_digest, with_payload

#: Column of each standard field in a table of records to render (text values).
COLUMNS = {n: n.lower().replace("-", "_").removeprefix("warc_") for n in NAMES}
COLUMNS["WARC-Type"] = "record_type"
COLUMNS["Content-Length"] = "content_length"


def render(records: DataFrame, sha1: bool = False) -> DataFrame:
    """(version, headers, body, error) besides the other columns: text columns of ``COLUMNS`` written as header fields.

    Missing columns and nulls are left out; concurrent_to may be an array.  The
    length is measured, and a block digest added where there is none (payload
    digests too, on HTTP messages).  URIs get brackets as the version asks.
    ``error`` says why a row can't be written: a field that its type or version
    doesn't have, or a declared block digest that isn't the block's.
    """
    have = set(records.columns)
    out = records.withColumn("version", F.coalesce("version", F.lit("1.1")) if "version" in have else F.lit("1.1"))
    out = out.withColumn("body", F.coalesce("body", F.lit(b"")))
    text = {n: F.col(c).cast("string") for n, c in COLUMNS.items() if c in have and n not in ("WARC-Concurrent-To", "Content-Length")}
    digest = sha1_digest if sha1 else sha256_digest
    text["WARC-Block-Digest"] = F.coalesce(text.get("WARC-Block-Digest", F.lit(None).cast("string")), digest(F.col("body")))
    if "content_type" in have and "target_uri" in have:
        seen = with_payload(out.withColumns({
            "_ct": F.col("content_type"), "content_type": v.media_type(F.col("content_type"))})).withColumn("content_type", F.col("_ct")).drop("_ct")
        out = seen
        text["WARC-Payload-Digest"] = F.coalesce(
            text.get("WARC-Payload-Digest", F.lit(None).cast("string")), F.when(F.col("payload").isNotNull(), digest(F.col("payload"))))
    line = lambda n, value: F.struct(F.lit(n).alias("name"), F.concat(F.lit(" "), value).cast("binary").alias("value"))
    one_1 = F.col("version") == "1.1"

    def shown(n: str, value: Column) -> Column:
        if FORM[n.lower()] != "uri":
            return value
        boxed = F.concat(F.lit("<"), value, F.lit(">"))
        return boxed if n in BRACKETED_1_1 else F.when(one_1, value).otherwise(boxed)

    parts, errors = [], []
    for n in NAMES:
        if n == "WARC-Concurrent-To" and "concurrent_to" in have:
            c = F.col("concurrent_to")
            many = c if records.schema["concurrent_to"].dataType.typeName() == "array" else F.array(c)
            parts.append(F.transform(F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: line("WARC-Concurrent-To", shown("WARC-Concurrent-To", x))))
        elif n == "Content-Length":
            parts.append(F.array(line(n, F.length("body").cast("string"))))
        elif n in text:
            parts.append(F.when(text[n].isNotNull(), F.array(line(n, shown(n, text[n])))).otherwise(F.array().cast("array<struct<name: string, value: binary>>")))
    headers = F.concat(*parts)
    kind = F.col("record_type")
    for n, value in text.items():
        types = [t for t, (a, b) in RULES.items() if n in (*CORE, *a, *b)]
        if n in ("WARC-Block-Digest", "WARC-Payload-Digest") and COLUMNS[n] not in have:
            continue
        errors.append(F.when(value.isNotNull() & kind.isin(*RULES) & ~kind.isin(*types), F.lit(f"The `{n}` has no place on the record.")))
        if n in ONLY_1_1:
            errors.append(F.when(value.isNotNull() & ~one_1, F.lit(f"The `{n}` is unknown to WARC 1.0.")))
    if "block_digest" in have:
        declared = v.digest(F.col("block_digest"))
        errors.append(F.when(v.decoded(declared) != v.computed(declared["algorithm"], F.col("body")), F.lit("The declared block digest is not the block's.")))
    drop = [c for c in ("payload", "payload_error") if c in out.columns and c not in have]
    return out.withColumns({"headers": headers, "error": F.coalesce(*errors, F.lit(None).cast("string")) if errors else F.lit(None).cast("string"),
                            "content_length": F.length("body").cast("decimal(20,0)")}).drop(*drop)


#: Media types that constructors give blocks of a type.
_MEDIA = {"warcinfo": FIELDS_MEDIA_TYPE, "metadata": FIELDS_MEDIA_TYPE, "request": REQUEST_MEDIA_TYPE, "response": RESPONSE_MEDIA_TYPE, "revisit": RESPONSE_MEDIA_TYPE}


def build(df: DataFrame, record_type: str, version: str = "1.1", keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Records of a type from columns named as in ``COLUMNS``, and ``body`` or ``body_fields``.

    Columns that the type doesn't have are refused, and required ones asked for.
    record_id defaults to a random UUID: give one where reruns must agree.
    """
    required, optional = RULES.get(record_type, ((), tuple(NAMES)))
    permitted = {COLUMNS[n] for n in (*CORE, *required, *optional)} | {"body", "body_fields"}
    if version == "1.0":
        permitted -= {COLUMNS[n] for n in ONLY_1_1}
    if alien := sorted(set(columns) - permitted):
        raise ValueError(f"not permitted on a {record_type} record: {', '.join(alien)}")
    needed = {COLUMNS[n] for n in required} | {"date"}
    if missing := sorted(needed - set(columns)):
        raise ValueError(f"required on a {record_type} record: {', '.join(missing)}")
    if "body_fields" in columns:
        given = columns.pop("body_fields")
        if record_type == "warcinfo":
            start = {"format": f"WARC File Format {version}", "conformsTo": f"http://iipc.github.io/warc-specifications/specifications/warc-format/warc-{version}/"}
            given = F.concat(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("value")) for n, t in start.items()]), given)
        columns["body"] = body_fields.render(given)
    columns.setdefault("record_id", F.concat(F.lit("urn:uuid:"), F.uuid()))
    columns.setdefault("body", F.lit(b""))
    if record_type in _MEDIA and (record_type != "revisit" or "body" in columns):
        media = F.lit(_MEDIA[record_type])
        columns.setdefault("content_type", F.when(F.length(columns["body"]) > 0, media) if record_type == "revisit" else media)
    return df.select(*(keep or []), F.lit(version).alias("version"), F.lit(record_type).alias("record_type"), *[c.alias(n) for n, c in columns.items()])


_EVENT = ("version", "record_type", "record_id", "date", "target_uri", "concurrent_to", "content_type", "warcinfo_id", "ip_address",
          "profile", "refers_to", "refers_to_target_uri", "refers_to_date", "truncated", "payload_digest", "body")


def exchange(df: DataFrame, *, request: Column, response: Column, target_uri: Column, date: Column, ids: tuple[Column, Column, Column],
             warcinfo_id: Column | None = None, ip_address: Column | None = None, fetch_time_ms: Column | None = None,
             revisit: dict[str, Column] | None = None, payload_digest: Column | None = None, truncated: Column | None = None,
             keep: list[str] | None = None) -> DataFrame:
    """Two or three rows for each capture: its request, then response, then metadata if a fetch time is given.

    Each names the one before in concurrent_to.  Address, payload digest and reason of
    truncation go to the response alone.  ``revisit``: profile, refers_to,
    refers_to_target_uri, refers_to_date and payload_digest of the original; then the
    second record is a revisit, and a head it keeps is declared truncated.
    """
    null = F.lit(None).cast("string")
    base = {n: null for n in _EVENT} | {"version": F.lit("1.1"), "date": date, "target_uri": target_uri,
                                        "warcinfo_id": null if warcinfo_id is None else warcinfo_id}
    request_id, response_id, metadata_id = ids
    rows = [base | {"record_type": F.lit("request"), "record_id": request_id, "content_type": F.lit(REQUEST_MEDIA_TYPE), "body": request}]
    second = base | {"record_type": F.lit("response"), "record_id": response_id, "concurrent_to": request_id,
                     "content_type": F.lit(RESPONSE_MEDIA_TYPE), "body": response, "ip_address": null if ip_address is None else ip_address,
                     "payload_digest": null if payload_digest is None else payload_digest, "truncated": null if truncated is None else truncated}
    if revisit:
        some = F.length(response) > 0
        second |= {"record_type": F.lit("revisit"), "content_type": F.when(some, F.lit(RESPONSE_MEDIA_TYPE)),
                   "truncated": F.when(some & (v.revisit_profile(revisit["profile"]) == "identical-payload-digest"), F.lit("length")), **revisit}
    rows.append(second)
    if fetch_time_ms is not None:
        body = body_fields.render(F.array(F.struct(F.lit("fetchTimeMs").alias("name"), fetch_time_ms.cast("string").alias("value"))))
        rows.append(base | {"record_type": F.lit("metadata"), "record_id": metadata_id, "concurrent_to": response_id,
                            "content_type": F.lit(FIELDS_MEDIA_TYPE), "body": body})
    structs = [F.struct(*[(r[n].cast("binary") if n == "body" else r[n]).alias(n) for n in _EVENT]) for r in rows]
    return df.select(*(keep or []), F.posexplode(F.array(*structs)).alias("seq", "r")).select(*(keep or []), "seq", *[F.col("r")[n].alias(n) for n in _EVENT])


def revisit_original(records: DataFrame, profile: Column | str) -> DataFrame:
    """(profile, refers_to, refers_to_target_uri, refers_to_date, payload_digest) of readable responses and revisits, as exchange's ``revisit`` takes them."""
    profile = F.lit(profile) if isinstance(profile, str) else profile
    digest = F.concat(F.col("payload_digest")["label"], F.lit(":"), F.col("payload_digest")["value"])
    return records.where(F.col("error").isNull() & F.col("record_type").isin("response", "revisit")).select(
        profile.alias("profile"), F.col("record_id").alias("refers_to"), F.col("target_uri").alias("refers_to_target_uri"),
        F.col("date")["text"].alias("refers_to_date"), digest.alias("payload_digest"))
