"""Checked fields to records: which fields a type may have, and what a block must be."""

from __future__ import annotations

from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as body_fields
from ..functions import values as v
from ..schema import CORE, FIELDS_TYPES, NAMES, ONLY_1_1, REPEATABLE, RULES, TYPES
from .grammar import all_fields, error, no_error
from .grammar import field as first_field


@dataclass(frozen=True)
class Extension:
    """Further record types, reasons of truncation, and fields that become columns (ext_<name>)."""

    record_types: tuple[str, ...] = ()
    truncations: tuple[str, ...] = ()
    fields: dict[str, tuple[str, ...]] = dataclass_field(default_factory=dict)

    def claim(self, unrecognized: Column, record_type: Column) -> Column:
        """struct(claimed, left): the unrecognized fields that this vocabulary has for a type, and the others."""
        names = F.coalesce(F.lit(None).cast("array<string>"), *[
            F.when(record_type == kind, F.array(*[F.lit(n.lower()) for n in own]).cast("array<string>")) for kind, own in self.fields.items()], F.array().cast("array<string>"))
        ours = lambda f: F.array_contains(names, F.lower(f["name"]))
        return F.struct(F.filter(unrecognized, ours).alias("claimed"), F.filter(unrecognized, lambda f: ~ours(f)).alias("left"))


def field(name: str) -> Column:
    """The first value of a standard field, from the struct that to_semantic_header makes once."""
    return F.col("_first")[name]


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def header_error(extension: Extension = Extension()) -> Column:
    """The first rule that a header breaks, as an error struct, or null."""
    names, version, kind = F.col("_names"), F.col("version"), F.col("_kind")
    repeats = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("n"), (F.array_position(names, n) < i + 1).alias("again"))),
                       lambda x: x["n"].isNotNull() & (x["n"] != REPEATABLE) & x["again"])
    repeated = F.try_element_at(repeats, F.lit(1))["n"]
    late = F.try_element_at(F.filter(names, lambda n: n.isin(*ONLY_1_1)), F.lit(1))
    missing = lambda n: error("semantic", "MissingField", n, _say("Required: `", n, "` is absent."))
    malformed = lambda n, value: error("semantic", "MalformedField", n, _say("The value of `", n, "` must not be `", value, "`."))
    checks = [
        F.when(repeated.isNotNull(), error("semantic", "RepeatedField", repeated, _say("The `", repeated, "` occurs more than once."))),
        F.when((version == "1.0") & late.isNotNull(), error("semantic", "FieldNotInVersion", late, _say("The `", late, "` is unknown to WARC 1.0."))),
        F.when(field("WARC-Type").isNull(), missing("WARC-Type")),
        F.when(field("WARC-Record-ID").isNull(), missing("WARC-Record-ID")),
        F.when(field("WARC-Date").isNull(), missing("WARC-Date")),
        F.when((version == "1.0") & (F.length(field("WARC-Date")) != 20), malformed("WARC-Date", field("WARC-Date"))),
        F.when(~kind.isin(*TYPES, *extension.record_types), error("semantic", "UnknownRecordType", "WARC-Type", _say(
            "The `", kind, "` record type is unknown."))),
    ]
    number = field("WARC-Segment-Number")
    needed = list(dict.fromkeys(n for required, _ in RULES.values() for n in required))
    for n in needed:  # in the order that each type looks for its own
        checks.append(F.when(kind.isin(*[t for t, (required, _) in RULES.items() if n in required]) & field(n).isNull(), missing(n)))
    checks.append(F.when((kind == "revisit") & (v.revisit_profile(v.bare_uri(field("WARC-Profile"))) == "identical-payload-digest")
                         & field("WARC-Payload-Digest").isNull(), missing("WARC-Payload-Digest")))
    count = v.digits(number)
    wrong = F.when(kind == "continuation", count < 2).otherwise(count != 1)
    checks.append(F.when(kind.isin(*TYPES) & number.isNotNull() & wrong, malformed("WARC-Segment-Number", count.cast("string"))))
    permitted = F.try_element_at(F.create_map(*[x for name, (required, optional) in RULES.items() for x in (
        F.lit(name), F.array(*[F.lit(n) for n in (*CORE, *required, *optional)]))]), kind)
    alien = F.try_element_at(F.filter(names, lambda n: n.isNotNull() & ~F.array_contains(permitted, n)), F.lit(1))
    checks.append(F.when(alien.isNotNull(), error("semantic", "ForbiddenField", alien, _say(
        "The `", alien, "` has no place on a `", kind, "` record."))))
    odd = F.try_element_at(F.filter("fields", lambda f: f["field"].isNull() & ~f["utf8"]), F.lit(1))["name"]
    checks.append(F.when(odd.isNotNull(), error("semantic", "NonUtf8Field", odd, _say("The value of `", odd, "` isn't UTF-8."))))
    return F.coalesce(*checks)


def to_semantic_header(untyped: DataFrame, extension: Extension = Extension()) -> DataFrame:
    """untyped with a column for each field that records have; ``error`` is the first broken rule, and then they are null."""
    out = untyped.withColumn("_first", F.struct(*[first_field(n).alias(n) for n in NAMES]))
    out = out.withColumns({"_kind": F.lower(field("WARC-Type")), "_names": F.transform("fields", lambda f: f["field"])})
    out = out.withColumn("error", F.coalesce("error", header_error(extension)))
    ok = F.col("error").isNull()
    uri = lambda n: v.bare_uri(field(n))
    columns = {
        "record_type": F.col("_kind"),
        "record_id": uri("WARC-Record-ID"),
        "date": v.date(field("WARC-Date"), F.col("version")),
        "block_digest": v.digest(field("WARC-Block-Digest")),
        "content_type": v.media_type(field("Content-Type")),
        "truncated": v.truncation(field("WARC-Truncated")),
        "payload_digest": v.digest(field("WARC-Payload-Digest")),
        "identified_payload_type": v.media_type(field("WARC-Identified-Payload-Type")),
        "target_uri": uri("WARC-Target-URI"),
        "warcinfo_id": uri("WARC-Warcinfo-ID"),
        "ip_address": field("WARC-IP-Address"),
        "concurrent_to": F.transform(all_fields("WARC-Concurrent-To"), v.bare_uri),
        "refers_to": uri("WARC-Refers-To"),
        "refers_to_target_uri": uri("WARC-Refers-To-Target-URI"),
        "refers_to_date": v.date(field("WARC-Refers-To-Date"), F.col("version")),
        "profile": uri("WARC-Profile"),
        "filename": _filename(),
        "segment_number": v.digits(field("WARC-Segment-Number")),
        "segment_origin_id": uri("WARC-Segment-Origin-ID"),
        "segment_total_length": v.digits(field("WARC-Segment-Total-Length")),
        "unrecognized": F.transform(F.filter("fields", lambda f: f["field"].isNull()), lambda f: F.struct(f["name"].alias("name"), f["text"].alias("value"))),
    }
    out = out.withColumns({n: F.when(ok, c) for n, c in columns.items()})
    for kind, names in extension.fields.items():
        for n in names:
            out = out.withColumn(f"ext_{n.lower().replace('-', '_')}", F.when(F.col("record_type") == kind, body_fields.get(F.col("unrecognized"), n)))
    return out.drop("_first", "_kind", "_names")


def _filename() -> Column:
    """struct(content, quoted, utf8): content has a character a byte where the value isn't UTF-8."""
    text = v.text_value(field("WARC-Filename"))
    read = F.try_element_at(F.filter("fields", lambda f: f["field"] == "WARC-Filename"), F.lit(1))["utf8"]
    return F.when(text.isNotNull(), F.struct(text["content"].alias("content"), text["quoted"].alias("quoted"), read.alias("utf8")))


def declares_fields() -> Column:
    return F.col("record_type").isin(*FIELDS_TYPES) & v.is_media_type(F.col("content_type"), "application", "warc-fields")


def with_body(header: DataFrame) -> DataFrame:
    """header with the block's rules checked and ``body_fields`` of warc-fields blocks."""
    size = F.length("body")
    block = lambda code, message: error("block", code, None, message)
    length = F.when(F.col("content_length") != size, block("ContentLengthMismatch", _say(
        "Declared bytes: ", F.col("content_length").cast("string"), ", bytes of the block: ", size.cast("string"), ".")))
    revisit = F.when(
        (F.col("record_type") == "revisit") & (size > 0) & (v.revisit_profile(F.col("profile")) == "identical-payload-digest")
        & ~F.coalesce(F.col("truncated") == "length", F.lit(False)),
        block("UndeclaredRevisitTruncation", _say("The revisit's block of ",
                                                  size.cast("string"), " bytes isn't marked as cut to a length.")))
    out = header.withColumn("error", F.coalesce("error", length, revisit, no_error()))
    wanted = F.col("error").isNull() & declares_fields()
    # filters on what the parser finds stay above the generator: they'd take the Python function with them otherwise
    out = out.select("*", F.inline(F.array(F.struct(F.when(wanted, body_fields.parse(F.when(wanted, F.col("body")))).alias("_parsed")))))
    said = block("Fields", _say("The block isn't of its declared type: ", F.col("_parsed")["error"]))
    return (
        out.withColumn("error", F.coalesce("error", F.when(F.col("_parsed")["error"].isNotNull(), said)))
        .withColumn("body_fields", F.col("_parsed")["fields"]).drop("_parsed")
    )


def to_semantic(untyped: DataFrame, extension: Extension = Extension()) -> DataFrame:
    return with_body(to_semantic_header(untyped, extension))


def where_untyped(raw: DataFrame, condition: Column) -> DataFrame:
    """Grammar-checked records that meet a condition on their columns; unreadable ones always stay, with their errors."""
    from .grammar import to_untyped

    return to_untyped(raw).where(F.col("error").isNotNull() | F.coalesce(condition, F.lit(False)))


def where_records(untyped: DataFrame, condition: Column, extension: Extension = Extension()) -> DataFrame:
    """Records that meet a condition on their header's columns; those whose header has a fault always stay.

    Blocks are only read, and their faults found, where the header is kept.
    """
    kept = to_semantic_header(untyped, extension).where(F.col("error").isNotNull() | F.coalesce(condition, F.lit(False)))
    return with_body(kept)


def filter_records(spark, path: str, wanted: list, extension: Extension = Extension(), **options) -> DataFrame:
    """Records of files that meet every ``Wanted`` test; those whose header has a fault stay, without their blocks where a test refused them.

    Blocks that the tests refuse are neither read nor checked, so a block's own fault is found in kept records alone.
    """
    from ..sources.warc import read_warc
    from .grammar import kept, to_untyped

    raw = read_warc(spark, path, wanted=wanted, refused="header", **options).withColumn("_wanted", kept(wanted) & F.col("error").isNull())
    header = to_semantic_header(to_untyped(raw), extension)
    return with_body(header.where(F.col("error").isNotNull() | F.col("_wanted")).drop("_wanted"))


def segment_bodies(records: DataFrame) -> DataFrame:
    """(record_id, segments, body): origin records with their continuations' blocks joined in order of number.

    Series are sorted by Spark and joined a piece at a time; a task holds one whole block,
    and no more of the others than a batch.
    """
    import pyarrow as pa

    key = F.when(F.col("record_type") == "continuation", F.col("segment_origin_id")).otherwise(F.col("record_id"))
    parts = records.where(F.col("error").isNull() & F.col("segment_number").isNotNull()).select(
        key.alias("series"), F.col("segment_number").cast("decimal(20,0)").alias("n"), "body")

    def run(batches):
        rows: list[tuple] = []
        name, n, pieces = None, 0, None

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["record_id", "segments", "body"])

        for batch in batches:
            for i in range(batch.num_rows):
                series = batch.column(0)[i].as_py()
                if pieces is None or series != name:
                    if pieces is not None:
                        rows.append((name, n, b"".join(pieces)))
                        if len(rows) >= 1024 or sum(len(r[2]) for r in rows[-8:]) > 4 << 20:
                            yield made()
                            rows.clear()
                    name, n, pieces = series, 0, []
                n += 1
                pieces.append(batch.column(2)[i].as_py() or b"")
        if pieces is not None:
            rows.append((name, n, b"".join(pieces)))
            yield made()

    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "series").sortWithinPartitions("series", "n", "body").mapInArrow(run, "record_id string, segments long, body binary")
