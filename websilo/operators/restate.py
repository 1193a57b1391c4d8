"""Records back to raw records: the inverse of the lift.

Every typed column is written in the one spelling that its record's version has for it, the
fields that no column holds follow as they were read, and all stand in canonical order.  What
is read from the result equals what was given, besides the digests that were added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as body_fields
from ..functions import values as v
from ..schema import BRACKETED_1_1, CORE, FIELDS, FORM, ONLY_1_1, RAW, REPEATABLE, RULES
from .canonicalize import canonical
from .digests import check_digests, sha1_digest, sha256_digest
from .grammar import error, lookup, no_error, standard_name, value_error
from .render import COLUMNS
from .semantic import Extension

_LINE = "array<struct<name: string, value: binary>>"


def _columns(records: DataFrame) -> DataFrame:
    """records with every column that the lift makes; those that are missing are null."""
    kinds = {"record_type": "string", "version": "string", "unrecognized": "array<struct<name: string, value: string>>", "concurrent_to": "array<string>",
             "body_fields": "array<struct<name: string, value: string>>", "body": "binary", "content_length": "decimal(20,0)"}
    date = "struct<ts: timestamp, nanos: int, precision: string, digits: int, text: string>"
    media = "struct<type: string, subtype: string, parameters: array<struct<name: string, value: string, quoted: boolean, separator: string>>>"
    by_form = {"date": date, "digest": "struct<algorithm: string, label: string, value: string>", "media_type": media, "digits": "decimal(20,0)",
               "text": "struct<content: string, quoted: boolean, utf8: boolean>"}
    for name, form in FIELDS:
        kinds.setdefault(COLUMNS[name], by_form.get(form, "string"))
    missing = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in records.columns}
    return records.withColumns(missing | ({} if "error" in records.columns else {"error": no_error()}))


def _value(name: str, form: str) -> Column:
    """The value of a field, without brackets, as text in which a character is a code point."""
    c = F.col(COLUMNS[name])
    if form == "date":
        return v.show_date(c)
    if form == "digest":
        return F.concat(c["label"], F.lit(":"), c["value"])
    if form == "media_type":
        return v.show_media_type(c)
    if form == "text":
        return v.show_text(c)
    return c.cast("string")


def _boxed(name: str, value: Column) -> Column:
    box = F.concat(F.lit("<"), value, F.lit(">"))
    return box if name in BRACKETED_1_1 else F.when(F.col("version") == "1.0", box).otherwise(value)


def _line(name: Column | str, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.alias("value"))


def lookup_array(table: dict[str, tuple[str, ...]], key: Column, otherwise: tuple[str, ...]) -> Column:
    """The names of a constant table for a key."""
    names = lambda t: F.array(*[F.lit(n) for n in t])
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, t in table.items() for x in (F.lit(k), names(t))]), key), names(otherwise))


def _refused(code: str, name: Column | str, why: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return error("render", code, name, F.concat(lit(name), F.lit(": "), lit(why)))


def to_raw(records: DataFrame, sha1: bool = False, extension: Extension = Extension(), keep: list[str] | None = None) -> DataFrame:
    """Raw records (version, headers, content_length, body, error) of records as ``to_semantic`` makes them, edited or not.

    The block is ``body``, or the lines of ``body_fields`` where body is null (after an edit
    of these).  Content-Length is measured; where content_length isn't null, it must be the
    block's.  A block digest is added where there is none, and a payload digest on whole HTTP
    requests and responses; declared ones must be right.  Fields in ``unrecognized`` are
    written behind the others as they were read.  URIs get brackets and dates their layout as
    the version asks.

    A record that can't be written has an error of the level ``render``, or ``block``, and no
    headers: its type or version lacks a field or a date's precision, a required field is
    null, a value couldn't be read back, an unrecognized field has the name of a standard one
    (on record types of ``extension`` it may, once).  Records with an error keep it.  file,
    record_index and ``keep`` are carried where records have them.
    """
    given = _columns(records)
    had = F.col("error").isNotNull()
    block = F.coalesce("body", body_fields.render(F.col("body_fields")), F.lit(b""))
    checked = check_digests(given.withColumn("body", F.when(had, F.col("body")).otherwise(block)))
    add = sha1_digest if sha1 else sha256_digest
    whole = F.col("record_type").isin("request", "response") & F.col("segment_number").isNull() & F.col("truncated").isNull() & F.col("payload_error").isNull()
    added = {
        "WARC-Block-Digest": add(F.col("body")),
        "WARC-Payload-Digest": F.when(whole & F.col("payload").isNotNull(), add(F.col("payload"))),
    }
    kind, version, size = F.col("record_type"), F.col("version"), F.length("body")
    own = kind.isin(*[t.lower() for t in extension.record_types]) if extension.record_types else F.lit(False)
    standard = kind.isin(*RULES)
    # every typed value once, in canonical order, as the text that its form's grammar reads and as octets
    typed = []
    for name, form in FIELDS:
        if name == REPEATABLE:
            typed.append(F.transform(F.filter(F.coalesce(F.col(COLUMNS[name]), F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.struct(
                F.lit(REPEATABLE).alias("name"), x.alias("text"), _boxed(REPEATABLE, x).cast("binary").alias("octets"))))
        elif name == "Content-Length":
            typed.append(F.array(F.struct(F.lit(name).alias("name"), size.cast("string").alias("text"), size.cast("string").cast("binary").alias("octets"))))
        else:
            value = _value(name, form)
            spelt = _boxed(name, value) if form == "uri" else value
            octets = spelt.cast("binary")
            if form == "text":  # what wasn't UTF-8 was read a byte a character
                octets = F.when(F.col(COLUMNS[name])["utf8"] == F.lit(False), F.encode(spelt, "ISO-8859-1")).otherwise(octets)
            if name in added:
                value, octets = F.coalesce(value, added[name]), F.coalesce(octets, added[name].cast("binary"))
            typed.append(F.array(F.struct(F.lit(name).alias("name"), value.alias("text"), octets.alias("octets"))))
    checked = checked.withColumn("_typed", F.filter(F.concat(*typed), lambda t: t["text"].isNotNull()))
    present = F.transform("_typed", lambda t: t["name"])
    first_of = lambda names: F.try_element_at(names, F.lit(1))
    needed = lookup_array({t: ("WARC-Type", "WARC-Record-ID", "WARC-Date", *required) for t, (required, _) in RULES.items()}, kind, ("WARC-Type", "WARC-Record-ID", "WARC-Date"))
    permitted = lookup_array({t: (*CORE, *required, *optional) for t, (required, optional) in RULES.items()}, kind, tuple(COLUMNS))
    # an added payload digest stands on requests and responses alone, which may have it
    missing = first_of(F.filter(needed, lambda n: ~F.array_contains(present, n)))
    alien = first_of(F.filter(present, lambda n: ~F.array_contains(permitted, n)))
    late = first_of(F.filter(present, lambda n: n.isin(*ONLY_1_1)))
    wrong = first_of(F.filter(F.transform("_typed", lambda t: F.struct(t["name"].alias("name"), value_error(lookup(FORM, F.lower(t["name"])), t["text"]).alias("why"))),
                              lambda e: e["why"].isNotNull()))
    checks = [
        F.when(missing.isNotNull(), _refused("MissingField", missing, "records of this type need it")),
        F.when(alien.isNotNull(), _refused("ForbiddenField", alien, F.concat(F.lit("a record of type "), kind, F.lit(" has no such field")))),
        F.when((version == "1.0") & late.isNotNull(), _refused("FieldNotInVersion", late, "WARC 1.0 has no such field")),
        F.when((version == "1.0") & (F.col("date")["precision"] != "second"), _refused(
            "ValueNotInVersion", "WARC-Date", F.concat(F.lit("WARC 1.0 writes seconds, not "), F.col("date")["text"]))),
        F.when(wrong.isNotNull(), _refused("UnwritableField", wrong["name"], wrong["why"])),
    ]
    further = F.coalesce("unrecognized", F.array().cast("array<struct<name: string, value: string>>"))
    read = F.transform(further, lambda f: F.struct(f["name"].alias("name"), standard_name(F.lower(f["name"])).alias("field"), f["value"].alias("value")))
    spelt = lambda f: F.when(f["value"].rlike(r"\A[ \t]"), f["value"]).otherwise(F.concat(F.lit(" "), f["value"]))
    lines = F.concat(F.transform("_typed", lambda t: _line(t["name"], F.concat(F.lit(b" "), t["octets"]))), F.transform(further, lambda f: _line(f["name"], spelt(f).cast("binary"))))

    def unwritable(f: Column) -> Column:
        reason = (F.when(~v.is_token(f["name"]), F.lit("the name is no token")).when(f["value"].rlike(r"[\r\n]"), F.lit("the value has a line break"))
                  .when(f["value"].rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), F.lit("the value has a control character")))
        legal = f["field"].isNull() | own
        fits = ~((version == "1.0") & F.coalesce(f["field"].isin(*ONLY_1_1), F.lit(False)))
        grammar = F.when(f["field"].isNotNull(), value_error(lookup(FORM, F.lower(f["name"])), v.trim_space(f["value"], " \t")))
        return (F.when(reason.isNotNull(), _refused("UnwritableField", f["name"], reason))
                .when(~legal, _refused("ReservedField", f["field"], "an unrecognized field has the name of a standard one"))
                .when(~fits, _refused("FieldNotInVersion", f["field"], "WARC 1.0 has no such field"))
                .when(grammar.isNotNull(), _refused("UnwritableField", f["name"], grammar)))

    odd = F.try_element_at(F.filter(F.transform(read, unwritable), lambda e: e.isNotNull()), F.lit(1))
    names = F.concat(F.filter(present, lambda n: n != REPEATABLE), F.filter(F.transform(read, lambda f: f["field"]), lambda n: n.isNotNull() & (n != REPEATABLE)))
    repeated = F.try_element_at(F.filter(F.transform(names, lambda n, i: F.when(F.array_position(names, n) < i + 1, n)), lambda n: n.isNotNull()), F.lit(1))
    identical = v.revisit_profile(F.col("profile")) == "identical-payload-digest"
    cut_short = (kind == "revisit") & identical & (size > 0) & ~F.coalesce(F.col("truncated") == "length", F.lit(False))
    first = [
        F.when(~F.coalesce(version.isin("1.0", "1.1"), F.lit(False)), error("render", "UnknownVersion", None, F.lit("the version is neither 1.0 nor 1.1"))),
        F.when(~(standard | own), _refused("UnknownRecordType", "WARC-Type", F.concat(kind, F.lit(" is neither a standard type nor one of the extension")))),
        F.col("payload_digest_error"),
        F.when((kind == "revisit") & identical & F.col("payload_digest").isNull(), _refused("MissingProfileField", "WARC-Payload-Digest", "the profile of the revisit needs it")),
        F.when(cut_short, error("block", "UndeclaredRevisitTruncation", None, F.concat(F.lit("the revisit has a block of "), size.cast("string"), F.lit(" bytes and isn't marked as cut to a length")))),
    ]
    count = F.col("segment_number")
    first.append(F.when(standard & F.when(kind == "continuation", count < 2).otherwise(count != 1), _refused(
        "ValueNotPermitted", "WARC-Segment-Number", F.concat(count.cast("string"), F.lit(" isn't a number for this type")))))
    last = [
        F.when(F.col("content_length") != size, error("block", "ContentLengthMismatch", None, F.concat(
            F.col("content_length").cast("string"), F.lit(" bytes are declared, and the block has "), size.cast("string")))),
        F.col("block_digest_error"), odd,
        F.when(repeated.isNotNull(), _refused("RepeatedField", repeated, "it would stand there twice")),
    ]
    out = checked.withColumn("error", F.coalesce("error", *first, *checks, *last, no_error()))
    ok = F.col("error").isNull()
    carried = [c for c in ("file", "record_index", *(keep or [])) if c in records.columns]
    made = {"version": version, "headers": F.when(ok, canonical(lines)), "content_length": F.when(ok, size).cast(RAW["content_length"].dataType), "body": F.col("body"), "error": F.col("error")}
    # a filter on error stays above the generator: pushed down, it would spell the checks out again for each use of a column
    return out.select(*carried, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
