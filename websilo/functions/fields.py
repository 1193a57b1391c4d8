"""``application/warc-fields`` blocks: ordered, repeatable named fields."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
_PAIR = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_FIELD = re.compile(rb"([!#$%&'*+\-.0-9A-Z^_`a-z|~]+)[ \t]*:((?:[^\r\n]|\r?\n[ \t])*+)\r?\n")
_FOLD = re.compile(rb"(?:\r?\n)[ \t]+")

#: The fields of warcinfo and metadata blocks, and the DCMI metadata terms (the first fifteen
#: are also elements of the legacy namespace).
WARCINFO_FIELDS = ("operator", "software", "robots", "hostname", "ip", "http-header-user-agent", "http-header-from")
METADATA_FIELDS = ("via", "hopsFromSeed", "fetchTimeMs")
DCMI_ELEMENTS = (
    "contributor", "coverage", "creator", "date", "description", "format", "identifier", "language", "publisher",
    "relation", "rights", "source", "subject", "title", "type",
)
DCMI_FURTHER = (
    "abstract", "accessRights", "accrualMethod", "accrualPeriodicity", "accrualPolicy", "alternative", "audience",
    "available", "bibliographicCitation", "conformsTo", "created", "dateAccepted", "dateCopyrighted", "dateSubmitted",
    "educationLevel", "extent", "hasFormat", "hasPart", "hasVersion", "instructionalMethod", "isFormatOf", "isPartOf",
    "isReferencedBy", "isReplacedBy", "isRequiredBy", "isVersionOf", "issued", "license", "mediator", "medium",
    "modified", "provenance", "references", "replaces", "requires", "rightsHolder", "spatial", "tableOfContents",
    "temporal", "valid",
)
DCMI_TERMS_URI, DCMI_ELEMENTS_URI = "http://purl.org/dc/terms/", "http://purl.org/dc/elements/1.1/"


def parse_bytes(block: bytes) -> tuple[list[dict] | None, str | None]:
    """(fields, error) of a block; one empty line may close it."""
    at, out = 0, []
    while (m := _FIELD.match(block, at)) is not None:
        name = m[1].decode("ascii")
        try:
            out.append({"name": name, "value": _FOLD.sub(b" ", m[2]).strip(b" \t\r\n").decode("utf-8")})
        except UnicodeDecodeError:
            return None, f"The value of `{name}` isn't UTF-8."
        at = m.end()
    if block[at:] in (b"", b"\r\n", b"\n"):
        return out, None
    return None, f"No field begins at byte {at} of the block."


@F.arrow_udf(T.StructType([T.StructField("fields", PAIR), T.StructField("error", T.StringType())]))
def parse(blocks: pa.Array) -> pa.Array:
    rows = [(None, None) if b is None else parse_bytes(b) for b in blocks.to_pylist()]
    return pa.array([{"fields": f, "error": e} for f, e in rows], pa.struct([("fields", _PAIR), ("error", pa.string())]))


def get(fields: Column, name: str) -> Column:
    """The first value of a name, in any case."""
    return F.try_element_at(get_all(fields, name), F.lit(1))


def get_all(fields: Column, name: str) -> Column:
    return F.transform(F.filter(fields, lambda f: F.lower(f["name"]) == name.lower()), lambda f: f["value"])


def put(fields: Column, name: str, value: Column) -> Column:
    """fields with one value of a name: at its first place, without later ones, or at the end; unchanged if value is null."""
    same = lambda f: F.lower(f["name"]) == name.lower()
    first = F.array_position(F.transform(fields, lambda f: F.lower(f["name"])), name.lower())
    new = F.struct(F.lit(name).alias("name"), value.alias("value"))
    changed = F.transform(fields, lambda f, i: F.when(same(f) & (i + 1 == first), F.struct(f["name"].alias("name"), value.alias("value"))).when(~same(f), f))
    return F.when(value.isNull(), fields).when(first > 0, F.filter(changed, lambda f: f.isNotNull())).otherwise(F.concat(fields, F.array(new)))


def push(fields: Column, name: str, value: Column) -> Column:
    return F.when(value.isNull(), fields).otherwise(F.concat(fields, F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))))


def render(fields: Column) -> Column:
    """A block: ``name: value`` lines."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit("\r\n"))), "").cast("binary")


def warcinfo_columns(df: DataFrame, fields: str = "body_fields") -> DataFrame:
    """df with the named fields of warcinfo blocks; ip is null if it isn't an address."""
    from .values import is_ip

    f = F.col(fields)
    names = {"operator": "operator", "software": "software", "robots": "robots", "hostname": "hostname",
             "user_agent": "http-header-user-agent", "from_address": "http-header-from"}
    ip = get(f, "ip")
    return df.withColumns({k: get(f, v) for k, v in names.items()} | {"ip": F.when(is_ip(ip), ip)})


def metadata_columns(df: DataFrame, fields: str = "body_fields") -> DataFrame:
    """df with via, hops_from_seed and fetch_time_ms (a count, or null)."""
    from .values import digits

    f = F.col(fields)
    return df.withColumns({"via": get(f, "via"), "hops_from_seed": get(f, "hopsFromSeed"), "fetch_time_ms": digits(get(f, "fetchTimeMs"))})


def from_fields(df: DataFrame, schema: T.StructType, fields: str = "body_fields", into: str = "data") -> DataFrame:
    """df with a struct(value, error): fields read into typed columns by name, in any case.

    A repeated field needs an array type; a value that its type doesn't take is an
    error; missing fields are null and unknown ones ignored.
    """
    f = F.col(fields)
    columns, errors = [], []
    for s in schema:
        values = get_all(f, s.name)
        if isinstance(s.dataType, T.ArrayType):
            cast = F.transform(values, _caster(s.dataType.elementType))
            bad = F.exists(cast, lambda v: v.isNull())
        else:
            cast = F.try_element_at(values, F.lit(1)).try_cast(s.dataType)
            errors.append(F.when(F.size(values) > 1, F.lit(f"The `{s.name}` occurs more than once.")))
            bad = (F.size(values) > 0) & cast.isNull()
        errors.append(F.when(bad, F.lit(f"The value of `{s.name}` is of another type.")))
        columns.append(cast.alias(s.name))
    error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    return df.withColumn(into, F.struct(F.when(error.isNull(), F.struct(*columns)).alias("value"), error.alias("error")))


def _caster(kind: T.DataType):
    return lambda v: v.try_cast(kind)


def to_fields(df: DataFrame, struct: str, schema: T.StructType, into: str = "body_fields") -> DataFrame:
    """df with the named fields of a struct column: nulls are left out, arrays repeat."""
    parts = []
    for s in schema:
        c = F.col(struct)[s.name]
        values = F.transform(c, lambda v: v.cast("string")) if isinstance(s.dataType, T.ArrayType) else F.array(c.cast("string"))
        parts.append(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull()), _named(s.name)))
    return df.withColumn(into, F.concat(*parts))


def _named(name: str):
    return lambda v: F.struct(F.lit(name).alias("name"), v.alias("value"))


def dcmi_terms(spark) -> DataFrame:
    """(name, uri, is_element) of the DCMI terms."""
    rows = [(n, DCMI_TERMS_URI + n, n in DCMI_ELEMENTS) for n in sorted(DCMI_ELEMENTS + DCMI_FURTHER)]
    return spark.createDataFrame(rows, "name string, uri string, is_element boolean")


def dcmi_term(name: Column) -> Column:
    """struct(name, uri, is_element) of the DCMI term of a field name, in any case; null for others."""
    terms = {n.lower(): n for n in DCMI_ELEMENTS + DCMI_FURTHER}
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in terms.items() for x in pair]), F.lower(name))
    return F.when(own.isNotNull(), F.struct(own.alias("name"), F.concat(F.lit(DCMI_TERMS_URI), own).alias("uri"), own.isin(*DCMI_ELEMENTS).alias("is_element")))


def _some(values: dict[str, Column | None]) -> Column:
    """Named fields of the values that are given and not null, in turn."""
    parts = [F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in values.items() if c is not None]
    return F.filter(F.array(*parts), lambda f: f["value"].isNotNull()) if parts else F.array().cast("array<struct<name: string, value: string>>")


def warcinfo_body(operator: tuple[Column, Column | None] | None = None, software: tuple[Column, Column | None] | None = None, robots: Column | None = None,
                  hostname: Column | None = None, ip: Column | None = None, user_agent: Column | None = None, from_address: Column | None = None) -> Column:
    """Fields of a warcinfo block: an operator is ``name <email>``, software ``name/version``; what is null is left out."""
    def two(pair, between: str, after: str):
        if pair is None:
            return None
        head, tail = pair
        return head if tail is None else F.when(tail.isNull(), head).otherwise(F.concat(head, F.lit(between), tail, F.lit(after)))

    return _some({"operator": two(operator, " <", ">"), "software": two(software, "/", ""), "robots": robots, "hostname": hostname, "ip": ip,
                  "http-header-user-agent": user_agent, "http-header-from": from_address})


def metadata_body(via: Column | None = None, hops_from_seed: Column | None = None, fetch_time: Column | None = None) -> Column:
    """Fields of a metadata block; fetch_time in seconds, written in whole milliseconds."""
    ms = None if fetch_time is None else F.floor(fetch_time.cast("decimal(18,6)") * 1000).cast("long")
    return _some({"via": via, "hopsFromSeed": hops_from_seed, "fetchTimeMs": ms})
