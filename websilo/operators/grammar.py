"""Raw records to the grammar-checked level: each standard field's value by its form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..schema import FORM, NAMES


def no_error() -> Column:
    return F.lit(None).cast("struct<level: string, code: string, field: string, message: string>")


def error(level: str, code: Column | str, field: Column | str | None, message: Column) -> Column:
    lit = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    return F.struct(F.lit(level).alias("level"), lit(code).alias("code"), lit(field).alias("field"), message.alias("message"))


def lookup(table: dict[str, str | int], key: Column) -> Column:
    """The value of a constant table for a key; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def standard_name(lower_name: Column) -> Column:
    """The standard spelling of a lower-case name; null for others."""
    return lookup({n.lower(): n for n in NAMES}, lower_name)


def _form(lower_name: Column) -> Column:
    return lookup(FORM, lower_name)


def value_error(form: Column, text: Column) -> Column:
    """What is wrong with a value of a form: a message, or null."""
    said = lambda what: F.concat(F.lit(f"not {what}: "), text)
    control = F.length(F.regexp_extract(text, r"\A([^\x00-\x08\x0A-\x1F\x7F]*)", 1))
    return (
        F.when((form == "uri") & v.bare_uri(text).isNull(), said("a URI"))
        .when((form == "date") & ~v.is_date(text), said("a timestamp"))
        .when((form == "digits") & v.digits(text).isNull(), said("a number"))
        .when((form == "token") & ~v.is_token(text), said("a token"))
        .when((form == "ip") & ~v.is_ip(text), said("an IP address"))
        .when(form == "digest", v.digest_error(text))
        .when(form == "media_type", v.media_type_error(text))
        .when((form == "text") & v.text_value(text).isNull(), F.concat(
            F.lit("no text: control character at byte "), control.cast("string"), F.lit(" of `"), text, F.lit("`")))
    )


def to_untyped(raw: DataFrame) -> DataFrame:
    """raw with ``fields``: array<struct<name, field, text, utf8>> and grammar faults in ``error``.

    ``field``: the standard name, or null; ``text``: the unfolded value (as bytes in
    ISO-8859-1 where it isn't UTF-8, and then ``utf8`` is false).  The first field
    with a fault in header order is reported; a framing fault outranks it.
    """
    def one(h: Column) -> Column:
        unfolded = v.unfold(h["value"])
        read = v.utf8(unfolded)
        return F.struct(h["name"].alias("name"), standard_name(F.lower(h["name"])).alias("field"),
                        F.coalesce(read, unfolded).alias("text"), read.isNotNull().alias("utf8"))

    out = raw.withColumn("fields", F.transform("headers", one))
    formed = F.transform(F.filter("fields", lambda f: f["field"].isNotNull()), lambda f: F.struct(
        f["name"].alias("name"), _form(F.lower(f["name"])).alias("form"), f["text"].alias("text")))
    faults = F.filter(F.transform(formed, lambda f: F.struct(
        f["name"].alias("name"), value_error(f["form"], f["text"]).alias("why"))), lambda f: f["why"].isNotNull())
    out = out.withColumn("_fault", F.try_element_at(faults, F.lit(1)))
    said = error("untyped", "MalformedField", F.col("_fault")["name"], F.concat(
        F.col("_fault")["name"], F.lit(": "), F.col("_fault")["why"]))
    return out.withColumn("error", F.coalesce("error", F.when(F.col("_fault").isNotNull(), said))).drop("_fault")


def get(name: str, headers: str = "headers") -> Column:
    """The first raw value of a name, in any case; white space kept."""
    return F.try_element_at(get_all(name, headers), F.lit(1))


def get_all(name: str, headers: str = "headers") -> Column:
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def text_of(name: str, headers: str = "headers") -> Column:
    """The first value of a name, unfolded, as text."""
    unfolded = v.unfold(get(name, headers))
    return F.coalesce(v.utf8(unfolded), unfolded)


def field(name: str, fields: str = "fields") -> Column:
    """The first checked value of a standard field, as text."""
    return F.try_element_at(all_fields(name, fields), F.lit(1))


def all_fields(name: str, fields: str = "fields") -> Column:
    return F.transform(F.filter(fields, lambda f: f["field"] == name), lambda f: f["text"])


def where_type(raw: DataFrame, *types: str) -> DataFrame:
    return raw.where(F.lower(v.trim_space(v.latin(get("WARC-Type")))).isin(*types))


def where_last_segment_not(df: DataFrame, uri: Column, names: list[str]) -> DataFrame:
    """Rows whose URI's last path segment isn't one of names."""
    path = F.regexp_extract(uri, r"^[^:]+:(?://[^/?#]*)?([^?#]*)", 1)
    return df.where(~F.element_at(F.split(path, "/"), -1).isin(*names))


def filter_raw(spark, path: str, wanted: list, **options) -> DataFrame:
    """Raw records of files that meet every ``Wanted`` test; others' blocks are passed over with their ends checked, and faults stay."""
    from ..sources.warc import read_warc

    return read_warc(spark, path, wanted=wanted, **options)


def kept(wanted: list) -> Column:
    """Rows with an error, and those that meet every test."""
    condition = F.lit(True)
    for w in wanted:
        condition = condition & w.column()
    return F.col("error").isNotNull() | condition


def filter_untyped(spark, path: str, wanted: list, **options) -> DataFrame:
    """Grammar-checked records of files that meet every test; records whose header has a fault stay, without their blocks where a test refused them."""
    from ..sources.warc import read_warc

    return to_untyped(read_warc(spark, path, wanted=wanted, refused="header", **options)).where(kept(wanted))
