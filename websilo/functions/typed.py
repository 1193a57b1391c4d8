"""Named fields of a block as typed values, and back: scalars, optional and repeated fields, choices, and a map of the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import TOKEN, full

_PAIRS = "array<struct<name: string, value: string>>"
#: kind -> (Spark's type, the texts it has, what it is called, least and largest value of whole numbers)
_KINDS = {
    "string": ("string", None, "text", None), "boolean": ("boolean", "true|false", "a boolean", None), "character": ("string", r"(?s).", "a character", None),
    **{f"int{n}": ("bigint", r"[+-]?[0-9]+", "an integer", (-(1 << n - 1), (1 << n - 1) - 1)) for n in (8, 16, 32, 64)},
    **{f"uint{n}": ("decimal(20,0)" if n == 64 else "bigint", r"[+]?[0-9]+", "an integer", (0, (1 << n) - 1)) for n in (8, 16, 32, 64)},
    "float": ("double", r"[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", "a floating-point number", None),
}


@dataclass(frozen=True)
class Field:
    """A field that a block may have: its kind (see ``_KINDS``), whether it must be there, may repeat, or is one of ``choices``."""

    name: str
    kind: str = "string"
    required: bool = True
    many: bool = False
    choices: tuple[str, ...] | None = None


def _read(kind: str, text: Column) -> Column:
    """text as a kind; null if it isn't one."""
    spark_type, pattern, _, bounds = _KINDS[kind]
    good = F.lit(True) if pattern is None else full(text, pattern)
    if bounds is not None:
        whole = F.when(full(text, pattern), F.regexp_replace(text, r"\A([+-]?)0+(?=[0-9])", "$1")).try_cast("decimal(38,0)")
        return F.when(whole.between(F.lit(str(bounds[0])).cast("decimal(38,0)"), F.lit(str(bounds[1])).cast("decimal(38,0)")), whole.cast(spark_type))
    if kind == "float":
        low = F.lower(F.regexp_replace(text, r"\A[+-]", ""))
        sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
        special = F.when(low == "nan", F.lit(float("nan"))).when(low.isin("inf", "infinity"), sign * F.lit(float("inf")))
        return F.when(good, F.coalesce(special, text.try_cast("double")))
    return F.when(good, text.cast(spark_type) if spark_type == "string" else text.try_cast(spark_type))


def _fault(code: str, name: Column | str, message: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(code).alias("code"), lit(name).alias("field"), lit(message).alias("message"))


def read(fields: Column, schema: list[Field], rest: bool = False, deny_unknown: bool = False) -> Column:
    """struct(value, rest, error) of an array of named fields.

    Names are those of the schema in any case of letters.  ``error`` (code, field, message) is
    that of the first line whose field breaks the schema: RepeatedField, UnreadableValue,
    UnknownChoice or, with ``deny_unknown``, UnknownField; and MissingField where all lines are fine.
    value is null then.  ``rest``: a map of the other fields, by their first spelling, to all their values.
    """
    names = [f.name.lower() for f in schema]
    if len(set(names)) < len(names):
        raise ValueError("two fields of the schema have the same name")
    columns, faults, missing = [], [], []
    lowered = F.transform(fields, lambda f: F.lower(f["name"]))
    place = lambda name: F.array_position(lowered, name)
    for f in schema:
        values = F.transform(F.filter(fields, _named(f.name)), lambda x: x["value"])
        present = F.size(values) > 0
        if f.choices is not None:
            made = F.transform(values, _chosen(f.choices))
            wrong = _fault("UnknownChoice", f.name, F.concat(F.lit(f"{f.name} is none of "), F.lit(", ".join(f.choices))))
        else:
            made = F.transform(values, _reader(f.kind))
            wrong = _fault("UnreadableValue", f.name, f"{f.name} is not {_KINDS[f.kind][2]}")
        bad = F.exists(made, lambda x: x.isNull())
        checks = F.when(present & bad, wrong)
        if not f.many:
            again = _fault("RepeatedField", f.name, F.concat(F.lit(f"{f.name} stands there "), F.size(values).cast("string"), F.lit(" times")))
            checks = F.when(F.size(values) > 1, again).when(present & bad, wrong)
        faults.append(F.when(checks.isNotNull(), F.struct(place(f.name.lower()).alias("at"), checks.alias("fault"))))
        if f.required and not f.many:
            missing.append(F.when(~present, _fault("MissingField", f.name, f"{f.name} is missing")))
        columns.append((F.when(present, made) if f.many and not f.required else made if f.many else F.try_element_at(made, F.lit(1))).alias(f.name))
    unknown = F.filter(fields, lambda f: ~F.lower(f["name"]).isin(*names) if names else F.lit(True))
    if deny_unknown:
        first = F.try_element_at(unknown, F.lit(1))
        faults.append(F.when(first.isNotNull(), F.struct(place(F.lower(first["name"])).alias("at"), _fault("UnknownField", first["name"], F.concat(first["name"], F.lit(" is not a field of the schema"))).alias("fault"))))
    earliest = F.array_min(F.filter(F.array(*faults), lambda x: x.isNotNull()))["fault"] if faults else F.lit(None)
    error = F.coalesce(earliest, *missing) if faults or missing else F.lit(None).cast("struct<code: string, field: string, message: string>")
    value = F.struct(*columns) if columns else F.struct(F.lit(None).cast("string").alias("none"))
    keys = F.array_distinct(F.transform(unknown, lambda f: F.lower(f["name"])))
    spelt = F.transform(keys, lambda k: F.try_element_at(F.filter(unknown, lambda f: F.lower(f["name"]) == k), F.lit(1))["name"])
    held = F.transform(keys, lambda k: F.transform(F.filter(unknown, lambda f: F.lower(f["name"]) == k), lambda f: f["value"]))
    others = F.map_from_arrays(spelt, held) if rest else F.lit(None).cast("map<string, array<string>>")
    return F.struct(F.when(error.isNull(), value).alias("value"), others.alias("rest"), error.alias("error"))


# the functions that arrays are mapped by have one parameter each: a second one would be the place
def _chosen(choices: tuple[str, ...]):
    return lambda x: F.when(x.isin(*choices), x)


def _reader(kind: str):
    return lambda x: _read(kind, x)


def _shower(kind: str):
    return lambda x: _shown(kind, x)


def _line(name: str):
    return lambda x: F.struct(F.lit(name).alias("name"), x.alias("value"))


def _named(name: str):
    return lambda f: F.lower(f["name"]) == name.lower()


def _shown(kind: str, value: Column) -> Column:
    if kind == "float":
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(F.isnan(value), "NaN").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(whole, value.cast("decimal(16,0)").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def write(value: Column, schema: list[Field], rest: Column | None = None) -> Column:
    """struct(fields, error): the named fields of a struct, in the schema's order, then those of a map of further ones.

    Nulls are left out, arrays give a line for each value.  A name that is no token, or a
    value that couldn't be read back (line breaks, white space at its ends), is an error.
    """
    parts = []
    for f in schema:
        c = value[f.name]
        texts = F.transform(F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull()), _shower(f.kind)) if f.many else F.filter(F.array(_shown(f.kind, c)), lambda x: x.isNotNull())
        parts.append(F.transform(texts, _line(f.name)))
    if rest is not None:
        lines = F.transform(F.map_entries(F.coalesce(rest, F.create_map().cast("map<string, array<string>>"))), lambda e: F.transform(e["value"], lambda x: F.struct(e["key"].alias("name"), x.alias("value"))))
        parts.append(F.flatten(lines))
    fields = F.concat(*parts) if parts else F.array().cast(_PAIRS)
    bad = F.try_element_at(F.filter(fields, lambda f: ~full(f["name"], TOKEN + "++") | f["value"].rlike(r"[\r\n]|\A[ \t]|[ \t]\z")), F.lit(1))
    fault = F.when(bad.isNotNull(), F.when(~full(bad["name"], TOKEN + "++"), _fault("InvalidName", bad["name"], "the name is no token")).otherwise(
        _fault("InvalidValue", bad["name"], "the value wouldn't be read back as it is")))
    return F.struct(F.when(fault.isNull(), fields).alias("fields"), fault.alias("error"))
