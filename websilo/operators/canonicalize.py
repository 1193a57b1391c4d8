"""Canonical spelling and order of header fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NAMES, RANK
from .grammar import lookup, standard_name

LAST = len(NAMES)


def rank(name: Column) -> Column:
    """The place of a standard field; the number of standard fields for others."""
    return F.coalesce(lookup(RANK, F.lower(name)), F.lit(LAST))


def canonical(headers: Column) -> Column:
    """Header fields in canonical order and spelling."""
    placed = F.transform(headers, lambda h, i: F.struct(
        rank(h["name"]).alias("r"), i.alias("i"), F.coalesce(standard_name(F.lower(h["name"])), h["name"]).alias("name"), h["value"].alias("value")))
    return F.transform(F.array_sort(placed), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))


def canonicalize(raw: DataFrame) -> DataFrame:
    """raw with standard names respelled and fields in canonical order; fields of equal rank keep theirs, values stay."""
    return raw.withColumn("headers", canonical(F.col("headers")))
