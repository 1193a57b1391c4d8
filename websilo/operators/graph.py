"""The graph of records and their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as v
from .grammar import get
from .merge import normal_id

#: Referring fields in the order they are drawn, with labels; colours of record types.
EDGE_FIELDS = {"WARC-Concurrent-To": "concurrent-to", "WARC-Warcinfo-ID": "warcinfo-id", "WARC-Refers-To": "refers-to", "WARC-Segment-Origin-ID": "segment-origin-id"}
COLOURS = {
    "warcinfo": "#F4A261",
    "response": "#8ECAE6",
    "resource": "#FFD166",
    "request": "#90BE6D",
    "metadata": "#CDB4DB",
    "revisit": "#FFADAD",
    "conversion": "#B8C0FF",
    "continuation": "#A8DADC",
}
_UUID = r"(?i)\Aurn:uuid:([\x00-\x7F]*)\z"


def nodes(raw: DataFrame) -> DataFrame:
    """(file, record_index, record_type, record_id): unreadable rows are left out."""
    kind = F.lower(v.trim_space(v.latin(get("WARC-Type"))))
    return raw.where(F.col("headers").isNotNull()).select(
        "file", "record_index", F.when(kind != "", kind).otherwise("unknown").alias("record_type"), normal_id(get("WARC-Record-ID")).alias("record_id"))


def references(raw: DataFrame) -> DataFrame:
    """(file, record_index, place, label, target): every occurrence of the referring fields."""
    lists = []
    for i, (n, label) in enumerate(EDGE_FIELDS.items()):
        lists.append(F.transform(_named(n), _edge(i, label)))
    return raw.where(F.col("headers").isNotNull()).select("file", "record_index", F.posexplode(F.concat(*lists)).alias("place", "e")).select(
        "file", "record_index", "place", F.col("e")["label"].alias("label"), F.col("e")["target"].alias("target")).where(F.col("target").isNotNull())


def _named(name: str) -> Column:
    return F.filter("headers", lambda h: F.lower(h["name"]) == name.lower())


def _edge(order: int, label: str):
    return lambda h: F.struct(F.lit(order).alias("order"), F.lit(label).alias("label"), normal_id(h["value"]).alias("target"))


def edges(raw: DataFrame) -> DataFrame:
    """(file, record_index, place, label, target_index): references resolved in their file; the last of equal ids counts."""
    ids = nodes(raw).where(F.col("record_id").isNotNull()).groupBy("file", F.col("record_id").alias("target")).agg(F.max("record_index").alias("target_index"))
    return references(raw).join(ids, ["file", "target"]).select("file", "record_index", "place", "label", "target_index")


def dangling(raw: DataFrame) -> DataFrame:
    """References to records that aren't in their file."""
    ids = nodes(raw).where(F.col("record_id").isNotNull()).select("file", F.col("record_id").alias("target")).distinct()
    return references(raw).join(ids, ["file", "target"], "left_anti")


def labels(of: DataFrame) -> DataFrame:
    """nodes with ``label``: the shortest prefix of a UUID, of eight characters or more, that no other UUID of the file has;
    other ids shortened in the middle; ``record N (no ID)``.

    In sorted order the longest prefix shared with any other UUID is shared with a neighbour.
    """
    uuid = F.when(F.col("record_id").rlike(_UUID), F.regexp_extract("record_id", _UUID, 1))
    rows = of.withColumn("uuid", uuid)
    distinct = rows.where(F.col("uuid").isNotNull()).select("file", "uuid").distinct()
    w = Window.partitionBy("file").orderBy("uuid")

    def shared(other: Column) -> Column:
        n = F.least(F.length("uuid"), F.length(other))
        same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring("uuid", F.lit(1), i) == F.substring(other, F.lit(1), i))
        return F.when(other.isNull(), 0).otherwise(F.array_max(same))

    need = distinct.select("file", "uuid", (F.greatest(shared(F.lag("uuid").over(w)), shared(F.lead("uuid").over(w))) + 1).alias("need"))
    joined = rows.join(need, ["file", "uuid"], "left")
    short = F.substring("uuid", F.lit(1), F.least(F.length("uuid"), F.greatest(F.lit(8), F.col("need"))))
    rid = F.col("record_id")
    other = F.when(F.length(rid) <= 28, rid).otherwise(F.concat(F.substring(rid, 1, 17), F.lit("…"), F.substring(rid, -8, 8)))
    none = F.concat(F.lit("record "), (F.col("record_index") + 1).cast("string"), F.lit(" (no ID)"))
    return joined.withColumn("label", F.coalesce(short, other, none)).drop("uuid", "need")


def hue_colour(hue: Column) -> Column:
    """A light, moderately saturated colour of a hue in degrees, as #RRGGBB."""
    chroma, sector = 0.45, hue / 60.0
    mid = F.lit(chroma) * (1.0 - F.abs(sector % 2.0 - 1.0))
    k = F.floor(sector)
    c, zero = F.lit(chroma), F.lit(0.0)
    order = [(c, mid, zero), (mid, c, zero), (zero, c, mid), (zero, mid, c), (mid, zero, c), (c, zero, mid)]
    out = []
    for channel in range(3):
        x = F.lit(None).cast("double")
        for i, parts in enumerate(order):
            x = F.when(k == i, parts[channel]).otherwise(x)
        out.append(F.lpad(F.hex(F.round((x + (0.775 - chroma / 2)) * 255).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), *out)


def colours(of: DataFrame) -> DataFrame:
    """(record_type, colour) of the types present: fixed ones, and hues in turn for others by first appearance."""
    first = of.groupBy("record_type").agg(F.min(F.struct("file", "record_index")).alias("at"))
    fixed = F.lit(None).cast("string")
    for t, c in COLOURS.items():
        fixed = F.when(F.col("record_type") == t, c).otherwise(fixed)
    named = first.withColumn("fixed", fixed)
    turn = F.row_number().over(Window.partitionBy(F.col("fixed").isNull()).orderBy("at")) - 1  # over types, not records
    return named.select("record_type", F.coalesce("fixed", hue_colour((turn * 137 + 25) % 360)).alias("colour"))


def d2_lines(raw: DataFrame) -> DataFrame:
    """(file, section, a, b, line): D2 source of each file's nodes (section 0) and references (1); to be sorted and joined."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    n = labels(nodes(raw))
    n = n.join(F.broadcast(colours(nodes(raw))), "record_type")
    node = n.select("file", F.lit(0).alias("section"), F.col("record_index").alias("a"), F.lit(0).alias("b"), F.concat(
        F.lit("records.record_"), F.col("record_index").cast("string"), F.lit(': "'), quoted(F.col("label")), F.lit('" { style.fill: "'), F.col("colour"), F.lit('" }')).alias("line"))
    e = edges(raw).select("file", F.lit(1).alias("section"), F.col("record_index").alias("a"), F.col("place").alias("b"), F.concat(
        F.lit("records.record_"), F.col("record_index").cast("string"), F.lit(" -> records.record_"), F.col("target_index").cast("string"),
        F.lit(': "'), F.col("label"), F.lit('"')).alias("line"))
    return node.unionByName(e)
