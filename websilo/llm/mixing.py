"""Mixing sources to target weights.

Sizes are summed by source, targets are shared out by weight, and each document
is repeated floor(rate) times plus one more copy with the probability of the
rate's fraction, drawn from a hash of its id.  All DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, quoted, spare

#: A source table of at most so many rows and bytes of names is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4 << 20


def size_of(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, LF, VT, FF and CR; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:doc_id); null ids draw as the text 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row for each source, null included.

    Sources stand in code-point order, null last, and take the weights in turn.
    Targets share ``share`` times all sizes by weight; a target stops at ``most``
    times its source's size and the excess is shared again by weight, until none
    is above: the fixed point is min(most * size, level * weight), whose level
    follows from one pass over the sources ordered by size / weight.  The windows
    here run over one row for each named source, not over documents.
    """
    sums = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    sums = sums.withColumn("weight", turn)
    by_rate = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    after = by_rate.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(most))
    sums = (
        sums.withColumn("pot", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)))
        .withColumn("left", F.sum("weight").over(after))
        # the level if all sources before this one are full and none from here on
        .withColumn("level", (F.col("pot") - F.col("full")) / F.col("left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= cap)
        .withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
            by_rate.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))
    return sums.select("source", "source_size", target.alias("target"))


_NAMES = ("size", "source_size", "target", "copies")


def with_copies(docs: DataFrame, seed: str = "mix", names: tuple[str, ...] = _NAMES, **targets) -> DataFrame:
    """docs with size, source_size, target and copies (0 to the cap), under ``names``.

    Null texts have size 0; a source without any words has target 0 and its
    documents get no copies; a null source is a source of its own.  Rows with the same
    id draw alike.  Texts are taken whole.  Columns of docs of ``names`` are replaced; others
    stay as they are, whatever their names.  An empty table gives no rows.
    """
    size, source_size, target, copies = names
    docs = docs.drop(*names)
    mine, rate_col = spare(docs, "source_name"), spare(docs, "rate")
    # written once: it is asked for its size, and then joined
    by_source = cut(source_targets(docs, **targets).select(
        F.col("source").alias(mine), F.col("source_size").alias(source_size), F.col("target").alias(target)))
    n, length = by_source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(mine)), F.lit(0))).first()
    if n <= BROADCAST_ROWS and length <= BROADCAST_BYTES:
        by_source = F.broadcast(by_source)
    joined = docs.join(by_source, docs["source"].eqNullSafe(by_source[mine])).drop(mine)
    most = float(targets.get("most", 2.0))
    rate = F.when(F.col(source_size) > 0, F.least(F.col(target) / F.col(source_size), F.lit(most))).otherwise(0.0)
    return (
        joined.withColumn(size, size_of(F.col("text")))
        .withColumn(rate_col, rate)
        .withColumn(copies, (F.floor(rate_col) + (draw(F.col("doc_id"), seed) < F.col(rate_col) - F.floor(rate_col)).cast("long")))
        .drop(rate_col)
    )


def mix(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """docs repeated to the target weights, with the columns of docs as they are, whatever their names."""
    names = tuple(spare(docs, n) for n in _NAMES)
    many = with_copies(docs, seed, names, **targets)
    turn = spare(many, "turn")
    return many.withColumn(turn, F.explode(F.array_repeat(F.lit(1), F.col(names[3]).cast("int")))).select(*quoted(docs))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3
           WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
l AS (
  SELECT *,
    (sum(source_size) OVER ())::DOUBLE * 1.5 AS pot,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source COLLATE "C" NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0 AS full_,
    sum(weight) OVER (ORDER BY source_size / weight, source COLLATE "C" NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
  FROM w),
f AS (
  SELECT min(rn) AS rn0 FROM (
    SELECT row_number() OVER (ORDER BY source_size / weight, source COLLATE "C" NULLS LAST) AS rn,
           (pot - full_) / left_ * weight <= source_size * 2.0 AS fits FROM l) WHERE fits),
level AS (
  SELECT (pot - full_) / left_ AS level FROM (
    SELECT *, row_number() OVER (ORDER BY source_size / weight, source COLLATE "C" NULLS LAST) AS rn FROM l)
  WHERE rn = (SELECT rn0 FROM f)),
t AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, (SELECT level FROM level) * weight)::DOUBLE AS target FROM w),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM r
"""
