"""Columns that a function of whole texts adds to a table, block by block."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import sliced
from .lineage import quoted


def with_text_columns(df: DataFrame, of: list, kinds: dict[str, T.DataType], compute: Callable[..., list], block: int = 4 << 20) -> DataFrame:
    """df and the columns of ``kinds``, which ``compute`` makes of the columns ``of`` of about ``block`` bytes of text.

    ``of``: the text column first, then others that compute takes.  Any names of df's own
    columns will do, those with dots and those of the new columns too (the new ones stand last).
    """
    kept, given = [f"c{i}" for i in range(len(df.columns))], [f"g{i}" for i in range(len(of))]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(kept, df.schema)), *(T.StructField(f"n{i}", t) for i, t in enumerate(kinds.values()))])
    plain = df.select(*[F.col(c).alias(k) for c, k in zip(quoted(df), kept)], *[c.alias(g) for c, g in zip(of, given)])

    def run(batches):
        for batch in sliced(batches, "g0", block):
            made = compute(*batch.columns[len(kept):])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*df.columns, *kinds)
