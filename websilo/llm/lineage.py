"""Cutting a plan's lineage in storage that all executors share, and names that no column of a table has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df hasn't, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[str]:
    """The columns of df, for select: names may hold dots."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def _folder(spark) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (as in tests) one in the warehouse."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", own))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in the folder that the session names in spark.checkpoint.dir."""
    _folder(df.sparkSession)
    return df.checkpoint()


def cut_table(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the checkpoint folder and read back: smaller than a checkpoint for many narrow rows.

    The table stays in that folder until ``discard``, or, as checkpoints do, for the folder's owner to sweep.
    """
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes what cut_table wrote for a table that nothing will read again."""
    path, spark = getattr(table, "_written_at", None), table.sparkSession
    if path is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
