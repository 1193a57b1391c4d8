"""Large archives read by many tasks, and records read by their places.

A file is dealt into ranges of bytes.  Each range's task looks for the first place in it where
a record seems to start (a gzip member that begins with a record, or a header behind a record's
end) and follows the records from there to the first that starts in a later range.  Blocks may
hold such places, too, so what was found is then checked: records follow each other without
gaps, hence a range's start is right if it is where the records of the ranges before it end.
Ranges whose start isn't are followed again from there, until all agree; the file's start is
certain, so every range is in the end.  Numbers of records and bytes of the ranges before give each
record its place in the file, and a fault ends the file as it does for a single reader.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import NO_BODY, RAW
from ..storage import settled
from .framing import MAX_HEADER, Fault, Framed, MarkedMembers, Members, Plain, frame, is_gzip, parse_header
from .warc import batches_of, found_files, open_file

SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20
_MAGIC, _OPENING = b"\x1f\x8b\x08", b"\r\n\r\nWARC/1."


def placed(file, at: int, packed: bool, bodies: bool) -> Iterator[tuple[int | None, Framed]]:
    """Records from a place on, each with the place in the file where it could be read from (null inside of a member)."""
    if packed:
        stream = MarkedMembers(file, at)
        for r in frame(stream, bodies):
            yield stream.marks.get(r.offset), r
            for mark in [m for m in stream.marks if m < r.offset]:
                del stream.marks[mark]
    else:
        file.seek(at)
        for r in frame(Plain(file), bodies):
            yield at + r.offset, r


def follow(file, start: int, high: int, packed: bool) -> tuple[int | None, int, int]:
    """(where the first record from ``high`` on starts, records before it, their plain bytes); None: a fault ends the file here."""
    n = plain = 0
    for at, r in placed(file, start, packed, False):
        if at is not None and at >= high:
            return at, n, r.offset
        n, plain = n + 1, r.offset + r.length
        if r.fault is not None:
            return None, n, plain
    return file.size(), n, plain


def seeming_start(file, low: int, high: int, packed: bool) -> int | None:
    """The first place from ``low`` and before ``high`` where a record seems to start."""
    if low == 0:
        return 0
    mark, before = (_MAGIC, 0) if packed else (_OPENING, 4)
    at = max(low - before, 0)
    while at + before < high:
        file.seek(at)
        size = min(_CHUNK, high - at - before)
        data = file.read(size + len(mark) - 1)
        hit = data.find(mark)
        while hit >= 0 and at + hit + before < high:
            place = at + hit + before
            if _opens(file, place, packed):
                return place
            hit = data.find(mark, hit + 1)
        if len(data) < size + len(mark) - 1:
            return None
        at += size
    return None


def _opens(file, place: int, packed: bool) -> bool:
    """Whether a header can be read from a place on."""
    file.seek(place)
    try:
        if packed:
            stream, block = Members(file), b""
            while b"\r\n\r\n" not in block and len(block) < MAX_HEADER:
                more = stream.read(1 << 16)
                if not more or not (block + more).startswith(b"WARC/1."):
                    return False
                block += more
        else:
            block = b""
            while b"\r\n\r\n" not in block and len(block) < MAX_HEADER:
                more = file.read(1 << 16)
                if not more:
                    return False
                block += more
        parse_header(block[: block.index(b"\r\n\r\n") + 4])
        return True
    except (Fault, OSError, EOFError, ValueError, zlib.error):
        return False


_RANGE = "file string, found_by string, range long, low long, high long, packed boolean"
_FOLLOWED = _RANGE + ", start long, stop long, n long, plain long, fault boolean"
_CHAINED = _FOLLOWED + ", due long, live boolean, wrong boolean"


def _ranges(spark: SparkSession, path: str, split_bytes: int, compression: str) -> DataFrame:
    files = []
    for name, found_by in found_files(path):
        with open_file(name, found_by) as f:
            files.append((name, found_by, f.size(), is_gzip(name) if compression == "auto" else compression == "gzip"))
    whole = spark.createDataFrame(files, "file string, found_by string, size long, packed boolean")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / split_bytes) - 1, F.lit(0)).cast("long")))
    return whole.where("size > 0").withColumn("range", each).select(
        "file", "found_by", "range", (F.col("range") * split_bytes).alias("low"), F.least((F.col("range") + 1) * split_bytes, F.col("size")).alias("high"), "packed")


def _least(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _by_row(df: DataFrame, schema: str, make: Callable[[dict], Iterator[pa.RecordBatch]], tasks: int) -> DataFrame:
    """What ``make`` yields for each row of df, rows dealt out over tasks."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from make(row)

    return df.repartition(max(1, tasks), F.xxhash64(*[F.col(c) for c in df.columns if c in ("file", "range", "offset")])).mapInArrow(run, schema)


def _follow_row(row: dict) -> Iterator[pa.RecordBatch]:
    start = row.pop("from", None)
    with open_file(row["file"], row["found_by"]) as file:
        if start is None:
            start = seeming_start(file, row["low"], row["high"], row["packed"])
        stop, n, plain = (None, 0, 0) if start is None else follow(file, start, row["high"], row["packed"])
    made = {k: row[k] for k in ("file", "found_by", "range", "low", "high", "packed")} | {
        "start": start, "stop": stop, "n": n, "plain": plain, "fault": start is not None and stop is None}
    yield pa.RecordBatch.from_pylist([made], schema=_schema(_FOLLOWED))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def split_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, compression: str = "auto", tasks: int = 0) -> DataFrame:
    """(file, found_by, packed, start, stop, first_index, first_plain): the ranges of the files that hold records, whose starts are certain.

    Plain files are followed from header to header, packed ones are unpacked; blocks aren't
    kept.  ``stop`` is null where a fault ends the file.  A file's ranges meet in one group,
    a row for each ``split_bytes`` of it.
    """
    ranges = _ranges(spark, path, split_bytes, compression)
    tasks = tasks or _least(spark)
    found = _by_row(ranges, _FOLLOWED, _follow_row, tasks)
    while True:
        known = settled(found.groupBy("file").applyInArrow(_chained, _CHAINED))
        wrong = known.where("wrong")
        if wrong.isEmpty():
            break
        again = wrong.select(*[x.split()[0] for x in _RANGE.split(", ")], F.col("due").alias("from"))
        found = known.where("NOT wrong").select(*[x.split()[0] for x in _FOLLOWED.split(", ")]).unionByName(_by_row(again, _FOLLOWED, _follow_row, tasks))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    return known.where("live").withColumns({"first_index": so_far("n"), "first_plain": so_far("plain")}).select(
        "file", "found_by", "range", "packed", "start", "stop", "first_index", "first_plain")


def _chained(table: pa.Table) -> pa.Table:
    """A file's ranges in order, with where each ``due`` record starts; ``wrong``: the range was followed from another place.

    Behind a wrong range the next seeming start is taken to be right until that range is known.
    """
    rows, due, ended = [], 0, False
    for row in sorted(table.to_pylist(), key=lambda r: r["range"]):
        row |= {"due": None, "live": False, "wrong": False}
        if due is None and row["start"] is not None:
            due = row["start"]
        if not ended and due is not None and due < row["high"]:
            row |= {"due": due, "live": row["start"] == due, "wrong": row["start"] != due}
            ended = row["live"] and row["fault"]
            due = row["stop"] if row["live"] else None
        rows.append(row)
    return pa.Table.from_pylist(rows, schema=_schema(_CHAINED))


def read_splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, bodies: bool = True, compression: str = "auto") -> DataFrame:
    """The rows of ``read_warc``, a large file's by several tasks.

    Files are gone through twice: for where records start (``split_index``), and for the records.
    """
    return read_ranges(settled(split_index(spark, path, split_bytes, compression)), bodies)


def read_ranges(index: DataFrame, bodies: bool = True) -> DataFrame:
    """The records of the ranges of a ``split_index``, which is best settled.

    A range of SPLIT_BYTES is a task; shorter ones are put together up to that size, but for
    as many tasks as there are cores.
    """
    def read(row: dict):
        with open_file(row["file"], row["found_by"]) as file:
            def records():
                for i, (at, r) in enumerate(placed(file, row["start"], row["packed"], bodies)):
                    if row["stop"] is not None and at is not None and at >= row["stop"]:
                        return
                    yield i, r

            yield from batches_of(records(), row["file"], bodies, first=row["first_index"], base=row["first_plain"])

    n, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    return _by_row(index, RAW if bodies else NO_BODY, read, min(max(1, n), max(_least(index.sparkSession), -(-size // SPLIT_BYTES))))


def read_places(places: DataFrame, keep: list[str] | None = None, tasks: int = 0) -> DataFrame:
    """The record at each (file, offset, length), as of ``write_warc``'s rows: raw rows, with ``stored_offset`` and the kept columns.

    ``offset`` in the result counts from the place.  What isn't exactly one record has an
    error; a row without a place gives none.
    """
    from pyspark.sql import types as T

    keep = list(keep or [])
    schema = T.StructType([*RAW, T.StructField("stored_offset", T.LongType()), *[places.schema[c] for c in keep]])
    narrow = places.where(F.col("file").isNotNull() & F.col("offset").isNotNull() & F.col("length").isNotNull()).select("file", "offset", "length", *[c for c in keep if c not in ("file", "offset", "length")])

    def run(batches):
        name = file = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("file", "offset", "length")}
                if row["file"] != name:
                    if file is not None:
                        file.close()
                    name = row["file"]
                    file = open_file(*_found(name))
                file.seek(row["offset"])
                data = pa.BufferReader(file.read(row["length"]))
                got = list(frame(Members(data) if is_gzip(name) else data, True))
                if len(got) != 1:
                    got = [Framed(0, row["length"], None, None, None, None, ("stream", "NotOneRecord", f"{len(got)} records stand at the place."))]
                for made in batches_of([(0, got[0])], name, True):
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array([row["offset"]], pa.int64()), *[batch.column(c).slice(i, 1) for c in keep]], names=schema.names)
        if file is not None:
            file.close()

    tasks = tasks or int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def _found(name: str) -> tuple[str, str]:
    from .warc import _filesystem

    return _filesystem(name)[1], name
