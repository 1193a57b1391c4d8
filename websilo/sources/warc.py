"""Reading and writing web archives with Spark's Python data source API.

Reading: one partition for each file, streamed in bounded batches.  Files are
found and opened by pyarrow's file systems (local, S3, HDFS, GCS), so any path
that those reach will do.  A fault ends its file with a row that has an error.

Writing: each task writes one file of its rows, in their order; every record is a
gzip member of its own (or the file plain).  Attempts write below a temporary
folder, and only the job's commit moves the files of successful ones into place.

A file is a task here; ``splits`` reads large files by several, and records by their places.
``write_warc`` returns a row for each record with its place and digest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import HEADER, NO_BODY, RAW
from .framing import MarkedMembers, Members, Plain, frame, gzip_member, is_gzip, members

BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def found_files(path: str) -> list[tuple[str, str]]:
    """(file, path that it was found by) of a path, or of several with commas between: itself, or those below a folder or under a trailing ``*``, in order of name."""
    from pyarrow import fs

    out: list[tuple[str, str]] = []
    for one in path.split(","):
        system, inner = _filesystem(one)
        prefix = inner[:-1] if inner.endswith("*") else None
        base = prefix.rsplit("/", 1)[0] if prefix is not None else inner
        info = system.get_file_info(base)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
            hidden = lambda f: any(part.startswith(("_", ".")) for part in f[len(base.rstrip("/")) :].split("/"))
            out += [(f, one) for f in sorted(f for f in found if not hidden(f) and (prefix is None or f.startswith(prefix)))]
        elif info.type == fs.FileType.File:
            out.append((inner, one))
        else:
            raise FileNotFoundError(one)
    return out


def list_files(path: str) -> list[str]:
    return [f for f, _ in found_files(path)]


def open_file(name: str, found_by: str):
    """A file, to be read from any place, in the file system of the path that it was found by."""
    return _filesystem(found_by)[0].open_input_file(name)


_KEYS = {"record_type": b"warc-type", "record_id": b"warc-record-id", "target_uri": b"warc-target-uri"}


def key_values(fields: list[tuple[str, bytes]] | None) -> dict[str, str | None]:
    """A header's type in lower case, id and target URI, both without brackets; null where there is none or it isn't UTF-8."""
    out: dict[str, str | None] = dict.fromkeys(_KEYS)
    for column, name in _KEYS.items():
        for n, value in fields or ():
            if n.lower().encode() == name:
                text = b" ".join(value.split(b"\r\n")).strip(b" \t\r\n")
                try:
                    text = text.decode()
                except UnicodeDecodeError:
                    break
                out[column] = text.lower() if column == "record_type" else text[1:-1] if text[:1] == "<" and text[-1:] == ">" else text
                break
    return out


KEYED = T.StructType([*[T.StructField(c, T.StringType()) for c in _KEYS]])
#: How many gzip members begin behind the last record's start and up to this one's, and whether one does just there; null in plain files.
MEMBERS = T.StructType([T.StructField("members_begun", T.LongType()), T.StructField("starts_member", T.BooleanType())])
#: What filters that are pushed into the reader, or given to it, may ask of a key.
TESTS = {
    "=": lambda value, x: value == x,
    "in": lambda value, x: value in x,
    "starts": lambda value, x: value.startswith(x),
    "ends": lambda value, x: value.endswith(x),
    "contains": lambda value, x: x in value,
    "is not null": lambda value, x: True,
}


@dataclass(frozen=True)
class Wanted:
    """A test of a key (record_type, record_id or target_uri): what it must be; ``negated``: must not.  A null key fails both."""

    key: str
    test: str
    value: str | tuple[str, ...] | None = None
    negated: bool = False

    def of(self, keys: dict[str, str | None]) -> bool:
        value = keys[self.key]
        return value is not None and TESTS[self.test](value, self.value) != self.negated

    def column(self):
        """The same as a column's condition."""
        c = F.col(self.key)
        made = {"=": lambda: c == self.value, "in": lambda: c.isin(*self.value), "starts": lambda: c.startswith(self.value), "ends": lambda: c.endswith(self.value),
                "contains": lambda: c.contains(self.value), "is not null": lambda: c.isNotNull()}[self.test]()
        return F.coalesce(~made if self.negated else made, F.lit(False))


def batches_of(records, path: str, bodies: bool, keys: bool = False, first: int = 0, base: int = 0, members: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (place, framed record, and perhaps its members); ``first`` and ``base`` are added to places and offsets."""
    from ..arrow import arrow_schema

    schema = arrow_schema(T.StructType([*(RAW if bodies else NO_BODY), *(KEYED if keys else ()), *(MEMBERS if members else ())]))
    rows: list = []
    places: list[int] = []
    begun: list = []
    size = 0

    def done():
        n = len(rows)
        fields = [f for r in rows for f in r.headers or ()]
        edges = [0]
        for r in rows:
            edges.append(edges[-1] + len(r.headers or ()))
        pairs = pa.StructArray.from_arrays([pa.array([f[0] for f in fields], pa.string()), pa.array([f[1] for f in fields], pa.binary())], fields=list(schema.field("headers").type.value_type))
        error = [None if r.fault is None else {"level": r.fault[0], "code": r.fault[1], "field": None, "message": r.fault[2]} for r in rows]
        made = {
            "file": pa.array([path] * n, pa.string()), "record_index": pa.array(places, pa.int64()), "offset": pa.array([base + r.offset for r in rows], pa.int64()),
            "length": pa.array([r.length for r in rows], pa.int64()), "version": pa.array([r.version for r in rows], pa.string()),
            "headers": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs, mask=pa.array([r.headers is None for r in rows])),
            "content_length": pa.array([r.content_length for r in rows], schema.field("content_length").type), "error": pa.array(error, schema.field("error").type),
        }
        if bodies:
            made["body"] = pa.array([r.body for r in rows], pa.binary())
        if keys:
            each = [key_values(r.headers) for r in rows]
            made |= {c: pa.array([k[c] for k in each], pa.string()) for c in _KEYS}
        if members:
            made |= {"members_begun": pa.array([m and m[0] for m in begun], pa.int64()), "starts_member": pa.array([m and m[1] for m in begun], pa.bool_())}
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)

    for i, r, *more in records:
        rows.append(r)
        begun.append(more[0] if more else None)
        places.append(first + i)
        size += 200 + len(r.body or b"")
        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield done()
            rows, places, begun, size = [], [], [], 0
    if rows:
        yield done()


@dataclass
class FilePartition(InputPartition):
    path: str
    found_by: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.bodies = _yes(options, "bodies", True)
        self.keys, self.members = _yes(options, "keys", False), _yes(options, "members", False)
        self.compression = options.get("compression", "auto")
        self.wanted = [Wanted(k, t, tuple(v) if isinstance(v, list) else v, n) for k, t, v, n in json.loads(options.get("wanted", "[]"))]
        self.refused = options.get("refused", "drop")
        self.pushed: list[Wanted] = []

    def partitions(self):
        return [FilePartition(*f) for f in found_files(self.path)]

    def read(self, partition: FilePartition):
        packed = is_gzip(partition.path) if self.compression == "auto" else self.compression == "gzip"
        with open_file(partition.path, partition.found_by) as raw:
            stream = (MarkedMembers(raw, 0) if self.members else Members(raw)) if packed else Plain(raw)
            records = self.chosen(frame(stream, self.bodies, self.accepts()))
            if self.members:
                records = with_members(records, getattr(stream, "begun", None))
            yield from batches_of(records, partition.path, self.bodies, self.keys, members=self.members)

    def accepts(self):
        every = [*self.wanted, *self.pushed]
        if not every:
            return None

        def accept(version, fields):
            keys = key_values(fields)
            return all(w.of(keys) for w in every)

        return accept

    def chosen(self, records):
        """Records with their places; those that are refused keep theirs, but don't come (or come without their blocks)."""
        for i, r in enumerate(records):
            if r.fault is not None and self.pushed:  # a pushed filter holds for faults, too
                keys = key_values(r.headers)
                if not all(w.of(keys) for w in self.pushed):
                    continue
            if not r.refused or self.refused == "header" and not self.pushed:
                yield i, r


def with_members(records, begun: list[int] | None):
    """(place, record, (members begun behind the last record's start, whether one begins here)); begun: plain bytes at which members begin, in order."""
    for i, r in records:
        if begun is None:
            yield i, r, None
        else:
            passed = [m for m in begun if m <= r.offset]
            yield i, r, (len(passed), r.offset in passed)
            del begun[: len(passed)]


class FilteringReader(WarcReader):
    """The reader that takes filters on its keys from the plan; only for sessions with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):
        for f in filters:
            w = pushed(f)
            if w is None:
                yield f
            else:
                self.pushed.append(w)


def pushed(f, negated: bool = False) -> Wanted | None:
    """A filter of the plan as a test of a key; None if it isn't one."""
    from pyspark.sql import datasource as ds

    if isinstance(f, ds.Not):
        return None if negated else pushed(f.child, True)
    names = {ds.EqualTo: "=", ds.In: "in", ds.StringStartsWith: "starts", ds.StringEndsWith: "ends", ds.StringContains: "contains", ds.IsNotNull: "is not null"}
    if type(f) not in names or len(f.attribute) != 1 or f.attribute[0] not in _KEYS or negated and isinstance(f, ds.IsNotNull):
        return None
    value = getattr(f, "value", None)
    if isinstance(f, ds.In) and (negated or not all(isinstance(x, str) for x in value)):
        return None  # a null in the list makes the rest unknown
    return Wanted(f.attribute[0], names[type(f)], tuple(value) if isinstance(value, (list, tuple)) else value, negated)


def _yes(options, name: str, default: bool) -> bool:
    return str(options.get(name, str(default))).lower() == "true"


class WarcSource(DataSource):
    """format("warc"): options path, bodies (true or false), compression (auto, gzip or none), keys, push, wanted, refused (see read_warc)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return T.StructType([*(RAW if _yes(self.options, "bodies", True) else NO_BODY), *(KEYED if _yes(self.options, "keys", False) else ()),
                             *(MEMBERS if _yes(self.options, "members", False) else ())])

    def reader(self, schema):
        return (FilteringReader if _yes(self.options, "push", False) else WarcReader)(self.options)

    def streamReader(self, schema):
        from .stream import WarcStreamReader

        return WarcStreamReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, bodies: bool = True, compression: str = "auto", push: bool = False,
              wanted: list[Wanted] | None = None, refused: str = "drop", members: bool = False) -> DataFrame:
    """Records of the files of a path, with their framing faults.

    ``bodies=False`` neither buffers nor ships blocks (the API passes no column
    pruning on), but checks their framing.

    ``push`` adds the keys record_type, record_id and target_uri as columns, and filters on
    them (equality, lists, starts, ends, parts, and their negations) go into the reader:
    blocks of records that these refuse are passed over, with their ends checked.  Rows come
    out as the filter's own rules say, so faults without these keys don't.  This turns on
    spark.sql.python.filterPushdown.enabled for the session.

    ``wanted`` gives such tests to the reader directly.  Faults always stay then, and a
    framing fault ends its file, whatever is asked for.  Records that are refused are dropped, or with
    ``refused="header"`` come without their blocks, so that rules on headers can still be
    checked for all (``grammar.filter_untyped``, ``semantic.filter_records``).

    ``members`` adds what gzip members begin at each record (``MEMBERS``).
    """
    register(spark)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    asked = json.dumps([(w.key, w.test, w.value, w.negated) for w in wanted or []])
    return spark.read.format("warc").options(bodies=str(bodies).lower(), compression=compression, push=str(push).lower(), keys=str(push or bool(wanted)).lower(),
                                             members=str(members).lower(), wanted=asked, refused=refused).load(path)


def to_bytes(df: DataFrame, name: str = "warc_bytes") -> DataFrame:
    """df with the record's bytes as they stand in a file: version line, fields, empty line, block, two line ends."""
    line = lambda h: F.concat(h["name"].cast("binary"), F.lit(b":"), h["value"], F.lit(b"\r\n"))
    fields = F.aggregate("headers", F.lit(b""), lambda a, h: F.concat(a, line(h)))
    return df.withColumn(name, F.concat(
        F.concat(F.lit("WARC/"), F.col("version")).cast("binary"), F.lit(b"\r\n"), fields, F.lit(b"\r\n"),
        F.coalesce(F.col("body"), F.lit(b"")), F.lit(b"\r\n\r\n")))


def invalid_reason(headers="headers", body="body"):
    """Why a record can't be written: a message, or null."""
    h, b = F.col(headers), F.col(body)
    from ..functions.values import TOKEN, latin

    bad_name = F.filter(h, lambda x: ~x["name"].rlike(rf"\A{TOKEN}++\z"))
    bad_value = F.filter(h, lambda x: latin(x["value"]).rlike(r"\r(?!\n[ \t])"))
    lengths = F.filter(h, lambda x: F.lower(x["name"]) == "content-length")
    declared = F.trim(latin(F.try_element_at(lengths, F.lit(1))["value"])).try_cast("decimal(20,0)")
    size = F.length(F.coalesce(b, F.lit(b"")))
    return (
        F.when(h.isNull(), "The record has no header.")
        .when(F.size(bad_name) > 0, F.concat(F.lit("Malformed field line: "), F.try_element_at(bad_name, F.lit(1))["name"]))
        .when(F.size(bad_value) > 0, F.concat(F.lit("Malformed field line: "), F.try_element_at(bad_value, F.lit(1))["name"]))
        .when(F.size(lengths) == 0, "Missing Content-Length.")
        .when(F.size(lengths) > 1, "Repeated Content-Length.")
        .when(declared.isNull(), "Malformed Content-Length.")
        .when(declared != size, F.concat(F.lit("Content-Length declares "), declared.cast("string"), F.lit(" bytes, but the body is "),
                                         size.cast("string"), F.lit(".")))
    )


WRITTEN = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("record_index", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("stored_digest", T.StringType()), T.StructField("error", T.StringType()),
])
_WRITTEN = [("file", pa.string()), ("record_index", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("stored_digest", pa.string()), ("error", pa.string())]


@dataclass
class Part(WriterCommitMessage):
    attempt: str
    name: str


class WarcWriter(DataSourceArrowWriter):
    """Rows (bytes of a record or null, why it has none) to a file a task, and a table of what it holds."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.packed, self.level = options.get("compression", "gzip") == "gzip", int(options.get("level", 6))
        self.stream, self.job = options.get("stream", "false") == "true", options["job"]
        system, inner = _filesystem(self.path)
        system.create_dir(f"{inner}/_temporary-{self.job}", recursive=True)
        # files of later jobs stand behind those that are there
        self.turn = 0 if overwrite else 1 + max((int(n[5:10]) for n in self._parts(system, inner) if n[5:10].isdigit()), default=-1)

    @staticmethod
    def _parts(system, inner: str) -> list[str]:
        from pyarrow import fs

        return [f.base_name for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.base_name.startswith("part-")]

    def write(self, iterator):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        system, inner = _filesystem(self.path)
        name = f"part-{self.turn:05d}-{task.partitionId():06d}.warc" + (".gz" if self.packed else "")
        attempt = f"{inner}/_temporary-{self.job}/{task.taskAttemptId()}"
        squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31) if self.stream and self.packed else None
        offset, index, schema = 0, 0, pa.schema(_WRITTEN)
        with system.open_output_stream(f"{attempt}.data", compression=None) as out, pq.ParquetWriter(f"{attempt}.rows", schema, filesystem=system) as table:
            for batch in iterator:
                rows = []
                for data, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if data is None:
                        rows.append((f"{inner}/{name}", index, None, None, None, error))
                    else:
                        stored = data if not self.packed else squeeze.compress(data) if squeeze else gzip_member(data, self.level)
                        out.write(stored)
                        rows.append((f"{inner}/{name}", index, offset, len(stored), "sha256:" + hashlib.sha256(stored).hexdigest(), None))
                        offset += len(stored)
                    index += 1
                if rows:
                    table.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _WRITTEN)], schema=schema))
            if squeeze:
                out.write(squeeze.flush())
        return Part(attempt, name)

    def commit(self, messages):
        system, inner = _filesystem(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for name in set(self._parts(system, inner)) - {m.name for m in done}:
                system.delete_file(f"{inner}/{name}")
        system.create_dir(f"{inner}/_written-{self.job}", recursive=True)
        for m in done:
            system.move(f"{m.attempt}.data", f"{inner}/{m.name}")
            system.move(f"{m.attempt}.rows", f"{inner}/_written-{self.job}/{m.name}.parquet")
        system.delete_dir(f"{inner}/_temporary-{self.job}")

    def abort(self, messages):
        system, inner = _filesystem(self.path)
        system.delete_dir(f"{inner}/_temporary-{self.job}")


def write_warc(df: DataFrame, path: str, compression: str = "gzip", level: int = 6, stream: bool = False, append: bool = False) -> DataFrame:
    """Writes (version, headers, body) rows below a folder and returns a row for each record, read from a table written beside them.

    Invalid records aren't written and have an error.  Files that were there are
    replaced, or stay before the new ones with ``append``.  Nothing shows before all
    tasks have succeeded, so lost executors and second attempts do no harm; the driver then
    moves the files one at a time, and if it dies meanwhile, old and new ones may be mixed.
    Order rows before for an order in files.  ``stream``: one gzip member for the whole file
    instead of one a record.
    """
    if not 0 <= level <= 9:
        raise ValueError(f"gzip level {level} is not between 0 and 9")
    spark, job = df.sparkSession, uuid.uuid4().hex[:12]
    register(spark)
    given = to_bytes(df).select(F.when(invalid_reason().isNull(), F.col("warc_bytes")).alias("b"), invalid_reason().alias("e"))
    path = path.rstrip("/")
    given.write.format("warc").mode("append" if append else "overwrite").options(
        compression=compression, level=str(level), stream=str(stream).lower(), job=job).save(path)
    return spark.read.schema(WRITTEN).parquet(f"{path}/_written-{job}/*.parquet")


def write_one(df: DataFrame, path: str, compression: str = "gzip", level: int = 6) -> DataFrame:
    """``write_warc`` to one file: tasks write parts beside each other, and one then copies them behind each other, a piece at a time.

    Records are packed and checked by the first tasks, in the order of df's partitions and rows.
    """
    spark, path, job = df.sparkSession, path.rstrip("/"), uuid.uuid4().hex[:12]
    system, inner = _filesystem(path)
    written = write_warc(df, f"{path}/_parts-{job}", compression, level)
    parts = [f for f, _ in found_files(f"{path}/_parts-{job}")]
    rows = dict(written.groupBy("file").count().collect())
    name = f"{inner}/part-00000-000000.warc" + (".gz" if compression == "gzip" else "")

    def copy(batches):
        from pyspark import TaskContext

        system = _filesystem(path)[0]
        for batch in batches:
            for names in batch.column(0).to_pylist():
                made, sizes = f"{inner}/_parts-{job}/_one-{TaskContext.get().taskAttemptId()}", []
                with system.open_output_stream(made, compression=None) as out:
                    for part in names:
                        sizes.append(0)
                        with system.open_input_stream(part, compression=None) as data:
                            while piece := data.read(8 << 20):
                                out.write(piece)
                                sizes[-1] += len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([sizes], pa.list_(pa.int64()))], names=["made", "sizes"])

    made, sizes = spark.createDataFrame([(parts,)], "parts array<string>").coalesce(1).mapInArrow(copy, "made string, sizes array<long>").first()
    for old in WarcWriter._parts(system, inner):
        system.delete_file(f"{inner}/{old}")
    system.move(made, name)
    for part in parts:
        system.delete_file(part)
    before, n, size = [], 0, 0
    for part, own in zip(parts, sizes):
        before.append((part, n, size))
        n, size = n + rows.get(part, 0), size + own
    starts = spark.createDataFrame(before, "file string, _n long, _size long")
    return written.join(F.broadcast(starts), "file").select(
        F.lit(name).alias("file"), (F.col("record_index") + F.col("_n")).alias("record_index"), (F.col("offset") + F.col("_size")).alias("offset"), "length", "stored_digest", "error")


def gzip_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, member_index, n_records) of record-compressed files: each member must hold exactly one record."""
    files = found_files(path)
    names = spark.createDataFrame(files, "file string, found_by string").repartition(max(1, len(files)), "file")

    def run(batches):
        for batch in batches:
            for name, found_by in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with open_file(name, found_by) as raw:
                    for i, one in enumerate(members(raw)):
                        n = sum(1 for r in frame(one, False) if r.fault is None)
                        while one.read(1 << 20):  # what a fault left unread
                            pass
                        rows.append((name, i, n))
                        if len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "member_index", "n_records"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "member_index", "n_records"])

    return names.mapInArrow(run, "file string, member_index long, n_records long")


__all__ = ["HEADER", "RAW", "gzip_members", "list_files", "read_warc", "register", "to_bytes", "write_one", "write_warc"]
