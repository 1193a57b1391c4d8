"""Work that must not grow by more than its input: plans that spell expressions out again, tables of one partition, short ranges."""

import base64
import hashlib
import io
import random
from decimal import Decimal

from pyspark.sql import functions as F

from websilo.functions import values as v
from websilo.operators import digests, export, grammar, semantic
from websilo.plans.synth import spread
from websilo.sources import splits
from websilo.sources.framing import gzip_member
from websilo.sources.warc import found_files, read_warc, write_one, write_warc

RAW = "file string, record_index long, version string, headers array<struct<name: string, value: binary>>, content_length decimal(20,0), body binary, error struct<level: string, code: string, field: string, message: string>"


def raw_row(i, more, body):
    lines = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:x:{i}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": "http://example.org/e", **more, "Content-Length": str(len(body))}
    return "x", i, "1.1", [(n, f" {t}".encode()) for n, t in lines.items()], Decimal(len(body)), body, None


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_export_reads_headers_once(spark):
    json = {"WARC-Identified-Payload-Type": "application/ld+json"}
    rows = [raw_row(0, json, b'{"a": 1}\r\n'), raw_row(1, {"WARC-Identified-Payload-Type": "text/plain"}, b"{}"), raw_row(2, json | {"WARC-Date": "never"}, b"{}"),
            raw_row(3, json, b"{"), raw_row(4, {"WARC-Identified-Payload-Type": "application/JSON"}, b"[\n1]"), raw_row(5, {}, b"{}")]
    raw = spark.createDataFrame(rows, RAW).localCheckpoint()
    out = export.json_lines(semantic.to_semantic_header(grammar.to_untyped(raw)))
    assert optimized(out).count("transform(headers") == 1
    got = {r["record_index"]: (r["line"], r["error"]) for r in out.collect()}
    assert got == {0: ('{"a": 1}', None), 3: (None, "record 3 (urn:x:3): the payload is not JSON"), 4: (None, "record 4 (urn:x:4): the payload spans more than one line")}


def test_tables_of_one_row_group_are_spread(spark):
    tasks = spark.sparkContext.defaultParallelism
    one = spread(spark.range(1000).coalesce(1), "id")
    assert one.rdd.getNumPartitions() == tasks and one.agg(F.sum("id")).first()[0] == 499500
    assert one.groupBy(F.spark_partition_id()).count().count() == tasks
    many = spark.range(1000).repartition(tasks + 1)
    assert spread(many, "id") is many


class Counting:
    """A file that knows how many bytes were read."""

    def __init__(self, data):
        self.data, self.n = io.BytesIO(data), 0

    def read(self, n):
        out = self.data.read(n)
        self.n += len(out)
        return out

    def seek(self, at):
        self.data.seek(at)

    def size(self):
        return len(self.data.getbuffer())


def member(i):
    return gzip_member(b"WARC/1.1\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 32\r\n\r\n" % i + random.Random(i).randbytes(32) + b"\r\n\r\n")


def test_short_ranges_read_little():
    data = b"".join(member(i) for i in range(20000))
    low = data.index(member(9000)) - 10
    for at, high in ((0, 16 << 10), (low, low + (16 << 10))):
        file = Counting(data)
        start = splits.seeming_start(file, at, high, True)
        stop, n, _ = splits.follow(file, start, high, True)
        assert start == (at and low + 10) and data[start:stop] == b"".join(member(i) for i in range(9000 if at else 0, (9000 if at else 0) + n))
        assert file.n < 300_000 < len(data)
    from websilo.sources.framing import Members, frame

    assert [r.headers[0][1] for r in frame(Members(io.BytesIO(data)))] == [b" <urn:x:%d>" % i for i in range(20000)]


def test_short_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(member(i) for i in range(400)))
    path = str(tmp_path / "a.warc.gz")
    assert splits.split_index(spark, path, 300).count() > 100
    rows = splits.read_splits(spark, path, 300)
    assert rows.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["record_index", "offset", "length", "headers", "body"]
    assert sorted(rows.select(*key).collect()) == sorted(read_warc(spark, path).select(*key).collect())


def test_one_file_of_parts(spark, tmp_path):
    rows = [raw_row(i, {}, bytes(i)) for i in range(50)]
    rows[30] = (*rows[30][:4], Decimal(7), b"1234567", None)  # its length isn't what its header says
    df = spark.createDataFrame(rows, RAW).repartitionByRange(7, "record_index").sortWithinPartitions("record_index")
    for compression in ("gzip", "none"):
        one, plain = str(tmp_path / f"one-{compression}"), str(tmp_path / f"plain-{compression}")
        written = write_one(df, one, compression)
        again = write_one(df, one, compression)  # replaces the first
        expected = write_warc(df.orderBy("record_index").coalesce(1), plain, compression)
        columns = ["record_index", "offset", "length", "stored_digest", "error"]
        key = lambda t: sorted((tuple(r) for r in t.select(*columns).collect()), key=str)
        assert key(written) == key(again) == key(expected) and len(key(written)) == 50
        (a,), (b,) = found_files(one), found_files(plain)
        assert open(a[0], "rb").read() == open(b[0], "rb").read() and {r["file"] for r in written.select("file").collect()} == {a[0]}


def test_added_digests_hash_a_block_once(spark):
    raw = spark.createDataFrame([raw_row(i, {}, b"x" * i) for i in range(3)], RAW).localCheckpoint()
    out = digests.add_sha1_digests(semantic.to_semantic_header(grammar.to_untyped(raw))).select("record_index", "block_digest")
    assert optimized(out).count("sha1(") == 1
    got = {r["record_index"]: tuple(r["block_digest"]) for r in out.collect()}
    assert got == {i: ("sha1", "sha1", base64.b32encode(hashlib.sha1(b"x" * i).digest()).decode()) for i in range(3)}


def test_base32_reads_its_bytes_once(spark):
    r = random.Random(3)
    rows = [(None,), (b"",), *[(r.randbytes(n),) for n in range(1, 45)], (b"\0" * 20,), (b"\xff" * 20,)]
    df = spark.createDataFrame(rows, "b binary").localCheckpoint().select("b", v.base32(F.col("b")).alias("t"))
    assert optimized(df.select("t")).count("b#") <= 3  # the relation, its use and perhaps an alias
    df = df.localCheckpoint()
    back = df.select("b", "t", v._unbase32(F.col("t")).alias("back"), v._unbase32(F.lower(F.rtrim("t", F.lit("=")))).alias("low"))
    for row in back.collect():
        assert row["t"] == (None if row["b"] is None else base64.b32encode(row["b"]).decode())
        assert row["b"] == row["back"] == row["low"]
