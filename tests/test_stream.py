import os
import random

from pyspark.sql import functions as F
from test_splits import record

from websilo.sources.framing import gzip_member
from websilo.sources.warc import read_warc
from websilo.streaming.ingest import first_captures, stream_warc


def run(spark, path, home):
    """One batch of what is there; the stream is stopped then."""
    q = stream_warc(spark, path).writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").trigger(once=True).start()
    try:
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        q.stop()
    return sorted((os.path.basename(r["file"]), r["record_index"], r["error"] and r["error"]["code"]) for r in spark.read.parquet(f"{home}/out").collect())


def test_growing_files_across_restarts(spark, tmp_path):
    folder, home = tmp_path / "in", str(tmp_path / "home")
    folder.mkdir()
    r = random.Random(1)
    parts = [record("response", i, r.randbytes(2000)) for i in range(12)]
    plain, packed = b"".join(parts), b"".join(map(gzip_member, parts))
    edges = [len(gzip_member(p)) for p in parts]
    put = lambda name, data: (folder / name).write_bytes(data)
    put("a.warc.open", plain[: len(parts[0]) + 10])
    put("b.warc.gz.open", packed[: sum(edges[:2]) + 5])
    put("c.warc", b"".join(parts[:3]))
    want = {("a.warc", 0, None), ("b.warc.gz", 0, None), ("b.warc.gz", 1, None), ("c.warc", 0, None), ("c.warc", 1, None), ("c.warc", 2, None)}
    assert run(spark, str(folder), home) == sorted(want)
    assert run(spark, str(folder), home) == sorted(want)  # nothing new
    put("a.warc.open", plain[: sum(map(len, parts[:5])) - 2])
    put("b.warc.gz.open", packed[: sum(edges[:7])])
    put("d.warc.open", parts[0] + parts[1][:-2] + b"xx" + parts[2])  # a fault that is certain
    want |= {("a.warc", i, None) for i in (1, 2, 3)} | {("b.warc.gz", i, None) for i in range(2, 7)} | {("d.warc", 0, None), ("d.warc", 1, "MalformedRecordTerminator")}
    assert run(spark, str(folder), home) == sorted(want)
    os.rename(folder / "a.warc.open", folder / "a.warc")  # complete, but cut off
    put("b.warc.gz.open", packed)
    os.rename(folder / "b.warc.gz.open", folder / "b.warc.gz")
    put("d.warc.open", parts[0] + parts[1][:-2] + b"xx" + parts[2] * 3)
    want |= {("a.warc", 4, "UnexpectedEndOfBody")} | {("b.warc.gz", i, None) for i in range(7, 12)}
    assert run(spark, str(folder), home) == sorted(want)
    bodies = {r["record_index"]: bytes(r["body"]) for r in spark.read.parquet(f"{home}/out").where("file LIKE '%/b.warc.gz'").collect()}
    assert bodies == {r["record_index"]: bytes(r["body"]) for r in read_warc(spark, str(folder / "b.warc.gz")).collect()}


def test_first_captures(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    digest = lambda d: f"WARC-Payload-Digest: {d}"
    same = ["sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N", "sha-1:aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d", "md5:0"]
    (folder / "a.warc").write_bytes(b"".join(record("response", i, b"", digest(d)) for i, d in enumerate(same * 2)))
    q = first_captures(stream_warc(spark, str(folder))).writeStream.format("memory").queryName("firsts").start()
    try:
        q.processAllAvailable()
        assert spark.table("firsts").count() == 2
    finally:
        q.stop()
