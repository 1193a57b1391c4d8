import gzip
import os
import random

from pyspark.sql import functions as F
from test_splits import record

from websilo import commands
from websilo.operators.verify import verify
from websilo.sources.framing import gzip_member
from websilo.sources.warc import read_warc


def info(ident, date, more=b""):
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\nsoftware: a/1\r\n%s\r\n\r\n" % (ident, date, 15 + len(more), more)


def joined(folder):
    data = b"".join(open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.startswith("part-"))
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def archives(folder):
    r = random.Random(1)
    folder.mkdir()
    a = info(b"a", b"2021-01-01") + b"".join(record("response", i, r.randbytes(50), "warc-warcinfo-id: <urn:x:a>") for i in range(9))
    b = info(b"b", b"2020-01-01") + b"".join(record("resource", f"r{i}", b"x" * i, "WARC-Warcinfo-ID: <urn:x:b>") for i in range(5)) + info(b"c", b"2020-01-01", b"robots: x\r\n")
    (folder / "a.warc").write_bytes(a)
    (folder / "b.warc").write_bytes(b)
    return a, b, str(folder / "a.warc"), str(folder / "b.warc")


def test_merged_parts_in_order(spark, tmp_path):
    a, b, first, second = archives(tmp_path / "in")
    kept = info(b"b", b"2020-01-01")
    want = kept + a[len(info(b"a", b"2021-01-01")) :].replace(b"warc-warcinfo-id: <urn:x:a>", b"warc-warcinfo-id: <urn:x:b>") + b[len(kept) :]
    for parts in (1, 8):
        for end in (".warc", ".warc.gz"):
            out = f"{tmp_path}/merged{parts}{end}"
            assert "1 equal warcinfo" in commands.merge(spark, first, second, out, parts)
            assert joined(out) == want
            assert len([n for n in os.listdir(out) if n.startswith("part-")]) >= min(parts, 2) - (parts == 1)
            assert all(n.endswith(".gz") == end.endswith(".gz") for n in os.listdir(out) if n.startswith("part-"))


def test_commands_and_their_codes(spark, tmp_path):
    a, b, first, second = archives(tmp_path / "in")
    said: list[str] = []
    go = lambda *args: commands.run(spark, [str(x) for x in args], said.append)
    out = lambda n: f"{tmp_path}/{n}"
    assert go("compress", first, "-o", out("c"), "-l", 9) == 0 and joined(out("c")) == a
    assert go("canonicalize", first, "-o", out("d")) == 0
    assert joined(out("d")).count(b"WARC-Warcinfo-ID") == 9 and len(joined(out("d"))) == len(a)
    assert go("canonicalize", first, "-o", first) == 1 and go("merge", first, second, "-o", second) == 1
    assert open(first, "rb").read() == a
    assert go("rewrite", second, "warcinfo", "-o", out("e"), "--software-name", "new", "--filename", "x.warc") == 0
    got = joined(out("e"))
    assert got.count(b"software: new/1\r\n") == 2 and got.count(b"WARC-Filename: x.warc") == 2 and got.count(b"xxxx\r\n\r\n") == 1
    assert go("rewrite", second, "warcinfo", "-o", out("f")) == 1 and not os.path.exists(out("f"))
    assert go("rewrite", second, "warcinfo", "-o", out("f"), "--operator-email", "a@b") == 1
    assert go("export", second, "csv", "-o", out("csv")) == 0
    lines = b"".join(open(f"{out('csv')}/{n}", "rb").read() for n in sorted(os.listdir(out("csv"))) if n.endswith(".csv")).decode().splitlines()
    assert [x for x in lines if not x.startswith("type,")][:2] == ["warcinfo,2020-01-01,x:b,", "resource,2024-01-01T00:00:00Z,x:r0,http://example.org/resource/r0"]
    assert go("export", second, "json", "-o", out("json")) == 0 and go("graph", second, "-o", out("graph")) == 0
    drawn = "".join(open(f"{out('graph')}/{n}").read() for n in sorted(os.listdir(out("graph"))) if n.endswith(".txt")).splitlines()
    assert len(drawn) == 7 + 5 and 'records.record_1 -> records.record_0: "warcinfo-id"' in drawn
    said.clear()
    assert go("lint", second) == 1 and said[-1].startswith(f"{len(said) - 1} problems") and any(x.startswith("record 1 (urn:x:r0): ") for x in said)
    broken = tmp_path / "broken.warc"
    broken.write_bytes(b[:-3])
    for command in (("compress",), ("canonicalize",)):
        assert go(*command, broken, "-o", out("never")) == 1 and not os.path.exists(out("never"))
    assert go("export", broken, "csv", "-o", out("csv2")) == 1
    assert go("validate", first) == 0 and go("validate", broken) == 1
    assert go("nothing") == 1 and go("compress", f"{tmp_path}/absent.warc", "-o", out("g")) == 1 and go("compress", first, "-o", out("h"), "-l", 11) == 1


def test_verification(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = [info(b"i", b"2024-01-01"), record("response", 1, b"x", "WARC-Warcinfo-ID: <urn:x:i>")]
    whole = record("resource", "s1", b"ab", "WARC-Segment-Number: 1")
    rest = record("continuation", "s2", b"cd", "WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:x:s1>", "WARC-Segment-Total-Length: 4")
    (folder / "a.warc.gz").write_bytes(b"".join(map(gzip_member, [*good, whole])))
    (folder / "b.warc.gz").write_bytes(gzip_member(rest) + gzip_member(record("resource", "z", b"", "WARC-Concurrent-To: <urn:x:1>")))
    assert verify(spark, str(folder)).count() == 0
    (folder / "c.warc.gz").write_bytes(gzip_member(record("resource", "d1", b"") + record("resource", "d2", b"")) + gzip_member(b"") + gzip_member(record("resource", 1, b"", "WARC-Refers-To: <urn:x:none>")))
    (folder / "d.warc").write_bytes(record("resource", "e1", b"", "WARC-Block-Digest: md5:" + "0" * 32, "WARC-Segment-Number: 1")
                                    + record("continuation", "e2", b"abc", "WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:x:e1>", "WARC-Segment-Total-Length: 4")
                                    + record("resource", "g1", b"", "WARC-Segment-Number: 1") + record("continuation", "g3", b"", "WARC-Segment-Number: 3", "WARC-Segment-Origin-ID: <urn:x:g1>", "WARC-Segment-Total-Length: 0")
                                    + record("resource", "h", b"").replace(b"WARC-Record-ID: <urn:x:h>\r\n", b"") + record("resource", "k", b"")[:-1])
    got = sorted((os.path.basename(r["file"])[0], r["record_index"], r["check"]) for r in verify(spark, str(folder)).collect())
    assert got == sorted([("c", 1, "compression"), ("c", 2, "compression"), ("c", 2, "id"), ("d", 0, "digest"), ("d", 1, "segment"), ("d", 3, "segment"), ("d", 4, "structure"), ("d", 4, "id"),
                          ("d", 5, "structure"), ("c", 2, "reference"), ("c", 2, "structure")])


def test_members_of_the_reader(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip_member(b"") + gzip_member(record("resource", 1, b"") + record("resource", 2, b"")) + gzip_member(record("resource", 3, b"")))
    got = read_warc(spark, str(tmp_path / "a.warc.gz"), members=True).orderBy("record_index").select("members_begun", "starts_member").collect()
    assert [tuple(r) for r in got] == [(2, True), (0, False), (1, True)]
    (tmp_path / "b.warc").write_bytes(record("resource", 1, b""))
    assert read_warc(spark, str(tmp_path / "b.warc"), members=True).select(F.col("members_begun").isNull() & F.col("starts_member").isNull()).first()[0]
