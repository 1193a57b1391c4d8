import io
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from websilo.functions import chunks, http, sniff
from websilo.functions.http import PayloadError, entity_bytes

HEAD = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
MESSAGES = [
    HEAD + b"5;x=y\r\nhello\r\n1\r\n \r\n0\r\nT: 1\r\n\r\nrest", HEAD + b"A\n0123456789\n0\n\n", HEAD + b"5\r\nhello", HEAD + b"5\r\nhelloX\r\n", HEAD + b"5\r\nhello\rX", HEAD + b"zz\r\n", HEAD + b"\r\n", HEAD,
    b"HTTP/1.1 200 OK\r\n\r\nplain\r\n\r\nbody", b"HTTP/1.1 200 OK\nTransfer-Encoding: identity,\n chunked\n\n2\nab\n0\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip\r\n\r\nx", b"no head", b"", HEAD + b"0\r\n",
]


def whole(message):
    try:
        return entity_bytes(message), None
    except PayloadError as e:
        return None, str(e)


def in_pieces(message, cuts):
    scan, out = chunks.MessageScanner(), []
    edges = [0, *sorted(c % (len(message) + 1) for c in cuts), len(message)]
    try:
        for a, b in zip(edges, edges[1:]):
            out += scan.feed(message[a:b])
        scan.close()
    except PayloadError as e:
        return None, str(e)
    return b"".join(out), None


@pytest.mark.parametrize("message", MESSAGES)
def test_every_cut(message):
    for i in range(len(message) + 1):
        for j in range(i, len(message) + 1, 3):
            assert in_pieces(message, [i, j]) == whole(message)
    assert in_pieces(message, range(len(message))) == whole(message)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"1", b"\r", b"\n", b"\r\n", b"a", b";", b"0", b"5\r\nhello\r\n", b"0\r\n\r\n"]), max_size=12), st.lists(st.integers(0, 200), max_size=6))
def test_any_chunks(parts, cuts):
    message = HEAD + b"".join(parts)
    assert in_pieces(message, cuts) == whole(message)


def test_series_of_segments(spark):
    message = HEAD + b"5\r\nhello\r\n0\r\n\r\n"
    rows = [("a", 1, None, message[:50]), ("a2", 2, "a", message[50:60]), ("a3", 3, "a", message[60:]), ("b", 1, None, message[:50]), ("b3", 3, "b", message[50:]), ("c", 1, None, message[:-9]),
            ("d", 1, None, message), ("d2", 2, "d", b""), ("d2", 2, "d", b""), ("e2", 2, "e", b"x"), ("f", 1, None, None)]
    df = spark.createDataFrame([(i, "response" if o is None else "continuation", n, o, b and bytearray(b)) for i, n, o, b in rows],
                               "record_id string, record_type string, segment_number long, segment_origin_id string, body binary").withColumn("error", F.lit(None).cast("string"))
    got = {r["record_id"]: tuple(r)[1:] for r in chunks.segment_payloads(df.repartition(3)).collect()}
    assert got["a"] == (3, len(message), 5, "sha256:2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", None)
    assert got["b"][-1] == "Segment 2 is missing." and got["d"][-1] == "Segment 2 stands there twice." and got["e"][-1] == "Segment 1 is missing."
    assert got["c"][-1].startswith("No last chunk") and got["f"][-1].startswith("No empty line")
    assert chunks.segment_payloads(df.limit(0)).count() == 0


def zipped(*names, first=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if first:
            z.writestr("mimetype", first)
        for n in names:
            z.writestr(n, "x" * 50)
    return out.getvalue()


def ftyp(*brands):
    return struct.pack(">I", 12 + 4 * len(brands)) + b"ftyp" + brands[0] + b"\0\0\0\0" + b"".join(brands[1:]) + b"\0" * 8


OFFICE = "application/vnd.openxmlformats-officedocument."
ACCEPTED = [
    (zipped("a.txt"), "application/zip"), (zipped("[Content_Types].xml", "word/document.xml"), OFFICE + "wordprocessingml.document"), (zipped("[Content_Types].xml", "xl/workbook.xml"), OFFICE + "spreadsheetml.sheet"),
    (zipped("_rels/.rels", "ppt/slides/1.xml"), OFFICE + "presentationml.presentation"), (zipped("a", first="application/epub+zip"), "application/epub+zip"),
    (zipped("content.xml", first="application/vnd.oasis.opendocument.text"), "application/vnd.oasis.opendocument.text"), (zipped("META-INF/MANIFEST.MF"), "application/java-archive"),
    (zipped("META-INF/MANIFEST.MF", "AndroidManifest.xml"), "application/vnd.android.package-archive"), (zipped("words/a"), "application/zip"),
    (b"RIFF\0\0\0\0WEBPVP8 ", "image/webp"), (b"RIFF\0\0\0\0WAVEfmt ", "audio/wav"), (b"RIFF\0\0\0\0AVI LIST", "video/x-msvideo"), (b"RIFF\0\0\0\0odd ", "application/x-riff"),
    (ftyp(b"avif", b"mif1"), "image/avif"), (ftyp(b"mif1", b"heic"), "image/heic"), (ftyp(b"mif1"), "image/heif"), (ftyp(b"isom", b"avc1"), "video/mp4"), (ftyp(b"qt  "), "video/quicktime"),
    (ftyp(b"M4A "), "audio/mp4"), (ftyp(b"3gp5"), "video/3gpp"), (b"a" * 257 + b"ustar\x0000", "application/x-tar"), (b"a" * 257 + b"ustar  \0", "application/x-tar"),
    (b"\x1aE\xdf\xa3\x9fB\x86\x81\x01B\x82\x84webm", "video/webm"), (b"\x1aE\xdf\xa3\x9fB\x82\x88matroska", "video/x-matroska"), (b"BM\x01\x02\x03\x04\0\0\0\0", "image/bmp"),
    (b"II*\0\x10\0\0\0CR\x02", "image/x-canon-cr2"), (b"!<arch>\ndebian-binary", "application/vnd.debian.binary-package"), (b"!<arch>\nother", "application/x-archive"),
    (b"\xca\xfe\xba\xbe\0\0\x004", "application/java-vm"), (b"\xff\xfb\x90", "audio/mpeg"), (b"\xff\xf1\x50", "audio/aac"), (b"G" + b"x" * 187 + b"G", "video/mp2t"),
]
REFUSED = [b"", b"\0" * 32, b"\x89PNG", b"BM plain text", b"Gxyz", b"PK", b"a" * 256 + b"ustar\0", b"\xca\xfe\xba\xbe\0\0\0\x02", b"RIFF", b"just text", b"\xff\xd8"]


@pytest.mark.parametrize("data, kind", ACCEPTED)
def test_containers_and_masks(data, kind):
    assert sniff.kind_of(data) == kind


def test_every_signature_is_found():
    kinds = set()
    for place, digits, kind in sniff.SIGNATURES:
        for p in sniff.pattern(digits):
            data = b"\x02" * place + bytes(v for v, _ in p)
            got = sniff.kind_of(data + b"\x03" * 8)
            kinds.add(got)
            assert got == kind, (digits, got)
    assert len(kinds) >= 70
    assert [sniff.kind_of(d) for d in REFUSED] == [None] * len(REFUSED)


def test_types_of_payloads(spark):
    rows = [(b"{}", "application/ld+json"), (b"{} x", "application/json"), (b"{}", None), (b"\x89PNG\r\n\x1a\n", "application/json"), (b"", None), (b"\0" * 32, "application/json"),
            (zipped("word/a", first=None), "text/plain"), (b" <!DOCTYPE html><p>", None), (b"<?xml version='1.0'?>", None), (None, "text/html"), ("é".encode(), None)]
    df = spark.createDataFrame([(i, p and bytearray(p) if p else (bytearray() if p == b"" else None), d) for i, (p, d) in enumerate(rows)], "i int, p binary, d string")
    got = [r[0] for r in df.orderBy("i").select(http.payload_type(F.col("p"), F.col("d"), http.strict_json(F.col("p")))).collect()]
    assert got == ["application/json", "text/plain", "text/plain", "image/png", None, None, OFFICE + "wordprocessingml.document", "text/html", "application/xml", None, "text/plain"]


def test_segments_are_joined(spark):
    from websilo.operators.semantic import segment_bodies

    rows = [("a", None, 1, b"one "), ("a3", "a", 3, b"three"), ("a2", "a", 2, b"two "), ("b", None, 1, None), ("c2", "c", 2, b"x" * (5 << 20)), ("c", None, 1, b""), ("d2", "d", 2, b"tail")]
    df = spark.createDataFrame([(i, "response" if o is None else "continuation", o, n, b and bytearray(b)) for i, o, n, b in rows],
                               "record_id string, record_type string, segment_origin_id string, segment_number long, body binary").withColumn("error", F.lit(None).cast("string"))
    got = {r["record_id"]: (r["segments"], bytes(r["body"])) for r in segment_bodies(df.repartition(3)).collect()}
    assert got == {"a": (3, b"one two three"), "b": (1, b""), "c": (2, b"x" * (5 << 20)), "d": (1, b"tail")}
    assert segment_bodies(df.limit(0)).count() == 0
