"""Types of payloads by their first bytes: a trie of signatures with masks, and the insides of containers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So much of a payload is looked at.
SEEN = 8192

#: Signatures of payload types as (place, hex digits, type); ``?`` is any half byte, and longer ones outrank shorter ones.
SIGNATURES = (
    (0, "89504E470D0A1A0A", "image/png"), (0, "FFD8FF", "image/jpeg"), (0, "474946383761", "image/gif"), (0, "474946383961", "image/gif"),
    (0, "424D????????00000000", "image/bmp"), (0, "49492A00", "image/tiff"), (0, "4D4D002A", "image/tiff"), (0, "49492B00", "image/tiff"), (0, "4D4D002B", "image/tiff"),
    (0, "49492A00????????4352", "image/x-canon-cr2"), (0, "00000100??00", "image/vnd.microsoft.icon"), (0, "38425053", "image/vnd.adobe.photoshop"),
    (0, "0000000C6A5020200D0A870A", "image/jp2"), (0, "FF4FFF51", "image/x-jp2-codestream"), (0, "FF0A", "image/jxl"), (0, "0000000C4A584C200D0A870A", "image/jxl"),
    (0, "762F3101", "image/x-exr"), (0, "716F6966", "image/x-qoi"), (0, "233F52414449414E4345", "image/vnd.radiance"), (0, "4949BC", "image/vnd.ms-photo"),
    (0, "255044462D", "application/pdf"), (0, "25215053", "application/postscript"), (0, "7B5C727466", "application/rtf"), (0, "D0CF11E0A1B11AE1", "application/x-ole-storage"),
    (0, "1F8B08", "application/gzip"), (0, "425A68", "application/x-bzip2"), (0, "FD377A585A00", "application/x-xz"), (0, "28B52FFD", "application/zstd"),
    (0, "04224D18", "application/x-lz4"), (0, "1F9D", "application/x-compress"), (0, "4C5A4950", "application/x-lzip"), (0, "377ABCAF271C", "application/x-7z-compressed"),
    (0, "526172211A0700", "application/vnd.rar"), (0, "526172211A070100", "application/vnd.rar"), (0, "4D534346", "application/vnd.ms-cab-compressed"),
    (0, "213C617263683E0A", "application/x-archive"), (0, "213C617263683E0A64656269616E", "application/vnd.debian.binary-package"), (0, "EDABEEDB", "application/x-rpm"),
    (0, "78617221", "application/x-xar"), (257, "757374617200", "application/x-tar"), (257, "7573746172202000", "application/x-tar"), (0, "303730373031", "application/x-cpio"),
    (0, "504B0506", "application/zip"), (0, "504B0708", "application/zip"), (0, "57415243 2F", "application/warc"),
    (0, "0061736D", "application/wasm"), (0, "7F454C46", "application/x-executable"), (0, "4D5A", "application/vnd.microsoft.portable-executable"),
    (0, "CFFAEDFE", "application/x-mach-binary"), (0, "CEFAEDFE", "application/x-mach-binary"), (0, "CAFEBABE0000003?", "application/java-vm"), (0, "6465780A3033??00", "application/vnd.android.dex"),
    (0, "4344303031", "application/x-iso9660-image"), (0, "53514C69746520666F726D6174203300", "application/vnd.sqlite3"), (0, "50415231", "application/vnd.apache.parquet"),
    (0, "4F626A01", "application/vnd.apache.avro"), (0, "4F5243", "application/vnd.apache.orc"), (0, "894844460D0A1A0A", "application/x-hdf5"), (0, "4152524F5731", "application/vnd.apache.arrow.file"),
    (0, "774F4646", "font/woff"), (0, "774F4632", "font/woff2"), (0, "4F54544F", "font/otf"), (0, "0001000000", "font/ttf"), (0, "74727565", "font/ttf"), (0, "74746366", "font/collection"),
    (34, "4C50", "application/vnd.ms-fontobject"),
    (0, "4F676753", "audio/ogg"), (0, "664C6143", "audio/flac"), (0, "494433", "audio/mpeg"), (0, "FFF[BA]", "audio/mpeg"), (0, "FFF3", "audio/mpeg"), (0, "FFF2", "audio/mpeg"),
    (0, "FFF1", "audio/aac"), (0, "FFF9", "audio/aac"), (0, "4D546864", "audio/midi"), (0, "2E736E64", "audio/basic"), (0, "2321414D52", "audio/amr"), (0, "4D414320", "audio/x-ape"),
    (0, "464F524D????????41494646", "audio/aiff"), (0, "464F524D????????41494643", "audio/aiff"),
    (0, "1A45DFA3", "video/x-matroska"), (0, "000001BA", "video/mpeg"), (0, "000001B3", "video/mpeg"), (0, "464C5601", "video/x-flv"), (0, "3026B2758E66CF11", "video/x-ms-asf"),
    (0, "4357530?", "application/vnd.adobe.flash-movie"), (0, "4657530?", "application/vnd.adobe.flash-movie"), (0, "47" + "??" * 187 + "47", "video/mp2t"),
    (0, "2142444E", "application/vnd.ms-outlook"), (0, "64383A616E6E6F756E6365", "application/x-bittorrent"), (0, "D4C3B2A1", "application/vnd.tcpdump.pcap"), (0, "A1B2C3D4", "application/vnd.tcpdump.pcap"),
    (0, "0A0D0D0A????????4D3C2B1A", "application/x-pcapng"), (60, "424F4F4B4D4F4249", "application/x-mobipocket-ebook"), (0, "41542654464F524D", "image/vnd.djvu"), (0, "EFBBBF3C3F786D6C", "application/xml"),
)
#: Forms of RIFF files, brands of ISO media files, document types of EBML files.
RIFF = {b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"ACON": "application/x-navi-animation", b"RMID": "audio/midi", b"CDXA": "video/mpeg"}
BRANDS = {b"avif": "image/avif", b"avis": "image/avif", b"heic": "image/heic", b"heix": "image/heic", b"mif1": "image/heif", b"msf1": "image/heif", b"M4A ": "audio/mp4",
          b"M4B ": "audio/mp4", b"qt  ": "video/quicktime", b"3gp": "video/3gpp", b"3g2": "video/3gpp2", b"crx ": "image/x-canon-cr3", b"jp2 ": "image/jp2", b"M4V ": "video/x-m4v"}
DOCTYPES = {b"webm": "video/webm", b"matroska": "video/x-matroska"}
#: What entries of a ZIP file say, first of these first.
ENTRIES = (
    ("word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), ("visio/", "application/vnd.ms-visio.drawing.main+xml"),
    ("AndroidManifest.xml", "application/vnd.android.package-archive"), ("META-INF/MANIFEST.MF", "application/java-archive"), ("doc.kml", "application/vnd.google-earth.kmz"),
)


class Node:
    """A place in the trie: following bytes under masks, and the type of what ends here."""

    __slots__ = ("exact", "masked", "kind")

    def __init__(self):
        self.exact: dict[int, Node] = {}
        self.masked: list[tuple[int, int, Node]] = []
        self.kind: str | None = None

    def grow(self, pattern: list[tuple[int, int]], kind: str) -> None:
        if not pattern:
            self.kind = self.kind or kind
            return
        (value, mask), rest = pattern[0], pattern[1:]
        if mask == 0xFF:
            node = self.exact.setdefault(value, Node())
        else:
            node = next((n for v, m, n in self.masked if (v, m) == (value, mask)), None)
            if node is None:
                node = Node()
                self.masked.append((value, mask, node))
        node.grow(rest, kind)

    def longest(self, data: bytes, at: int, depth: int = 0) -> tuple[int, str] | None:
        """(bytes, type) of the longest signature that the data from a place on begin with."""
        best = (depth, self.kind) if self.kind else None
        if at < len(data):
            byte = data[at]
            nexts = [self.exact[byte]] if byte in self.exact else []
            for node in [*nexts, *(n for v, m, n in self.masked if byte & m == v)]:
                found = node.longest(data, at + 1, depth + 1)
                if found and (best is None or found[0] > best[0]):
                    best = found
        return best


def pattern(digits: str) -> list[list[tuple[int, int]]]:
    """The patterns of a signature as (value, mask) bytes; ``[BA]`` stands for either half byte."""
    digits = digits.replace(" ", "")
    if "[" in digits:
        a, b = digits.index("["), digits.index("]")
        return [p for c in digits[a + 1 : b] for p in pattern(digits[:a] + c + digits[b + 1 :])]
    half = lambda c: (0, 0) if c == "?" else (int(c, 16), 15)
    pairs = [(half(digits[i]), half(digits[i + 1])) for i in range(0, len(digits), 2)]
    return [[(h[0] << 4 | low[0], h[1] << 4 | low[1]) for h, low in pairs]]


def _tries() -> dict[int, Node]:
    out: dict[int, Node] = {}
    for place, digits, kind in SIGNATURES:
        for p in pattern(digits):
            out.setdefault(place, Node()).grow(p, kind)
    return out


TRIES = _tries()


def zip_kind(data: bytes) -> str:
    """A ZIP file's type by the names of its first entries, and what a first entry ``mimetype`` holds."""
    names, at = [], 0
    while data[at : at + 4] == b"PK\x03\x04" and at + 30 <= len(data):
        size, n, extra = int.from_bytes(data[at + 18 : at + 22], "little"), int.from_bytes(data[at + 26 : at + 28], "little"), int.from_bytes(data[at + 28 : at + 30], "little")
        name = data[at + 30 : at + 30 + n].decode("utf-8", "replace")
        inside = at + 30 + n + extra
        if not names and name == "mimetype" and data[at + 8 : at + 10] == b"\0\0":
            held = data[inside : inside + size].decode("ascii", "replace").strip()
            return held if "/" in held and held.isprintable() else "application/zip"
        names.append(name)
        streamed = data[at + 6] & 8 and not size
        at = data.find(b"PK\x03\x04", inside) if streamed else inside + size
        if at < 0:
            break
    for mark, kind in ENTRIES:
        if any(n == mark or mark.endswith("/") and n.startswith(mark) for n in names):
            return kind
    return "application/zip"


def kind_of(data: bytes) -> str | None:
    """The type that a payload's first bytes have by signature or container; null if none."""
    if data[:4] == b"PK\x03\x04":
        return zip_kind(data)
    if data[:4] in (b"RIFF", b"RIFX") and len(data) >= 12:
        return RIFF.get(data[8:12], "application/x-riff")
    if data[4:8] == b"ftyp" and len(data) >= 12:
        size = int.from_bytes(data[:4], "big")
        brands = [data[8:12], *(data[i : i + 4] for i in range(16, min(size, len(data) - 3), 4))]
        for brand in brands[:1] if brands[0] not in (b"mif1", b"msf1") else [*brands[1:], brands[0]]:
            kind = BRANDS.get(brand) or BRANDS.get(brand[:3])
            if kind:
                return kind
        return "video/mp4"
    found = [x for place, node in TRIES.items() if (x := node.longest(data, place))]
    best = max(found, default=None)
    if best and best[1] == "video/x-matroska":
        at = data.find(b"\x42\x82", 4, 64)
        return next((k for d, k in DOCTYPES.items() if at > 0 and data[at + 3 : at + 3 + len(d)] == d), best[1])
    return best and best[1]


@F.arrow_udf(T.StringType())
def sniffed(starts: pa.Array) -> pa.Array:
    """``kind_of`` the first SEEN bytes of payloads."""
    return pa.array([None if b is None else kind_of(b) for b in starts.to_pylist()], pa.string())
