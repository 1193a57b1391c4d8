"""Framing of one web-archive stream into records, in bounded memory.

A stream ends at its first framing fault, which becomes the last record's error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

MAX_HEADER = 1 << 20
_BUFFER, _PIECE = 1 << 20, 16 << 10
_TOKEN = re.compile(rb"[!#$%&'*+\-.0-9A-Z^_`a-z|~]+")
_DIGITS = re.compile(rb"[ \t]*([0-9]+)[ \t]*")


class Fault(Exception):
    """A stream can't be read on: (level, code, message)."""


class Framed(NamedTuple):
    offset: int
    length: int
    version: str | None
    headers: list[tuple[str, bytes]] | None
    content_length: int | None
    body: bytes | None
    fault: tuple[str, str, str] | None
    refused: bool = False


class Pieces:
    """A file's bytes in pieces, whose unused ends can be given back; ``at``: place of the next byte.

    Reads grow from 64 KB to 1 MB, as a range may be short.  Pieces are short: what a member
    leaves of one is copied, for each member.
    """

    def __init__(self, raw: BinaryIO, at: int = 0):
        self.raw, self.at, self.have, self.used, self.size = raw, at, b"", 0, _BUFFER >> 4

    def more(self) -> bool:
        """Whether bytes are left."""
        if self.used == len(self.have):
            self.have, self.used = self.raw.read(self.size), 0
            self.size = min(2 * self.size, _BUFFER)
        return self.used < len(self.have)

    def take(self) -> bytes:
        """The next bytes; none at the end."""
        self.more()
        piece = self.have[self.used : self.used + _PIECE]
        self.used += len(piece)
        self.at += len(piece)
        return piece

    def give_back(self, n: int) -> None:
        """The last n bytes of the last piece weren't used."""
        self.used -= n
        self.at -= n


class Member:
    """One gzip member as a stream of plain bytes, which ends with it."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.unzip = pieces, zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while not self.unzip.eof:
            given = self.pieces.take()
            out = self.unzip.decompress(given, n)
            self.pieces.give_back(len(self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail))
            if out:
                return out
            if not given and not self.unzip.eof:
                raise EOFError("a gzip member is cut off")
        return b""


def members(raw: BinaryIO) -> Iterator[Member]:
    """The gzip members of a file in turn; each is to be read to its end before the next."""
    pieces = Pieces(raw)
    while pieces.more():
        yield Member(pieces)


class Members:
    """A file of concatenated gzip members as one stream of plain bytes; ``count`` members began."""

    def __init__(self, raw: BinaryIO):
        self.each, self.one, self.count = members(raw), None, 0

    def read(self, n: int) -> bytes:
        while True:
            if self.one is None:
                self.one = next(self.each, None)
                if self.one is None:
                    return b""
                self.count += 1
            out = self.one.read(n)
            if out:
                return out
            self.one = None


class MarkedMembers:
    """Gzip members from a place on as one stream of plain bytes; ``marks``: place in the file of the member that begins at a plain byte."""

    def __init__(self, file, at: int):
        file.seek(at)
        self.pieces, self.one, self.plain, self.marks = Pieces(file, at), None, 0, {}
        self.begun: list[int] = []  # plain bytes at which members begin, those of empty ones too

    def read(self, n: int) -> bytes:
        while True:
            if self.one is None:
                if not self.pieces.more():
                    return b""
                self.marks[self.plain] = self.pieces.at
                self.begun.append(self.plain)
                self.one = Member(self.pieces)
            out = self.one.read(n)
            if out:
                self.plain += len(out)
                return out
            self.one = None


class Plain:
    """A seekable file as a stream of bytes from its position on, parts of which can be passed over."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def read(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> int:
        """Passes over up to n bytes; how many."""
        at = self.file.tell()
        n = min(n, self.size - at)
        self.file.seek(at + n)
        return n


class _Reader:
    def __init__(self, stream):
        self.stream, self.have, self.at, self.taken = stream, b"", 0, 0
        self.skip = getattr(stream, "skip", None)

    def _more(self) -> bool:
        chunk = self.stream.read(_BUFFER)
        self.have, self.at = self.have[self.at :] + chunk, 0
        return bool(chunk)

    def line(self, room: int) -> bytes:
        """Up to and with the next LF, or what is left; more than room bytes is a fault."""
        start = 0
        while True:
            end = self.have.find(b"\n", self.at + start)
            size = (end + 1 if end >= 0 else len(self.have)) - self.at
            if size > room:
                raise Fault("stream", "HeaderBlockTooLarge", "Record header block too large.")
            if end >= 0 or not self._more_keep():
                out = self.have[self.at : self.at + size]
                self.at += size
                self.taken += size
                return out
            start = size

    def _more_keep(self) -> bool:
        return self._more()

    def exactly(self, n: int, keep: bool) -> bytes | None:
        """n bytes, or None if there are fewer; b"" if they aren't kept."""
        parts, left = [], n
        while left:
            if self.at == len(self.have) and not keep and self.skip is not None and left > _BUFFER // 16:
                over = self.skip(left)
                self.taken += over
                left -= over
                if left:
                    return None
                break
            if self.at == len(self.have) and not self._more():
                return None
            piece = self.have[self.at : self.at + left]
            self.at += len(piece)
            self.taken += len(piece)
            left -= len(piece)
            if keep:
                parts.append(piece)
        return b"".join(parts)


def parse_header(block: bytes) -> tuple[str, list[tuple[str, bytes]], int]:
    """(version, fields, content length) of a header block with its closing empty line."""
    lines = block.split(b"\n")
    shown = lambda b: b.rstrip(b"\r\n").decode("utf-8", "replace")
    first = lines[0]
    if not first.endswith(b"\r"):
        raise Fault("raw", "MalformedVersionLine", f"Malformed version line: {shown(first)}")
    first = first[:-1]
    if not first.startswith(b"WARC/"):
        raise Fault("raw", "MalformedVersionLine", f"Malformed version line: {shown(first)}")
    version = first[5:]
    if version not in (b"1.0", b"1.1"):
        raise Fault("raw", "MalformedVersion", f"Unsupported WARC version: {shown(version)}")
    fields: list[tuple[str, bytes]] = []
    for line in lines[1:-1]:
        if line == b"\r":
            break
        if not line.endswith(b"\r"):
            raise Fault("raw", "MalformedFieldLine", f"Malformed field line: {shown(line)}")
        if line[:1] in (b" ", b"\t") and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + b"\r\n" + line[:-1])
            continue
        name = _TOKEN.match(line)
        if not name or line[name.end() : name.end() + 1] != b":" or b"\r" in line[:-1]:
            raise Fault("raw", "MalformedFieldLine", f"Malformed field line: {shown(line)}")
        fields.append((name[0].decode("ascii"), line[name.end() + 1 : -1]))
    declared = [v for n, v in fields if n.lower() == "content-length"]
    if not declared:
        raise Fault("raw", "MissingContentLength", "Missing Content-Length.")
    if len(declared) > 1:
        raise Fault("raw", "RepeatedContentLength", "Repeated Content-Length.")
    digits = _DIGITS.fullmatch(declared[0])
    if not digits or int(digits[1]) >= 1 << 64:
        raise Fault("raw", "MalformedContentLength", f"Malformed Content-Length: {shown(declared[0]).strip()}")
    return version.decode(), fields, int(digits[1])


def frame(stream, bodies: bool = True, accept: Callable[[str, list], bool] | None = None) -> Iterator[Framed]:
    """Records of a stream of plain bytes; without bodies their framing is still checked.

    ``accept``: of a version and fields; the blocks of records that it refuses are passed
    over, with their ends checked, and such records are marked.
    """
    reader = _Reader(stream)
    while True:
        offset, block = reader.taken, b""
        version = fields = size = None
        keep = bodies
        try:
            while True:
                line = reader.line(MAX_HEADER - len(block))
                block += line
                if not line.endswith(b"\n"):
                    if not block:
                        return
                    raise Fault("raw", "UnexpectedEndOfHeaderBlock", "Unexpected end of header block.")
                if line == b"\r\n":
                    break
            version, fields, size = parse_header(block)
            refused = accept is not None and not accept(version, fields)
            keep = bodies and not refused
            body = reader.exactly(size, keep)
            if body is None:
                raise Fault("stream", "UnexpectedEndOfBody", "Unexpected end of body.")
            end = reader.exactly(4, True)
            if end is None:
                raise Fault("stream", "UnexpectedEndOfBody", "Unexpected end of body.")
            if end != b"\r\n\r\n":
                raise Fault("stream", "MalformedRecordTerminator", "Malformed record terminator.")
        except Fault as fault:
            yield Framed(offset, reader.taken - offset, version, fields, size, None, fault.args)
            return
        except (OSError, EOFError, zlib.error):
            yield Framed(offset, reader.taken - offset, version, fields, size, None,
                         ("stream", "Source", "Error reading data source."))
            return
        yield Framed(offset, reader.taken - offset, version, fields, size, body if keep else None, None, refused)


def is_gzip(path: str) -> bool:
    """Whether a path's extension is gz, in any case."""
    return path.rsplit("/", 1)[-1].lower().endswith(".gz")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One member with no time and an unknown system in its header."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    flags = 2 if level == 9 else 4 if level in (0, 1) else 0
    return (b"\x1f\x8b\x08\x00" + b"\0" * 4 + bytes([flags, 255]) + squeeze.compress(data) + squeeze.flush()
            + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little"))
