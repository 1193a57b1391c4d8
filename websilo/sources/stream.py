"""Archives in a folder as a stream of records, exactly once each.

The stream's offset is how many bytes of each file have been read, and whether the file was
complete.  Files whose names end in ``.open`` are still being written: a record that their
bytes don't hold to its end yet waits for a later batch; under the name without it they
are complete, and what is cut off then is a fault.  A batch reads the new part of each file as a
task of its own; records that the bytes before held are counted anew from the file's start
(headers alone in plain files), so nothing but the offsets has to be remembered, and a stopped
stream goes on where its checkpoint says.  A fault ends its file for good.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from .framing import Members, Plain, frame, is_gzip

OPEN = ".open"
_UNFINISHED = ("UnexpectedEndOfHeaderBlock", "UnexpectedEndOfBody", "Source")


class Prefix:
    """The first bytes of a file as a file."""

    def __init__(self, file, n: int):
        self.file, self.n = file, n
        file.seek(0)

    def size(self) -> int:
        return self.n

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, at: int) -> None:
        self.file.seek(at)

    def read(self, n: int) -> bytes:
        return self.file.read(max(0, min(n, self.n - self.file.tell())))


def held(file, n: int, closed: bool, packed: bool, bodies: bool):
    """The records that a file's first n bytes hold to their ends, with the fault that ends them if there is one."""
    part = Prefix(file, n)
    for r in frame(Members(part) if packed else Plain(part), bodies):
        if r.fault is not None and not closed and r.fault[1] in _UNFINISHED:
            return
        yield r


@dataclass
class Growth(InputPartition):
    name: str
    path: str
    found_by: str
    before: int
    was_closed: bool
    now: int
    closed: bool


class WarcStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bodies = str(options.get("bodies", "true")).lower() != "false"
        self.compression = options.get("compression", "auto")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from .warc import found_files, open_file

        out = {}
        for name, found_by in found_files(self.path):
            with open_file(name, found_by) as file:
                size = file.size()
            bare = name.removesuffix(OPEN)
            if bare == name or bare not in out:  # complete ones go before
                out[bare] = {"bytes": size, "closed": bare == name}
        return out

    def partitions(self, start: dict, end: dict):
        from .warc import found_files

        found = dict(found_files(self.path))
        out = []
        for name, at in end.items():
            had = start.get(name, {"bytes": 0, "closed": False})
            if had == at or had["closed"]:
                continue
            path = name if name in found else name + OPEN  # it may have been completed since
            out.append(Growth(name, path, found.get(path, self.path), had["bytes"], had["closed"], at["bytes"], at["closed"]))
        return out

    def read(self, partition: Growth):
        from .warc import batches_of, open_file

        packed = is_gzip(partition.name) if self.compression == "auto" else self.compression == "gzip"
        with open_file(partition.path, partition.found_by) as file:
            first = 0
            if partition.before:
                for r in held(file, partition.before, False, packed, False):
                    if r.fault is not None:
                        return  # it ended the file, and was told
                    first += 1
            new = ((i, r) for i, r in enumerate(held(file, partition.now, partition.closed, packed, self.bodies)) if i >= first)
            yield from batches_of(new, partition.name, self.bodies)
