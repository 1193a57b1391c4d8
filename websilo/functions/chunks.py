"""HTTP messages read piece by piece: the payload without its chunking, whatever the cuts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .http import PayloadError, split_message

_CUT_OFF = "No last chunk ends the chunked message."


class ChunkScanner:
    """A chunked body in pieces: ``feed`` gives the data of each; ``done`` once the closing chunk was read."""

    def __init__(self):
        self.stage, self.line, self.left, self.done = "size", b"", 0, False

    def feed(self, piece: bytes) -> list[bytes]:
        out, at = [], 0
        while at < len(piece) and not self.done:
            if self.stage == "size":
                end = piece.find(b"\n", at)
                self.line += piece[at : end if end >= 0 else len(piece)]
                at = end + 1 if end >= 0 else len(piece)
                if end >= 0:
                    self._sized()
            elif self.stage == "data":
                part = piece[at : at + self.left]
                out.append(part)
                at += len(part)
                self.left -= len(part)
                if not self.left:
                    self.stage = "end"
            else:  # the line end behind a chunk's data
                byte = piece[at : at + 1]
                at += 1
                if byte == b"\r" and self.stage == "end":
                    self.stage = "feed"
                elif byte == b"\n":
                    self.stage, self.line = "size", b""
                else:
                    raise PayloadError(_CUT_OFF)
        return out

    def _sized(self) -> None:
        line = self.line.removesuffix(b"\r")
        size = line.partition(b";")[0].strip(b" \t\r\n\x0c")
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise PayloadError(f"The chunked message has `{line.decode('utf-8', 'replace')}` where a chunk size belongs.")
        self.left = int(size, 16)
        self.stage, self.done = "data", self.left == 0

    def close(self) -> None:
        if not self.done:
            raise PayloadError(_CUT_OFF)


class MessageScanner:
    """A whole HTTP message in pieces: its head is held until it ends, the payload isn't."""

    def __init__(self):
        self.head, self.chunks, self.body = b"", None, False

    def feed(self, piece: bytes) -> list[bytes]:
        if self.body:
            return [piece] if self.chunks is None else self.chunks.feed(piece)
        self.head += piece
        try:
            rest, codings = split_message(self.head)
        except PayloadError:
            return []  # it has not ended yet
        names = [c.strip(" \t\r\n") for c in codings.split(",")]
        names = [c for c in names if c and c.lower() != "identity"]
        if names and [c.lower() for c in names] != ["chunked"]:
            raise PayloadError(f"The HTTP message has the transfer-coding `{codings.strip()}`: only chunked can be undone.")
        self.body, self.head = True, b""
        self.chunks = ChunkScanner() if names else None
        return self.feed(rest)

    def close(self) -> None:
        if not self.body:
            split_message(self.head)
        elif self.chunks is not None:
            self.chunks.close()


_DIGESTS = "record_id string, segments long, bytes long, payload_bytes long, payload_digest string, error string"


def segment_payloads(records: DataFrame) -> DataFrame:
    """(record_id, segments, bytes, payload_bytes, payload_digest, error) of each series of segments that holds an HTTP message.

    records: origins (segment 1) and continuations at the semantic level.  A series is read in
    order of its numbers, a piece at a time, by one task, which holds no more of it than its
    head; the payload's SHA-256 is that of the whole message's entity body.  Segments that are
    missing, or there twice, are an error, as is a message that can't be read.
    """
    key = F.when(F.col("record_type") == "continuation", F.col("segment_origin_id")).otherwise(F.col("record_id"))
    parts = records.where(F.col("error").isNull() & F.col("segment_number").isNotNull()).select(
        key.alias("series"), F.col("segment_number").cast("decimal(20,0)").alias("n"), "body")

    def run(batches):
        series, state = None, None
        rows: list[tuple] = []

        def begin():
            return {"scan": MessageScanner(), "hash": hashlib.sha256(), "n": 0, "bytes": 0, "payload": 0, "error": None}

        def end():
            if state["error"] is None:
                try:
                    state["scan"].close()
                except PayloadError as e:
                    state["error"] = str(e)
            fine = state["error"] is None
            rows.append((series, state["n"], state["bytes"], state["payload"] if fine else None, "sha256:" + state["hash"].hexdigest() if fine else None, state["error"]))

        def made():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _DIGESTS.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                name, number, body = (batch.column(c)[i].as_py() for c in range(3))
                if state is None or name != series:
                    if state is not None:
                        end()
                    series, state = name, begin()
                state["n"] += 1
                state["bytes"] += len(body or b"")
                if state["error"] is None and number != state["n"]:
                    state["error"] = f"Segment {state['n']} is missing." if number > state["n"] else f"Segment {number} stands there twice."
                if state["error"] is None:
                    try:
                        for data in state["scan"].feed(body or b""):
                            state["hash"].update(data)
                            state["payload"] += len(data)
                    except PayloadError as e:
                        state["error"] = str(e)
            if rows:
                yield made()
                rows.clear()
        if state is not None:
            end()
            yield made()

    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "series").sortWithinPartitions("series", "n").mapInArrow(run, _DIGESTS)
