import itertools
import random
import time

import pandas as pd
from pyspark.sql import functions as F
from test_splits import record

from websilo.operators import grammar, lint, semantic
from websilo.sources.warc import read_warc
from websilo.streaming.ingest import stream_warc
from websilo.streaming.lint import _AROUND, advance, finish, lint_stream, start

KINDS = ("warcinfo", "request", "response", "metadata", "resource", "unreadable")


def rows_of(kinds, file):
    return [{"file": file, "record_index": i, "kind": k, "record_id": None if k == "unreadable" else f"urn:x:{i}", "target_uri": f"http://example.org/{i % 2}"} for i, k in enumerate(kinds)]


def test_state_equals_windows(spark):
    """On every sequence of up to five types, cut into batches anywhere."""
    r, every, got = random.Random(1), [], []
    for n in range(6):
        for j, kinds in enumerate(itertools.product(KINDS, repeat=n)):
            rows = rows_of(kinds, f"{n}-{j}")
            every += rows
            state, at = start(), 0
            while at < n:
                to = r.randint(at + 1, n)
                got += advance(state, rows[at:to])
                at = to
            got += finish(state) + finish(state)
    df = spark.createDataFrame(pd.DataFrame(every))
    want = {(x["file"], x["record_index"]): tuple(x[c] for c in _AROUND) for x in lint.in_context(df).collect()}
    assert {(x["file"], x["record_index"]): tuple(x[c] for c in _AROUND) for x in got} == want and len(got) == len(want)


def test_idle_files_that_go_on():
    state, rows = start(), rows_of(["warcinfo", "request", "response"], "f")
    out = advance(state, rows[:2]) + finish(state) + advance(state, rows[2:]) + finish(state)
    assert [(x["record_index"], x["lead1"], x["lag1"], x["info"]) for x in out] == [(0, "request", None, None), (1, None, "warcinfo", "urn:x:0"), (2, None, "request", "urn:x:0")]


def test_lint_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    kinds = ["warcinfo", "request", "response", "metadata", "response", "request", "revisit", "request"]
    parts = [record(k, i, b"x" * i, *(["WARC-Profile: urn:x:p"] if k == "revisit" else [])) for i, k in enumerate(kinds)]
    parts[0] = parts[0].replace(b"WARC-Target-URI: http://example.org/warcinfo/0\r\n", b"")
    (folder / "a.warc").write_bytes(b"".join(parts))
    (folder / "b.warc").write_bytes(b"".join(parts[1:4] + parts[:1] * 2))
    lifted = lambda raw: semantic.to_semantic(grammar.to_untyped(raw))
    q = lint_stream(lifted(stream_warc(spark, str(folder))), idle_ms=1).writeStream.format("memory").queryName("lint").start()
    want = {tuple(r) for r in lint.lint(lifted(read_warc(spark, str(folder)))).collect()}
    try:
        got, until = [], time.time() + 90
        while len(got) < len(want) and time.time() < until and q.isActive:  # batches without data go on, as files may have become idle
            time.sleep(1)
            got = [tuple(r) for r in spark.table("lint").collect()]
    finally:
        q.stop()
    assert set(got) == want and len(got) == len(want) and len({r[4] for r in want}) > 8


def test_report_lines(spark):
    one = spark.createDataFrame([("f", 3, 1, "urn:x:1", "R", "said")], "file string, record_index long, place int, record_id string, violation string, message string")
    assert lint.report_lines(one).first()["line"] == "record 3 (urn:x:1): said"
    assert lint.summary(one).select(F.col("n")).first()[0] == 1
