"""Archives from the command line: ``spark-submit websilo/commands.py <command> ...``, or the functions themselves.

An output is a folder of part files in order: its parts, one behind the other, are the archive.
An output whose name ends in .gz holds a gzip member for each record.  Commands that
copy records fail on an input with an unreadable one before anything is written.  Exit
codes: 0 done, 1 failed or, of lint, validate and verify, problems found.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):  # run as a script
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websilo.operators import canonicalize as canonical_form
from websilo.operators import export, graph, grammar, lint as rules, merge as merging, rewrite, semantic, validate as validation, verify as verification
from websilo.sources.framing import is_gzip
from websilo.sources.warc import found_files, read_warc, write_warc
from websilo.storage import settled


class Failed(Exception):
    """A command can't do what it is asked; the message says why."""


def _whole(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of files in order of the paths, with file_seq; all readable, or else Failed."""
    files = [f for path in paths for f, _ in found_files(path)]
    raw = read_warc(spark, ",".join(paths))
    bad = raw.where(F.col("error").isNotNull()).select("file", "record_index", F.col("error")["message"]).orderBy("file", "record_index").first()
    if bad is not None:
        raise Failed(f"record {bad[1]} of {bad[0]}: {bad[2]}")
    return merging.in_order(raw, files)


def _apart(output: str, *inputs: str) -> None:
    plain = lambda p: os.path.normpath(p.removeprefix("file://").removeprefix("file:")) if "://" not in p.removeprefix("file://") else p.rstrip("/")
    if any(plain(output) == plain(i) for i in inputs):
        raise Failed(f"{output} is an input, and can't be the output, too")


def write_in_order(records: DataFrame, output: str, parts: int = 0, level: int = 6, packed: bool | None = None) -> DataFrame:
    """Writes records with (file_seq, record_index) in ranges of these; the table of what was written."""
    spark = records.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.repartitionByRange(n, "file_seq", "record_index").sortWithinPartitions("file_seq", "record_index")
    packed = is_gzip(output.rstrip("/")) if packed is None else packed
    written = write_warc(ranged.select("version", "headers", "body"), output, "gzip" if packed else "none", level)
    bad = written.where(F.col("error").isNotNull()).first()
    if bad is not None:
        raise Failed(f"a record can't be written: {bad['error']}")
    return written


def _count(written: DataFrame) -> tuple[int, int]:
    row = written.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return row[0], row[1]


def canonicalize(spark: SparkSession, source: str, output: str, parts: int = 0) -> str:
    _apart(output, source)
    n, _ = _count(write_in_order(canonical_form.canonicalize(_whole(spark, source)), output, parts))
    return f"{n} records with canonical headers are in {output}"


def compress(spark: SparkSession, source: str, output: str, level: int = 6, parts: int = 0) -> str:
    _apart(output, source)
    if not 0 <= level <= 9:
        raise Failed(f"gzip levels go from 0 to 9, not to {level}")
    n, size = _count(write_in_order(_whole(spark, source), output, parts, level, packed=True))
    return f"{n} records in {size} compressed bytes are in {output}"


def merge(spark: SparkSession, first: str, second: str, output: str, parts: int = 0) -> str:
    _apart(output, first, second)
    raw = settled(_whole(spark, first, second))
    n, _ = _count(write_in_order(merging.merge(raw), output, parts))
    return f"{n} records are in {output}; {raw.count() - n} equal warcinfo records were joined to others"


def rewrite_warcinfo(spark: SparkSession, source: str, output: str, parts: int = 0, **values) -> str:
    _apart(output, source)
    raw = _whole(spark, source)
    changed = settled(rewrite.rewrite_warcinfo(semantic.to_semantic(grammar.to_untyped(raw)), **values).select(
        "file", "file_seq", "record_index", "version", "headers", "content_length", "body", "record_type",
        F.coalesce("rewrite_error", F.when(grammar.lookup({"warcinfo": 1}, F.lower(F.col("record_type"))).isNotNull(), F.col("error")["message"])).alias("why")))
    bad = changed.where("why IS NOT NULL").first()
    if bad is not None:
        raise Failed(f"record {bad['record_index']} of {bad['file']}: {bad['why']}")
    n, _ = _count(write_in_order(changed, output, parts))
    return f"{n} records are in {output}, {changed.where(F.col('record_type') == 'warcinfo').count()} warcinfo records of them changed"


def export_records(spark: SparkSession, source: str, output: str, form: str) -> str:
    records = semantic.to_semantic(grammar.to_untyped(read_warc(spark, source)))
    {"csv": export.write_csv, "json": export.write_json_lines}[form](records, output)
    return f"{source} was exported as {form} to {output}"


def draw(spark: SparkSession, source: str, output: str) -> str:
    lines = graph.d2_lines(settled(read_warc(spark, source, bodies=False)))
    lines.orderBy("file", "section", "a", "b").select("line").write.mode("errorifexists").text(output)
    return f"the graph of {source} is in {output}"


def lint(spark: SparkSession, source: str, show=print) -> int:
    """Shows each finding in order of file and place; how many there are."""
    records = settled(semantic.to_semantic(grammar.to_untyped(read_warc(spark, source))).select(
        "file", "record_index", "headers", "error", "record_type", "record_id", "target_uri", "warcinfo_id", "concurrent_to", "payload_digest", "block_digest", "content_type", "content_length", "body_fields"))
    unread = records.where(F.col("error").isNotNull()).select("file", "record_index", F.lit(-1).alias("place"), F.concat(
        F.lit("record "), F.col("record_index").cast("string"), F.lit(": "), F.col("error")["message"]).alias("line"))
    n = 0
    for row in rules.report_lines(rules.lint(records)).unionByName(unread).orderBy("file", "record_index", "place").toLocalIterator():
        show(row["line"])
        n += 1
    return n


def _shown(df: DataFrame, show) -> int:
    n = 0
    for row in df.toLocalIterator():
        show("\t".join("" if x is None else str(x) for x in row))
        n += 1
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="websilo", description="Work on web archives.")
    kinds = p.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, **more):
        one = kinds.add_parser(name, **more)
        for place in places:
            one.add_argument(place)
        return one

    for name in ("canonicalize", "compress"):
        one = add(name, "input")
        one.add_argument("-o", "--output", required=True)
        if name == "compress":
            one.add_argument("-l", "--level", type=int, choices=range(10), default=6)
    add("merge", "first", "second").add_argument("-o", "--output", required=True)
    one = add("rewrite", "input")
    one.add_argument("target", choices=["warcinfo"])
    one.add_argument("-o", "--output", required=True)
    for name in ("filename", "software-name", "software-version", "operator-name", "operator-email", "collection-id"):
        one.add_argument(f"--{name}")
    one = add("export", "input")
    one.add_argument("format", choices=["csv", "json"])
    one.add_argument("-o", "--output", required=True)
    add("graph", "input").add_argument("-o", "--output", required=True)
    for name in ("lint", "validate", "verify"):
        add(name, "input")
    return p


def run(spark: SparkSession, arguments: list[str], show=print) -> int:
    """A command's exit code."""
    try:
        a = parser().parse_args(arguments)
    except SystemExit as e:
        return int(bool(e.code))
    try:
        if a.command == "canonicalize":
            show(canonicalize(spark, a.input, a.output))
        elif a.command == "compress":
            show(compress(spark, a.input, a.output, a.level))
        elif a.command == "merge":
            show(merge(spark, a.first, a.second, a.output))
        elif a.command == "rewrite":
            values = {"filename": a.filename, "software": (a.software_name, a.software_version), "operator": (a.operator_name, a.operator_email), "collection": a.collection_id}
            if not any(x is not None for v in values.values() for x in (v if isinstance(v, tuple) else (v,))):
                raise Failed("nothing is given that warcinfo records should hold")
            show(rewrite_warcinfo(spark, a.input, a.output, **values))
        elif a.command == "export":
            show(export_records(spark, a.input, a.output, a.format))
        elif a.command == "graph":
            show(draw(spark, a.input, a.output))
        elif a.command == "lint":
            n = lint(spark, a.input, show)
            show(f"{n} problems in {a.input}")
            return int(n > 0)
        elif a.command == "validate":
            results = validation.validate_all(read_warc(spark, a.input))
            files = spark.createDataFrame([(f,) for f, _ in found_files(a.input)], "file string")
            told = settled(validation.expected(results, files))
            _shown(told.orderBy("file", "level"), show)
            return int(told.where("status <> 'passed'").count() > 0)
        else:
            return int(_shown(verification.verify(spark, a.input).orderBy("file", "record_index", "check"), show) > 0)
    except Failed as e:
        print(f"websilo: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # what Spark says of a failed job
        print(f"websilo: {str(e)[:2000]}", file=sys.stderr)
        return 1
    return 0


def ship(spark: SparkSession, folder: str) -> None:
    """Gives the workers this package, as --py-files would, by way of a folder that stays until the session ends."""
    import shutil

    here = os.path.dirname(os.path.abspath(__file__))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/websilo", "zip", os.path.dirname(here), os.path.basename(here)))


if __name__ == "__main__":
    import tempfile

    with tempfile.TemporaryDirectory() as packed:
        session = SparkSession.builder.appName("websilo").getOrCreate()
        ship(session, packed)
        code = run(session, sys.argv[1:])
        session.stop()
    sys.exit(code)
