import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from websilo.functions import fields as wf
from websilo.functions import typed
from websilo.functions.typed import Field

PAIRS = "array<struct<name: string, value: string>>"
SCHEMA = [Field("text"), Field("flag", "boolean", required=False), Field("letter", "character", required=False), Field("small", "int8", required=False), Field("count", "uint64", required=False),
          Field("ratio", "float", required=False), Field("mode", required=False, choices=("fast", "slow")), Field("tag", many=True), Field("n", "int32", required=False, many=True)]


def read(spark, rows, **more):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, f {PAIRS}")
    return [r["r"] for r in df.select("i", typed.read(F.col("f"), SCHEMA, **more).alias("r")).orderBy("i").collect()]


CASES = [
    ([("text", "a")], None, None),
    ([], "MissingField", "text"),
    ([("TEXT", "a"), ("Text", "b")], "RepeatedField", "text"),
    ([("text", "a"), ("flag", "yes")], "UnreadableValue", "flag"),
    ([("small", "200"), ("text", "a"), ("text", "b")], "UnreadableValue", "small"),
    ([("text", "a"), ("text", "b"), ("small", "200")], "RepeatedField", "text"),
    ([("text", "a"), ("small", "-128"), ("count", "18446744073709551615")], None, None),
    ([("text", "a"), ("count", "18446744073709551616")], "UnreadableValue", "count"),
    ([("text", "a"), ("count", "-1")], "UnreadableValue", "count"),
    ([("text", "a"), ("count", " 1")], "UnreadableValue", "count"),
    ([("text", "a"), ("count", "0000000000000000000000000000000000000000000000007")], None, None),
    ([("text", "a"), ("letter", "ab")], "UnreadableValue", "letter"),
    ([("text", "a"), ("letter", "")], "UnreadableValue", "letter"),
    ([("text", "a"), ("ratio", "1d")], "UnreadableValue", "ratio"),
    ([("text", "a"), ("ratio", "1e")], "UnreadableValue", "ratio"),
    ([("text", "a"), ("mode", "FAST")], "UnknownChoice", "mode"),
    ([("n", "1"), ("N", "x"), ("text", "a")], "UnreadableValue", "n"),
    ([("other", "1"), ("text", "a")], None, None),
]


def test_errors_of_the_first_line(spark):
    got = read(spark, [c[0] for c in CASES])
    assert [(r["error"] and r["error"]["code"], r["error"] and r["error"]["field"]) for r in got] == [c[1:] for c in CASES]
    assert all((r["value"] is None) == (r["error"] is not None) for r in got)
    strict = read(spark, [[("text", "a"), ("Other", "1"), ("flag", "x")], [("flag", "x"), ("Other", "1")]], deny_unknown=True)
    assert [(r["error"]["code"], r["error"]["field"]) for r in strict] == [("UnknownField", "Other"), ("UnreadableValue", "flag")]


def test_values_and_the_way_back(spark):
    rows = [
        [("Text", "a b"), ("flag", "true"), ("letter", "é"), ("small", "+07"), ("count", "18446744073709551615"), ("ratio", "-.5e1"), ("mode", "slow"), ("tag", "x"), ("TAG", "y"), ("n", "1"), ("n", "-2"),
         ("Own", "1"), ("other", "2"), ("own", "3")],
        [("text", ""), ("ratio", "NaN")], [("text", "z"), ("ratio", "-Infinity"), ("n", "5")],
    ]
    a, b, c = read(spark, rows, rest=True)
    v = a["value"]
    assert (v["text"], v["flag"], v["letter"], v["small"], v["count"], v["ratio"], v["mode"], v["tag"], v["n"]) == ("a b", True, "é", 7, Decimal(2**64 - 1), -5.0, "slow", ["x", "y"], [1, -2])
    assert a["rest"] == {"Own": ["1", "3"], "other": ["2"]} and b["rest"] == {}
    assert b["value"]["tag"] == [] and b["value"]["n"] is None and math.isnan(b["value"]["ratio"]) and c["value"]["ratio"] == -math.inf and c["value"]["n"] == [5]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, f {PAIRS}").withColumn("r", typed.read(F.col("f"), SCHEMA, rest=True))
    back = df.withColumn("w", typed.write(F.col("r")["value"], SCHEMA, F.col("r")["rest"])).withColumn("again", typed.read(F.col("w")["fields"], SCHEMA, rest=True))
    for r in back.orderBy("i").collect():
        assert r["w"]["error"] is None
        assert str(r["again"]) == str(r["r"])
    lines = back.where("i = 0").select(wf.render(F.col("w")["fields"])).first()[0]
    assert bytes(lines).decode() == ("text: a b\r\nflag: true\r\nletter: é\r\nsmall: 7\r\ncount: 18446744073709551615\r\nratio: -5\r\nmode: slow\r\ntag: x\r\ntag: y\r\nn: 1\r\nn: -2\r\n"
                                     "Own: 1\r\nOwn: 3\r\nother: 2\r\n")


@pytest.mark.parametrize("text, rest, code", [("a\nb: c", {}, "InvalidValue"), (" a", {}, "InvalidValue"), ("a", {"b c": ["1"]}, "InvalidName"), ("a", {"b": ["1"]}, None), (None, None, None)])
def test_what_cannot_be_written(spark, text, rest, code):
    df = spark.createDataFrame([(text, rest)], "text string, rest map<string, array<string>>").select(F.struct("text").alias("v"), "rest")
    e = df.select(typed.write(F.col("v"), [Field("text")], F.col("rest"))["error"].alias("e")).first()["e"]
    assert (e and e["code"]) == code


def test_schemas(spark):
    with pytest.raises(ValueError):
        typed.read(F.col("f"), [Field("a"), Field("A")])
    r = spark.range(1).select(typed.read(F.array().cast(PAIRS), [], deny_unknown=True).alias("r")).first()["r"]
    assert r["error"] is None
