from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import judging, runs, traces


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize(spark):
    assert one(spark, "  Héllo,  WORLD_1! ", T.normalize) == "héllo world_1"


def test_shingles(spark):
    f = lambda c: T.shingles(T.words(T.normalize(c)), 3)
    assert one(spark, "a b c d", f) == ["a b c", "b c d"]
    assert one(spark, "a b", f) == ["a b"]
    assert one(spark, "", f) == []


def test_durations(spark):
    assert one(spark, "08:17:28", T.seconds_of) == 8 * 3600 + 17 * 60 + 28
    assert one(spark, "1:60:00", T.seconds_of) is None
    assert one(spark, "", T.seconds_of) is None
    assert one(spark, 3661, T.hms_of, "long") == "1:01:01"


def test_scrub_and_redact(spark):
    assert one(spark, "Accuracy 91.5% is Much Better, test_acc 3 précisacc 2x", T.scrub) == "[score] [n] is [redacted], [score] [n] précisacc 2x"
    assert one(spark, None, T.short_field) == "" and one(spark, "  a\n b % c ", T.short_field) == "a b c"
    assert one(spark, "k sk-live-abcd1 x", lambda c: T.redact(c, "sk-live-abcdefgh")) == "k [REDACTED] x"


def test_verdict_takes_the_last_match(spark):
    assert one(spark, "first [[A>B]] then [[b>>a]]", T.verdict) == "B>>A"
    assert one(spark, "none", T.verdict) is None


def test_think(spark):
    assert one(spark, "<think>x</think> y", lambda c: T.strip_think(c, True)) == "y"
    assert one(spark, "<think>x", lambda c: T.strip_think(c, True)) == "<think>x"


def test_repetitions_are_a_fixpoint():
    x = "ab" * 50 + "\n" + "same\n" * 20 + "end"
    once = T._limit(x)
    assert T._limit(once) == once
    assert once.count("abab") == 5 and once.count("same") == 5


def test_call_literals():
    assert T._call("f(a=1, b=(2, [3]))") == '{"args": {"a": 1, "b": [2, [3]]}, "name": "f"}'
    assert T._call("f(") is None


def test_fallback_and_flags(spark):
    cells = spark.createDataFrame([("m", "b", "0.5", ""), ("m", "c", "ERR", ""), ("m", "d", "0.9", "C")], "model string, benchmark string, value_str string, flag string")
    base = spark.createDataFrame([("m", x, 0.1) for x in "bcd"], "model string, benchmark string, value double")
    got = {r["benchmark"]: (r["value"], r["origin"]) for r in runs.fallback(cells, base, ["model", "benchmark"]).collect()}
    assert got == {"b": (0.5, "run"), "c": (0.1, "baseline"), "d": (0.1, "baseline")}


def test_battles(spark):
    g = spark.createDataFrame([("u", "A>>B", "B>>A"), ("u", None, "A=B")], "u string, g0 string, g1 string")
    assert [r["score"] for r in judging.battles(g, ["u"], "g0", "g1").collect()] == [0.0] * 6


def test_lineage(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id int, up int")
    assert {tuple(r) for r in traces.descend(n, "id", "up").collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2)}
