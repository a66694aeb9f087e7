"""What must not grow with the input faster than it, in small."""

import random
import re

from pyspark.sql import functions as F

from tallyspark.operators import audit, judging
from tallyspark.plans import catalogue, files
from tallyspark.plans.base import Tables
from tallyspark.sources import places, readers

SF = "/root/testdata/sf0.001"


def test_answers_are_written_by_executors(spark, monkeypatch):
    def through_the_driver(*args, **kw):
        raise AssertionError("lines go through the driver")

    monkeypatch.setattr(places, "put", through_the_driver)
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", through_the_driver)
    t = Tables(spark, SF)
    n = t("events").count()
    assert files._answers(t).count() == n
    assert catalogue.QUERIES["answers_by_question"](spark, SF).count() == n


def test_the_last_line_wins_over_files_of_one_stem(spark):
    root = places.shared_folder(spark, "stems")
    places.put(spark, f"{root}/a/m.jsonl", '{"uid": 1, "value": 1}\n{"uid": 1, "value": 2}\n{"uid": 2, "value": 3}\n')
    places.put(spark, f"{root}/b/m.jsonl", '{"uid": 1, "value": 4}\n')
    got = {(r["model"], r["uid"], r["value"]) for r in readers.jsonl_by_stem(spark, f"{root}/*/*.jsonl", "uid LONG, value DOUBLE", "uid").collect()}
    assert got == {("m", 1, 4.0), ("m", 2, 3.0)}


def _plain(messages, tests, n=8, least=3):
    """Violations of (row, message_index, role, content) in plain Python: (row, message_index or None, kind, test, overlap)."""
    words = lambda t: re.sub(r"[^\w\s]", " ", (t or "").lower()).split()
    grams = lambda w: {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    def best(text):
        w = words(text)
        if any(words(t) == w for _, t in tests):
            return ("exact", None, 0)
        found = [(-len(grams(w) & grams(words(t))), i) for i, t in tests]
        found = [x for x in found if x[0] <= -least]
        return ("ngram", min(found)[1], -min(found)[0]) if found else None

    out = {(r, i, *v) for r, i, _, c in messages if c and (v := best(c))}
    clean = {m[0] for m in messages} - {x[0] for x in out}
    for r in clean:
        v = best("\n".join(c or "" for x, _, _, c in sorted(messages, key=lambda m: m[1]) if x == r))
        if v:
            out.add((r, None, *v))
    return out


def test_violations_over_turns_as_plain_python_finds_them(spark):
    g = random.Random(5)
    tests = [(i, " ".join(g.choice("abcdefghij") * 3 for _ in range(k))) for i, k in enumerate((0, 3, 8, 9, 12, 15, 30, 40))]
    messages = []
    for row in range(300):
        cut = [w for _ in range(g.randrange(1, 4)) for w in (g.choice(tests)[1].split(" ")[g.randrange(5) :] if g.random() < 0.6 else [g.choice("klmnop") for _ in range(g.randrange(20))])]
        at = sorted(g.randrange(len(cut) + 1) for _ in range(g.randrange(6)))
        parts = [cut[a:b] for a, b in zip([0, *at], [*at, len(cut)], strict=True)]
        messages += [(row, i, "user", None if g.random() < 0.02 else " ".join(p)) for i, p in enumerate(parts)]
    want = _plain(messages, tests)
    assert {x[2] for x in want if x[1] is None} == {"exact", "ngram"}
    m = spark.createDataFrame(messages, "row long, message_index long, role string, content string").repartition(3)
    got = audit.decontam_violations(m, spark.createDataFrame(tests, "item_id long, text string"), first=None).collect()
    assert {(r["row"], r["message_index"], r["kind"], r["test_id"], r["overlap"]) for r in got} == want and len(got) == len(want)


def test_only_rows_that_can_hold_a_hit_are_put_together(spark, monkeypatch):
    counts, written = {}, audit._written

    def counted(df, label):
        out = written(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(audit, "_written", counted)
    t = Tables(spark, SF)
    audit.decontam_violations(catalogue.chats(t), t("benchmark"), first=None).count()
    assert counts["whole"] < t("documents").count() / 2


def test_resampled_means_do_not_depend_on_partitions_and_are_poisson(spark):
    rows = [(k, float(v)) for k in (1, 2, None) for v in (0, 0, 0.5, 1, 1, 1)] + [(9, float(i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, score double")
    one, two = ({(r["k"], r["round"]): (round(r["s"], 6), r["w"]) for r in judging._resampled(df.repartition(n), "k", "score", 400, 7).collect()} for n in (1, 5))
    assert one == two and len(one) == 4 * 400
    w = [v[1] for (k, _), v in one.items() if k == 9]
    mean = sum(w) / 400
    assert abs(mean - 2000) < 15 and 1500 < sum((x - mean) ** 2 for x in w) / 400 < 2600
    r = {x["k"]: x for x in judging.bootstrap(df, "k").collect()}[9]
    assert abs(r["mean"] - 0.5) < 0.01 and abs(r["q95"] - r["q05"] - 2 * 1.645 * 0.5 / 2000**0.5) < 0.012


def test_the_limiter_gets_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str((1 << 31) - 64))
        catalogue.QUERIES["repetition_limiter"](spark, SF)
        size = F.pandas_udf(lambda x: x.map(lambda _: sum(map(len, x))), "long")
        d = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        assert d.select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 8 << 20
    finally:
        spark.conf.set(name, before)


def test_tfidf_keeps_one_row_a_text_and_merges_equal_keys(spark, monkeypatch):
    counts, written = {}, audit._written

    def counted(df, label):
        out = written(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(audit, "_written", counted)
    d = lambda rows: spark.createDataFrame(rows, "k long, text string")
    far = audit.tfidf_distance(d([(1, "aa bb aa"), (2, "bb cc"), (3, None), (None, "a b"), (4, "cc dd")]), "k").first()
    assert counts["terms"] == 3 and far["n"] == 5 and 0 < far["mean_cos_dist"] < 1
    assert audit.tfidf_distance(d([]), "k").first()["mean_cos_dist"] == 0.0
    one = audit.tfidf_distance(d([(1, "aa bb"), (1, "bb cc"), (2, "aa cc")]), "k").first()["mean_cos_dist"]
    two = audit.tfidf_distance(d([(1, "aa bb bb cc"), (1, None), (2, "aa cc")]), "k").first()["mean_cos_dist"]
    assert abs(one - two) < 1e-9
