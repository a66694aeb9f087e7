"""Training-data audit: decontamination joins, diversity, chat validation, the gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, shingles, words
from ..sources.places import shared_folder
from .runs import seeded_sample

#: Shingle length, shared shingles of a hit, reported violations and least rows; fixed values.
SHINGLE_N, MIN_SHARED, REPORTED, MIN_ROWS = 8, 3, 10, 50
#: Least diversity of a training set, and the rows sampled for it; fixed values.
DIVERSITY = {"distinct_1g": 0.03, "distinct_4g": 0.30, "mean_cos_dist": 0.35, "len_cv": 0.15}
DIVERSITY_SAMPLE = 500


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, for frames that several aggregates read."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hashes(d: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hs): the hash of every word, in order."""
    w = d.select(*keys, words(normalize(F.col(text))).alias("w"))
    return w.select(*keys, F.transform("w", lambda x: F.xxhash64(x)).alias("hs"))


def _blocks(hs: Column, n: int, step: int) -> Column:
    """Hashes of runs of n // 2 + 1 words, from every ``step``-th word."""
    size = n // 2 + 1
    many = F.transform(F.sequence(F.lit(1), F.size(hs) - (size - 1), F.lit(step)), lambda i: F.xxhash64(F.slice(hs, i, size)))
    return F.when(F.size(hs) >= size, many).otherwise(F.array().cast("array<bigint>"))


def _last(hs: Column, n: int) -> Column:
    return F.slice(hs, F.greatest(F.size(hs) - (n - 1), F.lit(1)), n)


def _outline(d: DataFrame, keys: list[str], text: str, n: int, step: int) -> DataFrame:
    """(keys, size, edge, blocks) of every text.

    ``size``: its words; ``edge``: hashes of its first and last n - 1 words with a 0 between, of all words where
    they are few; ``blocks``: a run of n words holds one of them whole, so texts that share such a run share a block
    with all blocks of the other."""
    h = _hashes(d, keys, text).withColumn("hs", F.coalesce("hs", F.array().cast("array<bigint>")))
    edge = F.when(F.size("hs") <= 2 * (n - 1), F.col("hs")).otherwise(F.concat(F.slice("hs", 1, n - 1), F.array(F.lit(0).cast("long")), _last(F.col("hs"), n - 1)))
    return h.select(*keys, F.size("hs").cast("long").alias("size"), edge.alias("edge"), _blocks(F.col("hs"), n, step).alias("blocks"))


def _marks(n: int) -> Column:
    """What an outline is looked up by: its blocks, and one for the whole text by its size and both ends."""
    whole = F.xxhash64("size", F.slice("edge", 1, n - 1), _last(F.col("edge"), n - 1))
    return F.concat("blocks", F.array(whole))


def _test_marks(tests: DataFrame, n: int) -> DataFrame:
    return _written(_outline(tests, [], "text", n, 1).select(F.explode(_marks(n)).alias("h")).distinct(), "marks")


def _suspects(outlines: DataFrame, marks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys of outlines with a test's mark: all that can equal a test or share n words in a row with one, and a few others."""
    return outlines.select(*keys, F.explode(_marks(n)).alias("h")).join(marks, "h", "left_semi").select(*keys).distinct()


def _of(texts: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """The texts of some keys; null is a key."""
    return texts.alias("a").join(some.alias("m"), [F.col(f"a.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left_semi")


def _suspected(texts: DataFrame, tests: DataFrame, keys: list[str], text: str, n: int = SHINGLE_N) -> DataFrame:
    """The texts that can meet a test at all, as a table; the others are normalised once and never moved."""
    found = _suspects(_outline(texts, keys, text, n, n - n // 2), _test_marks(tests, n), keys, n)
    return _written(_of(texts, _written(found, "suspects"), keys), "suspected")


def ngram_overlap(texts: DataFrame, tests: DataFrame, keys: list[str], text: str = "text", n: int = SHINGLE_N, least: int = MIN_SHARED) -> DataFrame:
    """(keys, item_id, overlap): rows that share ``least`` shingles or more with a test item.

    A first pass looks up hashes of one run of words in several and keeps the keys of texts with a hit; those few
    texts are then shingled and met exactly.  The joins' build sides are left to Spark, which broadcasts the
    tests only below its own threshold."""
    return _overlap(_suspected(texts, tests, keys, text, n), tests, keys, text, n, least)


def _overlap(texts: DataFrame, tests: DataFrame, keys: list[str], text: str, n: int = SHINGLE_N, least: int = MIN_SHARED) -> DataFrame:
    sh = lambda d, ks, t: d.select(*ks, words(normalize(F.col(t))).alias("w")).select(*ks, F.explode(shingles(F.col("w"), n)).alias("g"))
    both = sh(texts, keys, text).join(sh(tests, ["item_id"], "text"), "g")
    return both.groupBy(*keys, "item_id").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)


def exact_match(texts: DataFrame, tests: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows whose normalised text is a test item's; smallest item wins."""
    sha = lambda c: F.sha2(normalize(F.col(c)), 256)
    t = tests.select(sha("text").alias("sha"), "item_id").groupBy("sha").agg(F.min("item_id").alias("item_id"))
    return texts.where(F.col(text).isNotNull()).select(*keys, sha(text).alias("sha")).join(t, "sha").select(*keys, "item_id", "sha")


def violations(texts: DataFrame, tests: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, item_id, overlap): exact matches first, then the best shingle hit of the others."""
    return _violations(_suspected(texts, tests, keys, text), tests, keys, text)


def _violations(texts: DataFrame, tests: DataFrame, keys: list[str], text: str) -> DataFrame:
    exact = exact_match(texts, tests, keys, text).select(*keys, F.lit("exact").alias("kind"), "item_id", F.lit(0).cast("long").alias("overlap"))
    rest = texts.join(exact.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(F.col("overlap").desc(), "item_id")
    best = _overlap(rest, tests, keys, text).withColumn("n", F.row_number().over(w)).where("n = 1")
    return exact.unionByName(best.select(*keys, F.lit("ngram").alias("kind"), "item_id", "overlap"))


def decontam_violations(messages: DataFrame, tests: DataFrame, first: int | None = REPORTED) -> DataFrame:
    """The first violations in (row, message) order: (row, scope, role, message_index, first_80, kind, test_id, overlap).

    ``messages``: (row, message_index, role, content).  Each message is scanned alone; of rows without a hit
    all messages together, joined by line breaks, so a text split over turns is found.

    All messages are normalised once, to outlines.  The outlines' edges, joined by row, hold every run of n words
    that crosses messages, so texts are only brought together of rows that can hold a hit."""
    hit = lambda v: v.withColumnsRenamed({"item_id": "test_id"}).withColumn("test_id", F.when(F.col("kind") == "ngram", F.col("test_id")))
    keys, n = ["row", "message_index"], SHINGLE_N
    step, marks = n - n // 2, _test_marks(tests, n)
    outlines = _written(_outline(messages, keys, "content", n, step), "outlines")
    alone = _written(_suspects(outlines, marks, keys, n), "suspects")
    parts = F.array_sort(F.collect_list(F.struct("message_index", "edge")))
    joined = outlines.groupBy("row").agg(F.sum("size").alias("size"), parts.alias("parts")).withColumn("edge", F.flatten(F.transform("parts", lambda m: m["edge"])))
    together = _suspects(joined.withColumn("blocks", _blocks(F.col("edge"), n, step)), marks, ["row"], n)
    # Messages of one index are put in order by their contents, which an outline does not have.
    tied = joined.where(F.size(F.array_distinct(F.transform("parts", lambda m: m["message_index"]))) < F.size("parts"))
    rows = _written(alone.select("row").unionByName(together).unionByName(tied.select("row")).distinct(), "rows")
    messages = _written(_of(messages, rows, ["row"]), "messages")
    some = _of(messages.where("content <> ''"), alone, keys)
    one = _written(hit(_violations(some, tests, keys, "content")).join(messages, keys), "hits")
    rest = messages.join(one.select("row").distinct(), "row", "left_anti")
    turns = F.array_sort(F.collect_list(F.struct("message_index", F.coalesce("content", F.lit("")).alias("content"))))
    whole = rest.groupBy("row").agg(F.array_join(F.transform(turns, lambda m: m["content"]), "\n").alias("content"))
    whole = _written(whole, "whole")
    all_ = hit(_violations(whole, tests, ["row"], "content")).join(whole, "row")
    cols = lambda scope, role, at: [F.col("row"), F.lit(scope).alias("scope"), role.alias("role"), at.alias("message_index"), F.substring("content", 1, 80).alias("first_80"), "kind", "test_id", "overlap"]
    none = F.lit(None).cast("string")
    both = one.select(*cols("per_message", F.col("role"), F.col("message_index"))).unionByName(all_.select(*cols("combined_all_messages", none, F.lit(None).cast(messages.schema["message_index"].dataType))))
    return both.orderBy("row", F.col("message_index").asc_nulls_last()).limit(first) if first else both


def decontam_report(messages: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: whether no violation was found, how many are reported, the tests and the threshold."""
    v = decontam_violations(messages, tests).agg(F.count(F.lit(1)).alias("n_reported"))
    t = tests.agg(F.count_distinct(F.sha2(normalize(F.col("text")), 256)).alias("test_items_loaded"))
    return v.crossJoin(t).select((F.col("n_reported") == 0).alias("pass"), "n_reported", "test_items_loaded", F.lit(MIN_SHARED).alias("shingle_overlap_threshold"))


def distinct_ratios(texts: DataFrame, sizes: tuple[int, ...], text: str = "text") -> DataFrame:
    """(n, n_distinct, n_all, ratio) of n-grams for each size, 0 when there are none; one scan.

    N-grams are told apart by 64-bit hashes of their words' 64-bit hashes, with 32 further bits of another hash."""
    grams = lambda n: F.when(F.size("hs") >= n, F.transform(F.sequence(F.lit(1), F.size("hs") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("hs", i, n)).alias("h"), F.hash(F.slice("hs", i, n)).alias("k"))))
    g = _hashes(texts, [], text).select(F.explode(F.flatten(F.array_compact(F.array(*map(grams, sizes))))).alias("g"))
    c = g.select("g.*").groupBy("n", "h", "k").agg(F.count(F.lit(1)).alias("c"))
    found = c.groupBy("n").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("a"))
    wanted = texts.sparkSession.createDataFrame([(n,) for n in sizes], "n int")
    out = wanted.join(found, "n", "left").select("n", F.coalesce("d", F.lit(0)).alias("n_distinct"), F.coalesce("a", F.lit(0)).alias("n_all"))
    return out.withColumn("ratio", F.when(F.col("n_all") > 0, F.col("n_distinct") / F.col("n_all")).otherwise(0.0))


def length_cv(texts: DataFrame, text: str = "text") -> DataFrame:
    """Population standard deviation of the word count over its mean."""
    w = texts.select(F.size(words(normalize(F.col(text)))).alias("n"))
    return w.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.when(F.avg("n") > 0, F.stddev_pop("n") / F.avg("n")), F.lit(0.0)).alias("length_cv"))


def tfidf_distance(texts: DataFrame, key: str, text: str = "text", features: int = 10_000) -> DataFrame:
    """Mean pairwise TF-IDF cosine distance in closed form: 1 - (|sum v|^2 - sum |v|^2) / (n (n - 1)).

    Words of two characters or more, smooth idf ln((1 + n) / (1 + df)) + 1, rows of length one; the
    vocabulary is the most frequent ``features`` words (ties by word)."""
    long = F.filter(words(normalize(F.col(text))), lambda w: F.length(w) >= 2)
    # Texts are dealt by key once; words are counted and put together where they lie, and no word is dealt again.
    tf = texts.select(key, text).repartition(key).select(key, F.explode(long).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("tf"))
    terms = _written(tf.groupBy(key).agg(F.collect_list(F.struct("w", "tf")).alias("v")).select("v"), "terms")
    vocabulary = terms.select(F.explode("v").alias("v")).groupBy(F.col("v.w").alias("w")).agg(F.sum("v.tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.col("total").desc(), "w").limit(features)
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    # At most ``features`` words, so every task has the list and sums its texts' vectors into one.
    known = vocabulary.crossJoin(n).select("w", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    names, idf = [r["w"] for r in known], np.array([r["idf"] for r in known], float)

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        total, rows, index = np.zeros(len(idf)), 0, pa.array(names, pa.string())
        for b in batches:
            v = b.column("v")
            place = pc.index_in(v.flatten().field("w").cast(pa.string()), index)
            use = pc.is_valid(place).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(v)), pc.list_value_length(v).to_numpy(zero_copy_only=False))[use]
            at = place.drop_null().to_numpy()
            x = v.flatten().field("tf").to_numpy()[use] * idf[at]
            norm = np.sqrt(np.bincount(row, x * x, len(v)))
            total += np.bincount(at, x / norm[row], len(idf))
            rows += int((norm > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(idf), dtype=np.int32)), pa.array(np.concatenate(([rows], total)))], ["i", "s"])

    s = terms.mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    sums_ = s.agg(F.sum(F.when(F.col("i") >= 0, F.col("s") * F.col("s"))).alias("whole"), F.max(F.when(F.col("i") < 0, F.col("s"))).alias("rows"))
    dist = 1 - (F.coalesce("whole", F.lit(0.0)) - F.coalesce("rows", F.lit(0.0))) / (F.col("n") * (F.col("n") - 1))
    return n.crossJoin(sums_).select("n", F.when(F.col("n") > 1, dist).otherwise(0.0).alias("mean_cos_dist"))


def duplicate_groups(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    d = texts.select(key, F.sha2(normalize(F.col(text)), 256).alias("sha")).groupBy("sha")
    return d.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def chat_violations(chats: DataFrame, key: str) -> DataFrame:
    """(key, reason) of chats that break the schema, the first rule broken."""
    has = lambda r: F.coalesce(F.exists("messages", lambda m: m["role"] == r), F.lit(False))
    reason = (F.when(F.col("messages").isNull() | (F.size("messages") < 2), "too_few_messages").when(~has("user"), "no_user").when(~has("assistant"), "no_assistant")
              .when(F.exists("messages", lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == ""), "empty_content"))
    return chats.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def as_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    m = F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def user_text(chats: DataFrame, key: str) -> DataFrame:
    """User turns, and all turns, joined by a line break."""
    join = lambda a: F.array_join(F.transform(a, lambda m: m["content"]), "\n")
    return chats.select(key, join(F.filter("messages", lambda m: m["role"] == "user")).alias("user_text"), join(F.col("messages")).alias("all_text"))


def gate(metrics: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """``pass`` and the list of failed limits; limits: column to (bound, 'min' or 'max')."""
    tests = [F.when(F.col(c) < b if kind == "min" else F.col(c) > b, F.lit(c)) for c, (b, kind) in sorted(limits.items())]
    return metrics.withColumn("failures", F.array_join(F.array_compact(F.array(*tests)), ",")).withColumn("pass", F.col("failures") == "")


def diversity(texts: DataFrame, key: str, text: str = "text", sample: int = DIVERSITY_SAMPLE, seed: int = 42) -> DataFrame:
    """One row with the four diversity measures of a training set's user texts; the distance is that of a seeded sample."""
    ratios = distinct_ratios(texts, (1, 4), text).agg(F.max(F.when(F.col("n") == 1, F.col("ratio"))).alias("distinct_1g"), F.max(F.when(F.col("n") == 4, F.col("ratio"))).alias("distinct_4g"))
    some = _written(seeded_sample(texts.select(key, text), [key], sample, seed), "sample")
    far = tfidf_distance(some, key, text).select("mean_cos_dist", F.col("n").alias("sample_size"))
    spread = length_cv(texts, text).select("n_rows", F.col("length_cv").alias("len_cv"))
    return ratios.crossJoin(far).crossJoin(spread)


def diversity_gate(texts: DataFrame, key: str, text: str = "text", limits: dict[str, float] = DIVERSITY, **kw) -> DataFrame:
    """``diversity`` with the failed limits and the verdict."""
    return gate(diversity(texts, key, text, **kw), {c: (b, "min") for c, b in limits.items()})


def training_set_gate(messages: DataFrame, tests: DataFrame, limits: dict[str, float] = DIVERSITY, rows: int = MIN_ROWS) -> DataFrame:
    """The whole gate, one row: enough rows, no benchmark text in any message, diverse user texts.

    ``messages``: (row, message_index, role, content)."""
    messages = _written(messages, "chats")
    turns = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("message_index", F.coalesce("content", F.lit("")).alias("content")))))
    users = messages.groupBy("row").agg(F.array_join(F.transform(turns, lambda m: m["content"]), "\n").alias("text"))
    d = diversity_gate(_written(users, "users"), "row", limits=limits).withColumnsRenamed({"failures": "diversity_failures", "pass": "diversity_pass"})
    c = decontam_report(messages, tests).withColumnRenamed("pass", "decontam_pass")
    return d.crossJoin(c).withColumn("pass", (F.col("n_rows") >= rows) & F.col("decontam_pass") & F.col("diversity_pass"))
