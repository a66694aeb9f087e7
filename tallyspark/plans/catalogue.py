"""The queries of the engine bound to the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, judging, runs, traces
from ..sources import places, readers
from .base import QUERIES, SQL, query, r6

#: The SQL form of ``normalize`` and of word lists, used by several queries.
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = "CASE WHEN {0} = '' THEN []::VARCHAR[] ELSE string_split({0}, ' ') END"


def _shingle_cte(name: str, table: str, keys: str) -> str:
    return f"""{name}_n AS (SELECT {keys}, {_NORM.format('text')} AS t FROM {table}),
{name}_w AS (SELECT {keys}, {_WORDS.format('t')} AS w FROM {name}_n),
{name} AS (SELECT DISTINCT {keys}, g FROM (SELECT {keys}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 8 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')) END) AS g FROM {name}_w))"""


@query(f"WITH {_shingle_cte('a', 'documents', 'doc_id')}, {_shingle_cte('b', 'benchmark', 'item_id')} SELECT doc_id, item_id, COUNT(*) AS overlap FROM a JOIN b USING (g) GROUP BY ALL HAVING COUNT(*) >= 3")
def decontam_ngram_overlap(t) -> DataFrame:
    return audit.ngram_overlap(t("documents"), t("benchmark"), ["doc_id"])


@query(f"""WITH b AS (SELECT sha256({_NORM.format('text')}) AS sha, MIN(item_id) AS item_id FROM benchmark GROUP BY 1), d AS (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + item_id, '  ' || text || ' !' FROM benchmark)
SELECT doc_id, item_id, sha FROM (SELECT doc_id, sha256({_NORM.format('text')}) AS sha FROM d) JOIN b USING (sha)""")
def decontam_exact_sha(t) -> DataFrame:
    """Documents, and the benchmark's own texts with other marks, against the benchmark by normalised hash."""
    quoted = t("benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.concat(F.lit("  "), "text", F.lit(" !")).alias("text"))
    return audit.exact_match(t("documents").select("doc_id", "text").unionByName(quoted), t("benchmark"), ["doc_id"])


#: Chats that quote the benchmark: conversations; items asked as they are; items split over two turns; documents as answers.
_CHATS = """msgs AS (SELECT conv_id AS row, turn AS message_index, role, text FROM conversations
 UNION ALL SELECT 1000000000 + item_id, 0, 'user', text FROM benchmark UNION ALL SELECT 1000000000 + item_id, 1, 'assistant', 'ok' FROM benchmark
 UNION ALL SELECT 2000000000 + item_id, 0, 'user', array_to_string(list_slice(string_split(text, ' '), 1, 9), ' ') FROM benchmark
 UNION ALL SELECT 2000000000 + item_id, 1, 'assistant', array_to_string(list_slice(string_split(text, ' '), 10, 18), ' ') FROM benchmark
 UNION ALL SELECT 3000000000 + doc_id, 0, 'user', 'Go on' FROM documents UNION ALL SELECT 3000000000 + doc_id, 1, 'assistant', text FROM documents)"""


def chats(t) -> DataFrame:
    """(row, message_index, role, content): ``_CHATS`` as a frame."""
    m = lambda d, row, at, role, content: d.select(row.cast("long").alias("row"), F.lit(at).cast("long").alias("message_index"), F.lit(role).alias("role"), content.alias("content"))
    b, d, item = t("benchmark"), t("documents"), F.col("item_id")
    part = lambda a: F.array_join(F.slice(F.split("text", " "), a, 9), " ")
    own = t("conversations").select(F.col("conv_id").alias("row"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"))
    parts = [m(b, item + 1_000_000_000, 0, "user", F.col("text")), m(b, item + 1_000_000_000, 1, "assistant", F.lit("ok")),
             m(b, item + 2_000_000_000, 0, "user", part(1)), m(b, item + 2_000_000_000, 1, "assistant", part(10)),
             m(d, F.col("doc_id") + 3_000_000_000, 0, "user", F.lit("Go on")), m(d, F.col("doc_id") + 3_000_000_000, 1, "assistant", F.col("text"))]
    for p in parts:
        own = own.unionByName(p)
    return own


def _hits_sql(name: str, table: str, keys: str) -> str:
    """CTEs up to ``name`` (keys, kind, item_id, overlap): exact matches of a table of texts, else the best of its shingle matches."""
    on = " AND ".join(f"e.{k} = o.{k}" for k in keys.split(", "))
    return f"""{name}_e AS (SELECT DISTINCT {keys} FROM {table} JOIN (SELECT DISTINCT {_NORM.format('text')} AS n FROM benchmark) b ON {_NORM.format(table + '.text')} = b.n),
{_shingle_cte(name + '_s', table, keys)}, {_shingle_cte(name + '_b', 'benchmark', 'item_id')},
{name}_o AS (SELECT {keys}, item_id, COUNT(*) AS overlap FROM {name}_s JOIN {name}_b USING (g) GROUP BY ALL HAVING COUNT(*) >= 3),
{name} AS (SELECT {keys}, 'exact' AS kind, NULL::BIGINT AS item_id, 0::BIGINT AS overlap FROM {name}_e
 UNION ALL SELECT {keys}, 'ngram', item_id, overlap FROM {name}_o o WHERE NOT EXISTS (SELECT 1 FROM {name}_e e WHERE {on}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY overlap DESC, item_id) = 1)"""


_VIOLATIONS = f"""{_CHATS}, said AS (SELECT * FROM msgs WHERE text <> ''), {_hits_sql('one', 'said', 'row, message_index')},
rest AS (SELECT row, string_agg(COALESCE(text, ''), chr(10) ORDER BY message_index) AS text FROM msgs WHERE row NOT IN (SELECT row FROM one) GROUP BY row), {_hits_sql('whole', 'rest', 'row')},
found AS (SELECT row, 'per_message' AS scope, role, message_index, substr(text, 1, 80) AS first_80, kind, item_id AS test_id, overlap FROM one JOIN msgs USING (row, message_index)
 UNION ALL SELECT row, 'combined_all_messages', NULL, NULL, substr(text, 1, 80), kind, item_id, overlap FROM whole JOIN rest USING (row))"""


@query(f"WITH {_CHATS}, said AS (SELECT * FROM msgs WHERE text <> ''), {_hits_sql('one', 'said', 'row, message_index')} SELECT * FROM one")
def decontam_messages(t) -> DataFrame:
    v = audit.violations(chats(t).where("content <> ''"), t("benchmark"), ["row", "message_index"], "content")
    return v.withColumn("item_id", F.when(F.col("kind") == "ngram", F.col("item_id")))


@query(f"WITH {_VIOLATIONS} SELECT * FROM found ORDER BY row, message_index NULLS LAST LIMIT 10")
def decontam_first_violations(t) -> DataFrame:
    return audit.decontam_violations(chats(t), t("benchmark"))


@query(f"WITH {_VIOLATIONS} SELECT scope, kind, COUNT(*) AS n, SUM(overlap)::BIGINT AS overlaps FROM found GROUP BY scope, kind")
def decontam_all_violations(t) -> DataFrame:
    """Every violation, message by message and over whole rows, counted by scope and kind."""
    return audit.decontam_violations(chats(t), t("benchmark"), first=None).groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("overlaps"))


@query(f"WITH {_VIOLATIONS} SELECT COUNT(*) = 0 AS pass, least(COUNT(*), 10) AS n_reported, (SELECT COUNT(DISTINCT {_NORM.format('text')}) FROM benchmark) AS test_items_loaded, 3 AS shingle_overlap_threshold FROM found")
def decontam_report(t) -> DataFrame:
    return audit.decontam_report(chats(t), t("benchmark"))


def _ratio_sql(n: int, table: str = "documents") -> str:
    return f"""SELECT {n} AS n, COUNT(DISTINCT g) AS n_distinct, COUNT(g) AS n_all, round(CASE WHEN COUNT(g) > 0 THEN COUNT(DISTINCT g) / COUNT(g)::DOUBLE ELSE 0 END, 6) AS ratio FROM (
 SELECT unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) ELSE []::VARCHAR[] END) AS g FROM (SELECT {_WORDS.format('t')} AS w FROM (SELECT {_NORM.format('text')} AS t FROM {table})))"""


@query(f"{_ratio_sql(1)} UNION ALL {_ratio_sql(4)}")
def diversity_distinct_ngrams(t) -> DataFrame:
    return audit.distinct_ratios(t("documents"), (1, 4)).withColumn("ratio", r6("ratio"))


@query(f"SELECT COUNT(*) AS n_rows, round(stddev_pop(n) / avg(n), 6) AS length_cv FROM (SELECT len({_WORDS.format('t')}) AS n FROM (SELECT {_NORM.format('text')} AS t FROM documents))")
def diversity_length_cv(t) -> DataFrame:
    return audit.length_cv(t("documents")).withColumn("length_cv", r6("length_cv"))


def _distance_sql(table: str, key: str) -> str:
    """CTEs up to ``dist`` (n, d): the mean pairwise TF-IDF distance of a table's texts."""
    return f"""dw AS (SELECT {key}, unnest({_WORDS.format('t')}) AS w FROM (SELECT {key}, {_NORM.format('text')} AS t FROM {table})),
tf AS (SELECT {key}, w, COUNT(*) AS tf FROM dw WHERE length(w) >= 2 GROUP BY ALL),
vocabulary AS (SELECT w, SUM(tf) AS total, COUNT(*) AS df FROM tf GROUP BY w ORDER BY total DESC, w LIMIT 10000),
size AS (SELECT COUNT(*) AS n FROM {table}),
x AS (SELECT {key}, tf.w, tf * (ln((1 + (SELECT n FROM size)) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN vocabulary v ON tf.w = v.w),
m AS (SELECT {key}, sqrt(SUM(x * x)) AS norm FROM x GROUP BY {key}),
s AS (SELECT SUM(s * s) AS whole FROM (SELECT SUM(x / norm) AS s FROM x JOIN m USING ({key}) GROUP BY w)),
dist AS (SELECT n, 1 - (whole - (SELECT COUNT(*) FROM m)) / (n * (n - 1)) AS d FROM size, s)"""


@query(f"WITH {_distance_sql('documents', 'doc_id')} SELECT n, round(d, 6) AS mean_cos_dist FROM dist")
def tfidf_mean_cos_dist(t) -> DataFrame:
    return audit.tfidf_distance(t("documents"), "doc_id").withColumn("mean_cos_dist", r6("mean_cos_dist"))


def _gate_sql(table: str, key: str) -> str:
    """CTEs up to ``gate``: the four diversity measures of a table's texts, the failed limits, the verdict."""
    return f"""r1 AS ({_ratio_sql(1, table)}), r4 AS ({_ratio_sql(4, table)}), picked AS (SELECT {key}, text FROM {table} ORDER BY md5('42/' || {key}), {key} LIMIT 500),
{_distance_sql('picked', key)}, cv AS (SELECT COUNT(*) AS n_rows, stddev_pop(n) / avg(n) AS cv FROM (SELECT len({_WORDS.format('t')}) AS n FROM (SELECT {_NORM.format('text')} AS t FROM {table}))),
gate AS (SELECT *, array_to_string(list_filter([CASE WHEN distinct_1g < 0.03 THEN 'distinct_1g' END, CASE WHEN distinct_4g < 0.3 THEN 'distinct_4g' END, CASE WHEN len_cv < 0.15 THEN 'len_cv' END, CASE WHEN mean_cos_dist < 0.35 THEN 'mean_cos_dist' END], lambda v: v IS NOT NULL), ',') AS failures
 FROM (SELECT r1.ratio AS distinct_1g, r4.ratio AS distinct_4g, round(d, 6) AS mean_cos_dist, dist.n AS sample_size, n_rows, round(cv, 6) AS len_cv FROM r1, r4, dist, cv))"""


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({c: r6(c) for c in ("distinct_1g", "distinct_4g", "mean_cos_dist", "len_cv")})


@query(f"WITH {_gate_sql('documents', 'doc_id')} SELECT *, failures = '' AS pass FROM gate")
def diversity_gate(t) -> DataFrame:
    return _rounded(audit.diversity_gate(t("documents"), "doc_id"))


@query(f"""WITH {_VIOLATIONS}, users AS (SELECT row, COALESCE(string_agg(text, chr(10) ORDER BY message_index) FILTER (WHERE role = 'user'), '') AS text FROM msgs GROUP BY row), {_gate_sql('users', 'row')},
rep AS (SELECT COUNT(*) = 0 AS decontam_pass, least(COUNT(*), 10) AS n_reported, (SELECT COUNT(DISTINCT {_NORM.format('text')}) FROM benchmark) AS test_items_loaded, 3 AS shingle_overlap_threshold FROM found)
SELECT distinct_1g, distinct_4g, mean_cos_dist, sample_size, n_rows, len_cv, failures AS diversity_failures, failures = '' AS diversity_pass, rep.*, n_rows >= 50 AND decontam_pass AND failures = '' AS pass FROM gate, rep""")
def audit_gate(t) -> DataFrame:
    """The whole gate of a training set: rows, decontamination and the four diversity measures."""
    return _rounded(audit.training_set_gate(chats(t), t("benchmark")))


@query(f"SELECT sha256({_NORM.format('text')}) AS sha, COUNT(*) AS n, MIN(doc_id) AS first_id FROM documents GROUP BY 1 HAVING COUNT(*) > 1")
def exact_dup_groups(t) -> DataFrame:
    return audit.duplicate_groups(t("documents"), "doc_id")


@query("""SELECT conv_id, CASE WHEN COUNT(*) < 2 THEN 'too_few_messages' WHEN SUM((role = 'user')::INT) = 0 THEN 'no_user' WHEN SUM((role = 'assistant')::INT) = 0 THEN 'no_assistant' ELSE 'empty_content' END AS reason
FROM conversations GROUP BY conv_id HAVING COUNT(*) < 2 OR SUM((role = 'user')::INT) = 0 OR SUM((role = 'assistant')::INT) = 0 OR SUM((trim(COALESCE(text, '')) = '')::INT) > 0""")
def chat_schema_violations(t) -> DataFrame:
    return audit.chat_violations(audit.as_chats(t("conversations")), "conv_id")


@query("SELECT conv_id, COALESCE(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '') AS user_text, string_agg(text, chr(10) ORDER BY turn) AS all_text FROM conversations GROUP BY conv_id")
def user_turn_concat(t) -> DataFrame:
    return audit.user_text(audit.as_chats(t("conversations")), "conv_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE event_id >= 100 AND event_id < 1000000000) WHERE n = 1")
def latest_per_key(t) -> DataFrame:
    e = t("events").select("user_id", "event_type", "event_id", "value")
    return readers.latest_runs(e, ["user_id", "event_type"], "event_id", 100, 1_000_000_000)


@query("""SELECT n_name, p AS o_orderpriority, COUNT(o_orderkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders)
LEFT JOIN (SELECT o_orderkey, o_orderpriority, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000) ON c_nationkey = n_nationkey AND o_orderpriority = p GROUP BY ALL""")
def dense_grid_missing(t) -> DataFrame:
    big = t("orders").where("o_totalprice > 400000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = big.groupBy(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority").agg(F.count("o_orderkey").alias("n"))
    d = runs.dense(t("nation").select("n_nationkey", "n_name"), t("orders").select("o_orderpriority").distinct(), cells, ["n_nationkey", "o_orderpriority"])
    return d.select("n_name", "o_orderpriority", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH c AS (SELECT user_id, event_type, CASE WHEN COUNT(*) % 3 = 0 THEN 'ERR' ELSE CAST(COUNT(*) AS VARCHAR) END AS s, CASE WHEN SUM(event_id) % 5 = 0 THEN 'C' ELSE '' END AS flag FROM events GROUP BY ALL),
b AS (SELECT event_type, round(avg(value), 6) AS base FROM events GROUP BY 1)
SELECT user_id, event_type, CASE WHEN s = 'ERR' OR flag <> '' THEN base ELSE CAST(s AS DOUBLE) END AS value, CASE WHEN s = 'ERR' OR flag <> '' THEN 'baseline' ELSE 'run' END AS origin FROM c JOIN b USING (event_type)""")
def fallback_grid(t) -> DataFrame:
    e = t("events")
    c = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))
    c = c.select("user_id", "event_type", F.when(F.col("n") % 3 == 0, "ERR").otherwise(F.col("n").cast("string")).alias("value_str"), F.when(F.col("s") % 5 == 0, "C").otherwise("").alias("flag"))
    base = e.groupBy("event_type").agg(r6(F.avg("value")).alias("value"))
    every = c.join(base, "event_type").select("user_id", "event_type", "value")
    return runs.fallback(c, every, ["user_id", "event_type"])


@query("SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS click, COUNT(*) FILTER (WHERE event_type = 'error') AS error, COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase, COUNT(*) FILTER (WHERE event_type = 'signup') AS signup, COUNT(*) FILTER (WHERE event_type = 'view') AS \"view\" FROM events GROUP BY user_id")
def score_grid_pivot(t) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    return runs.pivoted(t("events"), "user_id", "event_type", F.count(F.lit(1)), names).fillna(0, names)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, COUNT(l_quantity) AS n FROM lineitem GROUP BY ALL")
def percell_mean_std(t) -> DataFrame:
    return runs.mean_std(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumns({"mean": r6("mean"), "std": r6("std")})


@query("""WITH m AS (SELECT c_nationkey, o_orderpriority, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('1-URGENT', 0.4), ('2-HIGH', 0.3), ('3-MEDIUM', 0.15), ('4-NOT SPECIFIED', 0.1), ('5-LOW', 0.05)) AS x(p, factor))
SELECT c_nationkey, round(SUM(m * factor::DOUBLE), 4) AS score FROM m JOIN f ON o_orderpriority = p GROUP BY c_nationkey""")
def weighted_leaderboard(t) -> DataFrame:
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority", F.col("o_totalprice").alias("value"))
    f = o.sparkSession.createDataFrame([("1-URGENT", 0.4), ("2-HIGH", 0.3), ("3-MEDIUM", 0.15), ("4-NOT SPECIFIED", 0.1), ("5-LOW", 0.05)], "o_orderpriority string, factor double")
    return runs.weighted(o, f, "c_nationkey", "o_orderpriority").withColumn("score", F.round("score", 4))


@query("SELECT user_id, round(SUM(v) + (COUNT(*) - COUNT(v)) * avg(v), 6) AS total, COUNT(v) AS n_valid, COUNT(*) - COUNT(v) AS n_missing FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY user_id HAVING COUNT(v) > 0")
def mean_imputed_total(t) -> DataFrame:
    e = t("events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return runs.imputed_total(e, ["user_id"], "v").withColumn("total", r6("total"))


@query("""SELECT key, round(avg(v), 6) AS mean, round(COALESCE(stddev_samp(v), 0), 6) AS std, round(COALESCE(stddev_samp(v), 0) / sqrt(COUNT(v)), 6) AS stderr, MIN(v) AS min, MAX(v) AS max, COUNT(v) AS n
FROM (SELECT 'discount' AS key, l_discount AS v FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY key""")
def metrics_run_summary(t) -> DataFrame:
    d = t("lineitem").select(F.explode(F.create_map(F.lit("discount"), "l_discount", F.lit("quantity"), "l_quantity", F.lit("tax"), "l_tax")).alias("key", "v"))
    return runs.summary(d, "key", "v").withColumns({"mean": r6("mean"), "std": r6("std"), "stderr": r6("stderr")})


_LABEL = "CASE event_type WHEN 'click' THEN 'A>>B' WHEN 'view' THEN 'A>B' WHEN 'signup' THEN 'A=B' WHEN 'purchase' THEN 'B>A' END"


def _battles(t) -> DataFrame:
    e = t("events").select("user_id", F.expr(_LABEL).alias("g0"), F.expr(_LABEL.replace("A>>B", "X").replace("B>A", "A>>B").replace("X", "B>>A")).alias("g1"))
    return judging.battles(e, ["user_id"], "g0", "g1")


@query("""WITH s AS (SELECT user_id, unnest(CASE event_type WHEN 'click' THEN [0.0, 0.0, 0.0, 0.0, 0.0, 0.0] WHEN 'view' THEN [1.0, 0.0] WHEN 'signup' THEN [0.5, 0.5] WHEN 'purchase' THEN [1.0, 1.0, 1.0, 1.0] ELSE []::DECIMAL(2,1)[] END)::DOUBLE AS score FROM events)
SELECT user_id, round(avg(score), 6) AS win_rate, round(COALESCE(stddev_samp(score) / sqrt(COUNT(score)), 0), 6) AS stderr, COUNT(score) AS n FROM s GROUP BY user_id""")
def battle_winrate_stderr(t) -> DataFrame:
    return judging.win_rates(_battles(t), "user_id").withColumns({"win_rate": r6("win_rate"), "stderr": r6("stderr")})


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY event_type")
def quantile_ci(t) -> DataFrame:
    return t("events").groupBy("event_type").agg(*[r6(F.percentile("value", F.lit(q))).alias(n) for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))])


@query("""WITH i AS (SELECT l_orderkey, l_returnflag AS axis, (CASE WHEN l_linenumber % 4 = 0 THEN -3 ELSE l_linenumber END)::BIGINT AS points, l_quantity > 25 AS met FROM lineitem)
SELECT axis, COALESCE(SUM(points) FILTER (WHERE met), 0)::BIGINT AS met, SUM(CASE WHEN points > 0 THEN points ELSE 0 END)::BIGINT AS possible, round(COALESCE(SUM(points) FILTER (WHERE met), 0) / SUM(CASE WHEN points > 0 THEN points ELSE 0 END)::DOUBLE, 6) AS ratio FROM i GROUP BY axis""")
def rubric_by_axis(t) -> DataFrame:
    return judging.by_axis(_rubric(t), "axis").withColumn("ratio", r6("ratio"))


def _rubric(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("axis"), F.when(F.col("l_linenumber") % 4 == 0, -3).otherwise(F.col("l_linenumber")).cast("long").alias("points"), (F.col("l_quantity") > 25).alias("met"))


@query("""WITH i AS (SELECT l_orderkey, (CASE WHEN l_linenumber % 4 = 0 THEN -3 ELSE l_linenumber END)::BIGINT AS points, l_quantity > 25 AS met FROM lineitem),
s AS (SELECT l_orderkey, COALESCE((SUM(points) FILTER (WHERE met)) / (SUM(points) FILTER (WHERE points > 0))::DOUBLE, 0) AS score FROM i GROUP BY 1)
SELECT o_orderpriority AS theme, round(LEAST(GREATEST(avg(score), 0), 1), 6) AS accuracy, COUNT(*) AS n FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def rubric_by_theme(t) -> DataFrame:
    s = judging.rubric_scores(_rubric(t), "l_orderkey").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return judging.clipped_mean(s.withColumnRenamed("o_orderpriority", "theme"), ["theme"]).withColumn("accuracy", r6("accuracy"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS event_no, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS role_no FROM conversations")
def turn_counters(t) -> DataFrame:
    return traces.turn_counters(t("conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role", "event_no", "role_no")


@query("""WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM a)
SELECT user_id, island, MIN(event_type) AS event_type, MIN(event_id) AS first_id, MAX(event_id) AS last_id, COUNT(*) AS n, string_agg(event_id::VARCHAR, ' ' ORDER BY ts, event_id) AS text FROM b GROUP BY user_id, island""")
def delta_consolidation(t) -> DataFrame:
    e = t("events").withColumn("x", F.col("event_id").cast("string")).withColumn("i", F.col("event_id"))
    return traces.consolidate(e, "user_id", ["ts", "event_id"], "event_type", "i", "x").withColumnsRenamed({"first_ts": "first_id", "last_ts": "last_id"})


@query("""SELECT p.event_id, p.user_id, (SELECT props FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.event_id < p.event_id ORDER BY c.event_id DESC LIMIT 1) AS call_name FROM events p WHERE p.event_type = 'purchase'""")
def call_result_pairing(t) -> DataFrame:
    e = t("events").select("event_id", "user_id", "event_type", "props")
    r = e.where("event_type = 'purchase'").select("event_id", "user_id")
    return traces.earlier_call(r, e.where("event_type = 'click'").select("user_id", "event_id", "props"), "user_id", "event_id", "props").select("event_id", "user_id", "call_name")


@query("""WITH RECURSIVE n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 2 END AS parent FROM documents),
r(doc_id, root, depth) AS (SELECT doc_id, doc_id, 0 FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, r.root, r.depth + 1 FROM n JOIN r ON n.parent = r.doc_id WHERE n.doc_id <> r.doc_id)
SELECT doc_id, root, depth FROM r""")
def lineage_tree(t) -> DataFrame:
    nodes = t("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.expr("doc_id div 2")).alias("parent"))
    return traces.descend(nodes, "doc_id", "parent")


@query("""WITH l AS (SELECT doc_id AS exp_id, doc_id % 5 AS agent, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 3 = 0 THEN ((doc_id + 1) % 5) || '/' || (doc_id + 1) WHEN doc_id % 13 = 0 THEN '-1' ELSE CAST(doc_id + 5 AS VARCHAR) END AS p FROM documents),
k AS (SELECT *, CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE agent::VARCHAR END AS pa, CASE WHEN contains(p, '/') THEN split_part(p, '/', 2) ELSE p END AS pe FROM l)
SELECT CASE WHEN p IS NULL THEN 'legacy' WHEN p = 'none' THEN 'root' WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.exp_id::VARCHAR = k.pe AND l.agent::VARCHAR = k.pa) THEN 'orphan' WHEN pa <> agent::VARCHAR THEN 'cross' ELSE 'child' END AS link, COUNT(*) AS n FROM k GROUP BY 1""")
def lineage_links(t) -> DataFrame:
    log = t("documents").select(F.col("doc_id").cast("string").alias("exp_id"), (F.col("doc_id") % 5).cast("string").alias("agent_id"), F.expr(
        "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 3 = 0 THEN concat((doc_id + 1) % 5, '/', doc_id + 1) WHEN doc_id % 13 = 0 THEN '-1' ELSE cast(doc_id + 5 AS string) END").alias("parent_exp_id"))
    return traces.parents(log).groupBy("link").agg(F.count(F.lit(1)).alias("n"))


_PATTERNS = ["idiot", "license", "error", "the of", "password", "http"]


@query(f"SELECT p AS pattern, COUNT(*) AS n, MIN(doc_id) AS first_id, MAX(doc_id) AS last_id FROM documents, (SELECT unnest({_PATTERNS}) AS p) WHERE contains(lower(text), p) GROUP BY p")
def pattern_scan(t) -> DataFrame:
    return traces.pattern_hits(t("documents"), "doc_id", "text", _PATTERNS)


@query("SELECT doc_id, md5(regexp_replace(replace(text, 'sk-live-abcdefgh-0001', '[REDACTED]'), 'sk-live-ab[A-Za-z0-9_-]*', '[REDACTED]', 'g')) AS redacted_md5 FROM documents")
def secret_redaction(t) -> DataFrame:
    return t("documents").select("doc_id", F.md5(T.redact(F.col("text"), "sk-live-abcdefgh-0001")).alias("redacted_md5"))


#: Text in parts of word characters and of others, so words are found without an ASCII word boundary; whole numbers with decimals become one.
_SCRUBBED = r"""array_to_string(list_transform(regexp_extract_all(regexp_replace({0}, '[%％]', '', 'g'), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda p: CASE WHEN lower(p) IN ('accuracy', 'acc', 'score', 'stderr', 'metric', 'test_acc') THEN '[score]' WHEN lower(p) IN ('outperforms', 'winning', 'regression') THEN '[redacted]' WHEN regexp_matches(p, '^[0-9]+$') THEN '[n]' ELSE p END), '')"""
_NOTE = "text || ' Accuracy ' || n_chars || '.5% winning, test_acc=7 accuracy' || doc_id"


@query(rf"""WITH d AS (SELECT doc_id, trim(regexp_replace({_NOTE}, '\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, replace({_SCRUBBED.format('t')}, '[n].[n]', '[n]') AS t FROM d)
SELECT doc_id, md5(t) AS whole_md5, substr(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 200) AS short FROM s""")
def numeric_scrub(t) -> DataFrame:
    """Scores, comparisons and numbers out of texts of all languages, whole and as a short field."""
    note = F.concat("text", F.lit(" Accuracy "), F.col("n_chars").cast("string"), F.lit(".5% winning, test_acc=7 accuracy"), F.col("doc_id").cast("string"))
    return t("documents").select("doc_id", F.md5(T.scrub(T.collapse(note))).alias("whole_md5"), T.short_field(note).alias("short"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '(?s)```.*?```', '', 'g') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{1}[ \t]'))::INT AS h1, len(regexp_extract_all(t, '(?m)^#{2}[ \t]'))::INT AS h2, len(regexp_extract_all(t, '(?m)^[ \t]*[0-9]+\.[ \t]'))::INT AS ordered, len(regexp_extract_all(t, '(?m)^[ \t]*[-*+][ \t]'))::INT AS unordered, len(regexp_extract_all(t, '\*\*[^*\n]+\*\*'))::INT AS bold_stars, len(regexp_extract_all(t, '__[^_\n]+__'))::INT AS bold_bars FROM d""")
def markdown_features(t) -> DataFrame:
    return t("documents").select("doc_id", T.markdown_counts(F.col("text")).alias("m")).select("doc_id", "m.h1", "m.h2", "m.ordered", "m.unordered", "m.bold_stars", "m.bold_bars")


@query()
def repetition_limiter(t) -> DataFrame:
    places.bounded_batches(t.spark)
    return t("documents").select("doc_id", T.limit_repetitions("text").alias("limited"))


@query("""SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS chat_md5, SUM(length(role) + length(text) + 24)::BIGINT AS chat_len FROM conversations GROUP BY conv_id""")
def chat_render(t) -> DataFrame:
    c = audit.as_chats(t("conversations")).select("conv_id", T.render_chat(F.col("messages")).alias("x"))
    return c.select("conv_id", F.md5("x").alias("chat_md5"), F.length("x").cast("long").alias("chat_len"))


@query("SELECT event_type, SUM(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k, COUNT(json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type")
def json_extract(t) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t("events").groupBy("event_type").agg(F.sum(k).alias("total_k"), F.count(k).alias("n"))


@query("""WITH s AS (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 37) % 36000 END AS sec FROM orders), g AS (SELECT o_orderpriority, COUNT(sec) AS n, floor(SUM(sec) / COUNT(sec)::DOUBLE)::BIGINT AS mean_seconds FROM s GROUP BY 1)
SELECT *, (mean_seconds // 3600) || ':' || lpad(((mean_seconds // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((mean_seconds % 60)::VARCHAR, 2, '0') AS mean_hms, round((mean_seconds / 360.0)::DECIMAL(18, 6), 1)::VARCHAR || '%' AS share FROM g""")
def time_overview(t) -> DataFrame:
    s = t("orders").select("o_orderpriority", F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") * 37) % 36000).alias("sec"))
    return runs.time_overview(s.withColumn("sec", T.seconds_of(T.hms_of(F.col("sec")))), ["o_orderpriority"], "sec")


@query("""WITH a AS (SELECT o_orderstatus, o_orderpriority, COUNT(*)::DOUBLE AS v FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus, o_orderpriority, COUNT(*)::DOUBLE AS v FROM orders WHERE o_totalprice < 499000 AND o_orderpriority <> '5-LOW' GROUP BY ALL)
SELECT COALESCE(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, COALESCE(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority WHERE a.v IS DISTINCT FROM b.v""")
def table_diff(t) -> DataFrame:
    n = lambda d: d.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return runs.diff(n(t("orders")), n(t("orders").where("o_totalprice < 499000 AND o_orderpriority <> '5-LOW'")), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT c_mktsegment, score, row_number() OVER (ORDER BY score DESC NULLS LAST, c_mktsegment) AS place FROM (SELECT c_mktsegment, round(avg(c_acctbal), 6) AS score FROM customer GROUP BY 1)""")
def winner_ranking(t) -> DataFrame:
    return runs.ranking(t("customer").groupBy("c_mktsegment").agg(r6(F.avg("c_acctbal")).alias("score")), "score", ["c_mktsegment"])


@query("SELECT lang, COUNT(*) AS n, COUNT(quality) AS n_labelled, SUM(quality)::BIGINT AS n_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_join_quality(t) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.sum("quality").alias("n_good"))


@query("""SELECT s, COUNT(*) AS n FROM (SELECT 'both' AS s, c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'only_customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) GROUP BY s""")
def key_set_compare(t) -> DataFrame:
    c, o = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    both = c.intersect(o).select(F.lit("both").alias("s"))
    return both.unionByName(c.exceptAll(o.distinct()).select(F.lit("only_customer").alias("s"))).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT DISTINCT o_orderpriority FROM orders), f AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n_name FROM nation WHERE (SELECT COUNT(*) FROM f WHERE c_nationkey = n_nationkey) = (SELECT COUNT(*) FROM x)""")
def complete_members(t) -> DataFrame:
    """Nations that have orders of every priority there is."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n"), "o_orderpriority")
    every = t("nation").select(F.col("n_nationkey").alias("n"), "n_name").crossJoin(t("orders").select("o_orderpriority").distinct())
    pair = F.struct("n", "o_orderpriority").alias("pair")
    return runs.complete_groups(every.select("n_name", pair), o.select(pair), "n_name", "pair")


@query("SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS qty, COUNT(*) AS n, GROUPING(l_returnflag)::INT AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_extra(t) -> DataFrame:
    """A built-in extra that the reference does not have."""
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 90)")
def missing_runs(t) -> DataFrame:
    e = t("events")
    return e.where("event_type = 'error'").join(e.where("event_type = 'purchase' AND value > 90").select("user_id"), "user_id", "left_anti").select("event_id", "user_id")


@query()
def bootstrap_ci(t) -> DataFrame:
    return judging.bootstrap(_battles(t), "user_id")


@query()
def bootstrap_se(t) -> DataFrame:
    s = judging.rubric_scores(_rubric(t), "l_orderkey").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return judging.bootstrap_std(s, "o_orderpriority", "score", 200)


from . import files, results, texts, live  # noqa: E402, F401, I001  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
