"""Queries over results: agents, times and tokens, filters and grids, judging and pairwise models, experiment logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import judging, runs, traces
from .base import Fixture, Tables, query, r6

_SCORES = """big AS (SELECT c_nationkey AS method, o_orderpriority AS benchmark, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 350000),
f AS (SELECT * FROM (VALUES ('1-URGENT', 0.4), ('2-HIGH', 0.3), ('3-MEDIUM', 0.15), ('4-NOT SPECIFIED', 0.1), ('5-LOW', 0.05)) AS x(benchmark, factor)),
full_ AS (SELECT method FROM big GROUP BY method HAVING COUNT(DISTINCT benchmark) = 5),
score AS (SELECT method, SUM(m * factor::DOUBLE) AS metric FROM (SELECT method, benchmark, avg(value) AS m FROM big WHERE method IN (SELECT method FROM full_) GROUP BY ALL) JOIN f USING (benchmark) GROUP BY method)"""


def _agents(t: Tables) -> DataFrame:
    r = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.col("r_name").alias("agent"), F.col("n_nationkey").alias("method"))


@query(f"WITH {_SCORES}, a AS (SELECT r_name AS agent, metric FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN score ON method = n_nationkey) SELECT agent, round(avg(metric), 4) AS avg, round(stddev_samp(metric), 4) AS std, COUNT(*) AS n FROM a GROUP BY agent HAVING COUNT(*) = COUNT(metric)")
def agent_leaderboard(t: Tables) -> DataFrame:
    """Mean and deviation of the weighted scores of each agent's methods; a method counts if every benchmark is there."""
    big = t("orders").where("o_totalprice > 350000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("method"), F.col("o_orderpriority").alias("benchmark"), F.col("o_totalprice").alias("value"))
    factors = t.spark.createDataFrame([("1-URGENT", 0.4), ("2-HIGH", 0.3), ("3-MEDIUM", 0.15), ("4-NOT SPECIFIED", 0.1), ("5-LOW", 0.05)], "benchmark string, factor double")
    whole = runs.complete_groups(big.select("method").distinct().crossJoin(factors.select("benchmark")).select("method", F.struct("method", "benchmark").alias("cell")), big.select(F.struct("method", "benchmark").alias("cell")), "method", "cell")
    metric = runs.weighted(big.join(whole, "method", "left_semi"), factors, "method").withColumnRenamed("score", "metric")
    return runs.agent_scores(_agents(t), metric).withColumns({"avg": F.round("avg", 4), "std": F.round("std", 4)})


@query("""WITH s AS (SELECT c_nationkey AS method, floor(avg((o_orderkey * 37) % 36000))::BIGINT AS sec FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY 1),
a AS (SELECT r_name AS agent, sec FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN s ON method = n_nationkey), g AS (SELECT agent, floor(avg(sec))::BIGINT AS a, floor(stddev_samp(sec))::BIGINT AS d, COUNT(*) AS n FROM a GROUP BY agent HAVING COUNT(*) = COUNT(sec))
SELECT agent, (a // 3600) || ':' || lpad(((a // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((a % 60)::VARCHAR, 2, '0') AS avg_time, (d // 3600) || ':' || lpad(((d // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((d % 60)::VARCHAR, 2, '0') AS std_time, n FROM g""")
def agent_times(t: Tables) -> DataFrame:
    """Mean and deviation of H:M:S times of each agent's methods, cut to whole seconds."""
    o = t("orders").where("o_totalprice > 400000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("method"), ((F.col("o_orderkey") * 37) % 36000).alias("sec"))
    times = runs.time_overview(o, ["method"], "sec").select("method", F.col("mean_hms").alias("average_time"))
    return runs.agent_times(_agents(t), times)


@query("""SELECT o_orderpriority AS method, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS n_incomplete, SUM(x) FILTER (WHERE o_orderstatus <> 'P')::BIGINT AS total, round_even(avg(x) FILTER (WHERE o_orderstatus <> 'P'), 0)::BIGINT::VARCHAR AS avg_tokens
FROM (SELECT *, o_orderkey * 1013 AS x FROM orders) GROUP BY 1""")
def token_usage(t: Tables) -> DataFrame:
    """Token counts out of logs, per method, incomplete logs left out."""
    log = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("done\ntokens used\n"), F.format_number(F.col("o_orderkey") * 1013, 0), F.lit("\nbye"))).otherwise(F.lit("cut off"))
    return runs.token_usage(t("orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").cast("string").alias("run"), log.alias("content")))


@query("""WITH r AS (SELECT l_linenumber AS run, l_returnflag AS model, l_linestatus AS benchmark, l_quantity AS value FROM lineitem WHERE NOT (l_linenumber = 7 AND l_returnflag = 'A')),
k AS (SELECT run FROM r GROUP BY run HAVING COUNT(DISTINCT model) = 3)
SELECT model, benchmark, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, COUNT(value) AS n FROM r WHERE run IN (SELECT run FROM k) GROUP BY ALL""")
def cells_over_complete_runs(t: Tables) -> DataFrame:
    """Mean and deviation of each cell over the runs whose models are exactly the expected ones."""
    v = t("lineitem").where("NOT (l_linenumber = 7 AND l_returnflag = 'A')").select(F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("benchmark"), F.col("l_quantity").alias("value"))
    want = t("lineitem").select(F.col("l_returnflag").alias("model")).distinct()
    return runs.per_cell(v, ["model", "benchmark"], "run", want).withColumns({"mean": r6("mean"), "std": r6("std")})


GRID_A = Fixture("ga", "line_no long, row string", [(0, "model,x,y"), (1, "a,0.1,2"), (2, "b,0.5,ERR"), (3, "c,1")])
GRID_B = Fixture("gb", "line_no long, row string", [(0, "model,x,y"), (1, "a,0.10000000000001,2.0"), (2, "b,0.6,err,9")])


@query("SELECT * FROM (VALUES ('rows', -1::BIGINT, -1, '4', '3'), ('columns', 2, -1, '3', '4'), ('cell', 2, 1, '0.5', '0.6'), ('cell', 2, 2, 'ERR', 'err')) AS x(kind, line_no, place, a, b)")
def ragged_table_diff(t: Tables) -> DataFrame:
    """Two tables met cell by cell by their places, with a tolerance, ragged rows and unequal lengths."""
    d = lambda f: f.df(t.spark).select("line_no", F.split("row", ",").alias("cells"))
    return runs.ragged_diff(d(GRID_A), d(GRID_B))


@query("""WITH l AS (SELECT c_nationkey, c_mktsegment, c_acctbal > 0 AS ok FROM customer WHERE c_acctbal < 5000 QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey DESC) = 1)
SELECT n_nationkey AS c_nationkey, s.c_mktsegment, CASE WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'present' ELSE 'unusable' END AS state
FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN l ON l.c_nationkey = n_nationkey AND l.c_mktsegment = s.c_mktsegment""")
def missing_and_unusable_runs(t: Tables) -> DataFrame:
    """The dense grid of cells: no run, a latest run that is unusable, or a good one."""
    c = t("customer").where("c_acctbal < 5000").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("run_id"), (F.col("c_acctbal") > 0).alias("has_cuda"))
    return runs.missing_runs(t("nation").select(F.col("n_nationkey").alias("c_nationkey")), t("customer").select("c_mktsegment").distinct(), c, ["c_nationkey", "c_mktsegment"])


@query("""WITH s AS (SELECT c_mktsegment AS run, CASE WHEN c_mktsegment < 'C' THEN NULL ELSE round(avg(c_acctbal), 6) END AS m FROM customer GROUP BY 1)
SELECT (SELECT run FROM s WHERE m IS NOT NULL ORDER BY m DESC, run LIMIT 1) AS winner, string_agg(run, ',' ORDER BY m DESC NULLS LAST, run) AS ranking, string_agg(run, ',' ORDER BY run) FILTER (WHERE m IS NULL) AS excluded FROM s""")
def winner_report(t: Tables) -> DataFrame:
    """The winner, the full ranking and the runs left out for want of the metric, as one report."""
    s = t("customer").groupBy(F.col("c_mktsegment").alias("run")).agg(r6(F.avg("c_acctbal")).alias("m"))
    return runs.ranking_report(s.withColumn("m", F.when(F.col("run") >= "C", F.col("m"))), "m", "run")


METHODS = Fixture("methods", "method string", [("claude_10h",), ("codex_a",), ("codexhigh_b_testing",), ("codexlow_c",), (".hidden",), ("baseline",), ("Gemini_x",), ("codex",)])


@query(f"WITH {METHODS.cte} SELECT 'codex' AS wanted, method FROM methods WHERE regexp_matches(method, '^(codex_|codexhigh_|codexlow_)') AND NOT contains(method, 'testing') UNION ALL SELECT 'gemini', method FROM methods WHERE contains(lower(method), 'gemini') AND NOT starts_with(method, '.') AND method <> 'baseline' UNION ALL SELECT 'any', method FROM methods WHERE NOT starts_with(method, '.') AND method NOT IN ('baseline', 'codex')")
def method_filters(t: Tables) -> DataFrame:
    """Skip lists, dot names, prefixes, parts in any case, excluded parts."""
    m = METHODS.df(t.spark)
    a = runs.chosen(m, "method", prefixes=("codex_", "codexhigh_", "codexlow_"), without=("testing",))
    b = runs.chosen(m, "method", skipped=("baseline",), containing="GEMINI", case=False)
    c = runs.chosen(m, "method", skipped=("baseline", "codex"))
    say = lambda d, w: d.select(F.lit(w).alias("wanted"), "method")
    return say(a, "codex").unionAll(say(b, "gemini")).unionAll(say(c, "any"))


@query("SELECT 'en' AS wanted, COUNT(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'All', COUNT(*) FROM documents UNION ALL SELECT 'de/src1', COUNT(*) FROM documents WHERE lang = 'de' AND source = 'src1' UNION ALL SELECT 'absent', COUNT(*) FROM documents")
def wildcard_filters(t: Tables) -> DataFrame:
    """Equality filters where All, or no value, stands for any, and absent columns are not asked."""
    d = t("documents").select("lang", "source")
    say = lambda x, w: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("wanted"), "n")
    out = say(runs.matching(d, lang="en", source="All"), "en")
    for x, w in ((runs.matching(d, lang="All", source=None), "All"), (runs.matching(d, lang="de", source="src1"), "de/src1"), (runs.matching(d, colour="red"), "absent")):
        out = out.unionAll(say(x, w))
    return out


FILES = Fixture("files", "name string", [(n,) for n in ("final_claude.csv", "final_avg_x.csv", "final_std_x.csv", "final_time_x.csv", "final_baseline.csv", "contamination_a.csv", "contamination_baseline_zeroshot.csv", "single_metrics.csv", "single_metrics_aggregated.csv", "aggregated_avg_over_models.csv", "aggregated_avg_claude.csv", "aggregated_time_claude.csv", "time_aggregated.csv", "notes.txt")])


@query(f"WITH {FILES.cte} SELECT name, name IN ('final_claude.csv', 'contamination_a.csv', 'single_metrics.csv', 'single_metrics_aggregated.csv', 'aggregated_avg_claude.csv', 'time_aggregated.csv') AS compared FROM files")
def compared_files(t: Tables) -> DataFrame:
    """Which files of two result folders are compared."""
    return FILES.df(t.spark).select("name", runs.is_compared(F.col("name")).alias("compared"))


CODE = Fixture("code", "path string, content string", [
    ("m/r1/a.py", "from openai import OpenAI"), ("m/r1/b.py", "client.messages.create(); genai.GenerativeModel"), ("m/r2/evaluate.py", "import openai"), ("m/r2/site-packages/x.py", "import anthropic"), ("m/r3/c.py", "nothing"), ("n/r1/d.py", "x.completions.create")])


@query("SELECT * FROM (VALUES ('m/r1', 2::BIGINT, 'anthropic,google_gemini,openai'), ('n/r1', 1, 'openai')) AS x(run, n_files, providers)")
def provider_findings(t: Tables) -> DataFrame:
    """Code files that call a model provider, by run; paths of others' code are left out."""
    return traces.findings(CODE.df(t.spark), traces.PROVIDERS, traces.OTHERS)


@query("SELECT event_id, CASE (event_id % 4) WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS agent FROM events")
def round_robin(t: Tables) -> DataFrame:
    return t("events").select("event_id", runs.round_robin(F.col("event_id"), ["a", "b", "c", "d"]).alias("agent"))


@query("SELECT doc_id FROM documents ORDER BY md5('7/' || doc_id), doc_id LIMIT 37")
def seeded_sample(t: Tables) -> DataFrame:
    """A sample without replacement that every run draws alike."""
    return runs.seeded_sample(t("documents").select("doc_id"), ["doc_id"], 37, seed=7)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def first_rows(t: Tables) -> DataFrame:
    return runs.first_rows(t("events").select("event_id", "value", (-F.col("value")).alias("v")), ["v", "event_id"], 10).drop("v")


@query("SELECT user_id, MIN(event_id) FILTER (WHERE event_type = 'purchase') AS attempt, COUNT(event_id) AS n FROM events GROUP BY user_id")
def first_success(t: Tables) -> DataFrame:
    """The first attempt of each that succeeded, and all attempts."""
    return runs.first_success(t("events").select("user_id", F.col("event_id").alias("attempt"), (F.col("event_type") == "purchase").alias("ok")), ["user_id"])


@query("SELECT lang, source, doc_id, COUNT(*) OVER (PARTITION BY lang, source) AS n FROM documents")
def rows_by_group_size(t: Tables) -> DataFrame:
    """Rows with the size of their group, largest groups first."""
    return traces.by_group_size(t("documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])


@query("SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang")
def language_distribution(t: Tables) -> DataFrame:
    return judging.distribution(t("documents"), "lang")


@query("SELECT string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT event_type AS x FROM events UNION SELECT 'baseline')")
def unique_items(t: Tables) -> DataFrame:
    """Distinct names with the baseline among them, sorted."""
    names = t("events").select(F.col("event_type").alias("x")).union(t.spark.createDataFrame([("baseline",)], "x string")).distinct()
    return names.agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("items"))


_QUESTIONS = """q AS (SELECT doc_id AS uid, CASE lang WHEN 'en' THEN 'hard_prompt' WHEN 'fr' THEN 'coding' WHEN 'de' THEN 'math' ELSE 'creative_writing' END AS category, substr(text, 1, 30) AS prompt FROM documents),
a AS (SELECT doc_id AS uid, 'mine' AS model, 'q' || quality AS answer FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'o3-mini-2025-01-31', 'len ' || n_chars FROM documents WHERE n_chars > 900 UNION ALL SELECT doc_id, 'Qwen3-1.7B', source FROM documents WHERE source IS NOT NULL),
pairs AS (SELECT q.uid, category, prompt, m.answer, b.model AS baseline, b.answer AS baseline_answer FROM q JOIN a m ON m.uid = q.uid AND m.model = 'mine' JOIN a b ON b.uid = q.uid AND b.model = CASE category WHEN 'creative_writing' THEN 'Qwen3-1.7B' ELSE 'o3-mini-2025-01-31' END)"""


def _pairs(t: Tables) -> DataFrame:
    d = t("documents")
    category = F.when(F.col("lang") == "en", "hard_prompt").when(F.col("lang") == "fr", "coding").when(F.col("lang") == "de", "math").otherwise("creative_writing")
    q = d.select(F.col("doc_id").alias("uid"), category.alias("category"), F.substring("text", 1, 30).alias("prompt"))
    row = lambda x, model, answer: x.select(F.col("doc_id").alias("uid"), F.lit(model).alias("model"), answer.alias("answer"))
    a = row(t("labels").where("quality IS NOT NULL"), "mine", F.concat(F.lit("q"), F.col("quality").cast("string")))
    a = a.unionAll(row(d.where("n_chars > 900"), "o3-mini-2025-01-31", F.concat(F.lit("len "), F.col("n_chars").cast("string")))).unionAll(row(d.where("source IS NOT NULL"), "Qwen3-1.7B", F.col("source")))
    return judging.question_pairs(q, a, "mine")


@query(f"WITH {_QUESTIONS} SELECT * FROM pairs")
def question_pairs(t: Tables) -> DataFrame:
    """Questions with the candidate's answer and that of their category's baseline; unanswered ones go."""
    return _pairs(t)


@query(f"WITH {_QUESTIONS} SELECT uid, category FROM pairs WHERE uid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def unjudged_pairs(t: Tables) -> DataFrame:
    """Resuming: pairs that an earlier run has not judged."""
    done = t("labels").where("toxic = 1").select(F.lit("mine").alias("model"), F.col("doc_id").alias("uid"))
    return judging.unjudged(_pairs(t).withColumn("model", F.lit("mine")), done).select("uid", "category")


_STYLE = """b AS (SELECT o_orderkey AS uid, o_totalprice > 250000 AS win FROM orders),
ma AS (SELECT l_orderkey AS uid, SUM(l_quantity)::DOUBLE AS len, COUNT(*)::DOUBLE AS lists, MAX(l_linenumber)::DOUBLE AS bold FROM lineitem GROUP BY 1), mb AS (SELECT o_orderkey AS uid, (o_custkey + 1)::DOUBLE AS len, (o_orderkey % 7)::DOUBLE AS lists, (o_custkey % 5)::DOUBLE AS bold FROM orders),
d AS (SELECT uid, win, (ma.len - mb.len) / (ma.len + mb.len) AS d_len, (ma.lists / (ma.len + 1) - mb.lists / (mb.len + 1)) / (ma.lists / (ma.len + 1) + mb.lists / (mb.len + 1) + 1) AS d_lists, (ma.bold / (ma.len + 1) - mb.bold / (mb.len + 1)) / (ma.bold / (ma.len + 1) + mb.bold / (mb.len + 1) + 1) AS d_bold FROM b JOIN ma USING (uid) JOIN mb USING (uid))"""


def _styled(t: Tables) -> DataFrame:
    o = t("orders")
    b = o.select(F.col("o_orderkey").alias("uid"), F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("model"), F.lit("base").alias("baseline"), (F.col("o_totalprice") > 250000).cast("double").alias("score"))
    meta = t("lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.sum("l_quantity").alias("len"), F.count(F.lit(1)).cast("double").alias("lists"), F.max("l_linenumber").cast("double").alias("bold"))
    meta = meta.join(b.select("uid", "model"), "uid").select("uid", "model", "len", "lists", "bold")
    base = o.select(F.col("o_orderkey").alias("uid"), F.lit("base").alias("model"), (F.col("o_custkey") + 1).cast("double").alias("len"), (F.col("o_orderkey") % 7).cast("double").alias("lists"), (F.col("o_custkey") % 5).cast("double").alias("bold"))
    return judging.style(judging.with_style(b, meta.unionByName(base), ["lists", "bold"]), ["lists", "bold"])


@query(f"WITH {_STYLE} SELECT uid, round((d_len - avg(d_len) OVER ()) / stddev_samp(d_len) OVER (), 5) AS z_len, round((d_lists - avg(d_lists) OVER ()) / stddev_samp(d_lists) OVER (), 5) AS z_lists, round((d_bold - avg(d_bold) OVER ()) / stddev_samp(d_bold) OVER (), 5) AS z_bold FROM d")
def battle_style_scores(t: Tables) -> DataFrame:
    """Battles met with both sides' answer metadata: relative style differences as z-scores over all battles."""
    z = lambda c: F.round(f"z_d_{c}", 5).alias(f"z_{c}")
    return _styled(t).select("uid", z("len"), z("lists"), z("bold"))


_MODELS = "CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.0 WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 ELSE 0.0 END::DOUBLE"


def _model_battles(t: Tables) -> DataFrame:
    s = F.when(F.col("event_type").isin("click", "purchase"), 1.0).when(F.col("event_type") == "signup", 0.5).otherwise(0.0)
    return t("events").select(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), s.alias("score"))


@query(f"""WITH s AS (SELECT 'm' || (user_id % 7) AS model, avg({_MODELS}) AS p FROM events GROUP BY 1) SELECT model, round(ln(p / (1 - p)), 5) AS coefficient, round(p, 5) AS win_rate FROM s""")
def bt_winrates(t: Tables) -> DataFrame:
    """A Bradley-Terry fit of battles that all have one baseline: the fit must come to each model's log odds."""
    c = judging.fit_pairs(_model_battles(t), "base")
    base = c.where("name = 'base'").select(F.col("coefficient").alias("b"))
    rates = judging.pair_win_rates(c, "base").select(F.col("model").alias("name"), "win_rate")
    return c.where("name <> 'base'").crossJoin(base).join(rates, "name").select(F.col("name").alias("model"), F.round(F.col("coefficient") - F.col("b"), 5).alias("coefficient"), F.round("win_rate", 5).alias("win_rate"))


@query()
def bt_style_bootstrap(t: Tables) -> DataFrame:
    """The fit with style features beside the models, over 20 resamples: win rates at equal style, with intervals."""
    features = ["z_d_len", "z_d_lists", "z_d_bold"]
    c = judging.fit_pairs(_styled(t), "base", features, rounds=20)
    return judging.pair_win_rates(c, "base", features)


@query()
def rao_kupper(t: Tables) -> DataFrame:
    """The fit with ties of their own."""
    return judging.fit_pairs(_model_battles(t), "base", loss="rk").select("name", r6("coefficient").alias("coefficient"))


@query("SELECT user_id, event_id, array_to_string(list_transform(['0', '1', '2', 'base'], lambda m: CASE WHEN m = 'base' THEN '-1.0' WHEN m = (user_id % 3)::VARCHAR THEN '1.0' ELSE '0.0' END), ' ') AS x FROM events")
def one_hot_models(t: Tables) -> DataFrame:
    """Models as one-hot rows with -1 for the baseline."""
    v = judging.one_hot((F.col("user_id") % 3).cast("string"), ["0", "1", "2"], "base")
    return t("events").select("user_id", "event_id", F.array_join(v.cast("array<string>"), " ").alias("x"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.05), 4) AS q05, round(quantile_cont(o_totalprice, 0.95), 4) AS q95 FROM orders GROUP BY 1")
def interval_in_one_aggregate(t: Tables) -> DataFrame:
    """Mean, lower and upper bound of each key in one aggregate."""
    return judging.interval(t("orders"), "o_orderpriority", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("mean", "q05", "q95")})


@query("""WITH e AS (SELECT l_orderkey AS id, list({'points': (CASE WHEN l_linenumber % 4 = 0 THEN -3 ELSE l_linenumber END)::BIGINT, 'axis': l_returnflag} ORDER BY l_linenumber, l_returnflag) AS r, list(l_quantity > 25 ORDER BY l_linenumber, l_quantity > 25) FILTER (WHERE l_linenumber <> 6) AS m FROM lineitem GROUP BY 1),
z AS (SELECT r[i].axis AS axis, r[i].points AS points, m[i] AS met FROM (SELECT r, m, unnest(range(1, least(len(r), COALESCE(len(m), 0)) + 1)) AS i FROM e))
SELECT axis, COALESCE(SUM(points) FILTER (WHERE met), 0)::BIGINT AS met, SUM(CASE WHEN points > 0 THEN points ELSE 0 END)::BIGINT AS possible, round(COALESCE(SUM(points) FILTER (WHERE met), 0) / SUM(CASE WHEN points > 0 THEN points ELSE 0 END)::DOUBLE, 6) AS ratio FROM z GROUP BY axis""")
def zipped_rubric_by_axis(t: Tables) -> DataFrame:
    """Rubric items met with gradings by their place, the longer list's rest left out; the ratio of each axis."""
    item = F.struct("l_linenumber", F.when(F.col("l_linenumber") % 4 == 0, -3).otherwise(F.col("l_linenumber")).cast("long").alias("points"), F.col("l_returnflag").alias("axis"))
    met = F.when(F.col("l_linenumber") != 6, F.struct("l_linenumber", (F.col("l_quantity") > 25).alias("met")))
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("rubrics"), F.array_sort(F.collect_list(met)).alias("m"))
    d = judging.graded_items(g.select("id", "rubrics"), g.select("id", F.transform("m", lambda x: x["met"]).alias("met")), "id")
    return judging.by_axis(d, "axis").withColumn("ratio", r6("ratio"))


LOG = Fixture("log", "agent_id string, exp_id string, parent_exp_id string, promoted string, decontam_pass string, audit_pass string", [
    ("a", "exp_1", "none", "true", "", "True"), ("a", "exp_2", "exp_1", "", "yes", "1"), ("a", "exp_3", "exp_1", "0", "true", "no"), ("b", "exp_1", "a/exp_1", "", "", "pass"), ("b", "exp_2", "exp_9", None, "1", None), ("b", "exp_3", None, "yes", "0", "t"), ("a", "exp_4", "exp_2", "", "no", "x")])


@query("SELECT 7::BIGINT AS n, 4::BIGINT AS n_promoted, 4::BIGINT AS n_audit_pass, 1::BIGINT AS n_cross, 1::BIGINT AS n_orphan, 'a/exp_1' AS most_forked, 3::BIGINT AS n_children")
def experiment_footer(t: Tables) -> DataFrame:
    """Totals of an experiment log."""
    return traces.tree_footer(LOG.df(t.spark))


NOTES = Fixture("notes", "agent_id string, exp_id string, parent string, pivot string", [
    ("a", "exp_001", "none", None), ("a", "exp_002", "\n- exp_1  # the first", None), ("a", "exp_003", "none", ""), ("a", "exp_004", "# none", "stuck"), ("b", "exp_002", "a/exp_2", None), ("b", "exp_003", "a/exp_77", None), ("b", "exp_004", "exp_8", None), ("b", "exp_005", "\n \n", None), ("b", "exp_006", "a b/exp_1", None)])


@query("SELECT * FROM (VALUES ('a', 'exp_001', 'none', 'ok'), ('a', 'exp_002', 'exp_1', 'ok'), ('a', 'exp_003', 'none', 'needs_pivot'), ('a', 'exp_004', 'none', 'ok'), ('b', 'exp_002', 'a/exp_2', 'ok'), ('b', 'exp_003', 'a/exp_77', 'unknown'), ('b', 'exp_004', 'exp_8', 'unknown'), ('b', 'exp_005', NULL, 'missing'), ('b', 'exp_006', 'a b/exp_1', 'unknown')) AS x(agent_id, exp_id, parent, verdict)")
def parent_check(t: Tables) -> DataFrame:
    """Parents of experiment notes against the agent's own index and the shared log."""
    log = LOG.df(t.spark).select("agent_id", "exp_id")
    return traces.parent_check(NOTES.df(t.spark), log, log)


CALLS = Fixture("calls", "id long, said string, target string", [
    (1, "f(a=1, b=(2, [3]))", "f(b=[2, [3]], a=1)"), (2, "f(a=1)", "g(a=1)"), (3, "f(a=1.0)", "f(a=1.5)"), (4, "f(a=1)|f(a=1)", "f(a=1)"), (5, "", "f(a='x')"), (6, "f(a='x', b=True)", "f(a='x', b=True)")])


@query("SELECT 6::BIGINT AS n, 2::BIGINT AS n_correct, round(2 / 6.0, 6)::DOUBLE AS accuracy")
def call_accuracy(t: Tables) -> DataFrame:
    """Function calls against their targets: the function and all arguments, tuples as lists."""
    d = CALLS.df(t.spark).select("id", F.explode(F.split("said", r"\|")).alias("c"), T.parse_call(F.col("target")).alias("target")).withColumn("c", T.parse_call(F.col("c")))
    d = d.groupBy("id", "target").agg(F.array_compact(F.collect_list("c")).alias("calls"))
    return judging.call_accuracy(d).withColumn("accuracy", r6("accuracy"))


@query("SELECT id, x AS call FROM (VALUES (1::BIGINT, 'f(a=1, b=[2, [3]])'), (2, 'f(a=1)'), (3, 'f(a=1.0)'), (6, 'f(a=x, b=True)')) AS v(id, x)")
def call_texts(t: Tables) -> DataFrame:
    """Calls read and written again."""
    d = CALLS.df(t.spark).select("id", T.call_text(T.parse_call(F.col("said"))).alias("call"))
    return d.where("call IS NOT NULL")


@query("""WITH o AS (SELECT p_partkey, unnest([{'h': md5('42/' || p_partkey || '/0'), 't': p_name, 'ok': TRUE}, {'h': md5('42/' || p_partkey || '/1'), 't': p_brand, 'ok': FALSE}, {'h': md5('42/' || p_partkey || '/2'), 't': p_type, 'ok': FALSE}]) AS s FROM part),
r AS (SELECT p_partkey, s.t AS t, s.ok AS ok, row_number() OVER (PARTITION BY p_partkey ORDER BY s.h) AS n FROM o), l AS (SELECT p_partkey, string_agg(t, '|' ORDER BY n) AS options, MIN(CASE WHEN ok THEN ['A', 'B', 'C'][n] END) AS target FROM r GROUP BY p_partkey)
SELECT * FROM l""")
def shuffled_choices(t: Tables) -> DataFrame:
    """Multiple choice: options in a seeded order, and the letter of the right one."""
    d = judging.choices(t("part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey", "p_name", ["p_brand", "p_type"])
    return d.select("p_partkey", F.array_join("options", "|").alias("options"), "target")


@query("SELECT COUNT(*) AS n, round(avg((p_size % 4 = 0)::INT::DOUBLE), 6) AS accuracy FROM part")
def choice_accuracy(t: Tables) -> DataFrame:
    """The share of questions answered with the target's letter; no answer is wrong."""
    d = judging.choices(t("part"), "p_partkey", "p_name", ["p_brand", "p_type"])
    d = d.withColumn("pick", F.when(F.col("p_size") % 4 == 0, F.col("target")).when(F.col("p_size") % 4 == 1, F.lit("Z")))
    return judging.choice_accuracy(d).withColumn("accuracy", r6("accuracy"))
