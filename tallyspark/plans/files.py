"""Queries over sources and sinks: files are written to a shared folder in the forms that runs leave, and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import audit, runs, traces
from ..sources import places, readers, sinks
from .base import Fixture, Tables, query, r6


def _folder(t: Tables, files: dict[str, str]) -> str:
    """A new shared folder with small files by name."""
    root = places.shared_folder(t.spark, "fixture")
    for name, content in files.items():
        places.put(t.spark, f"{root}/{name}", content)
    return root


RUNS = Fixture("runs", "method string, run string, accuracy double", [
    ("claude_10h_v5", "gsm8k_Qwen_Qwen3-4B_100", 0.5), ("claude_10h_v5", "gsm8k_Qwen_Qwen3-4B_207", 0.75), ("claude_10h_v5", "gsm8k_Qwen_Qwen3-4B_999", 0.9), ("claude_10h_v5", "bfcl_google_gemma-3_150", 0.25),
    ("codexlow_1h", "gsm8k_Qwen_Qwen3-4B_120", 0.125), ("codexlow_1h", "oddname", 0.3), ("codex_testing", "gsm8k_Qwen_Qwen3-4B_130", 0.2), ("baseline", "gsm8k_Qwen_Qwen3-4B_140", 0.1), (".cache", "gsm8k_Qwen_Qwen3-4B_150", 0.1)])


@query(f"""WITH {RUNS.cte}, p AS (SELECT *, regexp_extract(run, '^([^_]+)_(.+)_([0-9]+)$', 1) AS benchmark, regexp_extract(run, '^([^_]+)_(.+)_([0-9]+)$', 2) AS model, TRY_CAST(regexp_extract(run, '^([^_]+)_(.+)_([0-9]+)$', 3) AS BIGINT) AS run_id FROM runs),
r AS (SELECT *, row_number() OVER (PARTITION BY method, benchmark, model ORDER BY run_id DESC) AS n FROM p WHERE run_id >= 100 AND run_id < 500 AND method <> 'baseline' AND method NOT LIKE '.%')
SELECT method, benchmark, model, run_id, accuracy FROM r WHERE n = 1""")
def latest_run_folders(t: Tables) -> DataFrame:
    """Two-level scan of run folders, names parsed, the latest run of each key inside a range, skipped methods left out."""
    root = _folder(t, {f"{m}/{r}/metrics.json": json.dumps({"accuracy": a}) for m, r, a in RUNS.rows})
    found = readers.run_files(t.spark, root, "metrics.json").select("method", "run", "path")
    found = runs.chosen(found, "method", skipped=("baseline",)).select("method", "path", readers.run_parts(F.col("run")).alias("p")).select("method", "path", "p.*")
    latest = readers.latest_runs(found.where("run_id IS NOT NULL"), ["method", "benchmark", "model"], "run_id", 100, 500)
    values = readers.named_files(t.spark, root, "metrics.json").select("path", F.get_json_object("content", "$.accuracy").cast("double").alias("accuracy"))
    return latest.join(values, "path").select("method", "benchmark", "model", "run_id", "accuracy")


NAMES = Fixture("names", "name string", [("a_b_c_12",), ("a_b_c_12_x",), ("gsm8k_Qwen_Qwen3-1.7B-Base_77",), ("aime2025_meta-llama_L_5",), ("plain",), ("a_b_c_d",), ("x_google_gemma_it_9",), ("q_w_9",)])


@query(f"""WITH {NAMES.cte}, p AS (SELECT name, string_split(name, '_') AS p FROM names),
r AS (SELECT name, 'four' AS rule, p[1] AS benchmark, p[3] AS model, TRY_CAST(p[4] AS BIGINT) AS run_id FROM p WHERE len(p) = 4 AND regexp_matches(p[4], '^[0-9]+$')
UNION ALL SELECT name, 'some', p[1], p[3], TRY_CAST(p[4] AS BIGINT) FROM p WHERE len(p) >= 4 AND regexp_matches(p[4], '^[0-9]+$')
UNION ALL SELECT name, 'last', regexp_extract(name, '^([^_]+)_(.+)_([0-9]+)$', 1), regexp_extract(name, '^([^_]+)_(.+)_([0-9]+)$', 2), regexp_extract(name, '^([^_]+)_(.+)_([0-9]+)$', 3)::BIGINT FROM names WHERE regexp_matches(name, '^([^_]+)_(.+)_([0-9]+)$')
UNION ALL SELECT name, 'organisation', rtrim(regexp_extract(name, '^(.*?)((Qwen_|google_|HuggingFaceTB_|meta-llama_).*)_[0-9]+$', 1), '_'), regexp_extract(name, '^(.*?)((Qwen_|google_|HuggingFaceTB_|meta-llama_).*)_([0-9]+)$', 2), regexp_extract(name, '_([0-9]+)$', 1)::BIGINT FROM names WHERE regexp_matches(name, '(Qwen_|google_|HuggingFaceTB_|meta-llama_).*_[0-9]+$'))
SELECT * FROM r""")
def run_name_rules(t: Tables) -> DataFrame:
    """The four rules by which run folders are named."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), readers.run_parts(F.col("name"), r).alias("p")) for r in ("four", "some", "last", "organisation")])
    return NAMES.df(t.spark).select("name", F.explode(rules).alias("x")).select("name", "x.rule", "x.p.*").where("run_id IS NOT NULL")


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def jsonl_round_trip(t: Tables) -> DataFrame:
    """Strict JSONL: every line parsed, rows numbered; written with blank lines between."""
    path = places.shared_folder(t.spark, "jsonl")
    c = t("conversations")
    lines = c.select(F.to_json(F.struct(*c.columns)).alias("value"))
    lines.unionAll(t.spark.createDataFrame([("",), ("  ",)], "value string")).write.text(path)
    return readers.jsonl_strict(t.spark, path, "conv_id LONG, turn LONG, role STRING, text STRING").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


CHATS = Fixture("chats", "line string", [
    ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}',), ('{"messages": [{"role": "user", "content": "a"}]}',), ("",), ("no json",),
    ('{"messages": [{"role": "user", "content": "a"}, {"role": "system", "content": "b"}]}',), ('{"messages": [{"role": null, "content": "a"}, {"role": "assistant", "content": "b"}]}',),
    ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "  "}]}',), ('{"other": 1}',)])


@query("SELECT * FROM (VALUES (1::BIGINT, 'too_few_messages'), (3, 'invalid_json'), (4, 'missing_role'), (5, 'missing_role'), (6, 'empty_content_1'), (7, 'too_few_messages'), (0, 'good')) AS x(row, reason)")
def jsonl_chat_violations(t: Tables) -> DataFrame:
    """Chat lines: the first rule that each bad line breaks, with its row; blank lines count as rows."""
    root = _folder(t, {"chats.jsonl": "\n".join(r[0] for r in CHATS.rows) + "\n"})
    good, bad = readers.chat_rows(t.spark, f"{root}/chats.jsonl")
    return bad.unionByName(good.select("row", F.lit("good").alias("reason")))


@query("SELECT item_id, sha256(text) AS sha FROM benchmark")
def jsonl_with_comments(t: Tables) -> DataFrame:
    """A hash index in JSONL with comment lines."""
    path = places.shared_folder(t.spark, "index")
    lines = t("benchmark").select(F.to_json(F.struct("item_id", F.sha2("text", 256).alias("sha"))).alias("value"))
    lines.unionAll(t.spark.createDataFrame([("# index v1",), ("  # {}",)], "value string")).write.text(path)
    return readers.jsonl_commented(t.spark, path, "item_id LONG, sha STRING")


def _answers(t: Tables) -> DataFrame:
    """Answers of two models as JSONL files by model; the even one answers some questions twice, the later line counts.

    Executors write the files, all lines of a question to the same one; the driver only names them."""
    e = t("events").select("event_id", "value")
    first = e.select(F.col("event_id").alias("uid"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("model"), "value", F.lit(0).alias("late"))
    again = e.select((F.col("event_id") - F.col("event_id") % 2).alias("uid"), F.lit("even").alias("model"), (F.col("value") + F.col("event_id")).alias("value"), (F.col("event_id") % 2 + 1).alias("late"))
    root = places.shared_folder(t.spark, "answers")
    rows = first.unionAll(again)
    for m in ("even", "odd"):
        rows.where(F.col("model") == m).repartition("uid").sortWithinPartitions("late", "uid").select(F.to_json(F.struct("uid", "value")).alias("value")).write.text(f"{root}/{m}")
        for i, name in enumerate(n for n in places.names_in(t.spark, f"{root}/{m}") if n.endswith(".txt")):
            places.rename(t.spark, f"{root}/{m}/{name}", f"{root}/part/{i}/{m}.jsonl")
    return readers.jsonl_by_stem(t.spark, f"{root}/part/*/*.jsonl", "uid LONG, value DOUBLE", "uid")


_LAST = """r AS (SELECT event_id AS uid, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, value, 0 AS late FROM events UNION ALL SELECT event_id - event_id % 2, 'even', value + event_id, event_id % 2 + 1 FROM events),
l AS (SELECT uid, model, value FROM r QUALIFY row_number() OVER (PARTITION BY model, uid ORDER BY late DESC) = 1)"""


@query(f"WITH {_LAST} SELECT model, COUNT(*) AS n, round(SUM(value), 4) AS total FROM l GROUP BY model")
def answers_by_stem(t: Tables) -> DataFrame:
    """JSONL files named after models; the last line of a question wins."""
    return _answers(t).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {_LAST} SELECT uid, COUNT(*) AS n, round(SUM(CASE WHEN model = 'even' THEN value END), 6) AS even, round(SUM(CASE WHEN model = 'odd' THEN value END), 6) AS odd FROM l GROUP BY uid")
def answers_by_question(t: Tables) -> DataFrame:
    """The inverse: for every question a map of model to answer."""
    m = readers.by_key_then_model(_answers(t), "uid")
    return m.select("uid", F.size("rows").cast("long").alias("n"), r6(F.try_element_at("rows", F.lit("even"))["value"]).alias("even"), r6(F.try_element_at("rows", F.lit("odd"))["value"]).alias("odd"))


@query("SELECT judge, COUNT(*) AS n, COUNT(score) AS n_scored, COUNT(note) AS n_noted FROM (SELECT 'a' AS judge, event_type AS score, NULL AS note FROM events UNION ALL SELECT 'b', NULL, event_type FROM events WHERE value > 50) GROUP BY judge")
def judgments_of_judges(t: Tables) -> DataFrame:
    """Judgment files of several judges, columns met by name."""
    root = places.shared_folder(t.spark, "judgments")
    e = t("events")
    for judge, d in (("a", e.select("event_id", F.col("event_type").alias("score"))), ("b", e.where("value > 50").select("event_id", F.col("event_type").alias("note")))):
        d.write.json(f"{root}/{judge}/part")
        for i, name in enumerate(n for n in places.names_in(t.spark, f"{root}/{judge}/part") if n.endswith(".json")):
            places.rename(t.spark, f"{root}/{judge}/part/{name}", f"{root}/{judge}/{i}.jsonl")
    d = readers.judgments(t.spark, root, ["a", "b"])
    return d.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.count("note").alias("n_noted"))


_GRID = "SELECT c_mktsegment, n_regionkey, round(avg(c_acctbal), 2) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING COUNT(*) > 8"


@query(f"""WITH g AS ({_GRID}), r AS (SELECT DISTINCT c_mktsegment FROM g), c AS (SELECT unnest(range(5)) AS n_regionkey)
SELECT c_mktsegment AS model, 'r' || n_regionkey AS "column", v AS value FROM r CROSS JOIN c LEFT JOIN g USING (c_mktsegment, n_regionkey)""")
def csv_grid_round_trip(t: Tables) -> DataFrame:
    """A wide CSV grid with a sorted header, read back as cells; missing cells are empty."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("c_mktsegment", F.concat(F.lit("r"), "n_regionkey").alias("column")).agg(F.round(F.avg("c_acctbal"), 2).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 8").drop("n")
    path = places.shared_folder(t.spark, "grid")
    sinks.wide_csv(g.withColumnRenamed("c_mktsegment", "model"), path, "model", "column", "v", [f"r{i}" for i in range(5)])
    return readers.grid(t.spark, path).select("model", "column", "value")


@query("SELECT o_orderpriority AS method, COUNT(*)::VARCHAR AS n FROM orders GROUP BY 1")
def csv_with_comment(t: Tables) -> DataFrame:
    """A narrow CSV behind a ``# schema_version`` line."""
    rows = t("orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count(F.lit(1)).alias("n")).collect()
    root = _folder(t, {"log.csv": "# schema_version=3\nmethod,n\n" + "".join(f"{r['method']},{r['n']}\n" for r in rows)})
    return readers.commented_csv(t.spark, f"{root}/log.csv")


@query("SELECT l_returnflag, l_linestatus, COUNT(*)::VARCHAR AS n, round(avg(l_tax), 6)::VARCHAR AS tax FROM lineitem GROUP BY ALL")
def narrow_csv_round_trip(t: Tables) -> DataFrame:
    """A narrow result table as CSV."""
    path = places.shared_folder(t.spark, "narrow")
    sinks.narrow_csv(t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_tax")).alias("tax")), path)
    return t.spark.read.option("header", "true").csv(path)


@query("SELECT * FROM (VALUES ('zeroshot', 'm1', 'gsm8k', 0.5::DOUBLE), ('zeroshot', 'm1', 'bfcl', 0.25), ('zeroshot', 'm2', 'gsm8k', 1), ('fewshot', 'm1', 'gsm8k', 0.75)) AS x(setting, model, benchmark, value)")
def nested_configuration(t: Tables) -> DataFrame:
    """A JSON object of objects of objects of numbers, over several lines."""
    root = _folder(t, {"baselines.json": json.dumps({"zeroshot": {"m1": {"gsm8k": 0.5, "bfcl": 0.25}, "m2": {"gsm8k": 1}}, "fewshot": {"m1": {"gsm8k": 0.75}}}, indent=2)})
    return readers.nested_numbers(t.spark, f"{root}/baselines.json")


@query("SELECT * FROM (VALUES ('judge_model', 'gpt-4.1'), ('temperature', '0.0'), ('max_tokens', '16000'), ('bench_name', 'arena-hard'), ('regex_patterns.0', '\\[\\[x\\]\\]'), ('regex_patterns.1', 'y'), ('reference', 'null'), ('settings.deep.flag', 'true')) AS x(name, value)")
def yaml_configuration(t: Tables) -> DataFrame:
    """A YAML configuration's leaves."""
    text = "# judge\njudge_model: gpt-4.1\ntemperature: 0.0\nmax_tokens: 16000 # most\nbench_name: \"arena-hard\"\nregex_patterns:\n  - '\\[\\[x\\]\\]'\n  - y\nreference: null\nsettings:\n  deep:\n    flag: true\n"
    root = _folder(t, {"arena.yaml": text})
    return readers.settings(t.spark, f"{root}/arena.yaml")


VERDICTS = Fixture("verdicts", "run string, contamination string, disallowed string, has_output boolean", [
    ("a", "contamination detected\n", "only allowed use detected", False), ("b", " no contamination detected ", None, False), ("c", "something", "disallowed use detected", False), ("d", None, None, False), ("e", "no contamination detected", "disallowed use detected", True)])


@query(f"""WITH {VERDICTS.cte}, v AS (SELECT *, CASE trim(contamination, chr(10) || ' ') WHEN 'contamination detected' THEN TRUE WHEN 'no contamination detected' THEN FALSE END AS c, CASE trim(disallowed) WHEN 'disallowed use detected' THEN TRUE WHEN 'only allowed use detected' THEN FALSE END AS d FROM verdicts),
a AS (SELECT *, CASE WHEN has_output THEN 'skip_exists' WHEN contamination IS NULL AND disallowed IS NULL THEN 'skip_no_input' WHEN (contamination IS NOT NULL AND c IS NULL) OR (disallowed IS NOT NULL AND d IS NULL) THEN 'error' ELSE 'would_migrate' END AS action FROM v)
SELECT run, action, CASE WHEN action = 'would_migrate' THEN '{{' || concat_ws(',', '"contamination_detected":' || c, '"disallowed_model_detected":' || d) || '}}' END AS judge_result,
 CASE WHEN contamination IS NULL THEN 'ERR' WHEN c THEN 'True' WHEN NOT c THEN 'False' ELSE 'IMPORTANT ERR' END AS flag FROM a""")
def judgement_migration(t: Tables) -> DataFrame:
    """Whole judgement files of fixed texts: their flags, and what a migration to JSON would do."""
    files = {f"{r}/{n}_judgement.txt": v for r, c, d, _ in VERDICTS.rows for n, v in (("contamination", c), ("disallowed_model", d)) if v is not None}
    root = _folder(t, files)
    at = lambda n, c: readers.whole_files(t.spark, f"{root}/*/{n}_judgement.txt").select(places.name_of("path", 1).alias("run"), F.col("content").alias(c))
    d = VERDICTS.df(t.spark).select("run", "has_output").join(at("contamination", "contamination"), "run", "left").join(at("disallowed_model", "disallowed"), "run", "left")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    d = d.withColumns({"contamination": strip("contamination"), "disallowed": strip("disallowed")})
    flag = runs.judgement(F.col("contamination"), "contamination detected", "no contamination detected").alias("flag")
    return runs.migration(d).join(d.select("run", flag), "run")


@query("SELECT * FROM (VALUES ('a', 'terminated'), ('b', 'killed'), ('c', 'clean'), ('d', 'clean')) AS x(run, kind)")
def error_log_heads(t: Tables) -> DataFrame:
    """The first 4096 bytes of error logs, classified; what stands later does not count."""
    root = _folder(t, {"a/error.log": "x\nTerminated by signal\n", "b/error.log": "run_task.sh: line 9: 12 Killed\n", "c/error.log": "fine é\n", "d/error.log": "x" * 5000 + "Terminated"})
    h = readers.log_heads(t.spark, f"{root}/*/error.log")
    return h.select(places.name_of("path", 1).alias("run"), traces.error_kind(F.col("head")).alias("kind"))


TRACE = ['[2024-01-02T03:04:05Z] {"type": "init", "n": 1}', '{"type": "text", "n": 2}', "", "not json", "[2024-01-02T03:04:06Z] also {bad", '{"type": "done"}']


@query("""SELECT * FROM (VALUES ('structured', 1::BIGINT, 'event', 'init', TIMESTAMP '2024-01-02 03:04:05', TRUE), ('structured', 2, 'event', 'text', NULL, TRUE), ('structured', 4, 'bad', NULL, NULL, TRUE), ('structured', 5, 'bad', NULL, NULL, TRUE), ('structured', 6, 'event', 'done', NULL, TRUE),
('plain', 1, 'bad', NULL, NULL, FALSE)) AS x(file, line_no, kind, type, ts, structured)""")
def trace_events(t: Tables) -> DataFrame:
    """Trace lines with and without time stamps; bad lines are told apart; the format is sniffed from the first lines."""
    root = _folder(t, {"structured.jsonl": "\n".join(TRACE) + "\n", "plain.jsonl": "hello\n"})
    good, bad = readers.trace_lines(t.spark, f"{root}/*.jsonl")
    stem = F.regexp_extract("file", r"([^/]*)\.jsonl$", 1).alias("file")
    a = good.select(stem, "line_no", F.lit("event").alias("kind"), F.try_variant_get("event", "$.type", "string").alias("type"), "ts")
    b = bad.select(stem, "line_no", F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("timestamp").alias("ts"))
    lines = good.select("file", "line_no", "line").unionByName(bad)
    return a.unionByName(b).join(readers.is_structured(lines).select(stem, "structured"), "file")


TEMPLATES = Fixture("templates", "method string, run string, template string, config string", [
    ("claude_10h_v1", "r1", "{{ x }}\n<think>", "unused"), ("claude_10h_v1", "r2", None, "{{ x }}\n<think>"), ("claude_10h_v1", "r3", " {{ tools }} ", None), ("gemini_1h_v2", "r1", "{{ x }}\n<think>\n", None), ("gemini_1h_v2", "r2", None, "{{ y }}"), ("gemini_1h_v2", "r3", None, None)])


def _template_root(t: Tables) -> str:
    files = {}
    for m, r, a, c in TEMPLATES.rows:
        files[f"{m}/{r}/final_model/config.json"] = "{}"
        if a is not None:
            files[f"{m}/{r}/final_model/chat_template.jinja"] = a
        if c is not None:
            files[f"{m}/{r}/final_model/tokenizer_config.json"] = json.dumps({"chat_template": c})
    return _folder(t, files)


@query(f"""WITH {TEMPLATES.cte}, x AS (SELECT trim(COALESCE(template, config), chr(10) || ' ') AS t FROM templates WHERE COALESCE(template, config) IS NOT NULL)
SELECT substr(md5(t), 1, 8) AS hash, COUNT(*) AS n, MIN(len(string_split(t, chr(10))))::INT AS lines, MIN(CASE WHEN contains(t, 'tools') THEN 'tool_calling' WHEN contains(t, '<think>') THEN 'thinking' ELSE 'basic' END) AS features FROM x GROUP BY t""")
def chat_template_groups(t: Tables) -> DataFrame:
    """Chat templates of final models, from the first source that has one, in groups of equal text."""
    d = readers.templates(t.spark, _template_root(t))
    return traces.template_groups(d.withColumn("template", F.regexp_replace("template", r"^\s+|\s+$", "")))


@query(f"""WITH {TEMPLATES.cte}, x AS (SELECT method, trim(COALESCE(template, config), chr(10) || ' ') AS t FROM templates WHERE COALESCE(template, config) IS NOT NULL)
SELECT method, SUM((t <> '{{{{ x }}}}' || chr(10) || '<think>')::INT)::BIGINT AS different, COUNT(*) AS total, round(100.0 * SUM((t <> '{{{{ x }}}}' || chr(10) || '<think>')::INT) / COUNT(*), 1) AS pct FROM x GROUP BY method HAVING different > 0""")
def different_templates(t: Tables) -> DataFrame:
    """Runs of each method whose chat template is not the usual one, beside all its runs."""
    d = readers.templates(t.spark, _template_root(t))
    return traces.different_share(d.withColumn("template", F.regexp_replace("template", r"^\s+|\s+$", "")), "{{ x }}\n<think>")


@query("SELECT * FROM (VALUES ('m/r1/final_model/a.safetensors'), ('m/r1/final_model/b.safetensors')) AS x(path)")
def weights_beside_metrics(t: Tables) -> DataFrame:
    """Weights in final_model folders, at any depth, whose run has metrics."""
    root = _folder(t, {"m/r1/final_model/a.safetensors": "", "m/r1/final_model/b.safetensors": "", "m/r1/final_model/x.json": "", "m/r1/metrics.json": "{}", "m/r2/final_model/a.safetensors": "", "m/r2/other/metrics.json": "{}", "m/r3/a.safetensors": "", "m/r3/metrics.json": "{}"})
    d = readers.with_sibling(t.spark, root, "final_model", "metrics.json", ".safetensors")
    return d.select(F.regexp_extract("path", r"(m/.*)$", 1).alias("path"))


@query("SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand")
def pinned_dataset(t: Tables) -> DataFrame:
    """A dataset at one revision of several."""
    root = places.shared_folder(t.spark, "dataset")
    p = t("part").select("p_partkey", "p_brand")
    p.write.parquet(f"{root}/rev-1")
    p.where("p_partkey < 0").write.parquet(f"{root}/rev-2")
    return readers.pinned(t.spark, root, "rev-1").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT key, round(avg(v), 6) AS mean, round(COALESCE(stddev_samp(v), 0), 6) AS std, round(COALESCE(stddev_samp(v), 0) / sqrt(COUNT(v)), 6) AS stderr, MIN(v) AS min, MAX(v) AS max, COUNT(v) AS n
FROM (VALUES ('accuracy', 0.5::DOUBLE), ('accuracy', 0.75), ('accuracy', 0.25), ('stderr', 0.1), ('stderr', 0.3), ('n', 10), ('only', 4)) AS x(key, v) GROUP BY key""")
def metric_files_summary(t: Tables) -> DataFrame:
    """Numeric fields of metric files over runs, keys united; booleans and texts are no numbers."""
    root = _folder(t, {"r1/metrics.json": '{"accuracy": 0.5, "stderr": 0.1, "ok": true}', "r2/metrics.json": '{\n"accuracy": 0.75, "n": 10, "note": "0.9"}', "r3/metrics.json": '{"accuracy": 0.25, "stderr": 0.3, "only": 4, "list": [1]}'})
    m = readers.metric_files(t.spark, f"{root}/*/metrics.json")
    return runs.summary(m, "key", "value").withColumns({"mean": r6("mean"), "std": r6("std"), "stderr": r6("stderr")})


@query("SELECT * FROM (VALUES ('m/r1', 'm/r5', 'm/r6'), ('m/r1', 'm/r6', NULL)) AS x(a, b, c)")
def runs_without_metrics(t: Tables) -> DataFrame:
    """Runs without metrics: all, and those with a final model, minus an ignore list."""
    names = ["r1/final_model/w", "r2/metrics.json", "r2/final_model/w", "r3/final_model/w", "r5/log.txt", "r6/final_model/w"]
    root = _folder(t, {f"m/{n}": "" for n in names})
    f = places.files_below(t.spark, root).select(F.regexp_extract("path", r"/(m/[^/]+)/(.*)$", 1).alias("run"), F.regexp_extract("path", r"/(m/[^/]+)/(.*)$", 2).alias("file"))
    row = lambda d: d.agg(F.array_sort(F.collect_list("run")).alias("x")).select(F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), F.get("x", F.lit(2)).alias("c"))
    return row(runs.without_metrics(f, ["m/r3"], everything=True)).unionAll(row(runs.without_metrics(f, ["m/r3"])))


@query("""SELECT o_orderpriority AS k, '{"n":' || COUNT(*) || ',"span":{"lo":' || MIN(o_orderkey) || ',"hi":' || MAX(o_orderkey) || '}}' AS report FROM orders GROUP BY 1""")
def json_report_round_trip(t: Tables) -> DataFrame:
    """A nested JSON report, one object a row."""
    path = places.shared_folder(t.spark, "report")
    g = t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.struct(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).alias("span"))
    sinks.json_report(g, path)
    back = t.spark.read.text(path)
    v = F.get_json_object("value", "$.o_orderpriority").alias("k")
    return back.select(v, F.concat(F.lit('{"n":'), F.get_json_object("value", "$.n"), F.lit(',"span":'), F.get_json_object("value", "$.span"), F.lit("}")).alias("report"))


@query("SELECT o_orderpriority AS exp_id, COUNT(*) AS row_count FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 UNION ALL SELECT o_orderpriority, COUNT(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def versioned_log(t: Tables) -> DataFrame:
    """Two appends to a versioned log beside rows of an older schema; the present version is read."""
    path = places.shared_folder(t.spark, "log")
    n = lambda d: d.groupBy(F.col("o_orderpriority").alias("exp_id")).agg(F.count(F.lit(1)).alias("row_count"))
    old = n(t("orders")).withColumnRenamed("row_count", "rows")
    sinks.append_versioned(old, path, ["exp_id", "rows"], 2)
    for d in (t("orders").where("o_orderstatus <> 'F'"), t("orders").where("o_orderstatus = 'F'")):
        sinks.append_versioned(n(d), path, ["exp_id", "row_count"], 3)
    return sinks.read_versioned(t.spark, path, 3)


@query("SELECT sha256(text) AS sha256, COUNT(DISTINCT text) AS n FROM documents GROUP BY 1")
def content_addressed_copy(t: Tables) -> DataFrame:
    """Texts kept once by content, appended twice."""
    path = places.shared_folder(t.spark, "content")
    d = t("documents").select("text")
    none = t.spark.createDataFrame([], "sha256 string")
    sinks.append_by_content(d, none, path, "text")
    sinks.append_by_content(d, t.spark.read.parquet(path), path, "text")
    return t.spark.read.parquet(path).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE value > 20")
def jsonl_append(t: Tables) -> DataFrame:
    """Results appended in two runs, the second one skipping what is there."""
    path = places.shared_folder(t.spark, "results")
    e = t("events").select("event_id", "event_type", "value").where("value > 20")
    sinks.append_jsonl(e.where("value > 60").drop("value"), path)
    done = t.spark.read.schema("event_id LONG, event_type STRING").json(path)
    done = audit._written(done, "done")
    sinks.append_jsonl(e.drop("value").join(done, "event_id", "left_anti"), path)
    return t.spark.read.schema("event_id LONG, event_type STRING").json(path)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_wins_rewrite(t: Tables) -> DataFrame:
    """A file rewritten sorted, the last line of a key kept."""
    return sinks.last_wins(t("events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT md5(string_agg(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(10) ORDER BY turn)) AS report_md5, COUNT(text) AS n FROM conversations GROUP BY conv_id")
def text_reports(t: Tables) -> DataFrame:
    """One rendered text for each conversation, written and read whole."""
    path = places.shared_folder(t.spark, "reports")
    c = t("conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    sinks.text_report(c, path, "conv_id", "turn", "text", separator="\x01")
    back = t.spark.read.text(path).select(F.split("value", "\x01").alias("x"))
    return back.select(F.md5(F.array_join("x", "\n")).alias("report_md5"), F.size("x").cast("long").alias("n"))


COPIES = Fixture("copies", "run string, file string, content string", [("a", "solve.txt", "key sk-live-abcdefgh-0001 and sk-live-abZZ9 end"), ("a", "notes.md", "clean"), ("b", "solve.txt", "x sk-ant-y z" + "." * 80)])


@query(f"""WITH {COPIES.cte}, w AS (SELECT * FROM (VALUES ('a'), ('b')) AS x(run), (VALUES ('solve.txt'), ('notes.md')) AS y(file))
SELECT w.run, w.file, COALESCE(regexp_replace(replace(content, 'sk-live-abcdefgh-0001', '<omitted-api-key>'), 'sk-live-ab[A-Za-z0-9_-]+', '<omitted-api-key>', 'g'), 'No ' || w.file || ' produced.') AS content,
 CASE WHEN contains(content, 'sk-ant-') THEN substr(content, greatest(strpos(content, 'sk-ant-') - 50, 1), strpos(content, 'sk-ant-') + 50 - greatest(strpos(content, 'sk-ant-') - 50, 1)) END AS context FROM w LEFT JOIN copies c ON w.run = c.run AND w.file = c.file""")
def sanitised_copies(t: Tables) -> DataFrame:
    """Files copied without secrets, a note where none was produced, a warning where a key's beginning is left."""
    found = COPIES.df(t.spark)
    wanted = t.spark.createDataFrame([(r, f) for r in "ab" for f in ("solve.txt", "notes.md")], "run string, file string")
    out = sinks.sanitised(wanted, found, ["run", "file"], ["sk-live-abcdefgh-0001"])
    return out.join(sinks.context_warnings(found, ["run", "file"], ["sk-ant-"]).drop("pattern"), ["run", "file"], "left")


@query("SELECT * FROM (VALUES ('gsm8k', TRUE, FALSE), ('bfcl', TRUE, TRUE), ('broken', FALSE, FALSE)) AS x(benchmark, complete, has_context)")
def benchmark_contract(t: Tables) -> DataFrame:
    """Benchmark folders and whether they keep the contract."""
    root = _folder(t, {n: "" for n in ("gsm8k/evaluate.py", "gsm8k/benchmark.txt", "bfcl/evaluate.py", "bfcl/benchmark.txt", "bfcl/task_context/x.md", "broken/evaluate.py")})
    f = places.files_below(t.spark, root).select(F.regexp_extract("path", r"/fixture-[^/]+/([^/]+)/(.*)$", 1).alias("benchmark"), F.regexp_extract("path", r"/fixture-[^/]+/([^/]+)/(.*)$", 2).alias("file"))
    return runs.benchmark_folders(f)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'clicked ' || props WHEN 'purchase' THEN 'bought for ' || CAST(floor(value) AS BIGINT) ELSE 'other' END AS shown FROM events""")
def event_handlers(t: Tables) -> DataFrame:
    """A table of handlers, one a type, with one for the rest: a chain of conditions to Spark."""
    h = registry.Handlers()
    h.add("click", lambda: F.concat(F.lit("clicked "), F.col("props")))
    h.add("purchase", lambda: F.concat(F.lit("bought for "), F.floor("value").cast("string")))
    return t("events").select("event_id", h.column(F.col("event_type"), F.lit("other")).alias("shown"))


@query("SELECT event_id, upper(event_type) || '!' AS shouted FROM events")
def registered_function(t: Tables) -> DataFrame:
    """A backend registered by name and called through SQL."""
    registry.FUNCTIONS.register_all(t.spark)
    return t("events").selectExpr("event_id", "shout(event_type) AS shouted")
