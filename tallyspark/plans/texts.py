"""Queries over text, time, number and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import judging, traces
from .base import Fixture, Tables, query


@query("""SELECT doc_id, regexp_replace(source || '/' || lang || ':[' || doc_id || ']', '[/:\\[\\]]', '_', 'g') AS safe, substr(text, 1, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS preview,
 split_part(source || '/' || lang, '/', -1) AS alias, lower(regexp_replace('Qwen3BaseModel' || source, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS cache_key FROM documents""")
def names_and_previews(t: Tables) -> DataFrame:
    """Path-safe names, previews, model aliases, cache keys."""
    path = F.concat("source", F.lit("/"), "lang")
    return t("documents").select(
        "doc_id", T.path_safe(F.concat(path, F.lit(":["), F.col("doc_id").cast("string"), F.lit("]"))).alias("safe"), T.preview(F.col("text"), 80).alias("preview"),
        T.model_alias(path).alias("alias"), T.cache_key(F.concat(F.lit("Qwen3BaseModel"), "source")).alias("cache_key"))


@query("""SELECT conv_id, turn, substr(md5(text), 1, 8) AS md5_prefix, sha256(text) AS sha FROM conversations""")
def text_hashes(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", F.substring(F.md5("text"), 1, 8).alias("md5_prefix"), F.sha2("text", 256).alias("sha"))


NOTES = Fixture("notes", "id long, text string", [
    (1, "# exp_1\n\n## Parent\nnone\n## Hypothesis\n\n## Better data wins\n more\n## Method\nsteps\n## Other\nstays\n## Conclusion\n done \n"), (2, "# exp_2\n first line\n## Method\nx\n"), (3, "## Hypothesis\nold\n## Hypothesis\nnew one\n"), (4, "")])


@query("""SELECT * FROM (VALUES (1::BIGINT, 'Parent', 'none'), (1, 'Hypothesis', '## Better data wins' || chr(10) || ' more'), (1, 'Method', 'steps' || chr(10) || '## Other' || chr(10) || 'stays'), (1, 'Conclusion', 'done'), (2, 'Method', 'x'), (3, 'Hypothesis', 'new one')) AS x(id, section, body)""")
def notes_sections(t: Tables) -> DataFrame:
    """Sections of experiment notes; of equal names the last one."""
    return traces.notes_sections(NOTES.df(t.spark), "id", "text", ["Parent", "Hypothesis", "Method", "Conclusion", "PivotReason"])


@query("SELECT * FROM (VALUES (1::BIGINT, 'Better data wins'), (2, 'first line'), (3, 'new one'), (4, '')) AS x(id, strategy)")
def note_strategies(t: Tables) -> DataFrame:
    """The strategy line of experiment notes: of the hypothesis, else of the notes."""
    n = NOTES.df(t.spark)
    h = traces.notes_sections(n, "id", "text", ["Parent", "Hypothesis", "Method", "Conclusion", "PivotReason"]).where("section = 'Hypothesis'").select("id", "body")
    return n.join(h, "id", "left").select("id", T.strategy(F.col("body"), F.col("text")).alias("strategy"))


ANSWERS = Fixture("answers", "id long, text string", [
    (1, "<think>hm [[A>B]]</think> so [[b>>a]]"), (2, "<think>never closed [[A=B]]"), (3, "plain [A>B] and [[A=B]] then [[A<B]]"), (4, "only [b>a]"), (5, "none"), (6, "a <think>x</think> [[B=A]]")])


@query(f"""WITH {ANSWERS.cte}, s AS (SELECT id, text, CASE WHEN starts_with(text, '<think>') AND contains(text, '</think>') THEN trim(split_part(text, '</think>', 2)) ELSE text END AS strict, CASE WHEN starts_with(text, '<think>') THEN trim(split_part(text, '</think>', -1)) ELSE text END AS loose FROM answers)
SELECT id, strict, loose, COALESCE(regexp_extract_all(upper(strict), '\\[\\[([AB<>=]+)\\]\\]', 1)[-1], regexp_extract_all(upper(strict), '\\[([AB<>=]+)\\]', 1)[-1]) AS verdict FROM s""")
def verdicts(t: Tables) -> DataFrame:
    """Thoughts taken off in both ways, and the last verdict of the first pattern that is there."""
    s = ANSWERS.df(t.spark).select("id", T.strip_think(F.col("text"), True).alias("strict"), T.strip_think(F.col("text"), False).alias("loose"))
    return s.select("id", "strict", "loose", T.verdict(F.col("strict")).alias("verdict"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN event_id * 7 END AS tokens, CASE WHEN event_type <> 'error' THEN round(value / 10, 4) END AS cost FROM events""")
def log_usage(t: Tables) -> DataFrame:
    """Token counts and costs out of log texts."""
    log = F.concat(F.lit("start\n"), F.when(F.col("event_type") == "click", F.concat(F.lit("tokens used\n"), F.format_number(F.col("event_id") * 7, 0), F.lit("\n"))).otherwise(F.lit("")),
                   F.when(F.col("event_type") != "error", F.concat(F.lit('{"type": "result", "total_cost_usd": '), F.round(F.col("value") / 10, 4).cast("string"), F.lit("}\n"))).otherwise(F.lit('{"type":"other"}\n')))
    return t("events").select("event_id", traces.token_count(log).alias("tokens"), traces.result_cost(log).alias("cost"))


@query("SELECT doc_id, md5('Ask: ' || text || ' in ' || lang || ' / ' || lang || ' <<keep>>') AS prompt_md5 FROM documents")
def filled_prompts(t: Tables) -> DataFrame:
    """Prompt templates with named places, in two styles of marks."""
    a = T.fill(F.lit("Ask: {question} in {lang} / <<lang>> <<keep>>"), {"question": F.col("text"), "lang": F.col("lang")})
    return t("documents").where("text IS NULL OR NOT contains(text, '<<')").select("doc_id", F.md5(T.fill(a, {"lang": F.col("lang")}, "<<", ">>")).alias("prompt_md5"))


PATHS = Fixture("paths", "path string, architecture string", [("hub/Qwen3-1.7B", None), ("x/final", "LlamaForCausalLM"), ("google_GEMMA-3", "x"), ("a/SmolLM3", None), ("final", "Gemma3ForCausalLM"), ("z", "Qwen3ForCausalLM"), ("llama-qwen", None)])


@query(f"WITH {PATHS.cte} SELECT path, CASE path WHEN 'hub/Qwen3-1.7B' THEN 'qwen' WHEN 'x/final' THEN 'llama' WHEN 'google_GEMMA-3' THEN 'gemma' WHEN 'a/SmolLM3' THEN 'smollm' WHEN 'final' THEN 'gemma' ELSE 'qwen' END AS family FROM paths")
def model_families(t: Tables) -> DataFrame:
    return PATHS.df(t.spark).select("path", T.model_family(F.col("path"), F.col("architecture")).alias("family"))


@query("""SELECT conv_id, turn, CASE WHEN text = '' THEN '>' ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) END AS shown FROM (SELECT conv_id, turn, replace(role || chr(10) || chr(10) || turn, chr(13), ' ') AS text FROM conversations)""")
def indented_lines(t: Tables) -> DataFrame:
    """Indented lines; long ones are wrapped at words (none is here: tests cover the wrapping)."""
    text = F.concat("role", F.lit("\n\n"), F.col("turn").cast("string"))
    return t("conversations").select("conv_id", "turn", T.wrapped(text, "> ", 200).alias("shown"))


TURNS = Fixture("turns", "id long, at int, role string, content string", [
    (1, 0, "system", "Be brief."), (1, 1, "user", " Hi "), (1, 2, "assistant", "<think>\nhm\n</think>\n\nHello"), (1, 3, "user", "More?"), (1, 4, "assistant", "<think>ok</think>Yes"),
    (2, 0, "user", "Sum"), (2, 1, "assistant", "<think>call</think>calling"), (2, 2, "tool", "41"), (2, 3, "tool", "42"), (2, 4, "assistant", "Done"),
    (3, 0, "user", "A"), (3, 1, "user", "<tool_response>x</tool_response>"), (3, 2, "assistant", "B")])

_THOUGHTS = {
    1: "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\n Hi <|im_end|>\n<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>user\nMore?<|im_end|>\n<|im_start|>assistant\n<think>\nok\n</think>\n\nYes<|im_end|>\n<|im_start|>assistant\n",
    2: "<|im_start|>user\nSum<|im_end|>\n<|im_start|>assistant\n<think>\ncall\n</think>\n\ncalling<|im_end|>\n<|im_start|>user\n<tool_response>\n41\n</tool_response>\n<tool_response>\n42\n</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nDone<|im_end|>\n<|im_start|>assistant\n",
    3: "<|im_start|>user\nA<|im_end|>\n<|im_start|>user\n<tool_response>x</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nB<|im_end|>\n<|im_start|>assistant\n"}
_MARKED = {
    1: "<bos><start_of_turn>user\nBe brief.\n\nHi<end_of_turn>\n<start_of_turn>model\n<think>\nhm\n</think>\n\nHello<end_of_turn>\n<start_of_turn>user\nMore?<end_of_turn>\n<start_of_turn>model\n<think>ok</think>Yes<end_of_turn>\n",
    2: "<bos><start_of_turn>user\nSum<end_of_turn>\n<start_of_turn>model\n<think>call</think>calling<end_of_turn>\n<start_of_turn>tool\n41<end_of_turn>\n<start_of_turn>tool\n42<end_of_turn>\n<start_of_turn>model\nDone<end_of_turn>\n",
    3: "<bos><start_of_turn>user\nA<end_of_turn>\n<start_of_turn>user\n<tool_response>x</tool_response><end_of_turn>\n<start_of_turn>model\nB<end_of_turn>\n"}
RENDERED = Fixture("rendered", "id long, thinking string, marked string", [(i, _THOUGHTS[i], _MARKED[i]) for i in _THOUGHTS])


@query(f"WITH {RENDERED.cte} SELECT * FROM rendered")
def chat_templates(t: Tables) -> DataFrame:
    """Chats in two templates: thoughts kept only after the last question, tool turns joined; marked turns with the system text in front."""
    m = F.array_sort(F.collect_list(F.struct("at", "role", "content")))
    g = TURNS.df(t.spark).groupBy("id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    return g.select("id", T.render_thinking(F.col("m"), prompt=True).alias("thinking"), T.render_turns(F.col("m")).alias("marked"))


@query("""SELECT event_id, strftime(make_timestamp(1700000000000000 + event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS shown, round((event_id * 3 - event_id) / 1000.0, 6) AS seconds,
 CASE WHEN left_ <= 0 THEN 'Timer expired!' ELSE (left_ // 3600) || ':' || lpad(((left_ % 3600) // 60)::VARCHAR, 2, '0') END AS remaining FROM (SELECT *, 36000 - event_id * 17 AS left_ FROM events)""")
def times(t: Tables) -> DataFrame:
    """Milliseconds as text, step durations, time left until a deadline."""
    e = F.col("event_id")
    return t("events").select("event_id", F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + e * 1000), "yyyy-MM-dd HH:mm:ss").alias("shown"),
                              F.round(traces.step_seconds(e, e * 3), 6).alias("seconds"), T.remaining(F.lit(1_700_000_000).cast("long"), F.lit(10).cast("long"), F.lit(1_700_000_000).cast("long") + e * 17).alias("remaining"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 20, 0), 1) AS clipped, round_even(l_orderkey / 4.0, 0)::BIGINT::VARCHAR AS halves FROM lineitem")
def numbers(t: Tables) -> DataFrame:
    """Clipping, and halves rounded to even as text."""
    return t("lineitem").select("l_orderkey", "l_linenumber", F.least(F.greatest(F.col("l_discount") * 20, F.lit(0.0)), F.lit(1.0)).alias("clipped"), T.half_even(F.col("l_orderkey") / 4.0).alias("halves"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id * 3 END AS n FROM events")
def number_or_sum_of_map(t: Tables) -> DataFrame:
    """A number, or an object of numbers as their sum."""
    j = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.format_string('{"h1": %d, "h2": %d}', "event_id", F.col("event_id") * 2))
    return t("events").select("event_id", T.count_of(F.parse_json(j)).alias("n"))


FENCED = Fixture("fenced", "id long, text string", [
    (1, '```json\n{"criteria_met": true, "explanation": "x"}\n```'), (2, '{"criteria_met": false}'), (3, '```\n{"criteria_met": "true"}\n```'), (4, "no json"), (5, '{"criteria_met": 1}'), (6, '```json\n{"other": 1}\n```')])


@query("SELECT * FROM (VALUES (1::BIGINT, TRUE, 'x'), (2, FALSE, NULL), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, NULL), (6, NULL, NULL)) AS x(id, met, explanation)")
def fenced_verdicts(t: Tables) -> DataFrame:
    """JSON in a fenced block, an empty object where there is none; only a boolean counts as one."""
    d = FENCED.df(t.spark).select("id", judging.fenced_json(F.col("text")).alias("v"))
    return d.select("id", judging.strict_bool(F.col("v"), "$.criteria_met").alias("met"), F.try_variant_get("v", "$.explanation", "string").alias("explanation"))


PRETTY = Fixture("pretty", "id long, text string, shown string", [
    (1, '{"a": 1, "b": [true, null], "c": "x\\ny", "d": {}}', '{\n  "a": 1,\n  "b": [\n    true,\n    null\n  ],\n  "c": x\ny,\n  "d": {}\n}'), (2, "no json", "no json"), (3, '"é"', '"é"')])


@query(f"WITH {PRETTY.cte} SELECT id, shown FROM pretty")
def pretty_json(t: Tables) -> DataFrame:
    return PRETTY.df(t.spark).select("id", T.pretty_json(F.col("text")).alias("shown"))


USED = Fixture("used", "scaffold string, text string", [
    ("codex", '{"usage": {"input_tokens": 5, "output_tokens": 7}}'), ("gemini", '{"stats": {"input_tokens": 11, "output_tokens": 2, "cost": 0.5}}'), ("opencode", '{"part": {"tokens": {"input": 3, "output": 4}, "cost": 0.25}}'), ("opencode", '{"part": {}}')])


@query("SELECT * FROM (VALUES ('codex', 5::BIGINT, 7::BIGINT, 0::DOUBLE), ('gemini', 11, 2, 0.5), ('opencode', 3, 4, 0.25), ('opencode', 0, 0, 0)) AS x(scaffold, tokens_in, tokens_out, cost)")
def scaffold_usage(t: Tables) -> DataFrame:
    """Token and cost fields where each scaffold keeps them."""
    d = USED.df(t.spark).withColumn("v", F.parse_json("text"))
    parts = [d.where(F.col("scaffold") == s).select("scaffold", traces.usage(F.col("v"), s).alias("u")).select("scaffold", "u.*") for s in traces.USAGE]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


TAGS = Fixture("tags", "id long, tags string", [(1, "axis:accuracy,theme:care"), (2, "theme:x:y,axis:b"), (3, ""), (4, "level:1,axis:a,axis:b")])


@query("SELECT * FROM (VALUES (1::BIGINT, 'accuracy', 'care', 0, 'axis:accuracy'), (1, 'accuracy', 'care', 1, 'theme:care'), (2, 'b', 'x', 0, 'theme:x:y'), (2, 'b', 'x', 1, 'axis:b'), (3, 'unknown', 'unknown', 0, ''), (4, 'a', 'unknown', 0, 'level:1'), (4, 'a', 'unknown', 1, 'axis:a'), (4, 'a', 'unknown', 2, 'axis:b')) AS x(id, axis, theme, place, tag)")
def tag_lookup(t: Tables) -> DataFrame:
    """The first tag of a kind, unknown without one; all tags with their place."""
    d = TAGS.df(t.spark).select("id", F.split("tags", ",").alias("tags"))
    return d.select("id", judging.tag(F.col("tags"), "axis:").alias("axis"), judging.tag(F.col("tags"), "theme:").alias("theme"), F.posexplode("tags").alias("place", "tag"))


@query("SELECT event_id, n FROM (SELECT user_id, event_type, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) JOIN (SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT user_id, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events))) USING (event_id) WHERE n <= 2")
def limited_lines(t: Tables) -> DataFrame:
    """At most two equal lines in a row."""
    from pyspark.sql import Window

    e = traces.limited_lines(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", 2)
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = e.withColumn("new", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return d.select("event_id", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("event_id")).cast("long").alias("n"))
