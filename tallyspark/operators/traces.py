"""Agent traces, experiment lineage and run health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cross_parent, parent_value, template_features
from ..sources.places import shared_folder


def turn_counters(rows: DataFrame, file: str, at: str, role: str) -> DataFrame:
    w, r = Window.partitionBy(file).orderBy(at), Window.partitionBy(file, role).orderBy(at)
    return rows.withColumn("event_no", F.row_number().over(w).cast("long")).withColumn("role_no", F.row_number().over(r).cast("long"))


def consolidate(events: DataFrame, part: str, at: list[str], kind: str, ts: str, text: str) -> DataFrame:
    """Runs of consecutive events of one kind: first and last time, count, joined text."""
    w = Window.partitionBy(part).orderBy(*at)
    new = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    e = events.withColumn("__new", new).withColumn("island", F.sum("__new").over(w).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct(*at, text)))
    return e.groupBy(part, "island").agg(F.first(kind).alias(kind), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"),
                                         F.array_join(F.transform(parts, lambda x: x[text]), " ").alias("text"))


def limited_lines(lines: DataFrame, file: str, at: str, text: str, most: int = 5) -> DataFrame:
    """At most ``most`` equal consecutive lines."""
    w = Window.partitionBy(file).orderBy(at)
    d = lines.withColumn("__i", F.sum(F.coalesce((F.col(text) != F.lag(text).over(w)).cast("int"), F.lit(1))).over(w))
    return d.withColumn("__n", F.row_number().over(Window.partitionBy(file, "__i").orderBy(at))).where(F.col("__n") <= most).drop("__i", "__n")


def earlier_call(results: DataFrame, calls: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """The name of the last call of a result's key that stands before it (a left as-of lookup).

    Both sides meet in one ordered window instead of a range join, so rows stay linear."""
    both = results.select(*results.columns, F.lit(None).cast("string").alias("__call"), F.lit(1).alias("__r")).unionByName(
        calls.select(key, at, F.col(name).alias("__call"), F.lit(0).alias("__r")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("call_name", F.last("__call", ignorenulls=True).over(w)).where("__r = 1").drop("__call", "__r")


def pattern_hits(rows: DataFrame, key: str, text: str, patterns: list[str], sensitive: bool = False) -> DataFrame:
    """(pattern, n, ids): rows that contain each pattern."""
    t = F.col(text) if sensitive else F.lower(text)
    hit = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(t, p if sensitive else F.lower(p)))
    d = rows.select(key, F.explode(hit).alias("pattern"))
    return d.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def parents(log: DataFrame) -> DataFrame:
    """Resolves ``parent_exp_id`` (bare: same agent, ``agent/exp``: another) and says what it found."""
    p = F.col("parent_exp_id")
    other = p.contains("/")
    d = log.withColumn("p_agent", F.when(other, F.split(p, "/", 2)[0]).otherwise(F.col("agent_id"))).withColumn("p_exp", F.when(other, F.split(p, "/", 2)[1]).otherwise(p))
    known = log.select(F.col("agent_id").alias("p_agent"), F.col("exp_id").alias("p_exp"), F.lit(1).alias("__k")).distinct()
    d = d.join(known, ["p_agent", "p_exp"], "left")
    state = F.when(p.isNull(), "legacy").when(F.trim(p).isin("", "none"), "root").when(F.col("__k").isNull(), "orphan").when(F.col("p_agent") != F.col("agent_id"), "cross").otherwise("child")
    return d.withColumn("link", state).drop("__k")


def descend(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) of every node that a root reaches, by pointer doubling: log(depth) joins.

    In each round a node takes its ancestor's ancestor and adds the distances.  Nodes whose chain ends at
    a missing parent, or on a cycle, have no root and do not come up.  Rounds are cut by checkpoints where
    the session has a checkpoint folder, and the driver sees one count a round."""
    up = F.col(parent)
    known = nodes.select(F.col(node).alias("__known")).distinct()
    d = nodes.select(node, up.alias("up")).distinct().join(known, F.col("up") == F.col("__known"), "left")
    here = F.col("up").isNull()
    lost = (~here & F.col("__known").isNull()) | F.coalesce(F.col("up") == F.col(node), F.lit(False))
    d = d.select(node, F.when(here, F.col(node)).otherwise(F.col("up")).alias("up"), F.when(here, 0).otherwise(1).alias("depth"), here.alias("done"), lost.alias("lost"))
    d = d.where("NOT lost").drop("lost")
    left = None
    while True:
        d = _cut(d)
        now = d.where("NOT done").count()
        if now == 0 or now == left:
            break
        left = now
        far = d.select(F.col(node).alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("done").alias("__done"))
        both = d.where("NOT done").join(far, "up")
        d = d.where("done").unionAll(both.select(node, F.col("__up").alias("up"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__done").alias("done")))
    return d.where("done").select(node, F.col("up").alias("root"), "depth")


def _cut(d: DataFrame) -> DataFrame:
    """``d`` with its lineage cut: written to the shared folder and read again."""
    path = shared_folder(d.sparkSession, "level")
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def tree_footer(log: DataFrame) -> DataFrame:
    """One row of totals over an experiment log: all, promoted, audited, cross-agent, orphans, the most forked parent."""
    d = parents(log).withColumn("is_promoted", promoted(log))
    known = F.col("link").isin("child", "cross")
    forks = d.where(known).groupBy(F.concat_ws("/", "p_agent", "p_exp").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    most = forks.agg(F.max(F.struct("n", "name")).alias("m")).select(F.coalesce("m.name", F.lit("(none)")).alias("most_forked"), F.coalesce("m.n", F.lit(0)).alias("n_children"))
    totals = d.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_promoted").alias("n_promoted"), F.count_if(truthy(F.col("audit_pass"))).alias("n_audit_pass"),
                   F.count_if(F.col("link") == "cross").alias("n_cross"), F.count_if(F.col("link") == "orphan").alias("n_orphan"))
    return totals.crossJoin(most)


def parent_check(notes: DataFrame, local: DataFrame, shared: DataFrame) -> DataFrame:
    """(agent_id, exp_id, parent, verdict) of experiment notes: ``ok``, ``missing``, ``unknown`` or ``needs_pivot``.

    A bare parent must stand in the agent's own index (``local``), ``agent/exp`` in the shared log; ``none`` is
    for the first experiment or one with a reason to pivot.  ``notes``: (agent_id, exp_id, parent, pivot)."""
    p = parent_value(F.col("parent"))
    d = notes.select("agent_id", "exp_id", p.alias("p"), F.coalesce(F.trim("pivot"), F.lit("")).alias("pivot"))
    own = local.select("agent_id", F.col("exp_id").alias("p"), F.lit(True).alias("own")).distinct()
    other = shared.select(F.concat_ws("/", "agent_id", "exp_id").alias("p"), F.lit(True).alias("other")).distinct()
    d = d.join(own, ["agent_id", "p"], "left").join(other, "p", "left")
    slash, first = F.col("p").contains("/"), F.regexp_extract("exp_id", r"^exp_0*(\d+)", 1) == "1"
    found = F.when(slash, cross_parent(F.col("p")) & F.col("other").isNotNull()).otherwise(F.col("own").isNotNull())
    verdict = F.when(F.col("p").isNull(), "missing").when(F.col("p") == "none", F.when(first | (F.col("pivot") != ""), "ok").otherwise("needs_pivot")).when(found, "ok").otherwise("unknown")
    return d.select("agent_id", "exp_id", F.col("p").alias("parent"), verdict.alias("verdict"))


def template_groups(templates: DataFrame) -> DataFrame:
    """(hash, n, lines, features) of equal chat templates, by ``template``."""
    t = F.trim("template")
    d = templates.where(F.col("template").isNotNull()).select(F.substring(F.md5(t), 1, 8).alias("hash"), t.alias("t"))
    g = d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"))
    return g.select("hash", "n", F.size(F.split("t", "\n")).alias("lines"), F.array_join(template_features(F.col("t")), ",").alias("features"))


def different_share(templates: DataFrame, usual: str) -> DataFrame:
    """(method, different, total, pct): runs whose template is not the usual one, and all runs with one."""
    other = F.count_if(F.trim("template") != usual.strip())
    g = templates.where(F.col("template").isNotNull()).groupBy("method").agg(other.alias("different"), F.count(F.lit(1)).alias("total"))
    return g.where("different > 0").select("method", "different", "total", F.round(100.0 * F.col("different") / F.col("total"), 1).alias("pct"))


def by_group_size(rows: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Rows with ``n``, the size of their group, in the order (first key, n descending, ties)."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, keys).orderBy(keys[0], F.col("n").desc(), *ties)


def findings(files: DataFrame, providers: dict[str, str], excluded: tuple[str, ...]) -> DataFrame:
    """(run, n_files, providers) of code files that call a provider; ``files``: (path, content), a run is the first two parts of a path."""
    keep = ~F.coalesce(*[F.when(F.col("path").rlike(p), True) for p in excluded], F.lit(False))
    d = files.where(keep).withColumn("hits", provider_hits(F.col("content"), providers)).where(F.size("hits") > 0)
    run = F.substring_index("path", "/", 2)
    g = d.select(run.alias("run"), "path", F.explode("hits").alias("p")).groupBy("run")
    return g.agg(F.count_distinct("path").alias("n_files"), F.array_join(F.array_sort(F.collect_set("p")), ",").alias("providers"))


def step_seconds(begin: Column, end: Column) -> Column:
    """Duration of a step from two times in milliseconds."""
    return (end - begin) / 1000.0


#: Where each scaffold's events keep input tokens, output tokens and cost; fixed values.
USAGE = {
    "codex": ("$.usage.input_tokens", "$.usage.output_tokens", "$.cost"),
    "gemini": ("$.stats.input_tokens", "$.stats.output_tokens", "$.stats.cost"),
    "opencode": ("$.part.tokens.input", "$.part.tokens.output", "$.part.cost")}


def usage(event: Column, scaffold: str) -> Column:
    """(tokens_in, tokens_out, cost) of an event VARIANT; absent numbers are 0."""
    a, b, c = USAGE[scaffold]
    get = lambda p, kind: F.coalesce(F.try_variant_get(event, p, kind), F.lit(0).cast(kind))
    return F.struct(get(a, "long").alias("tokens_in"), get(b, "long").alias("tokens_out"), get(c, "double").alias("cost"))


def truthy(c: Column, values: tuple[str, ...] = ("true", "t", "1", "yes", "y", "pass")) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*values), F.lit(False))


def promoted(log: DataFrame) -> Column:
    return truthy(F.coalesce(F.nullif(F.trim("promoted"), F.lit("")), F.col("decontam_pass")), ("true", "1", "yes"))


def notes_sections(notes: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, section, body) of ``## Name`` sections; the last of equal names wins."""
    lines = notes.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    head = F.regexp_extract("line", r"^##\s+(" + "|".join(names) + r")\s*$", 1)
    w = Window.partitionBy(key).orderBy("at")
    d = lines.withColumn("head", head).withColumn("part", F.sum((F.col("head") != "").cast("int")).over(w)).where("part > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == "", F.struct("at", "line")))), lambda x: x["line"]), "\n")
    g = d.groupBy(key, "part").agg(F.max("head").alias("section"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("body"))
    last = Window.partitionBy(key, "section").orderBy(F.col("part").desc())
    return g.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(key, "section", "body")


def error_kind(head: Column) -> Column:
    return F.when(head.contains("Terminated"), "terminated").when(head.rlike(r"run_task\.sh: line \d+: +\d+ Killed"), "killed").otherwise("clean")


def provider_hits(text: Column, providers: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in sorted(providers.items())]))


#: Calls and imports that give a provider away, and paths of others' code; fixed values.
PROVIDERS = {
    "openai": r"completions\.create|from openai import|import openai|OpenAI\(\)",
    "anthropic": r"messages\.create|from anthropic import|import anthropic|Anthropic\(\)",
    "google_gemini": r"generate_content|from google\.generativeai|import google\.generativeai|genai\.GenerativeModel"}
OTHERS = (r"evaluation_code/utils/completion.py", r"task/evaluation_code/grader.py", r"/site-packages/", r"/patched_lib/", r"/env/lib/", r"/inspect_ai/", r"/inspect_evals/", r"evaluate\.py$")


def token_count(log: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(log, r"tokens used\n([\d,]+)", 1), F.lit("")), F.lit(","), F.lit("")).cast("long")


def result_cost(log: Column) -> Column:
    return F.get_json_object(F.regexp_extract(log, r'(?m)^(\{"type": ?"result".*)$', 1), "$.total_cost_usd").cast("double")
