"""Run-results warehouse: grids, fallback, statistics, leaderboards, costs and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_even, hms_of, numeric, seconds_of
from .traces import token_count

BUDGET_SECONDS = 36_000


def dense(rows: DataFrame, columns: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every row name by every column name, joined with the cells; both name lists are dimensions."""
    return rows.crossJoin(columns).join(cells, keys, "left")


def fallback(cells: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """The baseline where the cell is no number or is flagged; a missing baseline fails the job."""
    c = cells.join(base.withColumnRenamed("value", "base"), keys, "left")
    need = numeric(F.col("value_str")).isNull() | (F.coalesce(F.col("flag"), F.lit("")) != "")
    value = F.when(need & F.col("base").isNull(), F.raise_error(F.lit("no baseline for a cell")).cast("double")).when(need, F.col("base")).otherwise(numeric(F.col("value_str")))
    return c.select(*keys, value.alias("value"), F.when(need, "baseline").otherwise("run").alias("origin"))


def flags(contamination: Column, model: Column) -> Column:
    """The flag of a cell from two judgements: C, M, both, or the errors spelled out."""
    bad = contamination.contains("ERR") | model.contains("ERR")
    return F.when(bad, F.concat(F.lit("C:"), contamination, F.lit(" M:"), model)).otherwise(F.concat(F.when(contamination == "True", "C").otherwise(""), F.when(model == "True", "M").otherwise("")))


def judgement(text: Column, yes: str, no: str) -> Column:
    """A judgement file's text to True, False, ERR (missing) or IMPORTANT ERR (unknown text)."""
    t = F.trim(text)
    return F.when(text.isNull(), "ERR").when(t == yes, "True").when(t == no, "False").otherwise("IMPORTANT ERR")


def mean_std(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), std.alias("std"), (std / F.sqrt(F.count(value))).alias("stderr"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def weighted(cells: DataFrame, factors: DataFrame, group: str, column: str = "benchmark") -> DataFrame:
    """Sum over columns of factor times the mean over models."""
    m = cells.groupBy(group, column).agg(F.avg("value").alias("m")).join(F.broadcast(factors), column)
    return m.groupBy(group).agg(F.sum(F.col("m") * F.col("factor")).alias("score"))


def imputed_total(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum with missing values at the mean; groups without any value go."""
    miss = F.count(F.lit(1)) - F.count(value)
    return rows.groupBy(*keys).agg((F.sum(value) + miss * F.avg(value)).alias("total"), F.count(value).alias("n_valid"), miss.alias("n_missing")).where("n_valid > 0")


def time_overview(rows: DataFrame, keys: list[str], seconds: str, budget: int = BUDGET_SECONDS) -> DataFrame:
    mean = F.floor(F.sum(seconds) / F.count(seconds))
    return rows.groupBy(*keys).agg(F.count(seconds).alias("n"), mean.alias("mean_seconds")).select(
        *keys, "n", "mean_seconds", F.coalesce(hms_of(F.col("mean_seconds")), F.lit("N/A")).alias("mean_hms"),
        F.coalesce(F.format_string("%.1f%%", 100.0 * F.col("mean_seconds") / budget), F.lit("N/A")).alias("share"))


def pivoted(cells: DataFrame, row: str, column: str, value: Column, columns: list[str]) -> DataFrame:
    return cells.groupBy(row).pivot(column, columns).agg(value)


def ranking(rows: DataFrame, metric: str, ties: list[str]) -> DataFrame:
    """Ranks by metric, missing last.  One row each for a leaderboard's entries."""
    w = Window.orderBy(F.col(metric).desc_nulls_last(), *ties)
    return rows.withColumn("place", F.row_number().over(w))


def complete_groups(expected: DataFrame, found: DataFrame, group: str, member: str) -> DataFrame:
    """Groups all of whose expected members were found."""
    j = expected.join(found.select(member).distinct().withColumn("hit", F.lit(1)), member, "left")
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k")).where("n = k").select(group)


def diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-10) -> DataFrame:
    """Cells that differ by more than the tolerance or stand on one side only."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return x.join(y, keys, "full_outer").where(~F.coalesce(F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) < tolerance), F.lit(False)))


def ragged_diff(a: DataFrame, b: DataFrame, line: str = "line_no", cells: str = "cells", tolerance: float = 1e-10) -> DataFrame:
    """(kind, line_no, place, a, b) of two tables of rows of cells, met by line and place.

    Texts are equal, or both numbers within the tolerance.  Rows of unequal length are reported once and
    compared as far as both reach; so are tables of unequal length, on line -1."""
    x, y = (d.select(F.col(line).alias("line_no"), F.col(cells).alias(n)) for d, n in ((a, "xs"), (b, "ys")))
    both = x.join(y, "line_no")
    size = lambda d: d.agg(F.count(F.lit(1)).cast("string").alias("n"))
    n = size(x).withColumnRenamed("n", "a").crossJoin(size(y).withColumnRenamed("n", "b")).where("a <> b")
    rows = n.select(F.lit("rows").alias("kind"), F.lit(-1).cast("long").alias("line_no"), F.lit(-1).alias("place"), "a", "b")
    width = both.where(F.size("xs") != F.size("ys")).select(F.lit("columns").alias("kind"), "line_no", F.lit(-1).alias("place"), F.size("xs").cast("string").alias("a"), F.size("ys").cast("string").alias("b"))
    pairs = both.select("line_no", F.posexplode(F.arrays_zip("xs", "ys")).alias("place", "c"), F.least(F.size("xs"), F.size("ys")).alias("upto")).where("place < upto")
    p, q = F.col("c.xs"), F.col("c.ys")
    near = F.coalesce(F.abs(numeric(p) - numeric(q)) < tolerance, F.lit(False))
    cell = pairs.where(~(p.eqNullSafe(q) | near)).select(F.lit("cell").alias("kind"), "line_no", "place", p.alias("a"), q.alias("b"))
    return rows.unionAll(width).unionAll(cell)


def per_cell(values: DataFrame, keys: list[str], run: str, expected: DataFrame) -> DataFrame:
    """Mean and sample deviation of each cell over runs; only runs whose set of row names equals the expected set count.

    ``values`` has (run, model, ...) rows, ``expected`` the row names (``model``)."""
    n = expected.distinct().agg(F.count(F.lit(1)).alias("want"))
    known = expected.distinct().withColumn("__k", F.lit(1))
    has = values.select(run, "model").distinct().join(known, "model", "left").groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count("__k").alias("k"))
    full = has.crossJoin(F.broadcast(n)).where("n = want AND k = want").select(run)
    return mean_std(values.join(full, run, "left_semi"), keys, "value")


def agent_scores(agents: DataFrame, metrics: DataFrame, metric: str = "metric") -> DataFrame:
    """(agent, avg, std, n) over the methods of each agent; an agent with a method that has no metric goes.

    ``agents``: (agent, method); ``metrics``: (method, metric), one row a method."""
    m = metrics.where(F.col(metric).isNotNull()).select("method", F.col(metric).alias("v"))
    j = agents.join(m, "method", "left")
    return j.groupBy("agent").agg(F.avg("v").alias("avg"), F.stddev_samp("v").alias("std"), F.count(F.lit(1)).alias("n"), F.count("v").alias("k")).where("n = k").drop("k")


def agent_times(agents: DataFrame, times: DataFrame, text: str = "average_time") -> DataFrame:
    """(agent, avg_time, std_time, n): mean and deviation of H:M:S texts, in hours, cut to whole seconds."""
    hours = seconds_of(F.col(text)) / 3600.0
    a = agent_scores(agents, times.withColumn("hours", hours), "hours")
    show = lambda c: hms_of(F.floor(F.col(c) * 3600))
    return a.select("agent", show("avg").alias("avg_time"), show("std").alias("std_time"), "n")


def token_usage(runs: DataFrame, log: str = "content", strict: bool = False) -> DataFrame:
    """(method, n, n_incomplete, total, avg_tokens) over the latest runs of each method; ``runs``: (method, run, content).

    A log without a count is left out, or fails the job if ``strict``; a method without any count fails it always."""
    d = runs.withColumn("tokens", token_count(F.col(log)))
    if strict:
        fail = F.raise_error(F.concat(F.lit("no token count in "), F.col("run"))).cast("long")
        d = d.withColumn("tokens", F.coalesce("tokens", fail))
    g = d.groupBy("method").agg(F.count("tokens").alias("n"), (F.count(F.lit(1)) - F.count("tokens")).alias("n_incomplete"), F.sum("tokens").alias("total"), F.avg("tokens").alias("a"))
    none = F.raise_error(F.concat(F.lit("no complete run of "), F.col("method"))).cast("string")
    return g.select("method", "n", "n_incomplete", "total", F.when(F.col("n") == 0, none).otherwise(half_even(F.col("a"))).alias("avg_tokens"))


def missing_runs(rows: DataFrame, columns: DataFrame, runs: DataFrame, keys: list[str], run_id: str = "run_id", usable: str = "has_cuda") -> DataFrame:
    """(keys, state) of the dense grid: ``missing``, ``unusable`` (the latest run is), or ``present``."""
    latest = runs.groupBy(*keys).agg(F.max_by(usable, run_id).alias("ok"))
    g = rows.crossJoin(columns).join(latest, keys, "left")
    return g.select(*keys, F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "present").otherwise("unusable").alias("state"))


def without_metrics(files: DataFrame, ignored: list[str], everything: bool = False) -> DataFrame:
    """Runs that have no metrics but some final model (or any run), minus those ignored; ``files``: (run, file) below runs."""
    names = files.groupBy("run").agg(F.max(F.col("file") == "metrics.json").alias("done"), F.max(F.col("file").startswith("final_model/")).alias("model"))
    keep = ~F.col("done") if everything else ~F.col("done") & F.col("model")
    return names.where(keep & ~F.col("run").isin(*ignored)).select("run")


def ranking_report(runs: DataFrame, metric: str, key: str) -> DataFrame:
    """One row: the winner, the whole ranking (valid runs first) and the runs without the metric, which are excluded.

    A leaderboard's runs are few; without any valid run the job fails."""
    r = F.struct(F.col(metric).isNull().alias("no"), (-F.col(metric)).alias("m"), F.col(key).alias("k"), F.col(metric).alias("v"))
    all_ = F.array_sort(F.collect_list(r))
    g = runs.agg(all_.alias("all"))
    valid = F.filter("all", lambda x: ~x["no"])
    winner = F.when(F.size(valid) == 0, F.raise_error(F.lit("no run has the metric")).cast("string")).otherwise(F.get(valid, F.lit(0))["k"])
    return g.select(winner.alias("winner"), F.array_join(F.transform("all", lambda x: x["k"]), ",").alias("ranking"), F.array_join(F.transform(F.filter("all", lambda x: x["no"]), lambda x: x["k"]), ",").alias("excluded"))


def migration(texts: DataFrame) -> DataFrame:
    """(run, action, judge_result): two judgement texts of a run to one JSON, with what would be done.

    ``texts``: (run, contamination, disallowed, has_output); a null text is a missing file."""
    said = lambda c, yes, no: F.when(F.trim(c) == yes, True).when(F.trim(c) == no, False)
    c = said(F.col("contamination"), "contamination detected", "no contamination detected")
    d = said(F.col("disallowed"), "disallowed use detected", "only allowed use detected")
    action = (F.when(F.col("has_output"), "skip_exists").when(F.col("contamination").isNull() & F.col("disallowed").isNull(), "skip_no_input")
              .when((F.col("contamination").isNotNull() & c.isNull()) | (F.col("disallowed").isNotNull() & d.isNull()), "error").otherwise("would_migrate"))
    out = texts.select("run", action.alias("action"), F.to_json(F.struct(c.alias("contamination_detected"), d.alias("disallowed_model_detected"))).alias("j"))
    return out.select("run", "action", F.when(F.col("action") == "would_migrate", F.col("j")).alias("judge_result"))


#: File names that a comparison of result folders leaves out or takes, the first rule that fits; fixed values.
COMPARED = (
    (r"^aggregated_(avg|std)_over_models\.csv$", False), (r"^aggregated_time_", False), (r"^final_(avg|std|time)_.*\.csv$", False),
    (r"^(final|contamination)_baseline(_zeroshot)?\.csv$", False), (r"^(final|contamination)_.*\.csv$", True),
    (r"^single_metrics(_aggregated)?\.csv$", True), (r"^aggregated_(avg|std)_", True), (r"^time_aggregated\.csv$", True))


def is_compared(name: Column) -> Column:
    out = F.lit(False)
    for pattern, yes in reversed(COMPARED):
        out = F.when(name.rlike(pattern), F.lit(yes)).otherwise(out)
    return out


def chosen(rows: DataFrame, column: str, skipped: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), without: tuple[str, ...] = (), containing: str | None = None, case: bool = True) -> DataFrame:
    """Rows whose name is not skipped and no dot name, begins with one of the prefixes, holds none of ``without``, and holds a part."""
    c = F.col(column)
    keep = ~c.startswith(".") & ~c.isin(*skipped)
    if prefixes:
        keep &= F.coalesce(*[F.when(c.startswith(p), True) for p in prefixes], F.lit(False))
    for w in without:
        keep &= ~c.contains(w)
    if containing:
        keep &= c.contains(containing) if case else F.lower(c).contains(containing.lower())
    return rows.where(keep)


def matching(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that equal the wanted values; ``All`` and None stand for any, a column that is not there is not asked."""
    for name, value in wanted.items():
        if value and value != "All" and name in rows.columns:
            rows = rows.where(F.col(name) == value)
    return rows


def first_success(attempts: DataFrame, keys: list[str], attempt: str = "attempt", ok: str = "ok") -> DataFrame:
    """(keys, attempt, n): the first attempt of a retry ladder that succeeded, null without one, and the attempts made."""
    a = F.min(F.when(F.col(ok), F.col(attempt)))
    return attempts.groupBy(*keys).agg(a.alias("attempt"), F.count(attempt).alias("n"))


def benchmark_folders(files: DataFrame) -> DataFrame:
    """(benchmark, complete, has_context) of a folder contract: ``evaluate.py`` and ``benchmark.txt``; ``files``: (benchmark, file)."""
    has = lambda p: F.max(F.col("file").rlike(p))
    return files.groupBy("benchmark").agg((has(r"^evaluate\.py$") & has(r"^benchmark\.txt$")).alias("complete"), has("^task_context/").alias("has_context"))


def round_robin(index: Column, names: list[str]) -> Column:
    """The name that a row's index, from 0, falls to when names are dealt in turn."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(index, F.lit(len(names))) + 1).cast("int"))


def seeded_sample(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, or all for a negative ``n``, in an order that only keys and seed decide.

    A top-n by a hash: each task keeps its own n least, so nothing is sorted as a whole."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    d = rows.withColumn("__h", h).orderBy("__h", *keys)
    return (d if n < 0 else d.limit(n)).drop("__h")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order."""
    return rows.orderBy(*order).limit(n)
