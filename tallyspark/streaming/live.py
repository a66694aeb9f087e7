"""Structured Streaming forms: stamped lines, windowed samples, stateful delta merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamped_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of arriving text files with the time at which they were processed."""
    return spark.readStream.format("text").load(folder).select(F.current_timestamp().alias("ts"), F.col("value").alias("line"))


def sampled(events: DataFrame, ts: str, value: str, late: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Windowed means with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("w.start", "n", "mean")


def merged_deltas(events: DataFrame, file: str = "file", kind: str = "kind", text: str = "text", at: str = "at", timeout_ms: int = 3_600_000) -> DataFrame:
    """Consecutive deltas of one kind in a file become one row; state is the open run of each file.

    Inside a micro-batch rows are taken in the order of ``at``, as they arrive in any order after the
    shuffle; a change of kind closes a run; a run without news is closed by timeout."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else [None, "", 0]
        out = []
        if state.hasTimedOut:
            out, run = [(key[0], *run)], [None, "", 0]
            state.remove()
        else:
            batch = pd.concat(list(parts)).sort_values(at, kind="stable")
            for k, t in zip(batch[kind], batch[text], strict=True):
                if run[0] is not None and k != run[0]:
                    out.append((key[0], *run))
                    run = [None, "", 0]
                run = [k, run[1] + t, run[2] + 1]
            state.update(tuple(run))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["file", "kind", "text", "n"])

    return events.groupBy(file).applyInPandasWithState(step, "file string, kind string, text string, n long", "kind string, text string, n long", "append", "ProcessingTimeTimeout")


def paired_results(calls: DataFrame, results: DataFrame, key: str = "tool_id", late: str = "10 minutes") -> DataFrame:
    """Stream-stream left join of results with their calls; both sides carry ``ts``."""
    c = calls.withWatermark("ts", late).select(F.col(key).alias("c_key"), F.col("ts").alias("c_ts"), "name")
    r = results.withWatermark("ts", late)
    return r.join(c, F.expr(f"{key} = c_key AND c_ts <= ts AND c_ts >= ts - INTERVAL {late}"), "leftOuter").drop("c_key")
