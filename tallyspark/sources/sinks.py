"""Sinks: grids, reports, versioned logs and content-addressed copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import around, redact


def wide_csv(cells: DataFrame, path: str, row: str, column: str, value: str, columns: list[str]) -> None:
    """A grid with a fixed, sorted header; the pivot's result is one row for each row name."""
    g = cells.groupBy(row).pivot(column, sorted(columns)).agg(F.first(value)).orderBy(row)
    g.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def narrow_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def json_report(df: DataFrame, path: str) -> None:
    """One JSON object a row, nested columns as nested objects."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def closed(rows: DataFrame, fields: list[str], forbidden: tuple[str, ...] = ("eval_", "score_")) -> DataFrame:
    """The closed projection: a forbidden or unknown column is an error."""
    bad = [c for c in rows.columns if c not in fields or c.startswith(forbidden)]
    if bad:
        raise ValueError(f"columns that the log does not take: {bad}")
    return rows.select(*fields)


def append_versioned(rows: DataFrame, path: str, fields: list[str], version: int) -> None:
    """Append the closed projection below its version.

    Each version has a folder of its own, so rows of an older schema are set aside by not being read;
    Spark's file commit stands in for a lock: writers add files and never touch each other's."""
    closed(rows, fields).write.mode("append").parquet(f"{path}/schema_version={version}")


def read_versioned(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows of one schema version."""
    return spark.read.parquet(f"{path}/schema_version={version}")


def append_by_content(rows: DataFrame, existing: DataFrame, path: str, content: str) -> None:
    """Append rows whose content hash is new."""
    h = rows.withColumn("sha256", F.sha2(content, 256))
    h.join(existing.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"]).write.mode("append").parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def last_wins(rows: DataFrame, key: str, line_no: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(line_no).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy(key)


def text_report(lines: DataFrame, path: str, key: str, at: str, text: str, separator: str = "\n") -> None:
    """One text a key, its lines in order."""
    t = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), separator).alias("value"))
    t.select("value").write.mode("overwrite").text(path)


def sanitised(wanted: DataFrame, found: DataFrame, keys: list[str], secrets: list[str], mark: str = "<omitted-api-key>") -> DataFrame:
    """Every wanted (key, file): the found content without its secrets, or the note that none was produced."""
    d = wanted.join(found, keys, "left")
    content = F.col("content")
    for s in secrets:
        content = redact(content, s, mark)
    return d.select(*keys, F.coalesce(content, F.concat(F.lit("No "), F.col(keys[-1]), F.lit(" produced."))).alias("content"))


def context_warnings(found: DataFrame, keys: list[str], patterns: list[str]) -> DataFrame:
    """(keys, pattern, context): where a content still holds a key's beginning, with 50 characters around."""
    hit = F.array_compact(F.array(*[F.when(F.col("content").contains(p), F.struct(F.lit(p).alias("pattern"), around(F.col("content"), p).alias("context"))) for p in patterns]))
    return found.select(*keys, F.explode(hit).alias("w")).select(*keys, "w.*")
