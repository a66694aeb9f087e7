"""Sources: run folders, JSONL, CSV, JSON and text artifacts, as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .places import exists, files_below, name_of, names_in, parent, placed_lines, text_lines

MESSAGES = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"


#: Organisations that begin a model's name in a run folder, the first that is found; fixed values.
ORGANISATIONS = ("Qwen_", "google_", "HuggingFaceTB_", "meta-llama_")


def run_parts(name: Column, rule: str = "last") -> Column:
    """benchmark, model and run id of a run folder's name, nulls where the name has another form.  Rules:

    ``last``: ``<benchmark>_<model>_<id>``, the benchmark up to the first underscore, the id after the last;
    ``four``: exactly four parts, the first, third and fourth; ``some``: four parts or more, the same three;
    ``organisation``: the model begins with a known organisation, the id stands last."""
    p = F.split(name, "_")
    number = lambda c: F.when(c.rlike(r"^\d+$"), c.try_cast("long"))
    of = lambda b, m, r, ok: F.struct(F.when(ok, b).alias("benchmark"), F.when(ok, m).alias("model"), F.when(ok, r).alias("run_id"))
    if rule in ("four", "some"):
        run = number(F.get(p, F.lit(3)))
        return of(F.get(p, F.lit(0)), F.get(p, F.lit(2)), run, ((F.size(p) == 4) if rule == "four" else (F.size(p) >= 4)) & run.isNotNull())
    if rule == "organisation":
        head, run = F.regexp_extract(name, r"^(.+)_(\d+)$", 1), number(F.regexp_extract(name, r"^(.+)_(\d+)$", 2))
        at = F.coalesce(*[F.when(F.instr(head, o) > 0, F.instr(head, o)) for o in ORGANISATIONS])
        return of(F.rtrim(F.substring(head, F.lit(1), at - 1), F.lit("_")), F.substring(head, at, F.length(head)), run, at.isNotNull() & run.isNotNull())
    form = r"^([^_]+)_(.+)_(\d+)$"
    part = lambda k: F.nullif(F.regexp_extract(name, form, k), F.lit(""))
    return F.struct(part(1).alias("benchmark"), part(2).alias("model"), part(3).cast("long").alias("run_id"))


def run_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(method, run, file, path) of all files two folders below ``root``; contents are not read."""
    parts = F.split("path", "/")
    return files_below(spark, root, pattern).select(F.element_at(parts, -3).alias("method"), F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("file"), "path")


def latest_runs(runs: DataFrame, keys: list[str], run_id: str = "run_id", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The row of highest run id for each key, of ids in [lo, hi)."""
    r = runs if lo is None else runs.where(F.col(run_id) >= lo)
    r = r if hi is None else r.where(F.col(run_id) < hi)
    w = Window.partitionBy(*keys).orderBy(F.col(run_id).desc())
    return r.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, row, fields): blank lines are skipped; a line that is no JSON of the schema fails the job with its row, from 0."""
    lines = text_lines(spark, path).where(F.trim("value") != "")
    r = F.from_json("value", schema + ", __bad STRING", {"columnNameOfCorruptRecord": "__bad"})
    lines = lines.select("file", (F.col("line_no") - 1).alias("row"), "value", r.alias("r"))
    fail = F.raise_error(F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(": invalid JSON"))).cast("struct<" + ",".join(f"{x.name}:{x.dataType.simpleString()}" for x in lines.schema["r"].dataType) + ">")
    return lines.withColumn("r", F.when(F.col("r.__bad").isNotNull() | F.col("r").isNull(), fail).otherwise(F.col("r"))).select("file", "row", "r.*").drop("__bad")


def jsonl_checked(spark: SparkSession, path: str, schema: str = MESSAGES) -> tuple[DataFrame, DataFrame]:
    """(rows with their index from 0, bad lines with index and text)."""
    lines = text_lines(spark, path).where(F.trim("value") != "")
    raw = lines.select((F.col("line_no") - 1).alias("row"), "value", F.from_json("value", schema + ", __bad STRING", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return raw.where("r.__bad IS NULL").select("row", "r.*").drop("__bad"), raw.where("r.__bad IS NOT NULL").select("row", "value")


def chat_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chats, violations): chat lines that keep the schema, and the first rule that each other line breaks."""
    good, bad = jsonl_checked(spark, path)
    m = F.col("messages")
    has = lambda r: F.coalesce(F.exists(m, lambda x: x["role"] == r), F.lit(False))
    empty = F.filter(F.transform(m, lambda x, i: F.when(F.coalesce(F.trim(x["content"]), F.lit("")) == "", i)), lambda i: i.isNotNull())
    reason = (F.when(m.isNull() | (F.size(m) < 2), "too_few_messages").when(~has("user") | ~has("assistant"), "missing_role")
              .when(F.size(empty) > 0, F.concat(F.lit("empty_content_"), F.get(empty, F.lit(0)).cast("string"))))
    marked = good.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("row", "reason").unionByName(bad.select("row", F.lit("invalid_json").alias("reason")))


def jsonl_commented(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL with ``#`` comment lines."""
    t = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    return t.select(F.from_json("value", schema).alias("r")).select("r.*")


def jsonl_by_stem(spark: SparkSession, pattern: str, schema: str, key: str) -> DataFrame:
    """A glob of JSONL files with the file's stem as ``model``; the last line of a key wins.

    Files of one stem in several folders are one list, in the order of their paths.  Lines are ordered by
    their places, not numbered, so no file's lines are brought together."""
    place = F.struct("file", "block", "id").alias("__at")
    d = placed_lines(spark, pattern).select(F.regexp_extract(F.col("file"), r"([^/]*)\.jsonl$", 1).alias("model"), place, F.from_json("value", schema).alias("r")).select("model", "__at", "r.*")
    w = Window.partitionBy("model", key).orderBy(F.col("__at").desc())
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__at")


def by_key_then_model(answers: DataFrame, key: str, model: str = "model") -> DataFrame:
    """(key, map of model to the rest of its row)."""
    rest = [c for c in answers.columns if c not in (key, model)]
    pairs = F.array_sort(F.collect_list(F.struct(F.col(model).alias("model"), F.struct(*rest).alias("row"))))
    return answers.groupBy(key).agg(F.map_from_entries(pairs).alias("rows"))


def judgments(spark: SparkSession, root: str, judges: list[str]) -> DataFrame:
    """Judgments of several judges below ``root/<judge>/*.jsonl``, columns met by name, with the judge's name."""
    d = spark.read.option("mergeSchema", "true").json([f"{root}/{j}/*.jsonl" for j in judges])
    return d.withColumn("judge", name_of(F.col("_metadata.file_path"), 1))


def grid(spark: SparkSession, path: str, key: str = "model") -> DataFrame:
    """A wide CSV grid as (key, column, value_str, value)."""
    d = spark.read.option("header", "true").csv(path)
    long = d.unpivot([d.columns[0]], d.columns[1:], "column", "value_str").withColumnRenamed(d.columns[0], key)
    return long.withColumn("value_str", F.coalesce("value_str", F.lit(""))).withColumn("value", F.col("value_str").try_cast("double"))


def commented_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("comment", "#").csv(path)


def nested_numbers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of objects of objects of numbers as (setting, model, benchmark, value)."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, MAP<STRING, MAP<STRING, DOUBLE>>>").alias("m"))
    a = t.select(F.explode("m").alias("setting", "m")).select("setting", F.explode("m").alias("model", "m"))
    return a.select("setting", "model", F.explode("m").alias("benchmark", "value"))


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def named_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, content) of all files of one name below ``root``; none gives an empty table."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return b.select("path", F.decode("content", "UTF-8").alias("content"))


def log_heads(spark: SparkSession, pattern: str, size: int = 4096) -> DataFrame:
    """First bytes of each file as Latin-1 text."""
    b = spark.read.format("binaryFile").load(pattern)
    return b.select("path", F.decode(F.substring("content", 1, size), "ISO-8859-1").alias("head"))


def trace_lines(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of trace files: (file, line_no, ts, event VARIANT, line) and (file, line_no, line).

    A leading ``[timestamp] `` is taken off; blank lines are skipped; a line that is no JSON is bad."""
    t = text_lines(spark, pattern).select("file", "line_no", F.trim("value").alias("value")).where("value <> ''")
    p = r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)\]\s*(.*)$"
    body = F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 2)).otherwise(F.col("value"))
    d = t.select("file", "line_no", F.regexp_extract("value", p, 1).try_cast("timestamp").alias("ts"), F.try_parse_json(body).alias("event"), body.alias("line"))
    return d.where("event IS NOT NULL"), d.where("event IS NULL").select("file", "line_no", "line")


def is_structured(lines: DataFrame, prefix: str = "{", first: int = 200) -> DataFrame:
    """For each file, whether one of its first lines starts with ``prefix``."""
    return lines.groupBy("file").agg(F.max((F.col("line_no") <= first) & F.col("line").startswith(prefix)).alias("structured"))


def yaml_settings(content: str) -> dict:
    """A YAML configuration: the library where it is installed, else nested maps and lists of plain scalars."""
    try:
        import yaml
    except ImportError:
        return _plain_yaml(content)
    return yaml.safe_load(content) or {}


def _plain_yaml(content: str) -> dict:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in content.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def scalar(x: str):
        x = x if x[:1] in "\"'" else x.split(" #")[0].strip()
        if x[:1] in "\"'" and x[-1:] == x[:1]:
            return x[1:-1]
        try:
            return json.loads(x)
        except ValueError:
            return None if x in ("", "~", "null") else x

    def block(at: int, depth: int) -> tuple[object, int]:
        out: object = [] if lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == depth:
            if isinstance(out, list):
                out.append(scalar(lines[at][1][2:].strip()))
                at += 1
                continue
            name, _, value = lines[at][1].partition(":")
            at += 1
            if value.strip():
                out[scalar(name)] = scalar(value.strip())
            elif at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- "))):
                out[scalar(name)], at = block(at, lines[at][0])
            else:
                out[scalar(name)] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a YAML file's leaves, names dotted, list places in them; configurations are small."""
    content = spark.read.text(path, wholetext=True).first()["value"]
    out: list[tuple[str, str]] = []

    def walk(prefix: str, v: object) -> None:
        items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else None
        if items is None:
            out.append((prefix, v if isinstance(v, str) else json.dumps(v)))
        for k, x in items or ():
            walk(f"{prefix}.{k}" if prefix else str(k), x)

    walk("", yaml_settings(content))
    return spark.createDataFrame(out, "name string, value string")


def templates(spark: SparkSession, root: str) -> DataFrame:
    """(method, run, template) of run folders: ``final_model/chat_template.jinja``, else the one in ``tokenizer_config.json``."""
    def runs(name: str) -> DataFrame:
        d = named_files(spark, root, name).where(name_of("path", 1) == "final_model")
        return d.select(name_of("path", 3).alias("method"), name_of("path", 2).alias("run"), "content")

    jinja = runs("chat_template.jinja").withColumnRenamed("content", "jinja")
    config = runs("tokenizer_config.json").select("method", "run", F.get_json_object("content", "$.chat_template").alias("config"))
    return jinja.join(config, ["method", "run"], "full_outer").select("method", "run", F.coalesce("jinja", "config").alias("template"))


def with_sibling(spark: SparkSession, root: str, folder: str, sibling: str, suffix: str) -> DataFrame:
    """Paths of files ending in ``suffix`` in folders named ``folder`` whose parent folder holds ``sibling``."""
    files = files_below(spark, root)
    beside = files.where(name_of("path") == sibling).select(parent("path").alias("at")).distinct()
    inside = files.where((name_of("path", 1) == folder) & F.col("path").endswith(suffix)).withColumn("at", parent("path", 2))
    return inside.join(beside, "at", "left_semi").select("path")


def pinned(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """A dataset at a revision: the Parquet (or JSON) files below ``root/revision``; another revision is never read."""
    at = f"{root}/{revision}"
    if not exists(spark, at):
        raise FileNotFoundError(f"no revision {revision} below {root}")
    kind = "parquet" if any(n.endswith(".parquet") for n in names_in(spark, at)) else "json"
    return spark.read.format(kind).load(at)


def metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, key, value) of the numeric fields of JSON objects, one a file; booleans and texts go; no file fails the job."""
    files = whole_files(spark, pattern)
    if files.isEmpty():
        raise FileNotFoundError(f"no file matches {pattern}")
    v = files.select("path", F.try_parse_json("content").alias("v"))
    fields = v.select("path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "x"))
    return fields.where(is_number(F.col("x"))).select("path", "key", F.try_variant_get("x", "$", "double").alias("value"))


def is_number(v: Column) -> Column:
    """Whether a VARIANT is a number; a boolean is none."""
    return F.coalesce(F.schema_of_variant(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))
