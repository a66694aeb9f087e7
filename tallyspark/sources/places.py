"""Folders and small files in the store that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="tally-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Bytes of an Arrow batch of texts, which both processes hold more than once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``BATCH_BYTES``; never raises it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if most <= 0 or most > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def put(spark: SparkSession, path: str, content: str) -> None:
    """Write one small file by its exact name (reports, configurations)."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode("utf-8")))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a file another name; the folder of the new name is made."""
    fs, p = _fs(spark, path)
    q = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(q.getParent())
    fs.rename(p, q)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def files_below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path) of all files below a folder, empty ones too, by Spark's own listing; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).inputFiles()
    return spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in found], "path string")


def placed_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, block, id, value) of text files: (block, id) is the order of a file's lines, without their numbers."""
    return spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def text_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, line_no, value) of text files, line_no from 1 in each file.

    A file's blocks are numbered apart and the counts of earlier blocks added, so a large file is not
    brought together in one task: only its list of blocks is."""
    t = placed_lines(spark, pattern)
    counts = t.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    return t.withColumn("at", inside).join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("at")).cast("long").alias("line_no"), "value")


def parent(path: Column | str, up: int = 1) -> Column:
    """The folder ``up`` levels above a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - up), "/")


def name_of(path: Column | str, up: int = 0) -> Column:
    """The last part of a path, or of the folder ``up`` levels above."""
    return F.element_at(F.split(path, "/"), -1 - up)
