"""Shared plumbing of the training-data operators: reading, scratch tables, components.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` (the folder that driver
and executors share) and read again.  That cuts lineage and outlives any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1

_local_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for a local master that names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_scratch.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='llm-scratch-')}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back.

    The shuffle files of finished jobs are let go: Spark deletes them when the driver's JVM finds
    their plans unreachable, so a collection is asked for after each table (not on a local master)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext.master.startswith("local["):
        gc.collect()
        spark._jvm.System.gc()
    back._scratch_path = path
    return back


def release(*dfs: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch, where a larger one would only cost memory in both processes.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``BATCH_BYTES``; never raises it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if most <= 0 or most > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def frugal(run: Callable) -> Callable:
    """``run`` for mapInArrow; free memory goes back to the system at its end, as reused workers live on."""

    @wraps(run)
    def wrapped(batches: Iterator, *args, **kw) -> Iterator:
        yield from run(batches, *args, **kw)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function on whole arrays (public domain splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_column(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, without a copy; nulls have length zero."""
    import pyarrow as pa

    if pa.types.is_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges with at most ``most`` bytes each, or one row."""
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > most:
            out.append((start, i))
            start, total = i, 0
        total += s
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it: Spark goes by the bytes of compressed files, and a table that
    grows with the input takes many times those on the driver."""
    return df.hint("merge")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge names.

    Alternating large-star and small-star rounds; each round is aggregations and equi-joins, so a
    hub's rows are pre-aggregated before the shuffle and skew-split by adaptive execution.  The
    driver sees one count and one checksum a round.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def stamp(df: DataFrame):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        return r["n"], r["x"]

    seen = stamp(e)
    while seen[0]:
        sym = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(unbroadcast(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        large_m = materialize(large, "large")
        low = large_m.groupBy("a").agg(F.min("b").alias("m"))
        small = large_m.join(unbroadcast(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        release(large_m, e)
        e, last, seen = new, seen, stamp(new)
        if seen == last:
            break
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
