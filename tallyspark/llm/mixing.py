"""Mixing sources to target weights by systematic sampling (operator 1, native).

Each document has ``target / source size`` expected copies.  Within a source the documents are put
in a hashed order, the expected copies are prefix-summed, one random offset is added,
and a document is emitted once for every integer boundary its interval crosses.

A source of few documents, one of them long, can miss its target by a part of that document.  So
``DRAWS`` offsets are drawn for each source from its name, and the one whose sample comes nearest to
the target is the source's offset (of equal ones the first).  The sums of all draws come from one
aggregation over narrow rows (sizes and ranks, never texts).

The prefix sum is two-level so that a source with a third of all rows never meets in one task: the
order within a source goes by (salt, size, doc_id), the salt being three hexadecimal digits of a hash
of doc_id; rows are ranked inside one (source, salt) cell, and a second sum sees a source's cells, at
most 4,096 whatever the number of rows.  Only the sizes and the sources' offsets are written: without
its native library Hadoop forks a chmod from the executor for what it makes in a local folder.

Nulls: a null source is a source of its own that sorts last; a null text has size 0; a null doc_id
is a value like any other.  Rows that are equal are separate rows.  Ties of size and doc_id go by a
hash of the text.  A very long text only has a large size.  Sources whose size is 0 get target 0 and
no copies.  An empty table gives an empty result.  Other columns pass through untouched, whatever
their names; ``mix_sources`` adds the columns ``ADDED`` and leaves out input columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
#: Offsets that are tried for each source.
DRAWS = 48
ADDED = ("__size", "__source_size", "__target", "__copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salt(key: Column, text: Column) -> Column:
    """Three hexadecimal digits of the key, or where it is null of the text."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), text.cast("string"), F.lit(""))), 1, 3)


def offset(source: Column, seed: str, draw: Column) -> Column:
    """One number in [0, 1) for each source and draw."""
    h = F.substring(F.md5(F.concat(F.lit(seed + "/"), draw.cast("string"), F.lit("/"), F.coalesce(source, F.lit("\x00")))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): capped shares by water filling.

    A source is capped at ``most`` times its size if the level at which all sources with a larger
    ratio of cap to weight would share the rest is not below its own ratio.  ``sizes`` has one row
    for each source, so the unpartitioned windows see the list of sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("i", F.row_number().over(by_name)).withColumn("w", w)
    t = t.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("i")
    t = t.withColumn("all", F.lit(float(share)) * F.sum("source_size").over(everything))
    t = t.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return t.select("source", "source_size", target.alias("target"))


def _starts(cells: DataFrame) -> DataFrame:
    """``cells`` (s, salt, n) with ``start``: the rows of their source that stand before them."""
    w = Window.partitionBy("s").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(F.col("s").alias("c_s"), F.col("salt").alias("c_salt"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))


def _copies() -> Column:
    """Integer boundaries between the prefix sums before and after the document of rank ``at``."""
    rate, at, u = F.col("rate"), F.col("at"), F.col("u")
    return (F.floor(rate * at + u) - F.floor(rate * (at - 1) + u)).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES, seed: str = SEED, text: str = "text",
                source: str = "source", key: str = "doc_id", draws: int = DRAWS, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with ``__size, __source_size, __target, __copies``; no row is dropped here."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    narrow = {"s": F.col(source), "k": F.col(key), "size": n_words(F.col(text)), "h": F.xxhash64(text), "salt": salt(F.col(key), F.col(text))}
    full = docs.select(F.struct(*names).alias("row"), *[c.alias(n) for n, c in narrow.items()])
    sizes = materialize(full.drop("row"), "sizes")
    cells = sizes.groupBy("s", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    goal = source_targets(cells.groupBy(F.col("s").alias("source")).agg(F.sum("words").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    us = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: offset(F.col("source"), seed, i))
    goal = goal.select(F.col("source").alias("g"), "source_size", "target", rate.alias("rate"), us.alias("us"))
    starts = _starts(cells)

    def ranked(d: DataFrame, of: DataFrame) -> DataFrame:
        w = Window.partitionBy("s", "salt").orderBy("size", "k", "h")
        d = d.withColumn("rank", F.row_number().over(w))
        d = d.join(starts, F.expr("s <=> c_s AND salt = c_salt"))
        return d.withColumn("at", F.col("start") + F.col("rank")).join(of, F.expr("s <=> g"))

    tries = ranked(sizes, goal).where("size > 0").select("g", "target", "rate", "at", "size", F.posexplode("us").alias("draw", "u"))
    sums = tries.groupBy("g", "draw", "u", "target").agg(F.sum(_copies() * F.col("size")).alias("taken"))
    best = sums.groupBy("g").agg(F.min_by("u", F.struct(F.abs(F.col("taken") - F.col("target")), "draw")).alias("u"))
    best = goal.drop("us").join(best.withColumnRenamed("g", "b"), F.expr("g <=> b"), "left")
    best = materialize(best.select("g", "source_size", "target", "rate", F.coalesce("u", F.lit(0.0)).alias("u")), "offsets")
    here = {key: "k", source: "s"}  # what the narrow table holds itself
    lean = set(names) <= set(here)
    out = ranked(sizes if lean else full, best)
    kept = [F.col(here[c] if lean else f"row.`{c}`").alias(c) for c in names]
    return out.select(*kept, F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), _copies().alias("__copies"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **kw) -> DataFrame:
    """The mix itself: the columns of ``docs``, every row as often as the mix takes it."""
    whole = docs.select(F.struct("*").alias("doc"), F.col(text).alias("t"), F.col(source).alias("s"), F.col(key).alias("k"))
    m = mix_sources(whole, text="t", source="s", key="k", keep=["doc"], **kw)
    return m.select("doc", F.explode(F.expr("CASE WHEN __copies > 0 THEN sequence(1L, __copies) ELSE array() END"))).select("doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 3) AS salt FROM d),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM s),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM n),
r AS (SELECT *, cap / w AS ratio, 1.5::DOUBLE * (SELECT SUM(source_size) FROM s)::DOUBLE AS total FROM w),
l AS (SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / SUM(w) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, CASE WHEN (SELECT MAX(level) FROM l WHERE level < ratio) IS NULL THEN cap
         ELSE LEAST(cap, (SELECT MAX(level) FROM l WHERE level < ratio) * w) END AS target FROM l),
q AS (SELECT k.doc_id, k.size, g.source_size, g.target, k.source,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY k.source ORDER BY k.salt, k.size, k.doc_id NULLS FIRST) AS pos
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
o AS (SELECT q.*, draw, ('0x' || substr(md5('mix-1/' || draw || '/' || COALESCE(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM q, range(48) AS x(draw)),
t AS (SELECT *, (floor(rate * pos + u) - floor(rate * (pos - 1) + u))::BIGINT * size AS taken FROM o),
e AS (SELECT source, draw, abs(SUM(taken) - MIN(target)) AS miss FROM t GROUP BY source, draw),
f AS (SELECT source, draw FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, draw) = 1)
SELECT t.doc_id, size, source_size, target, taken::BIGINT AS taken FROM t JOIN f ON t.source IS NOT DISTINCT FROM f.source AND t.draw = f.draw
"""
