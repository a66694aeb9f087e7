"""URL filters by a sort-merge range join of reversed-host keys (operator 10).

A host is turned round label by label (``blog.example.net`` to ``net\x00example\x00blog\x00``); a
rule's host, turned round, is then a prefix, that is an interval, of the keys of its host and all
subdomains.  subdomains.  Keys are cut into ranges of about equal rows at split points from a bounded sample of
(key, row hash) pairs, so a hot host spreads over many ranges; the sample decides only the balance.
A rule goes to every range its interval meets: its own, and each range boundary inside it.  The rules
open at a boundary are the host suffixes of one key, so rules never multiply beyond one copy a label
and boundary, and any number of rules is joined this way, without a broadcast.  Rows and rules of a
range are sorted together; a sweep walks them and keeps the stack of rules whose interval contains
the current key; the longest one whose path the URL's path starts with wins (of equal length the
longer host).  Nested intervals never cross, so the stack is exact.

Nulls and odd input: a null url, or one without ``://``, has an empty host and path and meets no
rule (an empty host is no subdomain of anything); a null key is a value like any other; hosts keep
their port and user info as written; equal urls are separate rows; of rules with one host and path
the last wins; very long urls are swept whole; other columns are not read; an empty table or an empty
list of rules gives an empty result or the default verdict.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT_VERDICT = "allow"
#: Rows of the sample from which the split points are taken, for each range.
SAMPLE_PER_RANGE = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = b"\xff"  # sorts after every byte of UTF-8


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def reversed_key(host: str) -> str:
    return "".join(x + "\x00" for x in reversed(host.split(".")))


def _sweep(default: str):
    """Sorted batches of (range, key, kind, host, path, verdict, id, ...): rules (kind 0) stand before the urls they may meet."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stack: list[list] = []  # [reversed key, [(path, host, verdict), ...]]
        last = None
        for batch in batches:
            own, names, verdicts = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("__range", "__key", "__kind", "host", "path", "__verdict")]
            for i, (at, key, kind, host, path, verdict) in enumerate(zip(*cols, strict=True)):
                if at != last:
                    stack, last = [], at
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append([key, []])
                    stack[-1][1].append((path, host, verdict))
                    continue
                best = None
                for _, rules in stack:
                    for rule in rules:
                        if path.startswith(rule[0]) and (best is None or (len(rule[0]) + len(rule[1]), len(rule[1])) >= (len(best[0]) + len(best[1]), len(best[1]))):
                            best = rule
                own.append(i)
                names.append(best[1] + best[0] if best else None)
                verdicts.append(best[2] if best else default)
            urls = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([urls.column("__id"), urls.column("host"), urls.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                                             ["__id", "host", "path", "rule", "verdict"])

    return run


def _ranges(splits: list[tuple[bytes, int]]):
    """Rows get the range of (key, row hash); rules are copied to every range from their key's to their interval's end."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, rows = [], []
            for i, (key, kind, h) in enumerate(zip(*(b.column(c).to_pylist() for c in ("__key", "__kind", "__hash")), strict=True)):
                if kind:
                    rows.append(i)
                    at.append(bisect.bisect_right(splits, (key, h)))
                else:
                    reach = range(bisect.bisect_left(splits, (key, -(1 << 63))), bisect.bisect_left(splits, (key + _END, -(1 << 63))) + 1)
                    rows.extend([i] * len(reach))
                    at.extend(reach)
            out = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *out.columns], ["__range", *out.schema.names])

    return run


def apply_rules(pages: DataFrame, rules=RULES, default: str = DEFAULT_VERDICT, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``; ``rules``: (host, path, verdict) rows, or a DataFrame of them."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(sorted({(h, t): (h, t, v) for h, t, v in rules}.values()), "host string, path string, verdict string")
    turned = F.encode(F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "\x00"), F.lit("\x00")), "UTF-8")
    p = pages.select(F.col(key).alias("__id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    p = p.select("__id", "host", "path", turned.alias("__key"), F.lit(1).alias("__kind"), F.xxhash64("__id", "path").alias("__hash"), F.lit(None).cast("string").alias("__verdict"))
    r = rules.toDF("host", "path", "verdict")
    r = r.select(F.lit(None).cast(p.schema["__id"].dataType).alias("__id"), "host", "path", turned.alias("__key"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__hash"), F.col("verdict").alias("__verdict"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64("__hash", "__key")
    sample = sorted((bytes(x["__key"]), x["__hash"]) for x in p.select(F.substring("__key", 1, 256).alias("__key"), "__hash").orderBy(order).limit(SAMPLE_PER_RANGE * n).collect())
    splits = [sample[len(sample) * k // n] for k in range(1, n)] if len(sample) >= n else []
    both = p.unionAll(r)
    kind = dict(pages.dtypes)[key]
    dealt = both.mapInArrow(_ranges(splits), f"__range int, __id {kind}, host string, path string, __key binary, __kind int, __hash long, __verdict string")
    dealt = dealt.repartition("__range").sortWithinPartitions("__range", "__key", "__kind", "path")
    out = dealt.mapInArrow(_sweep(default), f"__id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("__id", key)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"))


OP10_SQL = r"""
WITH u AS (
  SELECT page_id,
         COALESCE(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
