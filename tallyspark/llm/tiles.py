"""Cells of rows that are compared among themselves, cut into tiles of bounded size.

A cell of at most ``most`` home and ``visitors`` visiting rows is one tile.  A larger one is cut by hash
into chunks, and every pair of chunks is a tile of its own, so a crowd spreads over many tasks; a tile's
rows are gathered, compared and forgotten, and pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_KEY = ("label", "dim", "block", "cell", "kind", "ti", "tj")


def by_tile(batches: Iterator, columns: tuple[str, ...], small: int = 0) -> Iterator[tuple]:
    """Rows sorted by ``_KEY`` -> (key, the tile's columns as lists) of every tile of two rows or more.

    With ``small`` the whole cells of at most so many rows that lie inside a batch come together instead, as
    (None, (batch, starts, sizes)): most cells hold a few rows, and are dealt with by vector operations."""
    last, held = None, [[] for _ in columns]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in _KEY:
            k = b.column(c)
            k = (k.dictionary_encode().indices if c == "cell" else k).to_numpy(zero_copy_only=False)
            new[1:] |= k[1:] != k[:-1]
        starts = np.concatenate(([0], np.flatnonzero(new)))
        sizes = np.diff(np.append(starts, n))
        inside = np.ones(len(starts), bool)
        inside[0] = inside[-1] = False
        little = inside & (sizes >= 2) & (sizes <= small) & (b.column("kind").to_numpy(zero_copy_only=False)[starts] == 0)
        if little.any():
            yield None, (b, starts[little], sizes[little])
        rest = np.flatnonzero((sizes >= 2) & ~little | ~inside)
        key_of = [b.column(c) for c in _KEY]
        cols = [b.column(c) for c in columns]
        for t in rest.tolist():
            a, size = int(starts[t]), int(sizes[t])
            key = tuple(c[a].as_py() for c in key_of)
            own = [c.slice(a, size).to_pylist() for c in cols]
            if inside[t]:
                yield key, own
                continue
            if key != last:
                if len(held[0]) > 1:
                    yield last, held
                last, held = key, [[] for _ in columns]
            for h, o in zip(held, own, strict=True):
                h.extend(o)
    if len(held[0]) > 1:
        yield last, held


def small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, i, j): the rows of small tiles, and all pairs within a tile as places in ``rows``, j before i."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    rows = np.repeat(starts, sizes) + place
    i = np.repeat(np.arange(len(rows)), place)
    back = np.arange(len(i)) - np.repeat(np.cumsum(place) - place, place)
    return rows, i, i - 1 - back


def within(key: tuple) -> bool:
    """Whether a tile compares home rows with each other: a whole cell, or one chunk with itself."""
    return key[4] == 0 or (key[4] == 1 and key[5] == key[6])


def dealt(rows: DataFrame, load: DataFrame, most: int, visitors: int) -> DataFrame:
    """``rows`` (label, dim, block, cell, role, cid, ...) with their tiles (kind, ti, tj, side), dealt and sorted by tile.

    ``load`` counts a cell's rows by role; a cell over the bounds is cut into ka home and kb visiting chunks.
    The list of such cells is joined, broadcast by Spark itself only under its own size bound."""
    cell = ["label", "dim", "block", "cell"]
    hot = load.where((F.col("home") > most) | ((F.col("guests") > visitors) & (F.col("home") > 0))).select(
        *cell, F.ceil(F.col("home") / most).cast("int").alias("ka"), F.greatest(F.ceil(F.col("guests") / visitors), F.lit(1)).cast("int").alias("kb"))
    rows = rows.join(materialize(hot, "hot"), cell, "left").withColumns({"ka": F.coalesce("ka", F.lit(1)), "kb": F.coalesce("kb", F.lit(1))})
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cid", "block"), F.when(F.col("role") == 0, F.col("ka")).otherwise(F.col("kb"))).cast("int"))
    place = F.expr("""explode(CASE
        WHEN ka = 1 AND kb = 1 THEN array(struct(0 AS kind, 0 AS ti, 0 AS tj, role AS side))
        WHEN role = 0 THEN concat(
            transform(sequence(0, ka - 1), j -> struct(1 AS kind, least(chunk, j) AS ti, greatest(chunk, j) AS tj, int(chunk > j) AS side)),
            transform(sequence(0, kb - 1), j -> struct(2 AS kind, chunk AS ti, j AS tj, 0 AS side)))
        ELSE transform(sequence(0, ka - 1), i -> struct(2 AS kind, i AS ti, chunk AS tj, 1 AS side)) END)""")
    rows = rows.withColumn("p", place).select("*", "p.*").drop("p", "ka", "kb", "chunk")
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY)


def load_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "dim", "block", "cell").agg(F.count_if(F.col("role") == 0).alias("home"), F.count_if(F.col("role") == 1).alias("guests"))
