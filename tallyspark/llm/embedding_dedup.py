"""Embedding near-deduplication by a subspace pigeonhole join (operator 3).

For unit vectors, cosine >= t means squared distance <= 2 - 2t.  The vectors are rotated by a fixed
random orthogonal matrix and cut into low-dimensional blocks.  If all block distances exceeded their
share of the budget, the whole distance would exceed the budget; so every link lies within the share
in some block, and one range join a block finds it.  A range join puts each vector in the grid cell
of its block's coordinates, ``CELL`` shares wide, and lets it visit those preceding cells that the
ball of one share around it meets; so a pair meets in one cell.

The vectors themselves travel late.  First only ids and block coordinates go to the cells, and rows
without a partner within the share drop out: with 64 coordinates in 8 blocks a chance pair has a
partner about once in 10^6.  Then the vectors of the rest are fetched to their cells, where a pair
is verified exactly, in double precision, and counted only in the first block whose share it keeps.

Cells are worked on as tiles; a larger cell is split by hash into chunks, and every pair of chunks
is a tile of its own, so a hot label or a crowd of near copies spreads over many tasks.  Pairs are
never emitted: a tile returns counts for its vectors and a spanning star for each connected part.

Equal vectors of a label are one class with a multiplicity.  Nulls and odd input: vectors that are
null, zero or hold null or non-finite components, and rows with a null label or key, link with
nothing (0 links, their own component); vectors of different length do not compare; a repeated row
is one more copy, and rows of one key with different vectors are separate vectors; a cosine of
exactly the threshold links; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table
from .tiles import by_tile, dealt, load_of, small_pairs, within

COSINE = 0.98
BLOCKS = 8
#: Grid coordinates of a block, and the width of a cell in shares.
AXES = 8
CELL = 4.0
#: Vectors of a tile at home and visiting, while ids are compared and while whole vectors are.
NEAR_TILE, NEAR_VISITORS = 8192, 16384
TILE, VISITORS = 1024, 2048
#: Cells of at most so many rows are compared many at once.
SMALL_TILE = 64
SEED = 20240
_SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _cuts(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def _unpack(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind).astype(np.float64) for x in column.to_pylist()]


def _by_dim(vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, np.array([vectors[i] for i in rows])


def _places(yb: np.ndarray, share: float, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell coordinates, role) of all cells a block's rows are in: role 0 their own, 1 a preceding one in reach."""
    r = share**0.5
    width = CELL * r
    x = yb[:, :AXES] / width
    if dim**-0.5 < r:  # coordinates are small against a cell, so zero lies in a cell's middle
        x = x + 0.5
    home = np.floor(x)
    low = x - home
    down = low < 0.5
    gap = (np.minimum(low, 1 - low) * width) ** 2
    a = x.shape[1]
    pick = (np.arange(1 << a)[:, None] >> np.arange(a)) & 1
    reach = gap @ pick.T.astype(np.float64) <= share  # (rows, subsets of axes that are crossed)
    step = np.where(down, -1, 1)
    # The other cell precedes if the first crossed axis goes down.
    first = np.where(pick.any(1), pick.argmax(1), 0)
    precedes = down[:, first]
    precedes[:, 0] = True
    row, subset = np.nonzero(reach & precedes)
    cell = (home[row] + step[row] * pick[subset]).astype(np.int16)
    return row, cell, (subset > 0).astype(np.int32)


def _cells(cosine: float, blocks: int, kind, coordinates: bool):
    """(label, dim, block, cell, role) of every class in every block, with ``coordinates`` also its id and those."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            label, own = b.column("label").to_numpy(zero_copy_only=False), b.column("cid").to_numpy(zero_copy_only=False)
            for rows, x in _by_dim(_unpack(b.column("payload"), kind)):
                dim = x.shape[1]
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(dim)
                cuts = _cuts(dim, blocks)
                share = (2 - 2 * cosine) / (len(cuts) - 1) + _SLACK
                for k in range(len(cuts) - 1):
                    yb = y[:, cuts[k] : cuts[k + 1]]
                    for s in range(0, len(rows), 4096):
                        row, cell, role = _places(yb[s : s + 4096], share, dim)
                        at, n = rows[s + row], len(row)
                        flat = np.ascontiguousarray(cell).view(f"V{2 * cell.shape[1]}")[:, 0]
                        cols = [pa.array(label[at]), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(flat.tolist(), pa.binary()), pa.array(role)]
                        names = ["label", "dim", "block", "cell", "role"]
                        if coordinates:
                            near = np.ascontiguousarray(yb[s + row].astype(np.float32)).view(f"V{4 * yb.shape[1]}")[:, 0]
                            cols += [pa.array(own[at]), pa.array(near.tolist(), pa.binary())]
                            names += ["cid", "near"]
                        yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _partnered(side: np.ndarray, x: np.ndarray, within: bool, share: float, step: int = 256) -> np.ndarray:
    """Which rows of a tile have a partner within the share, by block coordinates in single precision."""
    home, guest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = np.zeros(len(side), bool)
    sq = (x * x).sum(1)
    for s in range(0, len(home), step):
        a = home[s : s + step]
        for b, own in ((home[s:], True), (guest, False)) if within else ((guest, False),):
            if len(b):
                near = sq[a][:, None] + sq[b][None, :] - 2 * (x[a] @ x[b].T) <= share + 1e-5
                if own:
                    near &= np.arange(len(b))[None, :] > np.arange(len(a))[:, None]
                found[a[near.any(1)]] = found[b[near.any(0)]] = True
    return found


class _Tile:
    """The rows of one tile, compared all at once."""

    def __init__(self, key: tuple, head: np.ndarray, copies: np.ndarray, side: np.ndarray, x: np.ndarray, cosine: float, blocks: int):
        self.block, self.within = key[0], key[1]
        self.head, self.copies, self.side, self.x = head, copies, side, x
        self.cosine = cosine
        dim = x.shape[1]
        self.norm = np.linalg.norm(x, axis=1)
        self.y = (x / self.norm[:, None]) @ rotation(dim)
        self.cuts = _cuts(dim, blocks)
        self.share = (2 - 2 * cosine) / (len(self.cuts) - 1) + _SLACK

    def links(self, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, first) of linked pairs; first: this block is the first whose share they keep."""
        home, guest = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        yb = self.y[:, self.cuts[self.block] : self.cuts[self.block + 1]]
        sq = (yb * yb).sum(1)
        for s in range(0, len(home), step):
            a = home[s : s + step]
            for b, own in ((home[s:], True), (guest, False)) if self.within else ((guest, False),):
                if not len(b):
                    continue
                near = sq[a][:, None] + sq[b][None, :] - 2 * (yb[a] @ yb[b].T) <= self.share + 1e-6
                if own:
                    near &= np.arange(len(b))[None, :] > np.arange(len(a))[:, None]
                ra, rb = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(ra):
                    continue
                cos = (self.x[a[ra]] @ self.x[b[rb]].T) / (self.norm[a[ra]][:, None] * self.norm[b[rb]][None, :])
                i, j = np.nonzero((cos >= self.cosine) & near[np.ix_(ra, rb)])
                i, j = a[ra[i]], b[rb[j]]
                for t in range(0, len(i), 20_000):
                    p, q = i[t : t + 20_000], j[t : t + 20_000]
                    d = np.add.reduceat((self.y[p] - self.y[q]) ** 2, self.cuts[:-1], axis=1) <= self.share
                    keep = d[:, self.block]
                    yield p[keep], q[keep], ~d[keep, : self.block].any(1)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, id, value): kind 0 a vector's links, kind 1 an edge of the spanning stars."""
        n = len(self.head)
        count, root = np.zeros(n, np.int64), np.arange(n)

        def top(v: np.ndarray) -> np.ndarray:
            while (root[v] != v).any():
                v = root[v]
            return v

        for p, q, first in self.links():
            np.add.at(count, p[first], self.copies[q[first]])
            np.add.at(count, q[first], self.copies[p[first]])
            while len(p):  # hook roots onto smaller ones until every pair of this slice agrees
                a, b = top(p), top(q)
                differ = a != b
                p, q, a, b = p[differ], q[differ], a[differ], b[differ]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        root = top(np.arange(n))
        some, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(n))
        return (np.concatenate([np.zeros(len(some), np.int32), np.ones(len(tied), np.int32)]),
                np.concatenate([self.head[some], self.head[tied]]), np.concatenate([count[some], self.head[root[tied]]]))


def _survivors(cosine: float, blocks: int):
    """Rows with a partner in their tile."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, tile in by_tile(batches, ("side", "role", "cid", "near"), SMALL_TILE):
            if key is None:
                b, starts, sizes = tile
                rows, i, j = small_pairs(starts, sizes)
                b = b.take(pa.array(rows))
                dim, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "side"))
                found, near = np.zeros(len(rows), bool), b.column("near").to_pylist()
                for width in {len(v) for v in near}:  # vectors of one length, as a rule
                    at = np.array([len(v) == width for v in near])
                    x = np.zeros((len(rows), width // 4), np.float32)
                    x[at] = np.frombuffer(b"".join(v for v in near if len(v) == width), np.float32).reshape(-1, width // 4)
                    ok = at[i] & at[j] & ((side[i] == 0) | (side[j] == 0))
                    p, q = i[ok], j[ok]
                    share = (2 - 2 * cosine) / np.minimum(blocks, dim[p]) + _SLACK
                    hit = ((x[p] - x[q]) ** 2).sum(1) <= share + 1e-5
                    found[p[hit]] = found[q[hit]] = True
                if found.any():
                    yield b.filter(pa.array(found)).select(["label", "dim", "block", "cell", "role", "cid"])
                continue
            side, role, cid, near = tile
            share = (2 - 2 * cosine) / (len(_cuts(key[1], blocks)) - 1) + _SLACK
            x = np.frombuffer(b"".join(near), np.float32).reshape(len(cid), -1)
            at = np.flatnonzero(_partnered(np.array(side), x, within(key), share))
            if len(at):
                n = len(at)
                cols = [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()), pa.array([key[2]] * n, pa.int32()), pa.array([key[3]] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(role)[at], pa.int32()), pa.array(np.array(cid)[at])], ["label", "dim", "block", "cell", "role", "cid"])

    return run


def _links(cosine: float, blocks: int, kind):
    """(kind, id, value) of all tiles; see ``_Tile.result``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, (side, cid, copies, payload) in by_tile(batches, ("side", "cid", "copies", "payload")):
            x = np.frombuffer(b"".join(payload), kind).astype(np.float64).reshape(len(cid), key[1])
            what, own, value = _Tile((key[2], within(key)), np.array(cid), np.array(copies), np.array(side), x, cosine, blocks).result()
            if len(what):
                yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(own), pa.array(value)], ["kind", "id", "value"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, key: str = "vec_id",
                 embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    single = dict(vectors.dtypes)[embedding] == "array<float>"
    kind = np.float32 if single else np.float64
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for i, lab, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                a = np.array(x, kind) if x and i is not None and lab is not None and None not in x else None
                out.append(a.tobytes() if a is not None and np.isfinite(a).all() and 0 < np.linalg.norm(a.astype(np.float64)) < np.inf else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "label", "payload"])

    v = materialize(v.mapInArrow(pack, "id long, label long, payload binary"), "vectors")
    classes = v.where("payload IS NOT NULL").groupBy("label", "payload").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # ids are fixed by being written
    place = "label long, dim int, block int, cell binary, role int"
    ids = classes.select("label", "cid", "payload")
    load = load_of(ids.mapInArrow(_cells(cosine, blocks, kind, False), place))
    near = dealt(ids.mapInArrow(_cells(cosine, blocks, kind, True), f"{place}, cid long, near binary"), load, NEAR_TILE, NEAR_VISITORS)
    rest = materialize(near.mapInArrow(_survivors(cosine, blocks), f"{place}, cid long").distinct(), "partnered")
    whole = rest.join(classes.select("cid", "copies", "payload"), "cid")
    found = materialize(dealt(whole, load_of(rest), TILE, VISITORS).mapInArrow(_links(cosine, blocks, kind), "kind int, id long, value long"), "links")
    links = found.where("kind = 0").groupBy("id").agg(F.sum("value").alias("links"))
    parts = connected_components(found.where("kind = 1").select(F.col("id").alias("a"), F.col("value").alias("b")))
    per = classes.join(links, classes["cid"] == links["id"], "left").join(parts, classes["cid"] == parts["node"], "left")
    per = materialize(per.select("label", "payload", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "cid").alias("part")), "per")
    least = per.groupBy("part").agg(F.min("head").alias("c"))
    per = per.join(least, "part").select("label", "payload", "n", "c")
    out = v.join(per, ["label", "payload"], "left").select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, MIN(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
