"""SimHash near-deduplication by multi-index hashing (operator 6).

A document's fingerprint is the bitwise majority of its 3-word shingles' XXH64 (seed 42).  Two
fingerprints link at 3 or fewer differing bits.  Of two 32-bit segments one then differs in at most
one bit, so every distinct fingerprint enumerates the Hamming ball of radius 1 around each segment
(33 keys), fetches the table rows with that segment value, and the complete distance is verified in
the join's condition.  Documents meet by fingerprint before any join, so copies cost one row.

``similar_groups`` takes a similarity instead of a few bits: 512-bit fingerprints of the distinct
5-word shingles only propose candidates, texts that agree in one of the 32 segments of 16 bits under
one of six orders of the bits and lie within a loose distance.  A first pass deals fingerprints to
their segments' buckets and keeps only which texts have a candidate there that they met in no earlier
bucket; the shingle sets of those are then fetched to the buckets and compared exactly.  A pair is
compared in the first bucket that it shares and never becomes a row; a bucket returns a spanning set of
links.  Buckets are cut into tiles.

Nulls and odd input: a null or blank text has fingerprint zero, linked like any other (without
shingles it has no similar text); a null doc_id takes part, and a group without any doc_id has a null
component; equal rows are separate rows with equal results, and ``keep_one`` keeps one of them; a very
long text is hashed in blocks; a count of exactly half the hashes gives a bit of 0; other columns,
whatever their names, are not read, or pass through ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, frugal, materialize, release, splitmix, table, unbroadcast
from .tiles import by_tile, dealt, load_of, small_pairs, within

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 2
#: Shingles that are hashed before their bits are counted; bounds a task's memory for any text.
BLOCK = 1 << 16

#: Similarity groups: words of a fingerprint, segments, bits of a segment.
WIDE = 8
WIDE_SHINGLE = 5
SIMILARITY = 0.8
WIDE_BITS = 16
WIDE_SEGMENTS = 64 * WIDE // WIDE_BITS
#: Orders of the bits; whole fingerprints travel, so one is shuffled at a time, which bounds the disk.
PASSES = ((0,), (1,), (2,), (3,), (4,), (5,))
#: Most differing bits of a candidate.  At a similarity of 0.8 78 +- 8 bits differ, of sets of four
#: and five shingles 96 +- 9.
FAR = 112
FAR_SMALL = 136
SMALL = 32
#: Texts of a tile while fingerprints are compared, and while whole sets are.
NEAR_TILE, TILE = 8192, 256
#: Buckets of at most so many texts are compared many at once.
SMALL_TILE = 64
#: Pairs whose earlier buckets are looked up at once.
MET = 1 << 14


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= n:
        return int.from_bytes(digest(flat, seed), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[:-n])).tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(stops), BLOCK):
        raw = b"".join([digest(flat[i:j], seed) for i, j in zip(begins[k : k + BLOCK], stops[k : k + BLOCK], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = [f - (1 << 64) if (f := fingerprint(x.as_py(), n, seed)) >> 63 else f for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` ones, radius 0 or 1."""
    return [0] + [1 << i for i in range(bits)] * (radius > 0)


def near_fingerprints(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs in ``fps`` that differ in at most ``distance`` bits.

    Pigeonhole: with ``segments`` segments one of them differs in at most distance // segments bits.
    """
    radius, bits = distance // segments, 64 // segments
    if radius > 1 or 64 % segments:
        raise ValueError("take a number of segments that divides 64 and leaves a radius of 0 or 1")
    part = F.array(*[F.struct(F.lit(s).alias("seg"), F.expr(f"shiftrightunsigned(fp, {s * bits}) & {(1 << bits) - 1}L").alias("part")) for s in range(segments)])
    index = fps.select(F.col("fp").alias("b"), F.explode(part).alias("p")).select("b", "p.seg", F.col("p.part").alias("key"))
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(bits, radius)])
    probe = fps.select(F.col("fp").alias("a"), F.explode(part).alias("p")).select(
        "a", "p.seg", F.explode(F.transform(masks, lambda m: F.col("p.part").bitwiseXOR(m))).alias("key"))
    near = probe.join(unbroadcast(index), ["seg", "key"]).where(F.expr(f"a < b AND bit_count(a ^ b) <= {distance}"))
    return near.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, seed: int = SEED,
                   distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links of fingerprints."""
    marked = materialize(fingerprints(docs, key, text, n, seed), "fingerprints")
    heads = materialize(marked.groupBy("fp").agg(F.min(key).alias("head")), "heads")
    roots = connected_components(near_fingerprints(heads.select("fp"), distance, segments))
    joined = heads.join(unbroadcast(roots), heads["fp"] == roots["node"], "left").select("fp", "head", F.coalesce("component", "fp").alias("root"))
    joined = materialize(joined, "roots")
    least = joined.groupBy("root").agg(F.min("head").alias("component_id"))
    of = joined.join(unbroadcast(least), "root").select("fp", "component_id")
    return marked.join(unbroadcast(of), "fp").select(key, "fp", "component_id")


def _shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    flat = b" ".join(words)
    if len(words) <= n:
        yield flat
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[:-n])).tolist()
    for i, j in zip(begins, (ends[n - 1 :] - 1).tolist(), strict=True):
        yield flat[i:j]


def wide_fingerprint(text: str | None, n: int = WIDE_SHINGLE) -> tuple[int, int, list[int]]:
    """(hash of the word sequence, number of distinct shingles, WIDE signed 64-bit words)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    flat = b" ".join(words)
    node = int(np.uint64(xxhash.xxh64_intdigest(flat, SEED)).astype(np.int64))
    if not words:
        return node, 0, [0] * WIDE
    digest = xxhash.xxh64_intdigest
    h = np.unique(np.fromiter((digest(x, SEED) for x in _shingles(words, n)), np.uint64))
    ones = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(h), 255):  # 255 ones fit a byte
        x = np.stack([splitmix(h[k : k + 255] + np.uint64(w)) for w in range(WIDE)], axis=1)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return node, len(h), np.packbits(ones * 2 > len(h)).view(np.int64).tolist()


def _wide(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, hash of the text, node, size, fp) of every row."""
    bounded_batches(docs.sparkSession)

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [wide_fingerprint(x.as_py(), n) for x in b.column(1)]
            fp = [np.array(r[2], np.int64).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(fp, pa.binary())], ["key", "hash", "node", "size", "fp"])

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, hash long, node long, size long, fp binary")


@cache
def _order(order: int) -> np.ndarray:
    return np.random.default_rng(order).permutation(64 * WIDE)


def _turned(bits: np.ndarray, order: int) -> np.ndarray:
    """Segments (rows, WIDE_SEGMENTS) of unpacked fingerprints under one order of the bits."""
    return np.ascontiguousarray(np.packbits(bits[:, _order(order)], axis=1)).view(np.uint16)


_PLACE = "label long, dim int, block int, cell binary, role int, cid long"


@frugal
def _buckets(batches: Iterator, orders: tuple[int, ...], counts: bool) -> Iterator:
    """A row of (node, grp, size, fp) -> one row for each segment; with ``counts`` only the bucket."""
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        n = b.num_rows
        fp = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, 8 * WIDE)
        bits = np.unpackbits(fp, axis=1)
        segments = np.concatenate([_turned(bits, o) for o in orders], axis=1)
        for s in range(segments.shape[1]):
            cell = pa.array(np.ascontiguousarray(segments[:, s]).view("V2").tolist(), pa.binary())
            block = orders[s // WIDE_SEGMENTS] * WIDE_SEGMENTS + s % WIDE_SEGMENTS
            cols = [pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block, np.int32)), cell, pa.array(np.zeros(n, np.int32)), b.column(0)]
            names = ["label", "dim", "block", "cell", "role", "cid"]
            yield pa.RecordBatch.from_arrays(cols if counts else [*cols, *b.columns[1:]], names if counts else [*names, "grp", "size", "fp"])


def _candidates(a: np.ndarray, b: np.ndarray, group: np.ndarray, size: np.ndarray, x: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(near, far): whether rows a and b are of different groups, of like size and within the loose distance; the distance."""
    far = np.zeros((len(a), len(b)), np.uint16)
    for w in range(WIDE):
        far += np.bitwise_count(x[a, w][:, None] ^ x[b, w][None, :])
    n, m = size[a][:, None], size[b][None, :]
    most = np.maximum(n, m)
    near = (group[a][:, None] != group[b][None, :]) & (np.minimum(n, m) >= similarity * most) & (far <= np.where(most < SMALL, FAR_SMALL, FAR))
    return near, far


def _pairs(side: np.ndarray, within_: bool, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Blocks of rows of a tile to be compared: home rows with later ones, or with the other side's."""
    home, guest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for s in range(0, len(home), step):
        if within_:
            yield home[s : s + step], home[s:], True
        if len(guest):
            yield home[s : s + step], guest, False


def _earlier(x: np.ndarray, block: int) -> list[np.ndarray]:
    """The segments of fingerprints that come before this segment of this order, an array for each order."""
    order, segment = divmod(block, WIDE_SEGMENTS)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1)
    return [_turned(bits, o) for o in range(order)] + [_turned(bits, order)[:, :segment]]


def _first_met(earlier: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs (i, j) share no earlier bucket."""
    new = np.ones(len(i), bool)
    for segments in earlier:
        at = np.flatnonzero(new)
        new[at] = ~(segments[i[at]] == segments[j[at]]).any(1)
    return new


@frugal
def _with_candidate(batches: Iterator, similarity: float) -> Iterator:
    """Rows of sorted tiles that have a candidate there and share no earlier bucket with it."""
    import pyarrow as pa

    for key, tile in by_tile(batches, ("side", "cid", "grp", "size", "fp"), SMALL_TILE):
        if key is None:
            b, starts, sizes = tile
            rows, i, j = small_pairs(starts, sizes)
            b = b.take(pa.array(rows))
            group, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "size"))
            x = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(len(rows), WIDE)
            far = np.zeros(len(i), np.uint16)
            for w in range(WIDE):
                far += np.bitwise_count(x[i, w] ^ x[j, w])
            most = np.maximum(size[i], size[j])
            near = (group[i] != group[j]) & (np.minimum(size[i], size[j]) >= similarity * most) & (far <= np.where(most < SMALL, FAR_SMALL, FAR))
            found = np.zeros(len(rows), bool)
            i, j = i[near], j[near]
            block = b.column("block").to_numpy(zero_copy_only=False)
            for k in np.unique(block[i]).tolist():
                here = np.flatnonzero(block[i] == k)
                own, place = np.unique(np.concatenate([i[here], j[here]]), return_inverse=True)
                earlier, u, v = _earlier(x[own], k), place[: len(here)], place[len(here) :]
                for s in range(0, len(here), MET):
                    new = here[s : s + MET][_first_met(earlier, u[s : s + MET], v[s : s + MET])]
                    found[i[new]] = found[j[new]] = True
            if found.any():
                yield b.filter(pa.array(found)).select(["label", "dim", "block", "cell", "role", "cid"])
            continue
        side, cid, group, size, fp = tile
        side, cid, group, size = (np.array(c) for c in (side, cid, group, size))
        x = np.frombuffer(b"".join(fp), np.uint64).reshape(len(cid), WIDE)
        found, earlier = np.zeros(len(cid), bool), None
        for a, b, own in _pairs(side, within(key)):
            near = _candidates(a, b, group, size, x, similarity)[0]
            if own:
                near &= np.arange(len(b))[None, :] > np.arange(len(a))[:, None]
            near &= ~(found[a][:, None] & found[b][None, :])
            p, q = np.nonzero(near)
            if len(p) and earlier is None:
                earlier = _earlier(x, key[2])
            for s in range(0, len(p), MET):
                i, j = a[p[s : s + MET]], b[q[s : s + MET]]
                undecided = ~(found[i] & found[j])
                i, j = i[undecided], j[undecided]
                new = _first_met(earlier, i, j)
                found[i[new]] = found[j[new]] = True
        if found.any():
            n = int(found.sum())
            cols = [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()), pa.array([key[2]] * n, pa.int32()), pa.array([key[3]] * n, pa.binary()), pa.array(np.zeros(n, np.int32)), pa.array(cid[found])]
            yield pa.RecordBatch.from_arrays(cols, ["label", "dim", "block", "cell", "role", "cid"])


@frugal
def _linked(batches: Iterator, similarity: float) -> Iterator:
    """Sorted tiles of texts with their shingle sets -> links (a, b), a < b, that span each linked part of a tile."""
    import pyarrow as pa

    for key, (side, cid, group, size, fp, hashes) in by_tile(batches, ("side", "cid", "grp", "size", "fp", "hashes")):
        side, group, size = (np.array(c) for c in (side, group, size))
        x = np.frombuffer(b"".join(fp), np.uint64).reshape(len(cid), WIDE)
        sets = [np.frombuffer(h, np.uint64) for h in hashes]
        root = {g: g for g in group.tolist()}
        earlier, out = _earlier(x, key[2]), []

        def top(g: int) -> int:
            while root[g] != g:  # noqa: B023
                root[g] = g = root[root[g]]  # noqa: B023
            return g

        for a, b, own in _pairs(side, within(key)):
            near, far = _candidates(a, b, group, size, x, similarity)
            if own:
                near &= np.arange(len(b))[None, :] > np.arange(len(a))[:, None]
            p, q = np.nonzero(near)
            by_distance = np.argsort(far[p, q], kind="stable")
            for s in range(0, len(p), 4096):
                i, j = a[p[by_distance[s : s + 4096]]], b[q[by_distance[s : s + 4096]]]
                new = _first_met(earlier, i, j)
                for u, v in zip(i[new].tolist(), j[new].tolist(), strict=True):
                    g, h = top(int(group[u])), top(int(group[v]))
                    if g != h:
                        shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                        if shared >= similarity * (len(sets[u]) + len(sets[v]) - shared):
                            root[max(g, h)] = min(g, h)
                            out.append((min(cid[u], cid[v]), max(cid[u], cid[v])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in out], pa.int64()) for k in range(2)], ["a", "b"])


@frugal
def _shingle_sets(batches: Iterator, n: int) -> Iterator:
    """(node, text) -> (node, sorted distinct shingle hashes)."""
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest
    for b in batches:
        sets = [np.unique(np.fromiter((digest(s, SEED) for s in _shingles((x.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), n)), np.uint64)).tobytes() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])


def similar_links(nodes: DataFrame, heads: DataFrame, docs: DataFrame, key: str, text: str, orders: tuple[int, ...], similarity: float, n: int) -> DataFrame:
    """Links (a, b), a < b, between groups of ``nodes`` (node, grp, size, fp) found under some orders of the bits.

    They join every two groups that a pair of similar texts proposed by these orders, and no earlier one, joins."""
    own = nodes.where("size > 0").select("node", "grp", "size", "fp")
    load = load_of(own.mapInArrow(partial(_buckets, orders=orders, counts=True), _PLACE))
    rows = own.mapInArrow(partial(_buckets, orders=orders, counts=False), f"{_PLACE}, grp long, size long, fp binary")
    near = dealt(rows, load, NEAR_TILE, NEAR_TILE).mapInArrow(partial(_with_candidate, similarity=similarity), _PLACE)
    near = materialize(near.distinct(), "candidates")
    ends = near.select(F.col("cid").alias("node")).distinct()
    rep = heads.join(ends, "node", "left_semi").select("node", F.col("rep.k").alias("rep_key"), F.col("rep.h").alias("rep_hash"))
    d = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("x"))
    texts = d.join(rep, F.expr("k <=> rep_key AND h = rep_hash")).select("node", "x").dropDuplicates(["node"])
    sets = materialize(texts.mapInArrow(partial(_shingle_sets, n=n), "node long, hashes binary"), "sets")
    whole = near.join(own.withColumnRenamed("node", "cid"), "cid").join(sets.withColumnRenamed("node", "cid"), "cid")
    out = materialize(dealt(whole, load_of(near), TILE, TILE).mapInArrow(partial(_linked, similarity=similarity), "a long, b long").distinct(), "links")
    release(near, sets)
    return out


def _groups(docs: DataFrame, key: str, text: str, n: int, similarity: float) -> DataFrame:
    """(key, __hash of the text, root, component_id) of every row; ``root`` tells groups apart.

    Texts of equal lower-cased words are one node, so copies cost one row.  Groups found in the first
    pass spare comparisons in the others."""
    marked = materialize(_wide(docs, key, text, n), "wide")
    rep = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("k"), F.col("hash").alias("h"))).alias("rep")
    heads = materialize(marked.groupBy("node").agg(F.min("key").alias("head"), rep, F.first("size").alias("size"), F.first("fp").alias("fp")), "wide_heads")
    first = similar_links(heads.withColumn("grp", F.col("node")), heads, docs, key, text, PASSES[0], similarity, n)
    begun = connected_components(first).select("node", F.col("component").alias("found"))
    grouped = materialize(heads.select("node", "size", "fp").join(begun, "node", "left").withColumn("grp", F.coalesce("found", "node")).drop("found"), "grouped")
    links = [similar_links(grouped, heads, docs, key, text, orders, similarity, n) for orders in PASSES[1:]]
    star = grouped.where("grp <> node").select(F.col("grp").alias("a"), F.col("node").alias("b"))
    roots = connected_components(reduce(DataFrame.unionAll, links, star))
    joined = heads.select(F.col("node").alias("fp"), "head").join(roots, F.col("fp") == F.col("node"), "left")
    joined = materialize(joined.select("fp", "head", F.coalesce("component", "fp").alias("root")), "wide_roots")
    least = joined.groupBy("root").agg(F.min("head").alias("component_id"))
    of = joined.join(least, "root").select("fp", "root", "component_id")
    out = materialize(marked.select("key", "hash", F.col("node").alias("fp")).join(of, "fp").select("key", "hash", "root", "component_id"), "similar")
    release(marked, heads, first, grouped, *links, joined)
    return out


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id): the smallest key reachable over links of ``similarity`` or more."""
    return _groups(docs, key, text, n, similarity).select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, n: int = WIDE_SHINGLE) -> DataFrame:
    """One row of each group of similar texts: that with the smallest key (of equal keys, one text; null only if all are)."""
    least = _groups(docs, key, text, n, similarity).groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("k"))
    keep = least.select(F.col("k.key").alias("keep"), F.col("k.hash").alias("of"))
    d = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    out = d.join(keep, F.expr("key <=> keep AND hash = of"), "left_semi")
    return out.dropDuplicates(["key", "hash"]).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = simhash_groups(docs)
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
