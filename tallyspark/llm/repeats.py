"""Exact repeats of fixed-length windows, shared by the two substring deduplicators.

Every window of ``width`` tokens picks one anchor inside it by a rule that looks at the window's
content alone, so equal windows pick anchors of equal name at equal distance.  Consecutive windows
with one anchor form a run.  A row of Spark is a run, not a window:

1. A run's rank is the pair (name, context).  The name is the fingerprint of tokens that all equal
   windows share, the context that of all tokens under the run.  Runs are shuffled by name and
   sorted; a name that stands alone is unique and drops out.  A run whose rank stands earlier has
   every window repeated.  The first run of a rank is opened if its name has other contexts.
2. Opened runs are cut by the anchor's distance into runs of at most ``STEP`` windows, whose names
   cover all but ``STEP`` - 1 tokens of a window, and ranked again; what is still open is ranked
   window by window, past the threshold.
3. The spans found return to their documents.

Rows of one rank in one batch are settled before the shuffle, so an exact copy or a passage that a
third of all documents hold costs a row a batch; settled rows travel by a hash of their own place.  The sorted
rows are read as a stream, so a task holds no group.

At every step, the last included, a rank is two keys of 64 bits from two families: the name folds
fingerprints of pairs, the context is a polynomial over the whole run, of other random byte values.
Equal strings have equal ranks; 10^12 different windows meet by chance with probability 10^-14.  A
document is (key, tag), the tag a 64-bit hash of its text, so rows of one key with different texts
(or null keys) stay apart; of equal rows one is listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, release, slices, splitmix, utf8_column

U = np.uint64
#: Bytes of text that are worked on at a time, and the longest piece of one document.
PIECE = 1 << 17
_POS = 22
_BYTE_HASH = splitmix(np.arange(256, dtype=U) + U(1 << 40))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWEST = -(1 << 63)
_BASE, _OTHER = U(0xD1342543DE82EF95), U(0x2545F4914F6CDD1D)
_inverses = np.ones(1, U)
#: Windows of a run once it has been opened.
STEP = 8


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The fingerprint of two neighbouring strings from theirs: the rank pair's name."""
    x = a * U(0x9DDFEA08EB382D69 + 2 * salt)
    x += b
    x ^= x >> U(31)
    x *= U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    return x


def doubled(h: np.ndarray, upto: int) -> list[np.ndarray]:
    """Fingerprints of all strings of 1, 2, 4, ... ``upto`` tokens: pairs at doubling offsets."""
    out, n, k = [h], 1, 0
    while n < upto:
        last = out[-1]
        out.append(_join(last[:-n], last[n:], k) if len(last) > n else last[:0])
        n, k = n * 2, k + 1
    return out


def _windows(ends: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows inside the pieces, in order."""
    n = np.maximum(ends - begins - width + 1, 0)
    first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
    return np.arange(int(n.sum())) + np.repeat(begins - first, n)


def _runs(at: np.ndarray, anchor: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first window, number of windows) of runs of consecutive windows of one anchor.

    One position can be the anchor at several levels, under another name at each."""
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(at)))


class Bytes:
    """Windows of bytes; an anchor is the 32-byte string of least fingerprint in the window."""

    def __init__(self, width: int = 100, gram: int = 32):
        self.width, self.gram = width, gram

    def tokens(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _BYTE_HASH[raw], off

    def anchors(self, levels: list[np.ndarray], begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows: (first window, windows, anchor position, anchor name)."""
        g = levels[self.gram.bit_length() - 1]
        m = (g >> U(_POS) << U(_POS)) | np.arange(len(g), dtype=U)
        span, n = self.width - self.gram + 1, 1
        while n * 2 <= span:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        pos = (np.minimum(m[: len(m) - span + n], m[span - n :]) & U((1 << _POS) - 1)).astype(np.int32)
        new = np.ones(len(pos) + 1, bool)
        np.not_equal(pos[1:], pos[:-1], out=new[1:-1])
        new[begins] = new[ends - self.width + 1] = True
        head = np.flatnonzero(new)
        n = np.diff(head)
        head = head[:-1]
        inside = head <= (ends - self.width)[np.searchsorted(begins, head, side="right") - 1]
        head, n = head[inside], n[inside]
        at = pos[head].astype(np.int64)
        return head, n, at, g[at]


class Words:
    """Windows of words; an anchor is a symbol of a recompression of the text.

    Rounds name runs of equal words, then pairs whose left symbol falls in one half and right symbol
    in the other by a salted hash, by the same rule everywhere.  From a window's two ends those
    symbols are dropped whose fate hangs on what lies outside; what is left at the highest level
    that leaves anything is the same for equal windows.  The symbol of least name is the anchor.
    """

    def __init__(self, width: int = 50, rounds: int = 5):
        self.width, self.rounds = width, rounds

    def tokens(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(raw, off)[:2]

    def anchors(self, levels: list[np.ndarray], begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        h = levels[0]
        at = _windows(ends, begins, self.width)
        first = np.zeros(len(h), bool)
        first[begins[begins < len(h)]] = True
        sym, beg = h, np.arange(len(h))
        lo, hi = at, at + self.width
        who = np.arange(len(at))
        pos, name = np.zeros(len(at), np.int64), np.zeros(len(at), U)

        def settle(level: int, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            """Take the least symbol between a and b at this level for the windows ``rows``."""
            if not len(rows):
                return
            order = splitmix(sym ^ U(level + 77))
            m = [(order >> U(_POS) << U(_POS)) | np.arange(len(sym), dtype=U)]
            size = b - a
            n = 1
            while n * 2 <= int(size.max()):
                m.append(np.minimum(m[-1][:-n], m[-1][n:]))
                n *= 2
            k = np.floor(np.log2(size)).astype(np.int64)
            best = np.empty(len(rows), U)
            for j in range(len(m)):
                r = np.flatnonzero(k == j)
                best[r] = np.minimum(m[j][a[r]], m[j][b[r] - (1 << j)])
            i = (best & U((1 << _POS) - 1)).astype(np.int64)
            pos[rows], name[rows] = beg[i], order[i]

        for level in range(self.rounds + 1):
            if level == 0:
                head = first.copy()
                head[0] = True
                head[1:] |= sym[1:] != sym[:-1]
                new = np.cumsum(head) - 1
                nlo, nhi = new[lo] + 1, new[hi - 1]
            else:
                left = (splitmix(sym ^ U(level * 1000003)) & U(1)) == 0
                head = np.ones(len(sym), bool)
                head[1:] = ~(left[:-1] & ~left[1:] & ~first[1:])
                new = np.cumsum(head) - 1
                a, b = lo + ~left[lo], hi - left[hi - 1]
                ok = a < b
                nlo = np.where(ok, new[np.minimum(a, len(new) - 1)], 0)
                nhi = np.where(ok, new[b - 1] + 1, 0)
            out = nlo >= nhi
            if out.any():
                settle(level, who[out], lo[out], hi[out])
                who, nlo, nhi = who[~out], nlo[~out], nhi[~out]
            heads = np.flatnonzero(head)
            size = np.diff(np.append(heads, len(sym)))
            merged = sym[heads]
            many = size > 1
            if level == 0:
                merged[many] = _join(merged[many], splitmix(size[many].astype(U)), 50)
            else:
                merged[many] = _join(merged[many], sym[heads[many] + 1], 50 + level)
            sym, beg, first = merged, beg[heads], first[heads]
            lo, hi = nlo, nhi
            if not len(who):
                break
        settle(self.rounds + 1, who, lo, hi)
        head, n = _runs(at, pos, name)
        return at[head], n, pos[head], name[head]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word offsets of the documents, first byte, length) for all words."""
    n = len(raw)
    solid = ~_SPACE[raw]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = off[(off > 0) & (off < n)]
    head[inner] = solid[inner]
    begin = np.flatnonzero(head)
    bounds = np.searchsorted(begin, off)
    if not len(begin):
        return np.zeros(0, U), bounds, begin, begin
    upto = np.concatenate(([0], np.cumsum(solid)))
    stop = np.append(begin[1:], n)
    size = upto[stop] - upto[begin]
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))[: n - begin[0]] if begin[0] == 0 else None
    if place is None:
        place = np.arange(begin[0], n) - np.repeat(begin, np.diff(np.append(begin, n)))
    tail = raw[begin[0] :]
    powers = splitmix(np.arange(int(size.max()) + 1, dtype=U) + U(1 << 50)) | U(1)
    keep = solid[begin[0] :]
    value = np.where(keep, _BYTE_HASH[tail] * powers[np.minimum(place, len(powers) - 1)], U(0))
    total = np.add.reduceat(value, begin - begin[0])
    return splitmix(total ^ size.astype(U)), bounds, begin, size


def _levels(spec, h: np.ndarray) -> list[np.ndarray]:
    return doubled(h, 1 << (spec.width.bit_length() - 1))


def _span_name(levels: list[np.ndarray], start: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Fingerprint of ``size`` tokens, between once and twice the largest level."""
    top, unit = levels[-1], 1 << (len(levels) - 1)
    return _join(top[start], top[start + size - unit], salt)


class _Prefix:
    """Polynomial hashes of any stretch of tokens, from one prefix sum; independent of ``doubled``."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([U(1)], np.full(n, _BASE, U))), dtype=U)
            self.sum = np.concatenate(([U(0)], np.cumsum(splitmix(h ^ _OTHER) * self.power[:n], dtype=U)))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The hash of tokens lo to hi, the same wherever they stand in this piece or another."""
        with np.errstate(over="ignore"):
            return splitmix((self.sum[hi] - self.sum[lo]) * _inverse(lo))


def _inverse(at: np.ndarray) -> np.ndarray:
    """Powers of the inverse of ``_BASE``, from a table that grows with the longest piece."""
    global _inverses
    need = int(at.max(initial=0)) + 1
    if len(_inverses) < need:
        with np.errstate(over="ignore"):
            _inverses = np.cumprod(np.concatenate(([U(1)], np.full(need, U(pow(int(_BASE), -1, 1 << 64)), U))), dtype=U)
    return _inverses[at]


def _context(spec, whole: _Prefix, lo: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A hash of all tokens under a run's windows, and of where its anchor lies."""
    return whole(lo, lo + n - 1 + spec.width) ^ splitmix((n.astype(U) << U(20)) ^ offset.astype(U))


def _pieces(bounds: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, begins, ends) of token ranges that together hold every window of every row once."""
    rows, begins, ends, held = [], [], [], 0
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        while b - a >= width:
            c = min(b, a + most + width - 1)
            if held and held + c - a > most + width:
                yield np.array(rows), np.array(begins), np.array(ends)
                rows, begins, ends, held = [], [], [], 0
            rows.append(r)
            begins.append(a)
            ends.append(c)
            held += c - a
            a = c - width + 1
    if rows:
        yield np.array(rows), np.array(begins), np.array(ends)


def _runs_of(spec, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, lo, n, offset, name, context) of all runs of a batch of texts; lo counts tokens in the row."""
    tokens, bounds = spec.tokens(raw, off)
    for rows, begins, ends in _pieces(bounds, spec.width, PIECE):
        size = ends - begins
        local = np.concatenate(([0], np.cumsum(size)))
        own = np.concatenate([tokens[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]) if len(rows) > 1 else tokens[begins[0] : ends[0]]
        levels = _levels(spec, own)
        lo, n, anchor, name = spec.anchors(levels, local[:-1], local[1:])
        piece = np.searchsorted(local, lo, side="right") - 1
        row = rows[piece]
        start = begins[piece] - bounds[row] + lo - local[piece]
        yield row, start, n, anchor - lo, name, _context(spec, _Prefix(own), lo, n, anchor - lo)


def _texts(batch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) in parts of bounded size; texts are column 0."""
    raw, off = utf8_column(batch.column(0))
    for i, j in slices(np.diff(off), PIECE):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


#: ``at`` packs lo, n, off and whether the row is settled: lo << 17 | n << 9 | off << 1 | settled.
_ROW = "name long, ctx long, doc long, tag long, at long"


def _settled(doc, tag, lo, n, off, name, ctx, other_document: bool):
    """One Arrow batch of rows, those already settled by an earlier row of their rank marked done."""
    import pyarrow as pa

    rank = _join(name, ctx, 200)
    order = np.argsort(rank, kind="stable")
    same = (name[order][1:] == name[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
    twin = np.zeros(len(order) + 1, bool)
    twin[1:-1] = same
    rows = order[twin[1:] | twin[:-1]]
    done = np.zeros(len(rank), np.int32)
    if len(rows):
        rows = rows[np.lexsort((lo[rows], tag[rows], doc[rows], rank[rows]))]
        head = np.ones(len(rows), bool)
        head[1:] = (name[rows][1:] != name[rows][:-1]) | (ctx[rows][1:] != ctx[rows][:-1])
        first = rows[head][np.cumsum(head) - 1]
        done[rows] = doc[rows] > doc[first] if other_document else ~head & ((doc[rows] > doc[first]) | (tag[rows] != tag[first]) | (lo[rows] > lo[first]))
    at = lo.astype(np.int64) << 17 | n.astype(np.int64) << 9 | off.astype(np.int64) << 1 | done
    name, ctx = (np.where(done == 1, U(0), x).view(np.int64) for x in (name, ctx))
    cols = (name, ctx, doc.astype(np.int64), tag.astype(np.int64), at)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [c.split()[0] for c in _ROW.split(", ")])


def _emit_runs(spec, other_document: bool) -> Callable:
    @frugal
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            doc, tag = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            parts = [(doc[i + row], tag[i + row], *rest) for i, _, raw, off in _texts(b) for row, *rest in _runs_of(spec, raw, off)]
            if parts:
                yield _settled(*(np.concatenate(x) for x in zip(*parts, strict=True)), other_document)

    return run


def _emit_opened(spec, step: int, other_document: bool) -> Callable:
    """Cuts the runs listed for each document into runs of at most ``step`` windows.

    Windows whose anchor lies step * c to step * c + step - 1 tokens in share the tokens from
    step * c before the anchor on, ``width`` - step + 1 of them: the name."""

    def cut(levels, whole, lo, n, off):
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        at = np.arange(int(n.sum())) + np.repeat(lo - first, n)
        anchor = np.repeat(lo + off, n)
        kind = (anchor - at) // step
        new = np.ones(len(at), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        a, o = at[head], (anchor - at)[head]
        name = _span_name(levels, (anchor - kind * step)[head], spec.width - step + 1, 120)
        return a, size, o, name, _context(spec, whole, a, size, o)

    @frugal
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            doc, tag = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            lists, parts = b.column(3), []
            for i, j, raw, off in _texts(b):
                tokens, bounds = spec.tokens(raw, off)
                for r in range(i, j):
                    items = lists[r].values
                    lo, n, o = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "n", "off"))
                    for found in _cut_pieces(spec, cut, tokens[bounds[r - i] : bounds[r - i + 1]], lo, n, o):
                        k = len(found[0])
                        parts.append((np.full(k, doc[r], np.int64), np.full(k, tag[r], np.int64), *found))
            if parts:
                yield _settled(*(np.concatenate(x) for x in zip(*parts, strict=True)), other_document)

    return run


def _cut_pieces(spec, cut: Callable, tokens: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray) -> Iterator[tuple]:
    """``cut`` for the runs of one document, a bounded stretch of its tokens at a time."""
    order = np.argsort(lo, kind="stable")
    lo, n, off = lo[order], n[order], off[order]
    begin = 0
    while begin < len(lo):
        a = int(lo[begin])
        end = max(begin + 1, int(np.searchsorted(lo, a + PIECE, "left")))
        b = int((lo[begin:end] + n[begin:end]).max()) - 1 + spec.width
        own = tokens[a:b]
        at, *rest = cut(_levels(spec, own), _Prefix(own), lo[begin:end] - a, n[begin:end], off[begin:end])
        yield at + a, *rest
        begin = end


def _resolve(other_document: bool) -> Callable:
    """Rows sorted by (name, ctx, doc, tag, at) to those that are repeated or to be opened.

    A row is covered if a row of its rank stands before it, at another place: a document listed twice
    has equal rows, of which one is kept.  The first rows of a rank are open if the name has another
    rank; of the first rank of a name they wait until a second one comes."""

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []  # the first rows of the first rank of the current name
        last_name = last_ctx = last_lead = last_row = None
        several = False
        for b in batches:
            if not b.num_rows:
                continue
            name, ctx, doc, tag, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("name", "ctx", "doc", "tag", "at"))
            done = at & 1
            n = b.num_rows
            new_name, new_ctx = np.ones(n, bool), np.ones(n, bool)
            new_name[1:] = name[1:] != name[:-1]
            new_ctx[1:] = new_name[1:] | (ctx[1:] != ctx[:-1])
            same = name[0] == last_name
            new_name[0], new_ctx[0] = not same, not (same and ctx[0] == last_ctx)
            # The first row of each rank: its index, or -1 for the rank carried over.
            head = np.maximum.accumulate(np.where(new_ctx, np.arange(n), -1))
            place = (doc, tag, at >> 17)
            lead = [np.where(head >= 0, x[head], last_lead[i] if last_lead is not None else 0) for i, x in enumerate(place)]
            covered = (doc > lead[0]) if other_document else (doc != lead[0]) | (tag != lead[1]) | (place[2] != lead[2])
            covered |= done == 1
            again = ~new_ctx
            again[1:] &= (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (at[1:] == at[:-1])
            again[0] &= (doc[0], tag[0], at[0]) == last_row
            first = ~covered & ~again
            # Names with several ranks inside this batch, or together with what came before.
            group = np.cumsum(new_name)
            ranks = np.bincount(group, weights=new_ctx)
            multi = ranks >= 2
            if group[0] == 0:
                multi[0] = several or ranks[0] >= 1
            is_open = first & multi[group]
            if held and (group[0] == 0) and multi[0]:
                yield _as_open(held)
            if group[-1] > 0 or (group[0] == 0 and multi[0]):
                held = []
            last = group == group[-1]
            if not multi[group[-1]]:
                wait = b.filter(pa.array(first & last & (done == 0)))
                if wait.num_rows:
                    held.append(wait)
            several = bool(multi[group[-1]])
            last_name, last_ctx, last_lead, last_row = name[-1], ctx[-1], [x[-1] for x in lead], (doc[-1], tag[-1], at[-1])
            keep = covered & ~again | is_open
            if keep.any():
                out = b.filter(pa.array(keep))
                yield _unpacked(out, is_open[keep])

    return run


def _unpacked(b, is_open: np.ndarray):
    import pyarrow as pa

    at = b.column("at").to_numpy(zero_copy_only=False)
    parts = [pa.array(x.astype(np.int32)) for x in (at >> 17, (at >> 9) & 255, (at >> 1) & 255)]
    return pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), *parts, pa.array(is_open)], ["doc", "tag", "lo", "n", "off", "open"])


def _as_open(parts: list):
    import pyarrow as pa

    b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    return _unpacked(b, np.ones(b.num_rows, bool))


def _ranked(rows: DataFrame, other_document: bool, label: str) -> DataFrame:
    """(doc, tag, lo, n, off, open): rows whose windows are all repeated, and rows to open."""
    goes_by = F.when(F.col("at") % 2 == 0, F.col("name")).otherwise(F.xxhash64("doc", "at"))
    s = rows.repartition(goes_by).sortWithinPartitions("name", "ctx", "doc", "tag", "at")
    return materialize(s.mapInArrow(_resolve(other_document), "doc long, tag long, lo int, n int, off int, open boolean"), label)


def repeated_spans(docs: DataFrame, spec, other_document: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tag, spans): for every document with repeats, runs (lo, n) of repeated window starts.

    A window is repeated if its tokens also start earlier: in a document with a smaller key or, if
    not ``other_document``, at an earlier place.  ``doc`` is the key (null: the lowest long) and
    ``tag`` a hash of the text, so rows of one key and different texts stay apart.
    """
    d = keyed(docs, key, text)
    found = _ranked(d.mapInArrow(_emit_runs(spec, other_document), _ROW), other_document, "runs")
    levels = [found]
    for step in (STEP, 1):
        lists = levels[-1].where("open").groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n", "off")).alias("items"))
        rows = d.join(lists, ["doc", "tag"]).select("text", "doc", "tag", "items").mapInArrow(_emit_opened(spec, step, other_document), _ROW)
        levels.append(_ranked(rows, other_document, f"step{step}"))
    spans = [x.where("NOT open").select("doc", "tag", "lo", "n") for x in levels]
    spans = spans[0].unionAll(spans[1]).unionAll(spans[2]).groupBy("doc", "tag")
    spans = materialize(spans.agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "spans")
    release(*levels)
    return spans


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(F.col(text)).alias("tag"))


def with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """(row, spans): every row of ``docs`` as a struct, whatever its columns are called; spans are null where nothing repeats."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(F.col(text)).alias("tag"))
    return d.join(spans, ["doc", "tag"], "left").select("row", "spans")


def removed_mask(spans, size: int, width: int) -> np.ndarray:
    """Which of ``size`` tokens a repeated window covers."""
    change = np.zeros(size + 1, np.int32)
    items = spans.values
    lo, n = (items.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "n"))
    np.add.at(change, lo, 1)
    np.add.at(change, lo + n - 1 + width, -1)
    return np.cumsum(change[:-1]) > 0
