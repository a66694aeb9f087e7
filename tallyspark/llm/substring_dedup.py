"""Suffix-array style deduplication of long repeated byte strings (operator 2) and substring
deduplication by recompression (operator 9).

Operator 2 names strings by prefix doubling: the rank of a string of 2L bytes is the name of the
pair of ranks at offsets 0 and L (1, 2, 4, ... 64, overlapping for lengths between).  Spark sorts the
ranked positions at 32 bytes, at 93 and at the threshold of 100, each time dropping what is unique
and settling what stands earlier.  A Spark row for every byte in every round does not fit the disk
and CPU limits, so windows that share their position of least 32-byte rank, about 30 in a row, are
one row until they must be told apart; see ``repeats``.

Operator 9 names words, runs and pairs in recompression rounds; see ``repeats.Words``.

Nulls and odd input: a null text is empty and loses nothing; texts shorter than a window lose
nothing; a null key counts as the smallest; rows of one key and one text are one document listed
twice and get equal results; of rows of one key with different texts that with the smaller hash counts
as the earlier; very long texts are searched in pieces; other columns, whatever their names, are not
read, or pass through ``strip_bytes``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, utf8_column
from .repeats import Bytes, Words, removed_mask, repeated_spans, with_spans

MIN_BYTES = 100
MIN_WORDS = 50


def _kept_bytes(raw: np.ndarray, spans, width: int) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, maximal removed runs)."""
    if spans is None:
        return raw.tobytes(), 0, 0
    gone = removed_mask(spans, len(raw), width)
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return raw[~gone].tobytes(), int(gone.sum()), runs


def _lists(column) -> list:
    return [x if x.is_valid else None for x in column]


def dedup_bytes(docs: DataFrame, width: int = MIN_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256)."""
    d = docs.select(key, text)
    marked = with_spans(d, repeated_spans(d, Bytes(width), False, key, text), key, text).select(f"row.`{key}`", f"row.`{text}`", "spans")

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            raw, off = utf8_column(b.column(1))
            out = []
            for i, s in enumerate(_lists(b.column(2))):
                own = raw[off[i] : off[i + 1]]
                kept, gone, runs = _kept_bytes(own, s, width)
                out.append((len(own), gone, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_bytes(docs: DataFrame, width: int = MIN_BYTES, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; all columns, every row.  The column
    ``length``, if named, is set to the number of characters left.

    A cut inside a character drops the character's remaining bytes, so the text stays valid UTF-8."""
    marked = with_spans(docs, repeated_spans(docs, Bytes(width), False, key, text), key, text)
    names = docs.columns
    at = names.index(text)

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols = b.column(0).flatten()
            raw, off = utf8_column(cols[at])
            out = []
            for i, s in enumerate(_lists(b.column(1))):
                own = raw[off[i] : off[i + 1]]
                out.append(cols[at][i].as_py() if s is None else _kept_bytes(own, s, width)[0].decode("utf-8", "ignore"))
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out


def dedup_words(docs: DataFrame, width: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256)."""
    d = docs.select(key, text)
    marked = with_spans(d, repeated_spans(d, Words(width), True, key, text), key, text).select(f"row.`{key}`", f"row.`{text}`", "spans")

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            raw, off = utf8_column(b.column(1))
            out = []
            for i, s in enumerate(_lists(b.column(2))):
                words = raw[off[i] : off[i + 1]].tobytes().split()
                n = len(words)
                if s is not None:
                    gone = removed_mask(s, n, width)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [key, "n_words", "n_removed", "kept_sha256"])

    return marked.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_words long, n_removed long, kept_sha256 string")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every window by itself: the first of equal ones stays, the bytes under the others go.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, encode(COALESCE(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, octet_length(b) AS n, unnest(range(1, octet_length(b) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, array_slice(b, i, i + 99) AS s FROM p WHERE i + 99 <= n),
f AS (SELECT s, MIN((doc_id, i)) AS first FROM w GROUP BY s HAVING COUNT(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE (doc_id, i) > first),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 100 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
x AS (SELECT doc_id, run, MIN(i) AS lo, MAX(i) + 99 AS hi FROM h GROUP BY doc_id, run),
y AS (SELECT doc_id, COALESCE(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS z FROM x
  UNION ALL SELECT doc_id, COALESCE(MAX(hi), 0) + 1, NULL FROM d LEFT JOIN x USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, unhex(COALESCE(string_agg(hex(array_slice(b, a, COALESCE(z, octet_length(b)))), '' ORDER BY a), '')) AS kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, COALESCE(removed, 0)::BIGINT AS n_removed, COALESCE(spans, 0) AS n_spans, sha256(kept) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, SUM(hi - lo + 1) AS removed, COUNT(*) AS spans FROM x GROUP BY doc_id) USING (doc_id)
"""

#: The same for words, where only another document's windows count.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w[i] AS word, i, CASE WHEN i + 49 <= len(w) THEN array_to_string(list_slice(w, i, i + 49), ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT s, MIN(doc_id) AS first FROM p WHERE s IS NOT NULL GROUP BY s HAVING COUNT(*) > 1),
c AS (SELECT doc_id, i, word, MAX(CASE WHEN doc_id > first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN f USING (s)),
k AS (SELECT doc_id, SUM(gone)::BIGINT AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
