"""Toxicity by non-negative positive-unlabelled learning (operator 5).

Confirmed toxic documents are the positives; everything else is unlabelled text.  A linear model
over word-presence features, a numpy array of weights, minimises the non-negative PU risk
``pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))`` with the logistic loss; ``pi`` is the class prior.
Training reads a bounded, hash-chosen sample (``MOST_POSITIVES`` and ``MOST_UNLABELLED`` documents,
and only rows whose crc32(doc_id) mod 5 is not 0), of each document the set of words of its whole
text; scoring covers every whole text.

Features are chosen from the sample by document frequency among the positives and lift over the
unlabelled text, so a word that only one document holds carries no weight.  A score is
sigmoid(w . x + b - t): t is the cut of least PU risk under the zero-one loss, on the same sample.
Labels tell the positives apart and their share among all labelled rows is the class prior; labelled
negatives are unlabelled text like any other.

Nulls and odd input: a null or empty text has no words and gets the score of the bias alone; a null
doc_id is never trained on and is not held out; without any positive training row all scores are 0;
equal texts get equal scores, repeated rows each their own; a key labelled twice is toxic if one label
is; a very long text is one set of words; the sample goes by a hash of the key, ties by the key, and so
does which of its near copies stays, so partitions do not matter; other columns, whatever their names,
are not read, or pass through ``clean``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, materialize, release, table

#: Bounds of the training sample, in documents (documented parameters).
MOST_POSITIVES = 1500
MOST_UNLABELLED = 6000
MOST_FEATURES = 512
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, self.weights.keys() & words(text)))
        return float(1.0 / (1.0 + np.exp(-min(max(z, -60.0), 60.0))))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def _chosen(counts: Iterable[tuple[str, int, int]], p: int, u: int, prior: float) -> dict[str, float]:
    """The features, best first, with their lift, from (word, positives, unlabelled documents that hold it)."""
    lift, sure = {}, {}
    for w, in_p, in_u in counts:
        expected = p * (in_u + 1) / (u + 1)
        # A feature is a word well above chance among the positives that mostly means a positive.
        z = (in_p - expected) / (expected + 0.5) ** 0.5
        if in_p >= _least(p) and prior * in_p / expected >= 0.3 and z >= _sure(p):
            lift[w], sure[w] = in_p / expected, z
    return {w: lift[w] for w in sorted(lift, key=lambda w: (-sure[w], w))[:MOST_FEATURES]}


def fit(positive: list[set[str]], unlabelled: list[set[str]], prior: float, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit by full-batch gradient steps on the nnPU risk to documents' sets of words; deterministic."""
    in_p, in_u = Counter(w for d in positive for w in d), Counter(w for d in unlabelled for w in d)
    lift = _chosen(((w, n, in_u[w]) for w, n in in_p.items()), len(positive), len(unlabelled), prior)
    at = {w: i for i, w in enumerate(lift)}
    return _descend(lift, *([[at[w] for w in d if w in at] for d in docs] for docs in (positive, unlabelled)), prior, rounds, rate, decay)


def _descend(lift: dict[str, float], p: list[list[int]], u: list[list[int]], prior: float, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """The model over the features ``lift`` from the places in it that each positive and each unlabelled document holds."""
    if not lift or not p or not u:
        return Model({}, -60.0, prior)
    names = list(lift)

    def matrix(docs: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(docs), len(names)), np.float32)
        for i, d in enumerate(docs):
            x[i, d] = 1
        return x

    xp, xu = matrix(p), matrix(u)
    w = np.array([np.log(lift[x]) for x in names], np.float32)
    b = np.float32(np.log(prior / (1 - prior)))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        sp, su = sig(xp @ w + b), sig(xu @ w + b)
        negative = np.mean(np.logaddexp(0, xu @ w + b)) - prior * np.mean(np.logaddexp(0, xp @ w + b))
        dp, du = prior * (sp - 1) / len(p), su / len(u)
        dn = prior * sp / len(p)
        if negative >= 0:
            gw, gb = xp.T @ (dp - dn) + xu.T @ du, (dp - dn).sum() + du.sum()
        else:  # the negative part went below zero: step back up, as the non-negative estimator asks
            gw, gb = xp.T @ dn - xu.T @ du, dn.sum() - du.sum()
        gw = gw + decay * w
        m_w, v_w = 0.9 * m_w + 0.1 * gw, 0.999 * v_w + 0.001 * gw * gw
        m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.999 * v_b + 0.001 * gb * gb
        step = rate * 0.1 / np.sqrt(t)
        w = w - step * (m_w / (1 - 0.9**t)) / (np.sqrt(v_w / (1 - 0.999**t)) + 1e-8)
        b = b - step * (m_b / (1 - 0.9**t)) / (np.sqrt(v_b / (1 - 0.999**t)) + 1e-8)
    model = Model({x: float(v) for x, v in zip(names, w, strict=True)}, float(b), prior)
    return _cut(model, xp @ w + b, xu @ w + b)


def _least(n: int) -> int:
    """Positives, of ``n``, that must hold a word for it to be a feature."""
    return max(3, n // 100)


def _sure(n: int) -> float:
    """Standard deviations above chance at which a word of ``n`` positives can be a feature."""
    return max(4, n**0.5 / 4)


def _marks(found: list[str]) -> list[int]:
    """Eight minimum hashes of a document's long words (of all if it has none)."""
    long = [w.encode() for w in found if len(w) >= 6] or [w.encode() for w in found]
    return [min((zlib.crc32(w, k * 7919) * 2654435761 % 4294967291 for w in long), default=-1) for k in range(8)]


def _distinct(docs: Iterable[tuple[int, list[int]]]) -> list[int]:
    """The ids of (id, marks) without near copies: a document goes if two of its eight marks were seen."""
    seen: set[tuple[int, int]] = set()
    out = []
    for d, marks in docs:
        keys = set(enumerate(marks))
        if len(keys & seen) < 2:
            out.append(d)
        seen |= keys
    return out


def _cut(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Move the bias so that 0 is the cut of least non-negative PU risk under the zero-one loss.

    At a cut the risk is prior * (positives below) + max(0, unlabelled above - prior * positives above),
    in shares; no labelled negative takes part.  Of equal risks the cut in the widest gap wins, of
    equal gaps the lowest."""
    z = np.unique(np.concatenate([positive, unlabelled]).astype(np.float64))
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gaps = np.concatenate([[1.0], np.diff(z), [1.0]])
    above = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    all_above = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    risk = model.prior * (1 - above) + np.maximum(0, all_above - model.prior * above)
    best = np.lexsort((cuts, -gaps, np.round(risk, 12)))[0]
    return Model(model.weights, model.bias - float(cuts[best]), model.prior)


def _sample(rows: DataFrame) -> DataFrame:
    """Rows of (text, kind, i) as (kind, i, words, marks): the set of words and eight minimum hashes of it."""

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [sorted(words(x.as_py())) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(sets, pa.list_(pa.string())), pa.array([_marks(x) for x in sets], pa.list_(pa.int64()))], ["kind", "i", "words", "marks"])

    return rows.mapInArrow(run, "kind int, i long, words array<string>, marks array<long>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          positives: int = MOST_POSITIVES, unlabelled: int = MOST_UNLABELLED) -> Model:
    """Sample, by hash order of the key, at most so many keys of each kind (one row each), and fit.

    The executors turn whole texts into sets of words, count them and rank the features; the driver gets
    the marks of the positives, the counts of ``MOST_FEATURES`` words and the places of a document's features,
    never its words, so its memory does not grow with the texts."""
    bounded_batches(docs.sparkSession)
    order = [F.xxhash64(F.col("k").cast("string")), F.col("k")]
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("x")).where("k IS NOT NULL AND x IS NOT NULL").where(~held_out(F.col("k")))
    y = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("y IS NOT NULL").where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    y = materialize(y, "toxic_labels")
    take = lambda df, n: df.select("k").distinct().orderBy(*order).limit(n)
    ids_p = take(y.where("y = 1").join(d.select("k"), "k", "left_semi"), positives)
    ids_u = take(d.select("k").join(y.where("y = 1").select("k"), "k", "left_anti"), unlabelled)
    ids = ids_p.withColumn("kind", F.lit(1)).unionAll(ids_u.withColumn("kind", F.lit(0)))
    rows = d.join(F.broadcast(ids), "k").groupBy("k", "kind").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    sample = materialize(_sample(rows.select("x", "kind", order[0].alias("i"))), "toxic_sample")
    share = y.agg(F.avg("y").alias("p")).first()["p"] or 0.0
    prior = min(max(share, 0.01), 0.5)
    pos = _distinct(tuple(r) for r in sample.where("kind = 1").select("i", "marks").orderBy("i").collect())
    unl = [r["i"] for r in sample.where("kind = 0").select("i").orderBy("i").collect()]
    if not pos or not unl:
        release(y, sample)
        return Model({}, -60.0, prior)
    taken = sample.where((F.col("kind") == 0) | F.col("i").isin(pos)).select("i", "kind", F.explode("words").alias("w"))
    counts = taken.groupBy("w").agg(F.count_if(F.col("kind") == 1).alias("in_p"), F.count_if(F.col("kind") == 0).alias("in_u"))
    expected = F.lit(float(len(pos))) * (F.col("in_u") + 1) / (len(unl) + 1)
    counts = counts.where(F.col("in_p") >= _least(len(pos))).withColumn("expected", expected)
    counts = counts.withColumn("sure", (F.col("in_p") - F.col("expected")) / F.sqrt(F.col("expected") + 0.5))
    counts = counts.where((F.lit(prior) * F.col("in_p") / F.col("expected") >= 0.3) & (F.col("sure") >= _sure(len(pos))))
    best = counts.orderBy(F.desc("sure"), "w").limit(MOST_FEATURES).select("w", "in_p", "in_u").collect()
    lift = _chosen(best, len(pos), len(unl), prior)
    held: dict[int, list[int]] = {}
    if lift:
        place = F.array_position(F.array(*map(F.lit, lift)), F.col("w")) - 1
        found = taken.where(F.col("w").isin(list(lift))).groupBy("i").agg(F.collect_list(place).alias("places"))
        held = {r["i"]: r["places"] for r in found.collect()}
    release(y, sample)
    return _descend(lift, [held.get(i, []) for i in pos], [held.get(i, []) for i in unl], prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``' key with ``score``, from the whole text alone."""
    bounded_batches(docs.sparkSession)

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = [model.score(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")


def clean(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``; all columns pass through."""
    bounded_batches(docs.sparkSession)

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index(text)
            yield b.filter(pa.array([model.score(x.as_py()) < cut for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
