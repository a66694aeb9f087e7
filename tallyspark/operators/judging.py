"""Pairwise judging: battles, win rates, bootstrap, pairwise models; rubric scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import shared_folder

#: Score of the first side for each label, once or three times; fixed values.
LABELS = {
    "A>>B": (1.0, 3), "A>B": (1.0, 1), "A=B": (0.5, 1), "A<B": (0.0, 1), "A<<B": (0.0, 3),
    "B>>A": (0.0, 3), "B>A": (0.0, 1), "B=A": (0.5, 1), "B<A": (1.0, 1), "B<<A": (1.0, 3)}
#: The model that answers of a category are compared with; fixed values.
BASELINES = {"hard_prompt": "o3-mini-2025-01-31", "coding": "o3-mini-2025-01-31", "math": "o3-mini-2025-01-31", "creative_writing": "Qwen3-1.7B", "arena-hard-v0.1": "gpt-4-0314"}


def label_scores(label: Column) -> Column:
    """Array of scores for one game's label; unknown labels give null."""
    pairs = [x for k, (s, n) in LABELS.items() for x in (F.lit(k), F.array(*[F.lit(s)] * n))]
    return F.create_map(*pairs)[label]


def battles(games: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """One row a score: the second game as it is, the first mirrored; games without both labels go."""
    a = F.concat(label_scores(F.col(second)), F.transform(label_scores(F.col(first)), lambda s: 1.0 - s))
    return games.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*keys, F.explode(a).alias("score"))


def win_rates(scores: DataFrame, key: str) -> DataFrame:
    se = F.coalesce(F.stddev_samp("score") / F.sqrt(F.count("score")), F.lit(0.0))
    return scores.groupBy(key).agg(F.avg("score").alias("win_rate"), se.alias("stderr"), F.count("score").alias("n"))


def _resampled(values: DataFrame, key: str, value: str, rounds: int, seed: int) -> DataFrame:
    """(key, round, s, w): sums of values and of weights of ``rounds`` Poisson resamples, the rows of a key in one partition.

    Equal values of a key draw their weights at once, as the sum of n Poisson(1) is Poisson(n), so a hot key costs
    a row a round and distinct value.  A task holds the sums of a few rows' keys, never those of all its keys.
    Draws depend on key, value and seed only."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                of, h, n, x = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__k", "__h", "__n", "__x"))
                begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                s, w = np.zeros((len(begin), rounds)), np.zeros((len(begin), rounds), np.int64)
                for i, j in enumerate(np.searchsorted(begin, np.arange(len(of)), "right") - 1):
                    weights = np.random.default_rng([seed, int(h[i]) % (1 << 64)]).poisson(n[i], rounds)
                    s[j] += x[i] * weights
                    w[j] += weights
                columns = [b.column("__key").take(pa.array(np.repeat(begin, rounds))), np.tile(np.arange(rounds, dtype=np.int32), len(begin)), s.ravel(), w.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [key, "round", "s", "w"])

    d = values.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.col(value).cast("double").alias("__x"))
    d = d.groupBy("__key", "__x").agg(F.count(F.lit(1)).alias("__n")).withColumns({"__k": F.xxhash64("__key"), "__h": F.xxhash64("__key", "__x")})
    drawn = d.sortWithinPartitions("__key", "__x").mapInArrow(draw, f"`{key}` {dict(values.dtypes)[key]}, round int, s double, w long")
    # Dealt by key once, for the sums and for what follows by key.
    return drawn.repartition(key).groupBy(key, "round").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def bootstrap(scores: DataFrame, key: str, rounds: int = 100, seed: int = 42) -> DataFrame:
    """Mean, q05 and q95 of resampled means, in one aggregate."""
    m = _resampled(scores, key, "score", rounds, seed).select(key, (F.col("s") / F.nullif(F.col("w"), F.lit(0))).alias("m"))
    return interval(m, key, "m")


def interval(means: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, q05, q95) of the resampled values of each key; one aggregate, where three results were joined."""
    return means.groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.05)).alias("q05"), F.percentile(value, F.lit(0.95)).alias("q95"))


def bootstrap_std(values: DataFrame, key: str, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Population standard deviation of resampled means, each clipped to [0, 1]."""
    m = _resampled(values, key, value, rounds, seed)
    return m.groupBy(key).agg(F.stddev_pop(F.least(F.greatest(F.col("s") / F.nullif(F.col("w"), F.lit(0)), F.lit(0.0)), F.lit(1.0))).alias("std"))


def one_hot(model: Column, models: list[str], baseline: str) -> Column:
    """1 at the model, -1 at the baseline (also where the model is the baseline), 0 elsewhere; models sorted, the baseline among them."""
    names = sorted({*models, baseline})
    return F.array(*[F.lit(-1.0) if n == baseline else F.when(model == n, 1.0).otherwise(0.0) for n in names])


#: Losses of a pairwise model, by name; ``register_loss`` adds one.
LOSSES: dict = {}


def register_loss(name: str):
    def add(f):
        LOSSES[name] = f
        return f

    return add


@register_loss("bt")
def _bradley_terry(x: np.ndarray, y: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information of sum w (y log p + (1 - y) log(1 - p)), p = sigmoid(x . theta), for every column of theta."""
    p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
    h = weights * p * (1 - p)
    return x.T @ (weights * (y[:, None] - p)), np.einsum("ni,nr,nj->rij", x, h, x, optimize=True)


@register_loss("rk")
def _rao_kupper(x: np.ndarray, y: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for ties of their own: the last row of theta is the tie margin e > 0.

    With l = x . theta a win has log sigmoid(l - e), a loss log sigmoid(-l - e), and a tie both plus log(exp(2e) - 1)."""
    gradient, information = np.zeros_like(theta), np.zeros((theta.shape[1], len(theta), len(theta)))
    margin = np.maximum(theta[-1], 1e-6)
    for sign, rows in ((1.0, y > 0), (-1.0, y < 1)):
        z = np.column_stack([sign * x[rows], np.full(int(rows.sum()), -1.0)])
        w = weights[rows]
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -40, 40)))
        gradient += z.T @ (w * (1 - p))
        information += np.einsum("ni,nr,nj->rij", z, w * p * (1 - p), z, optimize=True)
    ties = weights[y == 0.5].sum(0)
    e = np.exp(2 * margin)
    gradient[-1] += ties * 2 * e / (e - 1)
    information[:, -1, -1] += ties * 4 * e / (e - 1) ** 2
    return gradient, information


def fit_pairs(battles: DataFrame, baseline: str, features: list[str] = (), rounds: int = 0, loss: str = "bt", model: str = "model", outcome: str = "score",
              seed: int = 42, steps: int = 50, tolerance: float = 1e-8, ridge: float = 1e-9) -> DataFrame:
    """(round, name, coefficient): a pairwise model of every battle's outcome, with style features beside the models.

    Each step of Newton's method is one aggregation: tasks sum gradient and information of their rows, the
    driver solves systems of as many unknowns as there are models and features.  Round 0 is the fit itself,
    rounds 1 to ``rounds`` are Poisson resamples, whose weights come from a hash of the row, so they are the
    same in every step.  A ridge of 1e-9 fixes what the data leave open (a common shift of all models)."""
    names = sorted({r[0] for r in battles.select(model).distinct().collect()} | {baseline})
    at = {n: i for i, n in enumerate(names)}
    k, n = len(names), rounds + 1
    size = k + len(features) + (loss == "rk")
    theta = np.zeros((size, n))
    theta[:k] = 0.5
    if loss == "rk":
        theta[-1] = 0.1
    rows = battles.select(F.col(model).alias("m"), F.col(outcome).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    dup = F.row_number().over(Window.partitionBy("h0").orderBy("h0"))
    rows = rows.withColumn("h0", F.xxhash64(*rows.columns))
    rows = rows.withColumn("h", F.xxhash64("h0", dup)).drop("h0") if rounds else rows.withColumnRenamed("h0", "h")
    path = shared_folder(battles.sparkSession, "battles")
    rows.write.parquet(path)  # every step reads the rows, so they are made once
    rows = battles.sparkSession.read.schema(rows.schema).parquet(path)

    def weights(h: np.ndarray) -> np.ndarray:
        w = np.ones((len(h), n))
        for r in range(1, n):
            u = _uniform(h, seed * 1000 + r)
            w[:, r] = np.searchsorted(_POISSON, u)
        return w

    for _ in range(steps):
        now = theta

        def sums(batches: Iterator) -> Iterator:
            import pyarrow as pa

            g, i = np.zeros_like(now), np.zeros((n, size, size))  # noqa: B023
            for b in batches:
                for s in range(0, b.num_rows, 8192):
                    c = b.slice(s, 8192)
                    m = c.column(0).to_pylist()
                    x = np.zeros((len(m), size - (loss == "rk")))
                    x[np.arange(len(m)), [at[v] for v in m]] = 1.0
                    x[:, at[baseline]] = -1.0
                    for j in range(len(features)):
                        x[:, k + j] = c.column(2 + j).to_numpy(zero_copy_only=False)
                    dg, di = LOSSES[loss](x, c.column(1).to_numpy(zero_copy_only=False), weights(c.column(c.num_columns - 1).to_numpy(zero_copy_only=False)), now)  # noqa: B023
                    g, i = g + dg, i + di
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([i.tobytes()], pa.binary())], ["g", "i"])

        g, i = np.zeros_like(theta), np.zeros((n, size, size))
        # A second round of sums, so the driver gets a few rows however many tasks there were.
        for r in rows.mapInArrow(sums, "g binary, i binary").repartition(8).mapInArrow(_added, "g binary, i binary").collect():
            g += np.frombuffer(r["g"]).reshape(g.shape)
            i += np.frombuffer(r["i"]).reshape(i.shape)
        g -= ridge * theta
        step = np.linalg.solve(i + ridge * np.eye(size), g.T[:, :, None])[:, :, 0].T
        step /= np.maximum(1, np.abs(step).max(0) / 4)  # far steps are shortened
        theta = theta + step
        if loss == "rk":
            theta[-1] = np.maximum(theta[-1], now[-1] / 4)  # the margin stays positive
        step[:k] -= step[at[baseline]]  # a common shift says nothing
        if np.abs(step).max() < tolerance:
            break
    labels = [*names, *features, *["tie_margin"] * (loss == "rk")]
    return battles.sparkSession.createDataFrame([(r, label, float(theta[j, r])) for r in range(n) for j, label in enumerate(labels)], "round int, name string, coefficient double")


def _added(batches: Iterator) -> Iterator:
    """Rows of packed doubles, added up column by column."""
    import pyarrow as pa

    held: list = [None, None]
    for b in batches:
        for k in range(2):
            for x in b.column(k).to_pylist():
                v = np.frombuffer(x)
                held[k] = v.copy() if held[k] is None else held[k] + v
    if held[0] is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in held], ["g", "i"])


_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, j + 1), dtype=float) for j in range(12)])


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes, another for every salt."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64) ^ (np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def pair_free(coefficients: DataFrame, baseline: str) -> DataFrame:
    """Coefficients of each round measured from the baseline's, which the data leave open."""
    base = coefficients.where(F.col("name") == baseline).select("round", F.col("coefficient").alias("b"))
    return coefficients.where(F.col("name") != baseline).join(F.broadcast(base), "round").select("round", "name", (F.col("coefficient") - F.col("b")).alias("coefficient"))


def pair_win_rates(coefficients: DataFrame, baseline: str, features: list[str] = ()) -> DataFrame:
    """(model, win_rate, lower, upper): the median and the 5 % and 95 % points over the rounds of exp(c) / (exp(c) + exp(base))."""
    c = coefficients.where(~F.col("name").isin(*features, "tie_margin"))
    base = c.where(F.col("name") == baseline).select("round", F.col("coefficient").alias("b"))
    p = c.join(F.broadcast(base), "round").select(F.col("name").alias("model"), (1 / (1 + F.exp(F.col("b") - F.col("coefficient")))).alias("p"))
    return p.groupBy("model").agg(F.percentile("p", F.lit(0.5)).alias("win_rate"), F.percentile("p", F.lit(0.05)).alias("lower"), F.percentile("p", F.lit(0.95)).alias("upper"))


def with_style(battles: DataFrame, metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Battles (uid, model, baseline, ...) joined with both sides' answer metadata (uid, model, len, columns) as a_ and b_."""
    side = lambda p, m: metadata.select(F.col("uid"), F.col("model").alias(m), F.col("len").alias(f"{p}_len"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return battles.join(side("a", "model"), ["uid", "model"]).join(side("b", "baseline"), ["uid", "baseline"])


def question_pairs(questions: DataFrame, answers: DataFrame, candidate: str, baselines: dict[str, str] = BASELINES) -> DataFrame:
    """(uid, category, prompt, answer, baseline, baseline_answer): questions that both the candidate and the category's baseline answered.

    A category without a baseline fails the job.  ``questions``: (uid, category, prompt); ``answers``: (uid, model, answer)."""
    known = F.create_map(*[F.lit(x) for kv in baselines.items() for x in kv])
    fail = F.raise_error(F.concat(F.lit("no baseline for category "), F.col("category"))).cast("string")
    q = questions.withColumn("baseline", F.coalesce(known[F.col("category")], fail))
    mine = answers.where(F.col("model") == candidate).select("uid", "answer")
    theirs = answers.select("uid", F.col("model").alias("baseline"), F.col("answer").alias("baseline_answer"))
    return q.join(mine, "uid").join(theirs, ["uid", "baseline"]).select("uid", "category", "prompt", "answer", "baseline", "baseline_answer")


def unjudged(pairs: DataFrame, judged: DataFrame, keys: list[str] = ("model", "uid")) -> DataFrame:
    """The pairs that no earlier run has judged."""
    return pairs.join(judged.select(*keys), list(keys), "left_anti")


def graded_items(examples: DataFrame, gradings: DataFrame, example: str) -> DataFrame:
    """(example, axis, points, met): rubric items met with their gradings by place; the longer list's rest goes.

    ``examples``: (example, rubrics array of (points, axis)); ``gradings``: (example, met array)."""
    j = examples.join(gradings, example)
    z = j.select(example, F.posexplode(F.arrays_zip("rubrics", "met")).alias("place", "i"), F.least(F.size("rubrics"), F.size("met")).alias("upto"))
    return z.where("place < upto").select(example, F.col("i.rubrics.axis").alias("axis"), F.col("i.rubrics.points").alias("points"), F.col("i.met").alias("met"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def call_accuracy(answers: DataFrame, calls: str = "calls", target: str = "target") -> DataFrame:
    """(n, n_correct, accuracy): an answer is right if it makes one call, of the target's function with its arguments.

    ``calls`` is an array of canonical calls (see ``parse_call``), ``target`` one of them."""
    right = (F.size(calls) == 1) & F.get(calls, F.lit(0)).eqNullSafe(F.col(target)) & F.col(target).isNotNull()
    return answers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(right, F.lit(False))).alias("n_correct"), F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy"))


def choices(questions: DataFrame, key: str, right: str, wrong: list[str], seed: int = 42) -> DataFrame:
    """``questions`` with ``options`` in a seeded order, the same in every run, and ``target``, the letter of the right one."""
    h = lambda c, i: F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"), F.lit(str(i))))
    sides = F.array_sort(F.array(*[F.struct(h(c, i).alias("h"), F.col(c).alias("text"), F.lit(i == 0).alias("ok")) for i, c in enumerate([right, *wrong])]))
    letters = F.array(*map(F.lit, "ABCDEFGHIJ"[: len(wrong) + 1]))
    place = F.array_position(F.transform(sides, lambda s: s["ok"]), True).cast("int")
    return questions.withColumns({"options": F.transform(sides, lambda s: s["text"]), "target": F.element_at(letters, place)})


def choice_accuracy(answers: DataFrame, pick: str = "pick", target: str = "target") -> DataFrame:
    right = F.coalesce(F.col(pick) == F.col(target), F.lit(False))
    return answers.agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def style(a: DataFrame, columns: list[str]) -> DataFrame:
    """Relative style differences of two sides, then z-scores over all battles.

    Length: (a - b) / (a + b); others are densities, (a - b) / (a + b + 1)."""
    d = a.withColumn("d_len", (F.col("a_len") - F.col("b_len")) / F.nullif(F.col("a_len") + F.col("b_len"), F.lit(0)))
    for c in columns:
        x, y = F.col(f"a_{c}") / (F.col("a_len") + 1), F.col(f"b_{c}") / (F.col("b_len") + 1)
        d = d.withColumn(f"d_{c}", (x - y) / (x + y + 1))
    names = ["d_len"] + [f"d_{c}" for c in columns]
    stats = d.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_samp(n).alias(f"s_{n}") for n in names])
    d = d.crossJoin(F.broadcast(stats))
    return d.select(*a.columns, *[((F.col(n) - F.col(f"m_{n}")) / F.nullif(F.col(f"s_{n}"), F.lit(0.0))).alias(f"z_{n}") for n in names])


def rubric_scores(items: DataFrame, example: str, met: str = "met", points: str = "points") -> DataFrame:
    """Points met over positive points for each example, 0 without positive points; not clipped."""
    pos = F.sum(F.when(F.col(points) > 0, F.col(points)))
    return items.groupBy(example).agg(F.coalesce(F.sum(F.when(F.col(met), F.col(points))) / pos, F.lit(0.0)).alias("score"))


def clipped_mean(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.least(F.greatest(F.avg("score"), F.lit(0.0)), F.lit(1.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def by_axis(items: DataFrame, axis: str, met: str = "met", points: str = "points") -> DataFrame:
    """Micro ratio for each axis; axes without positive points go."""
    pos = F.sum(F.when(F.col(points) > 0, F.col(points)).otherwise(0))
    return items.groupBy(axis).agg(F.coalesce(F.sum(F.when(F.col(met), F.col(points))), F.lit(0)).alias("met"), pos.alias("possible")).where("possible > 0").withColumn("ratio", F.col("met") / F.col("possible"))


def tag(tags: Column, prefix: str) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.try_element_at(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(1)), ":"), F.lit(2)), F.lit("unknown"))


def strict_bool(v: Column, path: str) -> Column:
    """A field of a VARIANT if it is a JSON boolean, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def fenced_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")), F.parse_json(F.lit("{}")))
