import random
import re

import numpy as np

from tallyspark.functions import text as T
from tallyspark.operators import judging


def _ascent(x, y, loss, steps=6000, rate=0.02):
    """Plain gradient ascent on the mean log likelihood, gradients by differences: nothing shared with the fit."""
    theta = np.zeros(x.shape[1] + (loss == "rk"))
    theta[-1] = 0.3 if loss == "rk" else 0.0
    sig = lambda v: 1 / (1 + np.exp(-v))

    def value(t):
        if loss == "bt":
            p = sig(x @ t)
            return np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        z, e = x @ t[:-1], t[-1]
        win, lose = sig(z - e), sig(-z - e)
        return np.mean(np.log(np.where(y == 1, win, np.where(y == 0, lose, 1 - win - lose))))

    for _ in range(steps):
        g = np.array([(value(theta + h) - value(theta - h)) / 2e-5 for h in 1e-5 * np.eye(len(theta))])
        theta = theta + rate * 50 * g
        if np.abs(g).max() < 1e-8:
            break
    return theta


def _battles(spark, ties):
    g = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        m = f"m{g.integers(3)}"
        f = float(g.standard_normal())
        p = 1 / (1 + np.exp(-({"m0": 0.4, "m1": -0.3, "m2": 0.0}[m] + 0.7 * f)))
        rows.append((m, f, 0.5 if ties and g.random() < 0.25 else float(g.random() < p)))
    return rows, spark.createDataFrame(rows, "model string, f double, score double")


def test_style_fit_meets_an_independent_one(spark):
    rows, df = _battles(spark, False)
    x = np.array([[m == "m0", m == "m1", m == "m2", f] for m, f, _ in rows], float)
    want = _ascent(x, np.array([r[2] for r in rows]), "bt")
    c = {r["name"]: r["coefficient"] for r in judging.fit_pairs(df, "base", ["f"]).collect()}
    got = np.array([c["m0"] - c["base"], c["m1"] - c["base"], c["m2"] - c["base"], c["f"]])
    assert np.abs(got - want).max() < 1e-3


def test_ties_fit_meets_an_independent_one(spark):
    rows, df = _battles(spark, True)
    x = np.array([[m == "m0", m == "m1", m == "m2"] for m, _, _ in rows], float)
    want = _ascent(x, np.array([r[2] for r in rows]), "rk")
    c = {r["name"]: r["coefficient"] for r in judging.fit_pairs(df, "base", loss="rk").collect()}
    got = np.array([c["m0"] - c["base"], c["m1"] - c["base"], c["m2"] - c["base"], c["tie_margin"]])
    assert np.abs(got - want).max() < 1e-3


def test_resampled_fits_are_the_same_in_every_run(spark):
    _, df = _battles(spark, False)
    one, two = ({(r["round"], r["name"]): round(r["coefficient"], 9) for r in judging.pair_free(judging.fit_pairs(df.repartition(n), "base", rounds=4), "base").collect()} for n in (2, 5))
    assert one == two and len({v for (r, m), v in one.items() if m == "m0"}) == 5


def test_repeated_strings_as_the_pattern_says():
    def slow(t, most=5):
        while True:
            before = t
            for a, b in T.BANDS:
                t = re.sub(rf"(.{{{a},{b}}}?)\\1{{{most},}}".replace("\\\\", "\\"), lambda m: m.group(1) * most, t, flags=re.S)
            if t == before:
                return t

    g = random.Random(3)
    for _ in range(150):
        t = "".join(g.choice(["ab", "abc", "x", "yz\n", "q" * 7, "lorem ipsum dolor sit amet "]) * g.choice([1, 2, 6, 9, 30]) for _ in range(g.randrange(1, 9)))
        assert slow(t) == T._limit_strings(t, 5)


def test_repeated_blocks_and_their_broken_end():
    block = ["a one", "b two", "c three"]
    assert T._limit_blocks(block * 8 + ["a one", "b t"], 5) == block * 5
    assert T._limit_blocks(block * 8 + ["other"], 5) == block * 5 + ["other"]
    assert T._limit_blocks(block * 5, 5) is None


def test_wrapped_lines():
    assert T._wrapped("aa bb cc dd\n\nx", "  ", 7) == "  aa bb\n  cc dd\n\n  x"
