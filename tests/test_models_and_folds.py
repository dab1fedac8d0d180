"""Out-of-fold statistics, roll-ups, sparse scores and linear models against plain versions."""

import random
from collections import defaultdict
from statistics import median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import folds
from panelforge.operators import hierarchy as H
from panelforge.operators import metrics as M
from panelforge.operators import regression as R


def test_out_of_fold_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([2015, 2016, 2017, None]), rng.choice([None, *map(float, range(6))])) for _ in range(300)] + [("only", 0, 2016, 1.0), ("hot", 1, 2015, 2.0)] * 2
    got = {(r["g"], r["k"], r["yr"]): (r["n_out"], r["mean_out"], r["median_out"]) for r in folds.out_of_fold(spark.createDataFrame(rows, "g string, k int, yr int, v double"), ["g", "k"], "yr", "v").collect()}
    by = defaultdict(list)
    for g, k, yr, v in rows:
        if yr is not None and v is not None:
            for fold in (2015, 2016, 2017):
                if fold != yr:
                    by[g, k, fold].append(v)
    assert set(got) == set(by)  # a year gets rows for groups that it hasn't itself, and none for groups only it has
    assert ("only", 0, 2015) in got and ("only", 0, 2016) not in got
    for key, values in by.items():
        assert got[key] == pytest.approx((len(values), sum(values) / len(values), median(values)))
    nothing = folds.out_of_fold(spark.createDataFrame([], "g string, yr int, v double"), ["g"], "yr", "v")
    assert nothing.columns == ["g", "yr", "n_out", "mean_out", "median_out"] and nothing.collect() == []
    with pytest.raises(ValueError):
        folds.out_of_fold(spark.range(200).select(F.col("id").alias("yr"), F.lit(1.0).alias("v"), F.lit(1).alias("g")), ["g"], "yr", "v")


def test_trend_ratios_equal_the_join(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2015-01-01", periods=60)
    data = pd.DataFrame([(g, d.date(), float(rng.integers(0, 4))) for g in "ab" for d in days], columns=["g", "d", "y"])
    got = {(r["g"], r["d"], r["horizon"], r["measure"]): r["ratio"] for r in folds.trend_ratios(spark.createDataFrame(data), ["g"], "d", "y", {"m7": 7, "m3": 3}, F.col("y"), range(-2, 5)).collect()}
    want = {}
    for g, part in data.groupby("g"):
        y = part.set_index("d").y
        for name, n in (("m7", 7), ("m3", 3)):
            mean = y.rolling(n).mean()
            for d in y.index:
                for h in range(-2, 5):
                    v = mean.get((pd.Timestamp(d) - pd.Timedelta(days=h)).date())
                    if v is not None and v > 1e-12:
                        want[g, d, h, name] = y[d] / v
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    keys = spark.sql("select date'2016-03-08' d, 8 h union all select date'2016-03-31', -1").select(*folds.nth_weekday_keys(F.col("d"), F.col("h"))).collect()
    assert sorted(map(tuple, keys)) == [(2, 28, 3, 1, 2), (4, 1, 3, 3, 5)]


FACTS = "region string, store string, cat string, dept string, item string, m int, qty double"


def facts(n, seed=2):
    rng = random.Random(seed)
    return [(f"r{s % 2}", f"s{s}", f"c{i % 3}", f"d{i % 4}", f"i{i}", rng.randrange(40), float(rng.randrange(1, 9))) for s, i in ((rng.randrange(4), rng.randrange(9)) for _ in range(n))]


def test_rollup_equals_grouping_sets_without_expanding_facts(spark):
    df = spark.createDataFrame(facts(500), FACTS)
    one = H.rollup(df, H.LEVELS, ["m"], {"q": F.col("qty"), "n": F.lit(1)})
    two = H.aggregate(df, H.LEVELS, ["m"], [F.sum("qty").alias("q"), F.count("*").cast("int").alias("n")])
    show = lambda x: sorted(str((r["level"], r["group_id"], r["m"], r["q"], int(r["n"]))) for r in x.collect())
    assert show(one) == show(two)
    plan = one._jdf.queryExecution().toString()
    assert "Expand" not in plan and plan.count("Scan parquet") >= 1
    parents = {tuple(a): b for a, b in H.level_parents(H.LEVELS, {tuple(x): 4 ** len(x) + 1000 * ("item" in x) - ("region" in x) for x in H.LEVELS})}
    assert parents["store", "item"] is None and parents["item",] == ["region", "item"] and parents["cat",] in (["region", "cat"], ["item"]) and parents[()] is not None
    assert parents["region",] == ["store"]


@pytest.mark.parametrize("horizon,lag", [(4, 4), (3, 7)])
def test_sparse_scores_equal_dense_ones(spark, horizon, lag):
    rng = random.Random(horizon)
    rows = [(g, t, float(rng.randrange(1, 9)), float(rng.randrange(1, 5))) for g in "abcdef" for t in range(30) if rng.random() < {"a": 1, "b": 0.5, "c": 0.1, "d": 0.05}.get(g, 0.3) and (g != "e" or t >= 27) and (g != "f" or t in (3, 20))] + [("z", 29, 1.0, 1.0)]
    got = {r["g"]: r for r in M.sparse_scores(spark.createDataFrame(rows, "g string, t int, q double, p double"), ["g"], "t", "q", "p", horizon, lag).collect()}
    end = 29 - horizon
    for g in {r[0] for r in rows}:
        q, p = np.zeros(30), np.zeros(30)
        for _, t, a, b in (r for r in rows if r[0] == g):
            q[t], p[t] = a, b
        first = int(np.flatnonzero(q)[0])
        r = got[g]
        assert r["mse"] == pytest.approx(np.mean([(q[t] - q[t - lag]) ** 2 for t in range(end + 1, 30)]))
        steps = [(q[t] - q[t - 1]) ** 2 for t in range(first + 1, end + 1)]
        assert r["scale"] == (pytest.approx(np.mean(steps)) if steps else None) and r["revenue"] == pytest.approx(p[end - horizon + 1 : end + 1].sum())
    with pytest.raises(ValueError):
        M.sparse_scores(spark.createDataFrame(rows, "g string, t int, q double, p double"), ["g"], "t", "q", "p", 5, 4)


def test_direct_models_equal_least_squares(spark):
    rng = np.random.default_rng(7)
    data = {g: np.round(rng.gamma(2, 5, n), 3) for g, n in (("a", 90), ("b", 60), ("short", 12), ("flat", 50))}
    data["flat"][:] = 3.0
    rows = [(g, i, float(v)) for g, ys in data.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "g string, d int, y double").repartition(5)
    from panelforge.operators import windows as W

    w = W.ordered(["g"], "d")
    features = {"one": F.lit(1.0), "last": F.col("y"), "mean": W.rolling(F.avg, "y", w, 5), "twice": F.col("y") * 2}
    models, made = R.direct_models(df, ["g"], "d", "y", features, range(1, 8))
    forecasts = {(r["g"], r["horizon"]): r["forecast"] for r in made.collect()}
    counts = {(r["g"], r["horizon"]): r["n"] for r in models.collect()}
    for g, ys in data.items():
        x = np.array([[1.0, ys[i], ys[i - 4 : i + 1].mean(), 2 * ys[i]] for i in range(4, len(ys))])
        for h in range(1, 8):
            keep = len(x) - h
            if keep < 3:  # fewer rows than features that differ: any of many solutions
                continue
            beta = np.linalg.pinv(x[:keep]) @ ys[4 + h :]
            assert counts[g, h] == keep and forecasts[g, h] == pytest.approx(x[-1] @ beta, rel=1e-6, abs=1e-6), (g, h)
    assert len(forecasts) == len(counts) == 28


def plain_quantile(x, y, w, q, smooth, rounds):
    size = (abs(y) * w).sum() / w.sum()
    beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    for k in range(rounds):
        near = w / (max(smooth, 0.1 * 0.5**k) * size + abs(y - x @ beta))
        beta = np.linalg.solve((x * near[:, None]).T @ x, x.T @ (near * y + w * (2 * q - 1)))
    return beta


def loss(x, y, w, q, beta):
    e = y - x @ beta
    return (w * np.maximum(q * e, (q - 1) * e)).sum()


def test_quantile_weights_equal_a_plain_solver(spark):
    rng = np.random.default_rng(5)
    rows, sets = [], {}
    for g in ("total", "dept"):
        x = rng.gamma(3, 10, (150, 3))
        y = x @ [0.5, 0.3, 0.1] + rng.normal(0, 4, 150) * (1 + x[:, 0] / 40)
        w = rng.integers(1, 5, 150).astype(float)
        sets[g] = x, y, w
        rows += [(g, *map(float, a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    rows += [("total", None, 1.0, 1.0, 1.0, 1.0), ("total", 1.0, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double, w double")
    out = R.quantile_weights(df, ["g"], "y", ["a", "b", "c"], [0.1, 0.5], "w", rounds=24, tolerance=0.0, smooth=1e-4).collect()
    assert len(out) == 4
    for r in out:
        x, y, w = sets[r["g"]]
        beta = plain_quantile(x, y, w, r["q"], 1e-4, 24)
        assert r["n"] == 150 and np.abs(np.array(r["weights"]) - beta).max() < 1e-6
        around = min(loss(x, y, w, r["q"], beta + d) for d in rng.normal(0, 0.05, (3000, 3)))
        assert loss(x, y, w, r["q"], np.array(r["weights"])) < 1.01 * around  # near the least loss there is
