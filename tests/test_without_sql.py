"""Operators that SQL can't express against plain versions: naive 2, PCA, boosted models, late rows of streams."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import forecast as B
from panelforge.operators.boosting import boosted
from panelforge.plans import registry
from panelforge.plans.base import brand_panel
from panelforge.streaming import events as E

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_naive_2(y, season, horizon):
    """Step by step over a list."""
    n = len(y)
    factor = [1.0] * season
    if season > 1 and n >= 3 * season and min(y) > 0 and len(set(y)) > 1:
        mean = sum(y) / n
        var = sum((v - mean) ** 2 for v in y)
        ac = [sum((y[t] - mean) * (y[t + k] - mean) for t in range(n - k)) / var for k in range(1, season + 1)]
        if 2 * ac[-1] ** 2 > 1.645 / n**0.5 * (1 + sum(2 * a * a for a in ac)) ** 0.5:
            half = season // 2
            ratios = [[] for _ in range(season)]
            for t in range(half, n - half):
                around = y[t - half : t + half + 1]
                trend = sum(around) / season if season % 2 else (sum(around[1:-1]) + (around[0] + around[-1]) / 2) / season
                ratios[t % season].append(y[t] / trend)
            means = [sum(r) / len(r) for r in ratios]
            factor = [m * season / sum(means) for m in means]
    return [y[-1] / factor[(n - 1) % season] * factor[(n + h) % season] for h in range(horizon)]


@pytest.mark.parametrize("season", [1, 4, 7])
def test_naive_2_step_by_step(spark, season):
    rng = np.random.default_rng(3)
    of = {
        "seasonal": [10 + 5 * (k % 7 == 0) + 3 * (k % 4 == 1) + rng.random() for k in range(60)], "noise": (rng.random(60) + 1).tolist(), "short": [1.0, 2.0, 3.0],
        "flat": [2.0] * 40, "zero": [0.0, 1.0] * 20, "single": [4.0],
    }
    df = spark.createDataFrame([(k, d, v) for k, ys in of.items() for d, v in enumerate(ys)], "id string, d int, y double")
    got = {(r["id"], r["step"]): r["forecast"] for r in B.naive_2(df, "id", "d", "y", season, 10).collect()}
    want = {(k, h + 1): v for k, ys in of.items() for h, v in enumerate(plain_naive_2(ys, season, 10))}
    assert got == pytest.approx(want)


def test_naive_2_query(spark):
    p = brand_panel(spark, SF, True).toPandas().sort_values("d")
    want = {(k, h + 1): v for k, g in p.groupby("id") for h, v in enumerate(plain_naive_2((g["y"] + 1).tolist(), 7, 28))}
    assert {(r["id"], r["step"]): r["forecast"] for r in registry.queries()["b02_naive_2"](spark, SF).collect()} == pytest.approx(want)


def _lagged(p, lags):
    p = p.sort_values(["id", "d"]).copy()
    for k in lags:
        p[f"y_lag_{k}"] = p.groupby("id")["y"].shift(k)
    return p.dropna()


def test_pca_equals_the_eigenvectors(spark):
    p = _lagged(brand_panel(spark, SF, True).toPandas(), range(1, 8))
    x = p[[f"y_lag_{k}" for k in range(1, 8)]].to_numpy()
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    scores = np.abs(x @ vectors[:, np.argsort(-values)[:2]])
    want = {(i, d): s for i, d, s in zip(p["id"], p["d"], scores.tolist())}
    got = {(r["id"], r["d"]): [r["pc1"], r["pc2"]] for r in registry.queries()["v12_pca"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-4) for k in got)


def plain_boosted(x, y, new, rounds, rate, n_cuts):
    cuts = [sorted({float(np.quantile([r[c] for r in x], q / n_cuts)) for q in range(1, n_cuts)}) for c in range(len(x[0]))]
    mean = sum(y) / len(y)
    fit, out = [mean] * len(y), [mean] * len(new)
    for _ in range(rounds):
        res, best = [a - b for a, b in zip(y, fit)], None
        for c, values in enumerate(cuts):
            for v in values:
                low, high = [r for r, row in zip(res, x) if row[c] <= v], [r for r, row in zip(res, x) if row[c] > v]
                if low and high:
                    a, b = sum(low) / len(low), sum(high) / len(high)
                    loss = sum((r - a) ** 2 for r in low) + sum((r - b) ** 2 for r in high)
                    if best is None or loss < best[0] - 1e-9:
                        best = (loss, c, v, a, b)
        _, c, v, a, b = best
        fit = [f + rate * (a if row[c] <= v else b) for f, row in zip(fit, x)]
        out = [f + rate * (a if row[c] <= v else b) for f, row in zip(out, new)]
    return out


def test_boosted_models_step_by_step_and_one_for_each_series(spark):
    rng = np.random.default_rng(1)
    x, new = rng.random((80, 3)), rng.random((20, 3))
    y = 3 * (x[:, 1] > 0.4) + x[:, 0] + 0.1 * rng.random(80)
    assert boosted(x, y, new, 12, 0.3, 16) == pytest.approx(plain_boosted(x.tolist(), y.tolist(), new.tolist(), 12, 0.3, 16))
    p = _lagged(brand_panel(spark, SF, True).toPandas(), (7, 14, 28))
    one, lags = p["id"].min(), ["y_lag_7", "y_lag_14", "y_lag_28"]
    p = p[p["id"] == one]
    old = pd.to_datetime(p["d"]) < "2001-01-01"
    want = boosted(p[old][lags].to_numpy(), p[old]["y"].to_numpy(), p[~old][lags].to_numpy())
    got = registry.queries()["x10_boosted_trees"](spark, SF).where(f"id = '{one}'").orderBy("d").collect()
    assert [r["forecast"] for r in got] == pytest.approx(want.round(4).tolist(), abs=1e-4)


def test_late_rows_are_dropped_and_closed_windows_come_once(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    batches = [[0, 1, 7], [8, 100], [99.2], [2, 99.5, 101], [200]]  # hours; the row at 2 is late when it comes: Spark drops by the watermark of the batch before
    for k, hours in enumerate(batches):
        pdf = pd.DataFrame({"event_id": range(len(hours)), "ts": [base + dt.timedelta(hours=h) for h in hours], "user_id": 1, "event_type": "view", "value": 1.0, "props": ""})
        pdf["ts"] = pdf["ts"].astype("datetime64[us]")
        pdf.to_parquet(tmp_path / f"events{k}.parquet")
        os.utime(tmp_path / f"events{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    folder = f"file://{tmp_path}"
    hour = lambda r: (r["start"] - base).total_seconds() / 3600
    counts = {hour(r): r["n"] for r in E.tumbling(E.stream(spark, folder, 1), "6 hours").collect()}
    assert counts == {0: 2, 6: 2, 96: 4, 198: 1}
    closed = [(hour(r), r["n"]) for r in E.closed_windows(E.stream(spark, folder, 1), "6 hours").collect()]
    assert sorted(closed) == [(0, 2), (6, 2), (96, 4)]
    assert {hour(r): r["n"] for r in E.sliding(E.stream(spark, folder, 1), "12 hours", "6 hours").collect()} == {-6: 2, 0: 4, 6: 2, 90: 4, 96: 4, 192: 1, 198: 1}
    assert E.running_totals(E.stream(spark, folder, 1)).collect()[0]["n"] == 10
