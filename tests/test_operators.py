"""Operators on hand-written series: nulls, ties, short groups, zero denominators; against pandas where it defines the result."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforge.functions import distributions as D
from panelforge.functions import scalars as S
from panelforge.operators import forecast as B
from panelforge.operators import hierarchy as H
from panelforge.operators import joins as J
from panelforge.operators import metrics as M
from panelforge.operators import panel, reshape, sampling, scan
from panelforge.operators import windows as W

Y = [3.0, 1.0, None, 4.0, 1.0, 5.0, 9.0, 2.0]


@pytest.fixture(scope="module")
def series(spark):
    rows = [("a", k, y) for k, y in enumerate(Y)] + [("b", 0, 7.0), ("c", 0, None), ("c", 1, 2.0)]
    return spark.createDataFrame(rows, "id string, d int, y double")


def column(df, c, key="a"):
    return [r[0] for r in df.where(F.col("id") == key).orderBy("d").select(c.alias("x") if not isinstance(c, str) else c).collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and pd.isna(w)) or g == pytest.approx(w)


def test_rolling_equals_pandas(series):
    w, s = W.ordered(["id"], "d"), pd.Series(Y)
    out = series.select(
        "id", "d", W.rolling(F.avg, "y", w, 3).alias("mean"), W.rolling(F.avg, "y", w, 3, min_periods=1).alias("loose"), W.rolling(F.stddev_samp, "y", w, 4, 1).alias("std"), W.rolling_skew("y", w, 5).alias("skew"), W.rolling_kurt("y", w, 5).alias("kurt"), W.rolling(W.quantile(0.5), "y", w, 3).alias("median"), W.forward_fill("y", w).alias("ffill"),
    )
    same(column(out, "mean"), s.rolling(3).mean())
    same(column(out, "loose"), s.rolling(3, min_periods=1).mean())
    same(column(out, "std"), s.shift(1).rolling(4).std())
    same(column(out, "skew"), s.rolling(5).skew())
    same(column(out, "kurt"), s.rolling(5).kurt())
    same(column(out, "median"), s.rolling(3).median())
    same(column(scan.ewm_mean(series, ["id"], ["d"], "y", "ewm", 0.4), "ewm"), s.ewm(alpha=0.4).mean())
    same(column(out, "ffill"), s.ffill())
    assert column(out, "std", "b") == [None]


def test_ewm_of_full_series_needs_no_gaps(series):
    full = series.where("y is not null")
    values = [y for y in Y if y is not None and not pd.isna(y)]
    same(column(scan.ewm_mean(full, ["id"], ["d"], "y", "e", 0.3, gaps=False), "e"), pd.Series(values).ewm(alpha=0.3).mean())
    same(column(scan.ewm_mean(full, ["id"], ["d"], "y", "e", 0.3, adjust=False), "e"), pd.Series(values).ewm(alpha=0.3, adjust=False).mean())


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 1.0)], "id string, d int, y double")
    assert column(df.select("id", "d", W.average_rank_desc("y", W.by("id")).alias("r")), "r") == [1.0, 2.5, 2.5, 4.0]


def test_asof_ties_and_null_payload(spark):
    left = spark.createDataFrame([("u", 5), ("u", 0), ("v", 9), (None, 3)], "k string, ts int")
    right = spark.createDataFrame([("u", 5, 1, None), ("u", 4, 2, "x"), ("u", 5, 0, "y"), ("v", 10, 3, "z"), (None, 1, 4, "n")], "k string, ts int, seq int, p string")
    got = {(r["k"], r["ts"]): (r["seq"], r["p"]) for r in J.asof(left, right, "ts", ["k"], ["seq", "p"], "seq").collect()}
    assert got == {("u", 5): (1, None), ("u", 0): (None, None), ("v", 9): (None, None), (None, 3): (None, None)}


def test_asof_equals_pandas(spark):
    rng = random.Random(5)
    pick = lambda xs: [rng.choice(xs) for _ in range(80)]
    left = pd.DataFrame({"k": pick(["a", "b", "c"]), "ts": pick(range(40)), "i": range(80)}).sort_values("ts", kind="stable")
    right = pd.DataFrame({"k": pick(["a", "b", "d"]), "ts": pick(range(40)), "seq": [(-1) ** k * k * 10 for k in range(80)]}).sort_values(["ts", "seq"])
    want = pd.merge_asof(left, right, on="ts", by="k").sort_values("i")["seq"]
    extra = [("a", None, 90), (None, 3, 91), (None, None, 92)]
    lhs = spark.createDataFrame([*left.itertuples(index=False, name=None), *extra], "k string, ts int, i int")
    rhs = spark.createDataFrame([*right.itertuples(index=False, name=None), ("a", None, 5), (None, 1, 6), ("b", None, 7)], "k string, ts int, seq int")
    got = {r["i"]: r["seq"] for r in J.asof(lhs, rhs, "ts", ["k"], ["seq"], "seq").collect()}
    assert [got[k] for k in (90, 91, 92)] == [None] * 3
    same([got[k] for k in range(80)], want)


def test_shifted_is_the_self_join(spark):
    df = spark.sql("select id, date_add(date'2024-01-01', d) as d, y from values ('a', 0, 1.0D), ('a', 7, 2.0D), ('a', 8, 3.0D), ('a', 14, null), ('b', 7, 5.0D) t(id, d, y)")
    got = sorted((r["id"], r["d"].day, r["z"]) for r in J.shifted(df, ["id"], "d", "y", 7, "z").collect())
    assert got == [("a", 1, 2.0), ("a", 8, None)]


def test_validated_join_fails_on_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "x")], "k int, v string")
    assert {(r["k"], r["v"]) for r in J.validated(a, good, ["k"]).collect()} == {(1, "x"), (2, None)}
    with pytest.raises(PySparkException):
        J.validated(a, good.union(good), ["k"]).collect()
    with pytest.raises(ValueError):
        J.natural(a, spark.createDataFrame([(1,)], "other int"))


def test_levels_sum_to_the_total_and_keep_null_keys(spark):
    df = spark.createDataFrame([("r", "c", 1.0), ("r", None, 2.0), (None, "c", 4.0)], "region string, cat string, y double")
    out = H.aggregate(df, [[], ["region"], ["region", "cat"]], [], [F.sum("y").alias("y")]).collect()
    for level in ("total", "region", "region_cat"):
        assert sum(r["y"] for r in out if r["level"] == level) == 7.0


def test_top_down_sums_to_parents_and_survives_zero(spark):
    child = spark.createDataFrame([("p", "a", 1, 1.0), ("p", "b", 1, 3.0), ("q", "c", 1, 0.0)], "k string, id string, d int, y double")
    parent = spark.createDataFrame([("p", 1, 8.0), ("q", 1, 5.0)], "k string, d int, y double")
    assert {r["id"]: r["adjusted"] for r in H.top_down(child, parent, ["k"], "d", "y").collect()} == {"a": 2.0, "b": 6.0, "c": 0.0}


def test_leave_one_out_equals_the_loop(spark):
    rows = [("g", 2020, 1.0), ("g", 2021, 2.0), ("g", 2021, 4.0), ("h", 2020, 3.0)]
    got = {(r["id"], r["yr"]): r["mean_out"] for r in H.leave_one_out(spark.createDataFrame(rows, "id string, yr int, y double"), ["id"], "yr", "y").collect()}
    assert got == {("g", 2020): 3.0, ("g", 2021): 1.0, ("h", 2020): None}


def test_scores_with_zero_denominators(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "y double, f double")
    row = df.agg(M.mape("y", "f").alias("mape"), M.smape("y", "f").alias("smape"), M.nd("y", "f").alias("nd"), M.rmse("y", "f", 4).alias("rmse")).first()
    assert (row["mape"], row["smape"], row["nd"], row["rmse"]) == (0.0, 1.0, None, 0.5)


def test_clip_keeps_null_and_dense_panel_has_every_day(spark):
    df = spark.sql("select 'a' as id, date'2024-01-01' as d, 1.0D as y union all select 'b', date'2024-01-03', 2.0D")
    dense = panel.densify(df, ["id"], "d", ["y"])
    assert dense.count() == 6 and dense.where("y is null").count() == 4
    assert dense.select(panel.clip(F.col("y"), 1.5).alias("y")).where("y is null").count() == 4
    assert panel.future_rows(df, ["id"], "d", 2).count() == 4


def test_seasonal_naive_of_short_series_is_its_mean(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(7)] + [("b", 0, 1.0), ("b", 1, 3.0)], "id string, d int, y double")
    out = {(r["id"], r["step"]): r["forecast"] for r in B.seasonal_naive(df, "id", "d", "y", 7, 8).collect()}
    assert out["a", 1] == 0.0 and out["a", 8] == 0.0 and out["b", 5] == 2.0


def test_cascade_sums_to_the_adjusted_parents(spark):
    top = spark.createDataFrame([(1, 100.0)], "d int, y double")
    middle = spark.createDataFrame([("p", 1, 3.0), ("q", 1, 1.0)], "k string, d int, y double")
    bottom = spark.createDataFrame([("p", "a", 1, 1.0), ("p", "b", 1, 1.0), ("q", "c", 1, 7.0)], "k string, id string, d int, y double")
    out = H.cascade(top, [(middle, []), (bottom, ["k"])], "d", "y").collect()
    assert {r["id"]: r["y"] for r in out} == {"a": 37.5, "b": 37.5, "c": 25.0}


def test_codes_of_ranges_are_dense_and_ordered(spark):
    values = [None, "b", "a", "zz", "a", *(f"k{k:04d}" for k in range(500))]
    out = S.dense_codes(spark.createDataFrame([(v,) for v in values], "v string"), "v", "code").collect()
    assert [r["v"] for r in sorted(out, key=lambda r: r["code"])] == [None, *sorted(set(values) - {None})]
    assert sorted(r["code"] for r in out) == list(range(len(set(values))))
    assert S.dense_codes(spark.createDataFrame([], "v string"), "v", "code").collect() == []


def test_draws_follow_the_cumulative_weights(spark):
    weights = [(k, (k * 7) % 5 if k != 3 else None) for k in range(200)]
    draws = [(k, k * 37) for k in range(300)]
    order = sorted((k for k, w in weights if w), key=lambda k: (k % 8, k))
    line = [k for k in order for _ in range(dict(weights)[k])]
    got = sampling.draw_by_weight(spark.createDataFrame(weights, "id long, w long"), "id", "w", spark.createDataFrame(draws, "k long, u long"), 8).collect()
    assert {r["k"]: r["id"] for r in got} == {k: line[u % len(line)] for k, u in draws}


def test_log_gamma_and_densities_that_sum_to_one(spark):
    xs = [0.01, 0.5, 1.0, 2.0, 3.7, 10.0, 171.0, 1e4]
    got = [r["g"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(D.log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-9, abs=1e-9)
    k = spark.range(2000).select(F.col("id").cast("double").alias("x"))
    step = spark.range(1, 4000).select((F.col("id") / 100).alias("x"), (F.col("id") / 4000).alias("u"))
    lit = F.lit
    x = F.col("x")
    whole = k.agg(*[F.sum(F.exp(c)).alias(n) for n, c in (("poisson", D.poisson(x, lit(4.0))), ("nb", D.negative_binomial(x, lit(5.0), lit(0.4))))]).first()
    parts = step.agg(F.sum(F.exp(D.gamma(x, lit(2.5), lit(1.0))) / 100).alias("gamma"), F.sum(F.exp(D.beta(F.col("u"), lit(2.0), lit(3.0))) / 4000).alias("beta"), F.sum(F.exp(D.mixture([D.gaussian(x, lit(20.0), lit(2.0)), D.student_t(x, lit(20.0), lit(0.5), lit(9.0))], [0.4, 0.6])) / 100).alias("mix")).first()
    assert [*whole, *parts] == pytest.approx([1.0] * 5, abs=2e-3)


def test_normal_scores_equal_the_library(spark):
    levels = [1e-9, 0.001, 0.02424, 0.02425, 0.3, 0.5, 0.8, 0.97575, 0.9999]
    got = spark.createDataFrame([(u,) for u in levels], "u double").select(S.normal_score(F.col("u"))).collect()
    assert [row[0] for row in got] == pytest.approx([S.normal_quantile(u) for u in levels], rel=1e-8, abs=1e-8)


def test_power_scaling_is_fitted_and_keeps_nulls(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=500) * 0.5
    y = [(float(np.exp(x) - 1) if x >= 0 else float(1 - (1 - 2 * x) ** 0.5),) for x in z]  # normal under exponent 0
    df = spark.createDataFrame(y + [(None,)], "y double")
    assert abs(S.fit_yeo_johnson(df, "y", [k / 10 for k in range(-20, 41)]).first()["lam"]) <= 0.2
    assert S.fit_yeo_johnson(df.limit(0), "y", [0.0, 1.0]).first()["lam"] is None
    both = df.select(S.yeo_johnson(F.col("y"), F.lit(1.0)).alias("same"), "y").collect()
    assert all(a is None and b is None or a == pytest.approx(b) for a, b in both)


def test_bins_equal_digitise(spark):
    centres, values = [0.0, 0.0, 1.0, 4.0], [-1.0, 0.0, 0.4, 0.5, 2.5, 9.0]
    edges = np.convolve(centres, [0.5, 0.5], "valid")
    df = spark.createDataFrame([(v, centres) for v in values], "y double, c array<double>")
    assert [row[0] for row in df.select(S.digitise(F.col("y"), S.midpoints(F.col("c")))).collect()] == (np.digitize(values, edges) + 1).tolist()


def test_encoding_from_sums_and_weekday_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("b", 5.0), ("c", None)], "k string, y double")
    sums = df.groupBy("k", "y").agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("s2"))
    mean, std = W.encoding("n", "s", "s2", W.by("k"))
    got = {row["k"]: (row["m"], row["d"]) for row in sums.select("k", mean.alias("m"), std.alias("d")).collect()}
    assert got["a"] == pytest.approx((4.0, np.std([1, 3, 8], ddof=1))) and got["b"] == (5.0, None) and got["c"] == (None, None)
    days = spark.createDataFrame([("a", k, float(k)) for k in range(30)], "k string, d int, y double")
    means = W.same_weekday_means("y", W.ordered(["k"], "d"), (2, 4))
    got = {row["d"]: (row["m2"], row["m4"]) for row in days.select("d", *[c.alias(f"m{n}") for n, c in means.items()]).collect()}
    assert got[13] == (None, None) and got[14] == (3.5, 3.5) and got[28] == (17.5, 10.5)


def test_kernel_forecast_and_stack_equal_plain_versions(spark):
    rng = np.random.default_rng(5)
    start = datetime.date(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(i), float(rng.integers(0, 9))) for k in "ab" for i in range(40)] + [("a", start, None)]
    got = B.kernel_forecast(spark.createDataFrame(rows, "k string, d date, y double"), "k", "d", "y", 9, 10.0, 2.0, {"q50": 0.5}).collect()
    assert len(got) == 18
    last = start + datetime.timedelta(39)
    for row in got:
        to = last + datetime.timedelta(row["step"])
        w = sorted((y, math.exp(-(last - d).days / 10) * math.exp(-abs(d.weekday() - to.weekday()) / 2)) for k, d, y in rows if k == row["k"] and y is not None)
        total = sum(x for _, x in w)
        assert row["expected"] == pytest.approx(sum(y * x for y, x in w) / total)
        cumulative = np.cumsum([x for _, x in w])
        assert row["q50"] == w[int(np.argmax(cumulative >= 0.5 * total))][0]
    x = rng.normal(size=(50, 2))
    y = x @ [0.3, 0.6] + rng.normal(size=50) / 10
    df = spark.createDataFrame([(0, *map(float, (t, *p))) for t, p in zip(y, x)] + [(1, 1.0, 2.0, 4.0), (1, 2.0, 3.0, 6.0), (0, None, 1.0, 1.0)], "k int, y double, a double, b double")
    weights = {row["k"]: row[1:] for row in B.stack_two(df, ["k"], "y", "a", "b").collect()}
    assert weights[0] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0].tolist()) and weights[1] == (None, None)


def test_nearest_ranks_and_unstack(spark, monkeypatch):
    rows = [(g, k, v) for g, vs in (("a", [5.0, 1.0, None, 3.0, 3.0]), ("b", [2.0]), ("c", [None])) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {r["g"]: (r["low"], r["mid"], r["top"]) for r in B.nearest_ranks(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}).collect()}
    assert got == {"a": (1.0, 3.0, 5.0), "b": (2.0, 2.0, 2.0), "c": (None, None, None)}
    wide = reshape.unstack(df, ["g"], "k", "v")
    assert wide.columns == ["g", "F1", "F2", "F3", "F4", "F5"]
    assert sorted(map(tuple, wide.collect())) == [("a", 5.0, 1.0, None, 3.0, 3.0), ("b", 2.0, None, None, None, None), ("c", None, None, None, None, None)]
    assert reshape.unstack(df.limit(0), ["g"], "k", "v").columns == ["g"]
    monkeypatch.setattr(reshape, "MAX_COLUMNS", 4)
    with pytest.raises(ValueError):
        reshape.unstack(df, ["g"], "k", "v")


def test_holidays_by_rule_and_contributions(spark):
    one = spark.range(1)
    day = lambda c: one.select(c.alias("d")).first()["d"]
    year = F.lit(2024)
    assert day(S.nth_weekday(year, 11, 3, 4)) == datetime.date(2024, 11, 28) and day(S.nth_weekday(year, 5, 0, -1)) == datetime.date(2024, 5, 27) and day(S.nth_weekday(year, 9, 0, 1)) == datetime.date(2024, 9, 2)
    assert [day(S.observed(F.lit(x).cast("date"))) for x in ("2022-12-24", "2022-12-25", "2022-12-26")] == [datetime.date(2022, 12, 23), datetime.date(2022, 12, 26), datetime.date(2022, 12, 26)]
    df = spark.createDataFrame([("total", 2.0, 28.0), ("item", 1.0, 3.0), ("store_item", 1.0, 2.0)], "level string, loss double, w double")
    out = {r["level"]: (r["weight"], r["share"]) for r in M.contributions(df, "level", "loss", "w", 28, 2, ("store_item",)).collect()}
    assert out == {"total": (pytest.approx(1.0), pytest.approx(2 / 9)), "item": (3.0, pytest.approx(3 / 9)), "store_item": (4.0, pytest.approx(4 / 9))}
