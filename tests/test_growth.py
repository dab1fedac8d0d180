"""Steps whose rows, tasks or memory used to grow faster than the tables."""

import io
import re
from contextlib import redirect_stdout

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import distributions as D
from panelforge.operators import hierarchy as H
from panelforge.operators import metrics as M
from panelforge.operators import scan as S
from panelforge.plans import forecast_queries, relational_queries, window_queries
from panelforge.streaming import timers

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_level_losses_make_no_months_before_they_are_summed(spark):
    text = plan(forecast_queries.level_losses(spark, SF))
    assert "sequence(" not in text  # a row a series and month was made, and shuffled with the sums
    assert "concat_ws" not in text  # series are told apart by their keys, not by texts made of them


def test_level_sums_keep_their_keys(spark):
    rows = [("r1", 1, "c1", "d1", 10, 1, 2.0), ("r1", 1, "c1", "d1", 10, 1, 3.0), ("r1", 2, "c2", "d1", 11, 1, 4.0), (None, 3, None, None, None, 2, 5.0)]
    df = spark.createDataFrame(rows, "region string, store long, cat string, dept string, item long, m int, qty double")
    frames = H.level_sums(df, H.LEVELS, ["m"], {"q": F.col("qty")})
    assert all(frames[tuple(level)].columns == [*level, "m", "q"] for level in H.LEVELS)
    assert {tuple(r) for r in frames["store", "cat"].collect()} == {(1, "c1", 1, 5.0), (2, "c2", 1, 4.0), (3, None, 2, 5.0)}
    assert {tuple(r) for r in frames[()].collect()} == {(1, 9.0), (2, 5.0)}


def test_level_totals_divide_once(spark):
    rows = [("a", 4.0, 1.0, 10.0), ("a", 9.0, 1.0, 30.0), ("a", 1.0, 0.0, 10.0), ("b", 1.0, 1.0, 0.0), ("c", 1.0, None, 5.0)]
    got = {r["level"]: tuple(r)[1:] for r in M.level_totals(spark.createDataFrame(rows, "level string, mse double, scale double, revenue double")).collect()}
    assert got["a"] == (1.0, pytest.approx((10 * 2 + 30 * 3) / 50), 2)
    assert got["b"] == (0.0, 0.0, 1) and got["c"] == (1.0, None, 0)


def test_target_encoding_deals_stores_out_once(spark):
    text = plan(window_queries.w26(spark, SF))
    assert not re.findall(r"hashpartitioning\((store|item|region)#\w+, (cat|dept|item|region)#\w+, 4\)", text.split("__cat")[0])  # rows were dealt out once for each set


def test_parts_meet_distinct_keys(spark):
    assert plan(relational_queries.j21(spark, SF)).count("[l_partkey#") <= 2  # one scan (its columns are named twice), where semi and anti join had one each
    assert {r["k"] for r in relational_queries.j21(spark, SF).collect()} <= {"sold", "unsold"}


@pytest.mark.parametrize("query", [lambda *a: forecast_queries.h01(*a), lambda *a: relational_queries.ag27(*a)])
def test_levels_without_expanded_rows(spark, query):
    assert "Expand" not in plan(query(spark, SF))


def test_cascade_within_equals_the_cascade(spark):
    rows = [(1, "c1", "d1", 10, 7.0), (1, "c1", "d1", 11, 0.0), (1, "c1", "d2", 12, 25.0), (1, None, "d3", 13, 8.0), (1, "c2", None, 14, 9.0), (2, "c1", "d1", 10, 3.0), (None, "c1", "d1", 10, 5.0)]
    bottom = spark.createDataFrame(rows, "store long, cat string, dept string, item long, q double").withColumn("yr", F.lit(2000))
    own = lambda c: F.ceil(c / 10) * 10.0
    level = lambda *keys: bottom.groupBy(*keys, "yr").agg(own(F.sum("q")).alias("q"))
    top = level("store").select("store", "yr", (F.col("q") * 1.5).alias("q"))
    keys = ["store", "cat", "dept", "item"]
    steps = [(level(*keys[:k]), keys[: k - 1]) for k in (2, 3, 4)]
    want = H.cascade(top, steps, "yr", "q").select("store", "cat", "dept", "item", F.col("q").alias("adjusted"))
    got = H.cascade_within(bottom, top, ["store", "yr"], ["cat", "dept", "item"], "q", own)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert not re.findall(r"hashpartitioning\(store#\w+, (cat|yr)#\w+, (cat|dept)#", plan(got))  # no level is dealt out for itself


@pytest.mark.parametrize("query", [lambda *a: window_queries.w14_spans(*a), lambda *a: window_queries.w15_gaps(*a)])
def test_item_series_are_dealt_out_once(spark, query):
    text = plan(query(spark, SF))
    assert len(re.findall(r"Exchange (hash|range)partitioning", text)) == 1  # two scans dealt all rows out by ranges, after sums and gaps had by keys
    assert text.count("lineitem.parquet") == 1 and "panelforge/scan-" not in text  # sales and holes each read the table; scans wrote all rows


def test_tasks_of_item_series_grow_in_number_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(window_queries, "_ROWS", 500)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert re.findall(r"Exchange hashpartitioning\(item#\w+, (\d+)\)", plan(window_queries.w15_gaps(spark, SF))) == [str(rows // 500 + 1)]


def test_item_series_count_repeated_dimension_rows_as_joins_do(spark, tmp_path):
    for name in ("lineitem", "part", "supplier", "nation", "region"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.union(df) if name in ("nation", "region") else df).write.parquet(f"{tmp_path}/{name}.parquet")
    total = lambda path: window_queries._item_days(spark, path).agg(F.sum("y"), F.count("*")).first()
    once, four = total(SF), total(str(tmp_path))
    assert four[0] == 4 * once[0] and four[1] == once[1]


def test_carries_of_a_scan_sort_no_rows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "id string, d long, x double")
    text = plan(S.ewm_mean(df, ["id"], ["d"], "x", "e", 0.5))
    assert "max_by" not in text and "__tail" in text  # an aggregate over structs sorted all rows that the scan had written


class _Handle:
    def __init__(self):
        self.calls, self.rows = [], []

    def getListState(self, *_):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.calls.append(("set", at))

    def deleteTimer(self, at):
        self.calls.append(("drop", at))


class _At:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_user_has_one_timer_however_many_sessions(spark):
    handle, sessions = _Handle(), timers.Sessions(10)
    sessions.init(handle)
    list(sessions.handleInputRows((1,), iter([pd.DataFrame({"at": [0, 100, 5, 200, 300]})]), _At(0)))
    assert handle.calls == [("set", 15)]  # four timers before
    out = pd.concat(list(sessions.handleExpiredTimer((1,), _At(210), _At(15))))
    assert out[["first", "end", "n"]].values.tolist() == [[0, 15, 2], [100, 110, 1], [200, 210, 1]]
    assert handle.calls == [("set", 15), ("set", 310)] and handle.rows == [(300, 300, 1)]


def test_counts_are_scored_without_listing_them(spark):
    """Rates far beyond what a sum over counts could list, against the scores of the normal curve and of the gamma curve that they tend to."""
    df = spark.createDataFrame([(4e9, 4e9 + 6e4, 3e8)], "m double, x double, y double")
    poisson, normal, binomial, gamma = df.select(D.Poisson(F.col("m")).crps(F.col("x")), D.Gaussian(F.col("m"), F.sqrt("m")).crps(F.col("x")), D.NegativeBinomial(F.col("m"), F.lit(0.5)).crps(F.col("y")), D.Gamma(F.lit(2.0), 2 / F.col("m")).crps(F.col("y"))).first()
    assert poisson == pytest.approx(normal, rel=1e-4) and binomial == pytest.approx(gamma, rel=1e-6)


@pytest.mark.parametrize("head, x", [(lambda: D.Poisson(F.lit(31.0)), 25.0), (lambda: D.Poisson(F.lit(400.0)), 431.0), (lambda: D.NegativeBinomial(F.lit(120.0), F.lit(0.5)), 90.0), (lambda: D.NegativeBinomial(F.lit(120.0), F.lit(0.2)), 0.0)])
def test_closed_scores_equal_the_sums(spark, head, x):
    got, want = spark.range(1).select(head().crps(F.lit(x)), D._Counts.crps(head(), F.lit(x))).first()
    assert got == pytest.approx(want, rel=1e-8)
