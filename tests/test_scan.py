"""Scans against pandas, on series that lie across many tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import scan as S


def panel(sizes, holes=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(None if k == 0 and len(sizes) > 2 else f"s{k}", k % 2, i, None if rng.random() < holes else float(np.round(rng.normal(5, 9), 3))) for k, n in enumerate(sizes) for i in range(n)]
    return [rows[i] for i in rng.permutation(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, k long, d long, x double")


def ranks(rows, f):
    df = pd.DataFrame(rows, columns=["id", "k", "d", "x"]).sort_values("d")
    return {(i if isinstance(i, str) else None, k, d): v for (i, k), g in df.groupby(["id", "k"], dropna=False) for d, v in zip(g.d, f(g.x.astype(float)))}


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k] is None and np.isnan(v)) or abs(got[k] - v) <= 1e-9 * max(1, abs(v)), (k, got[k], v)


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (23, 3)])
@pytest.mark.parametrize("sizes,holes", [((30, 1, 400, 2, 57), 0.3), ((300,), 0.0)])
def test_ewm_against_pandas(spark, partitions, batch, sizes, holes):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, (partitions, batch, "false")):
        spark.conf.set(k, v)
    try:
        rows = panel(sizes, holes, sum(sizes))
        for adjust, alpha, least in ((True, 0.3, 4), (False, 2 / 7, 1)):
            got = S.ewm_mean(frame(spark, rows), ["id", "k"], ["d"], "x", "e", alpha, adjust, least).collect()
            same({(r["id"], r["k"], r["d"]): r["e"] for r in got}, ranks(rows, lambda x: x.ewm(alpha=alpha, adjust=adjust, min_periods=least).mean()))
        if not holes:
            for adjust in (False,):
                got = S.ewm_mean(frame(spark, rows), ["id", "k"], ["d"], "x", "e", 0.2, adjust, gaps=False).collect()
                same({(r["id"], r["k"], r["d"]): r["e"] for r in got}, ranks(rows, lambda x: x.ewm(alpha=0.2, adjust=adjust).mean()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_series_of_a_hundred_thousand_rows(spark):
    rows = panel((100_000, 5), 0.1)
    df = frame(spark, rows).repartition(4)
    got = S.ewm_mean(df, ["id", "k"], ["d"], "x", "e", 0.05, min_periods=10).collect()
    same({(r["id"], r["k"], r["d"]): r["e"] for r in got}, ranks(rows, lambda x: x.ewm(alpha=0.05, min_periods=10).mean()))


def test_long_gaps_empty_tables_and_other_maps(spark):
    rows = [("a", 0, i, 1.0 if i == 0 else 9.0 if i == 2000 else None) for i in range(2001)]
    got = {r["d"]: r["e"] for r in S.ewm_mean(frame(spark, rows), ["id", "k"], ["d"], "x", "e", 0.9).collect()}
    assert got[1999] == 1.0 and got[2000] == 9.0  # weights that vanish leave the last state
    assert S.ewm_mean(frame(spark, []), ["id"], ["d"], "x", "e", 0.5).collect() == []
    df = frame(spark, [("a", 0, i, float(i)) for i in range(6)])
    out = S.affine_scan(df, ["id"], ["d"], {"total": (F.lit(1.0), F.col("x")), "x": (F.lit(-1.0), F.lit(1.0))}).orderBy("d").collect()
    assert [r["total"] for r in out] == [0, 1, 3, 6, 10, 15] and [r["x"] for r in out] == [1, 0, 1, 0, 1, 0]
    with pytest.raises(ValueError):
        S.affine_scan(df, [], ["d"], {})


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (23, 3)])
@pytest.mark.parametrize("sizes,holes", [((30, 1, 400, 2, 57), 0.3), ((300,), 0.9), ((7, 5), 0.0)])
def test_streamed_means_against_pandas(spark, partitions, batch, sizes, holes):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(before, (partitions, batch)):
        spark.conf.set(k, v)
    try:
        rows = panel(sizes, holes, sum(sizes))
        for adjust in (True, False):
            means = {"e": (0.3, 4), "f": (2 / 7, 1), "x": (1.0, 2)}
            got = S.ewm_means(frame(spark, rows), ["id", "k"], ["d"], "x", means, adjust, split=False).collect()
            for name, (alpha, least) in means.items():
                same({(r["id"], r["k"], r["d"]): r[name] for r in got}, ranks(rows, lambda x: x.ewm(alpha=alpha, adjust=adjust, min_periods=least).mean()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_streamed_means_over_long_gaps_other_types_and_empty_tables(spark):
    rows = [("a", 0, i, 1.0 if i == 0 else 9.0 if i == 2000 else None) for i in range(2001)]
    for adjust in (True, False):
        got = {r["d"]: r["e"] for r in S.ewm_mean(frame(spark, rows), ["id"], ["d"], "x", "e", 0.9, adjust, split=False).collect()}
        assert got[1999] == 1.0 and got[2000] == 9.0
    assert S.ewm_mean(frame(spark, []), ["id"], ["d"], "x", "e", 0.5, split=False).collect() == []
    df = frame(spark, [("a", 0, i, float(i)) for i in range(3)]).withColumn("x", F.col("x").cast("decimal(9,2)"))
    out = S.ewm_mean(df, ["id"], ["d"], "x", "e", 0.5, adjust=False, split=False)
    assert out.columns == ["id", "k", "d", "x", "e"] and [r["e"] for r in out.orderBy("d").collect()] == [0.0, 0.5, 1.25]
    with pytest.raises(ValueError):
        S.ewm_mean(df, [], ["d"], "x", "e", 0.5, split=False)
