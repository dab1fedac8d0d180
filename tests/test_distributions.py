"""Distribution functions, quantiles and scores against sums and integrals of plain densities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import distributions as D

L = math.lgamma
PDF = {
    "gaussian": lambda x, m, s: np.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi)),
    "laplace": lambda x, m, s: np.exp(-abs(x - m) / s) / (2 * s),
    "student_t": lambda x, m, s, n: math.exp(L((n + 1) / 2) - L(n / 2)) / (s * math.sqrt(n * math.pi)) * (1 + ((x - m) / s) ** 2 / n) ** (-(n + 1) / 2),
    "gamma": lambda x, a, b: np.where(x > 0, np.exp(a * math.log(b) - L(a) + (a - 1) * np.log(np.maximum(x, 1e-300)) - b * x), 0.0),
    "beta": lambda x, a, b: np.where((x > 0) & (x < 1), np.exp(L(a + b) - L(a) - L(b) + (a - 1) * np.log(np.clip(x, 1e-300, 1)) + (b - 1) * np.log1p(-np.clip(x, 0, 1 - 1e-16))), 0.0),
    "poisson": lambda k, r: math.exp(k * math.log(r) - r - L(k + 1)),
    "negative_binomial": lambda k, m, al: math.exp(L(k + 1 / al) - L(1 / al) - L(k + 1) - math.log1p(al * m) / al + k * math.log(al * m / (1 + al * m))),
}
HEAD = {"gaussian": D.Gaussian, "laplace": D.Laplace, "student_t": D.StudentT, "gamma": D.Gamma, "beta": D.Beta, "poisson": D.Poisson, "negative_binomial": D.NegativeBinomial}
CASES = [
    ("gaussian", (3.0, 2.0), (-9.0, 0.0, 3.0, 3.1, 12.0)), ("laplace", (1.0, 0.5), (-2.0, 1.0, 4.0)), ("student_t", (0.5, 2.0, 5.0), (-8.0, 0.5, 3.0)), ("student_t", (0.0, 1.0, 2.5), (-3.0, 0.2, 9.0)),
    ("gamma", (2.0, 0.5), (0.1, 3.0, 20.0)), ("gamma", (1.3, 3.0), (0.01, 0.5, 2.0)), ("gamma", (900.0, 3.0), (270.0, 300.0, 333.0)), ("beta", (2.0, 3.0), (0.05, 0.4, 0.9)), ("beta", (1.5, 60.0), (0.001, 0.02, 0.2)),
    ("poisson", (0.3,), (0.0, 1.0, 4.0)), ("poisson", (37.5,), (20.0, 37.0, 60.0)), ("poisson", (2500.0,), (2400.0, 2555.0)), ("negative_binomial", (4.0, 0.5), (0.0, 3.0, 25.0)), ("negative_binomial", (120.0, 1.7), (0.0, 90.0, 700.0)),
]


def plain(name, pars, x, levels):
    """Distribution function, score and quantiles by a fine grid, or by sums for counts."""
    if name in ("poisson", "negative_binomial"):
        cdf = np.cumsum([PDF[name](k, *pars) for k in range(60_000 if name == "negative_binomial" else 6000)])
        k = np.arange(len(cdf))
        return cdf[int(x)], float(np.sum((cdf - (k >= x)) ** 2)), [int(np.searchsorted(cdf, p)) for p in levels]
    lo, hi = {"gamma": (0.0, max(60.0, 2.5 * pars[0]) / pars[1]), "beta": (0.0, 1.0)}.get(name, (-4000.0, 4000.0) if name == "student_t" else (-80.0, 80.0))
    inner = np.linspace(max(lo, -80.0), min(hi, 80.0) if name not in ("gamma",) else hi, 400_001)
    grid = np.unique(np.concatenate([inner, np.linspace(lo, hi, 100_001), [x]]))
    mids, steps = (grid[1:] + grid[:-1]) / 2, np.diff(grid)
    mass = PDF[name](mids, *pars) * steps
    cdf = np.concatenate([[0.0], np.cumsum(mass)])
    if name == "student_t":
        cdf += (1 - cdf[-1]) / 2
    half = (cdf[1:] + cdf[:-1]) / 2
    return float(np.interp(x, grid, cdf)), float(np.sum((half - (mids >= x)) ** 2 * steps)), [float(np.interp(p, cdf, grid)) for p in levels]


@pytest.mark.parametrize("name,pars,xs", CASES)
def test_against_grids(spark, name, pars, xs):
    head, levels = HEAD[name](*[F.col(f"p{k}") for k in range(len(pars))]), (0.005, 0.25, 0.5, 0.975)
    df = spark.createDataFrame([(x, *pars) for x in xs], "x double, " + ", ".join(f"p{k} double" for k in range(len(pars))))
    got = {r["x"]: r for r in df.select("x", head.cdf(F.col("x")).alias("cdf"), head.crps(F.col("x")).alias("crps"), *[head.quantile(F.lit(p) if k % 2 else p).alias(f"q{k}") for k, p in enumerate(levels)], head.mean().alias("m"), head.variance().alias("v")).collect()}
    for x in xs:
        cdf, crps, quantiles = plain(name, pars, x, levels)
        r = got[x]
        assert abs(r["cdf"] - cdf) < 2e-6 and abs(r["crps"] - crps) < 2e-4 * max(1, crps), (x, r, cdf, crps)
        for k, q in enumerate(quantiles):
            assert abs(r[f"q{k}"] - q) <= (0 if head.counts else 2e-3 * max(1, abs(q))), (k, r, q)


def test_mixtures_and_exact_values(spark):
    df = spark.createDataFrame([(0.3,), (-2.0,), (6.0,)], "x double")
    x, one = F.col("x"), F.lit(1.0)
    two = D.Mixture((D.Gaussian(F.lit(0.0), one), D.Gaussian(F.lit(5.0), F.lit(2.0))), (0.7, 0.3))
    grid = np.linspace(-60, 60, 2_400_001)
    mids, step = (grid[1:] + grid[:-1]) / 2, grid[1] - grid[0]
    cdf = np.cumsum((0.7 * PDF["gaussian"](mids, 0, 1) + 0.3 * PDF["gaussian"](mids, 5, 2)) * step)
    for r in df.select("x", two.cdf(x).alias("c"), two.crps(x).alias("s"), two.quantile(F.lit(0.9)).alias("q"), two.mean().alias("m"), two.variance().alias("v")).collect():
        assert abs(r["c"] - np.interp(r["x"], mids, cdf)) < 1e-4 and abs(r["s"] - np.sum((cdf - (mids >= r["x"])) ** 2) * step) < 1e-3 and abs(r["q"] - np.interp(0.9, cdf, mids)) < 1e-3
        assert abs(r["m"] - 1.5) < 1e-12 and abs(r["v"] - (0.7 + 0.3 * 29 - 2.25)) < 1e-12
    with pytest.raises(ValueError):
        D.Mixture((D.Laplace(one, one),), (1.0,)).crps(x)
    nine = df.select(D.incomplete_gamma(F.lit(1.0), F.lit(2.0)).alias("a"), D.incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("b"), D.Gaussian(F.lit(0.0), one).cdf(F.lit(1.959963984540054)).alias("c"), D.incomplete_gamma(F.lit(None).cast("double"), one).alias("n")).first()
    assert abs(nine["a"] - (1 - math.exp(-2))) < 1e-10 and abs(nine["b"] - (6 * 0.16 - 8 * 0.064 + 3 * 0.0256)) < 1e-10 and abs(nine["c"] - 0.975) < 1e-9 and nine["n"] is None
