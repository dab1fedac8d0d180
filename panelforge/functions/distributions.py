"""Distributions as columns: log densities, distribution functions, quantiles, the continuous ranked probability
score, means and variances of eight families.

The incomplete gamma and beta functions are loops of a bounded length inside one expression (``aggregate`` over a
sequence that grows with the root of the parameter), quantiles are closed forms or bisections between bounds that hold for every
distribution of a known mean and variance. No row needs Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.scalars import normal_quantile

#: The asymptotic series of the logarithm of the gamma function, coefficients of 1/x, 1/x^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8


def log_gamma(x: Column) -> Column:
    """Of positive numbers, to about ten digits: the series at ``x + 8``, carried back by the recurrence."""
    product, z = x, x + SHIFT
    for k in range(1, SHIFT):
        product = product * (x + k)
    tail = sum((F.lit(c) / F.pow(z, F.lit(2 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - F.log(product)


def gaussian(x: Column, mean: Column, std: Column) -> Column:
    return -0.5 * F.pow((x - mean) / std, F.lit(2)) - F.log(std) - 0.5 * math.log(2 * math.pi)


def laplace(x: Column, mean: Column, scale: Column) -> Column:
    return -F.abs(x - mean) / scale - F.log(2 * scale)


def student_t(x: Column, mean: Column, scale: Column, df: Column) -> Column:
    z = F.pow((x - mean) / scale, F.lit(2))
    return log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * F.log(math.pi * df) - F.log(scale) - (df + 1) / 2 * F.log1p(z / df)


def poisson(x: Column, rate: Column) -> Column:
    return x * F.log(rate) - rate - log_gamma(x + 1)


def negative_binomial(x: Column, mean: Column, alpha: Column) -> Column:
    """By mean and dispersion: the variance is mean + alpha * mean^2."""
    n, am = 1 / alpha, alpha * mean
    return log_gamma(x + n) - log_gamma(n) - log_gamma(x + 1) - n * F.log1p(am) + x * F.log(am / (1 + am))


def gamma(x: Column, shape: Column, rate: Column) -> Column:
    """Of positive x."""
    return shape * F.log(rate) - log_gamma(shape) + (shape - 1) * F.log(x) - rate * x


def beta(x: Column, a: Column, b: Column) -> Column:
    """Of x between 0 and 1."""
    return (a - 1) * F.log(x) + (b - 1) * F.log1p(-x) - log_gamma(a) - log_gamma(b) + log_gamma(a + b)


def mixture(log_densities: list[Column], weights: list[float]) -> Column:
    """The log of the weighted sum, by the largest term."""
    terms = [d + math.log(w) for d, w in zip(log_densities, weights)]
    most = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return most + F.log(sum((F.exp(t - most) for t in terms), F.lit(0.0)))


def let(values: list[Column], body) -> Column:
    """``body`` of values that are worked out once."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(f"v{k}") for k, v in enumerate(values)])), lambda x: body(*[x[f"v{k}"] for k in range(len(values))]))[0]


def _loop(steps: Column, start: dict[str, Column], step, result) -> Column:
    """Runs ``step`` for k = 1, 2, ... on named numbers."""
    pack = lambda d: F.struct(*[v.cast("double").alias(c) for c, v in d.items()])
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), pack(start), lambda acc, k: pack(step({c: acc[c] for c in start}, k.cast("double"))), lambda acc: result({c: acc[c] for c in start}))


def _steps(size: Column, each: float = 9.0) -> Column:
    """Enough for sixteen digits: terms shrink as those of a normal curve whose width is the root of the size."""
    return F.least(40 + each * F.sqrt(F.greatest(size, F.lit(1.0))), F.lit(1e6))


def incomplete_gamma(a: Column, x: Column) -> Column:
    """The lower regularised incomplete gamma function of positive a; 0 for x up to 0."""

    def body(a: Column, x: Column) -> Column:
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        # far from the middle terms shrink faster: by x / (a + 1) a step at least, or in the fraction by the distance in widths
        shrink = 40 + 40 / F.greatest(F.log((a + 1) / x), F.lit(1e-9))
        series = _loop(F.least(_steps(a), shrink), {"t": 1 / a, "s": 1 / a}, lambda v, k: {"t": v["t"] * x / (a + k), "s": v["s"] + v["t"] * x / (a + k)}, lambda v: v["s"])

        def fraction(v, k):
            c, d = (x + 1 - a + 2 * k) - k * (k - a) / v["c"], 1 / ((x + 1 - a + 2 * k) - k * (k - a) * v["d"])
            return {"c": c, "d": d, "h": v["h"] * c * d}

        first = 1 / (x + 1 - a)
        tail = _loop(F.least(_steps(a, 2.0), 40 + 1000 * a / ((x - a) * (x - a))), {"c": F.lit(1e300), "d": first, "h": first}, fraction, lambda v: v["h"])
        return F.when(x <= 0, 0.0).when(x < a + 1, front * series).otherwise(1 - front * tail)

    return let([a, x], body)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of positive a and b; 0 and 1 beside the unit interval."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(v, m):
            even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
            d = 1 / (1 + even * v["d"])
            c = 1 + even / v["c"]
            d2, c2 = 1 / (1 + odd * d), 1 + odd / c
            return {"c": c2, "d": d2, "h": v["h"] * d * c * d2 * c2}

        first = 1 / (1 - (a + b) * x / (a + 1))
        return _loop(_steps(F.least(a, b)), {"c": F.lit(1.0), "d": first, "h": first}, step, lambda v: v["h"])

    def body(a: Column, b: Column, x: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)

    return let([a, b, x], body)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def bisected(cdf, p: Column, lo: Column, hi: Column, steps: int = 55) -> Column:
    """Where a continuous distribution function reaches p, between two bounds."""

    def half(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        side = lambda below: F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))
        return F.transform(F.array(cdf(mid) < p), side)[0]  # the function is asked once a step

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi")), half, lambda v: (v["lo"] + v["hi"]) / 2)


def least_count(cdf, p: Column, hi: Column) -> Column:
    """The least whole number, 0 or more, whose distribution function reaches p, up to a bound where it does."""

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("double")
        side = lambda below: F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))
        return F.when(acc["hi"] - acc["lo"] > 1, F.transform(F.array(cdf(mid) < p), side)[0]).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(53)), F.struct(F.lit(-1.0).alias("lo"), F.ceil(hi).cast("double").alias("hi")), half, lambda v: v["hi"])


@dataclass(frozen=True)
class Head:
    """A family with its parameters as columns. ``x`` and ``p`` are columns; p lies strictly between 0 and 1. Null parameters give null."""

    def log_density(self, x: Column) -> Column:
        raise NotImplementedError

    def cdf(self, x: Column) -> Column:
        raise NotImplementedError

    def crps(self, x: Column) -> Column:
        raise NotImplementedError

    def mean(self) -> Column:
        raise NotImplementedError

    def variance(self) -> Column:
        raise NotImplementedError

    #: Where the family lives.
    support = (-math.inf, math.inf)
    counts = False

    def quantile(self, p: Column | float) -> Column:
        """Between the bounds that mean and variance set for any distribution (one-sided Chebyshev)."""

        def body(p: Column, m: Column, s: Column) -> Column:
            lo, hi = m - s * F.sqrt((1 - p) / p), m + s * F.sqrt(p / (1 - p))
            if self.counts:
                return least_count(self.cdf, p, F.greatest(hi, F.lit(0.0)) + 1)
            if self.support[0] > -math.inf:
                lo = F.greatest(lo, F.lit(self.support[0]))
            if self.support[1] < math.inf:
                hi = F.least(hi, F.lit(self.support[1]))
            return bisected(self.cdf, p, lo, hi)

        return let([F.lit(p), self.mean(), F.sqrt(self.variance())], body)

    def draw(self, u: Column) -> Column:
        """A draw, from a number drawn evenly between 0 and 1."""
        return self.quantile(u)


@dataclass(frozen=True)
class Gaussian(Head):
    m: Column
    s: Column

    def log_density(self, x):
        return gaussian(x, self.m, self.s)

    def cdf(self, x):
        return let([(x - self.m) / self.s], lambda z: 0.5 + 0.5 * F.signum(z) * incomplete_gamma(F.lit(0.5), z * z / 2))

    def quantile(self, p):
        """A level that is a number has a constant quantile; one that is a column is found by bisection."""
        return self.m + normal_quantile(p) * self.s if isinstance(p, float) else super().quantile(p)

    def crps(self, x):
        z = (x - self.m) / self.s
        return self.s * (z * (2 * self.cdf(x) - 1) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))

    def mean(self):
        return self.m

    def variance(self):
        return self.s * self.s


@dataclass(frozen=True)
class Laplace(Head):
    m: Column
    s: Column

    def log_density(self, x):
        return laplace(x, self.m, self.s)

    def cdf(self, x):
        tail = F.exp(-F.abs(x - self.m) / self.s) / 2
        return F.when(x < self.m, tail).otherwise(1 - tail)

    def quantile(self, p):
        p = F.lit(p)
        return self.m - self.s * F.signum(p - 0.5) * F.log1p(-2 * F.abs(p - 0.5))

    def crps(self, x):
        z = F.abs(x - self.m) / self.s
        return self.s * (z + F.exp(-z) - 0.75)

    def mean(self):
        return self.m

    def variance(self):
        return 2 * self.s * self.s


@dataclass(frozen=True)
class StudentT(Head):
    """Scores need over one degree of freedom; the variance over two."""

    m: Column
    s: Column
    df: Column

    def log_density(self, x):
        return student_t(x, self.m, self.s, self.df)

    def cdf(self, x):
        return let([(x - self.m) / self.s, self.df], lambda z, n: 0.5 + 0.5 * F.signum(z) * (1 - incomplete_beta(n / 2, F.lit(0.5), n / (n + z * z))))

    def quantile(self, p):
        """By bisection of u in z = u / (1 - u * u), since any degree of freedom is allowed."""
        at = lambda u: self.m + self.s * u / (1 - u * u)
        return at(bisected(lambda u: self.cdf(at(u)), F.lit(p), F.lit(-1.0 + 1e-15), F.lit(1.0 - 1e-15)))

    def crps(self, x):
        n, z = self.df, (x - self.m) / self.s
        density = F.exp(student_t(z, F.lit(0.0), F.lit(1.0), n))
        spread = 2 * F.sqrt(n) / (n - 1) * F.exp(log_beta(F.lit(0.5), n - 0.5) - 2 * log_beta(F.lit(0.5), n / 2))
        return self.s * (z * (2 * self.cdf(x) - 1) + 2 * density * (n + z * z) / (n - 1) - spread)

    def mean(self):
        return self.m

    def variance(self):
        return F.when(self.df > 2, self.s * self.s * self.df / (self.df - 2))


@dataclass(frozen=True)
class _Counts(Head):
    """Families of whole numbers: scores are sums over counts up to far beyond the value and the spread."""

    counts = True

    def _first(self) -> Column:
        """The log probability of zero."""
        raise NotImplementedError

    def _ratio(self, k: Column) -> Column:
        """The probability of k over that of k - 1."""
        raise NotImplementedError

    def crps(self, x):
        def body(x: Column, m: Column, s: Column, first: Column) -> Column:
            below = lambda k: F.greatest(F.least(x - k, F.lit(1.0)), F.lit(0.0))  # noqa: E731  the part of [k, k + 1] below x
            part = lambda f, k: f * f * below(k) + (1 - f) * (1 - f) * (1 - below(k))

            def step(v, k):
                log_p = v["l"] + F.log(self._ratio(k))
                f = v["f"] + F.exp(log_p)
                return {"l": log_p, "f": f, "s": v["s"] + part(f, k)}

            start = F.exp(first)
            return _loop(F.ceil(F.greatest(x, m + 20 * s)) + 20, {"l": first, "f": start, "s": part(start, F.lit(0.0))}, step, lambda v: v["s"]) + F.greatest(-x, F.lit(0.0))

        return let([x, self.mean(), F.sqrt(self.variance()), self._first()], body)


def _bessel_pair(z: Column) -> Column:
    """exp(-z) * (I0(z) + I1(z)) of z from 60 on, by the asymptotic series."""

    def one(order: int) -> Column:
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, 13):
            term = term * (-(4.0 * order * order - (2 * k - 1) ** 2) / (8 * k)) / z
            total = total + term
        return total

    return (one(0) + one(1)) / F.sqrt(2 * math.pi * z)


@dataclass(frozen=True)
class Poisson(_Counts):
    rate: Column

    def crps(self, x):
        """In closed form from a rate of 30 on; a sum over counts below it."""

        def closed(x: Column, m: Column) -> Column:
            here = Poisson(m)
            at = F.when(x < 0, 0.0).otherwise(F.exp(here.log_density(F.floor(x).cast("double"))))
            return (x - m) * (2 * here.cdf(x) - 1) + 2 * m * at - m * _bessel_pair(2 * m)

        return F.when(self.rate >= 30, let([x, self.rate], closed)).otherwise(super().crps(x))

    def log_density(self, x):
        return poisson(x, self.rate)

    def cdf(self, x):
        return F.when(x < 0, 0.0).otherwise(1 - incomplete_gamma(F.floor(x) + 1.0, self.rate))

    def _first(self):
        return -self.rate

    def _ratio(self, k):
        return self.rate / k

    def mean(self):
        return self.rate

    def variance(self):
        return self.rate


@dataclass(frozen=True)
class NegativeBinomial(_Counts):
    m: Column
    alpha: Column

    def crps(self, x):
        """In closed form for a large mean where 1 / alpha is a whole number up to 16; else a sum over counts."""

        def closed(x: Column, m: Column, n: Column) -> Column:
            p = 1 / (1 + m / n)
            q = 1 - p
            w = 4 * q / ((1 + q) * (1 + q))
            half = _loop(n, {"t": F.lit(1.0), "s": F.lit(1.0)}, lambda v, k: {"t": v["t"] * (k - n) * (k - 0.5) / ((k + 1) * k) * w, "s": v["s"] + v["t"] * (k - n) * (k - 0.5) / ((k + 1) * k) * w}, lambda v: v["s"])
            below = F.when(x < 1, 0.0).otherwise(incomplete_beta(n + 1, F.floor(x).cast("double"), p))
            return x * (2 * NegativeBinomial(m, 1 / n).cdf(x) - 1) - m * (2 * below - 1 + half / (1 + q))

        n = F.round(1 / self.alpha)
        whole = (self.m >= 100) & (n >= 1) & (n <= 16) & (F.abs(n * self.alpha - 1) < 1e-15)
        return F.when(whole, let([x, self.m, n], closed)).otherwise(super().crps(x))

    def log_density(self, x):
        return negative_binomial(x, self.m, self.alpha)

    def cdf(self, x):
        return F.when(x < 0, 0.0).otherwise(incomplete_beta(1 / self.alpha, F.floor(x) + 1.0, 1 / (1 + self.alpha * self.m)))

    def _first(self):
        return -F.log1p(self.alpha * self.m) / self.alpha

    def _ratio(self, k):
        return (k - 1 + 1 / self.alpha) / k * self.alpha * self.m / (1 + self.alpha * self.m)

    def mean(self):
        return self.m

    def variance(self):
        return self.m + self.alpha * self.m * self.m


@dataclass(frozen=True)
class Gamma(Head):
    shape: Column
    rate: Column
    support = (0.0, math.inf)

    def log_density(self, x):
        return gamma(x, self.shape, self.rate)

    def cdf(self, x):
        return incomplete_gamma(self.shape, x * self.rate)

    def crps(self, x):
        more = incomplete_gamma(self.shape + 1, x * self.rate)
        return x * (2 * self.cdf(x) - 1) - self.mean() * (2 * more - 1) - F.exp(-log_beta(F.lit(0.5), self.shape)) / self.rate

    def mean(self):
        return self.shape / self.rate

    def variance(self):
        return self.shape / (self.rate * self.rate)


@dataclass(frozen=True)
class Beta(Head):
    a: Column
    b: Column
    support = (0.0, 1.0)

    def log_density(self, x):
        return beta(x, self.a, self.b)

    def cdf(self, x):
        return incomplete_beta(self.a, self.b, x)

    def crps(self, x):
        spread = 2 * F.exp(log_beta(2 * self.a, 2 * self.b) - 2 * log_beta(self.a, self.b)) / self.a
        return x * (2 * self.cdf(x) - 1) + self.mean() * (1 - 2 * incomplete_beta(self.a + 1, self.b, x) - spread)

    def mean(self):
        return self.a / (self.a + self.b)

    def variance(self):
        return self.a * self.b / ((self.a + self.b) * (self.a + self.b) * (self.a + self.b + 1))


@dataclass(frozen=True)
class Mixture(Head):
    """Heads of continuous families with weights that sum to one; scores are closed for mixtures of Gaussians only."""

    heads: tuple[Head, ...]
    weights: tuple[float, ...]

    def log_density(self, x):
        return mixture([h.log_density(x) for h in self.heads], list(self.weights))

    def _mean_of(self, values) -> Column:
        return sum((w * v for w, v in zip(self.weights, values)), F.lit(0.0))

    def cdf(self, x):
        return self._mean_of([h.cdf(x) for h in self.heads])

    def quantile(self, p):
        """Between the least and the largest quantile of its parts."""
        return let([F.lit(p), *[h.quantile(p) for h in self.heads]], lambda p, *qs: bisected(self.cdf, p, F.least(*qs, qs[0]), F.greatest(*qs, qs[0])))

    def crps(self, x):
        if not all(isinstance(h, Gaussian) for h in self.heads):
            raise ValueError("scores are known for mixtures of Gaussians")

        def apart(m: Column, var: Column) -> Column:  # the mean distance of a Gaussian from zero
            return let([m, F.sqrt(var)], lambda m, s: 2 * s * F.exp(-m * m / (2 * s * s)) / math.sqrt(2 * math.pi) + m * (2 * Gaussian(F.lit(0.0), F.lit(1.0)).cdf(m / s) - 1))

        pairs = [u * v * apart(g.m - h.m, g.variance() + h.variance()) for u, g in zip(self.weights, self.heads) for v, h in zip(self.weights, self.heads)]
        return self._mean_of([apart(x - h.m, h.variance()) for h in self.heads]) - sum(pairs, F.lit(0.0)) / 2

    def mean(self):
        return self._mean_of([h.mean() for h in self.heads])

    def variance(self):
        return self._mean_of([h.variance() + h.mean() * h.mean() for h in self.heads]) - self.mean() * self.mean()
