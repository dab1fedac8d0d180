"""Linear models of many groups at once: sums of products on executors, solved as small arrays.

A group's normal equations are sums over its rows, so partial sums meet before the shuffle and no group
is gathered; what is solved is one small matrix a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators import windows as W
from panelforge.session import checkpoint


def normal_sums(df: DataFrame, keys: list[str], xs: list[Column], y: Column, weight: Column | None = None, pull: Column | None = None) -> DataFrame:
    """keys, n, gram (upper triangle, row by row) and moment of each group's rows, those with a null left out.

    ``gram`` sums weight * x * x' and ``moment`` weight * x * y, plus x * ``pull``.
    """
    p, w = len(xs), F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*keys, *[x.cast("double").alias(f"__x{k}") for k, x in enumerate(xs)], y.cast("double").alias("__y"), w.alias("__w"), (F.lit(0.0) if pull is None else pull).alias("__p"))
    rows = rows.dropna(subset=[f"__x{k}" for k in range(p)] + ["__y", "__w"])
    x = [F.col(f"__x{k}") for k in range(p)]
    gram = [F.sum(F.col("__w") * x[i] * x[j]) for i in range(p) for j in range(i, p)]
    moment = [F.sum(x[i] * (F.col("__w") * F.col("__y") + F.col("__p"))) for i in range(p)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*gram).alias("gram"), F.array(*moment).alias("moment"))


def solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Solutions of stacked normal equations by Cholesky factors; where features depend on each other, the one of least norm (features scaled to one size)."""
    n, p = moment.shape
    full = np.zeros((n, p, p))
    i, j = np.triu_indices(p)
    full[:, i, j] = full[:, j, i] = gram
    scale = np.sqrt(np.where(np.einsum("nii->ni", full) > 0, np.einsum("nii->ni", full), 1.0))  # features of one size
    a, b = full / (scale[:, :, None] * scale[:, None, :]), moment / scale
    good = np.linalg.eigvalsh(a)[:, 0] > 1e-10 if n else np.zeros(0, bool)
    out = np.empty((n, p))
    if good.any():
        low = np.linalg.cholesky(a[good])
        half = np.linalg.solve(low, b[good][:, :, None])
        out[good] = np.linalg.solve(np.swapaxes(low, 1, 2), half)[:, :, 0]
    for k in np.flatnonzero(~good):
        out[k] = np.linalg.pinv(a[k], rcond=1e-10, hermitian=True) @ b[k]
    return out / scale


def solved(sums: DataFrame, keys: list[str], out: str = "weights") -> DataFrame:
    """keys, n and the weights of each group; a group's equations are solved in the task that summed them."""
    source = sums.select(*keys, "n", "gram", "moment")
    schema = T.StructType([*source.select(*keys, "n").schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            gram, moment = (np.array(b.column(c).to_pylist(), float) for c in ("gram", "moment"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, "n")), pa.array(solve(gram, moment).tolist(), pa.list_(pa.float64()))], schema.names)

    return source.mapInArrow(run, schema)


def dot(weights: Column, xs: list[Column]) -> Column:
    return sum((weights[k] * x for k, x in enumerate(xs[1:], 1)), weights[0] * xs[0])


def direct_models(panel: DataFrame, keys: list[str], day: str, y: str, features: dict[str, Column], horizons: range) -> tuple[DataFrame, DataFrame]:
    """A least-squares model for each group and horizon, and its forecasts from each group's last row.

    ``features`` are columns (windows over the group's own past among them) at the row a forecast is made at; the target of
    horizon h lies h rows later. All groups and horizons are fitted from one sorted scan: a row gives one product for each horizon. Returns
    models (keys, horizon, n, weights) and forecasts (keys, horizon, forecast). Rows with a null feature or without
    a target fit nothing; a group whose last row has a null feature has no forecast.
    """
    w = W.ordered(keys, day)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(y, h).over(w).alias("__target")) for h in horizons])
    rows = panel.select(*keys, *[c.alias(name) for name, c in features.items()], ahead.alias("__ahead"), F.lead(day).over(w).isNull().alias("__last"))
    each, xs = rows.select(*keys, *features, F.inline("__ahead")), [F.col(c) for c in features]
    models = checkpoint(solved(normal_sums(each.where("__target is not null"), [*keys, "horizon"], xs, F.col("__target")), [*keys, "horizon"]), "direct-models")
    made = rows.where("__last").select(*keys, *features).dropna(subset=list(features)).join(models, keys)
    return models, made.select(*keys, "horizon", dot(F.col("weights"), xs).alias("forecast"))


def quantile_weights(df: DataFrame, keys: list[str], y: str, xs: list[str], levels: list[float], weight: str | None = None, rounds: int = 60, tolerance: float = 1e-9, smooth: float = 1e-4) -> DataFrame:
    """keys, q, n, weights: for each group and quantile level the linear combination of ``xs`` with the least pinball loss.

    Each round solves normal equations whose rows weigh 1 / (smooth + |residual|), pulled by 2 q - 1 (a majorising
    quadratic of the loss). ``smooth``, in units of the group's mean absolute value, is reached by halves from a tenth, since a wide one
    moves fast and a narrow one ends near the least loss. Rounds end when no weight moves by more than ``tolerance`` of its size. Sums are taken on executors, for all groups and levels at once; models are
    one row for each group and level, and are broadcast only below ``MODELS`` rows. Rows with a null or without weight are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, F.col(y).cast("double").alias("__y0"), *[F.col(x).cast("double").alias(x) for x in xs], w.alias("__w0")).dropna().where("__w0 > 0")
    rows = checkpoint(rows, "quantile-rows")
    size = rows.groupBy(*keys).agg((F.sum(F.abs("__y0") * F.col("__w0")) / F.sum("__w0")).alias("__size"))
    levels_of = F.explode(F.array(*map(F.lit, levels))).alias("q")
    start = solved(normal_sums(rows, keys, [F.col(x) for x in xs], F.col("__y0"), F.col("__w0")), keys).join(size, keys)
    models = checkpoint(start.select(*keys, levels_of, "n", "weights", F.greatest(F.col("__size"), F.lit(1e-12)).alias("__size")), "quantile-models")
    few = models.count() <= MODELS
    features = [F.col(x) for x in xs]
    for k in range(rounds):
        width = max(smooth, 0.1 * 0.5**k)
        each = rows.join(F.broadcast(models) if few else models, keys)
        near = 1 / (width * F.col("__size") + F.abs(F.col("__y0") - dot(F.col("weights"), features)))
        sums = normal_sums(each, [*keys, "q", "__size"], features, F.col("__y0"), F.col("__w0") * near, F.col("__w0") * (2 * F.col("q") - 1))
        new = checkpoint(solved(sums, [*keys, "q", "__size"]), "quantile-models")
        moved = new.alias("a").join(models.select(*keys, "q", F.col("weights").alias("__old")), [*keys, "q"]).select(F.max(F.array_max(F.zip_with("weights", "__old", lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.lit(1.0)))))).first()[0]
        models = new.select(*keys, "q", "n", "weights", "__size")
        if moved is None or moved <= tolerance and width == smooth:
            break
    return models.select(*keys, "q", "n", "weights")


#: Models that are broadcast at most: some hundred bytes each.
MODELS = 100_000
