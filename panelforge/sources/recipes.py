"""An algebra of synthetic series: generators are expressions that refer to each other and compile to columns.

A recipe names generators; each becomes a column over (series, step), and sums, products and lags of generators are generators.
Random ones draw by SHA-256 of the seed, their name, the series and the step, so a value depends on nothing
else: not on partitions, order of rows, or how many series there are. What runs along a series (lag, Markov chain, change
points) is a window over it; all of a recipe's share one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """What a generator compiles against: the seed and the columns of a frame of steps."""

    seed: int
    series: str
    step: str
    made: dict[str, Column]

    def along(self):
        return Window.partitionBy(self.series).orderBy(self.step)

    def uniform(self, name: str, at: Column | None = None) -> Column:
        """Evenly between 0 and 1, neither included, from 32 bits; ``at`` stands for the step."""
        at = F.col(self.step) if at is None else at
        key = F.concat_ws(":", F.lit(str(self.seed)), F.lit(name), F.col(self.series).cast("string"), at.cast("string"))
        return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32

    def normal(self, name: str, at: Column | None = None) -> Column:
        return F.sqrt(-2 * F.log(self.uniform(f"{name}/r", at))) * F.cos(2 * math.pi * self.uniform(f"{name}/a", at))


class Generator:
    """A node: compiles to stages of columns, since a window can't hold another one."""

    def __init__(self, compile_: Callable[[Context, str], Column], *needs: str | Generator):
        self.compile, self.needs = compile_, needs

    def __add__(self, other) -> Generator:
        return lifted(lambda a, b: a + b, self, other)

    __radd__ = __add__

    def __sub__(self, other) -> Generator:
        return lifted(lambda a, b: a - b, self, other)

    def __mul__(self, other) -> Generator:
        return lifted(lambda a, b: a * b, self, other)

    __rmul__ = __mul__


def lifted(f: Callable[..., Column], *args) -> Generator:
    """A function of columns applied to generators, names of the recipe (``ref``) and numbers."""
    nodes = [a if isinstance(a, Generator) else constant(a) for a in args]
    return Generator(lambda ctx, name: f(*[ctx.made[f"{name}/{k}"] for k in range(len(nodes))]), *nodes)


def constant(x: float) -> Generator:
    return Generator(lambda ctx, name: F.lit(float(x)))


def ref(name: str) -> Generator:
    """Another generator of the recipe, named before this one."""
    return Generator(lambda ctx, own: ctx.made[name], name)


def trend(slope: float, start: float = 0.0) -> Generator:
    return Generator(lambda ctx, name: start + slope * F.col(ctx.step))


def seasonality(period: float, amplitude: float = 1.0, phase: float = 0.0) -> Generator:
    return Generator(lambda ctx, name: amplitude * F.sin(2 * math.pi * F.col(ctx.step) / period + phase))


def gaussian(std: float = 1.0) -> Generator:
    return Generator(lambda ctx, name: std * ctx.normal(name))


def uniform(lo: float = 0.0, hi: float = 1.0) -> Generator:
    return Generator(lambda ctx, name: lo + (hi - lo) * ctx.uniform(name))


def per_series(lo: float, hi: float) -> Generator:
    """One draw a series."""
    return Generator(lambda ctx, name: lo + (hi - lo) * ctx.uniform(name, F.lit("series")))


def binary(p: float) -> Generator:
    return Generator(lambda ctx, name: F.when(ctx.uniform(name) < p, 1.0).otherwise(0.0))


def lag(of: Generator, k: int, fill: float = 0.0) -> Generator:
    return Generator(lambda ctx, name: F.coalesce(F.lag(ctx.made[f"{name}/0"], k).over(ctx.along()), F.lit(fill)), of)


def markov_chain(to_one: float, to_zero: float) -> Generator:
    """A chain of 0 and 1 that begins at 0 before the first step.

    A draw maps both states: to 1 (below ``to_one`` only), to 0 (below ``to_zero`` only), to the other one (below both), or
    to themselves. The state is that of the last draw that maps both to one state, turned by the number of turns since.
    """

    def draws(ctx: Context, name: str) -> Column:
        u = ctx.uniform(name)
        return F.when((u < to_one) & (u < to_zero), 2).when(u < to_one, 1).when(u < to_zero, 0).otherwise(3)

    def state(ctx: Context, name: str) -> Column:
        w = ctx.along().rowsBetween(Window.unboundedPreceding, 0)
        kind = ctx.made[f"{name}/0"]
        turns = F.sum(F.when(kind == 2, 1).otherwise(0)).over(w)
        return F.struct(turns.alias("t"), F.last(F.when(kind < 2, kind), ignorenulls=True).over(w).alias("s"), kind.alias("k"))

    def since(ctx: Context, name: str) -> Column:
        w = ctx.along().rowsBetween(Window.unboundedPreceding, 0)
        x = ctx.made[f"{name}/0"]
        at_last = F.last(F.when(x["k"] < 2, x["t"]), ignorenulls=True).over(w)
        return ((F.coalesce(x["s"], F.lit(0)) + x["t"] - F.coalesce(at_last, F.lit(0))) % 2).cast("double")

    return Generator(since, Generator(state, Generator(draws)))


def change_points(p: float, std: float) -> Generator:
    """A level that is drawn anew at each step with probability p; the first step has one too."""
    changes = Generator(lambda ctx, name: F.when(ctx.uniform(name) < p, 1).otherwise(0))
    count = Generator(lambda ctx, name: F.sum(ctx.made[f"{name}/0"]).over(ctx.along().rowsBetween(Window.unboundedPreceding, 0)), changes)
    return Generator(lambda ctx, name: std * ctx.normal(name, ctx.made[f"{name}/0"]), count)


def cumulated(of: Generator) -> Generator:
    return Generator(lambda ctx, name: F.sum(ctx.made[f"{name}/0"]).over(ctx.along().rowsBetween(Window.unboundedPreceding, 0)), of)


def missing_where(of: Generator, flag: Generator) -> Generator:
    """The generator, null where the flag is 1."""
    return lifted(lambda x, f: F.when(f != 1, x), of, flag)


def generate(series: DataFrame, id_col: str, steps: int, recipe: dict[str, Generator], seed: int = 0) -> DataFrame:
    """id, step (from 0) and a column for each named generator of the recipe.

    ``series`` is any table with an id column; each distinct id that isn't null becomes a series. A name may refer to names before it
    (``ref``); another order or an unknown name is a ValueError. Nodes compile depth first, one ``select`` for each layer that others build on.
    """
    ids = series.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    df = ids.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("step")) if steps > 0 else ids.select("id", F.lit(0).cast("long").alias("step")).limit(0)
    columns: dict[str, str] = {}
    layers: list[list[tuple[str, Generator]]] = []

    def place(node: Generator, path: str) -> int:
        """Puts a node behind what it needs; returns its layer."""
        at = 0
        for k, need in enumerate(node.needs):
            if isinstance(need, str):
                if need not in columns:
                    raise ValueError(f"{path} refers to {need}, which isn't named before it")
                at = max(at, depth[need] + 1)
            else:
                at = max(at, place(need, f"{path}/{k}") + 1)
        layers.extend([] for _ in range(at + 1 - len(layers)))
        layers[at].append((path, node))
        depth[path], columns[path] = at, f"__g{len(columns)}"
        return at

    depth: dict[str, int] = {}
    for name, node in recipe.items():
        place(node, name)
    ctx = Context(seed, "id", "step", {path: F.col(c) for path, c in columns.items()})
    for layer in layers:
        df = df.select("*", *[node.compile(ctx, path).alias(columns[path]) for path, node in layer])
    return df.select("id", "step", *[F.col(columns[name]).alias(name) for name in recipe])
