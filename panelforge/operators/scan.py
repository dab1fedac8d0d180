"""Recurrences along series of any length, as a segmented parallel scan of affine maps.

``y = a * y_before + b`` composes: two neighbouring steps are one step with
``a2 * a1`` and ``a2 * b1 + b2``. Rows are dealt to ranges of (series, order). A task
composes the maps of its own rows, batch by batch, and forgets where it began: what it
lacks is one number a recurrence, the state at the end of the range before. Only a range's first series
can lack it, so carries are composed from at most two rows a range, and each such row of
data gets its carry in one product. No series is gathered in a row or a task, and a
series of half of all rows costs what many short ones cost. Series that cannot be long (a row
a day) need none of that: dealt out by key they are streamed, in one exchange and without files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import checkpoint


def composed(begins: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map from each segment's beginning to each row, by doubling: log2(n) steps over whole arrays. ``b`` may hold several rows for one ``a``."""
    a, b, closed, step = a.copy(), b.copy(), begins.copy(), 1
    while step < len(a) and not closed[step:].all():
        at = step + np.flatnonzero(~closed[step:])
        for c in np.atleast_2d(b):
            c[at] += a[at] * c[at - step]
        a[at] *= a[at - step]
        closed[at] |= closed[at - step]
        step *= 2
    return a, b


def _differs(c: pa.Array) -> np.ndarray:
    """Whether each value but the first is another one than that before it; nulls equal each other."""
    left, right = c.slice(0, len(c) - 1), c.slice(1)
    values = pc.fill_null(pc.not_equal(left, right), False)
    return pc.or_(values, pc.not_equal(left.is_null(), right.is_null())).to_numpy(zero_copy_only=False)


def affine_scan(df: DataFrame, keys: list[str], order: list[str], maps: dict[str, tuple[Column, Column]], before: bool = False) -> DataFrame:
    """Adds for each name of ``maps`` the state ``y = a * y_before + b`` along each series, which begins at 0.

    ``order`` sorts a series and should be unique in it (ties are processed in any order, one after the other). A null
    ``a`` or ``b`` leaves the state as it is. With ``before`` a row gets the state before it. Null keys are a
    series of their own; an empty table gives an empty result. Added names replace columns of the table.
    """
    if not keys or not order:
        raise ValueError("a scan needs keys and an order")
    kept, names = [c for c in df.columns if c not in maps], list(maps)
    parts = []
    for k, (a, b) in enumerate(maps.values()):
        open_ = a.isNull() | b.isNull()
        parts += [F.when(open_, 1.0).otherwise(a.cast("double")).alias(f"__a{k}"), F.when(open_, 0.0).otherwise(b.cast("double")).alias(f"__b{k}")]
    source = df.select(*kept, *parts).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    states = [f"__{c}{k}" for k in range(len(names)) for c in "ab"]
    schema = T.StructType([*source.schema.fields, *[T.StructField(f"__end_{c}", T.DoubleType()) for c in states], T.StructField("__head", T.BooleanType()), T.StructField("__row", T.LongType()), T.StructField("__tail", T.BooleanType())])
    columns = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(columns: list[pa.Array], tail: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(columns[0])) == (len(columns[0]) - 1 if tail else -1))], schema.names)

        state, last, head, row, held = [(1.0, 0.0)] * len(names), None, True, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for c in keys:
                begins[1:] |= _differs(batch.column(c))
            first = tuple(batch.column(c)[0].as_py() for c in keys)
            fresh = last is not None and first != last
            segment = np.cumsum(begins)
            heads = (segment == 0) & (head and not fresh)  # rows of the range's first series
            added, begins[0] = [], True
            for k in range(len(names)):
                a, b = (batch.column(f"__{c}{k}").to_numpy(zero_copy_only=False) for c in "ab")
                to_a, to_b = composed(begins, a, b)
                on = (segment == 0) & (not fresh)
                to_b = np.where(on, to_a * state[k][1] + to_b, to_b)
                to_a = np.where(on, to_a * state[k][0], to_a)
                end = to_a[-1], to_b[-1]
                if before:
                    first_a, first_b = (1.0, 0.0) if fresh else state[k]
                    to_a, to_b = np.concatenate([[first_a], to_a[:-1]]), np.concatenate([[first_b], to_b[:-1]])
                    new = begins.copy()
                    new[0] = fresh
                    to_a[new], to_b[new] = 1.0, 0.0
                state[k] = end
                added += [pa.array(to_a), pa.array(to_b)]
            head, last = bool(heads[-1]), tuple(batch.column(c)[n - 1].as_py() for c in keys)
            if held:
                yield ready(held, False)
            held = [*batch.columns, *added, pa.array(heads), pa.array(np.arange(row, row + n))]
            row += n
        if held:
            yield ready(held, True)

    done = checkpoint(source.mapInArrow(run, schema), "scan")
    # what a range hands on: the composition of its last series' rows, from the range's beginning or from that series' own
    last = done.where("__tail").select("__part", *keys, *states, *[f"__end_{c}" for c in states], "__head")  # an aggregate would sort all rows
    heads = done.where("__row = 0").select("__part", F.struct(*keys).alias("first"))
    carry = _carries(last.join(heads, "__part"), keys, len(names), before)
    joined = done.join(F.broadcast(carry), ["__part", "__head"], "left")  # one row a range
    out = [F.when(F.col(f"__c{k}").isNull(), F.col(f"__end___b{k}")).otherwise(F.col(f"__end___a{k}") * F.col(f"__c{k}") + F.col(f"__end___b{k}")).alias(name) for k, name in enumerate(names)]
    return joined.select(*kept, *out)


def _carries(ranges: DataFrame, keys: list[str], n: int, before: bool) -> DataFrame:
    """__part, __head (true), __c0...: the state that each range's first series has when the range begins.

    ``ranges`` has a row for each range, in one task: their number is that of tasks, whatever their rows.
    """
    end = lambda c, k: F.col(f"__end___{c}{k}")
    if before:  # the ends are those before the last row: add its own map
        step = {f"{c}{k}": (F.col(f"__a{k}") * end("a", k) if c == "a" else F.col(f"__a{k}") * end("b", k) + F.col(f"__b{k}")) for k in range(n) for c in "ab"}
    else:
        step = {f"{c}{k}": end(c, k) for k in range(n) for c in "ab"}
    rows = ranges.select("__part", "first", F.struct(*keys).alias("last"), F.col("__head").alias("whole"), *[v.alias(c) for c, v in step.items()])
    w = Window.orderBy("__part")  # one row a range
    rows = rows.withColumn("same", F.coalesce(F.lag("last").over(w).eqNullSafe(F.col("first")) & F.lag("__part").over(w).isNotNull(), F.lit(False)))
    items = rows.agg(F.array_sort(F.collect_list(F.struct("__part", "whole", "same", *step))).alias("xs"))
    # a range that begins with the series before it ended with takes its state; after it, its last series is at a * carry + b
    carry = lambda acc, x, k: F.when(x["same"], acc["s"][k]).otherwise(0.0)
    after = lambda acc, x, k: F.when(x["whole"], x[f"a{k}"] * carry(acc, x, k) + x[f"b{k}"]).otherwise(x[f"b{k}"])
    scanned = F.aggregate(
        "xs",
        F.struct(F.array(*[F.lit(0.0)] * n).alias("s"), F.array().cast("array<array<double>>").alias("c")),
        lambda acc, x: F.struct(F.array(*[after(acc, x, k) for k in range(n)]).alias("s"), F.concat(acc["c"], F.array(F.array(*[carry(acc, x, k) for k in range(n)]))).alias("c")),
        lambda acc: acc["c"],
    )
    pairs = items.select(F.inline(F.arrays_zip(F.col("xs.__part").alias("__part"), scanned.alias("c"))))
    return pairs.select("__part", F.lit(True).alias("__head"), *[F.col("c")[k].alias(f"__c{k}") for k in range(n)])


def ewm_mean(df: DataFrame, keys: list[str], order: list[str], c: str, out: str, alpha: float, adjust: bool = True, min_periods: int = 1, gaps: bool = True, split: bool = True) -> DataFrame:
    """One exponentially weighted mean; see ``ewm_means``."""
    return ewm_means(df, keys, order, c, {out: (alpha, min_periods)}, adjust, gaps, split)


def ewm_means(df: DataFrame, keys: list[str], order: list[str], c: str, means: dict[str, tuple[float, int]], adjust: bool = True, gaps: bool = True, split: bool = True) -> DataFrame:
    """Exponentially weighted means by name, each of an alpha and a least number of values, as pandas' ``ewm(alpha=alpha, adjust=adjust).mean()``.

    Adjusted: two recurrences of one decay, of values and of weights, and their ratio. Recursive: the first value, then the weighted
    mean of the last state, aged by the rows since it, and the value. Nulls age the weights of what came before; at a null a mean is the last
    state, and null until ``min_periods`` values that aren't null. Without ``gaps`` (a series that has no nulls) one scan is saved. All means share their scans.
    Without ``split`` a series is streamed by one task, for series whose length has a bound (a row a day): an exchange by key that the table has already serves.
    """
    if not all(0 < alpha <= 1 for alpha, _ in means.values()):
        raise ValueError("alpha lies in (0, 1]")
    if not split:
        return _streamed(df, keys, order, c, means, adjust)
    x, none, one = F.col(c).cast("double"), F.col(c).isNull(), F.lit(1.0)
    rest = [k for k in df.columns if k not in means]
    count = (one, F.when(none, 0.0).otherwise(1.0))
    if gaps:  # rows since the last value and values so far, before each row
        is_null = F.when(none, 1.0).otherwise(0.0)
        df = affine_scan(df, keys, order, {"__gap": (is_null, is_null), "__before": count}, before=True)
    elif not adjust:
        df = affine_scan(df, keys, order, {"__before": (one, one)}, before=True)
    first, maps, held = F.col("__before") == 0, {"__n": count}, {}
    for k, (name, (alpha, least)) in enumerate(means.items()):
        aged = F.pow(F.lit(1.0 - alpha), (F.col("__gap") if gaps else F.lit(0.0)) + 1)
        if adjust:
            maps[f"__s{k}"], maps[f"__w{k}"] = (F.when(none, 1.0).otherwise(aged), F.when(~none, x)), (F.when(none, 1.0).otherwise(aged), F.when(~none, 1.0))
        else:
            maps[f"__s{k}"] = (F.when(first, 0.0).otherwise(aged / (aged + alpha)), F.when(~none, F.when(first, x).otherwise(alpha * x / (aged + alpha))))
        held[name] = F.when(F.col("__n") >= max(least, 1), F.col(f"__s{k}") / F.col(f"__w{k}") if adjust else F.col(f"__s{k}"))
    return affine_scan(df, keys, order, maps).select(*rest, *[v.alias(name) for name, v in held.items()])


def _streamed(df: DataFrame, keys: list[str], order: list[str], c: str, means: dict[str, tuple[float, int]], adjust: bool) -> DataFrame:
    """``ewm_means`` by one pass over sorted series; from batch to batch go a series' last value's row number, the values so far and the states."""
    if not keys or not order:
        raise ValueError("a mean needs keys and an order")
    kept = [k for k in df.columns if k not in means or k == c]
    source = df.select(*kept, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("__i"))  # the window deals rows out and sorts them
    rest = [k for k in df.columns if k not in means]
    schema = T.StructType([*[source.schema[k] for k in rest], *[T.StructField(name, T.DoubleType()) for name in means]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, states = 0, 0, [np.array([0.0, 1.0])] * len(means)
        for batch in batches:
            if not batch.num_rows:
                continue
            i = batch.column("__i").to_numpy().astype(np.int64)
            segment, known = np.cumsum(i == 1), batch.column(c).is_valid().to_numpy(zero_copy_only=False)
            x = batch.column(c).filter(pa.array(known)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            # the values, after one that stands for the batches before
            rows, of = np.concatenate([[at], i[known]]), np.concatenate([[0], segment[known]])
            first = np.concatenate([[False], (of[1:] != of[:-1]) | (rows[:-1] == 0)])
            begins = first.copy()
            begins[0] = True
            places = np.arange(len(rows))
            start = np.maximum.accumulate(np.where(begins, places, 0))
            count = places - start + np.where(start == 0, n, 1)
            gap = np.where(begins, 1, np.diff(rows, prepend=0))
            latest = np.cumsum(known)  # each row's last value
            inside, last = of[latest] == segment, rows[-1] * (of[-1] == segment[-1])
            added = []
            for k, (alpha, least) in enumerate(means.values()):
                a = np.power(1.0 - alpha, gap)
                if adjust:
                    b = np.concatenate([states[k][:, None], [x, np.ones(len(x))]], axis=1)
                else:
                    a, share = a / (a + alpha), alpha / (a + alpha)
                    b = np.concatenate([states[k][:1, None], [np.where(first[1:], 1.0, share[1:]) * x]], axis=1)
                _, b = composed(begins, a, b)
                value = b[0] / b[1] if adjust else b[0]
                states[k] = np.resize(b[:, -1], 2)
                added.append(pa.array(value[latest], mask=~(inside & (count[latest] >= max(least, 1)))))
            at, n = (int(last), int(count[-1])) if last else (0, 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], *added], schema.names)

    return source.mapInArrow(run, schema)


def ewm_span(span: float) -> float:
    """The decay of a span of rows."""
    return 2.0 / (span + 1.0)
