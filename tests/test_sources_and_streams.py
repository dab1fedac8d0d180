"""JSON lines with places, recipes, rolling order statistics, instances, table functions and timers against plain versions."""

import io
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelforge.operators import flatmap
from panelforge.operators import order_statistics as OS
from panelforge.operators import splits as SP
from panelforge.sources import jsonl
from panelforge.sources import recipes as R
from panelforge.streaming import timers


@pytest.mark.parametrize("size", [1, 3, 7, 50, 10_000])
def test_ranges_read_each_line_once(size, monkeypatch):
    rng = random.Random(size)
    for read in (1, 4, 1 << 20):
        monkeypatch.setattr(jsonl, "READ_BYTES", read)
        for _ in range(30):
            data = b"\n".join(bytes(rng.choice(b"ab ") for _ in range(rng.choice([0, 1, 2, 9, 30]))) for _ in range(rng.randrange(9)))
            want, at = [], 0
            for line in data.split(b"\n"):
                want.append((at, line))
                at += len(line) + 1
            if want[-1][1] == b"":  # what follows the last line feed is no line
                want.pop()
            got = [x for s in range(0, len(data), size) for x in jsonl.lines_of(io.BytesIO(data), s, min(s + size, len(data)))]
            assert got == want, (data, size, read)


def test_places_and_bad_lines(spark, tmp_path):
    lines = [json.dumps({"a": k, "b": "é" * (k % 5)}, ensure_ascii=False) for k in range(200)]
    lines[7], lines[50], lines[51], lines[120] = '{"a": 7, "b"', "", "3", '{"a": "x", "b": "y"}'
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.json").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "sub" / "two.json").write_text("\n".join(lines[:40]) + "\n", encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("no data")
    (tmp_path / "empty.json").write_text("")
    path = f"file://{tmp_path}"
    rows = jsonl.read_json_lines(spark, path, "a long, b string", bad="keep", split_bytes=100).collect()
    assert len(rows) == 240 and len({(r["file"], r["line"]) for r in rows}) == 240
    for r in rows:
        raw = open(r["file"], "rb").read()[r["start"] : r["end"]].decode()
        assert raw == lines[r["line"]]
        if r["line"] in (7, 50, 51, 120):
            assert r["a"] is None and f"line {r['line']} of" in r["error"] and f"bytes {r['start']} to {r['end']}" in r["error"]
        else:
            assert (r["a"], r["b"], r["error"]) == (r["line"], "é" * (r["line"] % 5), None)
    assert jsonl.read_json_lines(spark, path, "a long, b string", bad="drop").count() == 235
    with pytest.raises(PySparkException, match="line 7 of"):
        jsonl.read_json_lines(spark, path, "a long, b string").collect()
    with pytest.raises(ValueError):
        jsonl.read_json_lines(spark, path, "a long", bad="skip")


def test_recipes_are_seeded_and_free_of_order(spark):
    ids = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "id string")
    recipe = {"chain": R.markov_chain(0.3, 0.6), "u": R.uniform(), "n": R.gaussian(2.0), "level": R.change_points(0.1, 1.0), "walk": R.cumulated(R.ref("n")), "y": R.ref("chain") * R.ref("u") + R.lag(R.ref("u"), 1) - 1, "few": R.binary(0.25), "own": R.per_series(2.0, 3.0)}
    one = {(r["id"], r["step"]): r for r in R.generate(ids, "id", 300, recipe, seed=5).collect()}
    two = {(r["id"], r["step"]): r for r in R.generate(ids.union(spark.createDataFrame([("z",)], "id string")).repartition(7), "id", 300, recipe, seed=5).collect()}
    assert len(one) == 600 and all(two[k] == v for k, v in one.items())
    assert R.generate(ids, "id", 300, {"u": R.uniform()}, seed=6).where("id = 'x' and step = 0").first()["u"] != one["x", 0]["u"]
    for i in "xy":
        state, walk = 0, 0.0
        u = {r["step"]: r["u"] for r in R.generate(ids, "id", 300, {"chain/0/0": R.uniform()}, seed=5).select("id", "step", F.col("`chain/0/0`").alias("u")).where(F.col("id") == i).collect()}
        for k in range(300):
            r = one[i, k]
            state = int(u[k] < 0.3) if state == 0 else int(not u[k] < 0.6)
            walk += r["n"]
            assert r["chain"] == state and r["walk"] == pytest.approx(walk) and r["y"] == pytest.approx(state * r["u"] + (one[i, k - 1]["u"] if k else 0.0) - 1)
        levels = [one[i, k]["level"] for k in range(300)]
        assert 5 < sum(a != b for a, b in zip(levels, levels[1:])) < 60 and len({one[i, k]["own"] for k in range(300)}) == 1
    assert 0.15 < np.mean([r["few"] for r in one.values()]) < 0.35 and abs(np.std([r["n"] for r in one.values()]) - 2) < 0.3
    assert R.generate(ids, "id", 0, {"u": R.uniform()}).collect() == []
    with pytest.raises(ValueError):
        R.generate(ids, "id", 5, {"a": R.ref("b"), "b": R.uniform()})


@pytest.mark.parametrize("n", [1, 4, 180, 1000])
def test_rolling_quantiles_equal_pandas(spark, n):
    rng = random.Random(n)
    rows = [(g, k, None if rng.random() < 0.1 else float(rng.randrange(30))) for g, size in (("a", 2500), ("b", 3), (None, 300)) for k in range(size)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, d int, x double")
        full = OS.rolling_quantiles(df, ["g"], ["d"], "x", {n: {"lo": 0.1, "mid": 0.5}, n + 2: {"hi": 0.95}}, min_periods=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {(r["g"], r["d"]): r for r in full}
    for g in ("a", "b", None):
        s = pd.Series([x for h, _, x in rows if h == g], dtype=float)
        for name, size, q in (("lo", n, 0.1), ("mid", n, 0.5), ("hi", n + 2, 0.95)):
            want = s.rolling(size, min_periods=min(2, size)).quantile(q) if size > 1 else s.where(s.isna() & ~s.isna())
            for k, w in enumerate(want):
                v = got[g, k][name]
                assert (v is None and np.isnan(w)) or v == pytest.approx(w), (g, k, name)
    assert OS.rolling_quantiles(df.limit(0), ["g"], ["d"], "x", {3: {"m": 0.5}}).collect() == []


def test_canonical_instances(spark):
    rows = [(g, k, float(k) if k != 2 else None, k * 10) for g, n in (("a", 7), ("b", 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, d int, y double, f int")
    got = {(r["g"], r["d"]): r for r in SP.canonical_instances(df, ["g"], "d", "y", 4, ["f"], sample=F.col("d") % 3 == 1).collect()}
    assert set(got) == {("a", 1), ("a", 4), ("b", 1)}
    assert got["a", 1]["target"] == [0, 0, 0, 1] and got["a", 1]["observed"] == [0, 0, 1, 1] and got["a", 1]["f"] == [0, 0, 0, 10]
    assert got["a", 4]["target"] == [1, 0, 3, 4] and got["a", 4]["observed"] == [1, 1, 1, 1]
    assert {(r["g"], r["d"]) for r in SP.canonical_instances(df, ["g"], "d", "y", 4, padding=False).collect()} == {("a", k) for k in range(3, 7)}
    future = spark.createDataFrame([("a", k, k * 10) for k in range(7, 12)] + [("b", 2, 20)], "g string, d int, f int")
    last = SP.canonical_instances(df, ["g"], "d", "y", 4, ["f"], future=future, tail=3).collect()
    assert [(r["g"], r["d"], r["target"], r["next_f"]) for r in last] == [("a", 6, [3, 4, 5, 6], [70, 80, 90])]
    with pytest.raises(ValueError):
        SP.canonical_instances(df, ["g"], "d", "y", 4, tail=3)


def test_flat_maps(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(7)] + [("b", 0, 1.0), ("c", 0, None), ("c", 1, 2.0), ("c", 2, 3.0)], "g string, d int, y double")
    out = flatmap.windows(df, ["g"], "d", "y", 3, 2)
    assert out.columns == ["g", "d", "value_0", "value_1", "value_2"]
    assert sorted(map(tuple, out.collect())) == [("a", 2, 0, 1, 2), ("a", 4, 2, 3, 4), ("a", 6, 4, 5, 6), ("c", 2, None, 2, 3)]
    with pytest.raises(PySparkException):
        flatmap.windows(df, ["g"], "d", "y", 0, 2).collect()
    words = flatmap.flat_map(df.where("d = 0"), lambda row: [(row["g"], k) for k in range({"a": 0, "b": 1}.get(row["g"], 3))], StructType([StructField("g", StringType()), StructField("k", LongType())]))
    assert sorted(map(tuple, words.collect())) == [("b", 0), ("c", 0), ("c", 1), ("c", 2)]


def test_spans_merge():
    assert timers.merged([(50, 50, 1), (0, 0, 1), (9, 9, 1), (20, 30, 2)], 10) == [(0, 9, 2), (20, 30, 2), (50, 50, 1)]
    assert timers.merged([(0, 0, 1), (19, 19, 1), (10, 10, 1)], 10) == [(0, 0, 1), (10, 19, 2)]
    assert timers.merged([(0, 9, 2), (10, 10, 1), (18, 18, 1)], 10) == [(0, 18, 4)]


def test_sessions_close_once_over_batches_and_drop_late_rows(spark, tmp_path):
    """Files are batches: the second links two sessions, the third is late for one user, the last moves the watermark on."""
    minute = 60_000
    batches = [
        [(1, 0), (1, 25), (2, 5), (3, 0)],
        [(1, 12), (2, 40), (3, 100)],  # 12 links 0 and 25 of user 1; the watermark is at 25 - 10
        [(1, 3), (2, 45), (3, 150)],  # the watermark is at 90: (1, 3) and (2, 45) come too late
        [(4, 400)],
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(u, (1000 + m) * minute) for u, m in rows], "user_id long, at long").select("user_id", F.timestamp_millis("at").alias("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in (tmp_path / "in" / str(k)).glob("part-*.parquet"):
            f.rename(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(tmp_path))
    out = timers.closed_sessions(stream, 15 * minute, "10 minutes").select("user_id", F.unix_millis("start").alias("s"), F.unix_millis("end").alias("e"), "n").collect()
    assert sorted((r["user_id"], r["s"] // minute - 1000, r["e"] // minute - 1000, r["n"]) for r in out) == [(1, 0, 40, 3), (2, 5, 20, 1), (2, 40, 55, 1), (3, 0, 15, 1), (3, 100, 115, 1), (3, 150, 165, 1)]
