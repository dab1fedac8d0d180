import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelforge.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    """The root, and the siblings (left, right) of each node up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            p.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        nodes, at = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, over in zip(order, tops):
        for (_, _, own, r), path in zip(sorted(groups[s]), trees[s][1]):
            path, given = path + over, own
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                given = leaf(r[0], r[3], r[2], r[4], r[1].replace("\n", ""))
            h = given
            for left, right in path:
                h = digest(left, h, right)
            out.append((r[0], own, trees[s][0], root, digest(*(a + b for a, b in path)), h, h == root))
    return sorted(map(str, out))


def got(spark, rows):
    return sorted(str(tuple(r)) for r in M.tampered_manifest(spark.createDataFrame(rows, SCHEMA)).collect())


def docs(n, seed=3):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [(i, pick(None, "", "a", "b\nc", "\n", "é\n" * 20), pick(None, "en"), pick(*["hot"] * 6, "src1", "src10", "ä", "", None), pick(None, 3)) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28, 200])
def test_proofs_against_plain_trees(spark, n):
    rows = docs(n)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds_of_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)  # blocks of three or nine: up to four rounds
    rows = docs(150)
    assert got(spark, rows) == plain(rows)


def test_repeats_nulls_long_texts_and_empty_tables(spark):
    rows = [(None, "x", None, None, 1), (None, "x", None, None, 1), (5, "y\n", "en", "s", 2), (5, "y\n", "en", "s", 2), (5, "z", "en", "s", 1), (7, "long \n" * 300_000, "en", "s", None)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_columns_and_a_change_of_one_letter(spark):
    df = spark.createDataFrame(docs(50), SCHEMA).withColumns({c: F.lit("own") for c in ("pos", "n", "part", "group_key", "items", "path")})
    whole = M.manifest(df, M.leaf_digest(F.col("doc_id"), F.col("text")), keep={"pos": F.col("pos"), "items": F.col("items")})
    assert whole.columns == ["doc_id", "source", "leaf", "subroot", "root", "path", "pos", "items"]
    assert whole.where(M.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    first = whole.first()["root"]
    changed = M.manifest(df.withColumn("text", F.when(F.col("doc_id") == df.first()["doc_id"], "other").otherwise(F.col("text"))), M.leaf_digest(F.col("doc_id"), F.col("text")))
    assert changed.first()["root"] != first
    with pytest.raises(ValueError):
        M.manifest(df, M.leaf_digest(F.col("text")), keep={"root": F.col("text")})
