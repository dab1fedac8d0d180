import random

import numpy as np
import xxhash

from panelforge.llm import simhash as S


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    n = min(3, len(words))
    hs = [xxhash.xxh64(" ".join(words[i : i + n]).encode(), seed=42).intdigest() for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain(t or "") for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return {(d, f"{fps[i]:016x}", min((x for x in ids[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)}


def result(df):
    return {tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(300)]
    rows = [(0, ""), (1, None), (2, " \t\n"), (3, "One"), (4, "one"), (5, "A b"), (6, "x" * 30000)]
    for k in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 5)):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append((len(rows), "\n".join(base).upper() if rng.random() < 0.1 else "  ".join(base)))
    return rows + rows[10:14] + [(None, "Null id here")]


def test_against_brute_force(spark):
    rows = corpus()
    assert result(S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_lists_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST", 3)
    rows = corpus()
    assert result(S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_lookup_equals_comparison():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 24, 1500) | (0x1234567 << 32)).astype(np.int64)
    free = (0, 1, 2)

    def classes(links):
        group = {int(x): int(x) for x in fps}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in links:
            group[root(max(a, b))] = root(min(a, b))
        out = {}
        for x in group:
            out.setdefault(root(x), set()).add(x)
        return {frozenset(v) for v in out.values()}

    assert classes(S.forest(fps)) == classes(S.forest_by_lookup(fps, free))


def test_nearest_similar_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fp = base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 16)))
            rows.append((len(rows), fp - (1 << 64) if fp >> 63 else fp, rng.randint(80, 120)))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(5)]  # equal fingerprints

    def before(a):
        """Of each list the members before a, in order of fingerprints and nodes, as bits and node."""
        for d, fp, size in rows:
            apart = (fp ^ a[1]) % (1 << 64)
            shared = sum(apart >> 8 * p & 255 == 0 for p in range(8))
            if (fp, d) < (a[1], a[0]) and shared >= 2 and apart.bit_count() <= 12 and min(size, a[2]) >= 0.9 * max(size, a[2]):
                yield apart.bit_count(), d

    want = {(a[0], min(before(a))[1]) for a in rows if any(before(a))}
    df = spark.createDataFrame(rows, "node long, fp long, size int").repartition(3)
    found = lambda **more: {tuple(r) for r in S.nearest_similar(df, len(rows), 0.9, **more).select("a", "b").collect()}
    assert len(want) > 100 and found() == want == found(part=500, at_once=7)
    assert S.nearest_similar(df.limit(0), 0, 0.9).collect() == []


def test_every_five_positions_hold_a_triple():
    assert all(any(set(t) <= set(f) for t in S.TRIPLES) for f in S.FIVES)


def test_empty_and_clashing_columns(spark):
    assert result(S.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == set()
    rows = spark.createDataFrame([(1, "a b c d", "x", 3)], "doc_id long, text string, fingerprint string, fp int")
    assert result(S.near_duplicates(rows)) == brute([(1, "a b c d")])
