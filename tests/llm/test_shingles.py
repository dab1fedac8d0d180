import random

import corpus_pipeline as C
from panelforge.llm import shingles as S


def sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, t=0.8):
    """Of each row the position of its component's first row: ids in order, null ones last."""
    found, group = [sets(x or "") for _, x in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if len(a & b) >= t * len(a | b) - 1e-9:
                group[root(i)] = root(j)
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        first.setdefault(root(i), i)
    return [first[root(i)] for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    rows = [(0, ""), (1, None), (2, " \t\n"), (3, "One"), (4, "one"), (5, "A b"), (6, "x " * 3000)]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 200))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 6)):  # each from the one before or from the first one: chains and stars
            words = list(base)
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            base = words if rng.random() < 0.5 else base
            rows.append((len(rows), "\n".join(words).upper() if rng.random() < 0.1 else "  ".join(words)))
    return rows + rows[10:14] + [(None, rows[20][1]), (None, "null id here that is like no other one")]


def result(df):
    return sorted(map(str, df.select("doc_id", "component_id").collect()))


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 50)
    for seed in (1, 2, 3):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = spark.createDataFrame([(d, rows[k][0]) for (d, _), k in zip(rows, brute(rows))], "doc_id long, component_id long")
        assert result(S.near_duplicates(df, cells=64 if seed == 1 else S.CELLS)) == result(want)


def test_links_come_from_simhash_and_the_join_gets_the_rest(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = [*words[:150], "other", *words[151:]]
        rows += [(k, " ".join(words)), (100 + k, " ".join(copy))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    linked, joined, by_simhash, candidates = [], [], S.by_simhash, S.candidates

    def seen(counts, f):
        def run(*args):
            out = f(*args)
            counts.append(out.count())
            return out

        return run

    monkeypatch.setattr(S, "by_simhash", seen(linked, by_simhash))
    monkeypatch.setattr(S, "candidates", seen(joined, candidates))
    kept = lambda: sorted(r["doc_id"] for r in C.near_duplicate_stage(spark, docs, "").collect())
    assert kept() == list(range(20)) and linked == [20] and joined == [0]
    # without any link by fingerprint the join gives all of them
    monkeypatch.setattr(S, "by_simhash", lambda *args: by_simhash(*args).limit(0))
    assert kept() == list(range(20)) and joined[1] > 0


def test_empty_table(spark):
    assert result(S.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_stage_removes_copies_of_five_words_and_eight_tenths(spark):
    rng = random.Random(4)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        copy = list(words)
        copy[40], copy[80] = "other", "another"  # 106 of 126 shingles shared
        rows += [(k, " ".join(words)), (100 + k, " ".join(copy))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in C.near_duplicate_stage(spark, docs, "").collect()) == list(range(30))


def test_one_row_of_each_component_stays_with_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"k{k}w{i}" for i in range(60))
    near = lambda k: text(k) + " tail"
    rows = [(1, text(1)), (5, near(1)), (5, text(5))]  # only one text of id 5 has a copy
    rows += [(7, text(7)), (7, near(7)), (8, text(8)), (8, text(8))]  # copies under one id, repeated rows
    rows += [(None, text(9)), (None, near(9)), (None, text(9)), (None, text(1)), (None, text(10))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"].split(" ")[0]) for r in C.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, "k1w0"), (5, "k5w0"), (7, "k7w0"), (8, "k8w0"), (None, "k9w0"), (None, "k10w0")]))
