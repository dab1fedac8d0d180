import random
import re
import zlib
from collections import Counter

import pytest

from panelforge.llm import spelling as S


def counts(rows, damage=97):
    out = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if damage and h % damage == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words, least=3):
    words = {w: n for w, n in words.items() if n >= least}
    out, form = [], {}
    for w, n in words.items():
        own = [(-words[x], x) for x in words if near(w, x)]
        best = min(own, default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
        out.append((w, n, len(own)))
    rows = []
    for w, n, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, k, words[form[w]] if form[w] else None))
    return sorted(map(str, rows))


def show(df):
    return sorted(str(tuple(r)) for r in df.collect())


def words_of(n, letters, seed, longest=9):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)}
    for w in list(words)[: n // 3]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + "é" + w[k:], w[:k] + "z" + w[k + 1 :]} - {""}
    return {w: rng.choice([2, 3, 4, 9, 9, 30, 200]) for w in words}


@pytest.mark.parametrize("letters,n,limit", [("ab", 300, 32), ("abcde", 500, 2), ("abcdefghijklmnopqrst", 400, 32), ("aé", 200, 1)])
def test_groups_against_all_pairs(spark, monkeypatch, letters, n, limit):
    monkeypatch.setattr(S, "LIST", limit)  # nearly every list is cut, down to single places
    words = words_of(n, letters, n + limit)
    assert show(S.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


def test_texts_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 5)
    rng = random.Random(5)
    base = ["Straße", "grünes", "hello", "hallo", "hellos", "worlds", "wörlds", "abcde", "abcdf", "×××÷÷", "Ünder"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ",", "1", "-", "s"]) for _ in range(60))) for i in range(80)] + [(None, "hello HELLO"), (3, None), (4, ""), (4, "hello " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in S.word_counts(df, damage=7).collect()} == counts(rows, 7)
    assert show(S.spelling_variants(df)) == plain(counts(rows))


def test_long_words_chains_ties_and_empty_tables(spark):
    long = "x" * 100_000
    words = {long: 9, long + "y": 3, "abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "tiess": 3, "tiesa": 6, "tiesb": 6, "alone": 5}
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in S.variant_groups(spark.createDataFrame([*words.items(), (None, 9), ("alone", None)], "word string, n long")).collect()}
    assert got["abcde"] == ("abcdef", "abcdefghi", 1) and got["tiess"][0] == "tiesa" and got["alone"] == (None, "alone", 0) and got[long + "y"][0] == long
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(nothing).collect() == []
    extra = spark.createDataFrame([(1, "worte " * 3, "w", 9)], "doc_id long, text string, word string, n int")
    assert show(S.spelling_variants(extra)) == plain({"worte": 3})
