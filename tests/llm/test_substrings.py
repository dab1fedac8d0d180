import hashlib
import random
import re

import pytest

from panelforge.llm import substrings as S


def plain(rows, window=13):
    """Removed spans and kept text of each row, by all windows of all rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    number = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for i, ws in zip(number, words):
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), n, ws in zip(rows, number, words):
        gone = {k + j for k in range(len(ws) - window + 1) if first[tuple(ws[k : k + window])] < n for j in range(window)}
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(map(str, out))


def got(spark, rows, window=13, parts=5):
    df = S.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), window=window)
    found = df.collect()
    for r in found:  # the spans say the same as the counts
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["deduped"])) for r in found)


def corpus(n, letters, seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(letters) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    texts = [" ".join(rng.choice([rng.choice(passages), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))]) for _ in range(rng.randint(0, 8))) for _ in range(n)]
    return list(zip(rng.sample(range(5 * n), n), texts))


@pytest.mark.parametrize("letters,block", [("ab", 400), ("abcdefgh", 1000), ("abcdefgh", 1 << 20), ([f"wörd{k}" for k in range(300)], 3000)])
def test_spans_against_all_windows(spark, monkeypatch, letters, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    rows = corpus(120, letters, len(letters) + block)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("window", [1, 3, 7])
def test_other_windows(spark, monkeypatch, window):
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    rows = corpus(60, [f"w{k}" for k in range(40)], window)
    assert got(spark, rows, window) == plain(rows, window)


def test_shuffled_answers(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    rows = corpus(80, "abcdefgh", 9)
    assert got(spark, rows) == plain(rows)


def test_nulls_ties_repeats_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)
    p = " ".join(f"p{k}" for k in range(20))
    rows = [(None, p), (None, p + " x"), (3, p), (3, "y " + p), (3, p), (9, None), (8, ""), (7, " \t\n"), (6, "z\v" + p.replace(" ", "\n") + " q"), (2, " ".join(f"l{k}" for k in range(30_000))), (11, " ".join(f"l{k}" for k in range(100, 29_000))), (-4, p[:-3])]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_clashing_columns_and_the_digest(spark):
    p = " ".join(f"p{k}" for k in range(15))
    names = ("block", "ids", "texts", "rows", "words_text", "own_number", "spans", "n_words", "deduped")
    df = spark.createDataFrame([(1, p, *names), (2, "a " + p, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = {r["doc_id"]: r for r in S.duplicate_spans(df).collect()}
    assert [out[2][c] for c in names[:6]] == list(names[:6]) and (out[2]["n_words"], out[2]["n_removed"], out[2]["deduped"], out[2]["text"]) == (16, 15, "a", "a " + p)
    digests = {r["doc_id"]: r for r in S.span_digests(df).collect()}
    assert digests[2]["kept_sha256"] == hashlib.sha256(b"a").hexdigest() and digests[1]["n_removed"] == 0
