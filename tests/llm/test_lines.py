import random

from panelforge.llm import lines as L


def brute(rows, t=0.8, least=3):
    """(id, text) -> left text; lines in order of id and number, first of similar ones stays."""
    docs = sorted({(L.FIRST_ID if d is None else d, x or "") for d, x in rows}, key=lambda r: r[0])
    seen, gone = [], set()
    for d, text in docs:
        for k, line in enumerate(text.split("\n")):
            words = set(L.tokens(line))
            if len(L.tokens(line)) < least:
                continue
            if any(len(words & w) >= t * len(words | w) - 1e-9 for w in seen):
                gone.add((d, text, k))
            seen.append(words)
    left = lambda d, x: "\n".join(v for k, v in enumerate(x.split("\n")) if (L.FIRST_ID if d is None else d, x, k) not in gone)
    return sorted((str(d), left(d, x or "")) for d, x in rows)


def corpus(seed, n_docs=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["Été", "the", "of"]
    stock = [[rng.choice(vocab) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    rows = [(None, "no id here at all\nsecond line of it"), (0, None), (1, ""), (2, "\n\n"), (3, "a b c d\na b c d e\na b c d e f\nA  B c\tD"), (4, "x y z " * 3000)]
    for k in range(n_docs):
        out = []
        for _ in range(rng.randint(1, 6)):
            words = list(rng.choice(stock))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
        rows.append((k + 10, "\n".join(out)))
    return rows


def got(df, **kw):
    return sorted((str(r["doc_id"]), r["deduped"]) for r in L.dedup_lines(df, **kw).collect())


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cells=64) == brute(rows)


def test_second_round_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRS", 5)
    monkeypatch.setattr(L, "ROWS", 7)
    rng = random.Random(7)
    base = [f"t{i}" for i in range(20)]
    # many lines that share prefixes but are just below or above the threshold
    rows = [(k, " ".join(rng.sample(base, 16) + [f"u{k % 9}", f"v{k % 5}"])) for k in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(5, "one two three\nfour five six"), (5, "one two three\nfour five six"), (6, "one two three\nseven eight nine")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    clash = ("d", "th", "line", "lines", "gone_d", "gone_lines", "deduped", "Words")
    df = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *(c for c in clash if c != "deduped"), "deduped", "n_lines", "n_removed", "removed_lines"]
    assert got(df) == brute(rows) and out.first()["th"] == "th"
    assert sorted(r["n_removed"] for r in L.line_digests(df).collect()) == [0, 0, 1]


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)
    monkeypatch.setattr(L, "HELD", 20)
    monkeypatch.setattr(L, "PAIRS", 5)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(14)]
    # one group of similar lines that all share their tokens, and others that only look alike
    rows = [(k, " ".join(rng.sample(base, rng.randint(7, 12)) + [f"u{k % 4}"] * (k % 3 > 0))) for k in range(70)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_hashes_depend_on_the_token_only(monkeypatch):
    import numpy as np

    monkeypatch.setattr(L, "BLOCK", 16)
    texts = ["Ab cd", "", "ab\n  ef " + "g" * 50, "x ab", "cd"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(x.encode()) for x in texts)])
    starts, h = L.Hasher().tokens(np.frombuffer(data, np.uint8), offsets)
    words = [w for x in texts for w in L.tokens(x)]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))
    assert starts[:2].tolist() == [0, 3]


def test_tokens_of_a_line_that_share_their_posting_key(spark):
    import numpy as np

    words = [f"t{i}" for i in range(400_000)]
    data = " ".join(words).encode()
    _, h = L.Hasher().tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    order = np.argsort(h)
    k = int(np.flatnonzero(h[order][1:] >> np.uint64(32) == h[order][:-1] >> np.uint64(32))[0])
    one, two = words[order[k]], words[order[k + 1]]
    common = [f"c{i}" for i in range(10)]
    rows = [(1, " ".join([one, two, *common])), (2, f"{one} p q"), (3, f"{two} r s"), *((10 + k, "\n".join(f"{c} x{k}{c} y{k}{c}" for c in common)) for k in range(5))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_query_joins_lines_of_one_and_two_words(spark):
    rows = [(1, "One\ntwo words\n\nthree words here"), (2, "one\n\nwords TWO\nother"), (3, "two words more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["removed_lines"] for r in L.line_digests(docs).collect()} == {1: "", 2: "0,2", 3: ""}
    assert got(docs, min_tokens=L.ALL_LINES) == brute(rows, least=1)
