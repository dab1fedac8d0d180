import hashlib
import itertools
import random

import public_tokenizers as tokens
import pytest
from tokenizers import Tokenizer

from panelforge.llm import bpe, edits, packing
from panelforge.llm.queries import RANKS, TOKENIZER


@pytest.fixture(scope="module")
def encoder():
    with open(TOKENIZER, "rb") as f:
        return bpe.ByteBPE(f.read(), 50)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))


ODD = ["a\t\n\tb", " x  y \n\n z", "<|endoftext|>hi <|endoftext|> <|endoftext|>", "a\x1cb \x1d c", "日本語 テスト １２３ ½", "a" * 3000 + "b" * 700, "", "\n", "\r\n\r\n", "don't I'll 'S 've", "🙂🙂 é́", "x\x85y   z", "thandre " * 50]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\tab1,.'séñ\xa0日rl<|") for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoding_equals_the_library(encoder, library):
    for t in ODD + texts(3000):
        ids = encoder.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    encoder.warm(ODD)
    for t in ODD:
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_decoding_of_broken_bytes(encoder, library):
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.randrange(50_257) for _ in range(6)]
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merging_by_matrix_and_heap_equals_the_list(encoder):
    words = [w.encode() for t in ODD + texts(500, 9) for w in t.split() if 0 < len(w.encode()) <= bpe.WIDTHS[-1]]
    assert encoder.merge_many(words) == [tuple(encoder.merge(w)) for w in words]
    assert all(encoder._merge_long(w) == encoder.merge(w) for w in words)


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(1, "hi there", 5), (None, None, 6)], "doc_id long, text string, ids int")
    back = bpe.bpe_decode(bpe.bpe_encode(df, TOKENIZER), TOKENIZER)
    assert back.columns == ["doc_id", "text", "ids", "decoded"] and [r["decoded"] for r in back.collect()] == ["hi there", ""]
    row = bpe.bpe_digests(df, TOKENIZER).where("doc_id is null").first()
    assert row["n_tokens"] == 0 and row["ids_sha256"] == row["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_edited_counts_equal_full_encoding(encoder, monkeypatch):
    monkeypatch.setattr(edits, "BLOCK", 3)
    rng = random.Random(5)
    alphabet = " \n\tab1,.'serltv \xa0日"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        tree = edits.TokenTree(encoder, text)
        for _ in range(4):
            a = rng.randint(0, len(text) + 2)
            b, new = a + rng.choice([0, 1, 2, 5, 40]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 9])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.n_tokens == len(encoder.encode_plain(text))
            assert tree.sums.totals()[0] == len(text)


def test_an_edit_encodes_a_small_region(encoder):
    tree = edits.TokenTree(encoder, "some words here " * 2000)
    tree.edit(16_000, 16_010, "other")
    assert tree.encoded < 60


def test_revised_counts(spark, encoder):
    rows = [(1, "a few words and then some more of them " * 9), (2, ""), (None, None), (3, "x")]
    got = edits.revised_counts(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    for r, (_, text) in zip(got, rows):
        t = text or ""
        n = len(t)
        for a, b, new in ((n // 4, n // 4, " [revised] "), (n // 2, n // 2 + 24, ""), (max(n - 12, 0), n, "on 2024-01-31.")):
            t = t[:a] + new + t[b:]
        assert r["n_tokens"] == len(encoder.encode_plain(text or "")) and r["n_tokens_edited"] == len(encoder.encode_plain(t))
    assert edits.revised_counts(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []


def test_edits_of_long_texts_repeats_and_clashing_columns(spark, encoder):
    long = "many words, and numbers like 1234 and so on. " * 6000
    cut = [(5, 9, "X"), (200_000, 200_050, None), (len(long) - 3, len(long) + 99, " end")]
    rows = [(1, long, cut, "a", "b"), (2, "same text", [(0, 4, "this")], "a", "b"), (2, "same text", [(0, 4, "this")], "a", "b"), (3, "no edits", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>, n_tokens string, own_text string")
    got = edits.count_edited(df, TOKENIZER)
    assert got.columns == ["doc_id", "own_text", "n_chars", "n_tokens", "n_tokens_edited", "n_encoded"]
    out = sorted(map(tuple, got.collect()), key=lambda r: r[0])
    edited = long
    for a, b, new in cut:
        edited = edited[: min(a, len(edited))] + (new or "") + edited[min(b, len(edited)) :]
    assert out[0][3:5] == (len(encoder.encode_plain(long)), len(encoder.encode_plain(edited))) and out[0][5] < 5000
    assert out[1] == out[2] and out[1][4] == len(encoder.encode_plain("this text")) and out[3][1] is None and out[3][3] == out[3][4]


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        h = {rng.randint(0, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        k = rng.randint(1, 4)
        low = min(packing.padding(h, [*c, max(h)]) for n in range(k) for c in itertools.combinations(sorted(h)[:-1], min(n, len(h) - 1)))
        bounds = packing.best_bounds(h, k)
        assert len(bounds) <= k and bounds[-1] == max(h) and packing.padding(h, bounds) == low


def test_counts_equal_the_encoder(encoder, monkeypatch):
    with open(RANKS, "rb") as f:
        counter = packing.Counter(f.read())
    for t in ODD + texts(1000):
        assert counter.count(t) == len(encoder.encode_plain(t))
    monkeypatch.setattr(packing, "LONG_TEXT", 10)
    for t in ODD:
        assert counter.count(t) == len(encoder.encode_plain(t))


def test_packing_keeps_every_token_within_the_budget(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 1, 7, 64, 65, 300, 1000])) for k in range(500)] + [(None, 5), (7, None), (3, 64), (3, 64)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.pack(df, sequence=64, n_buckets=3, budget=200, slice_rows=100).toPandas()
    assert out["n_tokens"].sum() == sum(n or 0 for _, n in rows) and len(out) == sum(max(1, -(-(n or 0) // 64)) for _, n in rows)
    assert (out["n_tokens"] <= out["width"]).all() and out["width"].nunique() <= 3
    batches = out.groupby("batch").agg(n=("slot", "size"), top=("slot", "max"), width=("width", "first"), kinds=("bucket", "nunique"))
    assert (batches["n"] == batches["top"] + 1).all() and (batches["kinds"] == 1).all()
    assert ((batches["n"] * batches["width"] <= 200) | (batches["n"] == 1)).all() or (batches["width"] <= 1).any()
    histogram = out["n_tokens"].value_counts().to_dict()
    assert (out["width"] - out["n_tokens"]).sum() == packing.padding(histogram, packing.best_bounds(histogram, 3))
    assert packing.pack(df.limit(0)).collect() == []


def test_packing_of_documents(spark):
    df = spark.createDataFrame([(1, "one two", 9), (2, None, 9)], "doc_id long, text string, n_tokens int")
    assert {(r["doc_id"], r["n_tokens"]) for r in packing.pack_documents(df, RANKS).collect()} == {(1, 2), (2, 0)}
