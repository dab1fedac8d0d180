import hashlib
import random
import re
import time

from panelforge.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("ab.@-+_é 1234567890() ") for _ in range(rng.randint(0, 40)))
        assert P.base_spans(text) == plain(text), text
    assert P.base_spans("4111 1111 1111 1111") == [(0, 2, 19)]


TEXTS = [
    "Write to ann.b@mail.example.com or call +1 (202) 555-0173 today",
    'token = "9765fab7324201a5ddfac0becd9064abbef40be8" and 10.0.0.1',
    "card 4111-1111-1111-1111, IBAN DE89 3704 0044 0532 0130 00",
    "plain prose without anything in it",
    "", None, "x" * 60_000 + " a@b.co",
]


def test_query_columns_and_base_spans_stay(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[0]), (0, TEXTS[0])], "doc_id long, text string").withColumnRenamed("x", "y")
    rows = P.span_digests(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = (TEXTS[0] if r["doc_id"] is None else TEXTS[r["doc_id"]]) or ""
        base = plain(text)
        want = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b[1] == k for b in base) for k in range(4)]
        assert not want or set(want.split(",")) <= set(r["spans"].split(","))
    found = {r["doc_id"]: r["spans"] for r in rows}
    assert "secret:" in found[1] and "iban:" in found[2] and found[3] == ""


def test_em_finds_the_reliable_labeler():
    rng = random.Random(2)
    patterns = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = lambda right: "+" if (truth if rng.random() < right else not truth) else "-"
        key = "secret", vote(0.95) + vote(0.9) + vote(0.55) + "0" + "0" + "0"
        patterns[key] = patterns.get(key, 0) + 1
    model = P.SpanModel(patterns)
    gap = [model.reliability[1, j, 2] - model.reliability[0, j, 2] for j in range(3)]
    assert gap[0] > 0.7 and gap[1] > 0.6 and gap[2] < 0.35
    assert model.posterior["secret", "++-000"] > 0.5 > model.posterior["secret", "--+000"]


def test_the_classifier_beats_the_votes_alone():
    """Votes are weak; what the span looks like, which no vote sees, tells the truth."""
    rng = random.Random(3)
    patterns, examples, told = {}, [], []
    for k in range(3000):
        truth = rng.random() < 0.5
        key = "secret", "".join("+" if (truth if rng.random() < 0.8 else not truth) else "-" for _ in range(3))
        key = "secret", f"00{key[1]}0"
        span = "".join(rng.choice("abcdef0123456789" if truth else "xyzXYZ") for _ in range(20))
        patterns[key] = patterns.get(key, 0) + 1
        row = (*key, span, "the token ", " ends")
        (examples if k < 1500 else told).append((row, truth))
    model = P.SpanModel(patterns, [r for r, _ in examples])
    by_span = sum((model.probability(*r) >= 0.5) == y for r, y in told) / len(told)
    by_votes = sum((model.posterior[r[:2]] >= 0.5) == y for r, y in told) / len(told)
    assert by_span > by_votes + 0.05, (by_span, by_votes)


def test_long_texts_take_linear_time():
    for text in ("1" * 1_000_000, "1." * 500_000, "+1(" * 300_000, "eyJabc-" * 150_000, "a@b" * 300_000, "555 123-4567 10.0.0.1 " * 45_000):
        began = time.process_time()
        base = P.base_spans(text)
        P.candidates(text, base)
        assert time.process_time() - began < 20, text[:20]
    assert P.base_spans("10.0.0.1.2.3.4.5.6 999.1.1.1.1") == [(0, 1, 8), (9, 1, 16)]


def test_clashing_names_and_votes_of_very_long_texts(spark):
    names = ("own_text", "__text", "h", "n", "spans")
    df = spark.createDataFrame([("mail a@b.com " + "9" * 100_000, *names)], "text string, " + ", ".join(f"{c} string" for c in names))
    out = P.find_spans(df, P.train(df)).first()
    assert out["own_text"] == "own_text" and out["h"] == "h" and out["spans"][0]["kind"] == "email"


def test_mask_empty_table_and_clashing_columns(spark):
    model = P.SpanModel({})
    df = spark.createDataFrame([("mail a@b.com", 3)], "text string, spans int")
    row = P.find_spans(df, model, masked_col="masked").first()
    assert row["masked"] == "mail [EMAIL]" and row["spans"][0]["kind"] == "email"
    assert P.span_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
