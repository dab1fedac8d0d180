import hashlib
import random

import numpy as np
import pytest

from panelforge.llm import chunking as C


def test_gear_hash_is_the_rolling_one():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    h, out = 0, []
    for b in data:
        h = (h << 1) + int(C.GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    assert C.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == out


def test_chunks_cover_a_text_and_keep_their_sizes(monkeypatch):
    data = random.Random(2).randbytes(40_000)
    ends = C.chunk_ends(len(data), *C.candidate_cuts(data))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= C.MOST and sizes[:-1].min() >= C.LEAST
    monkeypatch.setattr(C, "BLOCK", 1000)
    assert C.chunk_ends(len(data), *C.candidate_cuts(data)) == ends


def test_an_insertion_changes_few_chunks():
    words = [f"wort{random.Random(k).randrange(10**6)}" for k in range(800)]
    a, b = " ".join(words), " ".join(words[:300] + ["neu"] + words[300:])
    assert C.likeness(C.fingerprint(a), C.fingerprint(b)) > 0.9
    assert C.likeness(C.fingerprint(a), C.fingerprint(a[::-1])) == 0
    assert C.likeness({}, {}) == 1 and C.likeness({}, {1: 2}) == 0
    assert C.containment(C.fingerprint(a[:3000]), C.fingerprint(a)) > 0.9
    assert C.read(C.shown(C.fingerprint(a))) == C.fingerprint(a)


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half] if half else t
        a, b, c = map(C.fingerprint, (t, new, nxt))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), C.shown(a), C.shown(b), C.likeness(a, b), C.likeness(a, c)))
    return out


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_against_brute_force(spark, range_rows):
    rng = random.Random(3)
    rows = [(k * 7 % 61, "".join(rng.choice("abcé \n😀") for _ in range(rng.choice([0, 1, 2, 50, 900])))) for k in range(40)]
    rows += [(None, "no id"), (1000, None), (1001, "a" * 20_000), (5, "twice"), (5, "twice"), (5, "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in C.edited_fingerprints(df, range_rows=range_rows).collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_single_and_clashing(spark):
    assert C.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = C.edited_fingerprints(spark.createDataFrame([(1, "abcd", "x")], "doc_id long, text string, fingerprint string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    assert C.fingerprints(spark.createDataFrame([("a", "b")], "fingerprint string, text string")).columns == ["text", "fingerprint"]
