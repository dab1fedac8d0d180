import random
import time

from panelforge.llm import toxicity as T


def test_fold_undoes_homoglyphs_digits_and_signs():
    assert T.fold("1D10T") == T.fold("idiot") == T.fold("іdіоt") == T.fold("ìd​îot")
    assert T.fold("$tup!d") == T.fold("stupid") and T.fold("Lóser") == T.fold("loser")
    assert T.fold("x%%% y$$$ !!") == "x%%% y$$$ !!"


def test_hits_are_words_or_beginnings_outside_exceptions():
    m = T.Model({T.fold("trash") + " ": 2.0, T.fold("moron"): 1.0})
    found = lambda s: [w for _, _, w in m.hits(T.fold(s))]
    assert found("Trash, and trashy; MORONS! oxymoron tr4sh") == [2.0, 1.0, 2.0]
    assert found("a trash can for the trash") == [2.0]
    assert m.score("") == m.score("nothing here") < 0.5


def corpus():
    rng = random.Random(4)
    rows, labels = [(900, None), (901, ""), (902, "x" * 50_000)], [(900, 0), (901, 0), (None, 1), (5000, 1), (7, 0), (7, 0)]
    for k in range(600):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 150))]
        if bad := k % 5 == 0:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["vilex", "grubon", "snaffed"]) + rng.choice(["", "e", "s"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels[:6] + [x for x in labels[6:] if x[0] != 7]


def test_held_out_accuracy_and_whole_result(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in T.toxicity(docs, marks).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    told = [out[i]["predicted"] == y for i, y in labels if i in out and out[i]["held_out"]]
    assert len(told) > 60 and sum(told) / len(told) > 0.97
    assert out[900]["score"] == out[901]["score"] < 0.5


def test_empty_tables_and_one_kind_of_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in T.toxicity(docs, none).collect()] == [0, 0]
    assert T.toxicity(docs.limit(0), none).collect() == []
    assert [r["predicted"] for r in T.toxicity(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).collect()] == [0, 0]


def plain_hits(m, folded):
    """Every entry at every place, then of those at one place the longest, then those inside phrases left out."""
    inside = [(i, i + len(p)) for p in map(T.fold, m.exceptions) for i in range(len(folded)) if folded.startswith(p, i) and not (i and folded[i - 1].isalnum())]
    out = []
    for i in range(len(folded)):
        if i and folded[i - 1].isalnum():
            continue
        at = [e for e in m.weights if folded.startswith(e.rstrip(" "), i) and not (e.endswith(" ") and folded[i + len(e) - 1 : i + len(e)].isalnum())]
        if at:
            e = max(at, key=lambda e: len(e.rstrip(" ")))
            if not any(a <= i and i + len(e.rstrip(" ")) <= b for a, b in inside):
                out.append((i, e.rstrip(" "), m.weights[e]))
    return out


def test_hits_against_a_plain_scan():
    rng = random.Random(6)
    m = T.Model({"tra": 1.0, T.fold("trash") + " ": 2.0, "ab": 0.5, "abba ": 3.0, "can": 0.25}, ("trash can", "abba ab", "can can"))
    for _ in range(3000):
        text = "".join(rng.choice(["trash", "tra", " ", " ", "can", "ab", "ba", "abba", "!", "x", "TR4SH", "\u0430b"]) for _ in range(rng.randint(0, 14)))
        folded = T.fold(text)
        assert sorted(m.hits(folded)) == plain_hits(m, folded), text


def test_many_phrases_take_linear_time():
    m = T.Model({T.fold("trash") + " ": 2.0})
    folded = T.fold("trash can trash " * 50_000)
    began = time.process_time()
    assert len(m.hits(folded)) == 50_000 and time.process_time() - began < 10


def test_labels_that_disagree_and_clashing_columns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + rows[10:14], "doc_id long, text string")
    toxic = [i for i, y in labels if y][3:9]
    odd = labels + [(i, 0) for i in toxic] * 2
    one, two = (spark.createDataFrame(x, "doc_id long, toxic int") for x in (odd, odd[::-1]))
    assert T.train(docs, one) == T.train(docs, two) == T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    df = spark.createDataFrame([("fine", "a", "b", "c")], "text string, own_text string, __text string, score string")
    row = T.score_texts(df, T.Model({})).first()
    assert (row["own_text"], row["__text"]) == ("a", "b") and 0 <= row["score"] <= 1
