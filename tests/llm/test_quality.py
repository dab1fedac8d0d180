import random
import re

from panelforge.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base figures, word by word."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            covered |= {k + j for k in places for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def texts():
    rng = random.Random(9)
    out = [None, "", " \t\n\x0b\x0c\r", "one", "a b c a b c", "\u00a0 \u2003 \x1c", "é # $$\nx\nx\n x", "w " * 40_000, "x" * 200_000]
    for _ in range(120):
        vocab = [rng.choice(["a", "Bé", "c|", "#d", "e!", "\u00a0f"]) + str(k) for k in range(rng.randint(3, 60))]
        out.append("".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 120))))
    return out


def test_figures_against_plain_words(spark):
    rows = list(enumerate(texts()))
    rows += [(None, "no id " * 30), rows[20], rows[20]]
    got = Q.quality_figures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    show = lambda r: (str(r[0]), *r[1:])
    assert sorted(show(r[:7]) for r in got) == sorted(show((d, *plain(t))) for d, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_lines_that_fail_go_and_documents_that_lose_too_much():
    good = "\n".join(" ".join(f"word{k}x{j}" for j in range(12)) for k in range(8))
    junk = ["Home | About | News | Shop", "All rights reserved.", "Accept all cookies to go on", "BUY IT NOW OR NEVER", "wow! such! bargain! today!", "aa### bb*** cc%%% dd&&&"]
    for line in junk:
        out = Q.assess(f"{good}\n{line}")
        assert out["kept"] and out["cleaned"] == good and out["n_lines_removed"] == 1, line
    assert not Q.assess(f"{good}\n" + "\n".join(f"{line} {k}" if "|" not in line else line for line in junk[3:] * 3 for k in range(9)))["kept"]
    assert Q.assess(good, Q.Rules(min_words=1))["kept"] and Q.assess("a short but clean text", Q.Rules(min_words=1))["kept"] and not Q.assess("", Q.Rules(min_words=1))["kept"]


def test_empty_table_and_clashing_columns(spark):
    assert Q.quality_figures(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b", "x", "y", 5)], "doc_id long, text string, own_text string, __text string, kept int")
    row = Q.quality_rules(df).first()
    assert row["own_text"] == "x" and row["__text"] == "y" and row["kept"] is False and row["text"] == row["cleaned"] == "a b"
