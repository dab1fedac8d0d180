import random

import corpus_pipeline as C
from panelforge.llm import pii, quality
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_shingles import brute as brute_near


def write(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    rows = []
    for k in range(60):
        text = ".\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(2, 8))) + "."
        if k % 7 == 0:
            text += f"\nwrite to user{k}@mail.example.com about it today please and soon"
        if k % 9 == 0:
            text = "Home | About | News | Shop\n" + text + "\nAll rights reserved."
        rows.append((k, text))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    rows += [(200 + k, rows[k][1].replace("w1 ", "w2 ")) for k in range(20, 26)]
    rows += [(300, "too short"), (301, None), (302, ""), (303, "SHOUT!! NOW!! AND!! ON!! " * 30), (None, rows[30][1] + "\nlast line of no id here")]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(write(spark, corpus(), tmp_path) + "/documents.parquet")
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    key = lambda r: (r[0] is not None, r)
    before = pairs(docs)
    first = pairs(C.quality_stage(spark, docs, ""))
    assert sorted(first, key=key) == sorted(((d, a["cleaned"]) for d, t in before if (a := quality.assess(t or "", C.RULES))["kept"]), key=key)
    assert {301, 302, 303}.isdisjoint({d for d, _ in first}) and 300 in {d for d, _ in first} and not any("Home |" in t for _, t in first)
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], docs.schema)
    second = pairs(C.line_stage(spark, frame(first), ""))
    assert sorted((str(d), t) for d, t in second) == [(d, t) for d, t in brute_lines(first) if t.strip()]
    near = first + [(900, max(first, key=lambda r: len(r[1]))[1] + " tail")]  # near copies that line dedup would have taken
    third = pairs(C.near_duplicate_stage(spark, frame(near), ""))
    assert {d for d, _ in third} == {near[i][0] for i, first_row in enumerate(brute_near(near)) if first_row == i}
    assert len({d for d, _ in near}) > len(third)
    fourth = C.personal_data_stage(spark, frame(second), "")
    assert fourth.columns == list(C.COLUMNS) and not any(pii.base_spans(r["text"]) or r["n_chars"] != len(r["text"]) for r in fourth.collect())
    assert fourth.where("text like '%[EMAIL]%'").count() == sum("@" in t for _, t in second)
    fifth = C.packing_stage(spark, fourth, "")
    assert {r["doc_id"] for r in fifth.collect()} == {d for d, _ in second}


def test_run_and_empty_table(spark, tmp_path):
    whole = C.run(spark, write(spark, corpus(), tmp_path / "a"))
    assert whole.count() > 30 and "batch" in whole.columns
    assert C.run(spark, write(spark, [], tmp_path / "b")).collect() == []
