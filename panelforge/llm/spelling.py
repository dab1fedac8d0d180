"""Spelling variants: words within one edit of each other, by an even-partition pigeonhole join.

A word of length l is cut into two halves. One edit leaves one half whole, so a
near word of l or l + 1 letters has that half at the same place, or, behind an
inserted letter, one place further. Words are indexed by their halves, probed by
the substrings of words of equal length and of words that are one longer, and candidates
are verified.

A list of a half that many words share would pair all of them. Lists of over
``LIST`` entries are cut by the same rule instead: the part that still may hold
the edit is halved again and the key grows by the half that must agree, until
lists are short or one place is left, where the alphabet bounds them.
So no list is dropped and none meets in one task before it is short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import crc32_sql, maybe_broadcast, small_batches, text_or_empty, written

MIN_LENGTH, MIN_COUNT = 5, 3
#: A word takes the form of a near word that occurs this many times as often.
FORM_TIMES = 2
#: Entries of a list; longer ones are cut.
LIST = 32
#: Distinct words that a task counts before it passes them on, and letters of them.
HELD, HELD_LETTERS = 1 << 18, 1 << 24
#: What a word is made of, and the share of runs that lose a letter.
WORD, DAMAGE = re.compile(r"[A-Za-zÀ-ÿ]+"), 97


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, damage: int = 0) -> DataFrame:
    """word, n: how often each word of at least ``min_length`` letters occurs.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. With ``damage`` d, a run whose crc32 (of its
    document's id, a colon and the run) is divisible by d loses the letter at that number modulo its length: misspellings to group.
    Null texts have no words; a null id counts as the text ``null``. Texts are read whole, and a task's counts are passed on when they
    reach a bound, so very long texts need no more memory than their own words.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        letters = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                prefix = crc32(f"{i}:".encode())
                for w, n in Counter(WORD.findall(text.lower().decode())).items():
                    if len(w) < min_length:
                        continue
                    if damage and (h := crc32(w.encode(), prefix)) % damage == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < min_length:
                            continue
                    letters += len(w)
                    held[w] += n
            if len(held) > HELD or letters > HELD_LETTERS:
                yield out()
                held.clear()
                letters = 0
        if held:
            yield out()

    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), text_or_empty(text_col).cast("binary").alias("t"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _key(longer: Column) -> Column:
    """Of a word's letters outside [s, e), and of s, e and the shorter word's length; a longer word has one letter more in between."""
    return F.xxhash64("l", "s", "e", F.expr("substring(word, 1, s)"), F.substring("word", F.col("e") + 1 + longer, F.length("word")))


def _halved(entries: DataFrame) -> DataFrame:
    """The two keys of each entry one step further: the first half agrees, or the second."""
    half = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
    out = entries.select("word", "n", "longer", "l", F.explode(F.array(F.struct(half.alias("s"), F.col("e").alias("e")), F.struct(F.col("s").alias("s"), half.alias("e")))).alias("x"))
    return out.select("word", "n", "longer", "l", "x.s", "x.e").withColumn("key", _key(F.col("longer")))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every two words that differ by one inserted, deleted or replaced letter, both ways.

    ``words`` has each word once, with its count. Words of any length are compared; an empty table gives none.
    """
    length = F.length("word")
    start = lambda longer: words.select("word", "n", F.lit(longer).alias("longer"), (length - longer).alias("l"), F.lit(0).alias("s"), (length - longer).alias("e")).where("l > 0")
    # halves of one place can't be cut: the shortest words start as they are
    level, found = start(0).unionByName(start(1)), []
    level = level.where("l > 1").transform(_halved).unionByName(level.where("l = 1").withColumn("key", _key(F.col("longer"))))
    while True:
        level = written(level, "segments")
        hot = written(level.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("e") - F.col("s")).alias("open")).where((F.col("c") > LIST) & (F.col("open") > 1)).select("key"), "long-lists")
        n_hot = hot.count()
        hot = maybe_broadcast(hot, n_hot, 64)
        short = level.join(hot, "key", "left_anti") if n_hot else level
        a = short.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = short.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        pairs = a.join(b, "key").where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(written(pairs.select("a", "a_n", "b", "b_n").distinct(), "near-words"))
        if not n_hot:
            break
        level = level.join(hot, "key", "left_semi")
        level = level.where("e - s > 1").transform(_halved).unionByName(level.where("e - s <= 1").select("word", "n", "longer", "l", "s", "e", "key"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct()
    return pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) ends, by doubling: each round a word takes its root's root."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        now = new.select("word", "root")


def variant_groups(counts: DataFrame, min_count: int = MIN_COUNT, times: float = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words that occur ``min_count`` times at least.

    A word's form is its most frequent near word (ties: the smallest by code points), if that occurs ``times`` times as
    often; a root is where forms end (counts grow along them, so they have no cycles). Null words and counts are left out, repeated words are summed.
    """
    words = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    words = written(words, "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    judged = judged.withColumn("has", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    judged = written(judged.select("word", F.when(F.col("has"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "forms")
    return judged.join(roots(judged.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The groups of a table's words, some of whose runs have lost a letter by a fixed rule."""
    return variant_groups(word_counts(docs, damage=DAMAGE))


_OCTETS = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
#: Near words by words that lack one letter, or have one masked.
ORACLE = f"""
WITH RECURSIVE docs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM docs GROUP BY ALL),
hashed AS (SELECT *, {crc32_sql(_OCTETS.format("doc_id || ':' || w"))} AS h FROM runs WHERE length(w) >= 5),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed),
words AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
lacking AS (SELECT DISTINCT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)),
masked AS (SELECT word, n, substr(word, 1, k - 1) || '_' || substr(word, k + 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM lacking a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM lacking a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.at AND e.form IS NULL
"""
