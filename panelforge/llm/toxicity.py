"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers letters, strips accents, maps homoglyphs of other scripts and
digits that stand for letters, and drops invisible characters. The lexicon's
entries are words and word beginnings with the log odds that they give a
document of being toxic; they are learned from labelled documents, so that any
language's insults and their inflections are found. A match inside an exception
phrase doesn't count. The sum of weights, normalised by the length, goes through
a logistic curve that is fitted on the same labelled documents.

Only the fit uses a bounded sample: at most about ``MAX_TRAIN`` labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import small_batches, text_or_empty, unused

MAX_TRAIN = 30_000
#: Lengths of the word beginnings that may become entries.
STEMS = range(3, 9)
#: An entry needs this many toxic documents, this likelihood ratio of documents, and this share of its
#: mean density (occurrences by words) in toxic documents in the sum of both kinds' densities.
LEAST_DOCS, LEAST_RATIO, LEAST_SHARE = 3, 15.0, 0.95
#: Entries are chosen while they cover so many toxic documents anew; one counts as new until it is covered ``COVER`` times.
COVER, LEAST_GAIN = 4, 3
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clownfish", "class clown", "pathetic fallacy", "loser of the match", "scumble")

#: Letters of other scripts, and digits and signs, that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
INVISIBLE = "­​‌‍⁠﻿"
#: Signs that stand for letters only where a letter follows and no other sign goes before.
SIGNS = {"$": "s", "@": "a", "!": "i", "|": "i"}
AT_SIGN = re.compile(r"(?<![^\w\s])[$@!|](?=\w)")
WORD = re.compile(r"[^\W_]+")


def fold_table() -> dict[int, str | None]:
    """Homoglyphs and digits as given; accented letters up to U+024F and full-width ones by their decomposition; l as i."""
    out: dict[int, str | None] = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base.isascii() and base.isalnum():
            out[c] = base
    out |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    out |= {ord(k): v for k, v in DIGITS.items()}
    out = {k: "".join("i" if x == "l" else DIGITS.get(x, x) for x in v) for k, v in out.items()}
    return out | {ord("l"): "i"} | dict.fromkeys(map(ord, INVISIBLE))


FOLD = fold_table()


def fold(text: str) -> str:
    text = text.lower()
    if any(map(text.__contains__, SIGNS)):
        text = AT_SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(FOLD)


def features(text: str) -> dict[str, int]:
    """Occurrences of the folded words, marked by a blank at the end, and of their beginnings."""
    out: dict[str, int] = {}
    for w, n in Counter(WORD.findall(fold(text))).items():
        out[w + " "] = n
        for k in STEMS:
            if len(w) > k:
                out[w[:k]] = out.get(w[:k], 0) + n
    return out


@dataclass
class Model:
    """Entries (folded; a blank at the end: whole words only) with weights, exception phrases and the logistic curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -1.0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    @property
    def automaton(self):
        if "_automaton" not in self.__dict__:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(entry.rstrip(" "), (entry.rstrip(" "), entry.endswith(" "), w))
            for phrase in self.exceptions:
                if (p := fold(phrase)) not in self.weights and p + " " not in self.weights:
                    a.add_word(p, (p, False, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """Start, entry and weight of each match at a word's beginning; of those at one place the longest counts."""
        if not self.weights:
            return []
        found: dict[int, tuple[str, float]] = {}
        apart: list[tuple[int, int]] = []
        for end, (entry, whole, w) in self.automaton.iter(folded):
            start = end - len(entry) + 1
            if start and folded[start - 1].isalnum() or whole and end + 1 < len(folded) and folded[end + 1].isalnum():
                continue
            if w is None:
                apart.append((start, end))
            elif start not in found or len(found[start][0]) < len(entry):
                found[start] = (entry, w)
        if not apart:
            return [(s, e, w) for s, (e, w) in found.items()]
        apart.sort()
        starts, reach = [a for a, _ in apart], list(accumulate((b for _, b in apart), max))
        # a hit lies in a phrase if one of those that begin at or before it reaches its end
        inside = lambda s, last: (k := bisect_right(starts, s)) > 0 and reach[k - 1] >= last
        return [(s, e, w) for s, (e, w) in found.items() if not inside(s, s + len(e) - 1)]

    def strength(self, text: str) -> tuple[float, float, float, float]:
        """What the curve sees: the log of the summed weights, their density, the log of the length if there is a match, and 1."""
        total, n = sum(w for _, _, w in self.hits(fold(text))), len(text.split()) + 20
        return (math.log1p(total), 10 * total / n, math.log(n), 1.0) if total else (0.0, 0.0, 0.0, 1.0)

    def score(self, text: str) -> float:
        x = sum(a * b for a, b in zip(self.curve, self.strength(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _ratio(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio of a feature in a of na toxic and b of nb other documents."""
    p = (a + b) / (na + nb)
    return 2 * sum(k * math.log(k / (n * q)) for k, n, q in ((a, na, p), (na - a, na, 1 - p), (b, nb, p), (nb - b, nb, 1 - p)) if k > 0)


def _counts(rows: DataFrame, wanted=None) -> dict[str, tuple[int, float]]:
    """In how many of the sampled rows each feature (of the wanted ones, or of all) occurs, and the sum of its densities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter = Counter()
        density: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                found, n = features(text), len(text.split()) + 20
                for f in found if wanted is None else found.keys() & wanted.value:
                    docs[f] += 1
                    density[f] += found[f] / n
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([density[f] for f in docs], pa.float64())], names=["f", "n", "x"])

    counted = rows.select("text").mapInArrow(run, "f string, n long, x double").groupBy("f").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where(F.col("n") >= (LEAST_DOCS if wanted is None else 1))
    return {r["f"]: (r["n"], r["x"]) for r in counted.toLocalIterator()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learns entries and curve from labelled rows; beyond ``max_train`` rows from a sample by the hash of the id.

    Rows with null ids, or labels other than 0 and 1, are left out; equal texts
    count once. Of an id's or a text's different labels 1 counts. Without a label of either kind the lexicon is empty and scores
    are the share of toxic labels (0 without labels).
    """
    small_batches(docs.sparkSession)
    good = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isin(0, 1)).groupBy("__id").agg(F.max("y").alias("y"))
    n = good.count()
    if n > max_train:
        good = good.where(F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1_000_000)) < int(1e6 * max_train / n))
    # at most about max_train rows of an id and a label: a bounded broadcast
    sample = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).join(F.broadcast(good), "__id").groupBy("text").agg(F.max("y").alias("y")).cache()
    try:
        size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        na, nb = size.get(1, 0), size.get(0, 0)
        if not na or not nb:
            share = min(max(na / max(na + nb, 1), 1e-9), 1 - 1e-9)
            return Model({}, curve=(0.0, 0.0, 0.0, math.log(share / (1 - share))))
        toxic, other = sample.where("y = 1"), sample.where("y = 0")
        a = _counts(toxic)
        context = docs.sparkSession.sparkContext
        b = _counts(other, context.broadcast(frozenset(a)))
        none = (0, 0.0)
        share = {f: x / na / (x / na + b.get(f, none)[1] / nb) for f, (_, x) in a.items()}
        strong = {f: r for f, (k, _) in a.items() if share[f] >= LEAST_SHARE and (r := _ratio(k, b.get(f, none)[0], na, nb)) >= LEAST_RATIO}
        chosen = _cover(toxic, strong, context)
        weight = lambda f: math.log((a[f][1] / na + 1e-6) / (b.get(f, none)[1] / nb + 1e-6))
        model = Model({f: round(max(weight(f), 0.1), 6) for f in sorted(chosen)})
        return _curve(model, sample)
    finally:
        sample.unpersist()


def _cover(toxic: DataFrame, strong: dict[str, float], context) -> list[str]:
    """Greedy choice of entries by likelihood ratio times the share of their documents that still count, of equal ones the
    longer, while they cover enough; of a word and its beginnings only one is chosen."""
    shared = context.broadcast(frozenset(strong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(t).keys() & shared.value) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["f"])

    of_doc = [r["f"] for r in toxic.select("text").mapInArrow(run, "f array<string>").toLocalIterator()]
    docs_of: dict[str, list[int]] = {}
    for k, found in enumerate(of_doc):
        for f in found:
            docs_of.setdefault(f, []).append(k)
    left = [COVER] * len(of_doc)
    gain = {f: len(d) for f, d in docs_of.items()}
    chosen: list[str] = []
    while gain:
        best = max(gain, key=lambda f: (strong[f] * gain[f] / len(docs_of[f]), len(f), f))
        if gain.pop(best) < LEAST_GAIN or any(c.startswith(best) or best.startswith(c.rstrip(" ")) for c in chosen):
            continue
        chosen.append(best)
        for k in docs_of[best]:
            left[k] -= 1
            if not left[k]:
                for f in of_doc[k]:
                    if f in gain:
                        gain[f] -= 1
    return chosen


def _curve(model: Model, sample: DataFrame) -> Model:
    """Fits the curve by Newton's method with a light penalty."""
    rows = score_texts(sample, model, raw="x").select("x", "y").toPandas()
    design, y = np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float)
    theta, penalty = np.zeros(design.shape[1]), np.eye(design.shape[1]) * 1e-2
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -60, 60)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ theta)
        size = np.abs(step).max()
        theta += step * min(1.0, 5.0 / size) if size else 0
        if size < 1e-9:
            break
    model.curve = tuple(map(float, theta))
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", raw: str | None = None) -> DataFrame:
    """Adds the score (0 to 1) of every whole text. Null texts count as empty: no match, the curve's value at 0."""
    small_batches(docs.sparkSession)
    out = raw or score_col
    keep = [c for c in docs.columns if c != out]
    (own,) = unused(docs.columns, "own_text")
    source = docs.select(*keep, text_or_empty(text_col).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.strength if raw else model.score
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([f(t) for t in b.column(own).to_pylist()], pa.list_(pa.float64()) if raw else pa.float64())], names=[*keep, out])

    return source.mapInArrow(run, docs.select(*keep).schema.add(out, T.ArrayType(T.DoubleType()) if raw else T.DoubleType()))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels of rows that aren't held out.

    Null texts count as empty. Rows with a null id are held out. Repeated rows
    stay and are scored alike. No documents: no rows; no labels: see ``train``.
    Columns besides doc_id, text and the labels' doc_id and toxic aren't read.
    Very long texts are scored whole, in linear time.
    """
    model = train(docs, labels.where(~held_out("doc_id")))
    source = docs.select(F.col("doc_id"), held_out("doc_id").alias("held_out"), F.col("text"))
    return score_texts(source, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
