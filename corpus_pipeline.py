"""A corpus pipeline of five stages over ``documents``: quality rules, line dedup, SimHash near-dedup, personal data, packing.

Each stage gets what its predecessor kept, as rows that were written and read
again, and returns the columns of documents; the last one returns packed
segments. Rows with null ids go through every stage. Repeated rows are one
document to line dedup: they are treated alike. Near-dedup keeps one row of
each component, whether ids are null or repeated. Empty tables give empty results.
Very long texts go through every stage whole. Each stage reads and returns the
five columns of documents; other columns, whatever their names, aren't passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import lines, packing, pii, quality, shingles
from panelforge.llm.common import maybe_broadcast, text_or_empty, written
from panelforge.llm.queries import RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


#: The stage keeps clean documents of any length: one word is enough.
RULES = quality.Rules(min_words=1)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines; documents that the rules reject (no word, half of them repeated, or too much text in failing lines) go."""
    return _with_text(quality.quality_rules(docs.select(*COLUMNS), rules=RULES).where("kept"), "cleaned")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later ones of similar lines; documents that lose all their words with that go."""
    deduped = lines.dedup_lines(docs.select(*COLUMNS), min_tokens=lines.ALL_LINES)
    return _with_text(deduped.where((F.col("n_removed") == 0) | F.col("deduped").rlike(r"\S")), "deduped")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row, by id (null ones last) and text, of each component of near-duplicates: five-word shingles, Jaccard 0.8 or more.

    SimHash fingerprints meet by positional bytes, pairs are checked on whole sets; links that
    fingerprints miss are joined exactly afterwards.
    """
    found = shingles.near_duplicates(docs.select("doc_id", "text")).groupBy("doc_id", "th", "is_first").agg(F.count("*").alias("n"))
    rows = written(found.where("not is_first or n > 1").select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "is_first"), "near-duplicates")
    gone, again = rows.where("not is_first"), rows.where("is_first")
    n_gone, n_again = gone.count(), again.count()
    known = docs.select(*COLUMNS, F.xxhash64(text_or_empty("text")).alias("th"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    kept = known.join(maybe_broadcast(gone, n_gone, 24), same, "left_anti")
    if n_again:
        again = maybe_broadcast(again, n_again, 24)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "th"]))
    return kept.select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span of personal data by its kind in brackets."""
    model = pii.train(docs)
    return _with_text(pii.find_spans(docs.select(*COLUMNS), model, masked_col="masked"), "masked")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens of what is left into batches of optimal length buckets."""
    return packing.pack_documents(docs, RANKS)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("packing", packing_stage),
]

#: SQL can't express shingle hashes, learned weights or tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
