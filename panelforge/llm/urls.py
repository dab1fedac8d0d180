"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Listed entries are canonical URLs, either whole ones or a host with a path
prefix. A URL's candidates are its host's suffixes (it and parent domains, of the numbers
of labels that the list holds) with the prefixes of its path that have a listed length. Each candidate probes
one 512-bit block of a Bloom filter, an array of longs in a scalar subquery;
only URLs with a possible hit go on, as distinct ones, to an exact join with
the list, which removes the filter's false positives. All of it is built-in
functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a block, and bits that an entry sets in its block.
BLOCK_WORDS = 8
PROBES = 6
BITS_AN_ENTRY = 16
#: The filter's bound, as it is broadcast: a fuller filter passes more to the exact join, it loses nothing.
MAX_FILTER_WORDS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """One row with the filter's words (array of long), and its number of blocks; ``n_keys`` sizes it."""
    n_blocks = 1
    while n_blocks * BLOCK_WORDS < MAX_FILTER_WORDS and n_blocks * BLOCK_WORDS * 64 < n_keys * BITS_AN_ENTRY:
        n_blocks *= 2
    spark = keys.sparkSession
    bits = keys.select(F.explode(F.array(*_bits(F.col(key), n_blocks))).alias("b"))
    words = bits.groupBy(F.col("b.word").alias("word")).agg(F.bit_or(F.col("b.mask")).alias("mask"))
    every = spark.range(n_blocks * BLOCK_WORDS).withColumnRenamed("id", "word").join(words, "word", "left")
    pairs = F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return every.agg(F.transform(pairs, lambda x: x["mask"]).alias("words")), n_blocks


def _bits(key: Column, n_blocks: int) -> list[Column]:
    """Each probe's word and mask: one hash chooses the block, slices of another its bits."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks))
    second = F.xxhash64(F.lit("bits"), key)
    out = []
    for k in range(PROBES):
        bit = F.shiftrightunsigned(second, 9 * k).bitwiseAND(F.lit(BLOCK_WORDS * 64 - 1))
        word = block * BLOCK_WORDS + F.shiftright(bit, 6)
        out.append(F.struct(word.cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("mask")))
    return out


def might_contain(words: Column, key: Column, n_blocks: int) -> Column:
    """False only if the key is not in the filter."""
    found = [words[b["word"].cast("int")].bitwiseAND(b["mask"]) != 0 for b in _bits(key, n_blocks)]
    out = found[0]
    for f in found[1:]:
        out = out & f
    return out


def canonical(host: Column, path: Column) -> Column:
    """The key of an entry: host and path joined by a blank, which neither a listed host nor path holds."""
    return F.concat(host, F.lit(" "), path)


def _candidates(host: Column, path: Column, lengths: Column, depths: Column) -> Column:
    """Keys of the host's suffixes of a listed number of labels with every path prefix of a listed length."""
    labels = F.split(host, r"\.")
    deep = F.filter(depths, lambda n: n <= F.size(labels))
    suffixes = F.transform(deep, lambda n: F.array_join(F.slice(labels, -n, n), "."))
    fits = F.filter(lengths, lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: canonical(s, F.substr(path, F.lit(1), n)))))


def url_filter(urls: DataFrame, entries: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (``host/path`` of the entry, else null) and verdict (block or allow) to every row.

    entries: host, path (a prefix; empty: the whole host), verdict. An entry fits
    its host and all subdomains; of those that fit, the longest wins, ties by
    ``block`` first. Null URLs and ones without ``://`` have an empty host and
    path and get the default. Entries with null or empty hosts fit nothing;
    of repeated ones the blocking one counts. The list may be empty or large:
    it is joined by hash, broadcast only where Spark's own size check allows.
    Copies of a URL are judged once. Input columns named like added ones are replaced.
    Very long URLs and hosts of very many labels are judged whole.
    """
    added = ("host", "path", "rule", "verdict")
    host, path = url_parts(F.col(url_col))
    rows = urls.select(*(c for c in urls.columns if c not in added), host.alias("host"), path.alias("path"))
    listed = (
        entries.where(F.col("host").isNotNull() & (F.col("host") != ""))
        .select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
        .groupBy("h", "p")
        .agg(F.max("verdict").alias("listed_verdict"))
        .select(canonical(F.col("h"), F.col("p")).alias("key"), F.concat("h", "p").alias("listed_rule"), F.length("p").alias("n"), F.size(F.split("h", r"\.")).alias("depth"), (F.length("h") + F.length("p")).alias("long"), "listed_verdict")
    )
    facts = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("n")).alias("lengths"), F.sort_array(F.collect_set("depth")).alias("depths")).first()
    if not facts["n"]:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    words, n_blocks = bloom_filter(listed, "key", facts["n"])
    lengths, depths = (F.array(*map(F.lit, facts[c])) for c in ("lengths", "depths"))
    probed = rows.where(F.col("host") != "").select("host", "path").distinct().select("host", "path", words.scalar().alias("words"), _candidates(F.col("host"), F.col("path"), lengths, depths).alias("keys"))
    possible = probed.select("host", "path", F.explode(F.filter("keys", lambda k: might_contain(F.col("words"), k, n_blocks))).alias("key"))
    best = F.max(F.struct("long", "listed_verdict", "listed_rule"))
    judged = possible.join(listed, "key").groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.listed_rule").alias("rule"), F.col("best.listed_verdict").alias("verdict"))
    return rows.join(judged, ["host", "path"], "left").select(*rows.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def entries_of(spark: SparkSession, listed: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(listed, "host string, path string, verdict string")


#: Rules of the query: host, path prefix, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def judge_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page under RULES."""
    source = pages.select("page_id", "url")
    return url_filter(source, entries_of(pages.sparkSession, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, host, path, max({'n': length(h) + length(p), 'v': v, 'r': h || p}) AS best
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL
)
SELECT s.page_id, s.host, s.path, f.best.r AS rule, coalesce(f.best.v, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT DISTINCT host, path, best FROM fits) f ON s.host = f.host AND s.path = f.path
"""
