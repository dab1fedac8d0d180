"""Quality rules, line first: punctuation, navigation and boilerplate rules judge each line, lines
that fail are removed, and a document that loses too much of its text is rejected.

Base rules judge the whole text beside that: too few words, or too many words
in repeated windows. A text is read once, inside one task; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import small_batches, text_or_empty, unused

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    """Thresholds: of the base rules, of the line rules and of the document."""

    min_words: int = 50
    window: int = 3
    max_repeat_percent: int = 50
    #: A line fails if over this share of its words end in symbols or hold a separator.
    max_symbol_words: float = 0.3
    #: A line of at least ``shout_words`` words fails if all its letters are capitals.
    shout_words: int = 4
    #: A line of at least ``exclaim_words`` words fails if over this share of its words ends in "!".
    exclaim_words: int = 4
    max_exclaim_words: float = 0.3
    #: A document is rejected if it loses more than this share of the characters of its words.
    max_lost: float = 0.3


#: Licence, cookie, sign-in and navigation lines, matched against the whole lower-cased line.
BOILERPLATE = re.compile(
    r"\s*(?:(?:this work is |this file is |released |code is )?(?:licensed|released) under .{0,80}|all rights reserved\.?|(?:copyright|©|\(c\)) .{0,80}"
    r"|.{0,40}\b(?:accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|sign in|log in|subscribe to our newsletter|click here|share on (?:facebook|twitter)|javascript is disabled)\b.{0,40})\s*"
)
#: Menus and breadcrumbs: short words between separators.
NAVIGATION = re.compile(r"\s*(?:[\w'-]{1,20}(?: [\w'-]{1,20}){0,2}\s*(?:[|»›•>]|::|/)\s*){2,}[\w'-]{0,20}(?: [\w'-]{1,20}){0,2}\.?\s*")
SYMBOL_WORD = re.compile(r"[#*$%&|<>]{2,}")


def line_fails(line: str, rules: Rules) -> str | None:
    """The name of the rule that a line with a word fails, or None."""
    if len(line) <= 160 and BOILERPLATE.fullmatch(line.lower()):
        return "boilerplate"
    words = line.split()
    n = len(words)
    if "|" in line or "»" in line or "›" in line or "•" in line or ">" in line or "::" in line or " / " in line:
        if n >= 3 and (NAVIGATION.fullmatch(line) or sum(w in ("|", "»", "›", "•", ">", "::", "/") for w in words) > rules.max_symbol_words * n):
            return "navigation"
    if any(map(line.__contains__, ("##", "**", "$$", "%%", "&&", "||", "<<", ">>"))) and sum(bool(SYMBOL_WORD.search(w)) for w in words) > rules.max_symbol_words * n:
        return "punctuation"
    if "!" in line and n >= rules.exclaim_words and sum(w[-1] == "!" for w in words) > rules.max_exclaim_words * n:
        return "punctuation"
    if n >= rules.shout_words and line.isupper():
        return "punctuation"
    return None


def repeat_words(words: list, window: int) -> int:
    """Words that lie in a window of words found twice or more; the first occurrence counts."""
    if len(words) <= window:
        return 0
    windows = list(zip(*(words[k:] for k in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, end = Counter(windows), 0, 0
    for at, w in enumerate(windows):
        if times[w] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def assess(text: str, rules: Rules = Rules()) -> dict:
    """The figures, the verdict and the cleaned text of one document.

    A text without words has only zeros and fails the base rules. ``cleaned``
    is the text of the lines that stay (lines without words stay too).
    """
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen: set[str] = set()
    n_dup = lost = 0
    stay = []
    for line in lines:
        if not line.strip(BLANKS):
            stay.append(line)
            continue
        if line in seen:
            n_dup += 1
        seen.add(line)
        if line_fails(line, rules):
            lost += len(line) - sum(map(line.count, BLANKS))
        else:
            stay.append(line)
    n_repeat = repeat_words(words, rules.window)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.max_lost * word_chars, "n_lines_removed": len(lines) - len(stay), "chars_removed": lost, "cleaned": "\n".join(stay),
    }


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, chars_removed long"


def quality_rules(docs: DataFrame, text_col: str = "text", cleaned_col: str | None = "cleaned", rules: Rules = Rules()) -> DataFrame:
    """Adds the figures of ``assess`` and the cleaned text to every row; removes no rows.

    The boilerplate and navigation rules judge short lines by design: a line of
    over 160 characters, or with over 80 after "licensed under", is prose to them.

    Null and empty texts have no words: figures 0, base_failed true, kept false.
    Rows are judged on their own, so ties, repeats, null ids and an empty table
    need no rule; input columns with the names of added ones are replaced.
    """
    small_batches(docs.sparkSession)
    added = [f.split()[0] for f in FIGURES.split(", ")] + ([cleaned_col] if cleaned_col else [])
    keep = [c for c in docs.columns if c not in added]
    (own,) = unused(docs.columns, "own_text")
    source = docs.select(*keep, text_or_empty(text_col).alias(own))
    schema = docs.select(*keep).schema
    for f in FIGURES.split(", "):
        schema = schema.add(*f.split())
    if cleaned_col:
        schema = schema.add(cleaned_col, "string")
    kinds = [*([pa.int64()] * 5), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), *([pa.string()] * bool(cleaned_col))]
    names = [f.split()[0] for f in FIGURES.split(", ")] + ["cleaned"] * bool(cleaned_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [assess(t, rules) for t in b.column(own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds))], names=[*keep, *added])

    return source.mapInArrow(run, schema)


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """doc_id and the figures of every document, without its texts."""
    return quality_rules(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", None, rules).drop("text", "n_lines_removed", "chars_removed")


#: The same rules as DuckDB SQL: words by position for the figures, lines by number for the verdict.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
windows AS (SELECT doc_id, i, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM words WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
flags AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS rep FROM windows),
covered AS (SELECT doc_id, i, rep OR coalesce(lag(rep, 1) OVER x, false) OR coalesce(lag(rep, 2) OVER x, false) AS c FROM flags WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
full_lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (SELECT doc_id, nth, list_sum(list_transform(w, lambda x: length(x))) AS chars,
  (length(line) <= 160 AND regexp_full_match(lower(line), '\s*(?:(?:this work is |this file is |released |code is )?(?:licensed|released) under .{0,80}|all rights reserved\.?|(?:copyright|©|\(c\)) .{0,80}|.{0,40}\b(?:accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|sign in|log in|subscribe to our newsletter|click here|share on (?:facebook|twitter)|javascript is disabled)\b.{0,40})\s*'))
  OR (regexp_matches(line, '[|»›•>]|::| / ') AND len(w) >= 3 AND (len(list_filter(w, lambda x: x IN ('|', '»', '›', '•', '>', '::', '/'))) > 0.3 * len(w)
      OR regexp_full_match(line, '\s*(?:[\pL\pN_''-]{1,20}(?: [\pL\pN_''-]{1,20}){0,2}\s*(?:[|»›•>]|::|/)\s*){2,}[\pL\pN_''-]{0,20}(?: [\pL\pN_''-]{1,20}){0,2}\.?\s*')))
  OR (regexp_matches(line, '##|\*\*|\$\$|%%|&&|\|\||<<|>>') AND len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]{2,}'))) > 0.3 * len(w))
  OR (contains(line, '!') AND len(w) >= 4 AND len(list_filter(w, lambda x: ends_with(x, '!'))) > 0.3 * len(w))
  OR (len(w) >= 4 AND upper(line) = line AND lower(line) <> line) AS fails
  FROM full_lines),
verdicts AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY doc_id),
facts AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN repeats r ON d.doc_id = r.doc_id LEFT JOIN verdicts v ON d.doc_id = v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.3 * word_chars AS kept
FROM facts
"""
