"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers of three kinds vote on each: regular
expressions (shape and checksums), gazetteers (domains, names, number prefixes)
and context (words and signs around). The counts of vote patterns over the
whole corpus go through expectation-maximisation, which estimates how reliable
each labeler is and how likely each pattern is personal data. On these
posteriors a final classifier of spans is trained, which sees the span itself
(length, classes and variety of characters, shape of its ends), the words around
it, its kind and what its shape, checksum and edges told; it decides each candidate in a second pass. Counts of
patterns cover all texts; the classifier is fitted on a bounded sample, at most
``EXAMPLES`` spans of each kind and pattern, those with the least hashes. Both
are bounded by the number of patterns, so nothing that grows with the corpus
reaches the driver.

Four kinds have fixed definitions (email, ip, card, phone); their spans always
stay. The method adds spans of the same kinds in other forms, and of further
kinds: secret tokens, account numbers, postal-like identifiers and names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import passing, small_batches, text_or_empty, unused, written

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: Numbers joined by dots, as far as they go.
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the four fixed kinds, in order; leftmost non-overlapping matches by kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += _ips(text)
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _ips(text: str) -> Iterator[tuple[int, int, int]]:
    """The matches of IP, in one walk over chains of numbers: each four in turn are a match."""
    for m in CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, 1, end
            at = end + 1


def _octet(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def _emails(text: str) -> Iterator[re.Match]:
    """As EMAIL.finditer(text), run by run around each @."""
    at = 0
    while (k := text.find("@", at)) >= 0:
        start = k
        while start > at and (text[start - 1] in _LOCAL):
            start -= 1
        m = EMAIL.match(text, start) if start < k else None
        if m:
            yield m
            at = m.end()
        else:
            at = k + 1


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Candidates beyond the fixed kinds, with the name of their kind.
PROPOSALS = (
    ("secret", re.compile(r"""(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|(?:sk|pk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16,64}|AKIA[0-9A-Z]{16}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{4,}){1,2})(?![A-Za-z0-9])""")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)[ -]?|[0-9]{2,4}[ -])[0-9]{3}[ -][0-9]{4}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")),
    ("email", re.compile(r"[A-Za-z0-9._+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("name", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? (?:[A-Z][a-zà-ÿ]{1,20})(?: [A-Z][a-zà-ÿ]{1,20}){0,2}")),
)
#: What a text without digits must hold for any of the proposals to be tried.
HINTS = ("[at]", "(at)", "Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "sk_", "sk-", "pk_", "pk-", "ghp", "xox", "AKIA", "eyJ")
#: Gazetteers: last labels of mail domains, number prefixes of card issuers, given names, private networks.
TOP_DOMAINS = frozenset("com org net edu gov mil info biz io de fr es it uk eu ch at nl be pt pl se us ca au".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "34", "37", "6011", "65", "36", "38", "30")
GIVEN_NAMES = frozenset("anna ben carlos carmen claire david elena emma felix hans jan jean john jose juan julia karl laura lucas maria marie mark martin max michael miguel nina paul peter pierre sarah thomas".split())
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|gateway)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|visa|mastercard|payment|karte|tarjeta|carte)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|teléfono|téléphone)\b"),
    "secret": re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_ -]?key|key|bearer)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|cuenta|compte)\b"),
    "name": re.compile(r"(?i)\b(?:dear|name|contact|sincerely|regards|hello)\b"),
}
#: Words that speak against personal data: versions, order and part numbers, examples.
AGAINST = re.compile(r"(?i)\b(?:version|release|order|invoice|isbn|part|section|page|figure|commit|sha-?1|md5|checksum|example)\b")
AROUND = 40
LABELERS = ("shape", "checksum", "gazetteer", "context", "against", "edges")
VOTE = {1: "+", -1: "-", 0: "0"}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates: the fixed spans and proposals that don't overlap them or each other."""
    out = [(s, e, KINDS[k]) for s, k, e in base]
    if not (DIGIT.search(text) or any(map(text.__contains__, HINTS))):
        return out
    taken = _merged([(s, e) for s, e, _ in out])
    for kind, pattern in PROPOSALS:
        ends = [e for _, e in taken]
        free = []
        for m in pattern.finditer(text):
            s, e = m.span()
            k = bisect_right(ends, s)  # the first taken span that ends behind the match's start
            if k == len(taken) or taken[k][0] >= e:
                free.append((s, e))
        if free:
            out += [(s, e, kind) for s, e in free]
            taken = _merged(taken + free)
    return sorted(out)


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str) -> str:
    """The labelers' votes on a candidate: + for, - against, 0 none."""
    span = text[start:end]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = _digits(span)
    shape = checksum = gazetteer = 0
    if kind == "email":
        shape = 1 if EMAIL.fullmatch(span) else 0
        gazetteer = 1 if re.split(r"\.|\[dot\]|\(dot\)", span)[-1].strip().lower() in TOP_DOMAINS else -1
    elif kind == "ip":
        shape = 1 if IP.fullmatch(span) and all(map(_octet, span.split("."))) or span.count(":") == 7 else -1
        gazetteer = -1 if span.startswith(("0.", "255.")) else 1
    elif kind == "card":
        shape = 1 if len(digits) in (13, 14, 15, 16, 19) else -1
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else 0
    elif kind == "phone":
        shape = 1 if 9 <= len(digits) <= 15 else 0
        gazetteer = 1 if span.startswith("+") else 0
    elif kind == "secret":
        shape = 1 if len(set(span)) >= 8 else -1
        gazetteer = 1 if span.startswith(("sk", "pk", "ghp", "xox", "AKIA", "eyJ")) or len(span) in (32, 40, 64) else 0
    elif kind == "iban":
        shape = 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
        checksum = 1 if _iban_ok(span) else -1
    elif kind == "ssn":
        shape = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" else 1
    elif kind == "name":
        shape = 1 if span.count(" ") >= 2 else 0
        gazetteer = 1 if any(w.lower() in GIVEN_NAMES for w in span.split()[1:]) else 0
    context = 1 if CONTEXT[kind].search(before) or re.match(r"\s*[:=]", before[::-1]) else 0
    against = -1 if AGAINST.search(before[-24:]) else 0
    edges = -1 if before[-1:].isalnum() or after[:1].isalnum() else 1
    return "".join(VOTE[v] for v in (shape, checksum, gazetteer, context, against, edges))


#: Most sampled spans of a kind and vote pattern: the bound of the classifier's training rows.
EXAMPLES = 8
#: Cells of the hashed words before and after a span.
CONTEXT_CELLS = 64
LAST_WORD, FIRST_WORD = re.compile(r"([^\W\d_]+)[\W\d_]{0,4}$"), re.compile(r"^[\W\d_]{0,4}([^\W\d_]+)")
OWN = ("shape", "checksum", "edges")
CLASSES = (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum())


def span_features(kind: str, pattern: str, span: str, before: str, after: str) -> list[str]:
    """The names of the features that a span has: what the labelers that read the span alone found, and what no
    labeler sees. Gazetteers and context take part through the posteriors only, or a classifier would repeat the votes."""
    out = ["all", f"kind={kind}", f"{kind} length={min(len(span).bit_length(), 8)}", f"{kind} variety={4 * len(set(span)) // len(span)}"]
    out += [f"{name}{vote}" for name, vote in zip(LABELERS, pattern) if vote != "0" and name in OWN]
    out += [f"class{k}={4 * sum(map(f, span)) // len(span)}" for k, f in enumerate(CLASSES)]
    out += [f"{end}={next((k for k, f in enumerate(CLASSES) if f(c)), 9)}" for end, c in (("first", span[0]), ("last", span[-1]))]
    for name, m in (("before", LAST_WORD.search(before)), ("after", FIRST_WORD.search(after))):
        if m:
            out.append(f"{name}={zlib.crc32(m[1].lower().encode()) % CONTEXT_CELLS}")
    return out


class SpanModel:
    """Labelers' reliabilities by EM over vote patterns, and a logistic classifier of spans that is trained on the posteriors.

    patterns: (kind, votes) -> occurrences. examples: (kind, votes, span, text before, text after), a sample.
    """

    def __init__(self, patterns: dict[tuple[str, str], int], examples: list[tuple[str, str, str, str, str]] = (), rounds: int = 100):
        self.kinds = sorted({k for k, _ in patterns})
        keys, n = list(patterns), np.array(list(patterns.values()), float)
        votes_of = np.array([["-0+".index(v) for v in p] for _, p in keys], int).reshape(len(keys), len(LABELERS))
        # start: majority of votes; then each labeler's chance of each vote given the truth, and the share of true candidates by kind
        post = 1 / (1 + np.exp(-1.5 * (votes_of - 1).sum(1)))
        kind = np.array([self.kinds.index(k) for k, _ in keys], int)
        self.reliability = np.full((2, len(LABELERS), 3), 1 / 3)
        self.share = np.full(len(self.kinds), 0.5)
        for _ in range(rounds if len(keys) else 0):
            for truth, weight in ((0, n * (1 - post)), (1, n * post)):
                for j in range(len(LABELERS)):
                    # a vote for can't become evidence against, whatever the corpus: counts start from a prior in that sense
                    prior = np.array([1.0, 2.0, 3.0] if truth else [3.0, 2.0, 1.0]) * 5
                    counts = np.bincount(votes_of[:, j], weight, 3) + prior
                    self.reliability[truth, j] = counts / counts.sum()
            own = np.bincount(kind, n, len(self.kinds))
            self.share = (np.bincount(kind, n * post, len(self.kinds)) + 5) / (own + 10)
            logit = np.log(self.share[kind] / (1 - self.share[kind]))
            for j in range(len(LABELERS)):
                logit = logit + np.log(self.reliability[1, j, votes_of[:, j]] / self.reliability[0, j, votes_of[:, j]])
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(new - post).max(initial=0) < 1e-9:
                break
            post = new
        self.posterior = dict(zip(keys, post.tolist()))
        self.weights = self._train(patterns, sorted(examples))

    def _train(self, patterns, examples) -> dict[str, float]:
        """Newton's method with a light penalty; a pattern's occurrences are shared by its examples."""
        names: dict[str, int] = {}
        rows = [[names.setdefault(f, len(names)) for f in span_features(*x)] for x in examples]
        if not rows:
            return {}
        x, sampled = np.zeros((len(rows), len(names))), Counter(e[:2] for e in examples)
        for k, found in enumerate(rows):
            x[k, found] = 1.0
        y = np.array([self.posterior[e[:2]] for e in examples])
        # by the square root, so that a frequent pattern doesn't silence the others; the sum is the number of examples
        weight = np.sqrt([patterns[e[:2]] / sampled[e[:2]] for e in examples])
        weight *= len(rows) / weight.sum()
        theta, penalty = np.zeros(len(names)), np.full(len(names), 0.3)
        penalty[names["all"]] = 1e-3
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * theta)
            theta += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        return {name: float(theta[k]) for name, k in names.items()}

    def probability(self, kind: str, pattern: str, span: str, before: str, after: str) -> float:
        """Of a span; without any example the posterior of its votes, or an even chance."""
        if not self.weights:
            return self.posterior.get((kind, pattern), 0.5)
        x = sum(self.weights.get(f, 0.0) for f in span_features(kind, pattern, span, before, after))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]


def _observed(docs: DataFrame) -> tuple[dict[tuple[str, str], int], list[tuple[str, str, str, str, str]]]:
    """How often each kind and vote pattern occurs over all texts (at most kinds times 3**labelers rows), and
    the ``EXAMPLES`` spans of each with the least hashes."""
    names = ["kind", "pattern", "n", "h", "span", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        least: dict[tuple[str, str], list[tuple]] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for s, e, kind in candidates(text, base_spans(text)):
                    key = kind, votes(text, s, e, kind)
                    total[key] += 1
                    seen = _around(text, s, e)
                    row = (xxhash.xxh64_intdigest("\0".join(seen)) >> 1, *seen)
                    best = least.setdefault(key, [])
                    if (len(best) < EXAMPLES or row < best[-1]) and row not in best:
                        best.append(row)
                        best.sort()
                        del best[EXAMPLES:]
        rows = [(*key, n, 0, "", "", "") for key, n in total.items()] + [(*key, 0, *row) for key, best in least.items() for row in best]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    seen = written(docs.mapInArrow(run, "kind string, pattern string, n long, h long, span string, before string, after string"), "vote-patterns")
    patterns = {(r["kind"], r["pattern"]): r["n"] for r in seen.where("n > 0").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("kind", "pattern").orderBy("h", "span", "before", "after"))
    sample = seen.where("n = 0").select("kind", "pattern", "h", "span", "before", "after").distinct().withColumn("place", place).where(F.col("place") <= EXAMPLES)
    return patterns, [tuple(r) for r in sample.select("kind", "pattern", "span", "before", "after").collect()]


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """The model of all texts. Null texts count as empty; without any candidate no span is added to the fixed ones."""
    small_batches(docs.sparkSession)
    with passing():
        return SpanModel(*_observed(docs.select(text_or_empty(text_col).alias("text"))))


def spans(text: str, model: SpanModel, cut: float = 0.5) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """The fixed spans, and all spans: fixed ones and candidates that the classifier takes."""
    base = base_spans(text)
    fixed = {(s, e) for s, _, e in base}
    out = []
    for s, e, kind in candidates(text, base):
        if (s, e) in fixed or model.probability(kind, votes(text, s, e, kind), *_around(text, s, e)) >= cut:
            out.append((s, e, kind))
    return base, out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_spans(docs: DataFrame, model: SpanModel, text_col: str = "text", spans_col: str = "spans", masked_col: str | None = None) -> DataFrame:
    """Adds ``spans`` (start, end in code points, kind; by start) and, if named, the text with each span as ``[KIND]``.

    Null and empty texts have no spans. Rows are judged on their own; input
    columns named like added ones are replaced. Very long texts are read whole,
    in linear time.
    """
    small_batches(docs.sparkSession)
    added = [spans_col, *([masked_col] if masked_col else [])]
    keep = [c for c in docs.columns if c not in added]
    (own,) = unused(docs.columns, "own_text")
    source = docs.select(*keep, text_or_empty(text_col).alias(own))
    schema = docs.select(*keep).schema.add(spans_col, SPAN)
    if masked_col:
        schema = schema.add(masked_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, masked = [], []
            for text in b.column(own).to_pylist():
                _, all_spans = spans(text, model)
                found.append([{"start": s, "end": e, "kind": k} for s, e, k in all_spans])
                if masked_col:
                    masked.append(mask(text, all_spans))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, _SPAN), *([pa.array(masked, pa.string())] if masked_col else [])], names=[*keep, *added])

    return source.mapInArrow(run, schema)


def mask(text: str, all_spans: list[tuple[int, int, str]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the first."""
    out, at = [], 0
    for s, e, kind in sorted(all_spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the four fixed kinds, the digest of the fixed spans, and all spans as kind:start:end."""
    model = train(docs, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, shown = [[] for _ in KINDS], [], []
            for text in b.column("text").to_pylist():
                base, found = spans(text, model)
                for k, out in enumerate(counts):
                    out.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                shown.append(",".join(f"{k}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else len(KINDS), x[2]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
