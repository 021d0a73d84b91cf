"""Secret scan over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match satisfies. A block of
documents gets an inverted index (trigram to documents) of the trigrams that the queries name; postings are intersected
and united as the query says, and the rule's expression runs on the candidates only. A rule without mandatory trigrams
scans every text. Trigrams are of UTF-8 bytes with A-Z lowered, so a query holds in either case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``regex``; one whose ``group`` has fewer than ``least`` characters is dropped then."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The three base kinds, in the order in which ties of start are listed (fixed values).
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Kinds of this method's own: well-known shapes of credentials.
OWN_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"\b[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("mail_key", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"']+:[^\s/@\"']{3,}@"),
    Rule("bearer", r"(?ai:authorization)[\"']?\x20*:\x20*[\"']?(?ai:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})", 1),
)
RULES = BASE_RULES + OWN_RULES

# A query is True (no condition), a trigram (3 bytes), ("and", *queries) or ("or", *queries).
MOST_EXACT = 64


def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> object:
    return True if True in parts or not parts else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _need(exact: set[bytes]) -> object:
    """The query that one of ``exact`` stands in the text."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(exact)])


def trigram_query(regex: str) -> object:
    """A condition on a text's trigrams that holds for every text with a match of ``regex``."""
    exact, query = _walk(parser.parse(regex))
    return _all([query, _need(exact) if exact is not None else True])


def _walk(items: object) -> tuple[set[bytes] | None, object]:
    """For a sequence: the strings it may match, if few (else None), and a query beside them."""
    run: set[bytes] = {b""}
    queries: list = []
    whole = True
    for op, arg in items:
        exact, query = _one(str(op), arg)
        queries.append(query)
        joined = {a + b for a in run for b in exact} if exact is not None and len(run) * len(exact) <= MOST_EXACT else None
        if joined is not None:
            run = joined
        else:
            queries.append(_need(run))
            run = exact if exact is not None and len(exact) <= MOST_EXACT else {b""}
            if exact is not None and run == {b""}:
                queries.append(_need(exact))
            whole = False
    if whole:
        return run, _all(queries)
    return None, _all([*queries, _need(run)])


def _one(op: str, arg: object) -> tuple[set[bytes] | None, object]:
    low = lambda c: chr(c).encode("utf-8", "surrogatepass").lower()
    if op == "LITERAL":
        return {low(arg)}, True
    if op == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            return {low(c) for _, c in arg}, True
        return None, True
    if op == "SUBPATTERN":
        return _walk(arg[3])
    if op == "BRANCH":
        parts = [_walk(p) for p in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT:
            return set().union(*(e for e, _ in parts)), _any([q for _, q in parts]) if any(q is not True for _, q in parts) else True
        return None, _any([_all([q, _need(e) if e is not None else True]) for e, q in parts])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, sub = arg
        exact, query = _walk(sub)
        if (least, most) == (0, 1) and exact is not None and len(exact) < MOST_EXACT:
            return exact | {b""}, True
        if least == 0:
            return None, True
        return None, _all([query, _need(exact) if exact is not None else True])
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {b""}, True
    return None, True


def trigrams_of(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1:]))


class TrigramIndex:
    """Postings of a block of texts, for the trigrams of some queries."""

    def __init__(self, trigrams: list[bytes]) -> None:
        self.number = {t: i + 1 for i, t in enumerate(trigrams)}
        if len(trigrams) > 65_000:
            raise ValueError("too many different trigrams in the rules")
        self.known = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.number.items():
            self.known[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.postings: dict[bytes, np.ndarray] = {}

    def fill(self, data: np.ndarray, ends: np.ndarray) -> None:
        """``data``: the lowered bytes of all texts in a row, ``ends``: where each ends."""
        self.count = len(ends)
        parts = []
        size = 1 << 20
        for at in range(0, max(0, len(data) - 2), size):
            b = data[at : at + size + 2].astype(np.uint32)
            n = self.known[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            if (hit := np.flatnonzero(n)).size:
                where = hit + at
                doc = np.searchsorted(ends, where, side="right")
                inside = where + 3 <= ends[doc]
                parts.append(np.unique(n[hit][inside].astype(np.int64) << 40 | doc[inside]))
        rows = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        cut = np.searchsorted(rows >> 40, np.arange(1, len(self.number) + 2))
        docs = rows & ((1 << 40) - 1)
        self.postings = {t: docs[cut[i - 1] : cut[i]] for t, i in self.number.items()}

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.count)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.candidates(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def find_spans(texts: list[str], rules: tuple[Rule, ...], index: TrigramIndex, queries: list[object]) -> list[list[tuple[int, int, str]]]:
    """The (start, rule number, end) of every text's spans, in order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) for b in raw])
    index.fill(LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)], ends)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        # A whole match of at least so many characters can be asked for at once where one class repeats.
        least = re.fullmatch(r"(.*\[[^\]]+\])\+", rule.regex) if rule.group == 0 and rule.least and rule.regex.startswith("[") else None
        find = re.compile(f"{least[1]}{{{rule.least},}}" if least else rule.regex).finditer
        for d in index.candidates(query).tolist():
            for m in find(texts[d]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[d].append((m.start(), n, m.end()))
    for spans in out:
        spans.sort()
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, a digest of their spans, and all spans as kind:start:end.

    Offsets are code points, ends exclusive; a null text counts as empty and has no spans. Rows that repeat are scanned
    each for itself; no row is moved to another task. Overlapping spans of different kinds are all reported. ``rules``
    must begin with the base kinds. Other columns don't matter; an empty table gives an empty result.
    """
    if rules[:3] != BASE_RULES:
        raise ValueError("the base kinds come first")
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        index = TrigramIndex(trigrams)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = find_spans([t or "" for t in batch.column(1).to_pylist()], rules, index, queries)
            say = lambda spans: ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in spans)
            base = [[s for s in spans if s[1] < 3] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            sha = pa.array([hashlib.sha256(say(spans).encode()).hexdigest() for spans in base], pa.string())
            return pa.record_batch([batch.column(0), *counts, sha, pa.array([say(s) for s in found], pa.string())], names=[x.split()[0] for x in SCANNED.split(", ")])

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCANNED)
