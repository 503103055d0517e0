"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query on trigrams is derived that every match
fulfils. The rows of a segment (a slice of an Arrow batch) are indexed: for
each trigram that some rule asks for, the sorted rows that hold it. A rule's
query intersects and unites these postings, and only the rows that are left go
to its regex. A rule without a mandatory trigram scans every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, others, schema_of, slices, taken, utf8

ANY = ("any",)
MOST = 64


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: a regex on UTF-8 bytes. group: what must be of least bytes or more."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 0


# The base rules as they are asked for.
BASE_RULES = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", rb"[0-9a-f]+", 0, 24),
)
#: A key from its BEGIN line through the END line of the same name, whatever is between (but no other BEGIN). Without that END line:
#: through all base64 lines and header fields that follow. Line breaks may be written as \\n or \\r, or be spaces before long runs.
PRIVATE_KEY = (
    rb"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----|"
    rb"(?:(?:\s|\\[rn])++(?:(?:Proc-Type|DEK-Info|Comment|Version|Charset|Hash):[^\r\n\\]*+|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:\Z|[\r\n]|\\[rn]))))*+)"
)
# Public formats of keys and tokens.
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("host_token", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Not within a longer run of its signs, and each run is taken at once: a text of many openings stays linear.
    Rule("web_token", rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("url_login", rb"[a-z]{2,16}://[A-Za-z0-9._-]+:[^\x00-\x20:/@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES


def all_of(queries: list) -> tuple:
    queries = list(dict.fromkeys(q for q in queries if q != ANY))
    return ANY if not queries else queries[0] if len(queries) == 1 else ("and", *queries)


def one_of(queries: list) -> tuple:
    queries = list(dict.fromkeys(queries))
    return ANY if ANY in queries or not queries else queries[0] if len(queries) == 1 else ("or", *queries)


def of_strings(strings: set[bytes]) -> tuple:
    """What holds if one of the strings occurs."""
    return one_of([all_of([("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: bytes) -> tuple:
    """A Boolean query on lower-cased trigrams: ANY, ("has", t), ("and", ...) or ("or", ...).

    It holds for every text with a match. Sets of up to MOST strings that a
    part can match exactly are carried along and joined; where a part is open
    (a star, a wide class), what is known so far turns into trigrams.
    """

    def walk(items) -> tuple[set[bytes] | None, tuple]:
        """(all strings that the items match, if few; else None), and a query besides."""
        known, found, closed = {b""}, [], True
        for op, arg in items:
            strings, query = one(str(op), arg)
            if strings is not None and len(joined := {a + b for a in known for b in strings}) <= MOST:
                known = joined
                continue
            found += [of_strings(known), query] + ([of_strings(strings)] if strings is not None else [])
            known, closed = {b""}, False
        return (known, ANY) if closed else (None, all_of([*found, of_strings(known)]))

    def one(op: str, arg) -> tuple[set[bytes] | None, tuple]:
        if op == "LITERAL":
            return {bytes([arg]).lower()}, ANY
        if op == "AT":
            return {b""}, ANY
        if op == "SUBPATTERN":
            return walk(arg[3])
        if op == "BRANCH":
            parts = [walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts) and len(union := set().union(*(s for s, _ in parts))) <= MOST:
                return union, ANY
            return None, one_of([q if s is None else of_strings(s) for s, q in parts])
        if op == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            chars = {c for k, v in arg for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])}
            return ({bytes([c]).lower() for c in chars}, ANY) if len(chars) <= 8 else (None, ANY)
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            strings, query = walk(inner)
            if strings is None:
                return None, query if low else ANY
            if high == low == 1:
                return strings, ANY
            if low == 0 and high == 1 and len(strings) < MOST:
                return strings | {b""}, ANY
            repeated = {b""}
            for _ in range(min(low, 3)):
                repeated = {a + b for a in repeated for b in strings}
                if len(repeated) > MOST:
                    return None, ANY
            return (repeated, ANY) if low == high <= 3 else (None, of_strings(repeated))
        return None, ANY

    strings, query = walk(parser.parse(pattern))
    return query if strings is None else of_strings(strings)


def trigrams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams_of, query[1:])) if query != ANY else set()


class Segment:
    """Postings of the wanted trigrams over the rows of one slice."""

    BLOCK = 1 << 22

    def __init__(self, texts: list[bytes], ids: np.ndarray, names: dict[bytes, int]):
        self.n, self.names = len(texts), names
        buf = np.frombuffer(b"\xff".join(texts).lower(), np.uint8)  # \xff is in no UTF-8 text
        ends = np.cumsum([len(t) + 1 for t in texts])
        pairs = [np.zeros(0, np.int64)]
        for at in range(0, len(buf), self.BLOCK):
            b = buf[at : at + self.BLOCK + 2].astype(np.int32)
            t = ids[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            hit = np.flatnonzero(t >= 0)
            pairs.append(np.unique(t[hit].astype(np.int64) * self.n + np.searchsorted(ends, at + hit, "right")))
        found = np.unique(np.concatenate(pairs))
        self.cuts = np.searchsorted(found, np.arange(len(names) + 1) * self.n)
        self.rows = found % max(1, self.n)

    def postings(self, trigram: bytes) -> np.ndarray:
        k = self.names[trigram]
        return self.rows[self.cuts[k] : self.cuts[k + 1]]

    def search(self, query: tuple) -> np.ndarray:
        """Sorted rows that fulfil the query."""
        if query == ANY:
            return np.arange(self.n)
        if query[0] == "has":
            return self.postings(query[1])
        parts = sorted((self.search(q) for q in query[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


@cache
def prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    names = {t: k for k, t in enumerate(sorted(set().union(*map(trigrams_of, queries))))}
    ids = np.full(1 << 24, -1, np.int16)
    for t, k in names.items():
        ids[t[0] << 16 | t[1] << 8 | t[2]] = k
    # A run's greedy match is as long as it gets, so a rule of one repeated class can ask for its length at once.
    whole = [re.fullmatch(rb"(\[[^]]*\])\+", r.pattern) for r in rules]
    found = [re.compile(w[1] + b"{%d,}" % r.least if w and r.group == 0 else r.pattern) for r, w in zip(rules, whole)]
    return queries, names, ids, found


def find_spans(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """For each text its (kind, start, end) in code points, by start and then by the order of the rules."""
    queries, names, ids, patterns = prepared(rules)
    segment = Segment(texts, ids, names)
    out: list[list] = [[] for _ in texts]
    for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns)):
        for row in segment.search(query).tolist():
            for m in pattern.finditer(texts[row]):
                if len(m[rule.group]) >= rule.least:
                    out[row].append((m.start(), k, m.end()))
    for row, spans in enumerate(out):
        if spans:
            text, spans = texts[row], sorted(spans)
            if not text.isascii():
                lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                point = lambda at, lead=lead: int(lead[at - 1]) if at else 0
                spans = [(point(a), k, point(b)) for a, k, b in spans]
            out[row] = [(rules[k].kind, a, b) for a, k, b in spans]
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with spans (array of kind, start, end; code points) in place of text; null and empty texts have none.

    Spans of different kinds may overlap; spans that start together are in the
    order of the rules. Repeated rows have the same spans, and an empty table
    gives an empty result. A column of that name is replaced. No shuffle.
    """
    rest = others(docs, text, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in find_spans(utf8(b, text), rules)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(spans, SPANS)], names=[*rest, "spans"])

    return mapped(docs, [*rest, text], run, schema_of(docs, rest, "spans array<struct<kind:string,start:bigint,end:bigint>>"))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """text with each span (or run of overlapping spans) as a mark of its first kind."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], mark.format(kind)]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with secrets in text masked; other rows and columns stay as they are, nulls too."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            old = b.column(at).to_pylist()
            new = [redacted(t, s) if s else t for t, s in zip(old, find_spans(utf8(b, text), rules))]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return mapped(docs, docs.columns, run, docs.schema)
