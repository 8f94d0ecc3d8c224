"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must hold (letters folded to
lower case). The documents of a batch are one index segment: postings list, for each trigram that some query names, the
documents that hold it. A query's candidates are the intersections and unions of its postings; only they are searched
with the expression. Rules without mandatory trigrams are searched in every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_apart

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    keep: Callable[[re.Match], bool] | None = None
    base: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.finditer(self.pattern, text, self.flags)
        return [m.span() for m in found if self.keep is None or self.keep(m)]


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


def _long_access(m: re.Match) -> bool:
    return m.end() - m.start() >= 20


#: The first three are the base rules; their matches are never changed by the others.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, _long_value, True),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, _long_access, True),
    Rule("hex", r"[0-9a-f]{24,}", re.ASCII, None, True),  # the runs of 24 or more among the runs of [0-9a-f]
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


#: A query is None (anything), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: list[str]) -> Query:
    """What a text must hold if it holds one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else None


def _read(items) -> tuple[list[str] | None, Query]:
    """The strings that the items can match, if they are few, and the query that holds for any match."""
    strings: list[str] | None = [""]
    queries: list[Query] = []
    exact = True

    def broken() -> None:
        nonlocal strings
        queries.append(_of_strings(strings))
        strings = [""]

    def follow(more: list[str] | None) -> None:
        nonlocal strings, exact
        if more is None or len(strings) * len(more) > MOST_STRINGS:
            exact = False  # what stands before is in the queries now, and the strings are only the rest
            broken()
        if more is not None:
            strings = [a + b for a in strings for b in more] if len(strings) * len(more) <= MOST_STRINGS else list(more)

    for op, value in items:
        if op is sre.LITERAL:
            follow([chr(value).lower()])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            follow(sorted({chr(v).lower() for _, v in value}))
        elif op is sre.SUBPATTERN:
            inner, query = _read(value[-1])
            queries.append(query)
            exact = exact and inner is not None
            follow(inner)
        elif op is sre.BRANCH:
            read = [_read(branch) for branch in value[1]]
            if all(inner is not None for inner, _ in read):
                follow(sorted({s for inner, _ in read for s in inner}))
            else:
                queries.append(_any([_all([query, _of_strings(inner or [])]) for inner, query in read]))
                exact = False
                follow(None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[:2] == (0, 1) and _read(value[2])[0] is not None:
            follow(["", *_read(value[2])[0]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            inner, query = _read(value[2])
            queries.append(query)
            follow(inner)
            exact = False
            broken()
        else:
            exact = False
            broken()
    if not exact:
        queries.append(_of_strings(strings))
        return None, _all(queries)
    return strings, _all(queries)


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean query of a regular expression, over lower-cased trigrams; None if it has no mandatory trigram."""
    strings, query = _read(_parser.parse(pattern, flags))
    return _all([query, _of_strings(strings)]) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Segment:
    """Postings of the given ASCII trigrams over a batch of texts."""

    def __init__(self, texts: list[bytes], wanted: list[str]):
        self.n = len(texts)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        flat = np.frombuffer(b"\0".join(texts).lower() + b"\0", np.uint8)
        ends = np.cumsum(lengths)
        codes = flat[:-2].astype(np.uint32)
        codes <<= 8
        codes |= flat[1:-1]
        codes <<= 8
        codes |= flat[2:]
        number = {int.from_bytes(t.encode(), "big"): i + 1 for i, t in enumerate(wanted)}
        table = _lookup(tuple(sorted(number.items())))
        which = table[codes]
        at = np.nonzero(which)[0]
        pairs = np.unique(which[at].astype(np.int64) * self.n + np.searchsorted(ends, at, "right")) if len(at) else np.zeros(0, np.int64)
        trigram, doc = np.divmod(pairs, max(1, self.n))
        bounds = np.searchsorted(trigram, np.arange(1, len(wanted) + 2))
        self.postings = {t: doc[a:b] for t, a, b in zip(wanted, bounds[:-1], bounds[1:], strict=True)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        found = [self.candidates(q) for q in query[1]]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


_TABLES: dict = {}


def _lookup(number: tuple[tuple[int, int], ...]) -> np.ndarray:
    if number not in _TABLES:
        _TABLES.clear()
        table = np.zeros(1 << 24, np.uint16)
        for code, i in number:
            table[code] = i
        _TABLES[number] = table
    return _TABLES[number]


def _scan(rules: tuple[Rule, ...]):
    asked = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(trigrams, asked)))

    def spans(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if texts:
            segment = Segment([t.encode() for t in texts], wanted)
            for number, (rule, query) in enumerate(zip(rules, asked, strict=True)):
                for i in segment.candidates(query).tolist():
                    found[i].extend((a, number, b) for a, b in rule.spans(texts[i]))
        return [sorted(x) for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out, part, size = [], [], 0
            for text in [*texts, None]:  # segments of bounded size, whatever the batch
                if text is None or size > 1 << 22:
                    out += spans(part)
                    part, size = [], 0
                if text is not None:
                    part.append(text)
                    size += len(text)
            rows = [[{"kind": rules[k].kind, "start": a, "stop": b} for a, k, b in x] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and spans of every row: an array of (kind, start, stop) in code points, stop exclusive, by start and then by
    the order of the rules. A null text has no spans; rows that repeat an id give a row each; an empty table gives none. Texts
    are searched whole, however long. Ids must be whole numbers; other columns are ignored, whatever their names."""
    rows = columns_apart(docs, id_col, text_col).toDF("doc", "text").select(F.col("doc").cast("long"), "text")
    return rows.mapInArrow(_scan(tuple(rules)), "doc long, spans array<struct<kind:string,start:int,stop:int>>")
