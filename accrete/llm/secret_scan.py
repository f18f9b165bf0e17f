"""Secret scans with a trigram index.

From every rule's regular expression a Boolean trigram query is derived: a text that matches must hold, for one of the
alternatives, all of its trigrams (in lower case; rules that ignore case and rules that don't are asked alike, as this
only lets more candidates through). Each Arrow batch is indexed as a segment: per trigram that some rule asks for, the
posting list of the rows that hold it. Postings are intersected and united as a rule's query says, and only the rows that
remain are searched with the regular expression. A rule without mandatory trigrams searches every row. Segments are
independent, so nothing is shuffled and a lost executor costs one batch.

Base rules are searched as given, leftmost and non-overlapping, and then dropped if too short; more rules add spans of
further kinds. Spans are code points, end exclusive, ordered by start and then by kind as listed in RULES.

Defined results: null text is empty and has no spans; whole texts are searched; repeated rows are searched alike; other
columns are carried along, one named spans is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as ops
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, ignores case, group whose length counts, least length. The first three are the base.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 18),
    ("hex", r"[0-9a-f]+", False, 0, 16),
    ("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", False, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", False, 0, 15),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", False, 0, 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False, 0, 30),
    ("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", True, 0, 27),
)
BASE_KINDS = ("assign", "access", "hex")
#: More spellings of a part than this are not told apart: the part then asks for nothing.
MOST_SPELLINGS = 64
SPANS = "array<struct<kind string, start int, end int>>"

#: A query is True (any text) or a set of alternatives, each the set of trigrams it needs.
Query = bool | frozenset[frozenset[str]]


def _spellings(node) -> set[str] | None:
    """All strings that a parsed part can match, if they are few; None otherwise."""
    op, arg = node
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= 4:
        return {chr(a).lower() for _, a in arg}
    if op is ops.SUBPATTERN:
        return _all_spellings(arg[-1])
    if op is ops.BRANCH:
        parts = [_all_spellings(p) for p in arg[1]]
        got = set().union(*parts) if None not in parts else None
        return got if got is not None and len(got) <= MOST_SPELLINGS else None
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[1] != ops.MAXREPEAT and arg[1] <= 2:
        inner = _all_spellings(arg[2])
        if inner is None:
            return None
        return {x for k in range(arg[0], arg[1] + 1) for x in ([""] if k == 0 else inner if k == 1 else [a + b for a in inner for b in inner])}
    return {""} if op is ops.AT else None


def _all_spellings(nodes) -> set[str] | None:
    got = {""}
    for node in nodes:
        one = _spellings(node)
        if one is None or len(got) * len(one) > MOST_SPELLINGS:
            return None
        got = {a + b for a in got for b in one}
    return got


def _and(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return frozenset(x | y for x in a for y in b)


def trigram_query(pattern: str) -> Query:
    """What a text must hold to match the pattern; True if the pattern has no mandatory trigram."""

    def of(nodes) -> Query:
        query: Query = True
        run = {""}  # the spellings of the parts since the last that has too many

        def close() -> Query:
            grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
            return True if not all(grams) else frozenset(grams)

        for node in nodes:
            one = _spellings(node)
            if one is not None and len(run) * len(one) <= MOST_SPELLINGS:
                run = {a + b for a in run for b in one}
                continue
            query, run = _and(query, close()), {""}
            op, arg = node
            if op is ops.SUBPATTERN:
                query = _and(query, of(arg[-1]))
            elif op is ops.BRANCH:
                parts = [of(p) for p in arg[1]]
                query = _and(query, True if True in parts else frozenset().union(*parts))
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] >= 1:
                query = _and(query, of(arg[2]))
        return _and(query, close())

    return of(parser.parse(pattern))


class Rules:
    """Compiled rules and their trigram queries."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(p, re.ASCII | (re.IGNORECASE if fold else 0)), group, least) for kind, p, fold, group, least in rules]
        self.queries = [trigram_query(p) for _, p, *_ in rules]
        self.trigrams = sorted({t for q in self.queries if q is not True for alternative in q for t in alternative})

    def postings(self, texts: list[str]) -> dict[str, set[int]]:
        """The rows of a segment that hold each trigram."""
        lower = [t.lower() for t in texts]
        return {g: {i for i, t in enumerate(lower) if g in t} for g in self.trigrams}

    def candidates(self, query: Query, postings: dict[str, set[int]], n: int):
        if query is True:
            return range(n)
        return sorted(set().union(*(set.intersection(*(postings[t] for t in alternative)) for alternative in query)))

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text, in order."""
        postings = self.postings(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, ((_, regex, group, least), query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in self.candidates(query, postings, len(texts)):
                found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if m.end(group) - m.start(group) >= least]
        return [[(self.rules[k][0], start, end) for start, k, end in sorted(spans)] for spans in found]


def scan(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with spans: kind, start and end of each secret found in the text column."""

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = Rules(rules)
        for texts in it:
            found = compiled.scan(texts.fillna("").tolist())
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], dtype=object)

    return docs.withColumn("spans", F.pandas_udf(batches, SPANS)(F.col(text)))
