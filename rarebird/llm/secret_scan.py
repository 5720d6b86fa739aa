"""Secret scans with a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived that every
match must satisfy. A block of rows is indexed by the trigrams that the queries
name, each with the set of rows that hold it; the queries are evaluated on these
postings by union and intersection, and only the rows left are searched with the
pattern. A rule whose pattern has no mandatory trigram scans every row.

The index is kept a block (one Arrow batch) at a time: no posting leaves its
task, so nothing is shuffled, no common trigram meets in one task, and a lost
executor costs its own blocks only.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.llm.common import free_name, text_or_empty

# The base kinds with their patterns and least lengths, in order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    ("assign", ASSIGN, 2, 12, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, False),
    ("hex", r"[0-9a-f]+", 0, 16, False),
)
# A private key goes on to its END line; without one, over its headers and runs of base64.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:\s*\n(?:Proc-Type|DEK-Info):[^\n]*)*"
    r"(?:(?:(?:\s|\\[rn])+[A-Za-z0-9+/=]{16,})+(?:(?:\s|\\[rn])+[A-Za-z0-9+/=]+(?=\s*(?:\n|\Z)))?)?)"
)
# Further kinds: published shapes of keys and tokens.
MORE_RULES = (
    ("private_key", PRIVATE_KEY, 0, 1, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1, False),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 1, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
)
# End of the fixed values.
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(r[0] for r in BASE_RULES)

# A query is True (any row), a trigram, ("and", parts) or ("or", parts).
Query = bool | str | tuple
#: Exact alternatives kept while a pattern is read; beyond it they become a query.
_MOST_EXACT = 64


def _and(*parts: Query) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _or(*parts: Query) -> Query:
    kept = list(dict.fromkeys(parts))
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    """One of these strings stands in the text."""
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings))) if strings else True


def _read(items) -> tuple[set[str] | None, Query]:
    """All strings the items match, if few, and a query that their matches satisfy."""
    run: set[str] = {""}
    queries: list[Query] = []

    def close() -> None:
        nonlocal run
        queries.append(_of_strings(run))
        run = {""}

    exact = True
    for op, value in items:
        strings, query = _one(op, value)
        if strings is not None and len(run) * len(strings) <= _MOST_EXACT:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        close()
        queries.append(query)
        if strings is not None:
            run = strings
    if exact:
        return run, _of_strings(run)
    close()
    return None, _and(*queries)


def _one(op, value) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(value).lower()}, True
    if op is C.IN:
        if all(k is C.LITERAL for k, _ in value):
            return {chr(v).lower() for _, v in value}, True
        return None, True
    if op is C.SUBPATTERN:
        strings, query = _read(value[3])
        return strings, query
    if op is C.BRANCH:
        read = [_read(branch) for branch in value[1]]
        if all(s is not None for s, _ in read) and sum(len(s) for s, _ in read) <= _MOST_EXACT:
            return set().union(*(s for s, _ in read)), True
        return None, _or(*(q for _, q in read))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _read(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, True
        if strings is not None and least == most and len(strings) ** least <= _MOST_EXACT:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, _of_strings(out)
        return None, query if least else True
    if op is C.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> Query:
    """The query over trigrams of the lower-cased text that every match satisfies."""
    return _read(_parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams(q) for q in query[1]))


def postings(texts: list[str], wanted: set[str]) -> dict[str, set[int]]:
    """Which rows of the block hold which of the wanted trigrams."""
    index: dict[str, set[int]] = {t: set() for t in wanted}
    for row, text in enumerate(texts):
        low = text.lower()
        for t in wanted:
            if t in low:
                index[t].add(row)
    return index


def candidates(query: Query, index: dict[str, set[int]], n: int) -> set[int]:
    if query is True:
        return set(range(n))
    if isinstance(query, str):
        return index[query]
    parts = [candidates(q, index, n) for q in query[1]]
    return set.union(*parts) if query[0] == "or" else set.intersection(*parts)


def compiled(rules) -> list[tuple]:
    # Without the ASCII flag, either case would also match the long s and the Kelvin sign.
    return [
        (kind, re.compile(p, re.ASCII | (re.IGNORECASE if either else 0)), group, least, trigram_query(p))
        for kind, p, group, least, either in rules
    ]


def scan_block(texts: list[str], rules: list[tuple]) -> list[list[tuple[int, int, int]]]:
    """(start, end, number of the rule) of all finds in each text, by start, then rule."""
    index = postings(texts, set().union(*(trigrams(r[4]) for r in rules)) if rules else set())
    found: list[list] = [[] for _ in texts]
    for k, (_, pattern, group, least, query) in enumerate(rules):
        for row in candidates(query, index, len(texts)):
            for m in pattern.finditer(texts[row]):
                if m.end(group) - m.start(group) >= least:
                    found[row].append((m.start(), m.end(), k))
    for spans in found:
        spans.sort(key=lambda s: (s[0], s[2]))
    return found


def _finder(rules) -> Column:
    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def find(texts: pd.Series) -> pd.Series:
        made = compiled(rules)
        names = [r[0] for r in rules]
        found = scan_block(texts.tolist(), made)
        return pd.Series([[{"kind": names[k], "start": a, "end": b} for a, b, k in spans] for spans in found])

    return find


def secret_spans(docs: DataFrame, text: str = "text", rules=RULES, into: str = "spans") -> DataFrame:
    """All rows and columns, and ``into``: the finds, by start, then in the order of the rules.

    Ends are exclusive; both count code points. Null and empty texts have none.
    Finds of different kinds may overlap. Rows are taken one by one, so repeated
    rows and missing ids change nothing; a column named ``into`` is replaced.
    """
    return docs.withColumn(into, _finder(tuple(rules))(text_or_empty(text)))


def mask(docs: DataFrame, text: str = "text", rules=RULES, sign: str = "[SECRET]") -> DataFrame:
    """The rows with each stretch of found characters replaced by ``sign``; null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        whole = [v if v is not None else "" for v in values]
        out = []
        for value, spans in zip(values, scan_block(whole, compiled(rules))):
            if spans:
                parts, end = [], 0
                for a, b, _ in spans:
                    if a >= end:
                        parts += [value[end:a], sign]
                    end = max(end, b)
                value = "".join([*parts, value[end:]])
            out.append(value)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, masked(text))


def masked_documents(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``mask``, with the length of the text counted anew in n_chars, if there is such a column."""
    out = mask(docs, text, rules)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def secret_report(docs: DataFrame, text: str = "text", id_column: str = "doc_id", rules=RULES) -> DataFrame:
    """Per row: the id, counts of the base kinds, a digest of their spans, all spans as text."""
    spans = free_name(docs, "spans")
    rows = secret_spans(docs.select(id_column, text), text, rules, spans)
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda found: F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return rows.select(id_column, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))
