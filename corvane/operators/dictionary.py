"""Dictionary scans: which terms a text holds, and where.

The terms are compiled once for each worker into an Aho-Corasick automaton, so a text is read once whatever the number of terms; a join by
`contains` would read it once for each. The dictionary is broadcast within a checked bound.

`longest` keeps, from left to right, the longest of overlapping matches; Latin terms must stand between word borders. Terms of up to three
characters or all in capitals match in their own case, others in any. Null texts and terms give nothing; an empty dictionary finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import checked_broadcast_rows

HITS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("key", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def own_case(term: str) -> bool:
    return len(term) <= 3 or term.isupper() and term.isascii()


class Scanner:
    """terms: (term, key)."""

    def __init__(self, terms: tuple[tuple[str, str], ...], longest: bool, borders: bool, any_case: bool = False):
        self.longest, self.borders = longest, borders
        self.parts = []
        for exact in (False, True):
            a = ahocorasick.Automaton()
            table: dict[str, list[tuple[str, str]]] = {}
            for t, k in terms:
                if t and (own_case(t) and not any_case) == exact:
                    table.setdefault(t if exact else t.lower(), []).append((t, k))
            for form, found in table.items():
                a.add_word(form, (form, sorted(found)))
            if table:
                a.make_automaton()
                self.parts.append((exact, a))

    def __call__(self, text: str | None) -> list[dict]:
        if not text:
            return []
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = []
        for exact, a in self.parts:
            s = text if exact else low
            for last, (form, terms) in a.iter(s):
                start, end = last - len(form) + 1, last + 1
                if self.borders and (start and word(s[start - 1]) and word(s[start]) or end < len(s) and word(s[end]) and word(s[end - 1])):
                    continue
                found += [(start, end, t, k) for t, k in terms]
        found.sort(key=lambda m: (m[0], -m[1], m[3], m[2]))
        if self.longest:
            kept, reach, span = [], 0, None
            for m in found:
                if m[0] >= reach or (m[0], m[1]) == span:
                    kept.append(m)
                    reach, span = m[1], (m[0], m[1])
            found = kept
        return [{"term": t, "key": k, "start": a, "end": b} for a, b, t, k in found]


def word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


@lru_cache(8)
def scanner(terms: tuple, longest: bool, borders: bool, any_case: bool) -> Scanner:
    return Scanner(terms, longest, borders, any_case)


def scan(df: DataFrame, text_col: str, terms: DataFrame, longest: bool = True, borders: bool = True, any_case: bool = False, most_terms: int = 500_000) -> DataFrame:
    """The frame with one row for each hit: its columns and term, key, start, end. terms: (term, key)."""
    rows = checked_broadcast_rows(terms.select("term", "key").where(F.col("term").isNotNull() & (F.trim("term") != "")).distinct(), most_terms, "the dictionary")
    table = df.sparkSession.sparkContext.broadcast(tuple(sorted((r.term, r.key) for r in rows)))

    @F.pandas_udf(HITS)
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = scanner(table.value, longest, borders, any_case)
        for t in texts:
            yield t.map(s)

    return df.withColumn("_hits", hits(text_col)).where(F.size("_hits") > 0).select(*df.columns, F.inline("_hits"))
