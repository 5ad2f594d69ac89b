"""Name -> (query, SQL twin) of every operator outside the llm subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from corvane.plans import checks, corpus, fields, ledger, matching, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (fields, text, ledger, matching, corpus, checks):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
