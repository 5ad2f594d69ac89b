"""Several values packed in one field (problem 3).

A parsing expression grammar, tried in this order at each place:

    field   <- item (DELIM item)*
    item    <- SPACE* (quoted SPACE* &(DELIM / END) / bare)
    quoted  <- OPEN (CLOSE CLOSE / !CLOSE .)* CLOSE        doubled closing quotes stand for one
    bare    <- (bracket / guarded / !DELIM .)*
    bracket <- '(' (bracket / !')' .)* ')'                 and the other pairs; inside, nothing divides
    guarded <- DIGIT ',' DIGIT / NONSPACE '/' NONSPACE     marks that belong to a term
    DELIM   <- one of | ; , tab, line break and their full-width and Chinese forms, or a '/' with white space around it

Where a quote or a bracket is not closed, or a closing quote is followed by something else, the alternative fails, the parser goes back to
where it began and takes it as bare text, and the value carries an error flag: `quote` or `bracket`.

Cases: null or blank gives no row; empty values between delimiters get no position; a value repeated in a field comes out at each of its
positions; texts of any length are parsed whole, in linear time: where the brackets close is worked out once for the text, from its end, and the
closing mark at which a quote failed is remembered for the opening marks before it. A bracket that is not closed leaves later ones of its kind alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters, quotes with the mark that closes them, brackets with the mark that closes them.
DELIMITERS = frozenset("|｜;；,，、\n\r\t")
QUOTES = {'"': '"', "“": "”", "„": "“", "「": "」", "『": "』", "«": "»", "＂": "＂"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】", "〔": "〕"}
BLANK = " \t\r\n\x0b\x0c" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
ITEMS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType()), T.StructField("error", T.StringType())]))


def closed_brackets(text: str) -> dict[int, int]:
    """Place of each opening bracket that is closed -> place of the mark that closes it: the first one behind it that is in no closed bracket."""
    kinds = {BRACKETS[c] for c in set(text) & BRACKETS.keys()}
    if not kinds:
        return {}
    out: dict[int, int] = {}
    first = {c: [-1] * (len(text) + 1) for c in kinds}  # from each place on, where c closes
    for i in range(len(text) - 1, -1, -1):
        c = text[i]
        if c in BRACKETS and (j := first[BRACKETS[c]][i + 1]) >= 0:
            out[i] = j
        behind = out[i] + 1 if i in out else i + 1
        for k, places in first.items():
            places[i] = i if c == k else places[behind]
    return out


class Parser:
    """One parse of one text. Positions are offsets into the text."""

    def __init__(self, text: str):
        self.text, self.end, self.failed = text, len(text), {}
        self.closed = closed_brackets(text)

    def delimiter(self, i: int) -> bool:
        t, c = self.text, self.text[i]
        if c == "/" or c == "／":
            return (i == 0 or t[i - 1] in BLANK) and (i + 1 == self.end or t[i + 1] in BLANK)
        if c not in DELIMITERS:
            return False
        return not (c in ",，" and 0 < i < self.end - 1 and t[i - 1].isdigit() and t[i + 1].isdigit())

    def skip(self, i: int) -> int:
        while i < self.end and self.text[i] in BLANK and self.text[i] not in DELIMITERS:
            i += 1
        return i

    def quoted(self, i: int) -> tuple[int, str] | None:
        opening, j, out = self.text[i], i + 1, []
        close = QUOTES[opening]
        if i < self.failed.get(close, 0):
            return None
        while (k := self.text.find(close, j)) >= 0:
            out.append(self.text[j:k])
            if self.text.startswith(close, k + 1):
                out.append(close)
                j = k + 2
                continue
            after = self.skip(k + 1)
            if after == self.end or self.delimiter(after):
                return after, "".join(out)
            break
        if opening != close:  # what opens later, but before this mark, meets the same one; a mark that opens and closes is met at once
            self.failed[close] = k if k >= 0 else self.end
        return None

    def bare(self, i: int) -> tuple[int, str, str | None]:
        start, error = i, None
        while i < self.end and not self.delimiter(i):
            c = self.text[i]
            if c in BRACKETS:
                if i in self.closed:
                    i = self.closed[i] + 1
                    continue
                error = error or "bracket"
            elif c in QUOTES and (i == start or c == '"'):
                error = "quote"
            i += 1
        return i, self.text[start:i], error

    def items(self) -> list[dict]:
        out, i = [], 0
        while i <= self.end:
            i = self.skip(i)
            if i < self.end and self.text[i] in QUOTES and (q := self.quoted(i)):
                (i, val), error = q, None
            else:
                i, val, error = self.bare(i)
            if val := val.strip(BLANK):
                out.append({"pos": len(out) + 1, "val": val, "error": error})
            i += 1  # the delimiter
        return out


def parse(text: str | None) -> list[dict]:
    return [] if text is None else Parser(text).items()


@F.pandas_udf(ITEMS)
def unpack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: parse(x))


def values(df: DataFrame, id_col: str, text_col: str | Column, field_name: str, least: int = 1) -> DataFrame:
    """(field_name, row_id, pos, val, error): each value of each field that holds `least` or more; rows repeated under one id count once."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = df.select(F.col(id_col).alias("row_id"), c.alias("text")).where(F.col("text").isNotNull() & (F.trim("text") != "")).distinct()
    items = rows.select("row_id", unpack("text").alias("items")).where(F.size("items") >= least)
    return items.select(F.lit(field_name).alias("field_name"), "row_id", F.inline("items"))
