"""Visually identical text with different characters (problem 2).

The mapping is a transducer over grapheme clusters, compiled once: rules generate the width forms, the compatibility ideographs and
radicals, the presentation ligatures, the styled letters (<font>), the <compat> letters and Roman numerals, the spaces and the characters of no width from Unicode's own data, and a fixed list adds the
look-alike letters of Cyrillic, Greek, Armenian, Cherokee, Lisu, Coptic, Deseret, kana and the small capitals that have the shape of a small letter, and
sequences of several clusters. `compile_mapping` checks it for conflicts (one source, two targets) and closes it, so that no target holds a source
and one pass is enough. The pass walks the text from left to right, takes the longest mapped sequence of whole clusters at each place, and
otherwise composes the cluster (NFC). Clusters repeat, so each worker keeps those it has seen in a bounded memo. Case, accents,
superscripts, visible punctuation, ordinary spaces, tabs and line breaks stay as they are.

Cases: null gives null, an empty text an empty one; texts of any length are handled whole; `pairs` takes no null or blank value and no
value without an id, and repeated rows count once. The number of pairs is that of the definition: rows with the same characters are never
paired, so a group of exact copies costs nothing.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import cut

# Letters of other scripts, each with the Latin letter (or ideograph, or mark) it looks like. Each line gives the letters of one
# script and, in the same order, what they look like.
SAME_SHAPE = (
    ("АВЕКМНОРСТУХЅІЈԌԚԜҮӀ", "ABEKMHOPCTYXSIJGQWYI"), ("аеорсухѕіјԁһԛԝӏѵү", "aeopcyxsijdhqwlvy"), ("ёЁїЇ", "ëËïÏ"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"), ("ονιρϲϳυαɑɡı", "ovipcjuaagi"),
    ("ՍՏՕօհոսցզյ", "USOohnugqj"), ("ᎠᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DTiYAJEWMHYGZRWVSLCPKB"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"), ("ⲂⲎⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥⲭ", "BHKMNOPCTXopcx"), ("ᴄᴏꜱᴜᴠᴡᴢ", "cosuvwz"), ("𐐄𐐬", "Oo"),
    ("エカタトニハロー", "工力夕卜二八口一"), ("ヘ", "へ"), ("∆∑∏", "ΔΣΠ"), ("‐‑ː∕⁄ʼʹ∶․", "--://'':."),
)
LOOK_ALIKE = {a: b for letters, shapes in SAME_SHAPE for a, b in zip(letters, shapes, strict=True)}
# Sequences of several clusters: a ring, a small o or a masculine sign before the letter of a temperature scale is a degree sign.
SEQUENCES = {ring + scale: "°" + scale for ring in "˚ᵒº∘" for scale in "CF"} | {"℃": "°C", "℉": "°F"}
# Compatibility letters that do not look like the letter they stand for: long s, letters with another shape, jamo that NFC would join.
UNLIKE = frozenset("ſẚϐϑϒϕϖϰϱϵ﬩") | {chr(c) for c in range(0x3131, 0x318F)}
MEMO = 200_000


def rule_mapping() -> dict[str, str]:
    """What follows from Unicode's data: compatibility forms that differ in nothing a reader sees, spaces and characters of no width."""
    out: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind, form = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            out[ch] = ""
        elif kind == "Zs" and ch != " ":
            out[ch] = " "
        elif form.startswith(("<wide>", "<narrow>")) or 0x2E80 <= cp <= 0x2FDF or 0xF900 <= cp <= 0xFAFF or 0x2F800 <= cp <= 0x2FA1F or 0xFB00 <= cp <= 0xFB06:
            if (to := unicodedata.normalize("NFKC", ch)) != ch:
                out[ch] = to
        elif ch not in UNLIKE and ch not in LOOK_ALIKE and (form.startswith("<font>") or form.startswith("<compat>") and (kind[0] == "L" or kind == "Nl")):
            out[ch] = "".join(chr(int(x, 16)) for x in form.split()[1:])  # one step, so that a styled letter of another shape keeps that shape
    return out


def compile_mapping(*tables: dict[str, str]) -> dict[str, str]:
    """One closed table from several. Raises where they give one source two targets, or where a target leads back to its source."""
    table: dict[str, str] = {}
    for t in tables:
        for k, v in t.items():
            k = unicodedata.normalize("NFC", k)
            if k == v:  # composition alone does it
                continue
            if table.setdefault(k, v) != v:
                raise ValueError(f"{k!r} is mapped to {table[k]!r} and to {v!r}")
    for k in table:
        seen, v = {k}, table[k]
        while (w := "".join(table.get(c, c) for c in v)) != v:
            if w in seen:
                raise ValueError(f"{k!r} leads back to itself")
            seen.add(v)
            v = w
        table[k] = unicodedata.normalize("NFC", v)
    return table


class Transducer:
    """Longest match over grapheme clusters. Sequences longer than one cluster are alternatives of one pattern, longest first."""

    def __init__(self, table: dict[str, str]):
        self.table, self.memo = table, {}
        either = lambda c: f"(?:{regex.escape(c)}|{regex.escape(d)})" if (d := unicodedata.normalize("NFD", c)) != c else regex.escape(c)
        clusters = {k: regex.findall(r"\X", k) for k in table}
        long = sorted((k for k in table if len(clusters[k]) > 1), key=lambda k: (-len(clusters[k]), k))
        self.unit = regex.compile("|".join([*("".join(map(either, clusters[k])) + r"(?![\p{M}\u200d])" for k in long), r"\X"]))

    def cluster(self, unit: str) -> str:
        if (out := self.memo.get(unit)) is None:
            nfc = unicodedata.normalize("NFC", unit)
            out = self.table.get(nfc)
            if out is None:
                out = unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in nfc))))
            if len(self.memo) < MEMO:
                self.memo[unit] = out
        return out

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return unicodedata.normalize("NFC", self.unit.sub(lambda m: self.cluster(m[0]), text))


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer(compile_mapping(rule_mapping(), LOOK_ALIKE, SEQUENCES))


@F.pandas_udf(T.StringType())
def one_form(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The one form of each text; an iterator, so that a worker compiles the table once."""
    t = transducer()
    for s in texts:
        yield s.map(t, na_action="ignore")


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame with each named column brought to its one form."""
    return df.withColumns({c: one_form(F.col(c)) for c in columns})


def variants(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, raw): distinct rows with a non-blank value; the form as a 128-bit and the characters as a 64-bit hash, so no text is shuffled."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).where(F.col("id").isNotNull() & F.col("raw").rlike(r"[^\s]"))
    return rows.select("id", F.unhex(F.md5(one_form("raw"))).alias("form"), F.xxhash64("raw").alias("raw")).distinct()


def classes(df: DataFrame, id_col: str, text_col: str, field_name: str) -> DataFrame:
    """(field_name, id, class_id, spelling_id): every row whose value looks like another one in other characters. class_id is the smallest id of its
    form, spelling_id the smallest id with its very characters; so the spellings of a class are its representatives, and the size of the result
    is that of the input, whatever the number of pairs."""
    v = cut(variants(df, id_col, text_col))
    spellings = v.groupBy("form", "raw").agg(F.min("id").alias("spelling_id"))
    forms = spellings.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("spelling_id").alias("class_id")).where(F.col("n") > 1)
    known = spellings.join(forms, "form").select("form", "raw", "class_id", "spelling_id")
    return v.join(known, ["form", "raw"]).select(F.lit(field_name).alias("field_name"), "id", "class_id", "spelling_id")


def pairs(df: DataFrame, id_col: str, text_col: str, field_name: str) -> DataFrame:
    """(field_name, id_a, id_b): two ids whose values have one form but not the same characters; id_a < id_b.

    Spellings are paired before rows: a form with one spelling leaves first, the few spellings of each other form meet, and only then each
    pair of spellings gets its rows. Rows with the same characters never meet, so a form that a third of all rows share costs what its
    result has, and AQE splits it over tasks.
    """
    v = cut(variants(df, id_col, text_col))  # identifiers and hashes: the texts are brought to their form once for the four uses below
    spellings = v.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    both = spellings.select("form", F.col("raw").alias("raw_a")).join(spellings.select("form", F.col("raw").alias("raw_b")), "form").where(F.col("raw_a") < F.col("raw_b"))
    a, b = v.select("form", F.col("raw").alias("raw_a"), F.col("id").alias("a")), v.select("form", F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    found = both.join(a, ["form", "raw_a"]).join(b, ["form", "raw_b"]).where(F.col("a") != F.col("b"))
    return found.select(F.lit(field_name).alias("field_name"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
