"""Functions that have no expression in the JVM, as Arrow batches."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.amounts import amounts as numbers  # noqa: F401
from corvane.functions.amounts import drift

# What a signature and a protection label, in the order of their precedence.
LABELS = (
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("URL", r"(?i)https?://\S+"),
    ("DOI", r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"),
    ("REG", r"(?i)\b(?:CTR|NCT|CHICTR|EUCTR|ISRCTN)[-:]?[A-Z0-9-]{4,}\b"),
    ("DATE", r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b"),
    ("PCT", r"\b\d+(?:\.\d+)?%"),
    ("NUM", r"(?i)\b\d+(?:\.\d+)?(?:\s*(?:mg|kg|ml|mm|cm|µg|ng|IU))?\b"),
    ("CITE", r"\[\d+(?:[-,]\d+)*\]"),
    ("PH", r"\{\{[^}]+\}\}|⟦[^⟧]+⟧|%\([a-zA-Z0-9_]+\)s|\{[a-zA-Z0-9_]+\}"),
)
ABBREVIATIONS = frozenset("e.g i.e vs fig figs dr mr mrs ms prof al no nos approx ca cf eq ref refs inc ltd co st vol pp sec ed".split())
_LABELS = tuple((n, re.compile(p)) for n, p in LABELS)
# Where two labels begin at one place the shorter one counts: a number before the date, share or registration that begins with it.
_ANY = re.compile("|".join(f"(?P<{n}>{'(?i:' + p.removeprefix('(?i)') + ')'})" if p.startswith("(?i)") else f"(?P<{n}>{p})" for n, p in sorted(LABELS, key=lambda x: x[0] != "NUM")))


def signature(text: str | None) -> str:
    """Labels of what stands in a text, in order, by one scan from left to right."""
    return "|".join(m.lastgroup for m in _ANY.finditer(text or ""))


def protected(text: str) -> tuple[str, dict[str, str]]:
    """The text with guarded parts as numbered marks, and what each mark stands for. Longest-lived marks first, each part once."""
    table: dict[str, str] = {}
    for name, pattern in _LABELS:
        def mark(m: re.Match, name=name) -> str:
            key = f"⟦{name}{len(table) + 1}⟧"
            table[key] = m[0]
            return key

        pieces = re.split(r"(⟦[^⟧]+⟧)", text)
        text = "".join(p if p in table else pattern.sub(mark, p) for p in pieces)
    return text, table


def restored(text: str, table: dict[str, str]) -> str:
    return re.sub(r"⟦[A-Z]+\d+⟧", lambda m: table.get(m[0], m[0]), text)


def ends_sentence(text: str, i: int) -> bool:
    c = text[i]
    if c in "。！？!?；;":
        return True
    if c != ".":
        return False
    rest = text[i + 1 :].lstrip("”\"')]）】")
    if rest and not rest[0].isspace():
        return False
    rest = rest.lstrip()
    if not rest:
        return True
    before = re.search(r"[A-Za-z][A-Za-z.]*$", text[:i])
    if before and (before[0].lower().strip(".") in ABBREVIATIONS or len(before[0].strip(".")) == 1):
        return False
    return rest[0].isupper() or rest[0].isdigit() or rest[0] in "“\"'([（【" or "一" <= rest[0] <= "鿿"


def sentence_at(text: str, start: int, end: int) -> tuple[int, int]:
    """Bounds of the sentence that holds a span; abbreviations and decimals end none."""
    a = next((i + 1 for i in range(min(start, len(text)) - 1, -1, -1) if ends_sentence(text, i)), 0)
    b = next((i + 1 for i in range(min(end, len(text)), len(text)) if ends_sentence(text, i)), len(text))
    while a < b and text[a].isspace():
        a += 1
    return a, b


def json_size(value: dict[str, str]) -> int:
    return len(json.dumps(value, ensure_ascii=False).encode())


def chunks(segments: list[str], most: int) -> tuple[list[dict[str, str]], list[tuple[int, int]]]:
    """Segments packed greedily into JSON objects of at most `most` bytes, and the ranges that came from one segment each.

    A segment that is too large alone is cut at its line ends; a line that is too large stays whole, alone in its chunk.
    """
    pieces: list[str] = []
    ranges: list[tuple[int, int]] = []
    for s in segments:
        key = str(len(segments) + len(pieces))
        if json_size({key: s}) <= most:
            pieces.append(s)
            continue
        at, now = len(pieces), ""
        for line in s.splitlines(keepends=True):
            if json_size({key: now + line}) <= most:
                now += line
                continue
            if now:
                pieces.append(now)
            now = ""
            if json_size({key: line}) > most:
                pieces.append(line)
            else:
                now = line
        if now:
            pieces.append(now)
        if len(pieces) - at > 1:
            ranges.append((at, len(pieces)))
    out: list[dict[str, str]] = []
    for i, p in enumerate(pieces):
        if out and json_size(out[-1] | {str(i): p}) <= most:
            out[-1][str(i)] = p
        else:
            out.append({str(i): p})
    return out, ranges


def assembled(pieces: dict[str, str], count: int, ranges: list[tuple[int, int]]) -> list[str]:
    """Pieces back to segments; a missing piece raises, it is never filled in."""
    missing = [i for i in range(count) if str(i) not in pieces]
    if missing:
        raise ValueError(f"pieces {missing[:5]} are missing")
    starts, inside = dict(ranges), {i for a, b in ranges for i in range(a, b)}
    return ["".join(pieces[str(j)] for j in range(i, starts[i])) if i in starts else pieces[str(i)] for i in range(count) if i in starts or i not in inside]


def parse_response(text: str):
    """JSON out of a fenced block or the bare text, repaired where it can be; None where it is none."""
    m = re.search(r"```(?:json)?(.*?)(?:```|$)", text or "", re.S)
    body = m[1] if m else text
    try:
        return json.loads(body)
    except (TypeError, ValueError):
        return mended_json(body) if body else None


def mended_json(text: str):
    """A JSON value that was cut short or has commas before its ends: read from its first bracket, open strings and brackets closed."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, ends, i, quoted = [], [], start, False
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\" and i + 1 < len(text):
                out.append(text[i : i + 2])
                i += 2
                continue
            quoted = c != '"'
            out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c))
        elif c in "]}":
            drop_comma(out)
            if not ends or ends.pop() != c:
                return None
            out.append(c)
            if not ends:
                break
        else:
            quoted = c == '"'
            ends += {"{": "}", "[": "]"}.get(c, "")
            out.append(c)
        i += 1
    body = "".join(out) + '"' * quoted
    for tail in ("", "null"):  # cut behind a colon, or behind a key
        rest = re.sub(r"[\s,]+$", "", body) + (tail if body.rstrip().endswith(":") else ": null" if tail else "")
        try:
            return json.loads(rest + "".join(reversed(ends)))
        except ValueError:
            continue
    return None


def drop_comma(out: list[str]) -> None:
    k = len(out) - 1
    while k >= 0 and out[k].isspace():
        k -= 1
    if k >= 0 and out[k] == ",":
        del out[k]


def char_chunks(rows: list[str], most: int = 12_000) -> list[list[str]]:
    """Rows packed in order into chunks of at most `most` characters, line breaks included; a longer row stays whole, alone."""
    out: list[list[str]] = []
    size = 0
    for r in rows:
        if out and size + 1 + len(r) <= most:
            out[-1].append(r)
            size += 1 + len(r)
        else:
            out.append([r])
            size = len(r)
    return out


def distinct_by_containment(values: list[str]) -> list[str]:
    """Values that are really different: what another one contains, or equals without spaces, case and marks, is the same."""
    kept: list[tuple[str, str]] = []
    squashed = {(re.sub(r"[\W_]+", "", x.lower()), x) for x in values if x}
    for s, v in sorted(squashed, key=lambda x: (-len(x[0]), x)):
        if s and not any(s in t for t, _ in kept):
            kept.append((s, v))
    return [v for _, v in kept]


def register() -> dict:
    """The functions as pandas UDFs, made when a session is there."""

    @F.pandas_udf(T.StringType())
    def signature_of(s: pd.Series) -> pd.Series:
        return s.map(signature)

    @F.pandas_udf(T.StringType())
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    @F.pandas_udf(T.StructType([T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("added", T.ArrayType(T.StringType()))]))
    def number_drift(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([drift(x, y) for x, y in zip(a, b)], columns=["missing", "added"])

    @F.pandas_udf(T.BooleanType())
    def round_trip(s: pd.Series) -> pd.Series:
        return s.map(lambda x: restored(*protected(x)) == x).astype(bool)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def chunk_sizes(s: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([[json_size(c) for c in chunks(list(x), int(m))[0]] for x, m in zip(s, most)])

    @F.pandas_udf(T.StringType())
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="")) for x, y in zip(a, b)])

    @F.pandas_udf(T.StringType())
    def sentence_of(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([t[slice(*sentence_at(t, int(a), int(b)))].strip() for t, a, b in zip(text, start, end)])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def really_different(s: pd.Series) -> pd.Series:
        return s.map(lambda x: distinct_by_containment(list(x)))

    return {f.__name__: f for f in (signature_of, nfkc, number_drift, round_trip, chunk_sizes, diff, sentence_of, really_different)}
