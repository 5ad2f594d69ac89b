"""Garbled text from wrong character encoding (problem 6).

Round-trip repair. In each round every pair (legacy encoding the text was decoded with, encoding it was meant in) is tried: the text is
encoded back under the legacy encoding and decoded strictly as the intended one. With a single-byte legacy encoding and UTF-8 meant, that
is done for each byte sequence that is valid UTF-8, so a value that is garbled in parts only is repaired in those parts; with a multi-byte
one it is done for each run of characters beyond ASCII, and for the value as a whole. The repair with the lowest garbling cost is kept if
the cost drops clearly; rounds go on while it does, without a limit, so any number of nested layers comes off one by one.

The cost of a character says how seldom it stands in rightful text at that place: control characters, replacement and private-use
characters, box drawing and symbols beside letters, capitals with accents inside words, letters of one script among another, ideographs
outside the first level of GB 2312. Rightful accents, Greek, Cyrillic, kana, Hangul, letters of other scripts among themselves, ruled tables
and Chinese cost little. Valid UTF-8 proves itself; between two legacy encodings, where nearly any bytes are valid, the drop of the cost is
the only evidence, so it must be larger (EVIDENCE), and nine in ten ideographs that come out must be common ones of the encoding meant.

Cases: null and blank values are never garbled; a value with replacement characters has lost characters for good, and so has one that
stays clearly garbled after every repair: it comes out as ''. Values of any length are handled whole. Repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings that text was wrongly decoded with, by what was meant.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "cp1253", "cp1254", "cp866", "koi8_r", "iso8859_5", "iso8859_15", "mac_cyrillic")
MULTI = (("gb18030", "utf-8"), ("cp932", "utf-8"), ("big5", "utf-8"), ("euc_kr", "utf-8"), ("cp949", "utf-8"), ("euc_jp", "utf-8"), ("big5", "gb18030"), ("cp932", "gb18030"), ("euc_kr", "gb18030"), ("cp949", "gb18030"), ("gb18030", "big5hkscs"), ("gb18030", "cp932"), ("gb18030", "cp1252"), ("gb18030", "cp1251"), ("big5hkscs", "cp1252"), ("cp932", "cp1252")) + tuple((a, b) for b in ("gb18030", "big5hkscs") for a in SINGLE[:6] + ("cp866", "koi8_r")) + tuple((a, b) for a in ("cp1252", "latin-1", "mac_roman", "cp437") for b in ("cp1251", "koi8_r"))
GOOD_SYMBOLS = frozenset("°±²³µ·×½¼¾§©®")
GOOD_PUNCT = frozenset("‘’“”–—…·、。《》「」『』【】〈〉")
OUTER = frozenset("«»„“”‘’–—…")
GOOD_MATH = frozenset("≥≤→℃μΔ")
EVIDENCE = {"utf-8": 0.3}  # by how much the cost of a run must drop, by the encoding meant
LEGACY_EVIDENCE = 2.2
CLEAN = 0.8  # cost of a character up to which a text that proved to be UTF-8 is taken as it is


@lru_cache(None)
def bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes it leaves undefined stand for the control characters they usually become."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if encoding != "latin-1":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


@lru_cache(200_000)
def double_bytes(ch: str, encoding: str) -> bytes:
    """Bytes of one character; where Python's codec lacks it, those of the variants that other software decodes with."""
    if ch == "€" and encoding == "gb18030":
        return b"\x80"
    for e in {"big5": ("big5", "big5hkscs", "cp950")}.get(encoding, (encoding,)):
        try:
            return ch.encode(e)
        except UnicodeEncodeError:
            pass
    raise KeyError(ch)


@lru_cache(100_000)
def level(ch: str) -> float:
    """Cost of an ideograph: first level of GB 2312, second level, any other."""
    try:
        return 0.25 if ch.encode("gb2312")[0] < 0xD8 else 1.0
    except UnicodeEncodeError:
        return 1.6


@lru_cache(100_000)
def common_in(ch: str, encoding: str) -> bool:
    """Whether an encoding has an ideograph among its common ones: all of GB 2312, the first levels of Big5 and of JIS X 0208."""
    try:
        b = ch.encode({"gb18030": "gb2312", "big5hkscs": "big5", "cp932": "euc_jp"}.get(encoding, encoding))
    except UnicodeEncodeError:
        return False
    return encoding == "gb18030" or len(b) == 2 and b[0] < (0xC7 if encoding == "big5hkscs" else 0xD0)


@lru_cache(100_000)
def script(ch: str) -> str:
    """a Latin without accents, l with, g Greek, c Cyrillic, h ideographs, k kana, y narrow kana, o Hangul, r other letters, b box drawing, p quotes and dashes, 0 digits, s symbols, blank."""
    o = ord(ch)
    if o < 0x80:
        return "a" if ch.isalpha() else "0" if ch.isdigit() else " "
    if ch in OUTER:
        return "p"
    if 0xC0 <= o <= 0x24F and o not in (0xD7, 0xF7) or 0x1E00 <= o <= 0x1EFF:
        return "l"
    if 0x370 <= o <= 0x3FF:
        return "g"
    if 0x400 <= o <= 0x52F:
        return "c"
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "h"
    if 0x3041 <= o <= 0x30FF and o != 0x30FB or 0x31F0 <= o <= 0x31FF:
        return "k"
    if 0xFF66 <= o <= 0xFF9F:
        return "y"
    if 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o <= 0x11FF or 0x3131 <= o <= 0x318E:
        return "o"
    if 0x2500 <= o <= 0x259F:
        return "b"
    return "r" if 0x530 <= o < 0x2000 and (ch.isalnum() or unicodedata.category(ch)[0] == "M") or 0x2C00 <= o <= 0x2DFF else "s"


LINE = "\\s\u2500-\u259f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3"
RULED = re.compile(f"(?<![^{LINE}])[\u2500-\u259f]+(?![^{LINE}])|(?<![^\\s\x00-\x7f])[\u2500-\u259f]{{3,}}")
HANGUL_AMONG_HAN = re.compile("[\uac00-\ud7a3][\u4e00-\u9fff]|[\u4e00-\u9fff][\uac00-\ud7a3]")
NARROW = re.compile("(?<![^\\s\x00-\x7f])(?<![A-Za-z])[\uff61-\uff9f]+(?![A-Za-z])(?![^\\s\x00-\x7f])")


def spans_of(pattern: re.Pattern, text: str, kinds: list[str], kind: str) -> frozenset[int]:
    return frozenset(i for m in pattern.finditer(text) for i in range(*m.span())) if kind in kinds else frozenset()


def cost(text: str) -> float:
    """The garbling cost of a text; 0 for ASCII."""
    if text.isascii():
        return 0.0
    total, kinds = 0.0, list(map(script, text))
    ideographs, n = kinds.count("h"), len(text)
    ruled, narrow = spans_of(RULED, text, kinds, "b"), spans_of(NARROW, text, kinds, "y")
    mixed = "o" in kinds and ideographs and HANGUL_AMONG_HAN.search(text) is not None
    for i, (ch, k) in enumerate(zip(text, kinds)):
        if k in "a0 ":
            continue
        before, after = (kinds[i - 1] if i else " "), (kinds[i + 1] if i + 1 < n else " ")
        before, after = (("s", " ")[k != "l"] if x == "p" else x for x in (before, after))
        o = ord(ch)
        if k == "h":
            alone = before not in "hk" and after not in "hk" and (before in "al" or after in "al" or ideographs < 3)
            total += level(ch) + (1.5 if alone else 0.8 if ideographs < 3 and "k" not in (before, after) else 0)
        elif k == "l":
            fits = (o < 0x180 or o >= 0x1E00 or ch in "ơƠưƯșȘțȚ") and ch.islower() and (before in "al" or after in "al") and "s" not in (before, after)
            total += 0.5 if fits else 0.8 if before == after == " " and ch.islower() and o < 0x180 else 1.2 if before == " " and after in "al" and ch.isupper() else 2.0
        elif k == "c":
            plain = "А" <= ch <= "я" or ch in "Ёё"
            inner = before == "c" and ch.isupper() and i and text[i - 1].islower()
            stray = before not in "c" and after not in "c" or before in "al0s" or after in "al0s"
            total += (0.12 if plain else 2.0) + (1.5 if inner else 0) + (1.0 if stray else 0)
        elif k == "g":
            word = before in " g" and after in " g" and before != after or before == after == "g"
            total += (0.15 if ch.islower() or before == " " else 0.3) if word else 0.5 if before in " hg" and after in " gh0" and not ("h" != before and after == "0") else 1.6
        elif k == "k":
            total += 1.5 if before in "alc" or after in "alc" else 0.25
        elif k == "y":
            total += 0.3 if i in narrow else 2.0
        elif k == "o":
            total += 1.0 if mixed else 0.3
        elif k == "r":
            total += 0.15 if before in "r 0" and after in "r 0" else 1.2
        elif k == "b":
            total += 0.2 if i in ruled else 2.5
        elif ch == chr(0xFFFD):
            total += 5
        elif o < 0xA0 or 0xE000 <= o <= 0xF8FF:
            total += 3
        elif ch in "«»":
            total += 0.6 if " " in (before, after) else 2.0
        elif o < 0x100:
            total += 0.6 if ch in GOOD_SYMBOLS and before != "l" else 0.8 if o == 0xA0 else 2.0
        elif ch in GOOD_PUNCT or 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFF60:
            total += 0.3
        elif ch in GOOD_MATH or 0x1F000 <= o < 0x20000 or 0x2460 <= o <= 0x24FF or 0x2600 <= o <= 0x27BF:
            total += 0.4
        elif 0x25A0 <= o <= 0x25FF:
            total += 0.4 if before == after == " " else 2.5
        elif 0xFF61 <= o <= 0xFF65:
            total += 2.0
        elif 0x530 <= o < 0x2000:  # marks of other scripts
            total += 0.4
        else:
            total += 0.4 if (0x2010 <= o <= 0x205E or 0x2190 <= o <= 0x22FF) and before in " 0" and after in " 0" else 1.5
    return total


@lru_cache(None)
def sequence_start(encoding: str) -> re.Pattern:
    """A lead byte of UTF-8 and a byte that may follow it, as the characters that a single-byte encoding makes of them."""
    lead, follow = ("".join(re.escape(c) for c, b in bytes_of(encoding).items() if lo <= b < hi) for lo, hi in ((0xC2, 0xF5), (0x80, 0xC0)))
    return re.compile(f"[{lead}][{follow}]")


def utf8_parts(text: str, encoding: str) -> str | None:
    """The text with each sequence that is valid UTF-8 under a single-byte encoding decoded; None where there is none."""
    if not sequence_start(encoding).search(text):
        return None
    table = bytes_of(encoding)
    raw = [table.get(c) for c in text]
    out, i, n, changed = [], 0, len(text), False
    while i < n:
        b = raw[i]
        size = 0 if b is None or b < 0xC2 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 0
        seq = raw[i : i + size]
        if size and len(seq) == size and all(x is not None and 0x80 <= x < 0xC0 for x in seq[1:]):
            try:
                out.append(bytes(seq).decode("utf-8"))
                i, changed = i + size, True
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out) if changed else None


RUN = re.compile("[^\x00-\x7f]+")


def impossible(text: str, wrong: str) -> bool:
    """Whether the first character beyond ASCII cannot begin UTF-8 under a multi-byte encoding."""
    first = next((c for c in text if not c.isascii()), None)
    try:
        b = double_bytes(first, wrong) if first else b""
    except KeyError:
        return True
    return not b or b[0] < 0xC2 or len(b) > 1 and not 0x80 <= b[1] < 0xC0


def recode(text: str, wrong: str, meant: str) -> str | None:
    """Strict round trip of one piece; None where it fails. The codec encodes if it can, else the characters one by one."""
    if meant == "utf-8" and wrong not in SINGLE and impossible(text, wrong):
        return None
    try:
        if wrong == "gb18030" and "€" in text:
            raise UnicodeEncodeError(wrong, text, 0, 1, "stands for one byte")
        data = text.encode(wrong)
    except UnicodeEncodeError:
        try:
            data = bytes(bytes_of(wrong)[c] for c in text) if wrong in SINGLE else b"".join(double_bytes(c, wrong) for c in text)
        except KeyError:
            return None
    try:
        out = data.decode(meant)
    except UnicodeDecodeError:
        return None
    if out == text:
        return None
    if meant in ("gb18030", "big5hkscs", "cp932"):
        ideographs = [c for c in out if script(c) == "h"]
        if 10 * sum(not common_in(c, meant) for c in ideographs) > len(ideographs):
            return None
    return out


def run_parts(text: str, wrong: str, meant: str) -> list[str]:
    """The text with its runs beyond ASCII decoded, each where that lowers its cost enough; and as a whole."""
    # Simplified Chinese has few of its characters in Big5: that the text has bytes there is evidence too.
    share, least = (0.7, EVIDENCE["utf-8"]) if meant == "utf-8" else (0.6 if wrong == "big5" else 0.3, 0.7 if wrong == "big5" else LEGACY_EVIDENCE)

    def enough(old: str, new: str) -> bool:
        now, then = cost(old), cost(new)
        return then < share * now and now - then >= least

    whole = recode(text, wrong, meant)
    found = [whole] if whole and (meant == "utf-8" or enough(text, whole)) else []

    def better(m: re.Match) -> str:
        return out if (out := recode(m[0], wrong, meant)) is not None and enough(m[0], out) else m[0]

    if (out := RUN.sub(better, text)) != text and out not in found:
        found.append(out)
    return found


def candidates(text: str, now: float) -> Iterator[list[str]]:
    """Repairs by one layer: first all that yield UTF-8, which proves itself, then the others."""
    yield [out for enc in SINGLE if (out := utf8_parts(text, enc))] + [out for wrong, meant in MULTI if meant == "utf-8" for out in run_parts(text, wrong, meant)]
    # Common characters that cost little where they stand can only have come from Big5, whose characters are common ones in other places.
    common = now <= 0.4 * sum(not c.isascii() for c in text)
    yield [out for wrong, meant in ((("big5", "gb18030"),) if common else MULTI) if meant != "utf-8" for out in run_parts(text, wrong, meant)]


def repaired(text: str, known: dict[str, tuple[float, str, int]] | None = None) -> tuple[float, str, int]:
    """(cost, text, layers taken off) of the best repair: the best step of each kind is followed to its end, and the lowest cost wins. Every
    step lowers the cost, so there is an end."""
    known = {} if known is None else known
    if text not in known:
        now = cost(text)
        best = (now, text, 0)
        for group in candidates(text, now) if now > 0 else ():
            low, step = min(((cost(c), c) for c in group), default=(now, text))
            if now - low >= 0.3 and (low <= 0.75 * now or now - low >= 1.0):
                end = repaired(step, known)
                best = min(best, (end[0], end[1], end[2] + 1))
                if end[0] <= CLEAN * sum(not c.isascii() for c in end[1]):
                    break
        known[text] = best
    return known[text]


@lru_cache(50_000)
def restore(text: str | None) -> str | None:
    """The original text of a garbled value, '' where it is lost, None where the value is not garbled."""
    if text is None or text.isascii():
        return None
    if chr(0xFFFD) in text:
        return ""
    _, out, layers = repaired(text)
    if not layers:
        return None
    beyond = sum(not c.isascii() for c in out)
    return "" if chr(0xFFFD) in out or beyond and cost(out) / beyond > 1.3 else out


@F.pandas_udf(T.StringType())
def restored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(restore)


def garbled(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field_name, restored): each garbled value. One scan for all fields; a value is parsed once however often its row is repeated."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    rows = df.select(F.col(id_col).alias("id"), pairs).select("id", "x.*").where(F.col("value").rlike(r"[^\x00-\x7F]")).distinct()
    return rows.select("id", "field_name", restored("value").alias("restored")).where(F.col("restored").isNotNull()).distinct()
