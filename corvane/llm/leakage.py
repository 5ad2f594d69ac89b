"""Evaluation texts leaking into training text (problem 8).

Texts are cut into tokens: words and numbers of any script in lower case, characters of scripts without spaces (Chinese, kana, Thai and the like) one by
one; markup, punctuation, white space and characters of no width play no part. Winnowing: of the hashes of all k-grams the smallest in every
window of w is kept as a fingerprint, so every run of k + w - 1 tokens that a document shares with a test item has a fingerprint in common.
Fingerprints that meet are extended on both sides: a stretch goes on over an altered, missing or added word (at most GAP tokens, as a number
such as 75-year-old has several) if NEED tokens agree behind it. A document leaks an item when one stretch holds at least `share` of the
item's tokens.

k and w follow from the item: the shortest stretch that leaks it, with one altered word at any place, must still hold a run of k + w - 1
tokens. Items of 19 tokens and more (at a share of a half) have k = 4, w = 2; shorter ones have smaller k and w, down to single words, and are
found in full. Documents are fingerprinted once for each pair (k, w) that occurs.

Test items are few and fixed: they are broadcast while they have at most `most_fingerprints` characters and `most_items` texts, and documents are
then fingerprinted, probed and extended where they lie, without a shuffle of any text. Beyond these bounds `leaks` joins the exploded
fingerprints of both sides by hash, those that more than `hot_rows` documents hold (found exactly) by hash and salt, and extends the hits
per document. Both ways give the same rows.

Cases: null and empty texts leak nothing; items without a token or an id are never found; an item id with several texts is leaked by each of them; repeated
rows give one row; texts are processed whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import checked_broadcast_rows, cut

TAG = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->|&(?:[a-z]{2,8}\d?|#x?[0-9a-f]{1,6});|\]\([^()\s]*\)", re.S)
SPACELESS = "㐀-鿿豈-\ufaff々-〇぀-ヿㇰ-ㇿ\U00020000-\U0003ffff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
INVISIBLE = dict.fromkeys((0x00AD, 0x200C, 0x200D, 0x2060, 0xFEFF))
K, W = 4, 2
SHARE = 0.5
GAP, NEED = 4, 2  # tokens altered in a row that do not break a stretch, and tokens that must agree behind them
CHUNK = 1 << 20  # characters whose tokens are hashed at once


@lru_cache(2)
def spaced_letters(digits: bool = True) -> str:
    """Letters, numbers (if asked for) and combining marks of all scripts with spaces, as ranges of a character class. Beyond 1FFFF there are ideographs only."""
    spaceless = re.compile(f"[{SPACELESS}]")
    found = [c for c in range(0x30, 0x20000) if unicodedata.category(ch := chr(c))[0] in ("LMN" if digits else "LM") and not spaceless.match(ch)]
    out, start = [], found[0]
    for a, b in zip(found, [*found[1:], 0]):
        if b != a + 1:
            out.append(f"\\U{start:08x}-\\U{a:08x}")
            start = b
    return "".join(out)


PLAIN_TOKEN = re.compile("[a-z0-9]+")


@lru_cache(1)
def token_pattern() -> re.Pattern:
    own, joining = spaced_letters(), "".join(map(chr, INVISIBLE))
    return re.compile(rf"[㐀-鿿]|(?=[^\W_])[{own}][{own}{joining}]*|(?=[^\W_])[{SPACELESS}]")


def pattern_for(low: str) -> re.Pattern:
    """The same tokens, by a shorter class where a text is plain."""
    return PLAIN_TOKEN if low.isascii() else token_pattern()


def prepared(text: str) -> str:
    """Lower case without markup, place for place."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have a lower case of two characters
        low = "".join(c if len(c) == 1 else text[i] for i, c in enumerate(map(str.lower, text)))
    return TAG.sub(lambda m: " " * len(m[0]), low) if "<" in low or "&" in low or "](" in low else low


class Bounded(dict):
    """What a function gives for a token. Tokens come again and again, so a bounded number is remembered."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        out = self[word] = self.of(word)
        return out


_plain = Bounded(lambda w: w if w.isascii() else unicodedata.normalize("NFC", w.translate(INVISIBLE)))
_hashes = Bounded(xxhash.xxh64_intdigest)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = prepared(text)
    found = pattern_for(low).findall(low)
    return found if low.isascii() else list(map(_plain.__getitem__, found))


def tokens(text: str | None) -> list[tuple[str, int, int]]:
    """(token, start, end) in the text as given."""
    low = prepared(text or "")
    return [(_plain[m[0]], m.start(), m.end()) for m in pattern_for(low).finditer(low)]


def kept_hashes(words: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: the rightmost smallest k-gram in each window. A k-gram's hash is a polynomial of its tokens'
    hashes, mixed once more, all modulo 2**64."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    one = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + one[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(1)).astype(np.int64)
    m = max(1, n - w + 1)
    best, at = h[:m].copy(), np.arange(m)
    for j in range(1, min(w, n)):
        other = h[j : j + m]
        lower = other <= best
        best[lower], at[lower] = other[lower], (np.arange(m) + j)[lower]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]  # positions never go back, so equal ones are neighbours
    return at, h[at]


def fingerprints(words: list[str], k: int = K, w: int = W) -> list[tuple[int, int]]:
    """(hash, position) of the kept k-grams."""
    at, kept = kept_hashes(words, k, w)
    return list(zip(kept.tolist(), at.tolist()))


def window_of(n: int, share: float) -> tuple[int, int]:
    """(k, w) for an item of n tokens: the shortest leaking stretch with one altered token still holds a run of k + w - 1 tokens."""
    need = max(1, math.ceil(share * n - 1e-9))
    run = max(1, need // 2)  # the longer part of need - 1 tokens in two
    k = max(min(run, 2), min(K, run - 1))
    return k, min(W, run - k + 1)


def stretch(doc: list[str], item: list[str], at: int, iat: int, gap: int, need: int) -> tuple[int, int, int]:
    """(tokens of the item that the stretch spans, first and last + 1 document position) around an agreeing pair of positions."""

    def walk(step: int) -> tuple[int, int]:
        i, j, edge, iedge = at, iat, at, iat
        while True:
            ni, nj = i + step, j + step
            if 0 <= ni < len(doc) and 0 <= nj < len(item) and doc[ni] == item[nj]:
                i, j, edge, iedge = ni, nj, ni, nj
                continue
            best = None
            for skip in range(1, 2 * gap + 1):
                for a in range(max(0, skip - gap), min(gap, skip) + 1):
                    b = skip - a
                    run = 0
                    while run < need and 0 <= i + step * (a + run + 1) < len(doc) and 0 <= j + step * (b + run + 1) < len(item) and doc[i + step * (a + run + 1)] == item[j + step * (b + run + 1)]:
                        run += 1
                    ends = not 0 <= j + step * (b + run + 1) < len(item)
                    if run >= need or run and ends:
                        best = best or (a, b)
            if best is None:
                return edge, iedge
            i, j = i + step * best[0], j + step * best[1]

    (first, ifirst), (last, ilast) = walk(-1), walk(1)
    return ilast - ifirst + 1, first, last + 1


class Finder:
    """The compiled test items. items: (item id, text)."""

    def __init__(self, items: list[tuple[str, str]], share: float = SHARE):
        self.share = share
        self.items = [(i, t) for i, x in items if (t := words_of(x))]
        grams: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, t) in enumerate(self.items):
            for h, at in fingerprints(t, *(kw := window_of(len(t), share))):
                grams[kw][h].append((n, at))
        self.index = [(kw, table, np.array(sorted(table), dtype=np.int64)) for kw, table in sorted(grams.items())]

    def extended(self, words: list[str], hits: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """(item id, share held, first and last + 1 token) of every stretch around the hits, in the order of their places, that is long enough.
        Hits within one run of agreeing tokens have the same stretch; any other hit is looked at, on a known diagonal too."""
        out, seen = {}, {}
        for n, at, iat in hits:
            if at >= len(words) or at < seen.get((n, at - iat), 0):
                continue
            name, own = self.items[n]
            if words[at] != own[iat]:
                continue
            end = at + 1
            while end < len(words) and end - at + iat < len(own) and words[end] == own[end - at + iat]:
                end += 1
            seen[n, at - iat] = end
            same, a, b = stretch(words, own, at, iat, GAP, NEED)
            if same >= self.share * len(own):
                out[name, same / len(own), a, b] = None
        return list(out)

    def hits(self, texts: list[list[str]]) -> dict[int, list[tuple[int, int, int]]]:
        """Text -> (item, position, position in the item) of the fingerprints in common. The texts' tokens are hashed in one go, with tokens
        between them that no item has."""
        pad = [""] * (K + W)
        flat, starts = [], []
        for t in texts:
            starts.append(len(flat))
            flat += t
            flat += pad
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for (k, w), table, keys in self.index:
            at, kept = kept_hashes(flat, k, w)
            place = np.minimum(np.searchsorted(keys, kept), len(keys) - 1)
            met = np.flatnonzero(keys[place] == kept)
            for p, h, d in zip(at[met].tolist(), kept[met].tolist(), (np.searchsorted(starts, at[met], side="right") - 1).tolist()):
                out[d] += [(n, p - starts[d], iat) for n, iat in table[h]]
        return out

    def all(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text, as extended(), with places in the text instead of tokens."""
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        for part in chunks(texts):
            words = [words_of(texts[i]) for i in part]
            for d, hits in self.hits(words).items():
                if found := self.extended(words[d], sorted(hits, key=lambda h: h[1])):
                    toks = tokens(texts[part[d]])
                    out[part[d]] = [(i, s, toks[a][1], toks[b - 1][2]) for i, s, a, b in found]
        return out

    def __call__(self, text: str | None) -> list[tuple[str, float, int, int]]:
        return self.all([text])[0]


def chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of the texts, in groups of about CHUNK characters."""
    part, size = [], 0
    for i, t in enumerate(texts):
        if t:
            part.append(i)
            size += len(t)
            if size > CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


@lru_cache(4)
def compiled(items: tuple[tuple[str, str], ...], share: float) -> Finder:
    return Finder(list(items), share)


def known_items(items: DataFrame) -> DataFrame:
    return items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()


def item_rows(items: DataFrame, most_items: int = 100_000) -> tuple[tuple[str, str], ...]:
    return tuple(sorted((r.item_id, r.text) for r in checked_broadcast_rows(known_items(items), most_items, "the test items")))


HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
PRINTS = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType())]))


def leaked_passages(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(id, item_id, share, start, end): every leaked stretch, with its place in the text."""
    broadcast = docs.sparkSession.sparkContext.broadcast(item_rows(items))

    @F.pandas_udf(HIT)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = compiled(broadcast.value, share)
        for s in texts:
            yield pd.Series([[dict(zip(("item_id", "share", "start", "end"), h)) for h in x] for x in f.all(s.tolist())], dtype=object)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.select("id", found("text").alias("hits")).where(F.size("hits") > 0).select("id", F.inline("hits"))


def prints(windows: tuple[tuple[int, int], ...] | None, share: float = SHARE):
    """A column function: the fingerprints of a text for each of the windows, or (None) for the one that an item of its length has."""

    @F.pandas_udf(PRINTS)
    def of(texts: pd.Series) -> pd.Series:
        def one(x: str) -> list[dict]:
            t = words_of(x)
            return [{"k": k, "w": w, "h": h, "at": at} for k, w in (windows or [window_of(len(t), share)]) for h, at in fingerprints(t, k, w)]

        return texts.map(one)

    return of


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, share: float = SHARE, most_fingerprints: int = 2_000_000, most_items: int = 100_000, hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """(id, item_id): documents that hold at least `share` of a test item in one stretch."""
    wanted = known_items(items)
    few = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size")).first()
    if few.size <= most_fingerprints and few.n <= most_items:  # an item has fewer fingerprints than characters
        return leaked_passages(docs, id_col, text_col, items, share).select("id", "item_id").distinct()
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    wanted = wanted.withColumn("item", F.xxhash64("item_id", "text"))
    theirs = cut(wanted.select("item", F.inline(prints(None, share)("text"))).withColumnRenamed("at", "iat"))
    windows = tuple(sorted((r.k, r.w) for r in theirs.select("k", "w").distinct().collect()))  # a handful: k <= K, w <= W
    key = ["k", "w", "h"]
    ours = cut(left.select("id", F.xxhash64("text").alias("version"), F.inline(prints(windows)("text"))).join(theirs.select(key).distinct(), key, "left_semi"))
    hot = ours.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(key)
    salted = ours.join(hot, key, "left_semi").withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(salts)))
    spread = theirs.join(hot, key, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = ours.join(hot, key, "left_anti").join(theirs, key).select("id", "version", "item", "at", "iat").unionByName(salted.join(spread, [*key, "salt"]).select("id", "version", "item", "at", "iat"))
    hits = met.groupBy("id", "version", "item").agg(F.collect_set(F.struct("at", "iat")).alias("hits"))  # at most |document| x |item| pairs
    both = hits.join(left.withColumn("version", F.xxhash64("text")), ["id", "version"]).join(wanted.select("item", "item_id", F.col("text").alias("item_text")), "item")

    @F.pandas_udf(T.BooleanType())
    def holds(texts: pd.Series, item: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str, x: str, h: list) -> bool:
            return bool(compiled((("", x),), share).extended(words_of(t), sorted(((0, a["at"], a["iat"]) for a in h), key=lambda a: a[1])))

        return pd.Series([one(*x) for x in zip(texts, item, found)], dtype=bool)

    return both.where(holds("text", "item_text", "hits")).select("id", "item_id").distinct()
