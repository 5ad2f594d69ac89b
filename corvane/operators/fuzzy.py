"""Fuzzy lookup by the Ratcliff-Obershelp ratio, exact: every pair that reaches the threshold is found.

ratio = 2 M / (a + b) for M characters in blocks. Between two blocks at least one character of either text is left over, so there are at most
a + b - 2 M + 1 blocks and the texts share at least 3 M - a - b - 1 pairs of neighbouring characters (repeats numbered). Texts meet by keys and
class of length, each text once however many rows hold it. Where they meet, shared pairs of characters are counted by a product of matrices
whose columns are hashes of them: what falls together only raises the count, so the bound stays one. What reaches it is counted again over
many more hashes, by characters and by characters in order, and what is left is measured. The number of columns changes the work, never the result.

No candidate is dropped. Keys with a class of length that holds more than `SLICE` characters, on either side, are found exactly and met in slices.
Of the rows of a text only the k + 1 first can be among the k best of a query (one may be the query itself), so only these are carried on.

Cases: null or empty texts have no partner; a text is not its own partner; equal texts are left to the exact lookup, and texts of one or two
characters can only be equal; a null key or id has no partner.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import broadcast_if_small, cut

SLICE = 2_000_000  # characters of a side that meet at once
BLOCK = 2048  # rows of a product
STEP = 1.15  # lengths in one class
MARKS = 1 << 20
LETTERS = 128  # columns of the count of characters
PAIRS = 8192  # pairs looked at together
MOST_HOT = 100_000  # cells met in slices that are broadcast; more are joined


def least_shared(total: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of characters that two texts of `total` characters share; grows with `total`."""
    return np.ceil((1.5 * threshold - 1) * total - 1 - 1e-9)


def numbered_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start of each text, hashes of its pairs of characters, repeats numbered); a text of n characters has n - 1."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    inside = owner[:-1] == owner[1:]
    pair = (chars[:-1][inside] << np.uint64(21)) | chars[1:][inside]
    owner = owner[:-1][inside]
    turn = np.lexsort((pair, owner)) if len(texts) >= 1 << 22 else None
    if turn is None:
        both = np.sort((owner << np.uint64(42)) | pair)
        owner, pair = both >> np.uint64(42), both & np.uint64((1 << 42) - 1)
    else:
        owner, pair = owner[turn], pair[turn]
    first = np.concatenate(([True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))
    at = np.arange(len(pair))
    again = at - np.maximum.accumulate(np.where(first, at, 0))
    mixed = (pair + again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(([0], np.cumsum(sizes - 1))), mixed ^ (mixed >> np.uint64(29))


def counted(starts: np.ndarray, hashes: np.ndarray, lo: int, hi: int, columns: int) -> np.ndarray:
    """How often each of the columns comes in each of the texts lo to hi."""
    own = hashes[starts[lo] : starts[hi]] % np.uint64(columns)
    owner = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
    return np.bincount(owner * columns + own.astype(np.int64), minlength=(hi - lo) * columns).astype(np.float32).reshape(hi - lo, columns)


def sorted_by_length(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, list[str]]:
    sizes = texts.map(len).to_numpy(dtype=np.int64)
    turn = np.argsort(sizes, kind="stable")
    own = texts.tolist()
    return turn, sizes[turn], [own[i] for i in turn]


def characters(texts: list[str]) -> np.ndarray:
    """How often characters come in each text, hashed to few columns; up to 255, beyond which the bound only gets weaker."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32) % LETTERS
    counts = np.bincount(np.repeat(np.arange(len(texts)), sizes) * LETTERS + chars, minlength=len(texts) * LETTERS)
    return counts.astype(np.int32 if len(sizes) and sizes.max() > 255 else np.uint8).reshape(len(texts), LETTERS)


def places_of(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def in_order(places: dict[str, int], n: int, text: str) -> int:
    """Characters that the text has in common, in their order, with that of n characters whose places are given; blocks never hold more."""
    full = left = (1 << n) - 1
    for c in text:
        if u := left & places.get(c, 0):
            left = ((left + u) | (left - u)) & full
    return n - left.bit_count()


def reached(matcher: SequenceMatcher, n: int, m: int, threshold: float) -> float | None:
    """The matcher's ratio if it reaches the threshold; it is given up where what is left can't any more."""
    least, found, open_ends = threshold * (n + m) / 2 - 1e-9, 0, [(0, n, 0, m)]
    room = min(n, m)
    while open_ends:
        alo, ahi, blo, bhi = open_ends.pop()
        i, j, size = matcher.find_longest_match(alo, ahi, blo, bhi)
        room -= min(ahi - alo, bhi - blo)
        if size:
            found += size
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if (w := min(part[1] - part[0], part[3] - part[2])) > 0:
                    room += w
                    open_ends.append(part)
        if found + room < least:
            return None
    score = 2.0 * found / (n + m)
    return score if score >= threshold else None


def near_pairs(queries: pd.Series, texts: pd.Series, threshold: float, most_columns: int) -> list[tuple[int, int, float]]:
    """(place in queries, place in texts, ratio) of what reaches the threshold and is not equal."""
    if not len(queries) or not len(texts):
        return []
    (qt, ql, qs), (rt, rl, rs) = sorted_by_length(queries), sorted_by_length(texts)
    (q_starts, q_hashes), (r_starts, r_hashes) = numbered_pairs(qs), numbered_pairs(rs)
    columns = min(most_columns, 1 << min(12, max(8, int(12 * rl[-1]).bit_length() - 1)))
    q_marks, r_marks = q_hashes >> np.uint64(44), r_hashes >> np.uint64(44)
    q_chars, r_chars = characters(qs), characters(rs)
    mark = np.zeros(MARKS, dtype=np.uint8)
    shorter = threshold / (2 - threshold)
    out = []
    for q0 in range(0, len(qs), BLOCK):
        q1 = min(len(qs), q0 + BLOCK)
        left = counted(q_starts, q_hashes, q0, q1, columns)
        places: dict[int, dict[str, int]] = {}
        r0, r_end = np.searchsorted(rl, ql[q0] * shorter - 1e-6), np.searchsorted(rl, ql[q1 - 1] / shorter + 1e-6, side="right")
        for b0 in range(r0, r_end, BLOCK):
            b1 = min(r_end, b0 + BLOCK)
            a0, a1 = q0 + np.searchsorted(ql[q0:q1], [rl[b0] * shorter - 1e-6, rl[b1 - 1] / shorter + 1e-6])
            if a0 >= a1:
                continue
            shared = left[a0 - q0 : a1 - q0] @ counted(r_starts, r_hashes, b0, b1, columns).T
            i, j = np.divmod(np.flatnonzero(shared >= least_shared(ql[a0:a1] + rl[b0], threshold)[:, None].astype(np.float32)), b1 - b0)
            i, j = i + a0, j + b0
            least = threshold * (ql[i] + rl[j]) - 1e-9
            keep = 2 * np.minimum(ql[i], rl[j]) >= least
            i, j, least = i[keep], j[keep], least[keep]
            keep = np.ones(len(i), dtype=bool)
            for k in range(0, len(i), PAIRS):
                part = slice(k, k + PAIRS)
                keep[part] = 2 * np.minimum(q_chars[i[part]], r_chars[j[part]]).sum(1, dtype=np.int64) >= least[part]
            i, j = i[keep], j[keep]
            ends = np.flatnonzero(np.concatenate((i[1:] != i[:-1], [True]))) + 1 if len(i) else []
            met: dict[int, list[int]] = {}
            for lo, hi in zip([0, *ends], ends):
                x = int(i[lo])
                own = q_marks[q_starts[x] : q_starts[x + 1]]
                mark[own] = 1
                for k in range(lo, hi, PAIRS):
                    y = j[k : min(hi, k + PAIRS)]
                    sizes = rl[y] - 1
                    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    hits = np.add.reduceat(mark[r_marks[np.repeat(r_starts[y] - begin, sizes) + np.arange(sizes.sum())]], begin, dtype=np.int64)
                    for z in y[hits >= least_shared(ql[x] + rl[y], threshold)].tolist():
                        met.setdefault(z, []).append(x)
                mark[own] = 0
            for z, xs in met.items():
                t, matcher = rs[z], None
                for x in xs:
                    s = qs[x]
                    if x not in places:
                        places[x] = places_of(s)
                    if s == t or 2 * in_order(places[x], len(s), t) < threshold * (len(s) + len(t)) - 1e-9:
                        continue
                    matcher = matcher or SequenceMatcher(None, "", t)
                    matcher.set_seq1(s)
                    if (score := reached(matcher, len(s), len(t), threshold)) is not None:
                        out.append((int(qt[x]), int(rt[z]), score))
    return out


def length_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(STEP))).cast("int")


def slices(cells: DataFrame, cell: list[str], name: str) -> DataFrame:
    """(*cell, name) of the cells with more than SLICE characters: how many slices they are met in."""
    n = cells.groupBy(*cell).agg(F.ceil(F.sum("size") / SLICE).cast("int").alias(name)).where(F.col(name) > 1)
    return broadcast_if_small(cut(n), MOST_HOT)


def lookup(queries: DataFrame, rows: DataFrame, keys: list[str], threshold: float = 0.85, k: int = 5, most_grams: int = 500_000) -> DataFrame:
    """(query_id, id, score, rank): queries and rows are (id, text, *keys). most_grams: columns of the products at most."""
    if threshold <= 2 / 3:
        raise ValueError("the bound needs a threshold above two thirds")
    cell, shorter = [*keys, "class"], threshold / (2 - threshold)

    def usable(df: DataFrame) -> DataFrame:
        return df.where(F.length("text") > 2).dropna(subset=["id", *keys]).select("id", "text", *keys)

    first = Window.partitionBy(*keys, "text").orderBy("id")
    r = usable(rows).withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= k + 1)
    r = cut(r.groupBy(*keys, "text").agg(F.collect_set("id").alias("ids")).withColumns({"size": F.length("text"), "class": length_class(F.length("text"))}))
    q = cut(usable(queries).toDF("id", "text", *keys))  # columns of its own, where queries and rows come from one table
    n = F.length("text")
    classes = F.sequence(length_class(F.greatest(F.lit(1), F.floor(n * shorter))), length_class(F.ceil(n / shorter)))
    wanted = q.select(*keys, "text").distinct().withColumns({"size": n, "class": F.explode(classes)})
    r_slices, q_slices = slices(r, cell, "r_slices"), slices(wanted, cell, "q_slices")

    def sliced(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each text in its own slice, for all slices of the other side."""
        df = df.join(r_slices, cell, "left").join(q_slices, cell, "left")
        place = F.pmod(F.xxhash64("text"), F.coalesce(f"{own}_slices", F.lit(1))).cast("int")
        return df.withColumns({f"{own}_slice": place, f"{other}_slice": F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_slices", F.lit(1)) - 1))}).drop("r_slices", "q_slices", "size")

    id_type = dict(r.select(F.explode("ids").alias("id")).dtypes)["id"]
    group = [*cell, "r_slice", "q_slice"]
    out = [*keys, "text", "ids", "score"]
    types = dict(r.dtypes)

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = near_pairs(a["text"], b["text"], threshold, most_grams)
        i, j = [x for x, _, _ in found], [y for _, y, _ in found]
        got = a[[*keys, "text"]].iloc[i].reset_index(drop=True)
        return got.assign(ids=pd.Series(b["ids"].iloc[j].tolist(), dtype=object), score=np.array([s for *_, s in found], dtype=np.float64))[out]

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "text"]) + f", ids array<{id_type}>, score double"
    met = sliced(wanted, "q", "r").groupBy(*group).cogroup(sliced(r, "r", "q").groupBy(*group)).applyInPandas(near, schema)
    pairs = met.select(*keys, "text", F.explode("ids").alias("id"), "score").groupBy(*keys, "text", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy(*keys, "text").orderBy(F.col("score").desc(), "id")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank")
    scored = pairs.join(q.withColumnRenamed("id", "query_id"), [*keys, "text"]).where(F.col("query_id") != F.col("id"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
