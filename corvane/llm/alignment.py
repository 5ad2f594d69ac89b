"""Sentence alignment in bilingual documents (problem 7).

Fitting, on all records: document frequencies (sentences that hold a word), neighbours and word pairs are counted where the texts lie and
summed by Spark; only the sums come to the driver, for the factorisation. A record of several sentences does not say which of them belong
together: its word pairs count over all pairs of its sentences, which together weigh as much as one unit of one sentence a side. From the
sums come skip-gram vectors of the words of each language (positive shifted pointwise mutual information of words and their neighbours,
factorised, which is what skip-gram with negative sampling converges to); seed translations by association (Dice); an orthogonal Procrustes
map that turns one language's vectors onto the other's by these seeds. A word's vector is its (mapped) skip-gram vector beside the coordinates
of its seed translations; numbers, and words that both languages write and use alike, have the same coordinates in both. Words are those of any script with spaces; Chinese,
kana, Thai and the like go by pairs of characters.

Aligning, for each document where it lies: a sentence is the sum of its word vectors, weighted by inverse document frequency. Time warping
over beads of 1-1, 1-2, 2-1, 1-3, 3-1 sentences and gaps maximises what the cosines exceed `floor` by; long documents are first warped at
half their resolution, recursively, and then only in a window of each row near the path found, so that time and memory grow with the number of sentences. Spans that stay unaligned are matched with each other again without
order, best first, which recovers what was moved, and then with the sentences beside which they complete a merged rendering.

Cases: records with a null or blank side have no pair; a sentence without a word or number is aligned with none; without a word that comes back only
numbers and words written alike count; repeated rows give one set of pairs; documents are aligned whole.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.leakage import SPACELESS, spaced_letters
from corvane.llm.piece_codes import NUMBERS, OTHERS, PieceCodes
from corvane.llm.sentences import sentences
from corvane.session import cut

DIMS, COORDINATES, ROWS = 96, 256, 8192
WINDOW = 5
CHARACTERS = 1 << 18  # of the texts whose pieces are found at once
LEAST_DICE = 0.1
UNIT = 1 << 32  # weight of a unit of one sentence a side; whole numbers have one sum in any order
BLOCK, MOST_HELD = 2_000_000, 4_000_000  # sizes of what a worker adds up at once, and holds before it hands partial sums on
SKIPGRAM_WEIGHT = 0.35
ALIKE = 0.3  # association from which on a word that both sides write alike is one word
SMALL = 1600  # cells that are warped without a coarser pass
MOST_WORDS = 100_000  # word vectors that a worker holds
MOST_NUMBERS = 20_000  # numbers, the most frequent, whose counts all workers hold; the others' are joined to the records that have them
CELLS = 1 << 22  # cosines held at once where unaligned sentences are matched
HELD_BACK = 1e-6  # of equally near sentences the one at the nearer place wins
BEADS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1))


NUMBER = "[0-9]+(?:[.,][0-9]+)*"
PLAIN_PIECE = re.compile(f"{NUMBER}|[a-z]+")


@lru_cache(1)
def piece_pattern() -> re.Pattern:
    own = spaced_letters(digits=False)
    return re.compile(rf"[㐀-鿿]+(?![{SPACELESS}])|[a-z]+(?![{own}])|{NUMBER}|[{own}]+|[{SPACELESS}]+")


def pieces(sentence: str) -> list[str]:
    """Words and numbers; of scripts without spaces the pairs of neighbouring characters."""
    low = sentence.lower()
    if "\n" in low:
        low = BROKEN.sub("", low)
    if low.isascii():
        found = PLAIN_PIECE.findall(low)
        return [w.replace(",", "") for w in found] if "," in low else found
    out = []
    for w in piece_pattern().findall(low):
        if "\u4e00" <= w[0] <= "\u9fff" or w[0] >= "\u0e00" and without_spaces(w[0]):
            if not w.isalnum():
                w = "".join(c for c in w if c.isalnum())
            out += map(add, w, w[1:]) if len(w) > 1 else [w] * len(w)
        else:
            out.append(w.replace(",", "") if "," in w else w)
    return out


BROKEN = re.compile("[-\u00ad\u2010\u2011]\n")


@lru_cache(100_000)
def without_spaces(ch: str) -> bool:
    return re.match(f"[{SPACELESS}]", ch) is not None


def beyond_latin(w: str) -> bool:
    return w[0] >= "\u0370"


def random_rows() -> np.ndarray:
    r = np.random.default_rng(11).standard_normal((ROWS, COORDINATES)).astype(np.float32)
    return r / np.linalg.norm(r, axis=1, keepdims=True)


COUNTS = (("kind", pa.int32()), ("a", pa.int32()), ("bs", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64())))
SUMMED = ("n0", "n1", "w0", "w1")


def sides_turned(x: list[list[str]], y: list[list[str]]) -> bool:
    """Whether the first side has more words beyond the Latin script; such sides come second, so that both directions are counted together."""
    return sum(beyond_latin(w) for z in x for w in z) > sum(beyond_latin(w) for z in y for w in z)


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], list[str]]]:
    """Sources and targets of batches of (source, target), about CHARACTERS at once."""
    for batch in batches:
        source, target = batch.source.tolist(), batch.target.tolist()
        of = np.cumsum(np.fromiter(map(len, map(add, source, target)), np.int64, len(source))) // CHARACTERS
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(source)]
        yield from ((source[i:j], target[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i)


class Sides:
    """The pieces of records by side, with sentences numbered through all of them.

    record, side, sentence, code: of each piece, in order; a record of which the first side has more words beyond the Latin script is turned.
    record_of: of each sentence. sizes: sentences with a piece on each side of each record. weights: what one pair of sentences of a record
    counts; all pairs of a record together count as much as a unit of one sentence a side."""

    def __init__(self, codes: PieceCodes, source: list[str], target: list[str]):
        n = len(source)
        text, self.sentence, self.code, beyond = codes.of([t for both in zip(source, target) for t in both])
        self.record = text >> 1
        far = np.bincount(text[beyond], minlength=2 * n).reshape(n, 2)
        self.side = text & 1 ^ (far[:, 0] > far[:, 1])[self.record]
        first = np.diff(self.sentence, prepend=-1) != 0
        self.sizes = np.bincount(2 * self.record[first] + self.side[first], minlength=2 * n).reshape(n, 2)
        pairs = self.sizes.prod(1)
        self.weights = np.where(pairs > 0, np.rint(UNIT / np.maximum(pairs, 1)), 0).astype(np.int64)
        self.record_of = np.zeros(self.sentence[-1] + 1 if len(text) else 0, dtype=np.int64)
        self.record_of[self.sentence] = self.record


def once(sentence: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, id), each pair once and in order; ids are below size."""
    both = np.sort(sentence * size + ids)
    return np.divmod(both[np.diff(both, prepend=-1) != 0], size)


def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n0, n1, w0, w1) of batches of (source, target): sentences of each side that hold a word, and the weight of the sentence pairs that
    do; the word "" counts sentences."""
    codes, total = PieceCodes(), np.zeros(2, dtype=np.int64)
    held: list[pa.Table] = []
    rows = 0

    def reduced() -> pa.Table:
        return pa.concat_tables(held).group_by("code", use_threads=False).aggregate([(k, "sum") for k in SUMMED]).select(["code", *(f"{k}_sum" for k in SUMMED)]).rename_columns(["code", *SUMMED])

    def out(own: pa.Table) -> pd.DataFrame:
        counts = own.to_pandas()
        counts.insert(0, "word", codes.spelled(counts.pop("code").to_numpy()))
        return counts

    for source, target in chunks(batches):
        s = Sides(codes, source, target)
        ids, found = pd.factorize(s.code)
        size = max(1, len(found))
        sentence, i = once(s.sentence, 2 * ids + s.side, 2 * size)
        record, side = s.record_of[sentence], i & 1
        n, w = np.bincount(i, minlength=2 * size), np.zeros(2 * size, dtype=np.int64)
        np.add.at(w, i, s.weights[record] * s.sizes[record, 1 - side])
        held.append(pa.table(dict(zip(("code", *SUMMED), (found, *(x[k : 2 * len(found) : 2] for x in (n, w) for k in (0, 1)))))))
        total += s.sizes.sum(0)
        rows += len(found)
        if rows > BLOCK:
            held = [reduced()]
            if (rows := held[0].num_rows) > MOST_HELD // 4:
                yield out(held[0])
                codes.clear()
                held, rows = [], 0
    if held:
        yield out(reduced())
    yield pd.DataFrame([("", *total.tolist(), 0, 0)], columns=["word", *SUMMED])


class Sums:
    """Sums by code, a * cols + b, added up in blocks: those of low a and b, the most frequent words, in one array, others in a table."""

    def __init__(self, rows: int, cols: int):
        most = 2 * MOST_HELD
        self.rows, self.cols = rows, cols
        self.top = min(rows, max(math.isqrt(most), most // cols))
        self.left = min(cols, max(1, most // self.top))
        self.cells, self.table = np.zeros(self.top * self.left, dtype=np.int64), None
        self.new: dict[int, list[np.ndarray]] = {}  # by what each of the codes counts
        self.rare: list[tuple[np.ndarray, int]] = []  # codes beyond the array
        self.held = self.held_rare = 0

    def add(self, codes: np.ndarray, n: int) -> None:
        self.new.setdefault(n, []).append(codes)
        self.held += len(codes)
        if self.held > BLOCK:
            self.reduce()

    def reduce(self) -> None:
        rest = []
        for n, parts in self.new.items():
            codes = np.concatenate(parts)
            if (self.top, self.left) != (self.rows, self.cols):
                a, b = np.divmod(codes, self.cols)
                inside = (a < self.top) & (b < self.left)
                self.rare.append((codes[~inside], n))
                self.held_rare += len(self.rare[-1][0])
                codes = a[inside] * self.left + b[inside]
            if 8 * len(codes) > len(self.cells):  # many of one weight are only counted
                self.cells += np.bincount(codes, minlength=len(self.cells)) * n
            else:
                rest.append((codes, n))
        if rest:
            np.add.at(self.cells, *self.weighted(rest))
        self.new, self.held = {}, 0
        if self.held_rare > BLOCK:
            self.reduce_rare()

    def reduce_rare(self) -> None:
        if self.held_rare:
            new = pa.table(dict(zip(("code", "n"), self.weighted(self.rare))))
            self.table = (new if self.table is None else pa.concat_tables([self.table, new])).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "n"])
        self.rare, self.held_rare = [], 0

    @staticmethod
    def weighted(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([c for c, _ in parts]), np.repeat(np.array([n for _, n in parts], dtype=np.int64), [len(c) for c, _ in parts])

    def full(self) -> bool:
        return self.table is not None and self.table.num_rows > MOST_HELD

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes in order and their sums; what comes later begins anew."""
        self.reduce()
        self.reduce_rare()
        at = np.flatnonzero(self.cells)
        codes, n = at // self.left * self.cols + at % self.left, self.cells[at]
        self.cells[at] = 0
        if self.table is not None:
            codes, n = (np.concatenate((x, self.table[k].to_numpy())) for x, k in ((codes, "code"), (n, "n")))
            turn, self.table = np.argsort(codes), None
            codes, n = codes[turn], n[turn]
        return codes, n


def packed(kind: int, codes: np.ndarray, n: np.ndarray, size: int) -> pd.DataFrame:
    """(kind, a, bs, ns): one row for each a of the codes a * size + b, which are in order."""
    a, starts = np.unique(codes // size, return_index=True)
    ends = [*starts[1:], len(codes)]
    b = (codes % size).astype(np.int32)
    return pd.DataFrame({"kind": np.full(len(a), kind, dtype=np.int32), "a": a.astype(np.int32), "bs": [b[i:j] for i, j in zip(starts, ends)], "ns": [n[i:j] for i, j in zip(starts, ends)]})


def pair_counts(batches: Iterator[pd.DataFrame], at: list[dict[str, int]]) -> Iterator[pd.DataFrame]:
    """(kind, a, bs, ns) of batches of (source, target): kinds 0 and 1 are words and the words after them within a side, as often as they
    stand so; kind 2 are words of both sides, by the weight of the sentence pairs that hold them."""
    sizes = [max(1, len(at[0])), max(1, len(at[1])), max(1, len(at[1]))]
    sums = [Sums(sizes[0], sizes[0]), Sums(sizes[1], sizes[1]), Sums(sizes[0], sizes[1])]
    codes, known = PieceCodes(), {}  # known: code -> its word on each side, -1 where it is none
    for source, target in chunks(batches):
        s = Sides(codes, source, target)
        ids, found = pd.factorize(s.code)
        places = np.full((len(found), 2), -1, dtype=np.int64)
        wordy = found & OTHERS != NUMBERS
        own = found[wordy].tolist()
        new = [c for c in own if c not in known]
        known.update((c, [x.get(w, -1) for x in at]) for c, w in zip(new, codes.spelled(np.array(new, dtype=np.int64))))
        places[wordy] = np.array([known[c] for c in own], dtype=np.int64).reshape(-1, 2)
        word = places[ids, s.side]
        held = []
        for k in (0, 1):
            own = (s.side == k) & (word >= 0)
            sentence, w = s.sentence[own], word[own]
            for j in range(1, WINDOW + 1):
                same = sentence[:-j] == sentence[j:]
                sums[k].add(w[:-j][same] * sizes[k] + w[j:][same], 1)
            sentence, w = once(sentence, w, sizes[k])
            held.append((s.record_of[sentence], w))
        for x, y, n in crossed(*held, s.weights):
            sums[2].add(x * sizes[2] + y, n)
        if len(codes.names) > MOST_WORDS:
            codes.clear()
            known = {}
        for k in (0, 1, 2):
            if sums[k].full():
                yield packed(k, *sums[k].taken(), sizes[k])
    for k in (0, 1, 2):
        yield packed(k, *sums[k].taken(), sizes[k])


def crossed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(x, y, weight) of all pairs of words of both sides of each record, about BLOCK at once. first, second: (record, word), in order of records."""
    (rx, x), (ry, y) = first, second
    many = np.bincount(ry, minlength=len(weights))
    starts = np.cumsum(many) - many
    for n in np.unique(weights[rx]).tolist():
        own = np.flatnonzero((weights[rx] == n) & (many[rx] > 0))
        ends = np.cumsum(many[rx[own]])
        cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK)) + 1).tolist(), len(own)]
        for i, j in zip(cuts, cuts[1:]):
            part = own[i:j]
            size = many[rx[part]]
            to = np.repeat(starts[rx[part]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield np.repeat(x[part], size), y[to], n


def summed(batches: Iterator[pd.DataFrame], weights: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """(kind, a, bs, ns) with one row for each (kind, a), if all of its rows are in these batches. Of kind 2 only pairs remain that may be
    translations."""
    rows: dict[tuple[int, int], list] = {}
    for batch in batches:
        for kind, a, bs, ns in zip(batch.kind, batch.a, batch.bs, batch.ns):
            new = (np.asarray(bs, dtype=np.int64), np.asarray(ns, dtype=np.int64))
            old = rows.get((kind, a))
            rows[kind, a] = new if old is None else added(*(np.concatenate(x) for x in zip(old, new)))
    out = []
    for (kind, a), (b, n) in sorted(rows.items()):
        if kind == 2:
            ok = (n >= 2 * UNIT) & (2 * n >= LEAST_DICE * (weights[0][a] + weights[1][b]))
            b, n = b[ok], n[ok]
        if len(b):
            out.append((kind, a, b.astype(np.int32), n))
    yield pd.DataFrame(out, columns=["kind", "a", "bs", "ns"])


def added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.argsort(codes, kind="stable")
    codes, n = codes[turn], n[turn]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.add.reduceat(n, starts)


def flattened(counts: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) of each kind, in order."""
    out = []
    counts = counts.sort_by([("kind", "ascending"), ("a", "ascending")])
    for kind in (0, 1, 2):
        own = counts.filter(pc.equal(counts["kind"], kind)).combine_chunks()
        a = np.repeat(own["a"].to_numpy(), pc.list_value_length(own["bs"]).to_numpy())
        out.append((a, pc.list_flatten(own["bs"]).to_numpy(), pc.list_flatten(own["ns"]).to_numpy()))
    return out


def times(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sparse matrix of (rows, cols, values), sorted by rows, times x."""
    out = np.zeros_like(x)
    for i in range(0, len(rows), BLOCK // 64):
        part = slice(i, i + BLOCK // 64)
        r = rows[part]
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        out[r[starts]] += np.add.reduceat(values[part, None] * x[cols[part]], starts, axis=0)
    return out


def skipgram_vectors(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, dims: int) -> np.ndarray:
    """Rows of the factorised shifted positive PMI matrix of words and their neighbours; n: how often b comes after a."""
    codes, place = np.unique(np.concatenate([a.astype(np.int64) * size + b, b.astype(np.int64) * size + a]), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([n, n]), minlength=len(codes))
    rows, cols = codes // size, codes % size
    each = np.maximum(np.bincount(rows, weights=counts, minlength=size), 1e-9)
    pmi = np.log(counts * counts.sum() / (each[rows] * (each[cols] ** 0.75 * (counts.sum() / (each**0.75).sum())))) - np.log(2.0)
    rows, cols, ppmi = rows[pmi > 0], cols[pmi > 0], pmi[pmi > 0].astype(np.float32)
    turn = np.argsort(cols, kind="stable")
    there = lambda x: times(rows, cols, ppmi, x)
    back = lambda x: times(cols[turn], rows[turn], ppmi[turn], x)
    dims = min(dims, size)
    q = np.linalg.qr(there(back(there(np.random.default_rng(5).standard_normal((size, dims + 8)).astype(np.float32)))))[0]
    u, s, _ = np.linalg.svd(back(q).T, full_matrices=False)
    v = (q @ u)[:, :dims] * np.sqrt(s[:dims])
    v = np.pad(v, ((0, 0), (0, DIMS - v.shape[1])))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def vocabulary(words: pd.DataFrame) -> list[list[str]]:
    """Words of each side that come back, the most frequent first. Numbers have no vector, nor has what stands in more than half of all sentences."""
    names = []
    words = words.astype({"word": str})
    for k in ("n0", "n1"):
        own = words[(words[k] > 1) & (2 * words[k] <= words.loc[words.word == "", k].sum()) & ~words.word.str[:1].str.isdigit() & (words.word != "")]
        names.append([w for _, w in sorted(zip(-own[k], own.word))])
    return names


class Embedder:
    """Vectors of words in the common space. pairs: (text, text), in either direction."""

    def __init__(self, pairs: list[tuple[str, str]]):
        batch = pd.DataFrame(pairs, columns=["source", "target"])
        words = pd.concat(word_counts(iter([batch]))).groupby("word", as_index=False).sum()
        names = vocabulary(words)
        counts = pd.concat(summed(pair_counts(iter([batch]), places(names)), weights_of(words, names)))
        self.build(words, names, flattened(pa.table({c: pa.array(counts[c].tolist(), t) for c, t in COUNTS})))

    @classmethod
    def of(cls, words: pd.DataFrame, names: list[list[str]], counts: pa.Table) -> Embedder:
        """From the sums of word_counts and pair_counts; words seen once may be missing."""
        e = cls.__new__(cls)
        e.build(words, names, flattened(counts))
        return e

    def build(self, words: pd.DataFrame, names: list[list[str]], counts: list) -> None:
        self.rows = random_rows()
        self.memo: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.held = 0
        self.numbers: DataFrame | None = None  # (word, n) of the numbers that are not in idf
        self.own: dict[str, int] = {}  # of them, those of the record at hand
        self.table = np.zeros((1024, DIMS + COORDINATES), dtype=np.float32)
        total = words[words.word == ""]
        self.n = max(1, int(total[["n0", "n1"]].sum().max()))
        self.idf = {w: float(np.log(1 + self.n / k)) for w, k in zip(words.word, words.n0 + words.n1) if w}
        self.by_side: tuple[dict[str, np.ndarray], dict[str, np.ndarray]] = ({}, {})
        self.translations: dict[str, list[tuple[str, float]]] = {}
        if min(map(len, names)) > 2:
            self.fit(weights_of(words, names), names, counts)

    def fit(self, weights: list[np.ndarray], names: list[list[str]], counts: list) -> None:
        v = [skipgram_vectors(*counts[s], len(names[s]), DIMS) for s in (0, 1)]
        e, z, n = counts[2]
        dice = 2 * n / (weights[0][e] + weights[1][z])
        turn = np.lexsort((e, -dice, z))
        e, z, dice = e[turn], z[turn], dice[turn]
        first = np.concatenate((np.ones(min(1, len(z)), dtype=bool), z[1:] != z[:-1]))
        seeds = next((k for least in (0.5, 0.2) if (k := np.flatnonzero(first & (dice >= least))).size), None)
        if seeds is not None:
            u, _, w = np.linalg.svd(v[1][z[seeds]].T @ v[0][e[seeds]])
            v[1] = v[1] @ (u @ w)
        for s in (0, 1):
            self.by_side[s].update(zip(names[s], np.float32(SKIPGRAM_WEIGHT) * v[s]))
        alike = set()
        for i, j, d in zip(e.tolist(), z.tolist(), dice.tolist()):
            w = names[1][j]
            if names[0][i] == w and d >= ALIKE:
                alike.add(w)
            if len(found := self.translations.setdefault(w, [])) < 3:
                found.append((names[0][i], d))
        for w in alike:  # written alike and used alike: one word
            self.by_side[1][w] = self.by_side[0][w]
            del self.translations[w]

    @property
    def vectors(self) -> ChainMap:
        """Vectors of the words of either side."""
        return ChainMap(*self.by_side)

    def place(self, w: str) -> np.ndarray:
        """Coordinates of a word, or of its seed translations."""
        found = self.translations.get(w)
        if not found:
            return self.coordinates(w)
        c = sum(np.float32(d) * self.coordinates(e) for e, d in found)
        size = float(np.linalg.norm(c))
        return c / size * min(1.0, 2 * found[0][1]) if size else self.coordinates(w)

    def coordinates(self, w: str) -> np.ndarray:
        return self.rows[xxhash.xxh32_intdigest(w) % ROWS]

    def added(self, w: str, side: int) -> None:
        """A word gets its row in the table of word vectors, which grows as words come."""
        i = self.held
        self.held += 1
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        v = self.by_side[side].get(w)
        weight = self.idf.get(w)
        if weight is None:
            weight = float(np.log(1 + self.n / self.own.get(w, 1)))
        if w[0].isdigit():
            weight = max(weight, 2.0)
        row = self.table[i]
        row[:DIMS] = 0 if v is None else v
        row[DIMS:] = self.place(w) if side else self.coordinates(w)
        row *= np.float32(weight)
        self.memo[side][w] = i

    def vector(self, words: list[str], side: int) -> np.ndarray:
        if self.held + len(words) > MOST_WORDS and self.held:
            self.memo, self.held = ({}, {}), 0
        memo = self.memo[side]
        rows = list(map(memo.get, words))
        if None in rows:
            for w in words:
                if w not in memo:
                    self.added(w, side)
            rows = list(map(memo.get, words))
        return self.table[rows].sum(0) if rows else np.zeros(DIMS + COORDINATES, dtype=np.float32)

    def sentence(self, s: str) -> np.ndarray:
        """Vector of a sentence by itself; its script says on which side it stands."""
        words = pieces(s)
        return self.vector(words, int(2 * sum(map(beyond_latin, words)) > len(words)))

    def embedded(self, source: list[str], target: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the sentences of both sides of a document."""
        own = [[pieces(z) for z in x] for x in (source, target)]
        turned = bool(source) and not all(z.isascii() for z in source) and sides_turned(*own)
        return tuple(np.stack([self.vector(z, side ^ turned) for z in x or [[]]]) for side, x in enumerate(own))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": ({}, {}), "held": 0, "rows": None, "numbers": None, "own": {}, "table": self.table[:1024] * 0}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.rows = random_rows()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)


def spans(x: np.ndarray) -> dict[int, np.ndarray]:
    """For k = 1 to 3 the unit vectors of each k neighbouring sentences together."""
    out, total = {}, x
    for k in (1, 2, 3):
        if len(x) < k:
            break
        total = x if k == 1 else total[: len(x) - k + 1] + x[k - 1 :]
        out[k] = unit(total)
    return out


def warp(a: np.ndarray, b: np.ndarray, floor: float, windows: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """Beads (i, p, j, q) of the best monotone path. windows: for each i from 0 to len(a) the first and last j that the path may pass; only these
    cells are computed and held. They overlap from row to row and reach from corner to corner."""
    n, m = len(a), len(b)
    windows = windows or [(0, m)] * (n + 1)
    sa, sb = spans(a), spans(b)
    beads = [(p, q) for p, q in BEADS if p in sa and q in sb]
    best: list[list[float]] = []
    back: list[list[tuple[int, int] | None]] = []
    whole = {(p, q): (sa[p] @ sb[q].T).tolist() for p, q in beads} if (n + 1) * (m + 1) <= SMALL else None
    for i in range(n + 1):
        lo, hi = windows[i]
        gains: dict[int, list[tuple[float, int, int]]] = {}  # end in b -> beads that gain something
        for p, q in beads:
            if i >= p:
                plo, phi = windows[i - p]
                first, last = max(lo - q, plo, 0), min(hi - q, phi, m - q)  # places in b at which such a bead may begin
                if first <= last:
                    row = whole[p, q][i - p][first : last + 1] if whole else (sb[q][first : last + 1] @ sa[p][i - p]).tolist()
                    before = best[i - p]
                    for j, x in enumerate(row, first):
                        if x > floor:
                            gains.setdefault(j + q, []).append((before[j - plo] + (x - floor) * (p + q) / 2, p, q))
        up, (ulo, uhi) = (best[i - 1], windows[i - 1]) if i else (None, (0, -1))
        now: list[float] = []
        steps: list[tuple[int, int] | None] = []
        for j in range(lo, hi + 1):
            score, step = (0.0 if not i and not j else -1.0), None
            if ulo <= j <= uhi and up[j - ulo] > score:
                score, step = up[j - ulo], (1, 0)
            if j > lo and now[-1] > score:
                score, step = now[-1], (0, 1)
            if j in gains:
                for x, p, q in gains[j]:
                    if x > score:
                        score, step = x, (p, q)
            now.append(score)
            steps.append(step)
        best.append(now)
        back.append(steps)
        if i >= 3:
            best[i - 3] = []  # no bead reaches further back
    out, i, j = [], n, m
    while i or j:
        p, q = back[i][j - windows[i][0]] or ((1, 0) if i else (0, 1))
        if p and q:
            out.append((i - p, p, j - q, q))
        i, j = i - p, j - q
    return out[::-1]


def halved(x: np.ndarray) -> np.ndarray:
    return np.stack([x[i : i + 2].sum(0) for i in range(0, len(x), 2)])


def coarse_to_fine(a: np.ndarray, b: np.ndarray, floor: float, width: int = 4) -> list[tuple[int, int, int, int]]:
    """Beads of the path; beyond SMALL cells it is sought at half the resolution first, and then within `width` sentences beside what was found."""
    n, m = len(a), len(b)
    if n * m <= SMALL or min(n, m) < 8:
        return warp(a, b, floor)
    rough = coarse_to_fine(halved(a), halved(b), floor * 0.7, width)
    points = sorted({(0, 0), (n, m), *((min(n, 2 * i), min(m, 2 * j)) for i, _, j, _ in rough), *((min(n, 2 * (i + p)), min(m, 2 * (j + q))) for i, p, j, q in rough)})
    lo, hi = [m] * (n + 1), [0] * (n + 1)
    for (i, j), (k, l) in zip(points, points[1:]):
        for x in range(i, k + 1):  # the line between two points of the path, widened on all sides
            y, z = (j + (l - j) * (x - i) // max(1, k - i), j + -(-(l - j) * (x + 1 - i) // max(1, k - i))) if k > i else (j, l)
            for u in range(max(0, x - width), min(n, x + width) + 1):
                lo[u], hi[u] = min(lo[u], max(0, y - width)), max(hi[u], min(m, z + width))
    return warp(a, b, floor, list(zip(lo, hi)))


def summed_rows(x: np.ndarray, rows: set[int]) -> np.ndarray:
    return x[next(iter(rows))] if len(rows) == 1 else x[sorted(rows)].sum(0)


def moved_pairs(ua: np.ndarray, ub: np.ndarray, free: list[set[int]], least: float) -> list[tuple[int, int]]:
    """Unaligned sentences matched without order, best first: in each round those that are each other's nearest are paired. Cosines are formed
    in blocks and only the nearest are kept."""
    left = [np.array(sorted(x), dtype=np.int64) for x in free]
    out: list[tuple[int, int]] = []
    while len(left[0]) and len(left[1]):
        x, y = left
        block = max(1, CELLS // len(y))
        top, at = np.full(len(y), -2.0), np.zeros(len(y), dtype=np.int64)
        own, own_at = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
        there = y / len(ub)
        for k in range(0, len(x), block):
            c = ua[x[k : k + block]] @ ub[y].T - HELD_BACK * np.abs(x[k : k + block, None] / len(ua) - there)
            own[k : k + block], own_at[k : k + block] = c.max(1), c.argmax(1)
            down = c.argmax(0)
            high = c[down, np.arange(len(y))]
            better = high > top
            top[better], at[better] = high[better], down[better] + k
        met = np.flatnonzero((own >= least - HELD_BACK) & (at[own_at] == np.arange(len(x))))
        if not len(met):
            break
        out += zip(x[met].tolist(), y[own_at[met]].tolist())
        keep = own >= least - HELD_BACK  # what is near to nothing now is near to nothing later
        keep[met] = False
        rest = np.ones(len(y), dtype=bool)
        rest[own_at[met]] = False
        left = [x[keep], y[rest & (top >= least - HELD_BACK)]]
    return out


def aligned(a: np.ndarray, b: np.ndarray, floor: float, moved: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of sentences, from 0. Memory grows with the number of sentences, not with its square."""
    if not len(a) or not len(b):
        return []
    ua, ub = unit(a), unit(b)
    groups: list[tuple[set[int], set[int]]] = []
    for i, p, j, q in coarse_to_fine(a, b, floor):
        groups.append((set(range(i, i + p)), set(range(j, j + q))))

    def cosine(x: set[int], y: set[int]) -> float:
        s, t = summed_rows(a, x), summed_rows(b, y)
        return float(s @ t) / max(1e-9, math.sqrt(float(s @ s) * float(t @ t)))

    # A sentence that adds nothing to its bead leaves it.
    for x, y in groups:
        for side, of in ((x, 0), (y, 1)):
            while len(side) > 1:
                now = cosine(x, y)
                rest = [(cosine(x - {k}, y) if of == 0 else cosine(x, y - {k}), k) for k in side]
                top, k = max(rest)
                if top < now:
                    break
                side.discard(k)
    free = [set(range(len(a))) - {i for x, _ in groups for i in x}, set(range(len(b))) - {j for _, y in groups for j in y}]
    # What was moved: unaligned sentences among themselves, best first.
    for i, j in moved_pairs(ua, ub, free, moved):
        groups.append(({i}, {j}))
        free[0].discard(i)
        free[1].discard(j)
    # What completes a merged rendering: an unaligned sentence beside the others of a group, or one that took the place of a better one.
    for side in (0, 1):
        of = {k: g for g, group in enumerate(groups) for k in group[1 - side]}  # group of each sentence of the other side
        for k in sorted(free[side]):
            link = (ub @ ua[k]) if side == 0 else (ua @ ub[k])
            options = []
            for g in {of[j] for j in np.flatnonzero(link >= floor * 0.8).tolist() if j in of}:
                x, y = groups[g]
                if len(x) > 1 and side == 1 or len(y) > 1 and side == 0:
                    continue
                now = cosine(x, y)
                more = cosine(x | {k}, y) if side == 0 else cosine(x, y | {k})
                if more > now + 0.02:
                    options.append((more - now, g))
            if options:
                groups[max(options)[1]][side].add(k)
                free[side].discard(k)
    return sorted({(i, j) for x, y in groups for i in x for j in y})


PAIRS = T.ArrayType(T.StructType([T.StructField("src_pos", T.IntegerType()), T.StructField("tgt_pos", T.IntegerType())]))


def places(names: list[list[str]]) -> list[dict[str, int]]:
    return [{w: i for i, w in enumerate(n)} for n in names]


def weights_of(words: pd.DataFrame, names: list[list[str]]) -> list[np.ndarray]:
    own = words.set_index("word")
    return [own[f"w{s}"].reindex(names[s]).to_numpy(dtype=np.int64) for s in (0, 1)]


def filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames with rows; those of a partition without records have no types."""
    return (x for x in frames if len(x))


def fitted(records: DataFrame) -> Embedder:
    """records: (source, target), both non-blank. All of them are counted where they lie; the driver gets the sums. Numbers grow with the records:
    only the most frequent are sent to the driver, the counts of the others stay a table."""
    texts, context = records.select("source", "target"), records.sparkSession.sparkContext
    words = texts.mapInPandas(lambda x: filled(word_counts(x)), "word string, n0 long, n1 long, w0 long, w1 long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "w0", "w1")))
    words = cut(words.where((F.col("n0") + F.col("n1") > 1) | (F.col("word") == "")))
    number = F.col("word").rlike("^[0-9]")
    numbers = words.where(number)
    top = numbers.orderBy((F.col("n0") + F.col("n1")).desc(), "word").limit(MOST_NUMBERS).toPandas()
    words = pd.concat([words.where(~number).toPandas(), top], ignore_index=True)
    names = vocabulary(words)
    shared = context.broadcast((places(names), weights_of(words, names)))
    schema = "kind int, a int, bs array<int>, ns array<long>"
    counts = texts.mapInPandas(lambda x: filled(pair_counts(x, shared.value[0])), schema).repartition("kind", "a").mapInPandas(lambda x: filled(summed(x, shared.value[1])), schema)
    e = Embedder.of(words, names, counts.toArrow())
    if len(top) == MOST_NUMBERS:
        held = records.sparkSession.createDataFrame(top[["word"]], "word string")
        e.numbers = numbers.join(F.broadcast(held), "word", "left_anti").select("word", (F.col("n0") + F.col("n1")).alias("n"))
    return e


def several(text: str) -> F.Column:
    """Whether a text may have two sentences."""
    return F.col(text).rlike(r"[。！？]\s*[^\s。！？]|[.!?]\s+\S")


def numbers_of(text: str) -> F.Column:
    """The numbers among the pieces of a text."""
    found = F.regexp_extract_all(F.regexp_replace(text, BROKEN.pattern, ""), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))


def with_numbers(records: DataFrame, counted: DataFrame | None) -> DataFrame:
    """Records with the numbers of theirs that are in counted: (word, n), and their counts. Records are told apart by a hash; should two have the
    same, each gets the numbers of both, which changes nothing."""
    if counted is None:
        return records.withColumns({"numbers": F.lit(None).cast("array<string>"), "counts": F.lit(None).cast("array<bigint>")})
    records = records.withColumn("row", F.xxhash64("record_id", "source", "target"))
    own = records.select("row", F.explode(F.array_distinct(F.concat(numbers_of("source"), numbers_of("target")))).alias("word"))
    found = own.join(counted, "word").groupBy("row").agg(F.collect_set(F.struct("word", "n")).alias("found"))
    return records.join(found, "row", "left").withColumns({"numbers": F.col("found.word"), "counts": F.col("found.n")}).drop("row", "found")


def alignments(records: DataFrame, embedder: Embedder, floor: float = 0.3, moved: float = 0.42) -> DataFrame:
    """records: (record_id, source, target, least), both non-blank -> (record_id, src_pos, tgt_pos) of the records that have `least` sentences
    or more on a side."""
    broadcast = records.sparkSession.sparkContext.broadcast(embedder)
    records = with_numbers(records, embedder.numbers)

    @F.pandas_udf(PAIRS)
    def pairs(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        e = broadcast.value
        for source, target, least, numbers, counts in batches:
            out = []
            for s, t, n, w, k in zip(source, target, least, numbers, counts):
                e.own = dict(zip(w, k)) if w is not None else {}
                a, b = sentences(s), sentences(t)
                if max(len(a), len(b)) < n:
                    out.append([])
                    continue
                x, y = e.embedded(a, b)
                out.append([{"src_pos": i + 1, "tgt_pos": j + 1} for i, j in aligned(x, y, floor, moved)])
            yield pd.Series(out)

    return records.select("record_id", F.inline(pairs("source", "target", "least", "numbers", "counts"))).distinct()
