"""Subject area of each document (problem 10).

An interpolated n-gram language model (maximum likelihood estimates of order 1 to 3, mixed with fixed weights and a uniform floor) is
trained for each subject on the labelled documents, and a background model for each subject on all others. Numbers are one token; Chinese
goes by characters. A sentence treats the subject with the lowest cross-entropy per token if that lies far enough below the cross-entropy of
the subject's background; sentences that any subject may hold (references, formulas, passing remarks) cost the same under both and treat
none. A document has every subject that at least `share` of its sentences treat.

Training starts from the documents with one label and is repeated with each sentence of a labelled document given to the label that it fits
best (or to none), so documents with several labels can be used too. The thresholds of the cross-entropy difference are calibrated on
documents that were held out of the training, by the F1 over (document, subject): one value for all subjects first, and then for each subject in
turn its own, where that is better.

Only the classifier is fitted on a sample: at most `most_labelled` labelled documents, those with the smallest hash of their identifier.
All documents are scored, whole, where they lie; what is shuffled is (id, subject).

Cases: null and empty texts have no subject; sentences that a leaked test passage covers by half do not count at all; documents with a
label are left out of `unlabelled`; without labels there is no subject to find and the result is empty; repeated rows give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import leakage
from corvane.llm.sentences import sentence_spans, words
from corvane.session import hash_sample

ORDER = 3
WEIGHTS = (0.05, 0.2, 0.3, 0.45)  # uniform, then orders 1 to 3
ROUNDS = 3
GRID = tuple(x / 20 for x in range(1, 41))


def model_tokens(sentence: str) -> tuple[str, ...]:
    return ("<s>", "<s>", *("#" if w[0].isdigit() else w for w in words(sentence)), "</s>")


class Models:
    """One n-gram model for each subject and one for its background, evaluated together: each n-gram has a row of log probabilities."""

    def __init__(self, subjects: list[str], counts: list[dict[int, Counter]]):
        self.subjects, k = subjects, len(subjects)
        totals = [Counter() for _ in range(ORDER + 1)]
        for c in counts:
            for n in range(1, ORDER + 1):
                totals[n].update(c[n])
        vocabulary = len(totals[1]) + 1
        grams = [g for n in range(1, ORDER + 1) for g in totals[n]]
        self.row = {g: i for i, g in enumerate(grams)}
        own = np.zeros((len(grams), k))
        for j, c in enumerate(counts):
            for n in range(1, ORDER + 1):
                for g, v in c[n].items():
                    own[self.row[g], j] = v
        both = np.concatenate([own, own.sum(1, keepdims=True) - own], 1)
        context: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(2 * k))
        for g in grams:
            context[g[:-1]] = context[g[:-1]] + both[self.row[g]]
        ratio = {}
        self.log = np.zeros((len(grams) + 1, 2 * k), dtype=np.float32)
        floor = WEIGHTS[0] / vocabulary
        self.log[-1] = math.log(floor)
        for g in grams:  # by order, so the shorter n-gram is there
            shorter = ratio[g[1:]] if len(g) > 1 else np.full(2 * k, floor)
            ratio[g] = shorter + WEIGHTS[len(g)] * both[self.row[g]] / np.maximum(context[g[:-1]], 1e-9)
            self.log[self.row[g]] = np.log(ratio[g])

    def gains(self, sentence: str) -> np.ndarray:
        """Cross-entropy per token of each background less that of its subject's model, in nats."""
        t = model_tokens(sentence)
        rows, get, none = [], self.row.get, len(self.log) - 1
        for i in range(2, len(t)):
            r = get(t[i - 2 : i + 1])
            if r is None:
                r = get(t[i - 1 : i + 1])
                if r is None:
                    r = get(t[i : i + 1], none)
            rows.append(r)
        mean = self.log[rows].mean(0)
        k = len(self.subjects)
        return mean[:k] - mean[k:]


def count(sentences: list[str]) -> dict[int, Counter]:
    out: dict[int, Counter] = {n: Counter() for n in range(1, ORDER + 1)}
    for s in sentences:
        t = model_tokens(s)
        for n in range(1, ORDER + 1):
            out[n].update(t[i - n + 1 : i + 1] for i in range(2, len(t)))
    return out


def train(docs: list[tuple[list[str], list[str]]], subjects: list[str], thresholds: np.ndarray) -> Models:
    """docs: (sentences, labels). From the documents with one label, then with each sentence at the label that it fits."""
    held = {s: [x for sents, labels in docs if labels == [s] for x in sents] for s in subjects}
    for s in subjects:  # a subject that never stands alone starts from all its documents
        held[s] = held[s] or [x for sents, labels in docs if s in labels for x in sents]
    models = Models(subjects, [count(held[s]) for s in subjects])
    place = {s: j for j, s in enumerate(subjects)}
    for _ in range(ROUNDS - 1):
        held = {s: [] for s in subjects}
        for sents, labels in docs:
            for x in sents:
                g = models.gains(x)
                best = max(labels, key=lambda s: g[place[s]])
                if g[place[best]] > thresholds[place[best]]:
                    held[best].append(x)
                else:
                    for s in subjects:  # says nothing of a subject: known to all models alike
                        held[s].append(x)
        models = Models(subjects, [count(held[s]) for s in subjects])
    return models


def decide(gains: list[np.ndarray], subjects: list[str], thresholds: np.ndarray, share: float) -> list[str]:
    if not gains:
        return []
    best = Counter(j for g in gains if g[j := int(g.argmax())] > thresholds[j])
    return [subjects[j] for j, n in sorted(best.items()) if n >= share * len(gains) - 1e-9]


class Held:
    """Scored sentences of held-out documents, for the F1 of many thresholds."""

    def __init__(self, docs: list[tuple[list[np.ndarray], set[str]]], subjects: list[str], share: float):
        self.k, self.n = len(subjects), len(docs)
        gains = np.array([g for d, _ in docs for g in d])
        self.best, self.top = gains.argmax(1), gains.max(1)
        sizes = np.array([len(d) for d, _ in docs])
        self.cell = np.repeat(np.arange(self.n), sizes) * self.k + self.best
        self.least = np.maximum(share * sizes - 1e-9, 0.5)[:, None]
        self.true = np.array([[s in labels for s in subjects] for _, labels in docs])

    def f1(self, thresholds: np.ndarray) -> float:
        counts = np.bincount(self.cell[self.top > thresholds[self.best]], minlength=self.n * self.k).reshape(self.n, self.k)
        got = counts >= self.least
        return 2 * float((got & self.true).sum()) / max(1, int(got.sum() + self.true.sum()))

    def best_of(self, thresholds: np.ndarray, which: list[int]) -> np.ndarray:
        """The thresholds with the middle of the best values of the grid for some of the subjects; as they are where that is as good."""
        now, marks = self.f1(thresholds), []
        for x in GRID:
            tried = thresholds.copy()
            tried[which] = x
            marks.append((self.f1(tried), x))
        top = max(m for m, _ in marks)
        if top <= now + 1e-3:
            return thresholds
        good = [x for m, x in marks if m >= top - 1e-3]
        out = thresholds.copy()
        out[which] = good[len(good) // 2]
        return out


def calibrated(docs: list[tuple[list[str], list[str]]], subjects: list[str], share: float, folds: int = 2) -> np.ndarray:
    """The threshold of each subject, by the F1 on documents held out of the training."""
    start, scored = np.full(len(subjects), 0.3), []
    for f in range(folds):
        models = train([d for i, d in enumerate(docs) if i % folds != f], subjects, start)
        scored += [([models.gains(x) for x in sents], set(labels)) for i, (sents, labels) in enumerate(docs) if i % folds == f]
    held = Held(scored, subjects, share)
    out = held.best_of(np.full(len(subjects), np.inf), list(range(len(subjects))))
    if np.isinf(out).any():  # no value finds anything
        return start
    for j in range(len(subjects)):
        out = held.best_of(out, [j])
    return out


def counted_sentences(text: str | None, leaked: list[tuple[str, float, int, int]]) -> list[str]:
    spans = sentence_spans(text, paragraphs=True)
    if leaked and spans:
        cuts = [(a, b) for _, _, a, b in leaked]
        spans = [(a, b) for a, b in spans if all(2 * (min(b, y) - max(a, x)) < b - a for x, y in cuts)]
    return [s for a, b in spans if words(s := text[a:b])]


class Classifier:
    def __init__(self, models: Models, thresholds: np.ndarray, share: float, items: tuple):
        self.models, self.thresholds, self.share, self.items = models, thresholds, share, items
        self.memo: dict[str, np.ndarray] = {}

    def __call__(self, text: str | None, leaked: list) -> list[str]:
        gains = []
        for s in counted_sentences(text, leaked):
            key = re.sub(r"\d+", "0", s)
            g = self.memo.get(key)
            if g is None:
                g = self.models.gains(s)
                if len(self.memo) < 300_000:
                    self.memo[key] = g
            gains.append(g)
        return decide(gains, self.models.subjects, self.thresholds, self.share)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple[str, list[str]]]:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    few = hash_sample(known, "doc_id", most)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").select("doc_id", "text", "labels", F.xxhash64("doc_id").alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r.h, r.doc_id))[:most]
    return [(r.text, r.labels) for r in rows]


def fitted(docs: DataFrame, labels: DataFrame, items: DataFrame | None, share: float, most_labelled: int) -> Classifier | None:
    known = leakage.item_rows(items) if items is not None else ()
    finder = leakage.Finder(list(known)) if known else None
    rows = labelled_sample(docs, labels, most_labelled)
    sample = [(s, l) for (t, l), x in zip(rows, leaked_in([t for t, _ in rows], finder)) if (s := counted_sentences(t, x))]
    subjects = sorted({s for _, l in sample for s in l})
    if not subjects:
        return None
    thresholds = calibrated(sample, subjects, share) if len(sample) > 3 else np.full(len(subjects), 0.3)
    return Classifier(train(sample, subjects, thresholds), thresholds, share, known)


def leaked_in(texts: list[str], finder: leakage.Finder | None) -> list[list]:
    return finder.all(texts) if finder else [[] for _ in texts]


@lru_cache(2)
def finder_of(items: tuple) -> leakage.Finder | None:
    return leakage.Finder(list(items)) if items else None


def subject_areas(docs: DataFrame, labels: DataFrame, items: DataFrame | None = None, share: float = 0.2, most_labelled: int = 2_000) -> DataFrame:
    """(doc_id, subject) of every document."""
    spark = docs.sparkSession
    fit = fitted(docs, labels, items, share, most_labelled)
    if fit is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("subject")).limit(0)
    broadcast = spark.sparkContext.broadcast(fit)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def areas(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = broadcast.value
        f = finder_of(c.items)
        for s in texts:
            yield pd.Series([c(x, y) for x, y in zip(s, leaked_in(s.tolist(), f))], dtype=object)

    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", F.explode(areas("text")).alias("subject")).distinct()


def unlabelled(docs: DataFrame, labels: DataFrame, items: DataFrame | None = None, **kw) -> DataFrame:
    """(doc_id, subject) of the documents without a label. The anti-join comes last, on identifiers, so that no text is shuffled."""
    return subject_areas(docs, labels, items, **kw).join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
