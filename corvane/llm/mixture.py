"""Mixing sources to target weights (problem 9).

Every document gets a random key (a hash of its identifier and a seed) and is range-sorted by (source, key). Each partition forms running
sums of its tokens by source; the partition totals, a few numbers for each partition and source, give the offsets that turn them into
prefix sums over the whole source. A source's budget is its share of the total; it is filled with whole epochs and then with the documents
whose prefix sum starts below the rest. The last document is used only as far as the budget goes, so shares are exact to the token.

The total is given, or the largest at which every source can reach its share within its `max_repeats`. A given total beyond that is not
reached: sources that run out give all they may, and the reached shares say so. A source of any size is spread over the range partitions,
so no task holds a whole source.

Tokens are those of a public tokenizer; the path of its ranks is a parameter.

Cases: documents with null or blank text or null source, and sources without a target, stay out; a target without documents, or with a share
or a number of repeats of 0 or less, gets nothing, is reported as such and does not bound the total; two targets for one source count as the
smaller pair; empty tables give an empty mixture; ties of the key are broken by the identifier; repeated rows of a document count once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import broadcast_if_small, checked_broadcast_rows, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to this public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = TOKENIZER):
    """A column function: number of tokens of a text."""

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for s in texts:
            yield s.map(lambda x: 0 if x is None else len(encode(x)))

    return n_tokens


SORTED = "source string, doc_id bigint, n_tokens bigint, part int, below bigint"


def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of the same source before each document, within a partition."""
    so_far: dict[str, int] = {}
    part = TaskContext.get().partitionId()
    for b in batches:
        sums = b.groupby("source", sort=False)["n_tokens"].cumsum() - b["n_tokens"]
        below = sums + b["source"].map(so_far).fillna(0).astype("int64")
        for s, n in b.groupby("source")["n_tokens"].sum().items():
            so_far[s] = so_far.get(s, 0) + int(n)
        yield pd.DataFrame({"source": b["source"], "doc_id": b["doc_id"], "n_tokens": b["n_tokens"], "part": part, "below": below.astype("int64")})


def prefix_sums(docs: DataFrame, targets: DataFrame, tokenizer: str, seed: int, partitions: int | None) -> DataFrame:
    """(source, doc_id, n_tokens, below): below counts the tokens of the source's documents that come earlier in its random order."""
    spark = docs.sparkSession
    wanted = targets.select("source").where(F.col("source").isNotNull()).distinct()
    rows = docs.select("source", "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("text").rlike(r"\S")).join(broadcast_if_small(wanted, 1_000_000), "source", "left_semi")
    counted = rows.select("source", "doc_id", token_counter(tokenizer)("text").alias("n_tokens")).groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = counted.withColumn("key", F.xxhash64(F.lit(seed), F.col("doc_id")))
    spread = keyed.repartitionByRange(n, "source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id").select("source", "doc_id", "n_tokens")
    local = cut(spread.mapInPandas(running, SORTED))
    totals = local.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    offsets = {}
    so_far: dict[str, int] = {}
    for r in sorted(checked_broadcast_rows(totals, 5_000_000, "the table of partition totals"), key=lambda r: (r.source, r.part)):
        offsets[r.part, r.source] = so_far.get(r.source, 0)
        so_far[r.source] = so_far.get(r.source, 0) + r.n
    table = spark.createDataFrame([(p, s, o) for (p, s), o in offsets.items()], "part int, source string, offset bigint")
    return local.join(F.broadcast(table), ["part", "source"]).select("source", "doc_id", "n_tokens", (F.col("below") + F.col("offset")).alias("below"))


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, int]:
    """Tokens of each source: its share of the total, at most what its repeats allow."""
    live = {s: (w, r) for s, (w, r) in targets.items() if available.get(s, 0) > 0 and w > 0 and r > 0}
    whole = sum(w for w, _ in live.values())
    if not live:
        return {}
    most = min(available[s] * r * whole / w for s, (w, r) in live.items())
    size = most if total is None else total
    return {s: min(int(size * w / whole + 1e-6), available[s] * r) for s, (w, r) in live.items()}


def plan(docs: DataFrame, targets: DataFrame, total: int | None, tokenizer: str, seed: int, partitions: int | None) -> tuple[DataFrame, list[tuple]]:
    sums = prefix_sums(docs, targets, tokenizer, seed, partitions)
    rows = checked_broadcast_rows(targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.min("target_share").alias("w"), F.min("max_repeats").alias("r")), 1_000_000, "the table of targets")
    wanted = {x.source: (x.w or 0.0, x.r or 0) for x in rows}
    have = {r.source: r.n for r in sums.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row for each wanted source
    got = budgets(have, wanted, total)
    return sums, [(s, w, r, have.get(s, 0), got.get(s, 0)) for s, (w, r) in sorted(wanted.items())]


BUDGET = "source string, target_share double, max_repeats int, available bigint, budget bigint"


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """(source, doc_id, epoch, n_tokens, used_tokens): every use of a document; used_tokens is below n_tokens for the last of a source."""
    sums, table = plan(docs, targets, total, tokenizer, seed, partitions)
    b = docs.sparkSession.createDataFrame(table, BUDGET).where(F.col("budget") > 0)
    left = F.col("budget") - F.col("below")
    uses = F.ceil(left / F.col("available")).cast("int")  # epochs in which the document starts below the budget
    rows = sums.where(F.col("n_tokens") > 0).join(F.broadcast(b), "source").where(left > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), uses - 1)))
    used = F.least("n_tokens", left - F.col("epoch") * F.col("available"))
    return rows.select("source", "doc_id", "epoch", "n_tokens", used.alias("used_tokens"))


def reached(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """(source, target_share, reached_share, tokens, available, epochs): what the mixture holds of each target."""
    _, table = plan(docs, targets, total, tokenizer, seed, partitions)
    b = docs.sparkSession.createDataFrame(table, BUDGET)
    whole = max(1, sum(x[4] for x in table))
    epochs = F.when(F.col("available") > 0, F.col("budget") / F.col("available")).otherwise(0.0)
    return b.select("source", "target_share", (F.col("budget") / F.lit(whole)).alias("reached_share"), F.col("budget").alias("tokens"), "available", epochs.alias("epochs"))
