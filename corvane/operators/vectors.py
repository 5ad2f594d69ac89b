"""Cosine similarity of dense vectors: a pair function in the JVM, and exact top-k of a query set against all rows.

An empty vector, vectors of unlike length and a vector of norm 0 have similarity 0 with everything. `top_k` broadcasts the query set, in as few
blocks as a broadcast of `most_bytes` allows, so 20 million vectors of 128 numbers are some 300 scans of the rows at the default and one tenth at
ten times of it; each task multiplies its rows with a block and keeps its best k for each query, so the shuffle carries at most tasks x queries
x k rows. Ties go to the smaller id. Null vectors are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def unit_rows(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.float64)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = v
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


SUB = 1024  # queries multiplied at once in a task


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best scores and their ids, the smaller id first among equals. What is not there has the score -inf."""
    if scores.shape[1] > 4 * k:  # ties with the kth best stay in, so that their ids decide
        edge = np.partition(scores, -k, axis=1)[:, -k]
        most = int((scores >= edge[:, None]).sum(1).max())
        if most < scores.shape[1]:
            at = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    turn = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, turn, 1), np.take_along_axis(ids, turn, 1)


def top_k(queries: DataFrame, rows: DataFrame, k: int, block: int | None = None, least: float | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, id, score, rank): queries and rows are (id, vector); a row is not matched with itself. block: queries in one broadcast."""
    spark = rows.sparkSession
    queries = queries.where(F.col("vector").isNotNull()).select("id", "vector")
    total, dim = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    block = block or max(1, most_bytes // (8 * max(1, dim)))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // block)))))
    blocks = [r.block for r in numbered.select("block").distinct().orderBy("block").collect()]
    parts = []
    for b in blocks:
        chunk = numbered.where(F.col("block") == b).orderBy("id").collect()
        ids = np.array([r.id for r in chunk])
        table = spark.sparkContext.broadcast((ids, unit_rows([r.vector for r in chunk], dim), dim))

        def best(batches: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            qids, q, dim = table.value
            kept, kept_ids = np.full((len(qids), k), -np.inf), np.full((len(qids), k), np.iinfo(np.int64).max)
            for pdf in batches:
                own, vectors = pdf["id"].to_numpy(dtype=np.int64), unit_rows(list(pdf["vector"]), dim).T
                for i in range(0, len(qids) if len(own) else 0, SUB):
                    part = slice(i, i + SUB)
                    scores = q[part] @ vectors
                    scores[qids[part, None] == own] = -np.inf
                    kept[part], kept_ids[part] = best_of(np.concatenate([kept[part], scores], 1), np.concatenate([kept_ids[part], np.broadcast_to(own, scores.shape)], 1), k)
            at, place = np.nonzero(kept > -np.inf)
            yield pd.DataFrame({"query_id": qids[at].astype(np.int64), "id": kept_ids[at, place], "score": kept[at, place]})

        parts.append(rows.select("id", "vector").where(F.col("vector").isNotNull()).mapInPandas(best, "query_id long, id long, score double"))
    if not parts:
        return rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    found = reduce(DataFrame.unionByName, parts)
    if least is not None:
        found = found.where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def changed(rows: DataFrame, stored: DataFrame, model: str, dim: int) -> DataFrame:
    """Rows (id, lang, text) whose embedding is not there or no longer theirs: another text, model or length. stored: (id, text_hash, model, dim)."""
    text_hash = F.sha2(F.concat(F.coalesce("lang", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))), 256)
    now = rows.withColumn("text_hash", text_hash)
    same = stored.where((F.col("model") == model) & (F.col("dim") == dim)).select("id", "text_hash")
    return now.join(same, ["id", "text_hash"], "left_anti")
