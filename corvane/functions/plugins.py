"""Functions of the user in a plan: providers that map batches of texts (a model, a service, an embedder), with retries and a size limit.

The provider is made once for each task, by a factory, so it may hold a connection. A batch that fails is tried again, then halved until the
row that fails is alone; its result is null and its error says why, so one bad row costs one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Provider = Callable[[list[str]], list[str]]


def answered(provider: Provider, texts: list[str], tries: int, wait: float) -> list[tuple[str | None, str | None]]:
    error = ""
    for n in range(tries):
        try:
            out = provider(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(texts)} texts, {len(out)} answers")
            return [(x, None) for x in out]
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is reported with the row
            error = f"{type(e).__name__}: {e}"
            time.sleep(wait * 2**n)
    if len(texts) == 1:
        return [(None, error)]
    half = len(texts) // 2
    return answered(provider, texts[:half], tries, wait) + answered(provider, texts[half:], tries, wait)


def apply_provider(df: DataFrame, column: str, factory: Callable[[], Provider], batch: int = 32, tries: int = 3, wait: float = 0.5, tasks: int | None = None) -> DataFrame:
    """The frame with `answer` and `error`. tasks bounds how many providers work at a time. Null and empty texts are not sent."""
    rows = df.coalesce(tasks) if tasks else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in batches:
            answers: list[tuple[str | None, str | None]] = [(None, None)] * len(pdf)
            send = [i for i, t in enumerate(pdf[column]) if t]
            for a in range(0, len(send), batch):
                part = send[a : a + batch]
                for i, x in zip(part, answered(provider, [pdf[column].iloc[i] for i in part], tries, wait)):
                    answers[i] = x
            yield pdf.assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", answer string, error string"
    return rows.mapInPandas(run, schema)


def register_all(spark: SparkSession) -> list[str]:
    """The Arrow functions of this package by name, for SQL."""
    from corvane.functions import udfs

    found = udfs.register()
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)
