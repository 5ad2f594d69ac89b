"""Relational operators over ledgers: latest versions, keyset pages, priority merges, diffs, intervals, gaps, rates.

All are DataFrame in, DataFrame out, and need at most one shuffle on the key that their definition names. Nulls in ordering columns come
first in descending and last in ascending order, as stated; ties are broken by the columns given, which should make rows unique. Empty
frames give empty frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "_row_number"


def best_per_key(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key. Compiles to a window group limit, which drops all but the best rows before the shuffle."""
    return df.withColumn(ROW, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(ROW) == 1).drop(ROW)


def first_n_per_key(df: DataFrame, keys: list[str | Column], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: list | None, size: int) -> DataFrame:
    """The page of `size` rows behind the row `after` (its values of the order columns). order: (column, ascending).

    The condition on the first column alone is stated too, since it is the one that the scan can use to skip row groups.
    """
    rows = df
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (name, ascending), value in zip(order, after):
            beyond = beyond | (same & (F.col(name) > F.lit(value) if ascending else F.col(name) < F.lit(value)))
            same = same & (F.col(name) == F.lit(value))
        name, ascending = order[0]
        rows = rows.where(F.col(name) >= F.lit(after[0]) if ascending else F.col(name) <= F.lit(after[0])).where(beyond)
    return rows.orderBy(*[F.col(n).asc() if a else F.col(n).desc() for n, a in order]).limit(size)


def diff(old: DataFrame, new: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, change): added, removed or changed between two states with one row for each key. A null payload equals a null one."""
    a, b = old.select(F.col(key), F.col(payload).alias("_old"), F.lit(1).alias("_in_old")), new.select(F.col(key), F.col(payload).alias("_new"), F.lit(1).alias("_in_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())


def gap_clusters(df: DataFrame, keys: list[str], at: str, gap: float, tie: str) -> DataFrame:
    """The frame with `cluster`: numbered from 1 within a key, a new one where the value lies more than `gap` behind the one before."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0, slice_width: float | None = None, firsts: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start, end, n): intervals that overlap, or lie at most `gap` apart, as one. Rows with a null bound are left out.

    firsts: columns whose smallest value in each merged interval is kept too. slice_width: intervals are merged within slices of that width
    first, by (keys, slice), and what is left is merged by key: the result is the same, and a key that holds a third of all rows is spread
    over the tasks of its slices.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), F.lit(1).cast("long").alias("n"), *firsts)

    def merged(x: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start", "end")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        x = x.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1))
        x = x.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return x.groupBy(*by, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *[F.min(f).alias(f) for f in firsts]).drop("_group")

    if slice_width:
        rows = merged(rows.withColumn("_slice", F.floor(F.col("start") / slice_width)), [*keys, "_slice"]).drop("_slice")
    return merged(rows, keys)


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The frame with the last non-null `value` up to each row: a running state over ordered rows, such as the section that a line is in."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def rate(df: DataFrame, keys: list[str], seconds: Column, span: int, amount: Column, slice_width: int | None = None) -> DataFrame:
    """The frame with `in_window`: the amount of the last `span` seconds, each row's own second included.

    slice_width (at least `span`): each row also stands as context in the next slice of time, and the window runs by (keys, slice), so a key
    that holds a third of all rows is spread over tasks.
    """
    if not slice_width:
        return df.withColumn("in_window", F.sum(amount).over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-span, 0)))
    if slice_width < span:
        raise ValueError("a slice must be as wide as the window")
    rows = df.withColumn("_at", seconds).withColumn("_amount", amount).withColumn("_own", F.floor(F.col("_at") / slice_width))
    rows = rows.withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(-span, 0)
    return rows.withColumn("in_window", F.sum("_amount").over(w)).where(F.col("_slice") == F.col("_own")).select(*df.columns, "in_window")


def state_token(df: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """(keys, n, token): an order-free token of the distinct items of each key that needs no list of them.

    It is the sum of two 64-bit hashes of each item, so it combines partially; equal sets have equal tokens, and unequal ones differ
    with a probability of about 1 - 2**-100.
    """
    items = df.select(*keys, item.alias("_item")).where(F.col("_item").isNotNull()).distinct()
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), F.col("_item")), F.lit(1 << 40)))
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), part(1).alias("_a"), part(2).alias("_b"), part(3).alias("_c")).select(*keys, "n", F.sha2(F.concat_ws(":", "_a", "_b", "_c", "n"), 256).alias("token"))


def wilson_lower(successes: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of a share; 0 without a case."""
    p, z2 = successes / total, z * z
    low = (p + z2 / (2 * total) - z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))) / (1 + z2 / total)
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low))


def merge(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], version: str) -> DataFrame:
    """An upsert: rows of `new` replace what differs and count the version up; equal ones leave the row as it is; null values keep the old."""
    a = old.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values], F.col(version).alias("_version"))
    b = new.select(*keys, *values, F.lit(True).alias("_new"))
    both = a.join(b, keys, "full_outer")
    changed = F.lit(False)
    for v in values:
        changed = changed | (F.col(v).isNotNull() & ~F.col(v).eqNullSafe(F.col(f"_old_{v}")))
    number = F.when(F.col("_version").isNull(), 1).when(F.coalesce("_new", F.lit(False)) & changed, F.col("_version") + 1).otherwise(F.col("_version"))
    return both.select(*keys, *[F.coalesce(v, f"_old_{v}").alias(v) for v in values], number.alias(version))


def cascade(df: DataFrame, steps: list[tuple[DataFrame, str, float]], value: str) -> DataFrame:
    """The frame with `value` and `confidence` from the first lookup that has its key. steps: (lookup with one row for each key, key, confidence)."""
    found, sure = F.lit(None), F.lit(None)
    for i, (lookup, key, confidence) in reversed(list(enumerate(steps))):
        df = df.join(lookup.select(F.col(key), F.col(value).alias(f"_v{i}")), key, "left")
        found, sure = F.coalesce(F.col(f"_v{i}"), found), F.when(F.col(f"_v{i}").isNotNull(), confidence).otherwise(sure)
    return df.withColumn(value, found).withColumn("confidence", sure).drop(*[f"_v{i}" for i in range(len(steps))])


def adaptive_clusters(df: DataFrame, keys: list[str], at: str, factor: float, floor: float, tie: str) -> DataFrame:
    """As gap_clusters, with a gap of `factor` times the median gap of the key, at least `floor`."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    gaps = df.withColumn("_gap", F.col(at) - F.lag(at).over(w))
    limit = F.greatest(F.lit(floor), F.lit(factor) * F.median("_gap").over(Window.partitionBy(*keys)))
    new = gaps.withColumn("_new", F.when(F.col("_gap") > limit, 1).otherwise(0))
    return new.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_gap", "_new")


def frozen(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The rows in order; more than `most` is an error when the frame is read, not a cut."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = df.orderBy(*order).limit(most + 1)
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > most, F.raise_error(F.lit(f"more than {most} rows are selected"))).otherwise(F.lit(True))).drop("_n")


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Frames of one schema as one, each row with the name of its part."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def overlaid(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], settled: Column | None = None) -> DataFrame:
    """Two states of one thing as one: what `new` says, and where it says nothing what `old` says. settled: a condition on `old` under which its
    row stays as it is, such as a state that is final."""
    a = old.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values], (settled if settled is not None else F.lit(False)).alias("_settled"))
    both = a.join(new.select(*keys, *values), keys, "full_outer")
    keep = F.coalesce("_settled", F.lit(False))
    return both.select(*keys, *[F.when(keep, F.col(f"_old_{v}")).otherwise(F.coalesce(v, f"_old_{v}")).alias(v) for v in values])


def overridden(df: DataFrame, reviewed: DataFrame, key: str, column: str) -> DataFrame:
    """The frame with `column` replaced by the reviewed one of its very key. reviewed: (key, column); of several the smallest counts, null ones do not."""
    one = reviewed.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_reviewed"))
    return df.join(one, key, "left").withColumn(column, F.coalesce("_reviewed", column)).drop("_reviewed").select(*df.columns)
