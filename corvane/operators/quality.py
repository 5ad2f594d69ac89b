"""Deterministic quality rules over (source, target) pairs: every rule yields findings of one schema, with a stable fingerprint.

pairs: (id, source, target). Findings: (id, code, severity, detail, fingerprint). A rule is an expression that gives its detail, or null where
it has nothing to say; all rules are evaluated in one pass over the pairs and exploded, so the pairs are read once whatever the number of
rules. A null source has no findings; a null target is the finding `empty_target`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X

SEVERITIES = {"empty_target": "blocker", "untranslated": "blocker", "digit_drift": "blocker", "dose_missing": "blocker", "language": "warning", "encoding": "blocker", "length_ratio": "warning", "edge_space": "info"}


def rules() -> dict[str, Column]:
    s, t = F.col("source"), F.col("target")
    blank = F.trim(F.coalesce(t, F.lit(""))) == ""
    missing = F.filter(X.doses(s), lambda d: ~F.contains(F.lower(F.regexp_replace(t, r"\s", "")), d))
    return {
        "empty_target": F.when(blank, F.lit("")),
        "untranslated": F.when(~blank & (F.length(s) > 20) & (F.lower(F.trim(s)) == F.lower(F.trim(t))), F.lit("")),
        "digit_drift": F.when(~blank & (F.array_sort(X.digit_tokens(s)) != F.array_sort(X.digit_tokens(t))), F.concat_ws(" ", F.array_sort(F.array_except(X.digit_tokens(s), X.digit_tokens(t))))),
        "dose_missing": F.when(~blank & (F.size(missing) > 0), F.array_join(F.array_sort(missing), " ")),
        "language": F.when(~blank & s.rlike(X.CJK) & t.rlike(X.CJK) & ~t.rlike("[A-Za-z]"), F.lit("zh")).when(~blank & ~s.rlike(X.CJK) & ~t.rlike(X.CJK) & t.rlike("[A-Za-z]"), F.lit("en")),
        "encoding": F.when(t.rlike(X.REPLACEMENT) | t.rlike(X.C1) | t.rlike(X.C0) | t.rlike(X.MOJIBAKE), F.lit("")),
        "length_ratio": F.when(~blank & (F.length(t) > 6 * F.length(s)), F.length(t).cast("string")),
        "edge_space": F.when(~blank & (t != F.trim(t)), F.lit("")),
    }


def fingerprint(*parts: Column) -> Column:
    """A stable identity: equal parts give equal fingerprints, in every run and on every machine."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def findings(pairs: DataFrame, only: list[str] | None = None) -> DataFrame:
    table = {k: v for k, v in rules().items() if only is None or k in only}
    found = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("code"), F.lit(SEVERITIES[k]).alias("severity"), v.alias("detail"))) for k, v in table.items()]))
    rows = pairs.where(F.col("source").isNotNull()).select("id", F.inline(found))
    return rows.withColumn("fingerprint", fingerprint(F.col("code"), F.col("id").cast("string"), F.col("detail")))


def gate(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blockers, warnings, state) of each group."""
    a = found.groupBy(*keys).agg(F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return a.withColumn("state", F.when(F.col("blockers") > 0, "blocked").when(F.col("warnings") > 0, "degraded").otherwise("ready"))


def rounds_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fingerprint, state): new, resolved or persisting between two rounds; infos do not count."""
    both = old.where(F.col("severity") != "info").select("fingerprint", F.lit(1).alias("r")).unionByName(new.where(F.col("severity") != "info").select("fingerprint", F.lit(2).alias("r")))
    s = both.groupBy("fingerprint").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    return s.select("fingerprint", F.when(F.col("lo") == 2, "new").when(F.col("hi") == 1, "resolved").otherwise("persisting").alias("state"))


def effective(found: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Findings with the state that their latest disposition gives them. dispositions: (fingerprint, action, at, seq)."""
    last = dispositions.groupBy("fingerprint").agg(F.max_by("action", F.struct("at", "seq")).alias("action"))
    closed = F.col("action").isin("grant_waiver", "confirm_false_positive", "acknowledge")
    return found.join(last, "fingerprint", "left").withColumn("state", F.when(closed, "closed").otherwise("open"))


def near_pairs(terms: DataFrame, column: str) -> DataFrame:
    """(a, b): distinct values one edit apart, a < b. Two such values share a form that each becomes by at most one deletion, so an equality
    join on those forms finds all of them; only what meets is measured."""
    v = terms.select(F.col(column).alias("v")).where(F.col(column).isNotNull() & (F.length(column) > 0)).distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.concat(F.substring("v", F.lit(1), i - 1), F.substring("v", i + 1, F.length("v"))))
    forms = v.select("v", F.explode(F.array_distinct(F.concat(F.array("v"), cuts))).alias("form"))
    a, b = forms.select(F.col("v").alias("a"), "form"), forms.select(F.col("v").alias("b"), "form")
    return a.join(b, "form").where(F.col("a") < F.col("b")).select("a", "b").distinct().where(F.levenshtein("a", "b") <= 1)
