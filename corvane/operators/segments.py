"""Twelve checks of a translated segment, as one pass of JVM expressions: (id, check, severity, detail) for everything that fails.

Numbers, doses, units, percentages, dates, citations and abbreviations of the source must stand in the target; of one detail only the first check
of that order (doses before numbers) speaks. Negation of the source must show in the target; no forbidden term may; codes of the table checks are
carried on; an empty target and markup that leaked are omissions; references stay as they are, and nothing else is asked of them.

Cases: a null source is an empty one; a null target is an empty one; null forbidden terms and codes are none; a repeated row gives its findings once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units, and words of negation in English and Chinese.
UNITS = "mg kg ml mm cm µg ug ng iu".split()
DOSE_UNITS = "mg|kg|ml|µg|ug|ng|iu"
NEGATION_EN = "no|not|never|without|neither|nor|non|absent|negative"
NEGATION_ZH = "不|无|未|非|没有|阴性"
HARD_CODES = ("LABEL_VALUE_SHIFT", "CELL_MERGE", "KEY_VALUE_COLLAPSE", "SPAN_ORDER_DRIFT", "COLUMN_CLUSTER_DRIFT")
MARKUP = r"(?i)</?\s*(?:span|style|font)[^>]*>"
VALUE = r"\d+(?:\.\d+)?"
# check -> (what to take from a text, what of it counts). Words are taken whole and then looked at, so no border is cut.
TOKENS = {
    "doses": (VALUE + r"\s*[A-Za-zµ]+", rf"(?i)^{VALUE}\s*(?:{DOSE_UNITS})$"),
    "percentages": (VALUE + "%", "."),
    "dates": (r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", "."),
    "citations": (r"\[\d+(?:[-,]\d+)*\]", "."),
    "units": ("[A-Za-zµ]+", f"(?i)^(?:{'|'.join(UNITS)})$"),
    "numbers": ("[A-Za-z_]*" + VALUE, r"^\d"),
    "abbreviations": ("[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*", r"^[A-Z]{2,}(?:-[A-Z0-9]+)?$"),
}


def tokens(text: Column, check: str) -> Column:
    taken, counts = TOKENS[check]
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(f"({taken})"), 1), lambda t: t.rlike(counts)))


def negated(text: Column) -> Column:
    return text.rlike(f"(?i)(?:^|[^A-Za-z])(?:{NEGATION_EN})(?:[^A-Za-z]|$)") | text.rlike(NEGATION_ZH)


def severity(check: str, detail: Column) -> Column:
    if check == "table_relations":
        return F.when(detail.isin(*HARD_CODES), "critical").otherwise("warning")
    if check == "omissions":
        return F.when(detail == "markup", "warning").otherwise("critical")
    return F.lit("warning" if check == "abbreviations" else "critical")


def entry(check: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(check).alias("check"), severity(check, x).alias("severity"), x.alias("detail"))


def findings(rows: DataFrame) -> DataFrame:
    """rows: (id, source, target), and if they are there (role, forbidden, codes)."""
    given = lambda name, otherwise: F.coalesce(F.col(name), otherwise) if name in rows.columns else otherwise
    none = F.array().cast("array<string>")
    s, t = F.coalesce("source", F.lit("")), F.coalesce("target", F.lit(""))
    base = rows.select("id", s.alias("s"), t.alias("t"), given("role", F.lit("body")).alias("role"), given("forbidden", none).alias("forbidden"), given("codes", none).alias("codes")).distinct()
    s, t = F.col("s"), F.col("t")
    blank = F.trim(t) == ""
    reported, columns = none, {}
    for check in TOKENS:
        own = F.array_except(tokens(s, check), tokens(t, check)) if check == "numbers" else F.filter(tokens(s, check), lambda x: ~F.contains(t, x))
        columns[check] = F.array_except(own, reported)
        base = base.withColumn(check, columns[check])
        reported = F.concat(reported, F.col(check))
    one = lambda condition, detail="": F.when(condition, F.array(F.lit(detail))).otherwise(none)
    base = base.withColumns({
        "negation": one(negated(s) & ~blank & ~negated(t)),
        "terminology": F.array_distinct(F.filter("forbidden", lambda x: (x != "") & F.contains(F.lower(t), F.lower(x)))),
        "table_relations": F.array_distinct("codes"),
        "omissions": F.concat(one((F.trim(s) != "") & blank, "empty"), one(t.rlike(MARKUP), "markup")),
        "references": one(~blank & (F.trim(s) != F.trim(t))),
    })

    def entries(checks: list[str]) -> Column:
        return F.concat(*[F.transform(F.col(k), entry(k)) for k in checks])

    whole = [*TOKENS, "negation", "terminology", "table_relations", "omissions"]
    return base.select("id", F.inline(F.when(F.col("role") == "references", entries(["references"])).otherwise(entries(whole))))
