"""Problem 3: values packed in one field, as registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import packed_fields
from corvane.session import load

FIELDS = (("domain_ad_concepts", "concept_id", "en_aliases"), ("domain_ad_concepts", "concept_id", "forbidden_targets"), ("domain_ad", "entry_id", "forbidden_targets"))


def packed(spark: SparkSession, sf: str, least: int) -> DataFrame:
    return reduce(DataFrame.unionByName, [packed_fields.values(load(spark, sf, t), i, c, f"{t}.{c}", least) for t, i, c in FIELDS])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf, 2).select("field_name", "row_id", "pos", "val")


def p3_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value, single ones too, with its error flag."""
    return packed(spark, sf, 1)


# The same grammar as one regular expression: a quoted value, or a run of brackets, guarded marks and other characters.
ITEM = r"""[ ]*"(?:[^"]|"")*"|[ ]*“[^”]*”|(?:[(（][^)）]*[)）]|[0-9][,，][0-9]|[^\s|;；,，、]/[^\s|;；,，、]|[^|;；,，、\n\r\t/])+"""
UNQUOTED = """trim(CASE WHEN starts_with(trim(x), '"') AND ends_with(trim(x), '"') AND length(trim(x)) > 1 THEN replace(trim(x)[2:-2], '""', '"') WHEN starts_with(trim(x), '“') THEN trim(trim(x), '“”') ELSE trim(x) END)"""
ROWS = " UNION ALL ".join(f"SELECT DISTINCT '{t}.{c}' AS field_name, {i} AS row_id, {c} AS text FROM {t} WHERE trim(coalesce({c}, '')) <> ''" for t, i, c in FIELDS)
COUNT = "length(regexp_replace(x, '[^{}]', '', 'g'))"
ERROR = f"""CASE WHEN regexp_matches(trim(x), '^["“]') AND NOT regexp_full_match(trim(x), '"(?:[^"]|"")*"|“[^”]*”') THEN 'quote' WHEN {COUNT.format('(（')} <> {COUNT.format(')）')} THEN 'bracket' END"""
VALUES = f"SELECT field_name, row_id, text, list_filter(list_transform(regexp_extract_all(text, '{ITEM}'), lambda x: {{'val': {UNQUOTED}, 'error': {ERROR}}}), lambda v: v.val <> '') AS vals FROM ({ROWS})"
P3 = "SELECT field_name, row_id, CAST(pos AS INTEGER) AS pos, v.val AS val{} FROM (SELECT field_name, row_id, generate_subscripts(vals, 1) AS pos, unnest(vals) AS v FROM (" + VALUES.replace("{", "{{").replace("}", "}}") + ") WHERE len(vals) >= {})"

QUERIES = {f.__name__: f for f in (p3_found, p3_values)}
ORACLE: dict[str, str] = {"p3_found": P3.format("", 2), "p3_values": P3.format(", v.error AS error", 1)}
