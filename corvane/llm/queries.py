"""Queries of the problems tagged llm, as __spark_entry__ registers them. All run over whole tables and whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import alignment, canonical_list, formatting_dups, garbled, leakage, lookalikes, mixture, scanned, subjects
from corvane.session import load


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting_dups.duplicates(load(spark, sf, "tm_units"), "id", "source_text")


def p1_units(spark: SparkSession, sf: str) -> DataFrame:
    return formatting_dups.collapse(load(spark, sf, "tm_units"), "id", "source_text")


def p2_fields(spark: SparkSession, sf: str) -> list[tuple[DataFrame, str, str, str]]:
    nouns, units = load(spark, sf, "proper_nouns"), load(spark, sf, "tm_units")
    return [(nouns, "entry_id", "source", "proper_nouns.source"), (nouns, "entry_id", "target", "proper_nouns.target"), (units, "id", "source_text", "tm_units.source_text")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [lookalikes.pairs(*x) for x in p2_fields(spark, sf)])


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The same as classes: every row with the class and the spelling it belongs to."""
    return reduce(DataFrame.unionByName, [lookalikes.classes(*x) for x in p2_fields(spark, sf)])


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit's source text in its one form."""
    return lookalikes.normalised(load(spark, sf, "tm_units").select("id", "source_text"), ["source_text"]).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_list.mapped(load(spark, sf, "term_screen_decisions"), "decision_id", "source", load(spark, sf, "domain_ad_concepts")).withColumnRenamed("id", "decision_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.garbled(load(spark, sf, "clinical_lifecycle"), "entry_id", ["source", "target", "notes"]).withColumnRenamed("id", "entry_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(load(spark, sf, "documents"), "doc_id", "text", load(spark, sf, "eval_items")).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.unlabelled(load(spark, sf, "documents"), load(spark, sf, "subject_labels"), load(spark, sf, "eval_items"))


def p10_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Make-up of the corpus: documents and share of documents by subject, labelled ones by their labels."""
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "subject_labels")
    both = p10_found(spark, sf).unionByName(labels.join(docs.select("doc_id"), "doc_id", "left_semi").distinct())
    return both.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mixture(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.reached(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))


def scanned_rows(spark: SparkSession, sf: str) -> DataFrame:
    archives = load(spark, sf, "archives").select(F.struct(F.lit("archives").alias("table_name"), F.col("archive_id").alias("row_id")).alias("key"), F.concat(F.lit("a"), "archive_id").alias("doc"), F.col("source_text_preview").alias("text"), F.lit(False).alias("in_table"), F.lit(0).cast("long").alias("place"))
    segments = load(spark, sf, "docx_segments").select(F.struct(F.lit("docx_segments").alias("table_name"), F.col("segment_id").alias("row_id")).alias("key"), F.concat(F.lit("d"), "docx_id").alias("doc"), "text", F.col("table_path").isNotNull().alias("in_table"), F.col("segment_index").cast("long").alias("place"))
    return archives.unionByName(segments).where(F.col("key.row_id").isNotNull()).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return scanned.repairs(scanned_rows(spark, sf)).select("key.table_name", "key.row_id", "kind", "found").distinct()


def p4_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scanned.paragraphs(scanned_rows(spark, sf)).select("key.table_name", "key.row_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    blank = r"[^\s\p{Z}]"
    units = load(spark, sf, "tm_units").select(F.col("id").alias("record_id"), F.col("source_text").alias("source"), F.col("target_text").alias("target")).where(F.col("source").rlike(blank) & F.col("target").rlike(blank))
    many = alignment.several("source") | alignment.several("target")
    archives = load(spark, sf, "archives").select(F.col("archive_id").alias("record_id"), F.col("source_text_preview").alias("source"), F.col("translated_text_preview").alias("target")).where(F.col("source").rlike(blank) & F.col("target").rlike(blank))
    embedder = alignment.fitted(units.unionByName(archives))
    return alignment.alignments(units.where(many).withColumn("least", F.lit(2)).unionByName(archives.withColumn("least", F.lit(1))), embedder)


QUERIES = {f.__name__: f for f in (p1_found, p1_units, p2_classes, p2_forms, p2_found, p4_found, p4_paragraphs, p5_found, p6_found, p7_found, p8_found, p9_mixture, p9_shares, p10_areas, p10_found)}


def text_key(column: str) -> str:
    """The canonical key of formatting_dups in the dialect of the second engine."""
    d = formatting_dups
    strip = lambda x: f"regexp_replace(lower({x}), '{d.MARKS}', '', 'g')"
    bare = f"regexp_replace({column}, '{d.ZERO_WIDTH}', '', 'g')"
    flat = f"regexp_replace(regexp_replace({bare}, '[\\r\\n\\t\\x{{0B}}\\x{{0C}}\\x{{2028}}\\x{{2029}}]+', ';', 'g'), '{d.SPACE}', ' ', 'g')"
    pieces = f"string_split(regexp_replace({flat}, '{d.FIELD}', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    fields = f"list_sort(list_transform({pieces}[2:], lambda p: {strip('string_split(p, chr(2))[1]')} || chr(2) || {strip('string_split(p, chr(2))[-1]')}))"
    return f"CASE WHEN {strip(bare)} = '' THEN NULL WHEN len({pieces}) > 2 AND {strip(pieces + '[1]')} = '' THEN array_to_string({fields}, chr(1)) ELSE {strip(bare)} END"


KEYED = f"SELECT DISTINCT id, {text_key('source_text')} AS key FROM tm_units WHERE source_text IS NOT NULL"
ORACLE: dict[str, str] = {
    "p1_found": f"SELECT keep_id, id AS dup_id FROM (SELECT id, min(id) OVER (PARTITION BY key) AS keep_id FROM ({KEYED}) WHERE key IS NOT NULL) WHERE id <> keep_id",
    "p1_units": f"SELECT min(id) AS keep_id, count(*) AS n_copies FROM ({KEYED}) WHERE key IS NOT NULL GROUP BY key",
}
