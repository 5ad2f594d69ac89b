"""Dictionary, vector and fuzzy lookup, quality rules, sources and streams as registered queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions import udfs
from corvane.operators import dictionary, fuzzy, quality, vectors
from corvane.plans.base import Part
from corvane.plans.text import DOSES, LANG, NORM, TOKENS, at, flag
from corvane.session import load
from corvane.sources import readers, writers
from corvane.streaming import events as S

part = Part()
c = F.col
HEADINGS = "SELECT DISTINCT lower(regexp_extract(text, '^\\d+\\. ([^\\n]+)$', 1)) AS term FROM docx_segments WHERE regexp_matches(text, '^\\d+\\. [^\\n]+$')"


def heading_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower(F.regexp_extract("text", r"^\d+\. ([^\n]+)$", 1)).alias("term")
    return load(spark, sf, "docx_segments").where(c("text").rlike(r"^\d+\. [^\n]+$")).select(t).distinct().withColumn("key", c("term"))


@part.query(f"SELECT term, count(*) AS docs, CAST(sum((length(low) - length(replace(low, term, ''))) // length(term)) AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL) JOIN ({HEADINGS}) ON contains(low, term) GROUP BY term")
def dictionary_hits(spark, sf):
    """Documents and places in them that hold each section title."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    hits = dictionary.scan(docs, "text", heading_terms(spark, sf), longest=False, borders=False, any_case=True)
    return hits.groupBy("term").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("hits"))


TERMS = "SELECT DISTINCT term, key FROM (SELECT en AS term, concept_id AS key FROM domain_ad_concepts UNION ALL SELECT zh, concept_id FROM domain_ad_concepts) WHERE trim(coalesce(term, '')) <> ''"
IN_WORD = "regexp_full_match(substr(source, {0}, 1), '[A-Za-z0-9_]') AND regexp_full_match(substr(source, {0} + 1, 1), '[A-Za-z0-9_]')"
OWN_CASE = "(length(term) <= 3 OR regexp_full_match(term, '[\\x00-\\x7F]*') AND term = upper(term) AND term <> lower(term))"
SCAN = f"""WITH RECURSIVE texts AS (SELECT DISTINCT decision_id, source FROM term_screen_decisions WHERE source <> ''),
    hits AS (SELECT decision_id, source, term, key, p AS start, p + length(term) AS stop FROM (SELECT *, unnest(range(0, length(source))) AS p FROM texts JOIN ({TERMS}) ON contains(lower(source), lower(term)))
        WHERE CASE WHEN {OWN_CASE} THEN substr(source, p + 1, length(term)) = term ELSE lower(substr(source, p + 1, length(term))) = lower(term) END AND NOT (p > 0 AND {IN_WORD.format('p')}) AND NOT (p + length(term) < length(source) AND {IN_WORD.format('(p + length(term))')})),
    best AS (SELECT decision_id, source, start, max(stop) AS stop FROM hits GROUP BY ALL),
    walk AS (SELECT decision_id, source, min(start) AS start, arg_min(stop, start) AS stop FROM best GROUP BY decision_id, source UNION ALL
        SELECT b.decision_id, b.source, min(b.start), arg_min(b.stop, b.start) FROM walk w JOIN best b ON b.decision_id = w.decision_id AND b.source = w.source AND b.start >= w.stop GROUP BY b.decision_id, b.source)
    SELECT decision_id, source, term, key, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM hits JOIN walk USING (decision_id, source, start, stop)"""


@part.query(SCAN)
def dictionary_scan(spark, sf):
    """Longest matches of the curated terms in what was typed, with their places."""
    concepts = load(spark, sf, "domain_ad_concepts")
    terms = concepts.select(c("en").alias("term"), c("concept_id").alias("key")).unionByName(concepts.select(c("zh").alias("term"), c("concept_id").alias("key")))
    return dictionary.scan(load(spark, sf, "term_screen_decisions").select("decision_id", "source").distinct(), "source", terms)


@part.query("SELECT concept_id, count(*) AS need, count_if(contains(lower(target), lower(zh))) AS hit FROM (SELECT DISTINCT entry_id, source, target FROM domain_ad WHERE source IS NOT NULL AND target IS NOT NULL) JOIN domain_ad_concepts ON contains(lower(source), lower(en)) WHERE zh IS NOT NULL GROUP BY concept_id")
def hard_term_hit_rate(spark, sf):
    """How often the target holds the translation of a term that the source holds."""
    concepts = load(spark, sf, "domain_ad_concepts").where(c("en").isNotNull() & c("zh").isNotNull()).select("concept_id", "zh", "en")
    rows = load(spark, sf, "domain_ad").where(c("source").isNotNull() & c("target").isNotNull()).select("entry_id", "source", "target").distinct()
    hits = dictionary.scan(rows, "source", concepts.select(c("en").alias("term"), c("concept_id").alias("key")), longest=False, borders=False, any_case=True).select("entry_id", "source", "target", "key").distinct()
    return hits.join(concepts, c("key") == c("concept_id")).groupBy("concept_id").agg(F.count("*").alias("need"), F.count_if(F.contains(F.lower("target"), F.lower("zh"))).alias("hit"))


@part.query("SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def cosine_topk(spark, sf):
    """The five nearest of each vector whose id is divisible by 50, against all vectors."""
    e = load(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"))
    return vectors.top_k(e.where(c("id") % 50 == 0), e, 5).select("query_id", "id", "rank")


@part.query("SELECT label, count(*) AS n, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))), 5) AS mean_cosine FROM embeddings GROUP BY label")
def cosine_to_anchor(spark, sf):
    e = load(spark, sf, "embeddings")
    anchor = e.where(c("vec_id") == 0).select(c("embedding").alias("anchor"))
    return e.crossJoin(F.broadcast(anchor)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.cosine(c("embedding"), c("anchor"))), 5).alias("mean_cosine"))


@part.query()
def tm_fuzzy_lookup(spark, sf):
    """For every unit whose number is divisible by 50, the approved units of its tenant and languages with a ratio of 0.85 or more, five at most."""
    u = load(spark, sf, "tm_units").where(F.length("source_text") > 0).select("id", "approved", X.normalise_source(c("source_text")).alias("text"), "tenant_id", X.normalise_lang(c("src_lang")).alias("s"), X.normalise_lang(c("tgt_lang")).alias("t")).distinct()
    return fuzzy.lookup(u.where(F.right("id", F.lit(10)).cast("long") % 50 == 0), u.where("approved"), ["tenant_id", "s", "t"])


FORMS = f"SELECT DISTINCT {at(NORM, 'source')} AS v FROM term_screen_decisions WHERE source IS NOT NULL"
WITHOUT = "left({0}, i - 1) || substr({0}, i + 1)"


@part.query(
    f"""SELECT a.v AS a, b.v AS b FROM ({FORMS}) a JOIN ({FORMS}) b ON a.v < b.v AND a.v <> '' AND CASE
    WHEN length(a.v) = length(b.v) THEN len(list_filter(range(1, length(a.v) + 1), lambda i: {at(WITHOUT, 'a.v')} = {at(WITHOUT, 'b.v')})) > 0
    WHEN length(a.v) = length(b.v) + 1 THEN len(list_filter(range(1, length(a.v) + 1), lambda i: {at(WITHOUT, 'a.v')} = b.v)) > 0
    WHEN length(a.v) + 1 = length(b.v) THEN len(list_filter(range(1, length(b.v) + 1), lambda i: {at(WITHOUT, 'b.v')} = a.v)) > 0 ELSE false END"""
)
def near_terms(spark, sf):
    """Typed forms that are one edit apart."""
    return quality.near_pairs(load(spark, sf, "term_screen_decisions").where(c("source").isNotNull()).select(X.normalise_source(c("source")).alias("v")), "v")


BLANK = "trim(coalesce(target_text, '')) = ''"
MISSING = f"list_filter({at(DOSES, 'source_text')}, lambda d: NOT contains(lower(regexp_replace(target_text, '\\s', '', 'g')), d))"
FINDINGS = f"""SELECT DISTINCT id, source_text, target_text, code FROM (SELECT id, source_text, target_text, unnest(list_filter([
    CASE WHEN {BLANK} THEN 'empty_target' END, CASE WHEN NOT {BLANK} AND length(source_text) > 20 AND lower(trim(source_text)) = lower(trim(target_text)) THEN 'untranslated' END,
    CASE WHEN NOT {BLANK} AND list_sort({at(TOKENS, 'source_text')}) <> list_sort({at(TOKENS, 'target_text')}) THEN 'digit_drift' END, CASE WHEN NOT {BLANK} AND len({MISSING}) > 0 THEN 'dose_missing' END,
    CASE WHEN NOT {BLANK} AND regexp_matches(source_text, '[一-鿿]') AND regexp_matches(target_text, '[一-鿿]') AND NOT regexp_matches(target_text, '[A-Za-z]') THEN 'language' WHEN NOT {BLANK} AND NOT regexp_matches(source_text, '[一-鿿]') AND NOT regexp_matches(target_text, '[一-鿿]') AND regexp_matches(target_text, '[A-Za-z]') THEN 'language' END,
    CASE WHEN {flag('target_text', chr(0xFFFD))} OR {flag('target_text', X.C1)} OR {flag('target_text', X.C0)} OR {flag('target_text', X.MOJIBAKE)} THEN 'encoding' END,
    CASE WHEN NOT {BLANK} AND length(target_text) > 6 * length(source_text) THEN 'length_ratio' END, CASE WHEN NOT {BLANK} AND target_text <> trim(target_text) THEN 'edge_space' END], lambda x: x IS NOT NULL)) AS code FROM tm_units WHERE source_text IS NOT NULL)"""


def pairs(spark, sf) -> DataFrame:
    return load(spark, sf, "tm_units").select("id", c("source_text").alias("source"), c("target_text").alias("target"))


@part.query(f"SELECT code, count(*) AS n FROM ({FINDINGS}) GROUP BY code")
def qa_findings(spark, sf):
    """Findings of all rules over all units, by rule."""
    p = pairs(spark, sf).where(c("source").isNotNull()).distinct()
    return quality.findings(p).groupBy("code").agg(F.count("*").alias("n"))


@part.query(f"SELECT tenant_id, CASE WHEN count_if(code IN ('empty_target', 'untranslated', 'digit_drift', 'dose_missing', 'encoding')) > 0 THEN 'blocked' WHEN count_if(code IN ('language', 'length_ratio')) > 0 THEN 'degraded' ELSE 'ready' END AS state, count_if(code IN ('empty_target', 'untranslated', 'digit_drift', 'dose_missing', 'encoding')) AS blockers, count_if(code IN ('language', 'length_ratio')) AS warnings FROM ({FINDINGS}) JOIN (SELECT DISTINCT id, tenant_id FROM tm_units) USING (id) GROUP BY tenant_id")
def qa_gate(spark, sf):
    """Gate of each tenant from the findings of its units."""
    u = load(spark, sf, "tm_units")
    p = u.where(c("source_text").isNotNull()).select(F.struct("id", "tenant_id").alias("id"), c("source_text").alias("source"), c("target_text").alias("target")).distinct()
    return quality.gate(quality.findings(p).select("id.tenant_id", "severity"), ["tenant_id"])


@part.query(f"SELECT fingerprint, n FROM (SELECT sha256(code || '|' || id || '|') AS fingerprint, count(*) AS n FROM ({FINDINGS}) WHERE code IN ('empty_target', 'edge_space') GROUP BY 1)")
def qa_fingerprints(spark, sf):
    """Stable identities of findings without detail."""
    p = pairs(spark, sf).where(c("source").isNotNull()).distinct()
    return quality.findings(p, ["empty_target", "edge_space"]).groupBy("fingerprint").agg(F.count("*").alias("n"))


@part.query()
def number_drift(spark, sf):
    """Protected numbers that are missing in the target or were added there, in one spelling (units, scales, months)."""
    f = udfs.register()["number_drift"]
    d = pairs(spark, sf).where(c("source").isNotNull() & c("target").isNotNull()).distinct().select("id", f("source", "target").alias("d"))
    return d.where((F.size("d.missing") > 0) | (F.size("d.added") > 0)).select("id", F.array_join("d.missing", " ").alias("missing"), F.array_join("d.added", " ").alias("added"))


@part.query()
def placeholder_signatures(spark, sf):
    """Signatures of the source texts, counted, and how many stored ones agree."""
    f = udfs.register()["signature_of"]
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull()).select("placeholder_sig", f("source_text").alias("signature"))
    return u.groupBy("signature").agg(F.count("*").alias("n"), F.count_if(c("placeholder_sig") == c("signature")).alias("agree"))


@part.query("SELECT count(*) AS n, count(*) AS restored FROM tm_units WHERE source_text IS NOT NULL")
def protect_round_trip(spark, sf):
    """Guarded parts come back as they were in every text."""
    f = udfs.register()["round_trip"]
    return load(spark, sf, "tm_units").where(c("source_text").isNotNull()).select(f("source_text").alias("ok")).agg(F.count("*").alias("n"), F.count_if("ok").alias("restored"))


@part.query()
def segment_chunks(spark, sf):
    """Segments of each document packed into JSON chunks of at most 1 000 bytes: number of chunks and largest."""
    f = udfs.register()["chunk_sizes"]
    d = load(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", f(F.split("text", "\n\n"), F.lit(1000)).alias("sizes"))
    return d.select("doc_id", F.size("sizes").alias("chunks"), F.array_max("sizes").alias("largest"))


@part.query()
def term_sentences(spark, sf):
    """The whole sentence around each section title in a document."""
    f = udfs.register()["sentence_of"]
    hits = dictionary.scan(load(spark, sf, "documents").select("doc_id", "text"), "text", heading_terms(spark, sf), any_case=True)
    return hits.select("doc_id", "term", "start", f("text", "start", "end").alias("sentence"))


SQUASHED = "regexp_replace(lower(target), '[^\\p{L}\\p{N}]+', '', 'g')"


@part.query(f"SELECT key, 1 + count(DISTINCT CASE WHEN NOT contains(longest, sq) THEN sq END) AS targets FROM (SELECT key, sq, first_value(sq) OVER (PARTITION BY key ORDER BY length(sq) DESC, sq DESC) AS longest FROM (SELECT DISTINCT {at(NORM, 'source')} AS key, {SQUASHED} AS sq FROM domain_ad WHERE source IS NOT NULL AND target IS NOT NULL)) GROUP BY key")
def distinct_targets(spark, sf):
    """Really different targets of a source: what the longest one contains, without case and marks, is the same as it.

    The longest target of each key is a combining aggregate, so no key's targets are ever listed.
    """
    d = load(spark, sf, "domain_ad").where(c("source").isNotNull() & c("target").isNotNull())
    d = d.select(X.normalise_source(c("source")).alias("key"), F.regexp_replace(F.lower("target"), r"[^\p{L}\p{N}]+", "").alias("sq")).distinct()
    longest = d.groupBy("key").agg(F.max(F.struct(F.length("sq").alias("l"), c("sq"))).alias("top")).select("key", c("top.sq").alias("longest"))
    return d.join(longest, "key").groupBy("key").agg((F.countDistinct(F.when(~F.contains("longest", "sq"), c("sq"))) + 1).alias("targets"))


@part.query()
def version_diffs(spark, sf):
    """Unified diffs of source and target notes, where both are there."""
    f = udfs.register()["diff"]
    return load(spark, sf, "domain_ad").where(c("source").isNotNull() & c("target").isNotNull()).select("entry_id", f("source", "target").alias("diff")).distinct()


XML_TEXT = "replace(replace(regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@part.query(f"SELECT {at(LANG, 'src_lang')} AS src, {at(XML_TEXT, 'source_text')} AS source, {at(XML_TEXT, 'target_text')} AS target FROM tm_units WHERE regexp_matches(source_text, '[^\\s\\p{{Z}}]') AND regexp_matches(target_text, '[^\\s\\p{{Z}}]')")
def tmx_round_trip(spark, sf):
    """Units written as TMX documents and read again."""
    u = load(spark, sf, "tm_units").where(c("source_text").rlike(r"[^\s\p{Z}]") & c("target_text").rlike(r"[^\s\p{Z}]"))
    docs = writers.tmx_documents(u.select("id", X.normalise_lang(c("src_lang")).alias("src_lang"), c("source_text").alias("source"), X.normalise_lang(c("tgt_lang")).alias("tgt_lang"), c("target_text").alias("target")), per_file=5_000)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["xml"]:
                yield pd.DataFrame([(a, s, t) for a, s, _, t in readers.tmx_units(x, max_chars=1 << 30, max_bytes=1 << 31)], columns=["src", "source", "target"])

    return docs.select("xml").mapInPandas(read, "src string, source string, target string")


@part.query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos, trim(regexp_replace(block, '\\s+', ' ', 'g')) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS block, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<') AND NOT contains(text, '&')) WHERE regexp_matches(block, '[^\\s]')")
def html_blocks(spark, sf):
    """Paragraphs of documents as HTML and back: the innermost blocks in reading order."""
    plain = load(spark, sf, "documents").where(c("text").isNotNull() & ~F.contains("text", F.lit("<")) & ~F.contains("text", F.lit("&")))
    html = plain.select("doc_id", F.concat(F.lit("<html><script>x()</script><div>"), F.array_join(F.transform(F.split("text", "\n\n"), lambda p: F.concat(F.lit("<p>"), writers.escaped(p), F.lit("</p>"))), ""), F.lit("</div></html>")).alias("html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, i, t) for d, h in zip(b["doc_id"], b["html"]) for i, (t, _) in enumerate(readers.html_blocks(h))], columns=["doc_id", "pos", "text"])

    return html.mapInPandas(read, "doc_id long, pos int, text string")


@part.query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_days(spark, sf):
    """Tumbling days of the event stream."""
    return S.run(S.tumbling(S.source(spark, sf, "events")), "complete").select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@part.query("SELECT DISTINCT user_id, event_id FROM events")
def stream_dedupe(spark, sf):
    e = S.source(spark, sf, "events")
    return S.run(S.distinct_events(e.unionByName(e)).select("user_id", "event_id"))


@part.query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS stages, count(*) AS n FROM events GROUP BY user_id")
def stream_stages(spark, sf):
    """Kinds of events seen by each stream, from keyed state."""
    out = S.run(S.completed_stages(S.source(spark, sf, "events")), "update")
    return out.groupBy("user_id").agg(F.max_by("stages", "n").alias("stages"), F.max("n").alias("n"))


QUERIES, ORACLE = part.QUERIES, part.ORACLE
