"""More corpus queries: predicates over pairs, term base rows, geometry-like windows, evaluation, file round trips."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import dictionary, grids, packed_fields, vectors
from corvane.operators import relational as R
from corvane.plans.base import Part
from corvane.plans.fields import VALUES
from corvane.plans.text import LANG, NORM, at, q
from corvane.session import load, shared_dir

part = Part()
c = F.col


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "tm_units").where(c("source_text").isNotNull() & c("target_text").isNotNull())


NEG = f"(regexp_matches({{0}}, {q(X.NEGATION_EN)}) OR regexp_matches({{0}}, {q(X.NEGATION_ZH)}))"


@part.query(f"SELECT {at(NEG, 'source_text')} AS in_source, {at(NEG, 'target_text')} AS in_target, count(*) AS n FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL GROUP BY 1, 2")
def negation_agreement(spark, sf):
    """Whether a negation stands on either side of a pair."""
    return pairs(spark, sf).groupBy(X.has_negation(c("source_text")).alias("in_source"), X.has_negation(c("target_text")).alias("in_target")).agg(F.count("*").alias("n"))


MODAL = ", ".join(f"CASE WHEN regexp_matches({{0}}, {q(p)}) OR regexp_matches({{0}}, {q(z)}) THEN '{k}' END" for k, (p, z) in X.MODALITY.items())


@part.query(f"SELECT side, class, count(*) AS n FROM (SELECT 'source' AS side, unnest(list_filter([{at(MODAL, 'source_text')}], lambda x: x IS NOT NULL)) AS class FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL UNION ALL SELECT 'target', unnest(list_filter([{at(MODAL, 'target_text')}], lambda x: x IS NOT NULL)) FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL) GROUP BY 1, 2")
def modality_classes(spark, sf):
    """Prohibition, obligation and permission on either side."""
    both = F.create_map(F.lit("source"), X.modality(c("source_text")), F.lit("target"), X.modality(c("target_text")))
    return pairs(spark, sf).select(F.explode(both).alias("side", "classes")).select("side", F.explode("classes").alias("class")).groupBy("side", "class").agg(F.count("*").alias("n"))


@part.query(r"SELECT least(n, 3) AS citations, count(*) AS units FROM (SELECT len(regexp_extract_all(source_text, '[\[［]\d+(?:[-,]\d+)*[\]］]')) AS n FROM tm_units WHERE source_text IS NOT NULL) GROUP BY 1")
def citation_density(spark, sf):
    return load(spark, sf, "tm_units").where(c("source_text").isNotNull()).groupBy(F.least(X.count_of(c("source_text"), r"[\[［]\d+(?:[-,]\d+)*[\]］]"), F.lit(3)).alias("citations")).agg(F.count("*").alias("units"))


@part.query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]{3,}')) >= 8 AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) >= 20")
def source_overlay(spark, sf):
    """Texts in which both languages lie over each other."""
    d = load(spark, sf, "documents").where(c("text").isNotNull())
    return d.where((X.count_of(c("text"), "[A-Za-z]{3,}") >= 8) & (X.count_of(c("text"), X.CJK) >= 20)).select("doc_id")


STEM = r"regexp_replace(regexp_replace({0}, '-(?:50|75|90)$', ''), '^(?:anti|non|pre|primary|secondary)[- ]', '')"


@part.query(f"SELECT DISTINCT norm, {at(STEM, 'norm')} AS stem, {at(STEM, 'norm')} <> norm AS derived, length(norm) <= 3 OR regexp_matches(source, '^[A-Z0-9-]+$') AS own_case FROM (SELECT source, {at(NORM, 'source')} AS norm FROM term_screen_decisions WHERE source IS NOT NULL)")
def morphology(spark, sf):
    """Stems without prefixes and strength suffixes, and whether a form must keep its case."""
    d = load(spark, sf, "term_screen_decisions").where(c("source").isNotNull()).select("source", X.normalise_source(c("source")).alias("norm"))
    stem = X.morphology_stem(c("norm"))
    return d.select("norm", stem.alias("stem"), (stem != c("norm")).alias("derived"), X.keeps_case(c("source"), c("norm")).alias("own_case")).distinct()


@part.query(r"SELECT DISTINCT segment_id, CAST(regexp_extract(text, '^(\d+)\. ([^\n]+)$', 1) AS INTEGER) AS number, regexp_extract(text, '^(\d+)\. ([^\n]+)$', 2) AS title FROM docx_segments WHERE regexp_matches(text, '^\d+\. [^\n]+$')")
def heading_numbers(spark, sf):
    h = load(spark, sf, "docx_segments").where(c("text").rlike(r"^\d+\. [^\n]+$"))
    return h.select("segment_id", F.regexp_extract("text", r"^(\d+)\. ([^\n]+)$", 1).cast("int").alias("number"), F.regexp_extract("text", r"^(\d+)\. ([^\n]+)$", 2).alias("title")).distinct()


FORCED = (("audit trail", "audit log"), ("审计轨迹", "稽查轨迹"), ("term base", "termbase"), ("数据库锁定", "锁库"))


@part.query("SELECT doc_id, " + reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", FORCED, "text") + " AS forced FROM documents WHERE text IS NOT NULL")
def forced_terms(spark, sf):
    """Ordered literal replacements."""
    return load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", X.forced(c("text"), FORCED).alias("forced"))


ALIASES = "SELECT row_id AS concept_id, unnest(list_transform(vals, lambda v: v.val)) AS text FROM (" + VALUES + ") WHERE field_name = 'domain_ad_concepts.{0}'"


@part.query(f"SELECT DISTINCT concept_id, lang, role, text FROM (SELECT concept_id, 'en' AS lang, 'preferred' AS role, en AS text FROM domain_ad_concepts UNION ALL SELECT concept_id, 'zh', 'preferred', zh FROM domain_ad_concepts UNION ALL SELECT concept_id, 'en', 'alias', text FROM ({at(ALIASES, 'en_aliases')}) UNION ALL SELECT concept_id, 'zh', 'alias', trim(unnest(string_split(zh_aliases, '|'))) FROM domain_ad_concepts UNION ALL SELECT concept_id, 'zh', 'forbidden', text FROM ({at(ALIASES, 'forbidden_targets')})) WHERE text IS NOT NULL AND text <> ''")
def runtime_terms(spark, sf):
    """The term base as rows: names, aliases and forbidden targets of every concept."""
    t = load(spark, sf, "domain_ad_concepts")
    one = lambda col, lang, role: t.select("concept_id", F.lit(lang).alias("lang"), F.lit(role).alias("role"), c(col).alias("text"))
    packed = lambda col, lang, role: packed_fields.values(t, "concept_id", col, col).select(c("row_id").alias("concept_id"), F.lit(lang).alias("lang"), F.lit(role).alias("role"), c("val").alias("text"))
    bars = t.select("concept_id", F.lit("zh").alias("lang"), F.lit("alias").alias("role"), F.explode(F.transform(F.split("zh_aliases", r"\|"), lambda x: F.trim(x))).alias("text"))
    rows = reduce(DataFrame.unionByName, [one("en", "en", "preferred"), one("zh", "zh", "preferred"), packed("en_aliases", "en", "alias"), bars, packed("forbidden_targets", "zh", "forbidden")])
    return rows.where(c("text").isNotNull() & (c("text") != "")).distinct()


@part.query(f"SELECT text AS forbidden, count(DISTINCT entry_id) AS entries FROM ({at(ALIASES, 'forbidden_targets')}) JOIN (SELECT DISTINCT entry_id, target FROM domain_ad WHERE target IS NOT NULL) ON contains(lower(target), lower(text)) GROUP BY 1")
def forbidden_hits(spark, sf):
    """Forbidden targets that stand in a translation."""
    t = load(spark, sf, "domain_ad_concepts")
    terms = packed_fields.values(t, "concept_id", "forbidden_targets", "f").select(c("val").alias("term"), c("val").alias("key")).distinct()
    hits = dictionary.scan(load(spark, sf, "domain_ad").select("entry_id", "target").distinct(), "target", terms, longest=False, borders=False, any_case=True)
    return hits.groupBy(c("term").alias("forbidden")).agg(F.countDistinct("entry_id").alias("entries"))


OCC = "(length(lower({0})) - length(replace(lower({0}), lower({1}), ''))) // length({1})"


def occ(a: str, b: str) -> str:
    return OCC.replace("{0}", a).replace("{1}", b)


@part.query(f"SELECT entry_id, concept_id, CAST({occ('source', 'en')} AS INTEGER) AS expected, CAST({occ('target', 'zh')} AS INTEGER) AS actual FROM (SELECT DISTINCT entry_id, source, target FROM domain_ad WHERE source IS NOT NULL AND target IS NOT NULL) JOIN domain_ad_concepts ON contains(lower(source), lower(en)) WHERE zh IS NOT NULL AND {occ('target', 'zh')} < {occ('source', 'en')}")
def policy_violations(spark, sf):
    """Terms whose translation stands in the target less often than they stand in the source."""
    t = load(spark, sf, "domain_ad_concepts").where(c("en").isNotNull() & c("zh").isNotNull()).select("concept_id", "en", "zh")
    rows = load(spark, sf, "domain_ad").where(c("source").isNotNull() & c("target").isNotNull()).select("entry_id", "source", "target").distinct()
    hits = dictionary.scan(rows, "source", t.select(c("en").alias("term"), c("concept_id").alias("key")), longest=False, borders=False, any_case=True).select("entry_id", "source", "target", "key").distinct()
    both = hits.join(t, c("key") == c("concept_id")).select("entry_id", "concept_id", X.occurrences(c("source"), c("en")).alias("expected"), X.occurrences(c("target"), c("zh")).alias("actual"))
    return both.where(c("actual") < c("expected"))


@part.query("SELECT observed, count(*) AS n FROM (SELECT CASE WHEN contains(lower(target), lower(zh)) THEN 'preferred' WHEN contains(lower(target), lower(en)) THEN 'verbatim' ELSE 'none' END AS observed FROM (SELECT DISTINCT entry_id, source, target FROM domain_ad WHERE source IS NOT NULL AND target IS NOT NULL) JOIN domain_ad_concepts ON contains(lower(source), lower(en)) WHERE zh IS NOT NULL) GROUP BY observed")
def observed_alignment(spark, sf):
    """How terms of the source show in the target: as preferred, left as they are, or not at all."""
    t = load(spark, sf, "domain_ad_concepts").where(c("en").isNotNull() & c("zh").isNotNull()).select("concept_id", "en", "zh")
    rows = load(spark, sf, "domain_ad").where(c("source").isNotNull() & c("target").isNotNull()).select("entry_id", "source", "target").distinct()
    hits = dictionary.scan(rows, "source", t.select(c("en").alias("term"), c("concept_id").alias("key")), longest=False, borders=False, any_case=True).select("entry_id", "source", "target", "key").distinct().join(t, c("key") == c("concept_id"))
    return hits.groupBy(F.when(F.contains(F.lower("target"), F.lower("zh")), "preferred").when(F.contains(F.lower("target"), F.lower("en")), "verbatim").otherwise("none").alias("observed")).agg(F.count("*").alias("n"))


@part.query("SELECT count(*) AS queries, count_if(hit) AS recalled, count_if(first) AS first_right FROM (SELECT query_id, bool_or(same) AS hit, bool_or(same AND rank = 1) AS first FROM (SELECT q.vec_id AS query_id, q.label = r.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5 GROUP BY query_id)")
def retrieval_eval(spark, sf):
    """Recall at five and precision at one of the neighbours against the labels; a query without neighbours counts as a miss."""
    e = load(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"), "label")
    gold = e.where(c("id") % 50 == 0).select(c("id").alias("query_id"), c("label").alias("gold"))
    found = vectors.top_k(e.where(c("id") % 50 == 0).select("id", "vector"), e.select("id", "vector"), 5).join(e.select("id", "label"), "id")
    a = gold.join(found, "query_id", "left").groupBy("query_id").agg(F.bool_or(c("gold") == c("label")).alias("hit"), F.bool_or((c("gold") == c("label")) & (c("rank") == 1)).alias("first"))
    return a.agg(F.count("*").alias("queries"), F.count_if("hit").alias("recalled"), F.count_if("first").alias("first_right"))


@part.query(f"SELECT key, target, origin FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, target) AS rn FROM (SELECT DISTINCT {at(NORM, 'source')} AS key, target, 'clinical' AS origin, 1 AS p FROM clinical_lifecycle WHERE source IS NOT NULL AND target IS NOT NULL UNION ALL SELECT DISTINCT {at(NORM, 'source')}, target, 'domain', 2 FROM domain_ad WHERE source IS NOT NULL AND target IS NOT NULL UNION ALL SELECT DISTINCT {at(NORM, 'source')}, target, 'names', 3 FROM proper_nouns WHERE source IS NOT NULL AND target IS NOT NULL)) WHERE rn = 1")
def glossary_union(spark, sf):
    """Three glossaries as one; where keys meet, the earlier glossary wins."""
    parts = [load(spark, sf, t).where(c("source").isNotNull() & c("target").isNotNull()).select(X.normalise_source(c("source")).alias("key"), "target", F.lit(n).alias("origin"), F.lit(p).alias("p")).distinct() for t, n, p in (("clinical_lifecycle", "clinical", 1), ("domain_ad", "domain", 2), ("proper_nouns", "names", 3))]
    return R.best_per_key(reduce(DataFrame.unionByName, parts), ["key"], [c("p"), c("target")]).drop("p")


@part.query(f"SELECT id, version FROM tm_units WHERE approved AND {at(LANG, 'src_lang')} = 'en' AND (project_id IS NULL OR project_id = (SELECT min(project_id) FROM tm_units)) ORDER BY updated_at DESC, id, version LIMIT 100")
def approved_list(spark, sf):
    """The newest approved units that a project sees: its own and the global ones."""
    u = load(spark, sf, "tm_units")
    first = u.agg(F.min("project_id").alias("p"))
    seen = u.where(c("approved") & (X.normalise_lang(c("src_lang")) == "en")).crossJoin(F.broadcast(first)).where(c("project_id").isNull() | (c("project_id") == c("p")))
    return seen.orderBy(c("updated_at").desc(), "id", "version").limit(100).select("id", "version")


@part.query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '#0000') AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def filter_pack(spark, sf):
    """Search text, value sets and half-open dates; all but the search reach the scans."""
    o = load(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1997-01-01'").select("o_custkey")
    k = load(spark, sf, "customer").where(c("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE") & F.contains(F.lower("c_name"), F.lit("#0000"))).select("c_custkey", "c_mktsegment")
    return o.join(k, c("o_custkey") == c("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@part.query("SELECT event_type, count(*) AS expired FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY 1")
def ttl_expiry(spark, sf):
    e = load(spark, sf, "events").select("event_type", "ts")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where("ts < now - interval 20 days").groupBy("event_type").agg(F.count("*").alias("expired"))


KIND = "CASE WHEN regexp_matches(lower({0}), '(university|college|大学)') THEN 'university' WHEN regexp_matches(lower({0}), '(hospital|clinic|医院)') THEN 'hospital' WHEN regexp_matches(lower({0}), '(inc\\.|ltd\\.|gmbh|b\\.v\\.|公司| ag$)') THEN 'company' WHEN regexp_matches(lower({0}), '(institute|laborator|office|研究所|实验室|办公室)') THEN 'institute' ELSE 'other' END"


@part.query(f"SELECT {at(KIND, 'source')} AS kind, {at(KIND, 'target')} AS target_kind, count(*) AS n FROM proper_nouns WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2")
def entity_kinds(spark, sf):
    """Kinds of organisations by their names on both sides."""
    p = load(spark, sf, "proper_nouns").where(c("source").isNotNull() & c("target").isNotNull())
    return p.groupBy(X.entity_kind(c("source")).alias("kind"), X.entity_kind(c("target")).alias("target_kind")).agg(F.count("*").alias("n"))


@part.query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(concat_ws('', source, target, notes), '[\\x00-\\x7F]', '', 'g'), '')) AS ch FROM clinical_lifecycle) WHERE ch <> '' GROUP BY ch")
def codepoint_census(spark, sf):
    """Characters beyond ASCII, counted."""
    t = load(spark, sf, "clinical_lifecycle").select(F.regexp_replace(F.concat_ws("", "source", "target", "notes"), r"[\x00-\x7F]", "").alias("t"))
    return t.select(F.explode(F.split("t", "")).alias("ch")).where(c("ch") != "").groupBy("ch").agg(F.count("*").alias("n"))


WORDS = "SELECT user_id AS page, event_type AS line, event_id AS word, value AS x0, value + 1.5 AS x1 FROM events"


def page_words(spark, sf) -> DataFrame:
    """Words on pages, as geometry operators take them: events stand in for words, their value for the place in the line."""
    return load(spark, sf, "events").select(c("user_id").alias("page"), c("event_type").alias("line"), c("event_id").alias("word"), c("value").alias("x0"), (c("value") + 1.5).alias("x1"))


MERGED = f"SELECT page, g, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({WORDS}))) GROUP BY page, g"


@part.query(f"SELECT page, round(x1, 4) AS left_edge, round(next, 4) AS right_edge FROM (SELECT page, x1, lead(x0) OVER (PARTITION BY page ORDER BY x0) AS next FROM ({MERGED})) WHERE next - x1 >= 1.0")
def column_gutters(spark, sf):
    """Empty stretches of at least 1.0 between the merged bands of a page."""
    return grids.gutters(page_words(spark, sf), ["page"], "x0", "x1", 1.0).select("page", F.round("left_edge", 4).alias("left_edge"), F.round("right_edge", 4).alias("right_edge"))


@part.query(f"SELECT word, band FROM (SELECT w.word, b.g AS band, row_number() OVER (PARTITION BY w.word ORDER BY least(w.x1, b.x1) - greatest(w.x0, b.x0) DESC, b.x0) AS rn FROM ({WORDS}) w JOIN (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY x0) AS INTEGER) AS g, x0, x1 FROM ({MERGED})) b ON w.page = b.page AND w.x0 < b.x1 AND b.x0 < w.x1) WHERE rn = 1")
def band_of_word(spark, sf):
    """The band that each word overlaps most."""
    w = page_words(spark, sf)
    bands = R.merged_intervals(w, ["page"], "x0", "x1").select("page", F.row_number().over(Window.partitionBy("page").orderBy("start")).alias("band"), c("start").alias("x0"), c("end").alias("x1"))
    return grids.best_band(w, bands, ["page"], "word").select("word", "band")


@part.query(f"SELECT a.word AS a, b.word AS b FROM ({WORDS}) a JOIN ({WORDS}) b ON a.page = b.page AND a.line = b.line AND a.word < b.word WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.35 * least(a.x1 - a.x0, b.x1 - b.x0)")
def overlapping_spans(spark, sf):
    """Spans of a line that lie over each other by more than 35 % of the smaller."""
    return grids.overlap_pairs(page_words(spark, sf), ["page", "line"], "word", 0.35)


@part.query("SELECT entry_id, source, target, notes FROM (SELECT DISTINCT entry_id, source, target, notes FROM clinical_lifecycle WHERE source IS NOT NULL AND target IS NOT NULL AND notes IS NOT NULL AND source <> '' AND target <> '' AND notes <> '')")
def csv_round_trip(spark, sf):
    """A glossary written as CSV and read again."""
    d = load(spark, sf, "clinical_lifecycle").select("entry_id", "source", "target", "notes").dropna()
    d = d.where((c("source") != "") & (c("target") != "") & (c("notes") != "")).distinct()
    at_ = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    d.write.option("quoteAll", True).csv(at_, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return spark.read.schema(d.schema).csv(at_, header=True, escape='"', multiLine=True)


@part.query("SELECT term_type, count(*) AS n, count(DISTINCT decision_id) AS decisions FROM term_screen_decisions GROUP BY 1")
def json_ledger(spark, sf):
    """Two appends to a ledger of JSON lines, read back."""
    d = load(spark, sf, "term_screen_decisions").select("decision_id", "term_type")
    at_ = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    even = F.pmod(F.xxhash64("decision_id"), F.lit(2)) == 0
    d.where(even).write.mode("append").json(at_)
    d.where(~even).write.mode("append").json(at_)
    return spark.read.schema(d.schema).json(at_).groupBy("term_type").agg(F.count("*").alias("n"), F.countDistinct("decision_id").alias("decisions"))


@part.query("SELECT sha256(coalesce(text, '')) AS seal, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_seals(spark, sf):
    """Documents by the hash of their content: those that came more than once."""
    d = load(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("seal"))
    return d.groupBy("seal").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where(c("copies") > 1)


@part.query("SELECT id, version FROM (SELECT DISTINCT id, version, row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC) AS rn FROM tm_units) WHERE rn = 1")
def unit_latest(spark, sf):
    """The latest version of each unit."""
    return R.best_per_key(load(spark, sf, "tm_units").select("id", "version", "updated_at"), ["id"], [c("version").desc(), c("updated_at").desc()]).select("id", "version")


@part.query("WITH old AS (SELECT id, arg_min(source_text, (version, updated_at)) AS source_text, arg_min(target_text, (version, updated_at)) AS target_text, min(version) AS version FROM (SELECT * FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL) WHERE approved GROUP BY id), new AS (SELECT id, max(source_text) AS source_text, max(upper(target_text)) AS target_text FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL GROUP BY id) SELECT id, coalesce(n.source_text, o.source_text) AS source_text, coalesce(n.target_text, o.target_text) AS target_text, CASE WHEN o.id IS NULL THEN 1 WHEN n.id IS NOT NULL AND (n.source_text <> o.source_text OR n.target_text <> o.target_text) THEN o.version + 1 ELSE o.version END AS version FROM old o FULL JOIN new n USING (id)")
def tm_upsert(spark, sf):
    """Approved units merged with a new state of all units: versions count up where a text changed."""
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull() & c("target_text").isNotNull())
    order = F.struct("version", "updated_at")
    old = u.where("approved").groupBy("id").agg(F.min_by("source_text", order).alias("source_text"), F.min_by("target_text", order).alias("target_text"), F.min("version").alias("version"))
    new = u.groupBy("id").agg(F.max("source_text").alias("source_text"), F.max(F.upper("target_text")).alias("target_text"))
    return R.merge(old, new, ["id"], ["source_text", "target_text"], "version")


EN = f"SELECT {at(NORM, 'en')} AS k, min(concept_id) AS concept_id FROM domain_ad_concepts WHERE en IS NOT NULL GROUP BY 1"
ZH = f"SELECT {at(NORM, 'zh')} AS k, min(concept_id) AS concept_id FROM domain_ad_concepts WHERE zh IS NOT NULL GROUP BY 1"


@part.query(f"SELECT DISTINCT s.norm, coalesce(a.concept_id, b.concept_id, d.concept_id) AS concept_id, CASE WHEN a.concept_id IS NOT NULL THEN 1.0 WHEN b.concept_id IS NOT NULL THEN 0.98 WHEN d.concept_id IS NOT NULL THEN 0.9 END AS confidence FROM (SELECT {at(NORM, 'source')} AS norm FROM term_screen_decisions WHERE source IS NOT NULL) s LEFT JOIN ({EN}) a ON a.k = s.norm LEFT JOIN ({ZH}) b ON b.k = s.norm LEFT JOIN ({EN}) d ON d.k = {at(STEM, 's.norm')}")
def suggest_cascade(spark, sf):
    """A concept for each typed form: by its English name, its Chinese name, or its stem, each with its confidence."""
    t = load(spark, sf, "domain_ad_concepts")
    by = lambda col, key: t.where(c(col).isNotNull()).groupBy(X.normalise_source(c(col)).alias(key)).agg(F.min("concept_id").alias("concept_id"))
    forms = load(spark, sf, "term_screen_decisions").where(c("source").isNotNull()).select(X.normalise_source(c("source")).alias("norm")).distinct()
    forms = forms.withColumns({"en": c("norm"), "zh": c("norm"), "stem": X.morphology_stem(c("norm"))})
    return R.cascade(forms, [(by("en", "en"), "en", 1.0), (by("zh", "zh"), "zh", 0.98), (by("en", "stem"), "stem", 0.9)], "concept_id").select("norm", "concept_id", c("confidence").cast("double").alias("confidence"))


@part.query("SELECT json_extract_string(extra_json, '$.ok') AS ok, count(*) AS n, CAST(sum(CAST(json_extract_string(extra_json, '$.pages') AS BIGINT)) AS BIGINT) AS pages FROM archives GROUP BY 1")
def json_facts(spark, sf):
    """Facts out of a JSON column of any shape."""
    return load(spark, sf, "archives").groupBy(F.get_json_object("extra_json", "$.ok").alias("ok")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("extra_json", "$.pages").cast("long")).alias("pages"))


@part.query("SELECT strftime(CASE WHEN regexp_matches(created_at, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN timezone('UTC', try_cast(created_at AS TIMESTAMPTZ)) ELSE try_cast(created_at AS TIMESTAMP) END, '%Y-%m-%d') AS day, count(*) AS n FROM archives GROUP BY 1")
def archive_days(spark, sf):
    """Archives by day; times without a zone are UTC."""
    return load(spark, sf, "archives").groupBy(F.date_format(F.try_to_timestamp("created_at"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@part.query(f"SELECT {at(LANG, 'to_lang')} AS lang, count(*) AS n, count(DISTINCT archive_id) AS archives FROM archives GROUP BY 1")
def archive_languages(spark, sf):
    return load(spark, sf, "archives").groupBy(X.normalise_lang(c("to_lang")).alias("lang")).agg(F.count("*").alias("n"), F.countDistinct("archive_id").alias("archives"))


@part.query("SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{2,}')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word HAVING count(*) >= 2")
def abbreviations(spark, sf):
    """Abbreviations that come at least twice."""
    d = load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), 0)).alias("word"))
    return d.groupBy("word").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n")).where(c("n") >= 2)


REJECTED = f"SELECT DISTINCT {at(NORM, 'source')} AS k FROM term_screen_decisions WHERE source IS NOT NULL AND decision = 'generic'"


@part.query(f"SELECT DISTINCT norm FROM (SELECT {at(NORM, 'source')} AS norm FROM domain_ad WHERE source IS NOT NULL) WHERE norm NOT IN ({REJECTED}) AND {at(STEM, 'norm')} NOT IN ({REJECTED})")
def rejected_suppression(spark, sf):
    """Candidates whose form and stem were not rejected: anti-joins on derived keys."""
    bad = load(spark, sf, "term_screen_decisions").where(c("source").isNotNull() & (c("decision") == "generic")).select(X.normalise_source(c("source")).alias("k")).distinct()
    d = load(spark, sf, "domain_ad").where(c("source").isNotNull()).select(X.normalise_source(c("source")).alias("norm")).distinct().withColumn("stem", X.morphology_stem(c("norm")))
    return d.join(bad, c("norm") == c("k"), "left_anti").join(bad, c("stem") == c("k"), "left_anti").select("norm")


@part.query("SELECT user_id, cluster, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap > greatest(0.5, 3.0 * med) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) + 1 AS cluster FROM (SELECT *, median(gap) OVER (PARTITION BY user_id) AS med FROM (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events))) GROUP BY 1, 2")
def adaptive_clusters(spark, sf):
    """Values of a user in clusters, divided where a gap is three times the usual one."""
    return R.adaptive_clusters(load(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 3.0, 0.5, "event_id").groupBy("user_id", "cluster").agg(F.count("*").alias("n"))


@part.query("SELECT l_linestatus, round(p95 / first_value(p95) OVER (ORDER BY l_linestatus), 4) AS ratio, p95 / first_value(p95) OVER (ORDER BY l_linestatus) <= 1.25 AS within FROM (SELECT l_linestatus, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1)")
def cohort_budget(spark, sf):
    """The 95th percentile of each cohort against that of the first, and whether it keeps within a quarter more."""
    a = load(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice)").alias("p95"))
    base = a.agg(F.min_by("p95", "l_linestatus").alias("base"))
    return a.crossJoin(F.broadcast(base)).select("l_linestatus", F.round(c("p95") / c("base"), 4).alias("ratio"), (c("p95") / c("base") <= 1.25).alias("within"))


@part.query("SELECT subject, coalesce(n, 0) AS n, coalesce(n, 0) >= 5 AS complete FROM subjects LEFT JOIN (SELECT subject, count(DISTINCT doc_id) AS n FROM subject_labels GROUP BY 1) USING (subject)")
def class_completeness(spark, sf):
    """Labelled cases of each class; a class without any is there with 0."""
    n = load(spark, sf, "subject_labels").groupBy("subject").agg(F.countDistinct("doc_id").alias("n"))
    return load(spark, sf, "subjects").join(n, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= 5).alias("complete"))


@part.query("SELECT user_id, action, reopened FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('click', 'purchase')) AS action, max((ts, event_id)) > max((ts, event_id)) FILTER (WHERE event_type IN ('click', 'purchase')) AS reopened FROM events GROUP BY 1) WHERE action IS NOT NULL")
def latest_closing_action(spark, sf):
    """The last closing event of each stream, and whether anything came after it."""
    at_ = F.struct("ts", "event_id")
    closing = c("event_type").isin("click", "purchase")
    a = load(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.when(closing, at_)).alias("action"), F.max(F.when(closing, at_)).alias("closed"), F.max(at_).alias("last"))
    return a.where(c("closed").isNotNull()).select("user_id", "action", (c("last") > c("closed")).alias("reopened"))


@part.query("SELECT docx_id, count(*) AS segments, count_if(is_textbox) AS textboxes, count_if(table_path IS NOT NULL) AS cells, count(DISTINCT container_ref) AS containers, count(DISTINCT section_index) AS sections FROM (SELECT DISTINCT docx_id, segment_id, is_textbox, table_path, container_ref, section_index FROM docx_segments) GROUP BY 1")
def structure_summary(spark, sf):
    """What each file is made of."""
    s = load(spark, sf, "docx_segments").select("docx_id", "segment_id", "is_textbox", "table_path", "container_ref", "section_index").distinct()
    return s.groupBy("docx_id").agg(F.count("*").alias("segments"), F.count_if("is_textbox").alias("textboxes"), F.count_if(c("table_path").isNotNull()).alias("cells"), F.countDistinct("container_ref").alias("containers"), F.countDistinct("section_index").alias("sections"))


@part.query("SELECT source, round((0.2 * complete + 0.35 * coalesce(zh, 0)) / (0.2 + CASE WHEN zh IS NULL THEN 0 ELSE 0.35 END), 4) AS score FROM (SELECT source, avg(CASE WHEN n_chars IS NULL THEN 0.0 ELSE 1.0 END) AS complete, avg(CASE WHEN lang = 'zh' THEN 1.0 WHEN lang = 'en' THEN 0.0 END) AS zh FROM documents GROUP BY 1)")
def weighted_score(spark, sf):
    """Parts of a score with their weights, those without a value left out of the sum of weights."""
    a = load(spark, sf, "documents").groupBy("source").agg(F.avg(F.when(c("n_chars").isNull(), 0.0).otherwise(1.0)).alias("complete"), F.avg(F.when(c("lang") == "zh", 1.0).when(c("lang") == "en", 0.0)).alias("zh"))
    whole = F.lit(0.2) + F.when(c("zh").isNull(), 0.0).otherwise(0.35)
    return a.select("source", F.round((0.2 * c("complete") + 0.35 * F.coalesce("zh", F.lit(0.0))) / whole, 4).alias("score"))


@part.query("SELECT c_custkey, CASE WHEN coalesce(total, 0) > 0 THEN round_even(least(100.0, CAST(done AS DOUBLE) / total * 100), 2) END AS progress FROM customer LEFT JOIN (SELECT o_custkey, count_if(o_orderstatus = 'F') AS done, count(*) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def progress(spark, sf):
    """Share of what is done in per cent, half-even to two places, at most 100; null where there is nothing to do."""
    a = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(c("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))
    j = load(spark, sf, "customer").select("c_custkey").join(a, c("o_custkey") == c("c_custkey"), "left")
    return j.select("c_custkey", F.when(F.coalesce("total", F.lit(0)) > 0, F.bround(F.least(F.lit(100.0), c("done") / c("total") * 100), 2)).alias("progress"))


QUERIES, ORACLE = part.QUERIES, part.ORACLE
