"""Text functions over whole tables, each checked by a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.plans.base import Part
from corvane.session import load

part = Part()
c = F.col


def q(s: str) -> str:
    """A string literal of SQL."""
    return "'" + s.replace("'", "''") + "'"


def at(template: str, column: str) -> str:
    return template.replace("{0}", column)


NORM = "trim(regexp_replace(lower({0}), " + q(r"[\s\p{Z}]+") + ", ' ', 'g'))"


@part.query(f"SELECT id, source_text, {at(NORM, 'source_text')} AS norm FROM tm_units WHERE source_text IS NOT NULL")
def normalise_source(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "tm_units").where(c("source_text").isNotNull()).select("id", "source_text", X.normalise_source(c("source_text")).alias("norm"))


@part.query(f"SELECT count(*) AS n, count_if(stale) AS stale, count_if(empty) AS empty FROM (SELECT source_norm IS DISTINCT FROM {at(NORM, 'source_text')} AS stale, coalesce(source_norm, '') = '' AS empty FROM tm_units WHERE source_text IS NOT NULL)")
def stale_norms(spark, sf):
    """How many stored normal forms are empty or no longer those of their text."""
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull())
    return u.agg(F.count(F.lit(1)).alias("n"), F.count_if(~c("source_norm").eqNullSafe(X.normalise_source(c("source_text")))).alias("stale"), F.count_if(F.coalesce("source_norm", F.lit("")) == "").alias("empty"))


@part.query(r"SELECT key, count(*) AS n, count(DISTINCT target) AS targets FROM (SELECT trim(regexp_replace(lower(source), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, target FROM domain_ad WHERE source IS NOT NULL) GROUP BY key")
def match_key_groups(spark, sf):
    d = load(spark, sf, "domain_ad").where(c("source").isNotNull())
    return d.groupBy(X.match_key(c("source")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("targets"))


@part.query(
    r"""SELECT DISTINCT source, array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(lower(source), '[\s_/-]+', ' ', 'g')), ' '),
    lambda w: CASE WHEN w LIKE '%yses' AND length(w) > 4 THEN left(w, length(w) - 3) || 'sis' WHEN w LIKE '%ses' AND length(w) > 4 THEN left(w, length(w) - 2) || 's'
    WHEN w LIKE '%s' AND NOT w LIKE '%ss' AND NOT w LIKE '%is' AND NOT w LIKE '%us' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END), lambda w: w <> ''), ' ') AS phrase_key
    FROM term_screen_decisions WHERE source IS NOT NULL"""
)
def phrase_keys(spark, sf):
    return load(spark, sf, "term_screen_decisions").where(c("source").isNotNull()).select("source", X.phrase_key(c("source")).alias("phrase_key")).distinct()


LANG = "CASE lower(trim(coalesce({0}, ''))) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.LANGUAGES.items()) + " ELSE lower(trim(coalesce({0}, ''))) END"


@part.query(f"SELECT {at(LANG, 'src_lang')} AS src, {at(LANG, 'tgt_lang')} AS tgt, count(*) AS n FROM tm_units GROUP BY 1, 2")
def lang_normalise(spark, sf):
    return load(spark, sf, "tm_units").groupBy(X.normalise_lang(c("src_lang")).alias("src"), X.normalise_lang(c("tgt_lang")).alias("tgt")).agg(F.count(F.lit(1)).alias("n"))


INFER = "CASE WHEN regexp_matches({0}, '[\u4e00-\u9fff]') THEN 'zh' WHEN regexp_matches({0}, '[A-Za-z]') THEN 'en' ELSE 'und' END"


@part.query(f"SELECT {at(LANG, 'lang')} AS said, {at(INFER, 'text')} AS seen, count(*) AS n FROM documents GROUP BY 1, 2")
def lang_infer(spark, sf):
    return load(spark, sf, "documents").groupBy(X.normalise_lang(c("lang")).alias("said"), X.infer_lang(c("text")).alias("seen")).agg(F.count(F.lit(1)).alias("n"))


@part.query(
    f"""SELECT doc_id, cjk, latin FROM (SELECT doc_id, {at(LANG, 'lang')} AS lang, length(regexp_replace(text, '[^\u4e00-\u9fff]', '', 'g')) AS cjk, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents WHERE text IS NOT NULL)
    WHERE cjk + latin >= 20 AND ((lang = 'zh' AND cjk * 10 < (cjk + latin) * 3) OR (lang = 'en' AND cjk * 10 > (cjk + latin) * 3))"""
)
def language_mismatch(spark, sf):
    """Documents whose share of Chinese characters does not fit the language they are said to be in (at least 20 letters)."""
    d = load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", X.normalise_lang(c("lang")).alias("lang"), X.count_of(c("text"), X.CJK).alias("cjk"), X.count_of(c("text"), "[A-Za-z]").alias("latin"))
    low, high = c("cjk") * 10 < (c("cjk") + c("latin")) * 3, c("cjk") * 10 > (c("cjk") + c("latin")) * 3
    return d.where((c("cjk") + c("latin") >= 20) & (((c("lang") == "zh") & low) | ((c("lang") == "en") & high))).select("doc_id", "cjk", "latin")


TOKENS = "list_transform(regexp_extract_all(translate({0}, '（）％＝⁰¹²³⁴⁵⁶⁷⁸⁹', '()%=0123456789'), " + q(X.DIGIT_TOKEN) + r"), lambda t: regexp_replace(t, '\s+', '', 'g'))"


@part.query(f"SELECT id, source_text, array_to_string({at(TOKENS, 'source_text')}, '|') AS tokens FROM tm_units WHERE source_text IS NOT NULL")
def digit_tokens(spark, sf):
    return load(spark, sf, "tm_units").where(c("source_text").isNotNull()).select("id", "source_text", F.array_join(X.digit_tokens(c("source_text")), "|").alias("tokens"))


@part.query(f"SELECT preserved, count(*) AS n FROM (SELECT list_sort({at(TOKENS, 'source_text')}) = list_sort({at(TOKENS, 'target_text')}) AS preserved FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL) GROUP BY preserved")
def digits_preserved(spark, sf):
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull() & c("target_text").isNotNull())
    return u.groupBy((F.array_sort(X.digit_tokens(c("source_text"))) == F.array_sort(X.digit_tokens(c("target_text")))).alias("preserved")).agg(F.count(F.lit(1)).alias("n"))


@part.query(
    f"""WITH u AS (SELECT DISTINCT id, source_text, target_text FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL),
    s AS (SELECT id, source_text, target_text, unnest({at(TOKENS, 'source_text')}) AS token FROM u), t AS (SELECT id, source_text, target_text, unnest({at(TOKENS, 'target_text')}) AS token FROM u),
    d AS (SELECT id, token, sum(k) AS k FROM (SELECT id, source_text, target_text, token, 1 AS k FROM s UNION ALL SELECT id, source_text, target_text, token, -1 AS k FROM t) GROUP BY id, source_text, target_text, token)
    SELECT id, token, CASE WHEN k > 0 THEN 'missing' ELSE 'added' END AS kind, CAST(abs(k) AS BIGINT) AS n FROM d WHERE k <> 0"""
)
def number_multiset_diff(spark, sf):
    """Numbers of the source that the target lacks, and the other way round, as multisets."""
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull() & c("target_text").isNotNull()).select("id", "source_text", "target_text").distinct()
    both = F.concat(F.transform(X.digit_tokens(c("source_text")), lambda t: F.struct(t.alias("token"), F.lit(1).alias("k"))), F.transform(X.digit_tokens(c("target_text")), lambda t: F.struct(t.alias("token"), F.lit(-1).alias("k"))))
    unit = F.xxhash64("source_text", "target_text").alias("unit")  # 8 bytes instead of two texts through the shuffle
    d = u.select("id", unit, F.inline(both)).groupBy("id", "unit", "token").agg(F.sum("k").alias("k")).where(c("k") != 0)
    return d.select("id", "token", F.when(c("k") > 0, "missing").otherwise("added").alias("kind"), F.abs("k").alias("n"))


DOSES = "list_distinct(list_transform(regexp_extract_all({0}, " + q(X.DOSE) + r", 1), lambda t: lower(regexp_replace(t, '\s', '', 'g'))))"


@part.query(f"SELECT DISTINCT id, dose FROM (SELECT id, target_text, unnest({at(DOSES, 'source_text')}) AS dose FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL) WHERE NOT contains(lower(regexp_replace(target_text, '\\s', '', 'g')), dose)")
def doses_missing(spark, sf):
    """Dose literals of the source that are nowhere in the target."""
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull() & c("target_text").isNotNull()).select("id", F.lower(F.regexp_replace("target_text", r"\s", "")).alias("target"), F.explode(X.doses(c("source_text"))).alias("dose"))
    return u.where(~F.contains("target", "dose")).select("id", "dose").distinct()


REDACT = "{0}"
for _p, _r in ((X.EMAIL, "[EMAIL]"), (X.PHONE, r"\1[PHONE]\2"), (X.TITLED_NAME, r"\1[NAME]"), (X.STUDY_ID, r"\1[ID]"), (X.ORGANISATION, r"\1[ORG]")):
    REDACT = f"regexp_replace({REDACT}, {q(_p)}, {q(_r)}, 'g')"


@part.query(f"SELECT entry_id, source, {at(REDACT, 'source')} AS redacted FROM proper_nouns WHERE source IS NOT NULL")
def redact_pii(spark, sf):
    return load(spark, sf, "proper_nouns").where(c("source").isNotNull()).select("entry_id", "source", X.redact(c("source")).alias("redacted"))


@part.query(r"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(t, '(["'']?api_key["'']?\s*[:=]\s*["'']?)([a-zA-Z0-9_.-]{4,})', '\1[API_KEY_HIDDEN]', 'g'), '(sk-[a-zA-Z0-9_-]{20,})', '[KEY_HIDDEN]', 'g'), '([a-zA-Z_]+token[a-zA-Z_]*["'']?\s*[:=]\s*["'']?)([a-zA-Z0-9_.-]{10,})', '\1[HIDDEN]', 'g') AS masked
    FROM (SELECT event_id, '{"api_key": "k' || event_id || 'abcd", "refresh_token": "' || event_type || '-0123456789", "props": ' || props || '}' AS t FROM events)""")
def mask_secrets(spark, sf):
    t = F.concat(F.lit('{"api_key": "k'), c("event_id").cast("string"), F.lit('abcd", "refresh_token": "'), "event_type", F.lit('-0123456789", "props": '), "props", F.lit("}"))
    return load(spark, sf, "events").select("event_id", X.mask_secrets(t).alias("masked"))


def flag(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {q(pattern)}), false)"


@part.query(f"SELECT field, count_if({flag('v', chr(0xFFFD))}) AS fffd, count_if({flag('v', X.C0)}) AS c0, count_if({flag('v', X.C1)}) AS c1, count_if({flag('v', X.MOJIBAKE)}) AS mojibake FROM (SELECT 'source' AS field, source AS v FROM clinical_lifecycle UNION ALL SELECT 'target', target FROM clinical_lifecycle UNION ALL SELECT 'notes', notes FROM clinical_lifecycle) GROUP BY field")
def artefact_flags(spark, sf):
    d = load(spark, sf, "clinical_lifecycle").select(F.explode(F.create_map(F.lit("source"), c("source"), F.lit("target"), c("target"), F.lit("notes"), c("notes"))).alias("field", "v"))
    return d.groupBy("field").agg(*[F.count_if(c("v").rlike(p)).alias(n) for n, p in (("fffd", X.REPLACEMENT), ("c0", X.C0), ("c1", X.C1), ("mojibake", X.MOJIBAKE))])


@part.query(
    f"""SELECT doc_id, CAST(count_if(hit) AS BIGINT) AS hits, count(*) AS lines FROM (SELECT doc_id, regexp_matches(line, {q(X.LATIN_RUN)}) AND NOT regexp_matches(line, '[\u4e00-\u9fff]') AS hit
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '[^\\s]')) GROUP BY doc_id"""
)
def latin_residue(spark, sf):
    """Lines of each document, and those among them that are a run of Latin words without a Chinese character."""
    lines = load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\s]")).alias("lines")).where(F.size("lines") > 0)
    hit = F.filter("lines", lambda x: x.rlike(X.LATIN_RUN) & ~x.rlike(X.CJK))
    return lines.select("doc_id", F.size(hit).cast("long").alias("hits"), F.size("lines").cast("long").alias("lines"))


COMPLEX = "length(regexp_replace({0}, '[^\u0400-\u052f\u0600-\u06ff\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]', '', 'g'))"


@part.query(f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(floor({at(COMPLEX, 'text')} * CAST(1 AS DOUBLE) + (length(text) - {at(COMPLEX, 'text')}) * CAST(0.3 AS DOUBLE)) AS INTEGER) + 1 END AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, sf):
    return load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", X.token_estimate(c("text")).alias("tokens"))


@part.query(f"SELECT source, sum(words + han) AS units, count(*) AS docs FROM (SELECT source, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, length(regexp_replace(text, '[^\u4e00-\u9fff]', '', 'g')) AS han FROM documents WHERE text IS NOT NULL) GROUP BY source")
def source_units(spark, sf):
    """Latin words and Chinese characters of each source."""
    d = load(spark, sf, "documents").where(c("text").isNotNull())
    return d.groupBy("source").agg(F.sum(X.count_of(c("text"), "[A-Za-z]+") + X.count_of(c("text"), X.CJK)).alias("units"), F.count(F.lit(1)).alias("docs"))


@part.query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(spark, sf):
    return load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", X.snippet(c("text"), 80).alias("snippet"))


@part.query(r"SELECT DISTINCT segment_id, CAST(row_number() OVER (PARTITION BY segment_id, text, u ORDER BY p) AS INTEGER) AS pos, line FROM (SELECT segment_id, text, u, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM (SELECT segment_id, text, row_number() OVER () AS u FROM docx_segments WHERE text IS NOT NULL)) WHERE regexp_matches(line, '[^\s]')")
def segments_from_text(spark, sf):
    """Non-blank lines of each text, numbered from 1."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\s]"))
    return load(spark, sf, "docx_segments").where(c("text").isNotNull()).select("segment_id", F.posexplode(lines).alias("p", "line")).select("segment_id", (c("p") + 1).alias("pos"), "line").distinct()


@part.query(
    """SELECT docx_id, segment_index, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY docx_id ORDER BY segment_index, segment_id) AS rn FROM (SELECT DISTINCT docx_id, segment_index, segment_id FROM docx_segments WHERE contains(lower(text), 'site'))) WHERE rn <= 5"""
)
def find_segments(spark, sf):
    """The first five segments of each file that hold a word."""
    from pyspark.sql import Window

    d = load(spark, sf, "docx_segments").where(F.contains(F.lower("text"), F.lit("site"))).select("docx_id", "segment_index", "segment_id").distinct()
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("docx_id").orderBy("segment_index", "segment_id"))).where(c("rn") <= 5).drop("rn")


JUNK = "(trim(coalesce({0}, '')) = '' OR regexp_matches(trim(coalesce({0}, '')), " + q(X.JUNK) + ") OR (length(trim(coalesce({0}, ''))) > 120 AND regexp_matches(trim({0}), '[.。].*[.。]')))"


@part.query(
    f"""SELECT reason, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, CASE WHEN trim(coalesce(source, '')) = '' THEN 'EMPTY' WHEN lower(trim(source)) IN ('n/a', 'see above', 'visit', 'site file', 'test entry', '???') THEN 'DENYLIST'
    WHEN length(trim(source)) < 3 THEN 'TOO_SHORT' WHEN length(trim(source)) > 64 THEN 'TOO_LONG' WHEN regexp_matches(source, '^[0-9\\s.,:/-]+$') THEN 'PATTERN' WHEN regexp_matches(trim(source), {q(X.PRESERVE_CELL)}) THEN 'CELL_PRESERVE' WHEN {at(JUNK, 'source')} THEN 'JUNK' ELSE 'ADMITTED' END AS reason FROM term_screen_decisions) GROUP BY reason"""
)
def admission_cascade(spark, sf):
    """First rule of a fixed order that keeps a term out of the term base."""
    s = F.trim("source")
    reason = (
        F.when(F.coalesce(s, F.lit("")) == "", "EMPTY").when(F.lower(s).isin("n/a", "see above", "visit", "site file", "test entry", "???"), "DENYLIST").when(F.length(s) < 3, "TOO_SHORT").when(F.length(s) > 64, "TOO_LONG")
        .when(c("source").rlike(r"^[0-9\s.,:/-]+$"), "PATTERN").when(s.rlike(X.PRESERVE_CELL), "CELL_PRESERVE").when(X.is_junk_source(c("source")), "JUNK").otherwise("ADMITTED")
    )
    return load(spark, sf, "term_screen_decisions").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


POLICY = f"CASE WHEN trim(coalesce(text, '')) = '' OR regexp_matches(trim(text), {q(X.PRESERVE_CELL)}) OR regexp_matches(trim(text), {q(X.UNIT_ONLY)}) OR regexp_matches(trim(text), '(?i)^Q\\d+W$') THEN 'PRESERVE' WHEN regexp_matches(trim(text), '\\d|https?://|@') THEN 'PROTECT_TOKENS' ELSE 'TRANSLATE' END"


@part.query(f"SELECT {POLICY} AS policy, count(*) AS n FROM docx_segments WHERE table_path IS NOT NULL GROUP BY 1")
def cell_policies(spark, sf):
    return load(spark, sf, "docx_segments").where(c("table_path").isNotNull()).groupBy(X.cell_policy(c("text")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))


WIDE = "（）％＝＋＜＞−" + "".join(map(chr, range(0xFF10, 0xFF1A))) + "".join(map(chr, range(0xFF21, 0xFF3B))) + "".join(map(chr, range(0xFF41, 0xFF5B)))


@part.query(f"SELECT DISTINCT source, regexp_replace(translate(source, {q(WIDE)}, '()%=+<>-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'), '\\(\\s*([nN])\\s*=\\s*(\\d+)\\s*\\)', '(\\1=\\2)', 'g') AS compact FROM term_screen_decisions WHERE source IS NOT NULL")
def compact_punctuation(spark, sf):
    return load(spark, sf, "term_screen_decisions").where(c("source").isNotNull()).select("source", X.compact_cell(c("source")).alias("compact")).distinct()


ESCAPED = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""


@part.query(f"SELECT doc_id, CAST(strlen({at(ESCAPED, 'text')}) + 9 AS INTEGER) AS bytes FROM documents WHERE text IS NOT NULL")
def json_sizes(spark, sf):
    return load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", X.json_bytes(c("text")).alias("bytes"))


@part.query(r"SELECT doc_id, CAST(length(regexp_replace('<think>plan' || chr(10) || '</think><span id=1>' || text || '</span>', '(?s)^\s*<think>.*?</think>', '')) AS INTEGER) AS without_think, CAST(length(regexp_replace(regexp_replace('<span id=1>' || text || '</span>', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[\x{80}-\x{9F}]', ' ', 'g'), '(?i)</?\s*(?:span|style|font)[^>]*>', '', 'g')) AS INTEGER) AS without_markup FROM documents WHERE text IS NOT NULL")
def strip_wrappers(spark, sf):
    wrapped = F.concat(F.lit("<span id=1>"), "text", F.lit("</span>"))
    return load(spark, sf, "documents").where(c("text").isNotNull()).select("doc_id", F.length(X.strip_think(F.concat(F.lit("<think>plan\n</think>"), wrapped))).alias("without_think"), F.length(X.strip_markup(wrapped)).alias("without_markup"))


@part.query("SELECT DISTINCT entry_id, sha256(concat_ws('|', coalesce(source, ''), coalesce(layer, ''), coalesce(src_lng, ''), coalesce(tgt_lng, ''))) AS import_key, sha256(coalesce(src_lng, '') || chr(0) || coalesce(source, '')) AS text_hash FROM clinical_lifecycle")
def entry_hashes(spark, sf):
    """Import key and embedding text hash of each entry."""
    z = lambda x: F.coalesce(x, F.lit(""))
    return load(spark, sf, "clinical_lifecycle").select("entry_id", F.sha2(F.concat_ws("|", z("source"), z("layer"), z("src_lng"), z("tgt_lng")), 256).alias("import_key"), F.sha2(F.concat(z("src_lng"), F.lit("\0"), z("source")), 256).alias("text_hash")).distinct()


@part.query("SELECT tenant_id, n, sha256(a || ':' || b || ':' || n) AS version_token FROM (SELECT tenant_id, count(*) AS n, CAST(sum(k) AS VARCHAR) AS a, CAST(sum(k * version % 1000000007) AS VARCHAR) AS b FROM (SELECT DISTINCT tenant_id, CAST(right(id, 10) AS BIGINT) AS k, version FROM tm_units WHERE approved) GROUP BY tenant_id)")
def version_token(spark, sf):
    """One token for the state of each tenant's approved units: equal states, equal tokens, whatever the order of the rows.

    Sums that combine partially, so no list of a tenant's units is formed; `operators.relational.state_token` does it for any item.
    """
    u = load(spark, sf, "tm_units").where("approved").select("tenant_id", F.right("id", F.lit(10)).cast("long").alias("k"), "version").distinct()
    a = u.groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("k").alias("a"), F.sum(c("k") * c("version") % 1000000007).alias("b"))
    return a.select("tenant_id", "n", F.sha2(F.concat_ws(":", c("a").cast("string"), c("b").cast("string"), c("n").cast("string")), 256).alias("version_token"))


QUERIES, ORACLE = part.QUERIES, part.ORACLE
