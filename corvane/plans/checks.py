"""Checks of translated segments and of what the ledgers say, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import labels, udfs
from corvane.functions import text as X
from corvane.operators import packed_fields, relational, segments
from corvane.plans import fields
from corvane.plans.base import Part
from corvane.session import checked_broadcast_rows, load

part = Part()
c = F.col


def forbidden_terms(spark: SparkSession, sf: str, most: int = 100_000) -> list[str]:
    """Terms that no target may hold: those of the curated list, which is small by contract."""
    packed = packed_fields.values(load(spark, sf, "domain_ad_concepts"), "concept_id", "forbidden_targets", "f").select(F.lower("val").alias("val")).where(F.length("val") > 1).distinct()
    return sorted(r.val for r in checked_broadcast_rows(packed, most, "the forbidden terms"))


def sql_tokens(column: str, check: str) -> str:
    taken, counts = segments.TOKENS[check]
    return f"list_distinct(list_filter(regexp_extract_all({column}, '{taken}'), lambda x: regexp_matches(x, '{counts}')))"


def sql_findings() -> str:
    reported, parts, steps = "CAST([] AS VARCHAR[])", [], "SELECT DISTINCT id, coalesce(source_text, '') AS s, coalesce(target_text, '') AS t FROM tm_units"
    for check in segments.TOKENS:
        kept = f"NOT list_contains({sql_tokens('t', check)}, x)" if check == "numbers" else "NOT contains(t, x)"
        steps = f"SELECT *, list_filter({sql_tokens('s', check)}, lambda x: {kept} AND NOT list_contains({reported}, x)) AS {check} FROM ({steps})"
        reported = f"list_concat({reported}, {check})"
        parts.append(f"SELECT id, '{check}' AS check_name, unnest({check}) AS detail FROM steps")
    negated = lambda x: f"(regexp_matches({x}, '(?i)(?:^|[^A-Za-z])(?:{segments.NEGATION_EN})(?:[^A-Za-z]|$)') OR regexp_matches({x}, '{segments.NEGATION_ZH}'))"
    parts.append(f"SELECT id, 'negation', '' FROM steps WHERE trim(t) <> '' AND {negated('s')} AND NOT {negated('t')}")
    parts.append(f"SELECT id, 'omissions', CASE WHEN trim(t) = '' THEN 'empty' ELSE 'markup' END FROM steps WHERE trim(s) <> '' AND trim(t) = '' OR regexp_matches(t, '{segments.MARKUP}')")
    return f"WITH steps AS ({steps}) " + " UNION ALL ".join(parts)


@part.query(sql_findings())
def segment_checks(spark, sf):
    """Every finding of the checks that ask for nothing beside the two texts."""
    u = load(spark, sf, "tm_units").select("id", c("source_text").alias("source"), c("target_text").alias("target"))
    return segments.findings(u).select("id", c("check").alias("check_name"), "detail")


TERMS = f"(SELECT list(DISTINCT lower(val)) FROM ({fields.P3.format('', 1)}) WHERE field_name = 'domain_ad_concepts.forbidden_targets' AND length(val) > 1)"
SEVERITY = "CASE WHEN check_name = 'abbreviations' OR check_name = 'omissions' AND detail = 'markup' THEN 'warning' ELSE 'critical' END"


@part.query(f'SELECT check_name AS "check", {SEVERITY} AS severity, count(*) AS n, count(DISTINCT id) AS units FROM ({sql_findings()} UNION ALL SELECT id, \'terminology\', unnest(list_filter({TERMS}, lambda x: contains(lower(t), x))) FROM steps) GROUP BY 1, 2')
def segment_terms(spark, sf):
    """The same with the forbidden terms of the curated list: units by check and severity."""
    terms = F.array(*map(F.lit, forbidden_terms(spark, sf))).cast("array<string>")
    u = load(spark, sf, "tm_units").select("id", c("source_text").alias("source"), c("target_text").alias("target"), terms.alias("forbidden"))
    return segments.findings(u).groupBy("check", "severity").agg(F.count("*").alias("n"), F.countDistinct("id").alias("units"))


@part.query(f"SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(source_text, '{labels.DRUG}'), lambda x: lower(x))), lambda x: NOT contains(lower(target_text), x))), ' ') AS lost FROM (SELECT DISTINCT id, source_text, target_text FROM tm_units WHERE source_text IS NOT NULL AND target_text IS NOT NULL) WHERE len(list_filter(regexp_extract_all(source_text, '{labels.DRUG}'), lambda x: NOT contains(lower(target_text), lower(x)))) > 0")
def drug_names_lost(spark, sf):
    """Substance names of the source (by their stems) that the target does not write alike."""
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull() & c("target_text").isNotNull()).select("id", "source_text", "target_text").distinct()
    lost = labels.drugs_lost(c("source_text"), c("target_text"))
    return u.select("id", F.array_sort(lost).alias("lost")).where(F.size("lost") > 0).select("id", F.array_join("lost", " ").alias("lost"))


@part.query("SELECT source, count(*) AS docs, count_if(kind = 'tabular') AS tabular, count_if(kind = 'prose') AS prose FROM (SELECT source, CASE WHEN n_lines >= 3 AND 10 * dense >= 6 * n_lines THEN 'tabular' ELSE 'prose' END AS kind FROM (SELECT source, len(ls) AS n_lines, len(list_filter(ls, lambda x: length(x) <= 60 AND 5 * length(regexp_replace(x, '[^0-9]', '', 'g')) >= length(regexp_replace(x, ' ', '', 'g')))) AS dense FROM (SELECT source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL))) GROUP BY source")
def tabular_documents(spark, sf):
    """Documents that look like tables: most of their lines are short and dense in digits."""
    d = load(spark, sf, "documents").where(c("text").isNotNull()).select("source", labels.looks_tabular(c("text")).alias("tabular"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("tabular").alias("tabular"), F.count_if(~c("tabular")).alias("prose"))


BLIND = "CAST(json_extract(x, '$.generic') AS DOUBLE) / greatest(CAST(json_extract(x, '$.extracted') AS DOUBLE), 1)"
STATS = "json_object('extracted', count(*), 'generic', count_if(term_type = 'general' OR term_type IS NULL), 'errors', count_if(source IS NULL), 'capped', count_if(false))"


@part.query(f"SELECT model, CAST(json_extract(x, '$.extracted') AS BIGINT) AS extracted, CAST(json_extract(x, '$.generic') AS BIGINT) AS generic, {BLIND} > 0.5 OR CAST(json_extract(x, '$.errors') AS BIGINT) > 0 AS blind FROM (SELECT model, {STATS} AS x FROM (SELECT DISTINCT * FROM term_screen_decisions) GROUP BY model)")
def screen_blindness(spark, sf):
    """Screens (by model) that see too little: more than half of what they extract is general, or they had errors."""
    d = load(spark, sf, "term_screen_decisions").distinct()
    stats = d.groupBy("model").agg(F.to_json(F.struct(F.count("*").alias("extracted"), F.count_if((c("term_type") == "general") | c("term_type").isNull()).alias("generic"), F.count_if(c("source").isNull()).alias("errors"), F.lit(0).alias("capped"))).alias("stats"))
    return labels.blindness(stats, "stats").select("model", "extracted", "generic", "blind")


@part.query("SELECT proposal, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT 'denylist' AS proposal, lower(trim(source)) AS value FROM term_screen_decisions WHERE decision = 'noise' AND trim(source) <> '' UNION ALL SELECT 'curated', lower(trim(source)) FROM term_screen_decisions WHERE decision <> 'noise' AND trim(source) <> '' UNION ALL SELECT 'alias', regexp_replace(lower(trim(source)), '^(?:anti|non|pre)-', '') FROM term_screen_decisions WHERE regexp_matches(lower(trim(source)), '^(?:anti|non|pre)-') UNION ALL SELECT 'suffix', right(lower(trim(source)), 4) FROM term_screen_decisions WHERE length(trim(source)) > 8 AND regexp_matches(source, '^[\\x20-\\x7E]+$')) GROUP BY proposal")
def proposal_report(spark, sf):
    """All kinds of proposals as one report."""
    d = load(spark, sf, "term_screen_decisions").where(F.trim("source") != "").select("decision", F.lower(F.trim("source")).alias("v"), "source")
    kinds = {
        "denylist": d.where(c("decision") == "noise").select("v"), "curated": d.where(c("decision") != "noise").select("v"),
        "alias": d.where(c("v").rlike("^(?:anti|non|pre)-")).select(F.regexp_replace("v", "^(?:anti|non|pre)-", "").alias("v")),
        "suffix": d.where((F.length("v") > 8) & c("source").rlike(r"^[\x20-\x7E]+$")).select(F.right("v", F.lit(4)).alias("v")),
    }
    return relational.tagged_union(kinds, "proposal").groupBy("proposal").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))


@part.query("SELECT v.concept_id, CASE WHEN q.concept_id IS NULL THEN 'unmatched' ELSE 'matched' END AS state, n FROM (SELECT concept_id, count(*) AS n FROM (SELECT DISTINCT concept_id, entry_id FROM domain_ad_concepts JOIN (SELECT DISTINCT entry_id, lower(target) AS low FROM domain_ad WHERE target IS NOT NULL) ON contains(low, lower(zh)) WHERE zh IS NOT NULL) GROUP BY concept_id) v LEFT JOIN (SELECT DISTINCT concept_id FROM domain_ad_concepts WHERE risk = 'high') q USING (concept_id)")
def violation_reconciliation(spark, sf):
    """Concepts that targets hold, matched with those that block."""
    from corvane.operators import dictionary

    concepts = load(spark, sf, "domain_ad_concepts")
    rows = load(spark, sf, "domain_ad").where(c("target").isNotNull()).select("entry_id", F.lower("target").alias("low")).distinct()
    held = dictionary.scan(rows, "low", concepts.where(c("zh").isNotNull()).select(F.lower("zh").alias("term"), c("concept_id").alias("key")), longest=False, borders=False).select(c("key").alias("concept_id"), "entry_id").distinct()
    counted = held.groupBy("concept_id").agg(F.count("*").alias("n"))
    blocking = concepts.where(c("risk") == "high").select("concept_id").distinct().withColumn("blocks", F.lit(True))
    return counted.join(blocking, "concept_id", "left").select("concept_id", F.when(c("blocks"), "matched").otherwise("unmatched").alias("state"), "n")


@part.query("SELECT tgt_lng, string_agg(source || ' => ' || target, chr(10) ORDER BY source, target) AS block FROM (SELECT tgt_lng, source, target, row_number() OVER (PARTITION BY tgt_lng ORDER BY source, target) AS r FROM (SELECT DISTINCT coalesce(tgt_lng, '') AS tgt_lng, source, target FROM proper_nouns WHERE source IS NOT NULL AND target IS NOT NULL)) WHERE r <= 80 GROUP BY tgt_lng")
def prompt_blocks(spark, sf):
    """The block of names for each language that a prompt shows: 80 lines at most, in order."""
    n = load(spark, sf, "proper_nouns").where(c("source").isNotNull() & c("target").isNotNull()).select(F.coalesce("tgt_lng", F.lit("")).alias("tgt_lng"), "source", "target").distinct()
    top = relational.first_n_per_key(n, ["tgt_lng"], [c("source"), c("target")], 80)
    listed = top.groupBy("tgt_lng").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("x"))
    return listed.select("tgt_lng", F.array_join(F.transform("x", lambda p: F.concat(p["source"], F.lit(" => "), p["target"])), "\n").alias("block"))


@part.query("SELECT archive_id, lower(regexp_extract(original_filename, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE lower(regexp_extract(original_filename, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in labels.FORMATS.items()) + " ELSE 'txt' END AS format FROM (SELECT DISTINCT archive_id, original_filename FROM archives)")
def format_lookup(spark, sf):
    """The format of each file by its extension, plain text for what is unknown (the second router)."""
    a = load(spark, sf, "archives").select("archive_id", "original_filename").distinct()
    ext = F.lower(F.regexp_extract("original_filename", r"\.([A-Za-z0-9]+)$", 1))
    return a.select("archive_id", ext.alias("ext"), labels.format_of(ext, "txt").alias("format"))


@part.query()
def numbers_kept(spark, sf):
    """Units by whether their target keeps all protected amounts, lost some, added some or both."""
    f = udfs.register()["number_drift"]
    u = load(spark, sf, "tm_units").where(c("source_text").isNotNull() & c("target_text").isNotNull()).select("id", "source_text", "target_text").distinct().select(f("source_text", "target_text").alias("d"))
    state = F.concat_ws("+", F.when(F.size("d.missing") > 0, "missing"), F.when(F.size("d.added") > 0, "added"))
    return u.select(F.when(state == "", "kept").otherwise(state).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


STATES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.TASK_STATES.items())


@part.query(f"SELECT CASE lower(trim(o_orderstatus)) {STATES} ELSE 'degraded' END AS state, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'Done ' WHEN 'O' THEN 'processing' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def task_states(spark, sf):
    """Orders by the one spelling of their state; what is no known spelling is degraded."""
    o = load(spark, sf, "orders").select(F.when(c("o_orderstatus") == "F", "Done ").when(c("o_orderstatus") == "O", "processing").otherwise(c("o_orderstatus")).alias("s"))
    return o.groupBy(labels.task_state(c("s")).alias("state")).agg(F.count("*").alias("n"))


@part.query("SELECT entry_id, CASE WHEN o.risk = 'high' THEN o.risk ELSE coalesce(n.risk, o.risk) END AS risk, CASE WHEN o.risk = 'high' THEN o.notes ELSE coalesce(n.notes, o.notes) END AS notes FROM (SELECT entry_id, min(risk) AS risk, min(notes) AS notes FROM domain_ad WHERE right(entry_id, 1) <= '6' GROUP BY entry_id) o FULL JOIN (SELECT entry_id, max(risk) AS risk, max(notes) AS notes FROM domain_ad WHERE right(entry_id, 1) >= '3' GROUP BY entry_id) n USING (entry_id)")
def states_overlaid(spark, sf):
    """Two rounds of entries as one: the later says what holds, but for what was settled in the earlier."""
    d = load(spark, sf, "domain_ad")
    last = F.right("entry_id", F.lit(1))
    old = d.where(last <= "6").groupBy("entry_id").agg(F.min("risk").alias("risk"), F.min("notes").alias("notes"))
    new = d.where(last >= "3").groupBy("entry_id").agg(F.max("risk").alias("risk"), F.max("notes").alias("notes"))
    return relational.overlaid(old, new, ["entry_id"], ["risk", "notes"], c("risk") == "high")


@part.query("SELECT u.id, coalesce(r.target_text, u.target_text) AS target_text FROM (SELECT DISTINCT id, source_text, target_text FROM tm_units) u LEFT JOIN (SELECT source_text, min(target_text) AS target_text FROM tm_units WHERE approved AND target_text IS NOT NULL GROUP BY source_text) r USING (source_text)")
def reviewed_targets(spark, sf):
    """Every unit with the approved target of its very source, where there is one."""
    u = load(spark, sf, "tm_units")
    return relational.overridden(u.select("id", "source_text", "target_text").distinct(), u.where("approved").select("source_text", "target_text"), "source_text", "target_text").select("id", "target_text")


@part.query("SELECT d.decision_id, d.source, starts_with(d.model, 'rule') AS by_machine FROM (SELECT DISTINCT decision_id, source, model FROM term_screen_decisions WHERE decision IN ('noise', 'generic')) d JOIN (SELECT DISTINCT lower(trim(en)) AS norm FROM domain_ad_concepts WHERE en IS NOT NULL) a ON lower(trim(d.source)) = a.norm")
def rejected_rows(spark, sf):
    """Rejected values that name a curated concept, with whether a machine rejected them."""
    d = load(spark, sf, "term_screen_decisions").where(c("decision").isin("noise", "generic")).select("decision_id", "source", "model").distinct()
    held = load(spark, sf, "domain_ad_concepts").where(c("en").isNotNull()).select(F.lower(F.trim("en")).alias("norm")).distinct()
    return d.join(held, F.lower(F.trim(d["source"])) == c("norm")).select("decision_id", "source", F.startswith("model", F.lit("rule")).alias("by_machine"))


@part.query("SELECT to_lang, count(*) AS runs, count_if(translated_text_preview IS NULL) AS blind_runs, round(1 - count_if(translated_text_preview IS NULL) / count(*), 6) AS acceptance FROM (SELECT DISTINCT archive_id, to_lang, created_at, translated_text_preview FROM archives WHERE left(created_at, 10) >= '2024-06-01') GROUP BY to_lang")
def domain_metrics(spark, sf):
    """Runs since a day, those that gave nothing, and the share of the others."""
    a = load(spark, sf, "archives").where(F.left("created_at", F.lit(10)) >= "2024-06-01").select("archive_id", "to_lang", "created_at", "translated_text_preview").distinct()
    blind = F.count_if(c("translated_text_preview").isNull())
    return a.groupBy("to_lang").agg(F.count("*").alias("runs"), blind.alias("blind_runs"), F.round(1 - blind / F.count("*"), 6).alias("acceptance"))


QUERIES, ORACLE = part.QUERIES, part.ORACLE
