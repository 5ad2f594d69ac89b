"""Ledger queries: versions, pages, merges, diffs, aggregates, windows and event streams as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import relational as R
from corvane.plans.base import Part
from corvane.plans.text import LANG, NORM, at
from corvane.session import load

part = Part()
c = F.col

# The runs ledger: a customer is a chain, its orders are the versions.
LATEST = "SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders o) WHERE rn = 1"
PHASE = "CASE o_orderstatus WHEN 'O' THEN 'executing' WHEN 'P' THEN 'gated' WHEN 'F' THEN 'completed' ELSE 'failed' END"


def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return R.best_per_key(load(spark, sf, "orders"), ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey").desc()])


def phase() -> F.Column:
    return F.when(c("o_orderstatus") == "O", "executing").when(c("o_orderstatus") == "P", "gated").when(c("o_orderstatus") == "F", "completed").otherwise("failed")


@part.query(f"SELECT {PHASE} AS phase, c_mktsegment, count(*) AS n FROM ({LATEST}) LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def run_facets(spark, sf):
    """Latest version of each chain, counted by phase and segment of its dimension row."""
    customers = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return latest_runs(spark, sf).join(customers, c("o_custkey") == c("c_custkey"), "left").groupBy(phase().alias("phase"), "c_mktsegment").agg(F.count("*").alias("n"))


@part.query(f"SELECT o_custkey, o_orderkey, {PHASE} AS phase FROM ({LATEST.replace('FROM orders o', 'FROM orders o WHERE o_totalprice > 100000')})")
def run_latest_version(spark, sf):
    """Filters come before ranking: the newest version that matches stands for its chain."""
    rows = load(spark, sf, "orders").where(c("o_totalprice") > 100000)
    return R.best_per_key(rows, ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey").desc()]).select("o_custkey", "o_orderkey", phase().alias("phase"))


@part.query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (200000.0, 5000) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 51")
def run_keyset_page(spark, sf):
    return R.keyset_page(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", False)], [200000.0, 5000], 51)


@part.query("SELECT o_orderkey, o_orderpriority, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 100")
def run_offset_page(spark, sf):
    o = load(spark, sf, "orders")
    return o.orderBy("o_orderdate", "o_orderkey").offset(100).limit(25).select("o_orderkey", "o_orderpriority").crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))


@part.query("SELECT c_custkey, c_name, coalesce(n, 0) AS n, coalesce(open, 0) AS open, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'O') AS open, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def run_enrichment(spark, sf):
    """Each chain with what belongs to it, aggregated before the join."""
    a = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "O").alias("open"), F.max("o_orderkey").alias("last"))
    return load(spark, sf, "customer").join(a, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("open", F.lit(0)).alias("open"), "last")


@part.query("SELECT r_name, n_name, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY 1, 2")
def scope_chain_join(spark, sf):
    """Inner joins along a chain of scopes, with filter and columns pushed into the scans."""
    j = load(spark, sf, "lineitem").where(c("l_returnflag") == "R").select("l_orderkey", "l_quantity")
    j = j.join(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).join(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
    j = j.join(load(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey")).join(load(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@part.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def ownership_check(spark, sf):
    o = load(spark, sf, "orders")
    k = o.select(c("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").select("c_custkey").join(k.where(c("o_orderstatus") == "P"), "c_custkey", "left_semi").join(k.where(c("o_totalprice") > 400000), "c_custkey", "left_anti")


LAYERS = {"org": 100, "form": 90, "project": 85, "clinical": 80, "session": 40, "harvest": 20}
PRIORITY = "CASE lower(trim(coalesce(layer, ''))) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LAYERS.items()) + " ELSE 0 END"


@part.query(
    f"""SELECT lang, norm, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, norm ORDER BY priority DESC, entry_id) AS rn FROM (SELECT DISTINCT {at(LANG, 'src_lng')} AS lang, {at(NORM, 'source')} AS norm, entry_id, {PRIORITY} AS priority
    FROM clinical_lifecycle WHERE trim(coalesce(source, '')) <> '' AND coalesce(status, '') <> 'rejected')) WHERE rn = 1"""
)
def layer_priority_merge(spark, sf):
    """The entry of the highest layer for each language and normal form; rejected entries take no part."""
    table = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    e = load(spark, sf, "clinical_lifecycle").where((F.trim(F.coalesce("source", F.lit(""))) != "") & (F.coalesce("status", F.lit("")) != "rejected"))
    e = e.select(X.normalise_lang(c("src_lng")).alias("lang"), X.normalise_source(c("source")).alias("norm"), "entry_id", F.coalesce(table[F.lower(F.trim(F.coalesce("layer", F.lit(""))))], F.lit(0)).alias("priority")).distinct()
    return R.best_per_key(e, ["lang", "norm"], [c("priority").desc(), c("entry_id")]).select("lang", "norm", "entry_id")


@part.query(
    f"""WITH u AS (SELECT *, {at(LANG, 'src_lang')} AS s, {at(LANG, 'tgt_lang')} AS t FROM tm_units WHERE coalesce(source_norm, '') <> ''), queries AS (SELECT DISTINCT id AS query_id, tenant_id, s, t, source_norm, placeholder_sig FROM u)
    SELECT query_id, id AS unit_id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY version DESC, id) AS rn FROM (SELECT DISTINCT query_id, id, version FROM queries JOIN u USING (tenant_id, s, t, source_norm) WHERE queries.placeholder_sig IS NOT DISTINCT FROM u.placeholder_sig AND approved AND id <> query_id)) WHERE rn = 1"""
)
def tm_exact_lookup(spark, sf):
    """For every unit: the best other approved unit of its tenant and languages with the same normal form and signature."""
    u = load(spark, sf, "tm_units").where(F.coalesce("source_norm", F.lit("")) != "").select("id", "tenant_id", X.normalise_lang(c("src_lang")).alias("s"), X.normalise_lang(c("tgt_lang")).alias("t"), "source_norm", F.coalesce("placeholder_sig", F.lit("\0")).alias("sig"), "approved", "version")
    queries = u.select(c("id").alias("query_id"), "tenant_id", "s", "t", "source_norm", "sig").distinct()
    hits = queries.join(u.where("approved"), ["tenant_id", "s", "t", "source_norm", "sig"]).where(c("id") != c("query_id")).select("query_id", "id", "version").distinct()
    return R.best_per_key(hits, ["query_id"], [c("version").desc(), c("id")]).select("query_id", c("id").alias("unit_id"))


@part.query(f"SELECT key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT {at(NORM, 'source')} AS key, min(target) AS t FROM domain_ad WHERE source IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT {at(NORM, 'en')} AS key, min(zh) AS t FROM domain_ad_concepts WHERE en IS NOT NULL GROUP BY 1) b USING (key) WHERE a.key IS NULL OR b.key IS NULL OR a.t IS DISTINCT FROM b.t")
def release_diff(spark, sf):
    """Entries added, removed or changed between two term lists."""
    old = load(spark, sf, "domain_ad").where(c("source").isNotNull()).groupBy(X.normalise_source(c("source")).alias("key")).agg(F.min("target").alias("t"))
    new = load(spark, sf, "domain_ad_concepts").where(c("en").isNotNull()).groupBy(X.normalise_source(c("en")).alias("key")).agg(F.min("zh").alias("t"))
    return R.diff(old, new, "key", "t")


ROUNDS = "SELECT DISTINCT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS round FROM events"


@part.query(f"WITH r AS ({ROUNDS}) SELECT state, count(*) AS n FROM (SELECT user_id, event_type, CASE WHEN min(round) = 2 THEN 'new' WHEN max(round) = 1 THEN 'resolved' ELSE 'persisting' END AS state FROM r GROUP BY 1, 2) GROUP BY state")
def round_diff(spark, sf):
    """Findings that are new, resolved or persisting between two rounds: one aggregate instead of two anti-joins."""
    e = load(spark, sf, "events").select("user_id", "event_type", F.when(c("event_id") % 2 == 0, 1).otherwise(2).alias("round"))
    s = e.groupBy("user_id", "event_type").agg(F.min("round").alias("lo"), F.max("round").alias("hi"))
    return s.groupBy(F.when(c("lo") == 2, "new").when(c("hi") == 1, "resolved").otherwise("persisting").alias("state")).agg(F.count("*").alias("n"))


@part.query("SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view, count(*) AS n, CASE WHEN bool_or(value > 95) THEN 'blocked' WHEN bool_or(value > 80) THEN 'degraded' ELSE 'ready' END AS gate FROM events GROUP BY user_id")
def gate_state(spark, sf):
    """Tally by kind and the worst state of each group."""
    return load(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(c("event_type") == "click").alias("click"), F.count_if(c("event_type") == "view").alias("view"), F.count("*").alias("n"),
        F.when(F.coalesce(F.bool_or(c("value") > 95), F.lit(False)), "blocked").when(F.coalesce(F.bool_or(c("value") > 80), F.lit(False)), "degraded").otherwise("ready").alias("gate"),
    )


@part.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS INTEGER) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def diagnostics_cube(spark, sf):
    """Histograms over all combinations of dimensions in one pass."""
    return load(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@part.query(f"SELECT key, n, targets, targets > 1 AS conflict, n > 1 AND targets <= 1 AS duplicate FROM (SELECT {at(NORM, 'source')} AS key, count(*) AS n, count(DISTINCT target) AS targets FROM domain_ad WHERE source IS NOT NULL GROUP BY 1)")
def same_source_flags(spark, sf):
    d = load(spark, sf, "domain_ad").where(c("source").isNotNull()).groupBy(X.normalise_source(c("source")).alias("key")).agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))
    return d.select("key", "n", "targets", (c("targets") > 1).alias("conflict"), ((c("n") > 1) & (c("targets") <= 1)).alias("duplicate"))


@part.query(f"SELECT {at(NORM, 'source')} AS key, count(*) AS n, count(DISTINCT decision_id) AS decisions, count(DISTINCT model) AS models FROM term_screen_decisions WHERE trim(coalesce(source, '')) <> '' GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT decision_id) >= 2")
def denylist_proposals(spark, sf):
    """Normal forms seen at least three times in at least two decisions."""
    d = load(spark, sf, "term_screen_decisions").where(F.trim(F.coalesce("source", F.lit(""))) != "").groupBy(X.normalise_source(c("source")).alias("key"))
    return d.agg(F.count("*").alias("n"), F.countDistinct("decision_id").alias("decisions"), F.countDistinct("model").alias("models")).where((c("n") >= 3) & (c("decisions") >= 2))


@part.query(f"SELECT suffix, count(DISTINCT norm) AS norms FROM (SELECT {at(NORM, 'source')} AS norm, string_split({at(NORM, 'source')}, '-')[-1] AS suffix FROM term_screen_decisions WHERE contains(source, '-')) WHERE length(suffix) >= 1 AND suffix <> norm GROUP BY suffix HAVING count(DISTINCT norm) >= 3")
def suffix_patterns(spark, sf):
    """Endings behind the last hyphen that at least three different forms share."""
    n = load(spark, sf, "term_screen_decisions").where(F.contains("source", F.lit("-"))).select(X.normalise_source(c("source")).alias("norm")).withColumn("suffix", F.substring_index("norm", "-", -1))
    return n.where((F.length("suffix") >= 1) & (c("suffix") != c("norm"))).groupBy("suffix").agg(F.countDistinct("norm").alias("norms")).where(c("norms") >= 3)


@part.query(f"SELECT term_type, count(*) AS keys, count_if(decision = 'domain') AS domain_keys FROM (SELECT {at(NORM, 'source')} AS key, arg_max(decision, (decision_id, decision)) AS decision, arg_max(term_type, (decision_id, decision, term_type)) AS term_type FROM term_screen_decisions WHERE trim(coalesce(source, '')) <> '' AND decision IS NOT NULL AND term_type IS NOT NULL GROUP BY 1) GROUP BY term_type")
def acceptance_rate(spark, sf):
    """The last decision on each normal form, counted by type."""
    d = load(spark, sf, "term_screen_decisions").where((F.trim(F.coalesce("source", F.lit(""))) != "") & c("decision").isNotNull() & c("term_type").isNotNull())
    last = d.groupBy(X.normalise_source(c("source")).alias("key")).agg(F.max_by("decision", F.struct("decision_id", "decision")).alias("decision"), F.max_by("term_type", F.struct("decision_id", "decision", "term_type")).alias("term_type"))
    return last.groupBy("term_type").agg(F.count("*").alias("keys"), F.count_if(c("decision") == "domain").alias("domain_keys"))


@part.query(f"SELECT key, count(*) AS n FROM (SELECT {at(NORM, 'source')} AS key FROM term_screen_decisions WHERE trim(coalesce(source, '')) <> '') WHERE key NOT IN (SELECT {at(NORM, 'en')} FROM domain_ad_concepts WHERE en IS NOT NULL) AND key NOT IN (SELECT {at(NORM, 'zh')} FROM domain_ad_concepts WHERE zh IS NOT NULL) GROUP BY key HAVING count(*) >= 2")
def curated_proposals(spark, sf):
    """Forms decided at least twice that the curated list does not have."""
    concepts = load(spark, sf, "domain_ad_concepts")
    known = concepts.select(X.normalise_source(c("en")).alias("key")).unionByName(concepts.select(X.normalise_source(c("zh")).alias("key"))).distinct()
    n = load(spark, sf, "term_screen_decisions").where(F.trim(F.coalesce("source", F.lit(""))) != "").groupBy(X.normalise_source(c("source")).alias("key")).agg(F.count("*").alias("n")).where(c("n") >= 2)
    return n.join(known, "key", "left_anti")


@part.query("SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50, count(*) AS n FROM events GROUP BY event_type")
def p95_budget(spark, sf):
    """Nearest-rank percentiles, exact."""
    return load(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.count("*").alias("n"))


@part.query("SELECT l_returnflag, round(greatest(0.0, (p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low FROM (SELECT l_returnflag, CAST(count_if(l_discount > 0.05) AS DOUBLE) / count(*) AS p, CAST(count(*) AS DOUBLE) AS n, CAST(3.8416 AS DOUBLE) AS z2 FROM lineitem GROUP BY 1)")
def wilson_bound(spark, sf):
    a = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(c("l_discount") > 0.05).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    return a.select("l_returnflag", F.round(R.wilson_lower(c("k"), c("n")), 6).alias("low"))


@part.query("SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, a.n AS base_n, b.n AS other_n, round(b.v - a.v, 4) AS delta FROM (SELECT p_brand, count(*) AS n, avg(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1) a FULL JOIN (SELECT p_brand, count(*) AS n, avg(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1) b ON a.p_brand = b.p_brand")
def compare_runs(spark, sf):
    """Two cohorts side by side: one scan and one conditional aggregate instead of two and a full join."""
    j = load(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_linestatus").join(load(spark, sf, "part").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey")).where(c("l_linestatus").isin("O", "F"))
    v = lambda s: F.avg(F.when(c("l_linestatus") == s, c("l_quantity")))
    n = lambda s: F.count(F.when(c("l_linestatus") == s, 1))
    a = j.groupBy("p_brand").agg(n("O").alias("o"), n("F").alias("f"), v("O").alias("ov"), v("F").alias("fv"))
    return a.select("p_brand", F.when(c("o") > 0, c("o")).alias("base_n"), F.when(c("f") > 0, c("f")).alias("other_n"), F.round(c("fv") - c("ov"), 4).alias("delta"))


@part.query("SELECT source, count(*) AS docs, sum(n_chars) AS chars, count_if(text IS NULL) AS without_text, count(DISTINCT project_id) AS projects, round(sum(n_chars) / count(n_chars), 4) AS mean_chars FROM documents GROUP BY source")
def macro_report(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(c("text").isNull()).alias("without_text"), F.countDistinct("project_id").alias("projects"), F.round(F.sum("n_chars") / F.count("n_chars"), 4).alias("mean_chars"))


HEAD = "'^\\d+\\. [^\\n]*$'"


@part.query(f"SELECT DISTINCT docx_id, segment_index, segment_id, section FROM (SELECT docx_id, segment_index, segment_id, last_value(CASE WHEN regexp_matches(text, {HEAD}) THEN text END IGNORE NULLS) OVER (PARTITION BY docx_id ORDER BY segment_index, segment_id ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT DISTINCT docx_id, segment_index, segment_id, text FROM docx_segments))")
def section_state(spark, sf):
    """The heading that each segment stands under: the last heading up to it."""
    s = load(spark, sf, "docx_segments").select("docx_id", "segment_index", "segment_id", "text").distinct()
    return R.carried(s, ["docx_id"], ["segment_index", "segment_id"], F.when(c("text").rlike(r"^\d+\. [^\n]*$"), c("text")), "section").drop("text").distinct()


@part.query("SELECT entry_id, source, status FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), status ORDER BY entry_id) AS rn FROM (SELECT DISTINCT entry_id, source, status FROM clinical_lifecycle WHERE source IS NOT NULL)) WHERE status IS DISTINCT FROM 'curated' OR rn = 1")
def collapse_decided(spark, sf):
    """Decided rows once for each key, undecided ones always."""
    e = load(spark, sf, "clinical_lifecycle").where(c("source").isNotNull()).select("entry_id", "source", "status").distinct()
    ranked = e.withColumn("rn", F.row_number().over(Window.partitionBy(F.lower("source"), "status").orderBy("entry_id")))
    return ranked.where(~c("status").eqNullSafe(F.lit("curated")) | (c("rn") == 1)).drop("rn")


@part.query("SELECT project_id, doc_id, rank, CASE WHEN rank = 5 THEN n - 5 ELSE 0 END AS overflow FROM (SELECT project_id, doc_id, row_number() OVER (PARTITION BY project_id ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank, count(*) OVER (PARTITION BY project_id) AS n FROM documents) WHERE rank <= 5")
def capped_findings(spark, sf):
    """The five largest of each group, and how many more there are."""
    d = load(spark, sf, "documents").select("project_id", "doc_id", "n_chars")
    n = d.groupBy(F.coalesce("project_id", F.lit("\0")).alias("k")).agg(F.count("*").alias("n"))
    top = R.first_n_per_key(d, ["project_id"], [c("n_chars").desc_nulls_last(), c("doc_id")], 5).withColumn("k", F.coalesce("project_id", F.lit("\0")))
    return top.join(n, "k").select("project_id", "doc_id", "rank", F.when(c("rank") == 5, c("n") - 5).otherwise(0).alias("overflow"))


@part.query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS baseline, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS generation FROM orders")
def version_baseline(spark, sf):
    """Each version with its number in the chain and the one before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("baseline"), F.row_number().over(w).alias("generation"))


@part.query("SELECT user_id, cluster, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS cluster FROM (SELECT user_id, event_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 21600 THEN 1 ELSE 0 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS s FROM events))) GROUP BY 1, 2")
def gap_clusters(spark, sf):
    """Events of a user in clusters that lie more than six hours apart."""
    e = load(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("s"))
    m = R.merged_intervals(e, ["user_id"], "s", "s", 21600, slice_width=864000, firsts=("event_id",))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("start")).cast("long")
    return m.select("user_id", number.alias("cluster"), "n", c("event_id").alias("first_id"))


@part.query("SELECT user_id, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS b FROM events))) GROUP BY user_id, g")
def interval_merge(spark, sf):
    """Overlapping intervals of a user as one."""
    e = load(spark, sf, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("a"), F.floor(c("value") * 60).cast("long").alias("len")).select("user_id", "a", (c("a") + c("len")).alias("b"))
    return R.merged_intervals(e, ["user_id"], "a", "b", slice_width=86400)


@part.query("SELECT event_id, CAST(sum(1) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events)")
def sliding_rate(spark, sf):
    """Events of the same user within the last hour, each event included."""
    e = load(spark, sf, "events").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"))
    return R.rate(e, ["user_id"], c("s"), 3600, F.lit(1), slice_width=86400).select("event_id", "in_window")


@part.query("SELECT user_id, generation, count(*) AS n, max(event_id) + 1 AS next_sequence FROM (SELECT DISTINCT user_id, CASE WHEN value > 50 THEN 2 ELSE 1 END AS generation, event_id FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0)) GROUP BY 1, 2")
def event_dedupe(spark, sf):
    """Idempotent append: events that came twice count once; the next sequence number of each stream."""
    e = load(spark, sf, "events")
    e = e.unionByName(e.where(c("event_id") % 3 == 0)).select("user_id", F.when(c("value") > 50, 2).otherwise(1).alias("generation"), "event_id").dropDuplicates()
    return e.groupBy("user_id", "generation").agg(F.count("*").alias("n"), (F.max("event_id") + 1).alias("next_sequence"))


@part.query("SELECT fenced, count(*) AS n FROM (SELECT e.event_id, CASE WHEN e.value > 50 THEN 2 ELSE 1 END < g.current AS fenced FROM events e JOIN (SELECT user_id, max(CASE WHEN value > 50 THEN 2 ELSE 1 END) AS current FROM events GROUP BY 1) g USING (user_id)) GROUP BY fenced")
def generation_fence(spark, sf):
    """Events of an older generation than the current one of their stream are fenced off."""
    e = load(spark, sf, "events").select("user_id", F.when(c("value") > 50, 2).otherwise(1).alias("g"))
    current = e.groupBy("user_id").agg(F.max("g").alias("current"))
    return e.join(current, "user_id").groupBy((c("g") < c("current")).alias("fenced")).agg(F.count("*").alias("n"))


@part.query("SELECT user_id, last_id FROM (SELECT user_id, max(epoch_us(ts) // 1000000) AS last, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1) WHERE (SELECT max(epoch_us(ts) // 1000000) FROM events) - last > 86400")
def stale_heartbeats(spark, sf):
    """Streams without an event for more than a day before the last of all."""
    e = load(spark, sf, "events").select("user_id", "event_id", "ts", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"))
    last = e.groupBy("user_id").agg(F.max("s").alias("last"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))
    return last.crossJoin(F.broadcast(e.agg(F.max("s").alias("now")))).where(c("now") - c("last") > 86400).select("user_id", "last_id")


@part.query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS pending FROM (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events) EXCEPT SELECT user_id, event_type FROM events) GROUP BY user_id")
def pending_stages(spark, sf):
    """Planned stages that a stream has no event of."""
    e = load(spark, sf, "events")
    planned = e.agg(F.sort_array(F.collect_set("event_type")).alias("planned"))  # the kinds of events: a fixed, small set
    done = e.groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    return done.crossJoin(F.broadcast(planned)).select("user_id", F.array_join(F.array_except("planned", "done"), ",").alias("pending")).where(c("pending") != "")


@part.query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 9000")
def event_tail(spark, sf):
    """Events behind a cursor; the filter is pushed into the scan."""
    return load(spark, sf, "events").where(c("event_id") > 9000).select("event_id", "user_id", "event_type")


@part.query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1, 2")
def event_days(spark, sf):
    """Tumbling days with a value out of the JSON column."""
    return load(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


GRID = "SELECT DISTINCT docx_id, table_path[1] AS tno, table_path[2] AS r, table_path[3] AS k, text FROM docx_segments WHERE len(table_path) = 3"


@part.query(f"SELECT docx_id, tno, max(r) + 1 AS rows, max(k) + 1 AS cols, count(DISTINCT (r, k)) AS cells, count_if(trim(coalesce(text, '')) = '') AS blanks, count(DISTINCT (r, k)) * 10 < (max(r) + 1) * (max(k) + 1) * 4 AS collapsed FROM ({GRID}) GROUP BY 1, 2")
def table_grids(spark, sf):
    """Dimensions of each table, filled cells, and whether so few are filled that the grid has collapsed."""
    g = cells(spark, sf)
    a = g.groupBy("docx_id", "tno").agg((F.max("r") + 1).alias("rows"), (F.max("k") + 1).alias("cols"), F.countDistinct("r", "k").alias("cells"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blanks"))
    return a.withColumn("collapsed", c("cells") * 10 < c("rows") * c("cols") * 4)


def cells(spark, sf) -> DataFrame:
    return load(spark, sf, "docx_segments").where(F.size("table_path") == 3).select("docx_id", c("table_path")[0].alias("tno"), c("table_path")[1].alias("r"), c("table_path")[2].alias("k"), "text").distinct()


@part.query(f"SELECT DISTINCT a.docx_id, a.tno, a.r, a.k FROM ({GRID}) a JOIN ({GRID}) b ON a.docx_id = b.docx_id AND a.tno = b.tno AND a.text = b.text AND a.r <> b.r AND a.k <> b.k")
def label_value_shift(spark, sf):
    """Cells whose text stands in another row and column of the same table again."""
    g = cells(spark, sf).where(c("text").isNotNull())
    a, b = g.alias("a"), g.alias("b")
    on = (c("a.docx_id") == c("b.docx_id")) & (c("a.tno") == c("b.tno")) & (c("a.text") == c("b.text"))
    return a.join(b, on & (c("a.r") != c("b.r")) & (c("a.k") != c("b.k")), "left_semi").select("a.docx_id", "a.tno", "a.r", "a.k").distinct()


@part.query("SELECT lower(regexp_extract(original_filename, '\\.([A-Za-z0-9]+)$', 1)) AS suffix, CASE lower(regexp_extract(original_filename, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'docx' THEN 'docx' WHEN 'pdf' THEN 'markdown_based' WHEN 'txt' THEN 'txt' WHEN 'xlsx' THEN 'xlsx' WHEN 'csv' THEN 'xlsx' WHEN 'srt' THEN 'srt' WHEN 'ass' THEN 'ass' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'epub' THEN 'epub' WHEN 'json' THEN 'json' WHEN 'pptx' THEN 'pptx' WHEN 'md' THEN 'markdown_based' WHEN 'markdown' THEN 'markdown_based' ELSE 'unsupported' END AS workflow, count(*) AS n FROM archives GROUP BY 1, 2")
def workflow_router(spark, sf):
    """File name extension to reader; an unknown one is unsupported, never guessed."""
    from corvane.sources.readers import workflow_of

    a = load(spark, sf, "archives").select("original_filename")
    return a.groupBy(F.lower(F.regexp_extract("original_filename", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), workflow_of(c("original_filename")).alias("workflow")).agg(F.count("*").alias("n"))


@part.query("SELECT key, files, kinds FROM (SELECT regexp_replace(regexp_replace(lower(coalesce(original_filename, '')), '\\.[a-z0-9]+$', ''), '([._-](zh|en|dual|mono|translated|final|v\\d+))+$', '') AS key, count(DISTINCT archive_id) AS files, count(DISTINCT regexp_extract(original_filename, '\\.([A-Za-z0-9]+)$', 1)) AS kinds FROM archives GROUP BY 1)")
def output_groups(spark, sf):
    """Files of one origin: the name without extension and pipeline markers."""
    a = load(spark, sf, "archives")
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("original_filename", F.lit(""))), r"\.[a-z0-9]+$", ""), r"([._-](zh|en|dual|mono|translated|final|v\d+))+$", "")
    return a.groupBy(key.alias("key")).agg(F.countDistinct("archive_id").alias("files"), F.countDistinct(F.regexp_extract("original_filename", r"\.([A-Za-z0-9]+)$", 1)).alias("kinds"))


QUERIES, ORACLE = part.QUERIES, part.ORACLE
