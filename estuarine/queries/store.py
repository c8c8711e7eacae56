"""Report-store, trend and report-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.functions.mathx import rnd
from estuarine.operators import store as S
from estuarine.operators import trends as T
from estuarine.queries import query
from estuarine.queries.diversity import rounded
from estuarine.queries.sources import scratch


def profiles(v):
    """Organism profiles: one row per detected part."""
    base = v.assignments.groupBy("organism_id").agg(
        F.max("kingdom").alias("kingdom"),
        F.max("phylum").alias("phylum"),
        F.max("genus").alias("genus"),
        F.max("species").alias("species"),
        F.count(F.lit(1)).alias("detection_count"),
        F.max("confidence").alias("confidence"),
        F.max("is_novel_candidate").alias("is_novel_candidate"),
        F.min("created_at").alias("first_detected"),
        F.max("created_at").alias("last_updated"),
    )
    part = v.table("part").select(F.col("p_partkey").alias("organism_id"), F.col("p_name").alias("organism_name"))
    lineage = F.concat(F.lit("K__"), "kingdom", F.lit("; P__"), "phylum")
    return base.join(part, "organism_id").withColumn("taxonomic_lineage", lineage)


PROFILES = """profiles AS (SELECT organism_id, max(kingdom) AS kingdom, max(phylum) AS phylum, max(genus) AS genus,
    max(species) AS species, count(*) AS detection_count, max(confidence) AS confidence,
    bool_or(is_novel_candidate) AS is_novel_candidate, min(created_at) AS first_detected,
    max(created_at) AS last_updated, any_value(p_name) AS organism_name,
    'K__' || max(kingdom) || '; P__' || max(phylum) AS taxonomic_lineage
  FROM assignments JOIN part ON organism_id=p_partkey GROUP BY 1)"""


def dated_reports(v):
    """Orders as dated analysis reports."""
    return v.table("orders").select(
        F.col("o_orderkey").alias("report_id"),
        (F.col("o_custkey") % 25).alias("dataset_id"),
        F.concat(F.lit("report "), "o_orderpriority").alias("report_name"),
        F.col("o_orderstatus").alias("report_type"),
        F.col("o_orderdate").alias("created_at"),
    )


DATED = """dated AS (SELECT o_orderkey AS report_id, o_custkey%25 AS dataset_id,
    'report ' || o_orderpriority AS report_name, o_orderstatus AS report_type, o_orderdate AS created_at FROM orders)"""


@query(
    "search_organisms",
    f"""WITH {PROFILES} SELECT organism_id, organism_name, detection_count, round(confidence,6) AS confidence
    FROM profiles WHERE (organism_name ILIKE '%WIDG%' OR taxonomic_lineage ILIKE '%WIDG%' OR genus ILIKE '%WIDG%'
      OR species ILIKE '%WIDG%') AND kingdom='ECONOMY' AND confidence>=.6
    ORDER BY detection_count DESC, profiles.confidence DESC, organism_id LIMIT 100""",
    "assignments",
)
def _(v):
    out = S.search_organisms(profiles(v), "WIDG", {"kingdom": "ECONOMY", "phylum": None}, 0.6)
    return rounded(out.select("organism_id", "organism_name", "detection_count", "confidence"), "confidence")


@query(
    "list_reports",
    f"""WITH {DATED} SELECT report_id, report_name, strftime(created_at,'%Y-%m-%d') AS day FROM dated
    WHERE dataset_id=7 AND created_at BETWEEN '1995-01-01' AND '1999-12-31' AND report_type='F'
    ORDER BY created_at DESC, report_id LIMIT 40 OFFSET 20""",
)
def _(v):
    out = S.list_reports(dated_reports(v), 7, "1995-01-01", "1999-12-31", "F", offset=20, limit=40)
    return out.select("report_id", "report_name", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(
    "search_reports",
    f"""WITH {DATED} SELECT report_id, report_name FROM dated WHERE report_name ILIKE '%urgent%'
      OR report_type ILIKE '%urgent%' ORDER BY created_at DESC, report_id LIMIT 50""",
)
def _(v):
    return S.search_reports(dated_reports(v), "urgent", ["report_name", "report_type"]).select(
        "report_id", "report_name"
    )


@query(
    "lookup_keys",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT doc_id FROM labels WHERE quality=1)",
)
def _(v):
    keys = v.table("labels").filter("quality = 1").select(F.col("doc_id").alias("p_partkey"))
    return S.lookup(v.table("part"), keys, ["p_partkey"]).select("p_partkey", "p_name")


def runs(v):
    """Runs: one per event type and user, the newest event as time."""
    return v.table("events").groupBy(
        F.col("event_type").alias("dataset"), F.concat(F.lit("run"), "user_id").alias("run_id")
    ).agg(F.max("ts").alias("modified"), F.count(F.lit(1)).alias("events"))


RUNS = """runs AS (SELECT event_type AS dataset, 'run' || user_id AS run_id, max(ts) AS modified, count(*) AS events
    FROM events GROUP BY ALL)"""


@query(
    "search_runs",
    f"WITH {RUNS} SELECT dataset, run_id FROM runs WHERE contains(dataset,'1') OR contains(run_id,'1')",
)
def _(v):
    return S.search_runs(runs(v), "1").select("dataset", "run_id")


@query(
    "recent_runs",
    f"""WITH {RUNS} SELECT dataset, run_id, strftime(modified,'%Y-%m-%d %H:%M:%S') AS modified
    FROM runs ORDER BY runs.modified DESC, dataset, run_id LIMIT 20""",
)
def _(v):
    return S.recent_runs(runs(v), 20).select(
        "dataset", "run_id", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified")
    )


@query(
    "filter_studies",
    """SELECT p_partkey, p_name FROM part WHERE (contains(p_name,'widget') OR contains(p_name,'ring'))
      AND round(p_retailprice*1050)::BIGINT>=1000000""",
)
def _(v):
    studies = v.table("part").select(
        "p_partkey", F.col("p_name").alias("title"), F.round(F.col("p_retailprice") * 1050).cast("long").alias("spots")
    )
    return S.filter_studies(studies, ["Widget", "RING"]).select("p_partkey", F.col("title").alias("p_name"))


@query(
    "clean_names",
    """WITH t AS (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'),
      '[_\\s]+', '_', 'g') AS n FROM pages)
    SELECT page_id, left(CASE WHEN trim(n,'_')='' THEN 'unnamed_dataset' ELSE trim(n,'_') END, 100) AS name FROM t""",
)
def _(v):
    return v.table("pages").select("page_id", S.clean_name(F.col("url")).alias("name"))


@query(
    "report_organisms",
    f"""WITH {PROFILES} SELECT DISTINCT report_id, a.organism_id, organism_name FROM assignments a
    JOIN profiles USING (organism_id) WHERE report_id IN (SELECT report_id FROM reports WHERE dataset_id=3)""",
    "assignments reports",
)
def _(v):
    out = S.report_organisms(v.assignments, profiles(v), v.reports.filter("dataset_id = 3"))
    return out.select("report_id", "organism_id", "organism_name")


@query(
    "co_occurring",
    f"""WITH {PROFILES}, c AS (SELECT organism_id, count(*) AS co_occurrence_count FROM assignments WHERE organism_id<>7
      AND report_id IN (SELECT report_id FROM assignments WHERE organism_id=7) GROUP BY 1 HAVING count(*)>=2)
    SELECT organism_id, co_occurrence_count, organism_name, kingdom FROM c JOIN profiles USING (organism_id)""",
    "assignments",
)
def _(v):
    out = S.co_occurring(v.assignments, profiles(v), 7)
    return out.select("organism_id", "co_occurrence_count", "organism_name", "kingdom")


@query(
    "detection_history",
    """SELECT sequence_id, report_id, report_name, dataset_name, round(confidence,6) AS confidence, is_novel_candidate
    FROM assignments JOIN reports USING (report_id) JOIN datasets USING (dataset_id) WHERE organism_id=7""",
    "assignments reports datasets",
)
def _(v):
    out = S.detection_history(v.assignments, v.reports, v.datasets, 7)
    cols = ["sequence_id", "report_id", "report_name", "dataset_name", "confidence", "is_novel_candidate"]
    return rounded(out.select(*cols), "confidence")


@query(
    "find_similar_reports",
    """SELECT CASE WHEN report_id_1=5 THEN report_id_2 ELSE report_id_1 END AS other_report_id,
      round(overall,6) AS overall FROM similarity_log WHERE (report_id_1=5 OR report_id_2=5) AND overall>=.5
    ORDER BY similarity_log.overall DESC, pair_id LIMIT 15""",
    "similarity_log",
)
def _(v):
    out = S.find_similar_reports(v.similarity_log, 5, 0.5, 15)
    return rounded(out.select("other_report_id", "overall"), "overall")


@query(
    "integrity_checks",
    """WITH k AS (SELECT 'lineitem' AS table_name, l_orderkey || '-' || l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 2
      UNION ALL SELECT 'supplier', s_name, count(*) FROM supplier GROUP BY 2)
    SELECT table_name, sum(n)::BIGINT AS rows, count(*) FILTER (n>1) AS duplicate_keys,
      count(*) FILTER (NOT starts_with(k,'Supplier')) AS bad_ids FROM k GROUP BY 1""",
)
def _(v):
    lines = v.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return S.integrity_checks(
        {"lineitem": lines, "supplier": v.table("supplier")},
        {"lineitem": "key", "supplier": "s_name"},
        "^Supplier",
    )


@query(
    "upsert_replace",
    """WITH n AS (SELECT o_custkey, max_by(o_orderpriority, struct_pack(d:=o_orderdate, k:=o_orderkey)) AS p
      FROM orders WHERE o_orderstatus='F' GROUP BY 1)
    SELECT c_custkey, coalesce(p, c_mktsegment) AS value FROM customer LEFT JOIN n ON c_custkey=o_custkey
    UNION ALL SELECT o_custkey, p FROM n WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _(v):
    old = v.table("customer").select("c_custkey", F.col("c_mktsegment").alias("value"))
    new = v.table("orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias("value"),
        F.struct("o_orderdate", "o_orderkey").alias("at"),
    )
    return S.upsert_replace(old, new, ["c_custkey"], "at").select("c_custkey", "value")


@query(
    "upsert_profiles",
    """SELECT organism_id, count(*) AS detection_count, strftime(min(created_at),'%Y-%m-%d') AS first_detected,
      strftime(max(created_at),'%Y-%m-%d') AS last_updated FROM assignments GROUP BY 1""",
    "assignments",
)
def _(v):
    per = v.assignments.groupBy("organism_id", (F.year("created_at") < 1998).alias("old")).agg(
        F.count(F.lit(1)).alias("detection_count"),
        F.min("created_at").alias("first_detected"),
        F.max("created_at").alias("last_updated"),
        F.max("genus").alias("genus"),
    )
    out = S.upsert_profiles(per.filter("old").drop("old"), per.filter("not old").drop("old"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("organism_id", "detection_count", day("first_detected"), day("last_updated"))


@query(
    "store_statistics",
    f"""WITH {PROFILES}, {DATED}, m AS (SELECT max(created_at) AS t FROM dated)
    SELECT 'total_organisms' AS statistic, '' AS item, count(*) AS n FROM profiles UNION ALL
    SELECT 'total_datasets', '', count(*) FROM datasets UNION ALL SELECT 'total_reports', '', count(*) FROM dated UNION ALL
    SELECT 'total_comparisons', '', count(*) FROM similarity_log UNION ALL
    SELECT 'novel_organisms', '', count(*) FROM profiles WHERE is_novel_candidate UNION ALL
    SELECT 'reports_last_7_days', '', count(*) FROM dated WHERE created_at >= TIMESTAMP '2001-06-01' - INTERVAL 7 DAY UNION ALL
    FROM (SELECT 'top_kingdom', kingdom, count(*) FROM profiles WHERE kingdom IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""",
    "assignments datasets similarity_log",
)
def _(v):
    now = F.lit("2001-06-01").cast("timestamp")
    return S.store_statistics(profiles(v), v.datasets, dated_reports(v), v.similarity_log, now)


@query(
    "report_export",
    """SELECT 'Report Metadata' AS "Type", report_id, report_name, NULL::BIGINT AS organism_id FROM reports UNION ALL
    SELECT DISTINCT 'Organism', report_id, NULL, organism_id FROM assignments""",
    "reports assignments",
)
def _(v):
    organisms = v.assignments.select("report_id", "organism_id").distinct()
    return S.report_export(v.reports.select("report_id", "report_name"), organisms)


HIST = """WITH s AS (SELECT min(x) AS lo, (max(x)-min(x))/{b} AS w FROM t)
    SELECT least(floor((x-lo)/w),{b}-1)::BIGINT AS bin, count(*) AS n, round(any_value(lo)+least(floor((x-lo)/w),{b}-1)*any_value(w),6) AS lower
    FROM t, s GROUP BY 1, least(floor((x-lo)/w),{b}-1)"""


@query(
    "confidence_histogram",
    "WITH t AS (SELECT novelty_score*7+confidence AS x FROM assignments), " + HIST.format(b=30)[5:],
    "assignments",
)
def _(v):
    rows = v.assignments.select((F.col("novelty_score") * 7 + F.col("confidence")).alias("x"))
    return rounded(S.histogram(rows, "x", 30).select("bin", "n", "lower"), "lower")


@query(
    "length_histogram",
    "WITH t AS (SELECT length(seq)::DOUBLE AS x FROM reads), " + HIST.format(b=50)[5:],
    "reads",
)
def _(v):
    rows = v.reads.select(F.length("seq").alias("x"))
    return rounded(S.histogram(rows, "x", 50).select("bin", "n", "lower"), "lower")


@query(
    "five_number",
    """SELECT l_suppkey, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice,.25),6) AS q25,
      round(median(l_extendedprice),6) AS median, round(quantile_cont(l_extendedprice,.75),6) AS q75,
      max(l_extendedprice) AS max FROM lineitem GROUP BY 1""",
)
def _(v):
    return rounded(S.five_number(v.table("lineitem"), "l_suppkey", "l_extendedprice"), "q25", "median", "q75")


@query(
    "run_counters",
    """SELECT count(*) AS total_sequences, count(DISTINCT l_linenumber) FILTER (l_linenumber<>1) AS clusters,
      count(*) FILTER (l_linenumber=1) AS noise, count(DISTINCT p_name) AS distinct_labels,
      count(*) FILTER (l_returnflag='R') AS novel_candidates FROM lineitem JOIN part ON l_partkey=p_partkey""",
)
def _(v):
    cluster = F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_linenumber"))
    return S.run_counters(
        v.lines.select(
            cluster.alias("cluster"), F.col("p_name").alias("label"), (F.col("l_returnflag") == "R").alias("is_novel")
        )
    )


def tagged(v):
    tags = v.table("events").filter("value > 60").select(
        F.col("event_type").alias("dataset"), F.concat(F.lit("run"), "user_id").alias("run_id")
    ).distinct().withColumn("version", F.lit("v2"))
    return S.tag_runs(runs(v), tags, "v1")


TAGGED = RUNS + """, tagged AS (SELECT dataset, run_id, CASE WHEN EXISTS (FROM events WHERE value>60 AND
    event_type=dataset AND 'run' || user_id=run_id) THEN 'v2' ELSE 'v1' END AS version FROM runs)"""


@query("tag_runs", f"WITH {TAGGED} SELECT dataset, run_id, version FROM tagged")
def _(v):
    return tagged(v).select("dataset", "run_id", "version")


@query(
    "version_counts",
    f"WITH {TAGGED} SELECT version, count(*) AS runs, count(DISTINCT dataset) AS datasets FROM tagged GROUP BY 1",
)
def _(v):
    return S.version_counts(tagged(v))


@query(
    "compare_versions",
    f"""WITH {TAGGED} SELECT dataset, count(*) FILTER (version='v1') AS runs_1, count(*) FILTER (version='v2') AS runs_2,
      count(*) FILTER (version='v1')>0 AND count(*) FILTER (version='v2')>0 AS common FROM tagged GROUP BY 1""",
)
def _(v):
    return S.compare_versions(tagged(v), "v1", "v2")


@query(
    "compact_store",
    """SELECT count(*) AS old_rows, count(*) AS new_rows, true AS verified FROM vectors""",
    "vectors",
)
def _(v):
    return S.compact_store(v.vectors, scratch(v, "compact"), 4)


@query(
    "report_json_fields",
    """SELECT event_id, json_extract(props,'$.k')::BIGINT AS k, json_extract(props,'$.absent')::VARCHAR AS absent FROM events""",
)
def _(v):
    parsed = F.from_json("props", "k bigint, absent string")
    return v.table("events").select("event_id", parsed["k"].alias("k"), parsed["absent"].alias("absent"))


@query(
    "novelty_trends",
    """SELECT created_at::DATE AS day, count(DISTINCT organism_id) FILTER (is_novel_candidate) AS novel_candidates,
      count(DISTINCT organism_id) AS total_organisms,
      round(avg(novelty_score) FILTER (is_novel_candidate),6) AS avg_novelty_score,
      round(count(DISTINCT organism_id) FILTER (is_novel_candidate)*100.0::DOUBLE/count(DISTINCT organism_id),6)
        AS novelty_percentage FROM assignments WHERE created_at>='1995-01-01' GROUP BY 1""",
    "assignments",
)
def _(v):
    out = T.novelty_trends(v.assignments, "1995-01-01")
    return rounded(out, "avg_novelty_score", "novelty_percentage")


@query(
    "novelty_validation",
    """SELECT validation_status, count(*) AS n FROM assignments WHERE is_novel_candidate AND created_at>='1995-01-01' GROUP BY 1""",
    "assignments",
)
def _(v):
    return T.novelty_validation(v.assignments, "1995-01-01")


@query(
    "top_novel",
    """SELECT organism_id, round(avg(novelty_score),6) AS avg_novelty_score, count(*) AS detection_count FROM assignments
    WHERE is_novel_candidate AND created_at>='1995-01-01' GROUP BY 1
    ORDER BY round(avg(novelty_score),9) DESC, count(*) DESC, organism_id LIMIT 10""",
    "assignments",
)
def _(v):
    return rounded(T.top_novel(v.assignments, "1995-01-01"), "avg_novelty_score")


@query(
    "similarity_trends",
    """SELECT created_at::DATE AS day, round(avg(overall),6) AS avg_similarity, count(*) AS comparison_count,
      round(min(overall),8) AS min_similarity, round(max(overall),8) AS max_similarity
    FROM similarity_log WHERE created_at>='1996-01-01' GROUP BY 1""",
    "similarity_log",
)
def _(v):
    out = T.similarity_trends(v.similarity_log, "1996-01-01")
    return rounded(rounded(out, "avg_similarity"), "min_similarity", "max_similarity", digits=8)


@query(
    "similarity_overall",
    """SELECT round(avg(a),6) AS average_similarity, round(stddev_pop(a),6) AS similarity_std,
      sum(n)::BIGINT AS total_comparisons FROM (SELECT avg(overall) AS a, count(*) AS n FROM similarity_log
      WHERE created_at>='1996-01-01' GROUP BY created_at::DATE)""",
    "similarity_log",
)
def _(v):
    return rounded(T.similarity_overall(v.similarity_log, "1996-01-01"), "average_similarity", "similarity_std")


def trend_sql(t, y):
    """Trend written with explicitly scaled time."""
    return f"""CASE WHEN count({y})<2 OR min({t})=max({t}) THEN 'insufficient_data' WHEN abs(regr_slope({y},{t}))<0.01 THEN 'stable'
      WHEN regr_slope({y},{t})>0 THEN 'increasing' ELSE 'decreasing' END"""


@query(
    "value_trend",
    f"""WITH x AS (SELECT user_id, value, (epoch(ts)-min(epoch(ts)) OVER (PARTITION BY user_id))/
        nullif(max(epoch(ts)) OVER (PARTITION BY user_id)-min(epoch(ts)) OVER (PARTITION BY user_id),0) AS t FROM events)
    SELECT user_id, round(coalesce(regr_slope(value,t),0),5) AS slope, round(coalesce(corr(value,t),0),6) AS correlation,
      round(coalesce(corr(value,t)*corr(value,t),0),6) AS r_squared, {trend_sql('t', 'value')} AS trend FROM x GROUP BY 1""",
)
def _(v):
    out = T.trend(v.table("events"), "user_id", "ts", "value")
    return rounded(rounded(out, "correlation", "r_squared"), "slope", digits=5)


TIMELINE = """tl AS (SELECT organism_id, report_id, max(created_at) AS analysis_date, count(*) AS sequence_count,
      max_by(confidence, struct_pack(s := sequence_id, c := confidence, n := novelty_score, i := is_novel_candidate)) AS confidence,
      max_by(novelty_score, struct_pack(s := sequence_id, c := confidence, n := novelty_score, i := is_novel_candidate)) AS novelty_score,
      max_by(is_novel_candidate, struct_pack(s := sequence_id, c := confidence, n := novelty_score, i := is_novel_candidate)) AS is_novel_candidate, any_value(report_name) AS report_name,
      any_value(dataset_name) AS dataset_name, any_value(depth_meters) AS depth_meters
    FROM assignments JOIN reports USING (report_id) JOIN datasets USING (dataset_id) GROUP BY 1, 2)"""


@query(
    "organism_timeline",
    f"""WITH {TIMELINE} SELECT organism_id, report_id, report_name, dataset_name, depth_meters,
      strftime(analysis_date,'%Y-%m-%d') AS analysis_date, sequence_count, round(confidence,6) AS confidence,
      novelty_score, is_novel_candidate FROM tl""",
    "assignments reports datasets",
)
def _(v):
    out = T.organism_timeline(v.assignments, v.reports, v.datasets)
    return rounded(out, "confidence").withColumn("analysis_date", F.date_format("analysis_date", "yyyy-MM-dd"))


@query(
    "timeline_summary",
    f"""WITH {TIMELINE}, x AS (SELECT *, epoch(analysis_date) AS e FROM tl),
      y AS (SELECT *, (e-min(e) OVER w)/nullif(max(e) OVER w-min(e) OVER w,0) AS t FROM x WINDOW w AS (PARTITION BY organism_id)),
      p AS (SELECT organism_id, dataset_name, count(*) AS n, row_number() OVER (PARTITION BY organism_id ORDER BY count(*) DESC,
        dataset_name) AS r FROM tl GROUP BY 1, 2)
    SELECT organism_id, count(*) AS detection_count, strftime(min(analysis_date),'%Y-%m-%d') AS first_detection,
      strftime(max(analysis_date),'%Y-%m-%d') AS last_detection, min(depth_meters) AS min_depth, max(depth_meters) AS max_depth,
      round(avg(depth_meters),6) AS mean_depth, max(depth_meters)-min(depth_meters) AS depth_range,
      {trend_sql('t', 'confidence')} AS confidence_trend, round(coalesce(regr_slope(confidence,t),0),6)+0.0 AS confidence_slope,
      any_value(p.dataset_name) AS most_common_location, any_value(n) AS location_detections
    FROM y JOIN p USING (organism_id) WHERE r=1 GROUP BY 1""",
    "assignments reports datasets",
)
def _(v):
    out = T.timeline_summary(T.organism_timeline(v.assignments, v.reports, v.datasets))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select(
        "organism_id", "detection_count", day("first_detection"), day("last_detection"), "min_depth", "max_depth",
        rnd("mean_depth").alias("mean_depth"), "depth_range", "confidence_trend",
        rnd("confidence_slope").alias("confidence_slope"), "most_common_location", "location_detections",
    )


RANKS = ["kingdom", "phylum", "genus", "species"]


@query(
    "taxonomic_distribution",
    """SELECT kingdom, phylum, genus, species, count(DISTINCT organism_id) AS organism_count, count(*) AS sequence_count,
      round(avg(confidence),6) AS avg_confidence FROM assignments GROUP BY 1,2,3,4""",
    "assignments",
)
def _(v):
    return rounded(T.taxonomic_distribution(v.assignments, RANKS), "avg_confidence")


@query(
    "taxonomic_rollup",
    """WITH d AS (SELECT kingdom, phylum, genus, species, count(DISTINCT organism_id) AS c FROM assignments GROUP BY 1,2,3,4),
      l AS (SELECT 'kingdom' AS rank, kingdom AS t, sum(c)::BIGINT AS n FROM d GROUP BY 2 UNION ALL SELECT 'phylum', phylum, sum(c) FROM d GROUP BY 2
        UNION ALL SELECT 'genus', genus, sum(c) FROM d GROUP BY 2),
      p AS (SELECT *, n*1.0::DOUBLE/sum(n) OVER (PARTITION BY rank) AS p FROM l WHERE t IS NOT NULL)
    SELECT rank, round(-sum(p*ln(p)),6)+0.0 AS shannon, round(1-sum(p*p),6)+0.0 AS simpson,
      round(CASE WHEN count(*)>1 THEN -sum(p*ln(p))/ln(count(*)) ELSE 0 END,6)+0.0 AS evenness, count(*) AS richness,
      sum(n)::BIGINT AS abundance FROM p GROUP BY 1""",
    "assignments",
)
def _(v):
    d = T.taxonomic_distribution(v.assignments, RANKS)
    return rounded(T.rank_rollup(d, ["kingdom", "phylum", "genus"]), "shannon", "simpson", "evenness")


@query(
    "unassigned_shares",
    """SELECT count(*) AS total_sequences, count(*) FILTER (kingdom IS NULL) AS no_kingdom,
      round(count(*) FILTER (kingdom IS NULL)*100.0::DOUBLE/count(*),6) AS unknown_kingdom_pct,
      count(*) FILTER (species IS NULL) AS no_species, round(count(*) FILTER (species IS NULL)*100.0::DOUBLE/count(*),6)
      AS unknown_species_pct FROM assignments""",
    "assignments",
)
def _(v):
    return rounded(T.unassigned(v.assignments, ["kingdom", "species"]), "unknown_kingdom_pct", "unknown_species_pct")


PAIRS = """pairs AS (SELECT lag(report_id) OVER (PARTITION BY dataset_id ORDER BY report_id) AS report_id_1,
      report_id AS report_id_2 FROM reports QUALIFY report_id_1 IS NOT NULL)"""
ALL_PAIRS = """r AS (SELECT DISTINCT report_id FROM assignments),
    pairs AS (SELECT x.report_id AS report_id_1, y.report_id AS report_id_2 FROM r x JOIN r y ON x.report_id<y.report_id)"""
COMPARE = """c AS (SELECT report_id, organism_id, count(*) AS n FROM assignments GROUP BY 1,2),
    p AS (SELECT *, n*1.0::DOUBLE/sum(n) OVER (PARTITION BY report_id) AS p FROM c),
    h AS (SELECT report_id, -sum(p*ln(p)) AS h, 1-sum(p*p) AS d, count(*) AS s FROM p GROUP BY 1),
    b AS (SELECT report_id_1, report_id_2, count(*) AS shared FROM pairs JOIN c x ON x.report_id=report_id_1
      JOIN c y ON y.report_id=report_id_2 AND x.organism_id=y.organism_id GROUP BY 1,2)
    SELECT report_id_1, report_id_2, coalesce(shared,0) AS shared, a.s AS size_1, z.s AS size_2,
      a.s-coalesce(shared,0) AS only_1, z.s-coalesce(shared,0) AS only_2, a.s+z.s-coalesce(shared,0) AS total,
      round(coalesce(shared,0)*1.0::DOUBLE/(a.s+z.s-coalesce(shared,0)),6) AS jaccard,
      round(coalesce(shared,0)*1.0::DOUBLE/least(a.s,z.s),6) AS overlap_coefficient,
      round(coalesce(shared,0)*2.0::DOUBLE/(a.s+z.s),6) AS dice,
      round(coalesce(shared,0)*100.0::DOUBLE/greatest(a.s,z.s),6) AS overlap_percentage,
      round(abs(a.h-z.h),6) AS shannon_diff, round(abs(a.d-z.d),6) AS simpson_diff, abs(a.s-z.s) AS richness_diff
    FROM pairs LEFT JOIN b USING (report_id_1, report_id_2) JOIN h a ON a.report_id=report_id_1 JOIN h z ON z.report_id=report_id_2"""
COMPARE_ROUND = ["jaccard", "overlap_coefficient", "dice", "overlap_percentage", "shannon_diff", "simpson_diff"]


@query("compare_reports", f"WITH {PAIRS}, {COMPARE}", "assignments reports")
def _(v):
    return rounded(T.compare_reports(v.assignments, T.successive_pairs(v.reports)), *COMPARE_ROUND)


@query("batch_compare", f"WITH {ALL_PAIRS}, {COMPARE}", "assignments")
def _(v):
    return rounded(T.compare_all_reports(v.assignments), *COMPARE_ROUND)


@query(
    "report_comparison_detail",
    f"""WITH {PAIRS}, c AS (SELECT report_id, organism_id, count(*) AS n, bool_or(is_novel_candidate) AS nv,
        arg_max_null(species, sequence_id) AS sp
        FROM assignments GROUP BY 1,2),
      o AS (SELECT report_id_1, report_id_2, organism_id FROM pairs JOIN c ON report_id=report_id_1 UNION
        SELECT report_id_1, report_id_2, organism_id FROM pairs JOIN c ON report_id=report_id_2)
    SELECT report_id_1, report_id_2, o.organism_id, x.n IS NOT NULL AS in_1, y.n IS NOT NULL AS in_2, coalesce(x.n,0) AS abundance_1,
      coalesce(y.n,0) AS abundance_2, round(CASE WHEN x.n>0 THEN coalesce(y.n,0)*1.0::DOUBLE/x.n END,6) AS abundance_ratio,
      coalesce(x.nv<>y.nv,false) AS novelty_changed, CASE WHEN x.n>0 AND y.n>0 THEN x.sp IS NOT DISTINCT FROM y.sp END AS taxonomy_agrees
    FROM o LEFT JOIN c x ON x.report_id=report_id_1 AND x.organism_id=o.organism_id
      LEFT JOIN c y ON y.report_id=report_id_2 AND y.organism_id=o.organism_id""",
    "assignments reports",
)
def _(v):
    out = T.report_comparison_detail(v.assignments, T.successive_pairs(v.reports))
    return rounded(out, "abundance_ratio")
