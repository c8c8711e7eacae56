"""Queries over the report store: search, listing, lookups, upserts, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.mathx import all_of, any_of
from estuarine.operators.ordered import exact_quantiles


def contains_text(columns: list[str], query: str) -> Column:
    """Case-insensitive LIKE '%query%' on any of the columns."""
    return any_of([F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def search_organisms(
    profiles: DataFrame,
    query: str = "",
    equal: dict[str, object] | None = None,
    min_confidence: float | None = None,
    limit: int = 100,
) -> DataFrame:
    """Text and attribute search, most detected first."""
    tests = []
    if query:
        tests.append(contains_text(["organism_name", "taxonomic_lineage", "genus", "species"], query))
    tests += [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    found = profiles.filter(all_of(tests)) if tests else profiles
    order = [F.desc("detection_count"), F.desc("confidence"), F.asc("organism_id")]
    return found.orderBy(*order).limit(limit)


def list_reports(
    reports: DataFrame,
    dataset_id: object | None = None,
    start: str | None = None,
    end: str | None = None,
    report_type: str | None = None,
    offset: int = 0,
    limit: int = 50,
) -> DataFrame:
    """Newest reports first, filtered and paged."""
    tests = []
    if dataset_id is not None:
        tests.append(F.col("dataset_id") == dataset_id)
    if start is not None:
        tests.append(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("created_at") <= F.lit(end).cast("timestamp"))
    if report_type is not None:
        tests.append(F.col("report_type") == report_type)
    found = reports.filter(all_of(tests)) if tests else reports
    return found.orderBy(F.desc("created_at"), F.asc("report_id")).offset(offset).limit(limit)


def search_reports(reports: DataFrame, query: str, fields: list[str], limit: int = 50) -> DataFrame:
    found = reports.filter(contains_text(fields, query))
    return found.orderBy(F.desc("created_at"), F.asc("report_id")).limit(limit)


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the key frame."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def search_runs(runs: DataFrame, query: str = "", dataset: str | None = None) -> DataFrame:
    """Runs whose dataset or id contains the text."""
    q = query.lower()
    hit = F.lower(F.col("dataset")).contains(q) | F.lower(F.col("run_id")).contains(q)
    found = runs.filter(hit)
    return found.filter(F.col("dataset") == dataset) if dataset else found


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("modified"), "dataset", "run_id").limit(n)


# Studies are kept from this many spots.
MIN_SPOTS = 1_000_000


def filter_studies(
    studies: DataFrame,
    keywords: list[str],
    min_spots: int = MIN_SPOTS,
    max_spots: int | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Studies with a keyword in the title and enough spots."""
    title = F.lower("title")
    test = any_of([title.contains(k.lower()) for k in keywords]) & (F.col("spots") >= min_spots)
    if max_spots is not None:
        test = test & (F.col("spots") <= max_spots)
    if exclude:
        test = test & ~any_of([title.contains(k.lower()) for k in exclude])
    return studies.filter(test)


# Name cleaning patterns, fallback and length.
RESERVED_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
UNNAMED = "unnamed_dataset"


def clean_name(name: Column, length: int | None = None) -> Column:
    """File-safe name: reserved characters and runs of blanks become one underscore.

    `length` cuts the name, where a file system asks for it; then names may collide.
    """
    text = F.regexp_replace(F.coalesce(name, F.lit("")), RESERVED_CHARS, "_")
    text = F.regexp_replace(F.regexp_replace(text, r"[_\s]+", "_"), "^_+|_+$", "")
    named = F.when(text == "", UNNAMED).otherwise(text)
    return F.left(named, F.lit(length)) if length else named


def report_organisms(seqs: DataFrame, profiles: DataFrame, reports: DataFrame) -> DataFrame:
    """Distinct organisms of the wanted reports with their profile."""
    wanted = seqs.join(reports.select("report_id").distinct(), "report_id", "left_semi")
    return wanted.select("report_id", "organism_id").distinct().join(profiles, "organism_id")


def co_occurring(
    seqs: DataFrame, profiles: DataFrame, organism_id: object, min_count: int = 2
) -> DataFrame:
    """Organisms in the reports of one organism, by number of their sequences there."""
    with_it = seqs.filter(F.col("organism_id") == organism_id).select("report_id").distinct()
    counts = (
        seqs.filter(F.col("organism_id") != organism_id)
        .join(with_it, "report_id", "left_semi")
        .groupBy("organism_id")
        .agg(F.count(F.lit(1)).alias("co_occurrence_count"))
        .filter(F.col("co_occurrence_count") >= min_count)
    )
    return counts.join(profiles, "organism_id")


def detection_history(seqs: DataFrame, reports: DataFrame, datasets: DataFrame, organism_id: object) -> DataFrame:
    """Detections of one organism with report and dataset."""
    rows = seqs.filter(F.col("organism_id") == organism_id)
    return (
        rows.join(reports, "report_id")
        .join(datasets.select("dataset_id", "dataset_name"), "dataset_id")
        .orderBy(F.desc("created_at"), F.asc("sequence_id"))
    )


def find_similar_reports(sim: DataFrame, report_id: object, threshold: float, k: int) -> DataFrame:
    """Best stored similarities of one report, whichever side of the pair it is on."""
    other = F.when(F.col("report_id_1") == report_id, F.col("report_id_2")).otherwise(F.col("report_id_1"))
    rows = sim.filter(
        ((F.col("report_id_1") == report_id) | (F.col("report_id_2") == report_id))
        & (F.col("overall") >= threshold)
    )
    return (
        rows.select(other.alias("other_report_id"), "overall", "pair_id")
        .orderBy(F.desc("overall"), F.asc("pair_id"))
        .limit(k)
    )


def integrity_checks(tables: dict[str, DataFrame], keys: dict[str, str], id_pattern: str) -> DataFrame:
    """Per table: rows, duplicate keys and ids that miss the pattern."""
    parts = []
    for name, df in sorted(tables.items()):
        key = keys[name]
        # one row per key first, so the check is a map-side combined count
        per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.count_if(F.col("n") > 1).alias("duplicate_keys"),
                F.count_if(~F.col("k").cast("string").rlike(id_pattern)).alias("bad_ids"),
            ).select(F.lit(name).alias("table_name"), "rows", "duplicate_keys", "bad_ids")
        )
    return reduce(DataFrame.unionByName, parts)


def upsert_replace(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last write wins: the newest row per key of the incoming rows replaces stored ones."""
    rest = [c for c in new.columns if c not in key]
    latest = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    latest = latest.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
    kept = old.join(latest.select(*key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def upsert_profiles(old: DataFrame, new: DataFrame, key: str = "organism_id") -> DataFrame:
    """Merge detections into profiles.

    Counts add up, the first detection is kept, attributes follow the latest row.
    """
    special = {key, "detection_count", "first_detected", "last_updated"}
    rest = [c for c in old.columns if c not in special]
    both = old.unionByName(new)
    merged = both.groupBy(key).agg(
        F.sum("detection_count").alias("detection_count"),
        F.min("first_detected").alias("first_detected"),
        F.max("last_updated").alias("last_updated"),
        F.max_by(F.struct(*rest), F.col("last_updated")).alias("r"),
    )
    return merged.select(
        key, "detection_count", "first_detected", "last_updated", *[F.col(f"r.{c}").alias(c) for c in rest]
    )


def store_statistics(
    profiles: DataFrame, datasets: DataFrame, reports: DataFrame, sim: DataFrame, now: Column
) -> DataFrame:
    """(statistic, item, n): table sizes, novel organisms, reports of the last 7 days, top kingdoms."""
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("statistic"), F.lit("").alias("item"), "n"
    )
    recent = reports.filter(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS"))
    kingdoms = (
        profiles.filter(F.col("kingdom").isNotNull())
        .groupBy(F.col("kingdom").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("item"))
        .limit(5)
        .select(F.lit("top_kingdom").alias("statistic"), "item", "n")
    )
    parts = [
        size(profiles, "total_organisms"),
        size(datasets, "total_datasets"),
        size(reports, "total_reports"),
        size(sim, "total_comparisons"),
        size(profiles.filter("is_novel_candidate"), "novel_organisms"),
        size(recent, "reports_last_7_days"),
        kingdoms,
    ]
    return reduce(DataFrame.unionByName, parts)


def report_export(report: DataFrame, organisms: DataFrame) -> DataFrame:
    """Metadata rows and organism rows in one wide table, told apart by `Type`."""
    a = report.withColumn("Type", F.lit("Report Metadata"))
    b = organisms.withColumn("Type", F.lit("Organism"))
    return a.unionByName(b, allowMissingColumns=True)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins over the full range; the last bin is closed."""
    rows = df.select(F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    span = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counted = rows.join(F.broadcast(span)).groupBy(b.cast("long").alias("bin")).agg(  # one row
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")
    )
    return counted.select(
        "bin",
        "n",
        (F.col("lo") + F.col("bin") * width).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
    )


def five_number(df: DataFrame, by: str, value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    probs = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}
    return exact_quantiles(df.select(by, value), [by], value, probs)


def run_counters(assign: DataFrame) -> DataFrame:
    """Summary counts of one run: sequences, clusters without noise, labels, novel ones."""
    return assign.agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"),
        F.count_if(F.col("cluster") == -1).alias("noise"),
        F.countDistinct("label").alias("distinct_labels"),
        F.count_if("is_novel").alias("novel_candidates"),
    )


def version_counts(runs: DataFrame) -> DataFrame:
    """Runs and datasets per embedding version."""
    return runs.groupBy(F.coalesce("version", F.lit("untagged")).alias("version")).agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("dataset").alias("datasets")
    )


def tag_runs(runs: DataFrame, tags: DataFrame, version: str) -> DataFrame:
    """Known tags stay; runs without one get `version`."""
    return runs.join(tags, ["dataset", "run_id"], "left").withColumn(
        "version", F.coalesce("version", F.lit(version))
    )


def compare_versions(runs: DataFrame, v1: str, v2: str) -> DataFrame:
    """Runs per dataset under two versions, and whether both have the dataset."""
    sides = runs.filter(F.col("version").isin(v1, v2)).groupBy("dataset").agg(
        F.count_if(F.col("version") == v1).alias("runs_1"),
        F.count_if(F.col("version") == v2).alias("runs_2"),
    )
    return sides.withColumn("common", (F.col("runs_1") > 0) & (F.col("runs_2") > 0))


def compact_store(df: DataFrame, path: str, files: int, older_than: Column | None = None) -> DataFrame:
    """Rewrite vectors as few compressed files; returns old and new fingerprints.

    The caller swaps the paths only when `verified` holds.
    """
    chosen = df.filter(older_than) if older_than is not None else df
    chosen.repartition(files).write.option("compression", "zstd").parquet(path)
    copied = df.sparkSession.read.schema(chosen.schema).parquet(path)

    def print_of(d: DataFrame, side: str) -> DataFrame:
        h = F.xxhash64(*[F.col(c) for c in sorted(d.columns)])
        return d.agg(
            F.count(F.lit(1)).alias(f"{side}_rows"), F.sum(h.cast("decimal(20,0)")).alias(f"{side}_print")
        )

    both = print_of(chosen, "old").join(F.broadcast(print_of(copied, "new")))  # one row each
    return both.select(
        "old_rows",
        "new_rows",
        (
            (F.col("old_rows") == F.col("new_rows"))
            & F.col("old_print").eqNullSafe(F.col("new_print"))
        ).alias("verified"),
    )
