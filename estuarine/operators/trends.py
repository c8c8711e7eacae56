"""Trends over time and comparisons between reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.mathx import first_match, ratio
from estuarine.operators.diversity import basic_diversity
from estuarine.operators.ordered import ranked, top_per_group
from estuarine.operators.reportgrid import all_pairs
from estuarine.session import materialize


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def trend_columns(ts: str, value: str, flat: float = 0.01) -> dict[str, Column]:
    """Slope over time scaled to [0, 1], correlation and label, as aggregates.

    Scaling time only multiplies the slope by the time span, so no window is needed.
    """
    t, y = _seconds(ts), F.col(value).cast("double")
    t = F.when(y.isNotNull(), t)
    slope = F.regr_slope(y, t) * (F.max(t) - F.min(t))
    r = F.corr(y, t)
    few = (F.count(y) < 2) | slope.isNull()
    return {
        "slope": F.when(few, 0.0).otherwise(slope),
        "correlation": F.coalesce(r, F.lit(0.0)),
        "r_squared": F.coalesce(r * r, F.lit(0.0)),
        "trend": first_match(
            [(few, "insufficient_data"), (F.abs(slope) < flat, "stable"), (slope > 0, "increasing")],
            "decreasing",
        ),
    }


def trend(df: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Linear trend of a value per group."""
    return df.groupBy(by).agg(*[c.alias(n) for n, c in trend_columns(ts, value).items()])


def novelty_trends(seqs: DataFrame, since: str) -> DataFrame:
    """Per day: distinct novel and all organisms, share, mean score of novel sequences.

    Organisms are reduced to one row per day first, which replaces two distinct counts.
    """
    novel = F.col("is_novel_candidate")
    per = (
        seqs.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
        .groupBy(F.to_date("created_at").alias("day"), "organism_id")
        .agg(
            F.max(novel.cast("int")).alias("nv"),
            F.sum(F.when(novel, F.col("novelty_score"))).alias("score"),
            F.count_if(novel).alias("hits"),
        )
    )
    out = per.groupBy("day").agg(
        F.sum("nv").alias("novel_candidates"),
        F.count(F.lit(1)).alias("total_organisms"),
        ratio(F.sum("score"), F.sum("hits")).alias("avg_novelty_score"),
    )
    return out.withColumn("novelty_percentage", F.col("novel_candidates") * 100.0 / F.col("total_organisms"))


def novelty_validation(seqs: DataFrame, since: str) -> DataFrame:
    """Novel detections by validation status."""
    rows = seqs.filter(F.col("is_novel_candidate") & (F.col("created_at") >= F.lit(since).cast("timestamp")))
    return rows.groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"))


def top_novel(seqs: DataFrame, since: str, n: int = 10) -> DataFrame:
    """Organisms of highest mean novelty."""
    rows = seqs.filter(F.col("is_novel_candidate") & (F.col("created_at") >= F.lit(since).cast("timestamp")))
    score = F.round(F.avg("novelty_score"), 9)
    return (
        rows.groupBy("organism_id")
        .agg(score.alias("avg_novelty_score"), F.count(F.lit(1)).alias("detection_count"))
        .orderBy(F.desc("avg_novelty_score"), F.desc("detection_count"), F.asc("organism_id"))
        .limit(n)
    )


def similarity_trends(sim: DataFrame, since: str) -> DataFrame:
    """Similarity per day."""
    rows = sim.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(
        F.avg("overall").alias("avg_similarity"),
        F.count(F.lit(1)).alias("comparison_count"),
        F.min("overall").alias("min_similarity"),
        F.max("overall").alias("max_similarity"),
    )


def similarity_overall(sim: DataFrame, since: str) -> DataFrame:
    """Mean and deviation of the daily means."""
    return similarity_trends(sim, since).agg(
        F.avg("avg_similarity").alias("average_similarity"),
        F.stddev_pop("avg_similarity").alias("similarity_std"),
        F.sum("comparison_count").alias("total_comparisons"),
    )


def organism_timeline(seqs: DataFrame, reports: DataFrame, datasets: DataFrame) -> DataFrame:
    """Detections per (organism, report); single values come from the last sequence id."""
    per = seqs.groupBy("organism_id", "report_id").agg(
        F.max("created_at").alias("analysis_date"),
        F.count(F.lit(1)).alias("sequence_count"),
        F.max(F.struct("sequence_id", "confidence", "novelty_score", "is_novel_candidate")).alias("r"),
    )
    return (
        per.join(reports, "report_id")
        .join(datasets.select("dataset_id", "dataset_name", "depth_meters"), "dataset_id")
        .select(
            "organism_id",
            "report_id",
            "report_name",
            "dataset_name",
            "depth_meters",
            "analysis_date",
            "sequence_count",
            "r.confidence",
            "r.novelty_score",
            "r.is_novel_candidate",
        )
    )


def timeline_summary(timeline: DataFrame) -> DataFrame:
    """First and last detection, main location, depth spread and two trends per organism."""
    key = "organism_id"
    conf = trend_columns("analysis_date", "confidence")
    nov = trend_columns("analysis_date", "novelty_score")
    base = timeline.groupBy(key).agg(
        F.count(F.lit(1)).alias("detection_count"),
        F.min("analysis_date").alias("first_detection"),
        F.max("analysis_date").alias("last_detection"),
        F.min("depth_meters").alias("min_depth"),
        F.max("depth_meters").alias("max_depth"),
        F.avg("depth_meters").alias("mean_depth"),
        (F.max("depth_meters") - F.min("depth_meters")).alias("depth_range"),
        conf["trend"].alias("confidence_trend"),
        conf["slope"].alias("confidence_slope"),
        nov["trend"].alias("novelty_trend"),
        nov["slope"].alias("novelty_slope"),
    )
    places = timeline.groupBy(key, F.col("dataset_name").alias("most_common_location")).agg(
        F.count(F.lit(1)).alias("location_detections")
    )
    top = top_per_group(places, [key], [F.desc("location_detections"), F.asc("most_common_location")], 1)
    return base.join(top, key)


def taxonomic_distribution(seqs: DataFrame, ranks: list[str]) -> DataFrame:
    """Organisms, sequences and mean confidence per lineage."""
    per = seqs.groupBy(*ranks, "organism_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c")
    )
    return per.groupBy(*ranks).agg(
        F.count(F.lit(1)).alias("organism_count"),
        F.sum("n").alias("sequence_count"),
        (F.sum("c") / F.sum("n")).alias("avg_confidence"),
    )


def rank_rollup(distribution: DataFrame, ranks: list[str]) -> DataFrame:
    """Diversity per rank over the lineage counts, each lineage weighing its organisms."""
    long = distribution.unpivot(["organism_count"], ranks, "rank", "taxon").filter(F.col("taxon").isNotNull())
    counts = long.groupBy("rank", "taxon").agg(F.sum("organism_count").alias("n"))
    return basic_diversity(counts, "rank")


def unassigned(seqs: DataFrame, ranks: list[str]) -> DataFrame:
    """Sequences without a name at each rank, with percentages."""
    total = F.count(F.lit(1))
    cols = []
    for r in ranks:
        missing = F.count_if(F.col(r).isNull())
        cols += [missing.alias(f"no_{r}"), (missing * 100.0 / total).alias(f"unknown_{r}_pct")]
    return seqs.agg(total.alias("total_sequences"), *cols)


def successive_pairs(reports: DataFrame, group: str = "dataset_id", key: str = "report_id") -> DataFrame:
    """Each report with the next one of its dataset: linear in the reports."""
    placed = ranked(reports.select(group, key), [group], [F.col(key)], "i")
    after = placed.select(group, F.col(key).alias("report_id_2"), (F.col("i") - 1).alias("i"))
    return placed.withColumnRenamed(key, "report_id_1").join(after, [group, "i"]).select(
        "report_id_1", "report_id_2"
    )


def listed_pairs(spark, report_ids: list, limit: int = 1000) -> DataFrame:
    """All pairs i < j of an explicit, bounded list of reports."""
    ids = sorted(set(report_ids))
    if len(ids) > limit:
        raise ValueError(f"at most {limit} reports can be compared pairwise")
    return spark.createDataFrame(list(combinations(ids, 2)), "report_id_1 long, report_id_2 long")


def pair_counts(counts: DataFrame, pairs: DataFrame, key: str, item: str, n: str = "n") -> DataFrame:
    """(pair, item, n1, n2) for the wanted pairs; an item counts 0 where absent.

    Both sides are tagged and added up in one aggregation, which acts as the full
    outer join and is keyed by (pair, item), so a hot report is spread.
    """
    a, b = f"{key}_1", f"{key}_2"
    left = pairs.select(a, b, F.col(a).alias(key)).join(counts.select(key, item, n), key)
    right = pairs.select(a, b, F.col(b).alias(key)).join(counts.select(key, item, n), key)
    both = left.select(a, b, item, F.col(n).alias("n1"), F.lit(0).cast("long").alias("n2")).unionByName(
        right.select(a, b, item, F.lit(0).cast("long").alias("n1"), F.col(n).alias("n2"))
    )
    return both.groupBy(a, b, item).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))


def set_measures() -> dict[str, Column]:
    """Set overlap of two reports as aggregates over pair counts."""
    one, two = F.col("n1") > 0, F.col("n2") > 0
    return overlap_measures(F.count_if(one & two), F.count_if(one), F.count_if(two))


def overlap_measures(shared: Column, a: Column, b: Column) -> dict[str, Column]:
    """Set overlap of two reports with `a` and `b` items, `shared` of them in both."""
    return {
        "shared": shared,
        "size_1": a,
        "size_2": b,
        "only_1": a - shared,
        "only_2": b - shared,
        "total": a + b - shared,
        "jaccard": ratio(shared, a + b - shared, 0.0),
        "overlap_coefficient": ratio(shared, F.least(a, b), 0.0),
        "dice": ratio(shared * 2, a + b, 0.0),
        "overlap_percentage": ratio(shared * 100, F.greatest(a, b), 0.0),
    }


def organism_counts(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("report_id", "organism_id").agg(F.count(F.lit(1)).alias("n"))


def compare_reports(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Organism overlap and diversity differences of report pairs."""
    counts = organism_counts(seqs)
    both = ["report_id_1", "report_id_2"]
    # items of the first report are looked up in the second, so a report in many pairs is never copied to each
    held = pairs.select(*both).distinct().join(counts.select(F.col("report_id").alias("report_id_1"), "organism_id"), "report_id_1")
    other = counts.select(F.col("report_id").alias("report_id_2"), "organism_id")
    overlap = held.join(other.hint("merge"), ["report_id_2", "organism_id"]).groupBy(*both).agg(F.count(F.lit(1)).alias("shared"))
    div = basic_diversity(counts, "report_id")
    side = lambda i: div.select(
        F.col("report_id").alias(f"report_id_{i}"),
        F.col("shannon").alias(f"h{i}"),
        F.col("simpson").alias(f"d{i}"),
        F.col("richness").cast("long").alias(f"s{i}"),
    )
    joined = pairs.select(*both).distinct().join(side(1), "report_id_1").join(side(2), "report_id_2").join(overlap, both, "left")
    return _pair_measures(joined.withColumn("shared", F.coalesce("shared", F.lit(0))))


def _pair_measures(joined: DataFrame) -> DataFrame:
    """Overlap and diversity differences from (report_id_1, report_id_2, shared, s1, s2, h1, h2, d1, d2)."""
    measures = overlap_measures(F.col("shared"), F.col("s1"), F.col("s2"))
    return joined.select(
        "report_id_1",
        "report_id_2",
        *[c.alias(n) for n, c in measures.items()],
        F.abs(F.col("h1") - F.col("h2")).alias("shannon_diff"),
        F.abs(F.col("d1") - F.col("d2")).alias("simpson_diff"),
        F.abs(F.col("s1") - F.col("s2")).alias("richness_diff"),
    )


def compare_all_reports(seqs: DataFrame, **blocks: int) -> DataFrame:
    """Organism overlap and diversity differences of all report pairs, the smaller id first.

    The result has a row for each pair, so it is quadratic in the reports; memory is bounded by the blocks.
    """
    counts = materialize(organism_counts(seqs))
    known = basic_diversity(counts, "report_id").select(
        "report_id", F.col("richness").cast("long").alias("s"), F.col("shannon").alias("h"), F.col("simpson").alias("d")
    )
    return _pair_measures(all_pairs(counts, known, **blocks))


def leading_pairs(counts: DataFrame) -> DataFrame:
    """Every report against the one with the most sequences."""
    totals = counts.groupBy("report_id").agg(F.sum("n").alias("n"))
    lead = totals.agg(F.max_by("report_id", F.struct("n", -F.col("report_id"))).alias("report_id_2"))
    pairs = totals.join(F.broadcast(lead))  # one row
    return pairs.filter(F.col("report_id") != F.col("report_id_2")).select(
        F.col("report_id").alias("report_id_1"), "report_id_2"
    )


def report_comparison_detail(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per organism of a report pair: presence, abundance ratio, novelty change, taxonomy agreement."""
    per = seqs.groupBy("report_id", "organism_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("is_novel_candidate").alias("novel"),
        F.max_by("species", "sequence_id").alias("species"),
    )
    side = lambda i: pairs.join(
        per.select(
            F.col("report_id").alias(f"report_id_{i}"),
            "organism_id",
            F.col("n").alias(f"n{i}"),
            F.col("novel").alias(f"novel_{i}"),
            F.col("species").alias(f"species_{i}"),
        ),
        f"report_id_{i}",
    )
    both = side(1).join(side(2), ["report_id_1", "report_id_2", "organism_id"], "full")
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    in_both = (n1 > 0) & (n2 > 0)
    return both.select(
        "report_id_1",
        "report_id_2",
        "organism_id",
        (n1 > 0).alias("in_1"),
        (n2 > 0).alias("in_2"),
        n1.alias("abundance_1"),
        n2.alias("abundance_2"),
        ratio(n2, n1).alias("abundance_ratio"),
        F.when(in_both, F.col("novel_1") != F.col("novel_2")).otherwise(False).alias("novelty_changed"),
        F.when(in_both, F.col("species_1").eqNullSafe(F.col("species_2"))).alias("taxonomy_agrees"),
    )
