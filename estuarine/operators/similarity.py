"""Similarity of samples and reports over explicit pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estuarine.functions.mathx import ratio
from estuarine.functions.vectors import haversine
from estuarine.operators.diversity import basic_diversity
from estuarine.operators.ranks import present_ranks, rank_counts
from estuarine.operators.trends import organism_counts, pair_counts, set_measures

PAIR = ["report_id_1", "report_id_2"]

# Weight of each rank; they add up to 1.2.
RANK_WEIGHTS = {
    "kingdom": 0.1,
    "phylum": 0.15,
    "class": 0.15,
    "order": 0.15,
    "family": 0.15,
    "genus": 0.2,
    "species": 0.3,
}


def _correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((vx > 0) & (vy > 0), (n * xy - x * y) / F.sqrt(vx * vy)).otherwise(0.0)


def joint_counts(counts: DataFrame, pairs: DataFrame, item: str, keys: list[str] | None = None) -> DataFrame:
    """(pair, n1, n2, f): taxa of a pair's union by their two counts.

    All measures follow from it, and it has no row per taxon.
    """
    return pair_counts(counts, pairs, "report_id", item).groupBy(*PAIR, "n1", "n2").agg(
        F.count(F.lit(1)).alias("f")
    )


def _mean_ranks(joint: DataFrame, side: str) -> DataFrame:
    """Average rank of each count value of one side; the window runs over distinct values."""
    w = Window.partitionBy(*PAIR).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    per = joint.groupBy(*PAIR, side).agg(F.sum("f").alias("k"))
    before = F.coalesce(F.sum("k").over(w), F.lit(0))
    return per.select(*PAIR, side, (before + (F.col("k") + 1) / 2).alias(f"r_{side}"))


def abundance_similarity(counts: DataFrame, pairs: DataFrame, item: str = "taxon") -> DataFrame:
    """Cosine, Pearson, Spearman, Bray-Curtis and Manhattan over the union of taxa.

    `counts` holds (report_id, item, n).
    """
    joint = joint_counts(counts, pairs, item)
    ranks = joint.join(_mean_ranks(joint, "n1"), [*PAIR, "n1"]).join(_mean_ranks(joint, "n2"), [*PAIR, "n2"])
    f, a, b = (F.col(c).cast("double") for c in ("f", "n1", "n2"))
    ra, rb = F.col("r_n1"), F.col("r_n2")
    s = lambda c: F.sum(f * c)
    sums = ranks.groupBy(*PAIR).agg(
        F.sum(f).alias("n"), s(a).alias("a"), s(b).alias("b"), s(a * a).alias("aa"), s(b * b).alias("bb"),
        s(a * b).alias("ab"), s(F.least(a, b)).alias("lo"), s(F.greatest(a, b)).alias("hi"),
        s(ra).alias("ra"), s(rb).alias("rb"), s(ra * ra).alias("raa"), s(rb * rb).alias("rbb"), s(ra * rb).alias("rab"),
    )
    c = F.col
    return sums.select(
        *PAIR,
        c("n").cast("long").alias("taxa"),
        F.when((c("aa") > 0) & (c("bb") > 0), c("ab") / F.sqrt(c("aa") * c("bb"))).otherwise(0.0).alias("cosine"),
        _correlation(c("n"), c("a"), c("b"), c("aa"), c("bb"), c("ab")).alias("pearson"),
        _correlation(c("n"), c("ra"), c("rb"), c("raa"), c("rbb"), c("rab")).alias("spearman"),
        ratio(c("lo") * 2, c("a") + c("b"), 1.0).alias("bray_curtis"),
        (1 - ratio(c("hi") - c("lo"), c("hi"), 0.0)).alias("manhattan"),
    )


def composition_similarity(assign: DataFrame, pairs: DataFrame, by: str = "report_id") -> DataFrame:
    """Cosine per rank and their weighted mean; ranks without names count as 0."""
    ranks = present_ranks(assign)
    counts = rank_counts(assign, by, ranks).select(
        F.col(by).alias("report_id"), F.struct("rank", "taxon").alias("item"), "n"
    )
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    per = (
        pair_counts(counts, pairs, "report_id", "item")
        .groupBy(*PAIR, F.col("item.rank").alias("rank"))
        .agg(F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))
    )
    cos = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")))
    wide = per.withColumn("c", cos).groupBy(*PAIR).agg(
        *[F.coalesce(F.max(F.when(F.col("rank") == r, F.col("c"))), F.lit(0.0)).alias(f"{r}_similarity") for r in ranks]
    )
    total = reduce(
        lambda x, y: x + y, [F.col(f"{r}_similarity") * RANK_WEIGHTS[r] for r in ranks], F.lit(0.0)
    )
    return wide.withColumn("taxonomic_similarity", total / sum(RANK_WEIGHTS.values()))


def relative_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(a, b); 1 when both are zero or missing."""
    x, y = F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))
    top = F.greatest(x, y)
    return F.when(top > 0, 1 - F.abs(x - y) / top).otherwise(1.0)


UNKNOWN = 0.5


def _known(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNKNOWN))


def environment_similarity(env: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Distance, depth, temperature and date similarity; 0.5 where a side is unknown.

    `env` has latitude, longitude, depth_meters, temperature_celsius, collection_date.
    """
    cols = ["latitude", "longitude", "depth_meters", "temperature_celsius", "collection_date"]
    side = lambda i: env.select(F.col(key).alias(f"{key}_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in cols])
    both = pairs.join(side(1), f"{key}_1").join(side(2), f"{key}_2")
    c = lambda name: (F.col(f"{name}_1"), F.col(f"{name}_2"))
    (la1, la2), (lo1, lo2) = c("latitude"), c("longitude")
    d1, d2 = c("depth_meters")
    t1, t2 = c("temperature_celsius")
    km = haversine(la1, lo1, la2, lo2)
    depth = F.when(d1.isNotNull() & d2.isNotNull(), 1 - F.abs(d1 - d2) / F.greatest(d1, d2, F.lit(1.0)))
    temp = F.when(t1.isNotNull() & t2.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(t1 - t2) / 20))
    days = F.abs(F.datediff(*c("collection_date")))
    when = F.when(days.isNotNull(), F.greatest(F.lit(0.0), 1 - days / 365))
    return both.select(
        f"{key}_1",
        f"{key}_2",
        km.alias("distance_km"),
        _known(F.exp(-km / 100)).alias("geographic_similarity"),
        _known(depth).alias("depth_similarity"),
        _known(temp).alias("temperature_similarity"),
        days.alias("days_apart"),
        _known(when).alias("temporal_similarity"),
    )


def diversity_similarity(div: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relative similarity of four diversity metrics and their mean."""
    metrics = ["shannon", "simpson", "evenness", "richness"]
    side = lambda i: div.select(F.col("report_id").alias(f"report_id_{i}"), *[F.col(m).alias(f"{m}_{i}") for m in metrics])
    both = pairs.join(side(1), "report_id_1", "left").join(side(2), "report_id_2", "left")
    sims = {m: relative_similarity(F.col(f"{m}_1"), F.col(f"{m}_2")) for m in metrics}
    mean = reduce(lambda x, y: x + y, sims.values()) / len(metrics)
    return both.select(
        *PAIR, *[s.alias(f"{m}_similarity") for m, s in sims.items()], mean.alias("diversity_similarity")
    )


# Component weights of the overall similarity.
OVERALL_WEIGHTS = {"jaccard": 0.25, "cosine": 0.25, "taxonomic": 0.20, "diversity": 0.15, "environment": 0.15}


def report_similarity(assign: DataFrame, env: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overall similarity of report pairs from overlap, abundance, taxonomy, diversity, environment.

    `env` is keyed by report_id.
    """
    counts = organism_counts(assign)
    per_pair = pair_counts(counts, pairs, "report_id", "organism_id")
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    base = per_pair.groupBy(*PAIR).agg(
        set_measures()["jaccard"].alias("jaccard"),
        F.coalesce(F.sum(a * b) / F.sqrt(F.nullif(F.sum(a * a) * F.sum(b * b), F.lit(0.0))), F.lit(0.0)).alias("cosine"),
    )
    tax = composition_similarity(assign, pairs).select(*PAIR, "taxonomic_similarity")
    div = diversity_similarity(basic_diversity(counts, "report_id"), pairs).select(*PAIR, "diversity_similarity")
    place = environment_similarity(env, pairs, "report_id").select(
        *PAIR,
        ((F.col("geographic_similarity") + F.col("depth_similarity") + F.col("temporal_similarity")) / 3).alias("environment_similarity"),
    )
    w = OVERALL_WEIGHTS
    score = (
        F.col("jaccard") * w["jaccard"]
        + F.col("cosine") * w["cosine"]
        + F.col("taxonomic_similarity") * w["taxonomic"]
        + F.col("diversity_similarity") * w["diversity"]
        + F.col("environment_similarity") * w["environment"]
    )
    out = base
    for part in (tax, div, place):
        out = out.join(part, PAIR)
    return out.withColumn("overall_similarity", score)


def compare_reports_simple(assign: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean of the clipped Shannon similarity and the Jaccard index, with metric differences."""
    counts = organism_counts(assign)
    overlap = pair_counts(counts, pairs, "report_id", "organism_id").groupBy(*PAIR).agg(
        set_measures()["shared"].alias("organism_overlap_count"), set_measures()["jaccard"].alias("jaccard")
    )
    div = basic_diversity(counts, "report_id")
    side = lambda i: div.select(
        F.col("report_id").alias(f"report_id_{i}"), *[F.col(m).alias(f"{m}_{i}") for m in ("shannon", "simpson", "evenness")]
    )
    diff = {m: F.abs(F.col(f"{m}_1") - F.col(f"{m}_2")) for m in ("shannon", "simpson", "evenness")}
    close = 1 - diff["shannon"] / F.greatest(F.col("shannon_1"), F.col("shannon_2"), F.lit(1.0))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), close))
    return overlap.join(side(1), "report_id_1").join(side(2), "report_id_2").select(
        *PAIR,
        "organism_overlap_count",
        "jaccard",
        *[d.alias(f"{m}_diff") for m, d in diff.items()],
        ((clipped + F.col("jaccard")) / 2).alias("similarity_score"),
    )
