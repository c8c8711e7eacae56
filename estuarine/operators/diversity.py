"""Community diversity of all samples at once.

Every index here depends on the abundances only through the abundance spectrum:
per sample, how many taxa (`f`) have `n` individuals. It is built with map-side
combining and has at most sqrt(2N) rows for a sample of N individuals, so a
sample holding most of the data is as cheap as the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estuarine.functions.mathx import (
    any_of,
    banded,
    first_match,
    fisher_alpha,
    lgamma,
    ratio,
    xlogx,
)
from estuarine.operators.ordered import running_totals, top_per_group
from estuarine.session import materialize


def tidy(abund: DataFrame, by: str, taxon: str = "taxon", n: str = "n") -> DataFrame:
    """One positive count per (sample, taxon)."""
    return (
        abund.filter(F.col(n) > 0)
        .groupBy(by, taxon)
        .agg(F.sum(n).cast("long").alias("n"))
        .withColumnRenamed(taxon, "taxon")
    )


def spectrum(abund: DataFrame, by: str) -> DataFrame:
    """(sample, n, f): number of taxa having n individuals. A spectrum passes through."""
    if "f" in abund.columns:
        return abund
    return abund.filter(F.col("n") > 0).groupBy(by, "n").agg(F.count(F.lit(1)).alias("f"))


def _f_at(k: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("n") == k, F.col("f"))), F.lit(0)).cast("long")


def chao1(s: Column, f1: Column, f2: Column, bias_corrected: bool = True) -> Column:
    """Chao1 richness; without doubletons either the corrected form or plain richness."""
    classic = s + (f1 * f1).cast("double") / (f2 * 2)
    fallback = s + (f1 * (f1 - 1)).cast("double") / 2 if bias_corrected else s.cast("double")
    return F.when(f2 > 0, classic).otherwise(fallback)


def _core(spec: DataFrame, by: str) -> DataFrame:
    n, f = F.col("n"), F.col("f")
    rare = n <= 10
    return spec.groupBy(by).agg(
        F.sum(f).alias("s"),
        F.sum(n * f).alias("total"),
        F.max(n).alias("top"),
        F.sum(f * xlogx(n)).alias("nlogn"),
        F.sum(n.cast("double") * n * f).alias("sq"),
        _f_at(1).alias("f1"),
        _f_at(2).alias("f2"),
        F.coalesce(F.sum(F.when(rare, f)), F.lit(0)).alias("s_rare"),
        F.coalesce(F.sum(F.when(rare, n * f)), F.lit(0)).alias("n_rare"),
        F.coalesce(F.sum(F.when(rare, n * (n - 1) * f)), F.lit(0)).alias("rare_pairs"),
        F.sum(f * lgamma(n + 1)).alias("log_fact"),
        F.coalesce(F.sum(F.when(n <= 5, f)), F.lit(0)).alias("s5"),
        F.coalesce(F.sum(F.when(n <= 5, n * f)), F.lit(0)).alias("n5"),
    )


def _ace(s: Column, f1: Column, s_rare: Column, n_rare: Column, pairs: Column) -> Column:
    cover = F.lit(1.0) - f1 / n_rare
    spread = s_rare / cover * pairs / (n_rare * (n_rare - 1)) - 1
    gamma = F.greatest(F.lit(0.0), spread)
    estimate = (s - s_rare) + s_rare / cover + f1 / cover * gamma
    plain = (s_rare == 0) | (f1 == n_rare)
    return F.when(plain, s.cast("double")).otherwise(estimate)


def _shannon(total: Column, nlogn: Column) -> Column:
    return F.log(total.cast("double")) - nlogn / total


def alpha_diversity(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Fourteen alpha indices per sample plus richness and abundance."""
    c = F.col
    h = _shannon(c("total"), c("nlogn"))
    p2 = c("sq") / (c("total").cast("double") * c("total"))
    share = c("top").cast("double") / c("total")
    return _core(spectrum(abund, by), by).select(
        by,
        c("s").alias("richness"),
        c("total").alias("abundance"),
        h.alias("shannon"),
        (1 - p2).alias("simpson"),
        (1 / p2).alias("inverse_simpson"),
        F.when(c("s") > 1, h / F.log(c("s").cast("double"))).otherwise(0.0).alias("evenness"),
        share.alias("dominance"),
        chao1(c("s"), c("f1"), c("f2")).alias("chao1"),
        _ace(c("s"), c("f1"), c("s_rare"), c("n_rare"), c("rare_pairs")).alias("ace"),
        fisher_alpha(c("s"), c("total")).alias("fisher_alpha"),
        share.alias("berger_parker"),
        (F.sqrt("sq") / c("total")).alias("mcintosh"),
        ((lgamma(c("total") + 1) - c("log_fact")) / c("total")).alias("brillouin"),
        (c("s") / F.sqrt(c("total").cast("double"))).alias("menhinick"),
        F.when(c("total") > 1, (c("s") - 1) / F.log(c("total").cast("double")))
        .otherwise(0.0)
        .alias("margalef"),
        F.exp(h).alias("effective_species"),
    )


def basic_diversity(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Shannon, Simpson, evenness, richness, abundance."""
    return alpha_diversity(abund, by).select(
        by, "shannon", "simpson", "evenness", "richness", "abundance"
    )


def rarefaction(abund: DataFrame, by: str = "sample_id", points: int = 50) -> DataFrame:
    """Expected richness at up to `points` evenly spaced subsample sizes.

    Binomial ratios stay in log space, so large samples do not overflow.
    """
    spec = spectrum(abund, by)
    totals = spec.groupBy(by).agg(
        F.sum("f").alias("s"), F.sum(F.col("n") * F.col("f")).alias("total")
    )
    count = F.least(F.lit(points).cast("long"), F.col("total"))
    step = (F.col("total") - 1).cast("double") / F.greatest(count - 1, F.lit(1))
    sizes = F.transform(
        F.sequence(F.lit(0).cast("long"), count - 1),
        lambda i: F.when(i == count - 1, F.col("total")).otherwise(
            F.floor(F.lit(1.0) + i * step).cast("long")
        ),
    )
    n, m, total = F.col("n"), F.col("sample_size"), F.col("total")
    # C(N-n, m) / C(N, m) by three log-gamma terms, of which two are known before the join
    grid = totals.select(by, "s", "total", F.posexplode(sizes).alias("point", "sample_size")).withColumn(
        "of_size", lgamma(total - m + 1) - lgamma(total + 1)
    )
    rows = spec.join(totals.select(by, "total"), by).select(by, "n", "f", lgamma(total - n + 1).alias("of_count"))
    log_missing = F.col("of_count") + F.col("of_size") - lgamma(total - n - m + 1)
    missing = F.when(total - n >= m, F.exp(log_missing)).otherwise(0.0)
    return (
        rows.join(grid, by)
        .groupBy(by, "point", "sample_size", "s", "total")
        .agg(F.sum(F.col("f") * (1 - missing)).alias("e"))
        .select(
            by,
            (F.col("point") + 1).alias("point"),
            "sample_size",
            F.when(m >= total, F.col("s").cast("double")).otherwise(F.col("e")).alias(
                "expected_species"
            ),
        )
    )


def sampling_adequacy(alpha: DataFrame, by: str = "sample_id") -> DataFrame:
    """Completeness against Chao1, adequacy level and advice."""
    done = ratio(F.col("richness"), F.col("chao1"), 1.0)
    level = first_match(
        [
            (done >= 0.9, "excellent"),
            (done >= 0.8, "good"),
            (done >= 0.6, "adequate"),
            (done >= 0.4, "poor"),
        ],
        "very_poor",
    )
    extra = ((F.lit(0.8) - done) * F.col("richness") * 2).cast("int")
    # Advice texts by completeness limit.
    more = F.concat(F.lit("Collect approximately "), extra.cast("string"), F.lit(" additional samples"))
    below_60 = [
        "Increase sampling effort significantly",
        "Consider different sampling methods",
        "Expand spatial coverage",
    ]
    below_40 = [
        "Current sampling is insufficient for reliable diversity estimates",
        "Consider systematic sampling design",
        "Increase sampling intensity by 3-5x",
    ]
    advice = F.array_compact(
        F.array(
            F.when(done < 0.8, more),
            *[F.when(done < 0.6, F.lit(t)) for t in below_60],
            *[F.when(done < 0.4, F.lit(t)) for t in below_40],
        )
    )
    return alpha.select(
        by,
        done.alias("sampling_completeness"),
        level.alias("adequacy_level"),
        F.greatest(F.lit(0.0), F.col("chao1") - F.col("richness")).alias("missing_species"),
        (done < 0.8).alias("additional_sampling_needed"),
        advice.alias("recommendations"),
    )


def _with_totals(spec: DataFrame, by: str) -> DataFrame:
    """Spectrum with sample totals and the taxa and individuals of larger classes.

    The window spans at most sqrt(2N) rows per sample, never the taxa themselves.
    """
    whole = Window.partitionBy(by)
    above = whole.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return spec.select(
        "*",
        F.sum("f").over(whole).alias("s"),
        F.sum(F.col("n") * F.col("f")).over(whole).alias("total"),
        F.coalesce(F.sum("f").over(above), F.lit(0)).alias("s_above"),
        F.coalesce(F.sum(F.col("n") * F.col("f")).over(above), F.lit(0)).alias("n_above"),
    )


def community_structure(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Counts of dominant (>5 %), core (1-5 %), rare (<1 %) taxa, evenness class."""
    spec = _with_totals(spectrum(abund, by), by)
    pct = F.col("n") * 100.0 / F.col("total")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("f"))), F.lit(0))
    top = F.max(pct)
    return spec.groupBy(by).agg(
        pick(pct > 5).alias("dominant_species"),
        pick((pct >= 1) & (pct <= 5)).alias("core_species"),
        pick(pct < 1).alias("rare_species"),
        first_match(
            [
                (top > 50, "highly_uneven"),
                (top > 25, "moderately_uneven"),
                (top > 10, "moderately_even"),
            ],
            "highly_even",
        ).alias("evenness_category"),
    )


def _top_sum(k: int) -> Column:
    taken = F.least(F.col("f"), F.greatest(F.lit(k) - F.col("s_above"), F.lit(0)))
    return F.sum(F.col("n") * taken)


def dominance(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Taxa needed for 50 % and 80 % of the individuals, dominance ratio, top-5 share.

    Whole-number comparisons of cumulative counts; the position inside a class of
    equal counts follows by division.
    """
    n, f, total, above = (F.col(x) for x in ("n", "f", "total", "n_above"))

    def within(num: int, den: int) -> Column:
        room = total * num - above * den
        fit = F.when(room > 0, F.least(f, F.floor(room / (n * den)))).otherwise(0)
        return (F.sum(fit) + 1).cast("long")

    return _with_totals(spectrum(abund, by), by).groupBy(by).agg(
        within(1, 2).alias("species_for_50_percent"),
        within(4, 5).alias("species_for_80_percent"),
        (F.max(n).cast("double") / F.min(n)).alias("dominance_ratio"),
        (_top_sum(5) * 100.0 / F.max(total)).alias("top_5_species_percentage"),
    )


def rare_species(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Singletons, doubletons and other low-count taxa with a rarity class."""
    c = F.col
    ones = c("f1").cast("double") / c("s")
    return _core(spectrum(abund, by), by).select(
        by,
        c("f1").alias("singletons"),
        c("f2").alias("doubletons"),
        c("s5").alias("five_or_fewer"),
        (c("f1") + c("f2")).alias("two_or_fewer"),
        (ones * 100).alias("singleton_percentage"),
        (c("s5") * 100.0 / c("s")).alias("rare_percentage"),
        (c("n5") * 100.0 / c("total")).alias("rare_abundance_percentage"),
        first_match(
            [
                (ones > 0.5, "extremely_high_rarity"),
                (ones > 0.3, "high_rarity"),
                (ones > 0.1, "moderate_rarity"),
            ],
            "low_rarity",
        ).alias("rarity_assessment"),
    )


def inequality(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Lorenz-curve inequality, top shares and abundance classes.

    `gini_reference` is one minus twice the trapezoid under the descending
    cumulative shares, which starts at the first taxon; `gini_standard` is the
    usual coefficient. Inside a class of f equal counts the cumulative sums form an
    arithmetic series, so neither needs a row per taxon.
    """
    n, f, above = F.col("n"), F.col("f"), F.col("n_above")
    area = F.sum(f * above.cast("double") + n * (f * (f + 1) / 2))
    s, total = F.max("s").cast("double"), F.max("total").cast("double")
    curve = area / total
    trapezoid = (curve - (F.max(n) / total + 1) / 2) / s
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, f)), F.lit(0))
    share = lambda k: F.least(_top_sum(k) * 100.0 / total, F.lit(100.0))
    out = _with_totals(spectrum(abund, by), by).groupBy(by).agg(
        (1 - 2 * trapezoid).alias("gini_reference"),
        (2 * curve / s - (s + 1) / s).alias("gini_standard"),
        share(1).alias("top_1_share"),
        F.when(s >= 3, share(3)).otherwise(100.0).alias("top_3_share"),
        F.when(s >= 10, share(10)).otherwise(100.0).alias("top_10_share"),
        pick(n > 100).alias("very_abundant"),
        pick((n > 50) & (n <= 100)).alias("abundant"),
        pick((n > 10) & (n <= 50)).alias("common"),
        pick((n > 5) & (n <= 10)).alias("uncommon"),
        pick((n > 2) & (n <= 5)).alias("rare"),
        pick(n <= 2).alias("very_rare"),
    )
    level = banded(
        F.col("gini_reference"),
        [(0.3, "low_inequality"), (0.5, "moderate_inequality"), (0.7, "high_inequality")],
        "extreme_inequality",
    )
    return out.withColumn("inequality_level", level)


# Fixed values: (ecosystem, shannon low, shannon high, simpson low, simpson high).
ECOSYSTEMS = [
    ("marine_surface", 2.5, 4.0, 0.7, 0.9),
    ("deep_sea", 1.5, 3.0, 0.5, 0.8),
    ("freshwater", 2.0, 3.5, 0.6, 0.85),
    ("terrestrial", 3.0, 4.5, 0.8, 0.95),
]


def ecosystem_match(alpha: DataFrame, by: str = "sample_id") -> DataFrame:
    """Which benchmark ranges a sample's Shannon and Simpson fall into."""
    h, d = F.col("shannon"), F.col("simpson")
    ranges = F.array(
        *[
            F.struct(
                F.lit(name).alias("ecosystem"),
                h.between(lo, hi).alias("shannon_match"),
                d.between(dlo, dhi).alias("simpson_match"),
            )
            for name, lo, hi, dlo, dhi in ECOSYSTEMS
        ]
    )
    level = first_match(
        [
            ((h > 3.5) & (d > 0.8), "very_high"),
            ((h > 2.5) & (d > 0.7), "high"),
            ((h > 1.5) & (d > 0.5), "moderate"),
        ],
        "low",
    )
    return alpha.select(by, level.alias("diversity_level"), F.inline(ranges)).withColumn(
        "overall_match", F.col("shannon_match") & F.col("simpson_match")
    )


# Functional groups in match order with their taxon keywords.
FUNCTIONAL_GROUPS = {
    "primary_producers": ["Cyanobacteria", "Diatoms", "Phytoplankton"],
    "decomposers": ["Bacteria", "Fungi", "Actinobacteria"],
    "chemosynthetic": ["Archaea", "Sulfur_bacteria", "Methanogens"],
    "heterotrophs": ["Proteobacteria", "Bacteroidetes"],
    "symbionts": ["Rhizobia", "Mycorrhizae", "Endosymbionts"],
}


def functional_group(taxon: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """First group with a keyword inside the taxon name, else 'unknown'."""
    low = F.lower(taxon)
    return first_match(
        [
            (any_of([low.contains(k.lower()) for k in words]), name)
            for name, words in (groups or FUNCTIONAL_GROUPS).items()
        ],
        "unknown",
    )


def functional_diversity(
    abund: DataFrame, by: str = "sample_id", groups: dict[str, list[str]] | None = None
) -> DataFrame:
    """Group totals and shares per sample with the diversity over groups."""
    grouped = abund.groupBy(
        by, functional_group(F.col("taxon"), groups).alias("functional_group")
    ).agg(F.sum("n").cast("long").alias("n"))
    indices = basic_diversity(grouped, by).select(
        by,
        F.col("shannon").alias("functional_shannon"),
        F.col("simpson").alias("functional_simpson"),
        F.col("evenness").alias("functional_evenness"),
        F.col("richness").alias("functional_richness"),
        F.col("abundance").alias("total"),
    )
    return grouped.join(indices, by).select(
        by,
        "functional_group",
        "n",
        (F.col("n").cast("double") / F.col("total")).alias("proportion"),
        "functional_shannon",
        "functional_simpson",
        "functional_evenness",
        "functional_richness",
    )


def rank_abundance(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Taxa ranked by falling count (ties by name) with percentages."""
    return _ranked_taxa(abund, by).select(by, "taxon", "n", "rank", "percentage")


def species_accumulation(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """Running species and individuals in rank order."""
    return _ranked_taxa(abund, by).select(
        by,
        F.col("rank").alias("species_rank"),
        F.col("rank").alias("cumulative_species"),
        F.col("cumulative").alias("cumulative_individuals"),
    )


def _ranked_taxa(abund: DataFrame, by: str) -> DataFrame:
    totals = abund.groupBy(by).agg(F.sum("n").alias("__total"))
    ranked = running_totals(
        abund.filter(F.col("n") > 0).select(by, "taxon", "n"),
        [by],
        [F.desc("n"), F.asc("taxon")],
        {"rank": F.lit(1).cast("long"), "cumulative": F.col("n")},
    )
    return ranked.join(totals, by).withColumn(
        "percentage", F.col("n") * 100.0 / F.col("__total")
    )


def abundance_matrix(abund: DataFrame, taxa: list[str], by: str = "sample_id") -> DataFrame:
    """Samples by an explicit list of taxa; the long form is the default elsewhere."""
    return abund.groupBy(by).pivot("taxon", taxa).agg(F.sum("n")).na.fill(0)


def dominant_taxa(abund: DataFrame, by: str, n: int) -> DataFrame:
    return top_per_group(abund, [by], [F.desc("n"), F.asc("taxon")], n)


def diversity_profile(abund: DataFrame, by: str = "sample_id") -> DataFrame:
    """All per-sample community results in one row.

    The abundances are spread over one spectrum aggregation; the parts join on the
    sample key, one row each.
    """
    spec = materialize(spectrum(abund, by))
    alpha = alpha_diversity(spec, by)
    gini = inequality(spec, by).select(by, "gini_reference", "gini_standard", "inequality_level")
    adequacy = sampling_adequacy(alpha, by).select(
        by, "sampling_completeness", "adequacy_level", "missing_species"
    )
    parts = [community_structure(spec, by), dominance(spec, by), rare_species(spec, by)]
    out = alpha
    for part in [*parts, gini, adequacy]:
        out = out.join(part, by)
    return out
