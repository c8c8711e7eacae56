"""Profiles of taxonomic assignments: rank distributions, confidence, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.mathx import first_match, ratio
from estuarine.operators.diversity import alpha_diversity, chao1, spectrum
from estuarine.operators.ordered import exact_quantiles, top_per_group

# Main ranks, root-most first.
RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]


def present_ranks(df: DataFrame) -> list[str]:
    return [r for r in RANKS if r in df.columns]


def parse_taxonomy(taxonomy: Column, rank: str) -> Column:
    """Name at a rank in `rank__name;rank__name` text; null if absent or empty."""
    name = F.regexp_extract(taxonomy, rf"(?:^|;){rank}__([^;]*)", 1)
    return F.when(name != "", name)


def taxonomy_text(ranks: dict[str, Column]) -> Column:
    """`rank__name;...` text of the ranks that are set, 'Unknown' if none is."""
    parts = F.array_compact(
        F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{r}__"), c)) for r, c in ranks.items()])
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ";")).otherwise("Unknown")


def rank_counts(assign: DataFrame, by: str, ranks: list[str] | None = None) -> DataFrame:
    """(group, rank, taxon, n) in long form.

    The wide rows are pre-counted as tuples before the ranks are unpivoted, so the
    shuffle carries distinct lineages instead of every sequence.
    """
    ranks = ranks or present_ranks(assign)
    lineages = assign.groupBy(by, *ranks).agg(F.count(F.lit(1)).alias("n"))
    return (
        lineages.unpivot([by, "n"], ranks, "rank", "taxon")
        .filter(F.col("taxon").isNotNull())
        .groupBy(by, "rank", "taxon")
        .agg(F.sum("n").alias("n"))
    )


def rank_richness(assign: DataFrame, by: str) -> DataFrame:
    """Distinct taxa per rank, their sum and the number of positive entries.

    The sum itself counts as an entry of the breadth.
    """
    ranks = [r for r in present_ranks(assign) if r != "species"]
    per = rank_counts(assign, by, ranks).groupBy(by).pivot("rank", ranks).agg(F.count(F.lit(1)))
    everyone = assign.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).select(by)
    cols = {r: F.coalesce(F.col(r), F.lit(0)) for r in ranks}
    spread = sum(cols.values(), F.lit(0))
    positive = sum(((c > 0).cast("long") for c in [*cols.values(), spread]), F.lit(0))
    return everyone.join(per, by, "left").select(
        by,
        *[c.alias(f"{r}_diversity") for r, c in cols.items()],
        spread.cast("long").alias("phylogenetic_dispersion"),
        positive.cast("long").alias("taxonomic_breadth"),
    )


def rank_distribution(assign: DataFrame, by: str, top: int = 20) -> DataFrame:
    """Per rank the `top` taxa, totals, distinct taxa, leading taxon, assignment rate."""
    counts = rank_counts(assign, by)
    summary = counts.groupBy(by, "rank").agg(
        F.sum("n").alias("total_assigned"),
        F.count(F.lit(1)).alias("unique_taxa"),
        F.max("n").alias("top_count"),
    )
    size = assign.groupBy(by).agg(F.count(F.lit(1)).alias("__rows"))
    best = top_per_group(counts, [by, "rank"], [F.desc("n"), F.asc("taxon")], top, "position")
    return best.join(summary, [by, "rank"]).join(size, by).select(
        by,
        "rank",
        "taxon",
        "n",
        F.col("position").cast("long").alias("position"),
        "total_assigned",
        "unique_taxa",
        "top_count",
        (F.col("total_assigned") / F.col("__rows")).alias("assignment_rate"),
    )


def confidence_stats(assign: DataFrame, by: str, high: float = 0.8) -> DataFrame:
    """Spread of the positive confidences and the share above `high`."""
    rows = assign.filter(F.col("confidence") > 0).select(by, "confidence")
    moments = rows.groupBy(by).agg(
        F.avg("confidence").alias("mean"),
        F.stddev_pop("confidence").alias("std"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
        F.avg((F.col("confidence") > high).cast("double")).alias("high_confidence_rate"),
    )
    quart = exact_quantiles(rows, [by], "confidence", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.join(quart, by)


def alpha_by_rank(assign: DataFrame, by: str) -> DataFrame:
    """Diversity at genus, species and family level; Chao1 falls back to richness."""
    counts = rank_counts(assign, by, [r for r in ("genus", "species", "family") if r in assign.columns])
    keyed = counts.withColumn("__g", F.struct(by, "rank"))
    spec = spectrum(keyed, "__g")
    singles = spec.groupBy("__g").agg(
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("f"))), F.lit(0)).alias("f1"),
        F.coalesce(F.sum(F.when(F.col("n") == 2, F.col("f"))), F.lit(0)).alias("f2"),
    )
    alpha = alpha_diversity(spec, "__g").select("__g", "shannon", "simpson", "richness", "evenness")
    return alpha.join(singles, "__g").select(
        F.col(f"__g.{by}").alias(by),
        F.col("__g.rank").alias("rank"),
        "shannon",
        "simpson",
        "richness",
        chao1(F.col("richness"), F.col("f1"), F.col("f2"), bias_corrected=False).alias("chao1"),
        "evenness",
    )


def beta_prep(assign: DataFrame, by: str, rare_below: int = 5, top: int = 10) -> DataFrame:
    """Genus and species vectors with rare and dominant flags."""
    counts = rank_counts(assign, by, ["genus", "species"])
    lead = top_per_group(
        counts.filter(F.col("rank") == "genus"), [by], [F.desc("n"), F.asc("taxon")], top
    ).select(by, "rank", "taxon", F.lit(True).alias("is_dominant"))
    return counts.join(lead, [by, "rank", "taxon"], "left").select(
        by,
        "rank",
        "taxon",
        "n",
        ((F.col("rank") == "genus") & (F.col("n") < rare_below)).alias("is_rare"),
        F.coalesce("is_dominant", F.lit(False)).alias("is_dominant"),
    )


def phylo_pattern(assign: DataFrame, by: str, rare_below: int = 10) -> DataFrame:
    """Kingdom and phylum diversity, dominance over all rows, rare phyla, breadth."""
    counts = rank_counts(assign, by, ["kingdom", "phylum"])
    keyed = counts.withColumn("__g", F.struct(by, "rank"))
    alpha = alpha_diversity(keyed, "__g").select(
        F.col(f"__g.{by}").alias(by), F.col("__g.rank").alias("rank"), "richness", "evenness"
    )
    wide = alpha.groupBy(by).agg(
        *[
            F.coalesce(F.max(F.when(F.col("rank") == r, F.col(src))), F.lit(zero)).alias(f"{r}_{out}")
            for r in ("kingdom", "phylum")
            for src, out, zero in (("richness", "count", 0), ("evenness", "evenness", 0.0))
        ]
    )
    tops = counts.groupBy(by).agg(
        F.max(F.when(F.col("rank") == "kingdom", F.col("n"))).alias("__top"),
        F.count_if((F.col("rank") == "phylum") & (F.col("n") < rare_below)).alias("rare_phyla"),
    )
    size = assign.groupBy(by).agg(F.count(F.lit(1)).alias("__rows"))
    return size.join(wide, by).join(tops, by).select(
        by,
        "kingdom_count",
        "kingdom_evenness",
        ratio(F.col("__top"), F.col("__rows"), 0.0).alias("kingdom_dominance"),
        "phylum_count",
        "phylum_evenness",
        "rare_phyla",
        (F.col("kingdom_count") * F.col("phylum_count")).alias("phylogenetic_breadth"),
    )


def contamination(
    assign: DataFrame, by: str, archaea: str = "Archaea", eukaryota: str = "Eukaryota"
) -> DataFrame:
    """Signs of cross-domain contamination from the kingdom counts."""
    counts = rank_counts(assign, by, ["kingdom"])
    n = F.col("n")
    of = lambda name: F.coalesce(F.sum(F.when(F.col("taxon") == name, n)), F.lit(0))
    return counts.groupBy(by).agg(
        (F.count(F.lit(1)) > 1).alias("multiple_domains"),
        (of(archaea) * 20 > F.sum(n)).alias("unexpected_archaea"),
        (of(eukaryota) * 10 < F.sum(n)).alias("low_eukaryote_ratio"),
        (1 - F.max(n).cast("double") / F.sum(n)).alias("contamination_score"),
    )


def novel_rank(identity: Column) -> Column:
    """Rank at which a sequence is new, by identity to the best known one."""
    value = F.coalesce(identity, F.lit(0.0))
    return first_match(
        [(value < 70, "genus_or_higher"), (value < 85, "species"), (value < 95, "subspecies_or_strain")],
        "sequence_variant",
    )


def novel_by_confidence(
    assign: DataFrame, threshold: float = 0.8, top: int = 50, by: str | None = None
) -> DataFrame:
    """Weakly assigned sequences of low identity, most novel first, `top` per group or overall."""
    hits = assign.filter(
        (F.col("confidence") > 0.3) & (F.col("confidence") < threshold) & (F.col("identity") < 90)
    ).select(
        *([by] if by else []),
        "sequence_id",
        "confidence",
        "identity",
        (1 - F.col("confidence")).alias("novelty_score"),
        novel_rank(F.col("identity")).alias("potential_rank"),
    )
    order = [F.desc("novelty_score"), F.asc("sequence_id")]
    return top_per_group(hits, [by], order, top) if by else hits.orderBy(*order).limit(top)


def assignment_summary(assign: DataFrame, label: str, conflict: Column, top: int = 10) -> DataFrame:
    """Totals, distinct labels, conflicts and the leading labels and phyla as (section, item, n)."""
    name = F.coalesce(F.col(label), F.lit("Unknown"))
    cards = assign.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(name).alias("distinct_labels"),
        F.count_if(conflict).alias("conflicts"),
    ).select(F.expr("stack(3, 'total', total, 'distinct_labels', distinct_labels, 'conflicts', conflicts) AS (item, n)"))

    def leading(col: Column, section: str, k: int) -> DataFrame:
        return (
            assign.groupBy(col.alias("item"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("item"))
            .limit(k)
            .select(F.lit(section).alias("section"), "item", "n")
        )

    out = cards.select(F.lit("cards").alias("section"), "item", "n")
    out = out.unionByName(leading(name, "labels", top))
    return out.unionByName(leading(F.coalesce(F.col("phylum"), F.lit("Unknown")), "phyla", 5))


def taxonomic_profile(assign: DataFrame, by: str, threshold: float = 0.8) -> DataFrame:
    """Composition totals with confidence, phylogenetic and contamination results."""
    known = F.coalesce(*[F.col(r) for r in present_ranks(assign)]).isNotNull()
    totals = assign.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.count_if(known).alias("assigned_sequences"),
        F.count_if(F.col("confidence") >= threshold).alias("high_confidence_assignments"),
    )
    conf = confidence_stats(assign, by).select(
        by, F.col("mean").alias("mean_confidence"), F.col("median").alias("median_confidence")
    )
    out = totals
    for part in (conf, phylo_pattern(assign, by), contamination(assign, by)):
        out = out.join(part, by, "left")
    return out
