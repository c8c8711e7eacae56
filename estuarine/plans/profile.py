"""One-call dataset profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.sequences import letter_count, mean_phred
from estuarine.operators import diversity, reads as R


def profile_dataset(reads: DataFrame, by: str = "sample_id") -> DataFrame:
    """Tidy (group, section, metric, value) rows over all reads, no sampling.

    Three narrow aggregations: lengths by value, per-group sums over the sequence
    text, and organism counts feeding the diversity indices.
    """
    lengths = R.length_stats(reads, by)
    has_qual = "qual" in reads.columns
    lean = reads.select(
        by,
        "seq",
        F.lower("description").alias("text"),
        (mean_phred(F.col("qual")) if has_qual else F.lit(None).cast("double")).alias("q"),
    )
    seq = F.upper("seq")
    sums = {
        **{("composition", b): F.sum(letter_count(seq, b)) for b in "ACGTN"},
        ("composition", "total_characters"): F.sum(F.length("seq")),
        **{("annotation", w): F.count_if(F.col("text").contains(w)) for w in R.DESCRIPTION_KEYWORDS},
        ("quality", "sequences_with_quality"): F.count("q"),
        ("quality", "mean_quality"): F.avg("q"),
        ("quality", "min_quality"): F.min("q"),
        ("quality", "max_quality"): F.max("q"),
        ("quality", "low_quality_sequences"): F.count_if(F.col("q") < 20),
    }
    flat = lean.groupBy(by).agg(*[e.alias(f"m{i}") for i, e in enumerate(sums.values())])
    organisms = reads.groupBy(by, F.coalesce("organism", F.lit("Unknown")).alias("taxon")).agg(
        F.count(F.lit(1)).alias("n")
    )
    alpha = diversity.alpha_diversity(organisms, by)
    metrics = [c for c in alpha.columns if c != by]
    length_metrics = [c for c in lengths.columns if c != by]
    return (
        _tidy(lengths, by, {("length", c): F.col(c) for c in length_metrics})
        .unionByName(_tidy(flat, by, {k: F.col(f"m{i}") for i, k in enumerate(sums)}))
        .unionByName(_tidy(alpha, by, {("diversity", c): F.col(c) for c in metrics}))
    )


def _tidy(df: DataFrame, by: str, cells: dict[tuple[str, str], Column]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("section"), F.lit(m).alias("metric"), c.cast("double").alias("value")
            )
            for (s, m), c in cells.items()
        ]
    )
    return df.select(by, F.inline(rows))
