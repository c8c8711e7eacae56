"""Organism identity: signatures, taxonomy matching, profiles, cross-report matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.mathx import first_match
from estuarine.operators.ordered import top_per_group
from estuarine.operators.ranks import RANKS, present_ranks
from estuarine.operators.similarity import RANK_WEIGHTS
from estuarine.session import materialize

# Matching thresholds.
TAXONOMY_MIN, COMBINED_MIN, CROSS_REPORT_MIN, FUZZY_CREDIT = 0.8, 0.85, 0.8, 0.8


def fuzzy_match(a: Column, b: Column) -> Column:
    """One name inside the other, or the same first three letters of longer names."""
    inside = a.contains(b) | b.contains(a)
    prefix = (F.length(a) > 3) & (F.length(b) > 3) & (F.left(a, F.lit(3)) == F.left(b, F.lit(3)))
    return (F.length(a) > 0) & (F.length(b) > 0) & (inside | prefix)


def taxonomic_similarity(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Weighted agreement over the ranks, 0.8 of the weight for a fuzzy match."""
    terms = []
    for rank in left:
        a, b = F.trim(F.lower(left[rank])), F.trim(F.lower(right[rank]))
        w = RANK_WEIGHTS[rank]
        known = (F.length(a) > 0) & (F.length(b) > 0)
        terms.append(
            F.coalesce(
                F.when(known & (a == b), w).when(known & fuzzy_match(a, b), w * FUZZY_CREDIT), F.lit(0.0)
            )
        )
    return reduce(lambda x, y: x + y, terms, F.lit(0.0))


def lineage_text(ranks: dict[str, Column]) -> Column:
    """`K__x; P__y` of the ranks that are set, else 'Unclassified'."""
    parts = [F.when(c != "", F.concat(F.lit(f"{r[0].upper()}__"), c)) for r, c in ranks.items()]
    joined = F.array_join(F.array_compact(F.array(*parts)), "; ")
    return F.when(joined != "", joined).otherwise("Unclassified")


def display_name(genus: Column, species: Column, family: Column, order: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return first_match(
        [
            (has(genus) & has(species), F.concat_ws(" ", genus, species)),
            (has(genus), F.concat(genus, F.lit(" sp."))),
            (has(family), F.concat(family, F.lit(" family member"))),
            (has(order), F.concat(order, F.lit(" order member"))),
        ],
        "Unclassified organism",
    )


def organism_id(genus: Column, species: Column, signature: Column) -> Column:
    """The printed form; different organisms may share it. Join by `organism_key`."""
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    text = F.concat_ws("_", known(genus), known(species), F.left(signature, F.lit(8)))
    return F.concat(F.lit("ORG_"), F.upper(F.left(F.md5(text), F.lit(12))))


def organism_key(genus: Column, species: Column, signature: Column) -> Column:
    """Full hash of name and whole signature."""
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    return F.sha2(F.concat_ws("\x00", known(genus), known(species), F.coalesce(signature, F.lit(""))), 256)


def identification_confidence(n: Column, filled: Column, mean_length: Column) -> Column:
    """Number of sequences, completeness of the lineage and length, capped at 1."""
    score = (
        F.least(n / 10, F.lit(1.0)) * 0.3
        + filled / len(RANKS) * 0.4
        + F.coalesce(F.least(mean_length / 500, F.lit(1.0)), F.lit(0.0)) * 0.3
    )
    return F.least(score, F.lit(1.0))


# Kingdom words looked for in descriptions.
KINGDOM_WORDS = [("bacteria", "Bacteria"), ("archaea", "Archaea"), ("eukaryota", "Eukaryota"), ("eukaryotic", "Eukaryota")]


def kingdom_from_text(description: Column, words: list[tuple[str, str]] | None = None) -> Column:
    low = F.lower(description)
    return first_match([(low.contains(w), k) for w, k in (words or KINGDOM_WORDS)]).cast("string")


def novelty_by_known(df: DataFrame, known: DataFrame) -> DataFrame:
    """Novelty score from how many known organisms share genus and species."""
    counts = known.groupBy("genus", "species").agg(F.count(F.lit(1)).alias("known_count"))
    n = F.coalesce("known_count", F.lit(0))
    missing = (F.coalesce("genus", F.lit("")) == "") | (F.coalesce("species", F.lit("")) == "")
    score = first_match([(missing, 0.8), (n == 0, 0.9), (n < 3, 0.7)], 0.3)
    return (
        df.join(counts, ["genus", "species"], "left")
        .withColumn("novelty_score", score)
        .withColumn("is_novel_candidate", F.col("novelty_score") > 0.5)
        .withColumn("known_count", n)
    )


def consensus_taxonomy(assign: DataFrame, by: str, order: str = "sequence_id") -> DataFrame:
    """Most common value per rank and group; the value seen first in `order` wins ties."""
    ranks = present_ranks(assign)
    seen = assign.groupBy(by, *ranks).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    counts = (
        seen.unpivot([by, "n", "first"], ranks, "rank", "value")
        .filter(F.coalesce("value", F.lit("")) != "")
        .groupBy(by, "rank", "value")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    best = top_per_group(counts, [by, "rank"], [F.desc("n"), F.asc("first"), F.asc("value")], 1)
    return best.groupBy(by).pivot("rank", ranks).agg(F.first("value"))


def group_signature(signatures: DataFrame, by: str) -> DataFrame:
    """Most common signature per group; ties take the smaller text."""
    counts = signatures.groupBy(by, "signature").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, [by], [F.desc("n"), F.asc("signature")], 1).select(by, "signature")


def _side(df: DataFrame, ranks: list[str], tag: str) -> dict[str, Column]:
    return {r: F.col(f"{r}_{tag}") for r in ranks}


def _classes(df: DataFrame, ranks: list[str], extra: list[str], tag: str, key: str) -> DataFrame:
    """Distinct (signature, lineage) classes with size and first member."""
    grouped = df.groupBy(*extra, "signature", *ranks).agg(
        F.min(key).alias(f"{key}_{tag}"), F.count(F.lit(1)).alias(f"members_{tag}")
    )
    return grouped.select(
        *extra, "signature", f"{key}_{tag}", f"members_{tag}", *[F.col(r).alias(f"{r}_{tag}") for r in ranks]
    )


def identify_organisms(groups: DataFrame, known: DataFrame, group_key: str = "group_id") -> DataFrame:
    """Match groups to known organisms, else mint a new profile id.

    Without equal signatures the combined score cannot reach its threshold, so both
    match tiers need the same signature, which is the join key. A group's result depends on its
    signature and lineage alone: groups and known organisms of one signature and lineage are
    folded into one class each before they are compared.
    """
    ranks = present_ranks(known)
    traits = ["signature", *ranks]
    classes = _classes(known, ranks, [], "k", "organism_id")
    # a class may be as large as its input, whatever the optimiser assumes
    joined = groups.select(*traits).distinct().join(classes.hint("merge"), "signature", "left")
    tax = taxonomic_similarity({r: F.col(r) for r in ranks}, _side(known, ranks, "k"))
    same_name = (F.col("genus") == F.col("genus_k")) & (F.col("species") == F.col("species_k"))
    tier = F.when(tax >= TAXONOMY_MIN, 1).when(same_name & ((tax + 1) / 2 >= COMBINED_MIN), 2)
    match = F.when(F.col("tier").isNotNull(), F.struct("tier", F.col("organism_id_k").alias("organism_id")))
    best = joined.withColumn("tier", tier).groupBy(*traits).agg(F.min(match).alias("m"))
    best = best.select(*traits, F.col("m.organism_id").alias("matched_id"), F.col("m.tier").alias("match_tier"))
    none = F.lit(None).cast("string")
    col = lambda r: F.col(r) if r in ranks else none
    out = novelty_by_known(best, known).select(
        *[F.col(c).alias(f"__{c}") for c in traits],
        F.coalesce(F.col("matched_id").cast("string"), organism_id(col("genus"), col("species"), F.col("signature"))).alias("organism_id"),
        F.coalesce(F.col("matched_id").cast("string"), organism_key(col("genus"), col("species"), F.col("signature"))).alias("organism_key"),
        F.col("matched_id").isNull().alias("is_new"),
        "match_tier",
        display_name(col("genus"), col("species"), col("family"), col("order")).alias("organism_name"),
        lineage_text({r: F.col(r) for r in ranks}).alias("taxonomic_lineage"),
        "novelty_score",
        "is_novel_candidate",
    )
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in traits])
    return groups.select(group_key, *traits).join(out.hint("merge"), same).select(
        group_key, "signature", *[c for c in out.columns if not c.startswith("__")]
    )


def similar_organisms(profiles: DataFrame, target: object, threshold: float, k: int) -> DataFrame:
    """Best k organisms by (signature equality + taxonomic similarity) / 2 to one organism."""
    ranks = present_ranks(profiles)
    one = profiles.filter(F.col("organism_id") == target).select(
        F.col("signature").alias("signature_t"), *[F.col(r).alias(f"{r}_t") for r in ranks]
    )
    rest = profiles.filter(F.col("organism_id") != target)
    scored = rest.join(F.broadcast(one.limit(1))).select(  # one row
        "organism_id",
        (
            (
                (F.col("signature") == F.col("signature_t")).cast("double")
                + taxonomic_similarity({r: F.col(r) for r in ranks}, _side(one, ranks, "t"))
            )
            / 2
        ).alias("similarity"),
    )
    rounded = scored.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= threshold)
    return rounded.orderBy(F.desc("similarity"), F.asc("organism_id")).limit(k)


def match_organisms(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Organisms shared or similar between the reports of each pair.

    `members` holds (report_id, organism_id, signature, ranks). Exact matches are
    counted by organism. Left-over organisms can only be similar under an equal
    signature; they are compared as classes of one signature and lineage, whose sizes
    multiply, so no organism pair is ever written out. Names stay out of all tables but those of
    the classes and of the pairs of classes that meet.
    """
    ranks = present_ranks(members)
    pair = ["report_id_1", "report_id_2"]
    sides = [
        pairs.select(*pair, F.col(f"report_id_{i}").alias("report_id"))
        .join(members.select("report_id", "organism_id"), "report_id")
        .select(*pair, "organism_id", F.lit(i).alias("side"))
        for i in (1, 2)
    ]
    both = sides[0].unionByName(sides[1]).groupBy(*pair, "organism_id")
    found = materialize(both.agg(F.bit_or("side").alias("sides")))
    # classes go by number through the tables that grow with the pairs; ids are written, so that they stay
    traits = members.select("organism_id", "signature", *ranks).distinct()
    named = materialize(traits.select("signature", *ranks).distinct().withColumn("kind", F.monotonically_increasing_id()))
    same = reduce(lambda x, y: x & y, [traits[c].eqNullSafe(named[c]) for c in ("signature", *ranks)])
    group = named.filter("signature is not null").groupBy("signature").agg(F.min("kind").alias("group"))
    numbers = named.join(group, "signature").select("kind", "group")
    of = traits.join(named, same).select("organism_id", "kind").join(numbers, "kind")
    flat = materialize(
        found.filter("sides <> 3").join(of, "organism_id").groupBy(*pair, "group", "kind")
        .agg(F.count_if(F.col("sides") == 1).alias("m1"), F.count_if(F.col("sides") == 2).alias("m2"))
    )
    exact = found.groupBy(*pair).agg(
        F.count_if(F.col("sides") == 3).alias("exact_matches"),
        F.count_if(F.col("sides") == 1).alias("unique_to_1"),
        F.count_if(F.col("sides") == 2).alias("unique_to_2"),
        (F.count_if(F.col("sides") == 3) / F.count(F.lit(1))).alias("jaccard"),
    )
    left, right = (flat.filter(f"m{k} > 0").select(*pair, "group", F.col("kind").alias(f"kind_{k}"), f"m{k}") for k in (1, 2))
    met = left.join(right.hint("merge"), [*pair, "group"])
    # lineages of two classes are compared once, in however many pairs of reports they meet
    one, two = (named.select(F.col("kind").alias(f"kind_{k}"), *[F.col(r).alias(f"{r}_{k}") for r in ranks]) for k in (1, 2))
    score = (taxonomic_similarity(_side(named, ranks, "1"), _side(named, ranks, "2")) + 1) / 2
    alike = met.select("kind_1", "kind_2").distinct().join(one, "kind_1").join(two, "kind_2").filter(score >= CROSS_REPORT_MIN)
    alike = materialize(alike.select("kind_1", "kind_2"))
    similar = met.join(alike, ["kind_1", "kind_2"], "left_semi").groupBy(*pair).agg(
        F.sum(F.col("m1") * F.col("m2")).alias("similar_pairs"), F.count(F.lit(1)).alias("similar_classes")
    )
    return exact.join(similar, pair, "left").na.fill(0, ["similar_pairs", "similar_classes"])
