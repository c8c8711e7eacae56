"""Taxonomy assignment: neighbour votes, cluster consensus, alignment hits, classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.functions.headers import coverage_of_query, coverage_of_span, organism_name, taxid
from estuarine.functions.mathx import first_match, ratio
from estuarine.operators.ordered import top_per_group
from estuarine.operators.ranks import RANKS
from estuarine.operators.vectors import as_doubles, knn_join
from estuarine.session import materialize

# Vote, consensus and alignment settings.
MIN_SIMILARITY, MARGIN, OTHER_AGREEMENT = 0.65, 0.07, 0.6
MIN_AGREEMENT = {"species": 0.8, "genus": 0.7, "family": 0.6}
CONSENSUS_MIN, CONSENSUS_RANKS = 0.7, ["species", "genus", "family"]
SPECIES_CONFIDENCE, IDENTITY_MIN, ALIGNMENT_CAP = 0.8, 97.0, 0.99


def knn_lca(
    neighbours: DataFrame,
    labels: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    margin: float = MARGIN,
    min_agreement: dict[str, float] | None = None,
) -> DataFrame:
    """Most specific rank on which the similarity-weighted neighbours agree.

    `neighbours` has query_id, ref_id, value; `labels` has ref_id and rank columns. Each
    query has k neighbours, so its votes are few.
    """
    agreement = MIN_AGREEMENT | (min_agreement or {})
    ranks = [r for r in reversed(RANKS) if r in labels.columns]
    neighbours = materialize(neighbours)  # read twice; a search would be made twice
    sims = neighbours.groupBy("query_id").agg(
        F.avg("value").alias("knn_mean_similarity"), F.max("value").alias("knn_top_similarity")
    )
    near = neighbours.filter(F.col("value") >= min_similarity).join(labels, "ref_id")
    long = near.unpivot(["query_id", "value"], ranks, "rank", "label").filter(F.col("label").isNotNull())
    votes = long.groupBy("query_id", "rank", "label").agg(F.round(F.sum("value"), 9).alias("w"))
    tally = votes.groupBy("query_id", "rank").agg(
        F.sum("w").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("v"), "label"))).alias("s")
    )
    top = -F.get("s", 0)["v"]
    second = F.coalesce(-F.get("s", 1)["v"], F.lit(0.0))
    share = top / F.greatest(F.col("total"), F.lit(1e-12))
    wanted = first_match([(F.col("rank") == r, a) for r, a in agreement.items()], OTHER_AGREEMENT)
    depth = first_match([(F.col("rank") == r, i) for i, r in enumerate(ranks)])
    accepted = tally.select("query_id", "rank", F.get("s", 0)["label"].alias("label"), share.alias("share"), top.alias("top"), second.alias("second"), depth.alias("depth")).filter(
        (F.col("share") >= wanted) & (F.col("top") - F.col("second") >= margin)
    )
    best = accepted.groupBy("query_id").agg(
        F.min_by(F.struct("rank", "label", "share", "top", "second"), F.col("depth")).alias("b")
    )
    return sims.join(best, "query_id", "left").select(
        F.col("query_id").alias("sequence_id"),
        F.col("b.rank").alias("assigned_rank"),
        F.col("b.label").alias("assigned_label"),
        F.coalesce("b.share", F.lit(0.0)).alias("confidence"),
        F.coalesce("b.top", F.lit(0.0)).alias("top_weight"),
        F.coalesce("b.second", F.lit(0.0)).alias("second_weight"),
        "knn_mean_similarity",
        "knn_top_similarity",
    )


def cluster_consensus(assign: DataFrame, clusters: DataFrame, threshold: float = CONSENSUS_MIN) -> DataFrame:
    """Spread a label held by most of a cluster to its unassigned and weaker members.

    Per cluster the most specific rank with a clear majority counts; shares are of the
    whole cluster. Noise is left alone.
    """
    rows = materialize(assign.join(clusters, "sequence_id", "left"))  # read three times
    inside = rows.filter(F.col("cluster").isNotNull() & (F.col("cluster") != -1))
    sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    counts = (
        inside.filter(F.col("assigned_rank").isin(*CONSENSUS_RANKS))
        .groupBy("cluster", "assigned_rank", "assigned_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    lead = top_per_group(counts, ["cluster", "assigned_rank"], [F.desc("n"), F.asc("assigned_label")], 1)
    depth = first_match([(F.col("assigned_rank") == r, i) for i, r in enumerate(CONSENSUS_RANKS)])
    winners = (
        lead.join(sizes, "cluster")
        .withColumn("share", F.col("n") / F.col("size"))
        .filter(F.col("share") >= threshold)
        .groupBy("cluster")
        .agg(F.min_by(F.struct(F.col("assigned_rank").alias("r"), F.col("assigned_label").alias("l"), "share"), depth).alias("w"))
    )
    joined = rows.join(winners, "cluster", "left")
    weaker = (F.col("assigned_rank") == F.col("w.r")) & (F.col("confidence") < F.col("w.share"))
    change = F.coalesce(F.col("w").isNotNull() & (F.col("assigned_rank").isNull() | weaker), F.lit(False))
    new = {
        "assigned_rank": F.when(change, F.col("w.r")).otherwise(F.col("assigned_rank")),
        "assigned_label": F.when(change, F.col("w.l")).otherwise(F.col("assigned_label")),
        "confidence": F.when(change, F.greatest("confidence", "w.share")).otherwise(F.col("confidence")),
        "source": F.when(change, F.concat("source", F.lit("+consensus"))).otherwise(F.col("source")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in assign.columns])


def best_hit(hits: DataFrame, min_identity: float = IDENTITY_MIN, mode: str = "identity") -> DataFrame:
    """One hit per query: the highest identity above the limit (first wins ties), or simply the first.

    `hits` carries `pos`, its order in the file.
    """
    rest = [c for c in hits.columns if c != "query_id"]
    if mode == "first":
        return hits.groupBy("query_id").agg(F.min_by(F.struct(*rest), F.col("pos")).alias("h")).select("query_id", "h.*")
    good = hits.filter(F.col("identity") >= min_identity)
    order = F.struct(-F.col("identity"), F.col("pos"))
    return good.groupBy("query_id").agg(F.min_by(F.struct(*rest), order).alias("h")).select("query_id", "h.*")


def hits_to_assignments(hits: DataFrame, reads: DataFrame, span_coverage: bool = True) -> DataFrame:
    """Every read with its hit's taxon, taxid, identity and coverage; misses are Unknown.

    `hits` holds at most one row per query.
    """
    cover = (
        coverage_of_span(F.col("align_length"), F.col("q_start"), F.col("q_end"))
        if span_coverage
        else coverage_of_query(F.col("align_length"), F.col("query_length"))
    )
    found = hits.select(
        F.col("query_id").alias("sequence_id"),
        "subject_id",
        "identity",
        "evalue",
        cover.alias("coverage"),
        F.coalesce(organism_name(F.col("title")), F.lit("Unknown")).alias("taxonomy"),
        taxid(F.col("title")).alias("taxid"),
    )
    out = reads.select("sequence_id").join(found, "sequence_id", "left")
    return out.select(
        "sequence_id",
        F.col("subject_id").alias("best_hit"),
        F.coalesce("identity", F.lit(0.0)).alias("identity"),
        F.coalesce("evalue", F.lit(float("inf"))).alias("evalue"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("taxonomy", F.lit("Unknown")).alias("taxonomy"),
        "taxid",
    )


def alignment_fallback(
    assign: DataFrame, hits: DataFrame, weak_below: float = SPECIES_CONFIDENCE, min_identity: float = IDENTITY_MIN
) -> DataFrame:
    """Give unassigned and weak species rows the species of a good alignment.

    `hits` has sequence_id, taxonomy, identity, taxid.
    """
    h = hits.select(
        "sequence_id", F.col("taxonomy").alias("blast_label"), F.col("identity").alias("blast_identity"), F.col("taxid").alias("blast_taxid")
    )
    rows = assign.join(h, "sequence_id", "left")
    open_row = F.col("assigned_rank").isNull() | (
        (F.col("assigned_rank") == "species") & (F.col("confidence") < weak_below)
    )
    take = F.coalesce(open_row & (F.col("blast_identity") >= min_identity) & F.col("blast_label").isNotNull(), F.lit(False))
    capped = F.least(F.lit(ALIGNMENT_CAP), F.col("blast_identity") / 100)
    return rows.select(
        *[
            F.when(take, "species").otherwise(F.col(c)).alias(c)
            if c == "assigned_rank"
            else F.when(take, F.col("blast_label")).otherwise(F.col(c)).alias(c)
            if c == "assigned_label"
            else F.when(take, F.greatest("confidence", capped)).otherwise(F.col(c)).alias(c)
            if c == "confidence"
            else F.when(take, F.concat("source", F.lit("+blast"))).otherwise(F.col(c)).alias(c)
            if c == "source"
            else F.col(c)
            for c in assign.columns
        ],
        *[F.when(take, F.col(c)).alias(c) for c in ("blast_label", "blast_identity", "blast_taxid")],
    )


def assign_taxonomy(
    queries: DataFrame,
    refs: DataFrame | None,
    labels: DataFrame | None,
    clusters: DataFrame | None,
    hits: DataFrame | None,
    k: int = 50,
    **vote,
) -> DataFrame:
    """Votes of neighbours, then cluster consensus, then alignment; each step is optional.

    `queries` has vec_id and embedding; the result is keyed by sequence_id.
    """
    if refs is not None and labels is not None:
        voted = knn_lca(knn_join(queries, refs, k), labels, **vote)
        every = queries.select(F.col("vec_id").alias("sequence_id"))
        rows = every.join(voted, "sequence_id", "left").select(
            "sequence_id",
            "assigned_rank",
            "assigned_label",
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.col("assigned_rank").alias("knn_rank"),
            F.col("assigned_label").alias("knn_label"),
            F.coalesce("confidence", F.lit(0.0)).alias("knn_confidence"),
            F.lit("knn").alias("source"),
        )
    else:
        none = F.lit(None).cast("string")
        rows = queries.select(
            F.col("vec_id").alias("sequence_id"), none.alias("assigned_rank"), none.alias("assigned_label"),
            F.lit(0.0).alias("confidence"), none.alias("knn_rank"), none.alias("knn_label"),
            F.lit(None).cast("double").alias("knn_confidence"), F.lit("none").alias("source"),
        )
    if clusters is not None:
        rows = cluster_consensus(rows, clusters)
    return alignment_fallback(rows, hits) if hits is not None else rows


def tiebreak(
    assign: DataFrame, species_confidence: float = SPECIES_CONFIDENCE, min_identity: float = IDENTITY_MIN
) -> DataFrame:
    """Which of neighbour vote and alignment decides, why, and whether they disagree."""
    knn = F.when(F.col("knn_rank") == "species", F.col("knn_label"))
    ident, conf = F.col("blast_identity"), F.col("knn_confidence")
    rules = [
        (ident >= min_identity, "blast", f"blast_identity>={min_identity}"),
        (conf >= species_confidence, "knn", f"knn_confidence>={species_confidence}"),
        (ident.isNotNull(), "blast", "blast_identity_fallback"),
        (conf.isNotNull(), "knn", "knn_confidence_fallback"),
    ]
    conflict = (knn != "") & (F.col("blast_label") != "") & (F.trim(knn) != F.trim("blast_label"))
    return assign.select(
        "*",
        first_match([(c, w) for c, w, _ in rules], "unknown").alias("tiebreak_winner"),
        first_match([(c, why) for c, _, why in rules], "insufficient_evidence").alias("tiebreak_reason"),
        knn.alias("knn_species"),
        F.col("blast_label").alias("blast_species"),
        F.coalesce(conflict, F.lit(False)).alias("conflict_flag"),
    )


def conflicts(assign: DataFrame, columns: list[str] | None = None) -> DataFrame:
    found = assign.filter("conflict_flag")
    return found.select(*columns) if columns else found


# Classifier settings.
FOREST_TREES, TRAIN_SHARE = 100, 0.8


def train_taxon_classifier(
    vectors: DataFrame, label: str = "label", key: str = "vec_id", trees: int = FOREST_TREES, share: float = TRAIN_SHARE, seed: int = 42
):
    """Random forest on vectors: (model, held-out rows).

    Rows go to training by a hash of their id, which takes the same share of every label.
    """
    rows = vectors.select(
        key, F.col(label).cast("string").alias("taxon"), array_to_vector(as_doubles(F.col("embedding"))).alias("features")
    )
    train = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    stages = [
        StringIndexer(inputCol="taxon", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, seed=seed),
    ]
    return Pipeline(stages=stages).fit(rows.filter(train)), rows.filter(~train)


def predict_taxa(model, vectors: DataFrame, key: str = "vec_id", top: int = 3) -> DataFrame:
    """The `top` taxa per vector with their probabilities."""
    names = model.stages[0].labels
    rows = vectors.select(key, array_to_vector(as_doubles(F.col("embedding"))).alias("features"))
    prob = model.stages[1].transform(rows).select(key, vector_to_array("probability").alias("p"))
    taxa = F.array(*[F.lit(n) for n in names])
    ranked = F.array_sort(
        F.transform(F.slice("p", 1, len(names)), lambda p, i: F.struct((-F.round(p, 9)).alias("q"), F.get(taxa, i).alias("taxon")))
    )
    flat = prob.select(key, F.posexplode(F.slice(ranked, 1, top)).alias("position", "x"))
    return flat.select(key, (F.col("position") + 1).alias("position"), F.col("x.taxon").alias("taxon"), (-F.col("x.q")).alias("probability"))


def classifier_report(model, held: DataFrame) -> DataFrame:
    """Precision, recall and F1 per taxon with the overall accuracy on held-out rows."""
    names = F.array(*[F.lit(n) for n in model.stages[0].labels])
    out = model.transform(held).select("taxon", F.get(names, F.col("prediction").cast("int")).alias("predicted"))
    pairs = out.groupBy("taxon", "predicted").agg(F.count(F.lit(1)).alias("n"))
    right = F.col("taxon") == F.col("predicted")
    actual = pairs.groupBy("taxon").agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)).alias("hits"))
    guessed = pairs.groupBy(F.col("predicted").alias("taxon")).agg(F.sum("n").alias("guesses"))
    total = pairs.agg((F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)) / F.sum("n")).alias("accuracy"))
    both = actual.join(guessed, "taxon", "left").join(F.broadcast(total))  # one row
    p, r = ratio(F.col("hits"), F.col("guesses"), 0.0), ratio(F.col("hits"), F.col("support"), 0.0)
    return both.select("taxon", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r, 0.0).alias("f1"), "accuracy")
