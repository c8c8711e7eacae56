"""Taxonomy trees, lineage resolution over several sources, and lineage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.headers import organism_name
from estuarine.functions.mathx import ratio
from estuarine.operators.ranks import RANKS, present_ranks
from estuarine.operators.reads import dedupe_reads
from estuarine.operators.textjoin import first_containing
from estuarine.session import materialize
from estuarine.sources.tables import LINEAGE_RANKS

# All ranks, root-most first.
ALL_RANKS = [
    "superkingdom", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "superclass",
    "class", "subclass", "infraclass", "superorder", "order", "suborder", "infraorder", "parvorder",
    "superfamily", "family", "subfamily", "tribe", "subtribe", "genus", "subgenus", "species group",
    "species subgroup", "species", "subspecies", "varietas", "forma",
]

# Weight of each evidence source, and of any other one.
EVIDENCE_WEIGHTS = {
    "ncbi_taxdump": 1.0,
    "silva": 0.9,
    "pr2": 0.9,
    "unite": 0.9,
    "gtdb": 0.8,
    "blast_hit": 0.7,
    "ml_prediction": 0.6,
    "knn_consensus": 0.8,
    "manual_curation": 0.95,
    "custom_database": 0.5,
}
OTHER_WEIGHT = 0.5

def tree_paths(nodes: DataFrame) -> DataFrame:
    """(taxid, path): the node and its ancestors, itself first, from (taxid, parent, rank, name).

    Each round doubles the climbed distance, so a tree of depth d takes log2(d) joins.
    Finished rows leave the join; a parent matches one row only, so a popular
    ancestor is split by the adaptive skew join. A node that comes up again in its own
    path lies on a cycle, which is an error in the tree.
    """
    own = F.array(F.struct("taxid", "rank", "name"))
    up = F.when(F.col("parent") != F.col("taxid"), F.col("parent"))
    state = materialize(nodes.select("taxid", own.alias("path"), up.alias("up")))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        ahead = state.select(F.col("taxid").alias("up"), F.col("path").alias("more"), F.col("up").alias("next"))
        moved = (
            state.filter(F.col("up").isNotNull())
            .join(ahead, "up", "left")
            .select(
                "taxid",
                F.concat("path", F.coalesce("more", F.array().cast(state.schema["path"].dataType))).alias("path"),
                F.col("next").alias("up"),
            )
        )
        state = materialize(state.filter(F.col("up").isNull()).unionByName(moved))
        again = F.exists(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda x: x["taxid"] == F.col("taxid"))
        if found := state.filter(again).select("taxid").first():
            raise ValueError(f"the tree has a cycle through {found['taxid']}")
    return state.select("taxid", "path")


def _at_rank(rank: str, last: bool = False) -> Column:
    named = F.filter(
        "path", lambda x: (F.lower(F.trim(x["rank"])) == rank) & x["name"].isNotNull()
    )
    return F.get(F.reverse(named) if last else named, 0)["name"]


def main_lineages(paths: DataFrame) -> DataFrame:
    """Seven main ranks per taxid; the name nearest to the taxon is kept."""
    return paths.select("taxid", *[_at_rank(r).alias(r) for r in RANKS])


def _current_ids(ids: DataFrame, merged: DataFrame | None) -> DataFrame:
    if merged is None:
        return ids.withColumn("current_taxid", F.col("taxid"))
    new = merged.select(F.col("old_taxid").alias("taxid"), F.col("taxid").alias("__new"))
    return ids.join(new, "taxid", "left").select("*", F.coalesce("__new", "taxid").alias("current_taxid")).drop("__new")


def resolve_by_taxid(ids: DataFrame, lineages: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Main ranks of taxids; merged ids first become their successors."""
    known = lineages.withColumnRenamed("taxid", "current_taxid")
    return _current_ids(ids, merged).join(known, "current_taxid", "left")


def resolve_by_name(
    names: DataFrame, lineages: DataFrame, scientific: DataFrame, merged: DataFrame | None = None
) -> DataFrame:
    """Main ranks of names, compared without case; a name without species becomes the species."""
    table = scientific.groupBy(F.lower("name").alias("__k")).agg(F.min("taxid").alias("taxid"))
    ids = names.withColumn("__k", F.lower("name")).join(table, "__k", "left").drop("__k")
    out = resolve_by_taxid(ids, lineages, merged)
    return out.withColumn("species", F.coalesce("species", "name"))


def resolve_enhanced(ids: DataFrame, paths: DataFrame, scientific: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Extended lineage per taxid: all ranks as a map (root-most name wins), evidence, reference.

    Common names and synonyms stay in their own long table (`taxon_names`), since one
    taxon may own very many.
    """
    named = F.filter(
        F.transform(F.reverse("path"), lambda x: F.struct(F.lower(F.trim(x["rank"])).alias("k"), x["name"].alias("v"))),
        lambda e: e["k"].isin(*ALL_RANKS) & e["v"].isNotNull(),
    )
    # walking from the root, the first entry of a rank stays
    once = F.filter(
        named,
        lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda p: p["k"] == e["k"]),
    )
    known = paths.select(F.col("taxid").alias("current_taxid"), F.map_from_entries(once).alias("lineage"))
    sci = scientific.select(F.col("taxid").alias("current_taxid"), F.col("name").alias("scientific_name"))
    out = _current_ids(ids, merged).join(known, "current_taxid", "left").join(sci, "current_taxid", "left")
    found = F.col("lineage").isNotNull()
    return out.select(
        "taxid",
        "current_taxid",
        "scientific_name",
        "lineage",
        F.when(found, 1.0).otherwise(0.0).alias("confidence"),
        F.when(
            found,
            F.array(
                F.struct(
                    F.lit("ncbi_taxdump").alias("source"),
                    F.lit(1.0).alias("confidence"),
                    F.lit("taxonomy dump traversal").alias("method_details"),
                )
            ),
        ).alias("evidence"),
        F.when(
            found,
            F.array(F.struct(F.lit("NCBI").alias("database"), F.col("current_taxid").cast("string").alias("identifier"))),
        ).alias("external_refs"),
    )


# Name classes that count as common names and synonyms.
COMMON_CLASSES = ["common name", "genbank common name"]
SYNONYM_CLASSES = ["synonym", "equivalent name", "anamorph"]


def taxon_names(names: DataFrame) -> DataFrame:
    """(taxid, kind, name): distinct common names and synonyms."""
    kind = F.when(F.col("name_class").isin(*COMMON_CLASSES), "common").when(
        F.col("name_class").isin(*SYNONYM_CLASSES), "synonym"
    )
    return names.select("taxid", kind.alias("kind"), "name").filter(F.col("kind").isNotNull()).distinct()


def search_common_name(names: DataFrame, query: str, scientific: DataFrame) -> DataFrame:
    """Taxa with a common name holding the text, once each."""
    hits = taxon_names(names).filter((F.col("kind") == "common") & F.lower("name").contains(query.lower()))
    return hits.groupBy("taxid").agg(F.min("name").alias("common_name")).join(
        scientific.select("taxid", F.col("name").alias("scientific_name")), "taxid", "left"
    )


def taxdump_stats(nodes: DataFrame, names: DataFrame, merged: DataFrame) -> DataFrame:
    """(statistic, item, n): table sizes, taxa with common names and synonyms, nodes per rank."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("statistic"), F.lit("").alias("item"), "n"
    )
    kinds = taxon_names(names).select("taxid", "kind").distinct()
    parts = [
        one(nodes, "total_nodes"),
        one(names.filter(F.col("name_class") == "scientific name"), "total_names"),
        one(kinds.filter("kind = 'common'"), "with_common_names"),
        one(kinds.filter("kind = 'synonym'"), "with_synonyms"),
        one(merged, "merged_taxids"),
        nodes.groupBy(F.col("rank").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("rank").alias("statistic"), "item", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence_weight(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EVIDENCE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(OTHER_WEIGHT))


def lineage_confidence(evidence: DataFrame, key: str) -> DataFrame:
    """Weighted mean confidence from (key, source, confidence)."""
    w = evidence_weight(F.col("source"))
    return evidence.groupBy(key).agg(
        (F.sum(F.col("confidence") * w) / F.sum(w)).alias("confidence"), F.count(F.lit(1)).alias("evidence_count")
    )


def resolve_multi(
    ids: DataFrame, sources: DataFrame, key: str = "name", prefer: str | None = None, partial: str | None = "silva"
) -> DataFrame:
    """Merge the lineages of several sources per wanted name.

    Sources rank by preference, then priority. The first is the base; empty ranks are
    filled in that order; a source of higher priority than the base overrides its
    ranks. `partial` names the source that also matches by substring. A name has at
    most one row per source, so candidates are few by construction.
    """
    cols = ["taxid", "scientific_name", *LINEAGE_RANKS, "confidence"]
    table = sources.groupBy("source", "priority", "taxon_key").agg(F.max(F.struct(*cols)).alias("r"))
    table = table.select("source", "priority", "taxon_key", "r.*")
    wanted = ids.select(F.col(key).alias("__id"), F.lower(key).alias("taxon_key")).distinct()
    exact = wanted.join(table, "taxon_key")
    if partial:
        part = table.filter(F.col("source") == partial)
        missed = wanted.join(part.select("taxon_key"), "taxon_key", "left_anti")
        found = first_containing(missed.select("__id"), "__id", part, "taxon_key", "taxon_key")
        exact = exact.unionByName(found.select(*exact.columns))
    at = F.struct(
        (F.col("source") != F.lit(prefer or "")).alias("__other"), (-F.col("priority")).alias("__p"), F.col("source")
    )
    row = F.struct(at.alias("at"), "source", "priority", *cols)
    grouped = exact.groupBy("__id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    base = F.get("c", 0)
    higher = F.filter("c", lambda x: x["priority"] > base["priority"])

    def settle(rank: str) -> Column:
        over = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(higher, lambda x: x[rank].isNotNull()), lambda x: x[rank])), -1)
        fill = F.get(F.filter("c", lambda x: x[rank].isNotNull()), 0)[rank]
        return F.coalesce(over, fill)

    weight = lambda x: evidence_weight(F.when(x["source"] == "custom", "custom_database").otherwise(x["source"]))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + weight(x))
    score = F.aggregate("c", F.lit(0.0), lambda a, x: a + weight(x) * x["confidence"])
    conflicts = F.array_compact(
        F.array(
            *[
                F.when(
                    base[r].isNotNull() & (settle(r) != base[r]),
                    F.struct(F.lit(r).alias("rank"), base[r].alias("old"), settle(r).alias("new")),
                )
                for r in LINEAGE_RANKS
            ]
        )
    )
    return grouped.select(
        F.col("__id").alias(key),
        base["scientific_name"].alias("scientific_name"),
        base["taxid"].alias("taxid"),
        *[settle(r).alias(r) for r in LINEAGE_RANKS],
        F.transform("c", lambda x: x["source"]).alias("sources"),
        (score / total).alias("confidence"),
        (F.size("c") > 1).alias("reconciled"),
        conflicts.alias("conflicts"),
    )


def search_sources(sources: DataFrame, query: str, limit: int) -> DataFrame:
    """Names holding the text, best source first."""
    hits = sources.filter(F.col("taxon_key").contains(query.lower()))
    return hits.select("source", "priority", "taxon_key", "scientific_name").distinct().orderBy(
        F.desc("priority"), F.asc("taxon_key")
    ).limit(limit)


def apply_overrides(lineages: DataFrame, overrides: DataFrame, key: str = "scientific_name") -> DataFrame:
    """A user's row replaces all ranks of the taxon it names."""
    ranks = present_ranks(lineages)
    ov = overrides.select(
        F.lower(key).alias("__k"),
        F.lit(True).alias("overridden"),
        *[(F.col(r) if r in overrides.columns else F.lit(None).cast("string")).alias(f"__{r}") for r in ranks],
    )
    joined = lineages.withColumn("__k", F.lower(key)).join(ov, "__k", "left")
    flag = F.coalesce("overridden", F.lit(False))
    return joined.select(
        *[F.when(flag, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in ranks else F.col(c) for c in lineages.columns],
        flag.alias("overridden"),
    )


def source_statistics(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source").agg(
        F.max("priority").alias("priority"),
        F.count(F.lit(1)).alias("loaded_rows"),
        F.countDistinct("taxon_key").alias("distinct_taxa"),
    )


def lookup_lineage(
    ids: DataFrame, lineages: DataFrame, scientific: DataFrame, multi: DataFrame, merged: DataFrame | None = None, key: str = "identifier"
) -> DataFrame:
    """Batch lookup: digits as taxid, else as name; unresolved ones fall back to other sources.

    `multi` holds (name, ranks) as made by `resolve_multi`.
    """
    digits = F.col(key).rlike("^[0-9]+$")
    table = scientific.groupBy(F.lower("name").alias("__k")).agg(F.min("taxid").alias("__t"))
    ids = ids.withColumn("__k", F.lower(key)).join(table, "__k", "left")
    ids = ids.withColumn("taxid", F.when(digits, F.expr(f"try_cast({key} AS BIGINT)")).otherwise(F.col("__t")))
    tree = resolve_by_taxid(ids.drop("__t"), lineages, merged)
    found = reduce(lambda a, b: a | b, [F.col(r).isNotNull() for r in RANKS])
    other = multi.select(F.lower("name").alias("__k"), *[F.col(r).alias(f"__{r}") for r in RANKS], F.lit(True).alias("__m"))
    both = tree.join(other, "__k", "left")
    source = F.when(found, "tree").when(F.col("__m"), "sources").when(~digits, "name").otherwise("none")
    rank = lambda r: F.when(found, F.col(r)).otherwise(F.col(f"__{r}"))
    cols = {r: rank(r) for r in RANKS}
    cols["species"] = F.coalesce(cols["species"], F.when(~digits, F.col(key)))
    return both.select(key, *[c.alias(r) for r, c in cols.items()], source.alias("resolved_by"))


def align_labels(reads: DataFrame, labels: DataFrame, fallback: str = "description") -> DataFrame:
    """Reads with their label columns; a missing species falls back to the description."""
    out = reads.join(labels, "sequence_id", "left")
    return out.withColumn("species", F.coalesce("species", fallback))


def attach_names(reads: DataFrame, table: DataFrame) -> DataFrame:
    """Organism name per read: exact id in the table, else a table name holding the id, else the header.

    `table` has sequence_id, name and a position column `pos`.
    """
    ids = reads.select("sequence_id").distinct()
    exact = table.groupBy("sequence_id").agg(F.min_by("name", "pos").alias("__exact"))
    named = ids.join(exact.hint("merge"), "sequence_id", "left").withColumn("__id", F.col("sequence_id").cast("string"))
    missed = named.filter(F.col("__exact").isNull()).select("__id")
    held = first_containing(missed, "__id", table.select("name", "pos"), "name", "pos")
    held = held.select("__id", F.col("name").alias("__held"))
    # only ids and names until here; the names grow with the reads, so none of them is broadcast
    found = named.join(held.hint("merge"), "__id", "left").select("sequence_id", F.coalesce("__exact", "__held").alias("__found"))
    out = reads.withColumn("__header", organism_name(F.col("description"))).join(found.hint("merge"), "sequence_id", "left")
    return out.select(*reads.columns, F.coalesce("__found", "__header").alias("name"))


def prepare_references(
    sources: list[DataFrame], table: DataFrame, lineages: DataFrame, scientific: DataFrame, max_n: float = 0.1
) -> DataFrame:
    """Reference sequences: union of sources, first copy of each sequence, name, taxid, ranks."""
    union = reduce(lambda a, b: a.unionByName(b), sources)
    named = attach_names(dedupe_reads(union, max_n=max_n), table)
    out = resolve_by_name(named, lineages, scientific)
    return out.select(
        "sequence_id", "name", F.coalesce("taxid", F.lit(0).cast("long")).alias("taxid"), *RANKS
    )


def lineage_statistics(lineages: DataFrame, evidence: DataFrame, refs: DataFrame) -> DataFrame:
    """Tidy (section, item, n, value): totals, coverage per rank, evidence and reference counts."""
    ranks = present_ranks(lineages)
    agg = lineages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("taxid").alias("with_taxid"),
        F.avg("confidence").alias("conf"),
        *[F.count(r).alias(f"r_{r}") for r in ranks],
    )
    n = F.col("total")
    cell = lambda s, i, k, v: F.struct(
        F.lit(s).alias("section"), F.lit(i).alias("item"), k.alias("n"), v.cast("double").alias("value")
    )
    none = F.lit(None)
    cells = [
        cell("totals", "total_lineages", n, none),
        cell("totals", "with_taxid", F.col("with_taxid"), none),
        cell("totals", "avg_confidence", n, F.col("conf")),
        *[cell("rank_coverage", r, F.col(f"r_{r}"), ratio(F.col(f"r_{r}") * 100, n, 0.0)) for r in ranks],
    ]
    by_source = evidence.groupBy(F.col("source").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    out = agg.select(F.inline(F.array(*cells)))
    out = out.unionByName(by_source.select(F.lit("evidence").alias("section"), "item", "n", none.cast("double").alias("value")))
    total_refs = refs.agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(
        total_refs.select(F.lit("totals").alias("section"), F.lit("external_refs").alias("item"), "n", none.cast("double").alias("value"))
    )


def lineage_tree(lineages: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Tree nodes (path, parent, rank, name) with taxa, highest confidence and evidence sources.

    Equal lineages are folded before their path prefixes are spread out. The set of
    evidence sources is bounded by the known sources.
    """
    ranks = present_ranks(lineages)
    sources = evidence.groupBy(key).agg(F.collect_set("source").alias("src"))
    folded = (
        lineages.join(sources, key, "left")
        .groupBy(*ranks)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("confidence").alias("conf"),
            F.array_distinct(F.flatten(F.collect_set("src"))).alias("src"),
        )
    )
    steps = F.array_compact(
        F.array(*[F.when(F.col(r).isNotNull(), F.struct(F.lit(r).alias("rank"), F.col(r).alias("name"))) for r in ranks])
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("steps")),
        lambda i: F.struct(
            F.array_join(F.transform(F.slice("steps", 1, i), lambda s: s["name"]), ";").alias("path"),
            F.array_join(F.transform(F.slice("steps", 1, i - 1), lambda s: s["name"]), ";").alias("parent"),
            F.element_at("steps", i)["rank"].alias("rank"),
            F.element_at("steps", i)["name"].alias("name"),
        ),
    )
    spread = folded.withColumn("steps", steps).filter(F.size("steps") > 0).select("n", "conf", "src", F.inline(prefixes))
    return spread.groupBy("path", "parent", "rank", "name").agg(
        F.sum("n").alias("n_taxa"),
        F.max("conf").alias("max_confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("src")))).alias("evidence_sources"),
    )


def confidence_matrix(lineages: DataFrame, key: str) -> DataFrame:
    """Confidence at every main rank, 0 where the rank is missing."""
    ranks = present_ranks(lineages)
    return lineages.select(
        key, *[F.when(F.coalesce(r, F.lit("")) != "", F.col("confidence")).otherwise(0.0).alias(r) for r in ranks]
    )
