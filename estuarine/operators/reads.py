"""Filters, trimming, deduplication and profiles of sequence reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.functions.mathx import first_match, ratio
from estuarine.functions.adapters import without_adapters
from estuarine.functions.sequences import (
    MARKER_GENES,
    exact_base_rank,
    kmer_windows,
    kmers,
    letter_count,
    marker_gene,
    mean_phred,
    n_fraction,
)
from estuarine.operators.ordered import exact_quantiles, ranked, top_per_group, value_counts

# Filter defaults and adapter sequences.
MIN_LENGTH, MAX_LENGTH = 50, 500
QUALITY, MAX_N = 20.0, 5
ADAPTERS = ["AGATCGGAAGAGC", "CTGTCTCTTATA"]


def _has_qual(df: DataFrame) -> bool:
    return "qual" in df.columns


def _criteria(df: DataFrame, min_len: int, max_len: int, quality: float, max_n: int) -> dict[str, Column]:
    seq = F.col("seq")
    good = F.lit(True)
    if _has_qual(df):
        good = F.coalesce(mean_phred(F.col("qual")) >= quality, F.lit(True))
    return {
        "length": F.length(seq).between(min_len, max_len),
        "quality": good,
        "n": letter_count(seq, "N") <= max_n,
    }


def quality_filter(
    reads: DataFrame,
    min_len: int = MIN_LENGTH,
    max_len: int = MAX_LENGTH,
    quality: float = QUALITY,
    max_n: int = MAX_N,
) -> DataFrame:
    """Reads passing length, N count (upper-case N only) and, where known, mean quality."""
    tests = _criteria(reads, min_len, max_len, quality, max_n)
    return reads.filter(tests["length"] & tests["n"] & tests["quality"])


def filter_stats(
    reads: DataFrame,
    by: str = "sample_id",
    min_len: int = MIN_LENGTH,
    max_len: int = MAX_LENGTH,
    quality: float = QUALITY,
    max_n: int = MAX_N,
) -> DataFrame:
    """How many reads pass each criterion on its own and all together."""
    t = _criteria(reads, min_len, max_len, quality, max_n)
    every = t["length"] & t["n"] & t["quality"]
    return reads.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.count_if(t["length"]).alias("passed_length"),
        F.count_if(t["quality"]).alias("passed_quality"),
        F.count_if(t["n"]).alias("passed_n_filter"),
        F.count_if(every).alias("final_passed"),
        F.avg(every.cast("double")).alias("pass_rate"),
    )


def edna_filter(
    reads: DataFrame, source: str = "sample_id", order: str = "sequence_id", max_n: float = 0.1
) -> DataFrame:
    """Length, quality and N-share filter; survivors are renumbered per source from 0."""
    length = F.length("seq")
    keep = length.between(MIN_LENGTH, MAX_LENGTH) & (n_fraction(F.col("seq")) <= max_n)
    if _has_qual(reads):
        keep = keep & F.coalesce(mean_phred(F.col("qual")) >= QUALITY, F.lit(True))
    numbered = ranked(reads.filter(keep), [source], [F.col(order)], "__i")
    name = F.concat(F.lit("SRA_"), F.col(source), F.lit("_"), (F.col("__i") - 1).cast("string"))
    return numbered.withColumn("read_name", name).drop("__i")


def adapter_pattern(adapters: list[str], min_overlap: int = 3) -> str:
    """Whole adapter anywhere, or a prefix of at least `min_overlap` at the read end."""
    whole = "|".join(f"{a}.*" for a in adapters)
    ends = sorted(
        {a[:k] for a in adapters for k in range(min_overlap, len(a))}, key=lambda p: (-len(p), p)
    )
    return f"(?:{whole}|(?:{'|'.join(ends)}))$"


def quality_cut(qual: Column, cutoff: int = 20) -> Column:
    """Length kept after 3' quality trimming.

    Walking from the end, the sum of (cutoff - q) is followed until it turns
    negative; the read is cut where the sum was largest.
    """
    n = F.size(qual)
    start = F.struct(
        F.lit(0).cast("long").alias("total"),
        F.lit(0).cast("long").alias("best"),
        n.alias("keep"),
        n.alias("at"),
        F.lit(False).alias("over"),
    )

    def walk(acc: Column, q: Column) -> Column:
        total = acc["total"] + (F.lit(cutoff) - q)
        over = acc["over"] | (total < 0)
        better = ~over & (total > acc["best"])
        at = acc["at"] - 1
        return F.struct(
            total.alias("total"),
            F.when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, at).otherwise(acc["keep"]).alias("keep"),
            at.alias("at"),
            over.alias("over"),
        )

    return F.aggregate(F.reverse(qual), start, walk, lambda acc: acc["keep"])


def trimmed(
    reads: DataFrame, adapters: list[str] | None = None, passes: int = 2, error_rate: float = 0.1, min_overlap: int = 3
) -> DataFrame:
    """All reads after the 3' quality cut, where qualities exist, and up to `passes` adapter removals.

    A removal cuts at the best match with at most `error_rate` edits per adapter base; with an `error_rate` of 0, at the first
    whole adapter or longest ending.
    """
    adapters = adapters or ADAPTERS
    out = reads
    if _has_qual(reads):
        out = out.withColumn("__keep", quality_cut(F.col("qual"))).withColumn(
            "seq", F.col("seq").substr(F.lit(1), F.col("__keep"))
        )
    seq = F.col("seq")
    if error_rate:
        seq = seq.substr(F.lit(1), without_adapters(seq, adapters, error_rate, min_overlap, passes))
    else:
        pattern = adapter_pattern(adapters, min_overlap)
        for _ in range(passes):
            seq = F.regexp_replace(seq, pattern, "")
    out = out.withColumn("seq", seq)
    if _has_qual(reads):
        out = out.withColumn("qual", F.slice("qual", F.lit(1), F.length("seq"))).drop("__keep")
    return out


def trim_adapters(
    reads: DataFrame, adapters: list[str] | None = None, min_len: int = 50, passes: int = 2, error_rate: float = 0.1
) -> DataFrame:
    """Reads as `trimmed`, without those that are shorter than `min_len` then."""
    return trimmed(reads, adapters, passes, error_rate).filter(F.length("seq") >= min_len)


def dedupe_reads(
    reads: DataFrame, order: str = "sequence_id", min_len: int = 60, max_n: float = 0.1
) -> DataFrame:
    """First occurrence of every distinct sequence among long, unambiguous reads.

    min_by combines before the shuffle, so copies of one sequence never meet in a task.
    """
    kept = reads.filter((F.length("seq") >= min_len) & (n_fraction(F.col("seq")) <= max_n))
    rest = [c for c in reads.columns if c != "seq"]
    return (
        kept.groupBy("seq")
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("__first"))
        .select(*[F.col(f"__first.{c}").alias(c) if c != "seq" else F.col("seq") for c in reads.columns])
    )


def dereplicate(reads: DataFrame, order: str = "sequence_id", by: str | None = None) -> DataFrame:
    """Distinct sequences with their size and representative."""
    keys = ([by] if by else []) + ["seq"]
    return reads.groupBy(*keys).agg(
        F.min(order).alias("representative"), F.count(F.lit(1)).alias("size")
    )


def extract_markers(reads: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """Reads with the first marker gene they mention; the others are dropped."""
    gene = marker_gene(F.col("description"), F.col("seq"), genes)
    return reads.withColumn("marker", gene).filter(F.col("marker").isNotNull())


def accession_summary(
    reads: DataFrame, by: str = "sample_id", genes: list[str] | None = None
) -> DataFrame:
    """Processed reads and reads per marker gene of each accession."""
    genes = genes or MARKER_GENES
    gene = marker_gene(F.col("description"), F.col("seq"), genes)
    return reads.groupBy(by).agg(
        F.count(F.lit(1)).alias("processed_sequences"),
        *[F.count_if(gene == g).alias(f"marker_{g}") for g in genes],
    )


def accession_report(reads: DataFrame, by: str = "sample_id") -> DataFrame:
    """Base counts, total bases, length and quality spread per accession."""
    quality = mean_phred(F.col("qual")) if _has_qual(reads) else F.lit(None).cast("double")
    lean = reads.select(by, "seq", F.length("seq").alias("__len"), quality.alias("__q"))
    base = lean.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.min("__len").alias("min_length"),
        F.max("__len").alias("max_length"),
        F.avg("__len").alias("mean_length"),
        F.sum("__len").alias("total_bases"),
        *[F.sum(letter_count(F.col("seq"), b)).alias(f"count_{b}") for b in "ATCGN"],
        F.avg("__q").alias("mean_quality"),
        F.min("__q").alias("min_quality"),
        F.max("__q").alias("max_quality"),
    )
    return base.join(_length_quantiles(reads, by, {"median_length": 0.5}), by)


def _length_quantiles(reads: DataFrame, by: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles from length counts: at most one row per length and group."""
    counted = value_counts(reads.select(by, F.length("seq").alias("len")), [by], "len")
    return counted.groupBy(by).agg(
        *[F.percentile("len", F.lit(p), F.col("freq")).alias(name) for name, p in probs.items()]
    )


def length_stats(reads: DataFrame, by: str = "sample_id") -> DataFrame:
    """Count, range, mean, population deviation and percentiles of the lengths."""
    counted = value_counts(reads.select(by, F.length("seq").alias("len")), [by], "len")
    x, f = F.col("len").cast("double"), F.col("freq")
    mean = F.sum(x * f) / F.sum(f)
    pct = {"p25": 0.25, "median_length": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return counted.groupBy(by).agg(
        F.sum(f).alias("total_sequences"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
        mean.alias("mean_length"),
        F.sqrt(F.greatest(F.sum(x * x * f) / F.sum(f) - mean * mean, F.lit(0.0))).alias("std_length"),
        *[F.percentile("len", F.lit(p), f).alias(name) for name, p in pct.items()],
    )


_COUNTED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*-."


def character_counts(reads: DataFrame, by: str = "sample_id") -> DataFrame:
    """(group, character, n) over upper-cased sequences.

    Letters and gap signs are counted by one projection of sums; only characters
    outside that alphabet are exploded.
    """
    seq = F.upper("seq")
    sums = reads.groupBy(by).agg(
        *[F.sum(letter_count(seq, c)).alias(f"c{i}") for i, c in enumerate(_COUNTED)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("character"), F.col(f"c{i}").alias("n"))
            for i, c in enumerate(_COUNTED)
        ]
    )
    known = sums.select(by, F.inline(pairs)).filter(F.col("n") > 0)
    rest = F.translate(seq, _COUNTED, "")
    other = (
        reads.filter(F.length(rest) > 0)
        .select(by, F.explode(F.split(rest, "")).alias("character"))
        .groupBy(by, "character")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return known.unionByName(other)


def composition(reads: DataFrame, by: str = "sample_id", top: int = 10) -> DataFrame:
    """Most common characters with shares, unique characters and sequence type.

    A letter that is no nucleotide code makes the group a protein set.
    """
    counts = character_counts(reads, by)
    totals = counts.groupBy(by).agg(
        F.sum("n").alias("total_characters"),
        F.count(F.lit(1)).alias("unique_characters"),
        F.max(~F.col("character").isin(*"ATCGUN") & F.col("character").rlike("[A-Z]")).alias("aa"),
    )
    best = top_per_group(counts, [by], [F.desc("n"), F.asc("character")], top)
    return best.join(totals, by).select(
        by,
        "character",
        "n",
        (F.col("n").cast("double") / F.col("total_characters")).alias("share"),
        "total_characters",
        "unique_characters",
        F.when(F.col("aa"), "protein").otherwise("dna").alias("sequence_type"),
    )


def quality_summary(reads: DataFrame, by: str = "sample_id", low: float = 20.0) -> DataFrame:
    """Spread of the per-read mean quality and the number of low-quality reads."""
    rows = reads.select(by, mean_phred(F.col("qual")).alias("q")).filter(F.col("q").isNotNull())
    base = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("sequences_with_quality"),
        F.avg("q").alias("mean_quality"),
        F.min("q").alias("min_quality"),
        F.max("q").alias("max_quality"),
        F.stddev_pop("q").alias("std_quality"),
        F.count_if(F.col("q") < low).alias("low_quality_sequences"),
    )
    return base.join(exact_quantiles(rows, [by], "q", {"median_quality": 0.5}), by)


# Description keywords counted by the annotation summary.
DESCRIPTION_KEYWORDS = [
    "hypothetical", "putative", "uncharacterized", "fragment", "precursor", "partial",
]


def annotation_summary(
    reads: DataFrame, by: str = "sample_id", keywords: list[str] | None = None, top: int = 20
) -> DataFrame:
    """Tidy (group, section, item, n): organisms, description keywords, features, coverage."""
    words = keywords or DESCRIPTION_KEYWORDS
    text = F.lower("description")
    organism = F.coalesce("organism", F.lit("Unknown"))
    has_features = "feature_types" in reads.columns
    sums = {
        ("coverage", "with_organism"): F.count_if(organism != "Unknown"),
        ("coverage", "with_description"): F.count_if(F.length("description") > 0),
    }
    if has_features:
        sums[("coverage", "with_features")] = F.count_if(F.size("feature_types") > 0)
    sums |= {("keyword", w): F.count_if(text.contains(w)) for w in words}
    flat = reads.groupBy(by).agg(*[e.alias(f"m{i}") for i, e in enumerate(sums.values())])
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.lit(k).alias("item"), F.col(f"m{i}").alias("n"))
            for i, (s, k) in enumerate(sums)
        ]
    )
    out = flat.select(by, F.inline(pairs))
    counts = reads.groupBy(by, organism.alias("item")).agg(F.count(F.lit(1)).alias("n"))
    best = top_per_group(counts, [by], [F.desc("n"), F.asc("item")], top)
    out = out.unionByName(best.select(by, F.lit("organism").alias("section"), "item", "n"))
    if has_features:
        kinds = (
            reads.select(by, F.explode("feature_types").alias("item"))
            .groupBy(by, "item")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        out = out.unionByName(kinds.select(by, F.lit("feature").alias("section"), "item", "n"))
    return out


def organism_to_taxa(df: DataFrame, by: str, organism: str = "organism") -> DataFrame:
    """Genus and species counts parsed from organism names."""
    words = F.filter(
        F.split(F.translate(F.col(organism), "_\t\n", "   "), " "), lambda w: F.length(w) > 0
    )
    genus = F.when(F.size(words) >= 1, F.get(words, 0))
    species = F.when(F.size(words) >= 2, F.concat_ws(" ", F.get(words, 0), F.get(words, 1)))
    names = df.groupBy(by, organism).agg(F.count(F.lit(1)).alias("n"))
    both = names.select(
        by,
        "n",
        F.inline(
            F.array(
                F.struct(F.lit("genus").alias("rank"), genus.alias("taxon")),
                F.struct(F.lit("species").alias("rank"), species.alias("taxon")),
            )
        ),
    )
    return both.filter(F.col("taxon").isNotNull()).groupBy(by, "rank", "taxon").agg(
        F.sum("n").alias("n")
    )


# Habitat keywords in declared order.
HABITAT_KEYWORDS = {
    "marine": ["marine", "ocean", "sea", "seawater"],
    "freshwater": ["freshwater", "lake", "river", "pond"],
    "terrestrial": ["soil", "terrestrial", "land"],
    "brackish": ["brackish", "estuary", "estuarine"],
}


def habitat_keywords(
    reads: DataFrame, by: str = "sample_id", keywords: dict[str, list[str]] | None = None
) -> DataFrame:
    """Reads mentioning each habitat and the most mentioned one (declared order breaks ties)."""
    table = keywords or HABITAT_KEYWORDS
    text = F.lower("description")
    hits = reads.groupBy(by).agg(
        *[F.count_if(text.rlike("|".join(words))).alias(f"{h}_reads") for h, words in table.items()]
    )
    top = F.greatest(*[F.col(f"{h}_reads") for h in table], F.lit(0))
    best = first_match([((F.col(f"{h}_reads") == top) & (top > 0), h) for h in table], "unknown")
    return hits.withColumn("habitat", best)


def systematic_sample(df: DataFrame, n: int, order: str) -> DataFrame:
    """Every step-th row in `order`, at most `n`, with the factor that scales counts back."""
    placed = ranked(df, [], [F.col(order)], "__i")
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    step = F.greatest(F.floor(F.col("__total") / F.lit(n)), F.lit(1))
    at = F.col("__i") - 1
    size = F.least(F.lit(n), F.ceil(F.col("__total") / step))
    return (
        placed.join(F.broadcast(total))  # one row
        .filter((at % step == 0) & (at / step < n))
        .withColumn("scale_factor", F.col("__total").cast("double") / size)
        .drop("__i", "__total")
    )


def limit_reads(reads: DataFrame, n: int, order: str = "sequence_id") -> DataFrame:
    return reads.orderBy(order).limit(n)


def read_signature(reads: DataFrame, k: int = 6, top: int = 64, key: str = "sequence_id") -> DataFrame:
    """Signature: hash of the most frequent k-mers and their counts as sorted JSON text.

    Ties keep the k-mer seen first. The counting runs per distinct sequence on rows
    (sequence, k-mer), combined before the shuffle.
    """
    named = reads.select(key, F.trim(F.upper("seq")).alias("__s"))
    # equal sequences share one id; the k-mer rows carry that id, never the text
    unique = named.groupBy("__s").agg(F.min(key).alias("__id"))
    # a long sequence becomes many rows first, so that none holds all its k-mers
    parts = unique.select("__id", F.posexplode(kmer_windows(F.col("__s"), k)).alias("part", "__w"))
    rows = parts.select("__id", "part", F.posexplode(kmers(F.col("__w"), k)).alias("at", "kmer"))
    rows = rows.withColumn("pos", F.struct("part", "at"))
    counted = rows.groupBy("__id", "kmer").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")
    )
    best = top_per_group(counted, ["__id"], [F.desc("n"), F.asc("first")], top)
    entry = F.concat(F.lit('"'), "kmer", F.lit('": '), F.col("n").cast("string"))
    built = best.groupBy("__id").agg(
        F.array_sort(F.collect_list(F.struct("kmer", entry.alias("e")))).alias("__top")
    )
    body = F.concat(F.lit("{"), F.coalesce(F.array_join("__top.e", ", "), F.lit("")), F.lit("}"))
    signed = unique.join(built, "__id", "left").select(
        "__s", F.left(F.sha2(body, 256), F.lit(32)).alias("signature")
    )
    return named.join(signed, "__s").select(key, "signature")


def encode_kmers(reads: DataFrame, k: int, max_len: int, key: str = "sequence_id") -> DataFrame:
    """k-mer ids (lexicographic rank + 1, 0 pads) and mask, both of length `max_len`.

    A longer sequence gives several rows, numbered by `chunk`; a sequence without k-mers one. Long sequences are worked on
    in windows: the k-mers before each window are counted in the row, windows become rows, and only
    the chunks that lie across two windows are put together afterwards. `key` names the sequences.
    """
    words = lambda text: F.filter(kmers(text, k), lambda w: w.rlike("^[ACGT]+$"))
    windows = kmer_windows(F.coalesce(F.col("seq"), F.lit("")), k)
    counted = reads.select(key, windows.alias("__t")).withColumn("__n", F.transform("__t", lambda t: F.size(words(t)).cast("long")))
    added = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, n: x + n)
    placed = counted.select(key, "__n", added(F.col("__n")).alias("total"), F.posexplode("__t").alias("part", "text"))
    placed = placed.select(key, "total", "part", added(F.slice("__n", F.lit(1), F.col("part"))).alias("before"), words(F.col("text")).alias("words"))
    ids = placed.select(key, "total", "part", "before", F.transform("words", lambda w: exact_base_rank(w) + 1).alias("ids"))
    n, before = F.size("ids").cast("long"), F.col("before")
    first, last = F.floor(before / max_len), F.floor((before + n - 1) / max_len)

    def piece(c: Column) -> Column:
        start = F.greatest(c * max_len, before)
        size = F.least((c + 1) * max_len, before + n) - start
        return F.struct(c.alias("chunk"), F.slice("ids", (start - before + 1).cast("int"), size.cast("int")).alias("ids"))

    # a sequence without k-mers has one empty piece, in its first window
    empty = F.struct(F.lit(0).cast("long").alias("chunk"), F.array().cast("array<bigint>").alias("ids"))
    none = F.array().cast("array<struct<chunk: bigint, ids: array<bigint>>>")
    own = F.when(n > 0, F.transform(F.sequence(first, last), piece)).when((F.col("total") == 0) & (F.col("part") == 0), F.array(empty)).otherwise(none)
    pieces = ids.select(key, "total", "part", F.inline(own))
    whole = F.size("ids") == F.least(F.lit(max_len), F.col("total") - F.col("chunk") * max_len)
    across = pieces.filter(~whole).groupBy(key, "chunk").agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "ids")))["ids"]).alias("ids"))
    every = pieces.filter(whole).select(key, "chunk", "ids").unionByName(across)
    pad = lambda a, zero: F.slice(F.concat(a, F.array_repeat(zero, max_len)), 1, max_len)
    return every.select(
        key,
        "chunk",
        pad(F.col("ids"), F.lit(0).cast("long")).alias("input_ids"),
        pad(F.transform("ids", lambda _: F.lit(1)), F.lit(0)).alias("attention_mask"),
    )


def preprocess_steps(reads: DataFrame, by: str = "sample_id", min_len: int = 50, error_rate: float = 0.1, **limits: float) -> DataFrame:
    """Reads left after trimming and quality filter per source; each read is trimmed and judged once."""
    cut = trimmed(reads, error_rate=error_rate)
    long_ = F.coalesce(F.length("seq") >= min_len, F.lit(False))
    tests = _criteria(cut, **{"min_len": MIN_LENGTH, "max_len": MAX_LENGTH, "quality": QUALITY, "max_n": MAX_N, **limits})
    good = F.coalesce(long_ & tests["length"] & tests["n"] & tests["quality"], F.lit(False))
    out = cut.groupBy(by).agg(
        F.count(F.lit(1)).alias("input_reads"), F.count_if(long_).alias("after_trimming"), F.count_if(good).alias("after_quality")
    )
    return out.withColumn("kept_share", ratio(F.col("after_quality"), F.col("input_reads"), 0.0))
