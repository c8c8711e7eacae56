"""Readers and writers for label, taxonomy, vector and hit tables, and store copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estuarine.functions.mathx import first_match
from estuarine.operators.ranks import RANKS


def with_columns(df: DataFrame, names: list[str], kind: str = "string") -> DataFrame:
    """Add the missing ones of `names` as nulls."""
    return df.select("*", *[F.lit(None).cast(kind).alias(n) for n in names if n not in df.columns])


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV or TSV with a header; the separator follows the extension unless given."""
    if sep is None:
        sep = "\t" if path.lower().endswith((".tsv", ".txt")) else ","
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_labels(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Label table keyed by `sequence_id`; absent rank columns read as null."""
    df = read_delimited(spark, path, sep)
    if "sequence_id" not in df.columns:
        raise ValueError("label table needs a sequence_id column")
    return with_columns(df, RANKS)


# Label columns of training tables, first present wins.
LABEL_COLUMNS = ["label", "class", "taxonomy"]


def training_label(df: DataFrame) -> Column:
    """First known label column, else the table's second column (or its only one)."""
    for name in LABEL_COLUMNS:
        if name in df.columns:
            return F.col(name)
    return F.col(df.columns[min(1, len(df.columns) - 1)])


def _dump(spark: SparkSession, path: str) -> DataFrame:
    parts = F.transform(F.split("value", r"\|"), lambda p: F.trim(F.translate(p, "\t", " ")))
    return spark.read.text(path).select(parts.alias("p"), F.monotonically_increasing_id().alias("line"))


def read_taxdump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Taxonomy dump as `nodes`, `names` (all classes), `scientific`, `merged`.

    The first scientific name of a taxon wins.
    """
    at = lambda i: F.get("p", i)
    nodes = _dump(spark, f"{folder}/nodes.dmp").select(
        at(0).cast("long").alias("taxid"), at(1).cast("long").alias("parent"), at(2).alias("rank")
    )
    names = _dump(spark, f"{folder}/names.dmp").select(
        at(0).cast("long").alias("taxid"), at(1).alias("name"), at(3).alias("name_class"), "line"
    )
    scientific = (
        names.filter(F.col("name_class") == "scientific name")
        .groupBy("taxid")
        .agg(F.min_by("name", "line").alias("name"))
    )
    merged = _dump(spark, f"{folder}/merged.dmp").select(
        at(0).cast("long").alias("old_taxid"), at(1).cast("long").alias("taxid")
    )
    return {"nodes": nodes, "names": names.drop("line"), "scientific": scientific, "merged": merged}


def write_taxdump(nodes: DataFrame, folder: str) -> None:
    """Dump files from (taxid, parent, rank, name)."""
    row = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|"))
    t, p = F.col("taxid").cast("string"), F.col("parent").cast("string")
    nodes.select(row(t, p, F.col("rank"))).write.text(f"{folder}/nodes.dmp")
    nodes.select(row(t, F.col("name"), F.lit(""), F.lit("scientific name"))).write.text(
        f"{folder}/names.dmp"
    )
    nodes.limit(0).select(row(t, t)).write.text(f"{folder}/merged.dmp")


LINEAGE_RANKS = ["superkingdom", *RANKS]

# Taxonomy sources with their priorities.
SOURCE_PRIORITY = {"custom": 100, "silva": 90, "pr2": 85}


def as_lineages(df: DataFrame, source: str) -> DataFrame:
    """Bring a rank table to the common lineage columns, keyed by lower-case name."""
    df = with_columns(df, ["scientific_name", *LINEAGE_RANKS])
    df = with_columns(with_columns(df, ["taxid"], "long"), ["confidence"], "double")
    blank = lambda c: F.when(~F.trim(c).isin("", "nan"), F.trim(c))
    deepest = F.coalesce(*[blank(F.col(r)) for r in reversed(LINEAGE_RANKS)])
    name = F.coalesce(blank(F.col("scientific_name").cast("string")), deepest)
    return df.select(
        F.lit(source).alias("source"),
        F.lit(SOURCE_PRIORITY.get(source, 0)).alias("priority"),
        F.lower(name).alias("taxon_key"),
        name.alias("scientific_name"),
        F.col("taxid").cast("long").alias("taxid"),
        *[blank(F.col(r).cast("string")).alias(r) for r in LINEAGE_RANKS],
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.9)).alias("confidence"),
    ).filter(F.col("taxon_key").isNotNull())


def read_silva(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """`taxonomy` lineages `a;b;c`: domain, then phylum to species, named by `organism`."""
    df = read_delimited(spark, path, sep)
    steps = [r for r in LINEAGE_RANKS if r != "kingdom"]
    parts = F.transform(F.split("taxonomy", ";"), lambda x: F.trim(x))
    ranked = df.select("*", *[F.get(parts, i).alias(r) for i, r in enumerate(steps)])
    named = ranked.withColumnRenamed("organism", "scientific_name")
    return as_lineages(named.filter(F.col("taxonomy") != ""), "silva")


def read_pr2(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Rank-column table; a `domain` column stands in for a missing kingdom."""
    df = read_delimited(spark, path, sep)
    if "kingdom" not in df.columns and "domain" in df.columns:
        df = df.withColumnRenamed("domain", "kingdom")
    return as_lineages(df, "pr2")


def read_custom(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """User lineages from JSON records or CSV."""
    df = spark.read.option("multiLine", True).json(path) if fmt == "json" else read_delimited(spark, path, ",")
    return as_lineages(df, "custom")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector store: parquet partitioned by dataset and run."""
    df = spark.read.parquet(path)
    return with_columns(df, ["dataset", "run_id"])


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("dataset", "run_id").parquet(path)


# Columns of tabular alignment output.
HIT_COLUMNS = (
    "query_id string, subject_id string, identity double, align_length int, mismatches int, "
    "gap_opens int, q_start int, q_end int, s_start int, s_end int, evalue double, bit_score double, "
    "query_length int, title string"
)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Alignment hits from tab-separated output; `pos` orders them as in their files.

    Rows of a file are read in order, block by block, so the block's start and the row's
    place among the rows of its task give that order without a sort.
    """
    rows = spark.read.option("sep", "\t").schema(HIT_COLUMNS).csv(path)
    return rows.select("*", _place())


def _place() -> Column:
    """(file, start of the block, row in the task): sorts as the rows stand in their files."""
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos")


def read_hits_xml(spark: SparkSession, path: str) -> DataFrame:
    """First alignment and first segment of every query from XML output."""
    raw = spark.read.format("xml").option("rowTag", "Iteration").schema(
        "`Iteration_query-def` string, `Iteration_query-len` int, `Iteration_hits` struct<`Hit`: array<"
        "struct<`Hit_id`: string, `Hit_def`: string, `Hit_hsps`: struct<`Hsp`: array<struct<"
        "`Hsp_identity`: int, `Hsp_align-len`: int, `Hsp_query-from`: int, `Hsp_query-to`: int, "
        "`Hsp_evalue`: double, `Hsp_bit-score`: double>>>>>>"
    ).load(path)
    hit = F.get(F.col("Iteration_hits.Hit"), 0)
    hsp = F.get(hit["Hit_hsps"]["Hsp"], 0)
    return raw.select(
        F.col("Iteration_query-def").alias("query_id"),
        hit["Hit_id"].alias("subject_id"),
        hit["Hit_def"].alias("title"),
        (hsp["Hsp_identity"] * 100.0 / F.greatest(hsp["Hsp_align-len"], F.lit(1))).alias("identity"),
        hsp["Hsp_align-len"].alias("align_length"),
        hsp["Hsp_query-from"].alias("q_start"),
        hsp["Hsp_query-to"].alias("q_end"),
        hsp["Hsp_evalue"].alias("evalue"),
        hsp["Hsp_bit-score"].alias("bit_score"),
        F.col("Iteration_query-len").alias("query_length"),
        _place(),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options: str) -> None:
    """Table sink; list columns become `; ` text where the format has no lists."""
    if fmt == "csv":
        df = df.select(
            *[
                F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name)
                if f.dataType.typeName() == "array"
                else F.col(f.name)
                for f in df.schema
            ]
        )
        options = {"header": "true", **options}
    writer = df.write.format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_reports(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Report rows under year=/month= folders."""
    dated = df.select("*", F.year(ts).alias("year"), F.date_format(ts, "MM").alias("month"))
    dated.write.partitionBy("year", "month").parquet(path)


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs under root/dataset/run with artifact flags, newest first.

    Only the metadata of the files is read.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "modificationTime")
    )
    base = root.rstrip("/").rsplit("/", 1)[-1]
    parts = F.split(F.regexp_extract("path", rf"/{base}/(.*)$", 1), "/")
    files = listing.select(
        F.get(parts, 0).alias("dataset"),
        F.get(parts, 1).alias("run_id"),
        F.array_join(F.slice(parts, 3, 100), "/").alias("artifact"),
        "modificationTime",
    ).filter(F.col("artifact") != "")
    # The file that shows each stage was run.
    artifacts = {
        "pipeline": "pipeline_results.json",
        "taxonomy": "taxonomy/taxonomy_predictions.csv",
        "novelty": "novelty/novelty_analysis.json",
        "clustering": "clustering/cluster_assignments.csv",
    }
    return (
        files.groupBy("dataset", "run_id")
        .agg(
            F.max("modificationTime").alias("modified"),
            F.count(F.lit(1)).alias("artifacts"),
            *[F.max(F.col("artifact") == a).alias(f"has_{k}") for k, a in artifacts.items()],
        )
        .orderBy(F.desc("modified"), "dataset", "run_id")
    )


def coerce_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns to typed ones: `timestamp`, `json` (variant) or an array type.

    Text that cannot be parsed stays in `<column>_raw`.
    """
    out = df
    for name, kind in kinds.items():
        text = F.col(name)
        if kind == "timestamp":
            parsed = F.try_to_timestamp(text)
        elif kind == "json":
            parsed = F.try_parse_json(text)
        else:
            parsed = F.from_json(text, kind)
        out = out.withColumn(f"{name}_raw", F.when(parsed.isNull(), text)).withColumn(name, parsed)
    return out


def copy_missing(src: DataFrame, dst: DataFrame, key: list[str]) -> DataFrame:
    """Destination rows plus the source rows whose key it lacks."""
    fresh = src.join(dst.select(*key).distinct(), key, "left_anti")
    return dst.unionByName(fresh, allowMissingColumns=True)


def validate_copy(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Row counts of each table in two stores and whether they agree."""

    def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
        parts = [
            df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias("table_name"), name)
            for t, df in sorted(tables.items())
        ]
        return reduce(DataFrame.unionByName, parts)

    both = counts(a, "source_rows").join(counts(b, "target_rows"), "table_name", "full")
    zero = both.na.fill(0, ["source_rows", "target_rows"])
    return zero.withColumn("matches", F.col("source_rows") == F.col("target_rows"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Content hashes of whole files."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select(
            "path", "length", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"),
            F.sha2("content", 256).alias("sha256"),
        )
    )


# Identifier URL templates by database.
REFERENCE_URLS = {
    "NCBI": "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id={id}",
    "ITIS": "https://www.itis.gov/servlet/SingleRpt/SingleRpt?search_topic=TSN&search_value={id}",
    "GBIF": "https://www.gbif.org/species/{id}",
    "WoRMS": "https://www.marinespecies.org/aphia.php?p=taxdetails&id={id}",
    "EOL": "https://eol.org/pages/{id}",
    "BOLD": "https://www.boldsystems.org/index.php/Taxbrowser_Taxonpage?taxid={id}",
    "SILVA": "https://www.arb-silva.de/browser/ssu/silva/{id}",
    "PR2": "https://pr2-database.org/browse/{id}",
    "UNITE": "https://unite.ut.ee/bl_forw.php?id={id}",
    "GTDB": "https://gtdb.ecogenomic.org/taxon_overview?id={id}",
}
SEARCH_URL = "https://www.google.com/search?q={id}"


def reference_url(database: Column, identifier: Column) -> Column:
    """Link for an external identifier; unknown databases get a search link."""

    def filled(template: str, value: Column) -> Column:
        before, after = template.split("{id}")
        quoted = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
        return F.concat(F.lit(before), quoted, F.lit(after))

    rules = [
        (F.upper(database) == name.upper(), filled(template, identifier))
        for name, template in REFERENCE_URLS.items()
    ]
    return first_match(rules, filled(SEARCH_URL, F.concat_ws(" ", database, identifier)))
