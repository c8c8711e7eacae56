"""Readers and writers for sequence files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estuarine.functions.mathx import first_match
from estuarine.functions.sequences import phred_from_text
from estuarine.sources.fastq import FastqSource

# Extensions by format.
EXTENSIONS = {
    "fasta": ["fasta", "fa", "fas"],
    "fastq": ["fastq", "fq"],
    "swiss": ["swiss", "sp"],
    "genbank": ["gb", "gbk"],
    "embl": ["embl", "em"],
}


def readable(value: Column) -> Column:
    """Text of a line, falling back to a single-byte charset where it is not valid UTF-8."""
    return F.when(F.is_valid_utf8(value), value).otherwise(
        F.decode(value.cast("binary"), "iso-8859-1")
    )


def clean_bases(seq: Column) -> Column:
    """Sequence text without blanks; undecodable characters become N."""
    return F.regexp_replace(F.regexp_replace(seq, r"\s+", ""), r"[^\x21-\x7E]", "N")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files (plain or gzip): one row per record, multi-line sequences joined.

    Records are split by the text source, so large plain files are read in parallel.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.ltrim(readable(F.col("value"))), "^>", "")
    head = F.regexp_replace(F.regexp_extract(record, r"^([^\n]*)", 1), r"^\s+|\s+$", "")
    return (
        raw.select(record.alias("r"), head.alias("h"), F.col("_metadata.file_path").alias("f"))
        .filter(F.length("h") > 0)
        .select(
            F.regexp_extract("h", r"^(\S+)", 1).alias("sequence_id"),
            F.col("h").alias("description"),
            clean_bases(F.regexp_replace("r", r"^[^\n]*\n?", "")).alias("seq"),
            F.col("f").alias("source_file"),
        )
    )


def write_fasta(
    reads: DataFrame, path: str, key: str = "sequence_id", description: str | None = None
) -> None:
    head = F.col(key).cast("string")
    if description:
        head = F.concat_ws(" ", head, F.trim(F.regexp_replace(description, r"\s+", " ")))
    reads.select(F.concat(F.lit(">"), head, F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and server that Spark itself would use."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    return re.sub(r"^file:/+", "file:///", full)


def read_fastq(spark: SparkSession, path: str, max_split: int = 128 << 20) -> DataFrame:
    """FASTQ files with phred scores; plain files are split on record borders.

    A path without scheme is on Spark's default file system. A record that a file's end cuts
    off is an error.
    """
    spark.dataSource.register(FastqSource)
    raw = spark.read.format("fastq").option("maxSplit", str(max_split)).load(qualified(spark, path))
    return raw.select(
        "sequence_id",
        "description",
        "seq",
        F.when(F.length("quality") > 0, phred_from_text(F.col("quality")))
        .otherwise(F.array().cast("array<int>"))
        .alias("qual"),
        "source_file",
    )


def write_fastq(reads: DataFrame, path: str, key: str = "sequence_id") -> None:
    quality = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    reads.select(
        F.concat(F.lit("@"), F.col(key).cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), quality)
        .alias("value")
    ).write.text(path)


def _joined(block: Column) -> Column:
    return F.upper(F.regexp_replace(block, r"[^A-Za-z*]", ""))


def read_flatfile(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Swiss-Prot, EMBL or GenBank entries: id, description, organism, feature types, sequence."""
    # the separator holds for both kinds of line ends; what is left of the line goes
    raw = spark.read.option("lineSep", "\n//").text(path)
    entry = F.regexp_replace(F.regexp_replace(readable(F.col("value")), r"\r", ""), r"^[^\S\n]*\n", "")
    e = F.col("e")
    lines = lambda tag: F.array_join(
        F.regexp_extract_all(e, F.lit(rf"(?m)^{tag}   (.*)$"), F.lit(1)), " "
    )
    if fmt in ("swiss", "embl"):
        fields = {
            "sequence_id": F.regexp_extract(e, r"(?m)^ID   ([^\s;]+)", 1),
            "description": lines("DE"),
            "organism": F.regexp_replace(lines("OS"), r"\.$", ""),
            "feature_types": F.regexp_extract_all(e, F.lit(r"(?m)^FT   (\S+)"), 1),
            "seq": _joined(F.regexp_extract(e, r"(?s)\nSQ   [^\n]*\n(.*)$", 1)),
        }
        start = r"(?m)^ID   "
    elif fmt == "genbank":
        fields = {
            "sequence_id": F.regexp_extract(e, r"(?m)^LOCUS\s+(\S+)", 1),
            "description": F.regexp_replace(
                F.regexp_extract(e, r"(?s)\nDEFINITION\s+(.*?)\n(?=\S)", 1), r"\s+", " "
            ),
            "organism": F.trim(F.regexp_extract(e, r"(?m)^  ORGANISM\s+(.*)$", 1)),
            "feature_types": F.regexp_extract_all(
                F.regexp_extract(e, r"(?s)\nFEATURES[^\n]*\n(.*?)\n(?=\S)", 1),
                F.lit(r"(?m)^     (\S+)"),
                1,
            ),
            "seq": _joined(F.regexp_extract(e, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)),
        }
        start = r"(?m)^LOCUS"
    else:
        raise ValueError(f"unknown flat-file format {fmt!r}")
    return (
        raw.select(entry.alias("e"), F.col("_metadata.file_path").alias("source_file"))
        .filter(e.rlike(start))
        .select(*[c.alias(n) for n, c in fields.items()], "source_file")
    )


def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """Format per file: by extension (through .gz), else by its first line, else FASTA."""
    name = F.regexp_replace(F.col("_metadata.file_path"), r"\.gz$", "")
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).alias("ext"),
        "value",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    firsts = raw.groupBy("source_file", "ext").agg(
        F.min_by("value", F.struct("block", "line")).alias("first")
    )
    by_ext = [(F.col("ext").isin(exts), fmt) for fmt, exts in EXTENSIONS.items()]
    line = F.trim("first")
    by_line = [
        (line.startswith(">"), "fasta"),
        (line.startswith("@"), "fastq"),
        (line.startswith("ID   "), "swiss"),
        (line.startswith("LOCUS"), "genbank"),
    ]
    return firsts.select("source_file", first_match(by_ext + by_line, "fasta").alias("format"))
