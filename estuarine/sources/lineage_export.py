"""Lineage exports. Every format is written by the tasks that hold the rows.

Formats with one document per file get one document per record line, so no task
needs the whole result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estuarine.operators.ranks import present_ranks

# Vocabularies and namespaces.
DWC = "http://rs.tdwg.org/dwc/terms/"
TAXONOMY = "http://example.org/taxonomy/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
PHYLOXML = "http://www.phyloxml.org"

# What the names of a JSON-LD record stand for.
CONTEXT = {
    "@vocab": TAXONOMY,
    "dwc": DWC,
    "taxon": "dwc:Taxon",
    "scientificName": "dwc:scientificName",
    "kingdom": "dwc:kingdom",
    "phylum": "dwc:phylum",
    "class": "dwc:class",
    "order": "dwc:order",
    "family": "dwc:family",
    "genus": "dwc:genus",
    "species": "dwc:species",
}

FORMATS = ["json", "csv", "tsv", "xml", "json-ld", "rdf", "phyloxml"]


def escape_xml(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in df.schema
        ]
    )


def _subject() -> Column:
    named = F.concat(F.lit("name:"), F.url_encode(F.coalesce("scientific_name", F.lit("unknown"))))
    return F.coalesce(F.col("taxid").cast("string"), named)


def _json_ld(df: DataFrame) -> Column:
    fields = [
        F.struct(*[F.lit(v).alias(k) for k, v in CONTEXT.items()]).alias("@context"),
        F.lit("taxon").alias("@type"),
        F.concat(F.lit("urn:taxon:"), _subject()).alias("@id"),
        F.col("scientific_name").alias("scientificName"),
        F.col("confidence"),
        *[F.col(r) for r in present_ranks(df)],
    ]
    return F.to_json(F.struct(*fields))


def _turtle(df: DataFrame) -> Column:
    subject = F.concat(F.lit(f"<{TAXONOMY}"), F.replace(_subject(), F.lit(":"), F.lit("/")), F.lit(">"))
    parts = [
        F.concat(subject, F.lit(f" <{RDF}type> <{DWC}Taxon>")),
        F.concat(F.lit(f"<{DWC}scientificName> "), _quoted(F.col("scientific_name"))),
        *[F.concat(F.lit(f"<{DWC}{r}> "), _quoted(F.col(r))) for r in present_ranks(df)],
        F.concat(F.lit(f"<{TAXONOMY}confidence> "), F.col("confidence").cast("string")),
    ]
    return F.concat(F.concat_ws(" ; ", *parts), F.lit(" ."))


def _phyloxml(df: DataFrame) -> Column:
    name = escape_xml(F.coalesce("scientific_name", F.lit("unnamed")))
    taxonomy = F.when(
        F.col("taxid").isNotNull(),
        F.concat(
            F.lit('<taxonomy><id provider="ncbi">'), F.col("taxid").cast("string"), F.lit("</id><scientific_name>"),
            name, F.lit("</scientific_name></taxonomy>"),
        ),
    )
    return F.concat(
        F.lit(f'<phyloxml xmlns="{PHYLOXML}"><phylogeny rooted="true"><clade><name>'),
        name,
        F.lit("</name>"),
        F.coalesce(taxonomy, F.lit("")),
        F.lit('<confidence type="bootstrap">'),
        F.format_string("%.1f", F.col("confidence") * 100),
        F.lit("</confidence></clade></phylogeny></phyloxml>"),
    )


def export_lineages(df: DataFrame, path: str, fmt: str) -> None:
    """Write lineages (taxid, scientific_name, confidence, ranks, list columns) in a format."""
    if fmt == "json":
        df.write.json(path)
    elif fmt in ("csv", "tsv"):
        _flat(df).write.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt == "xml":
        df.write.format("xml").option("rootTag", "taxonomic_lineages").option("rowTag", "lineage").save(path)
    elif fmt in ("json-ld", "rdf", "phyloxml"):
        line = {"json-ld": _json_ld, "rdf": _turtle, "phyloxml": _phyloxml}[fmt](df)
        df.select(line.alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
