"""Names and identifiers out of sequence headers and hit titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name and identifier patterns in the order they are tried. The borders
# of the two-word name are spelt out, since runtimes disagree on \b at accented letters.
_WORD = r"[\p{L}\p{N}_]"
NAME_PATTERNS = [
    rf"(?<!{_WORD})([A-Z][a-z]+\s+[a-z][a-z\-]*[a-z])(?!{_WORD})",
    r"\[([^\]]+)\]",
]
TAXID_PATTERNS = [r"taxid\|(\d+)", r"TaxID=(\d+)", r"taxid=(\d+)", r"taxon:(\d+)"]


def _first(text: Column, patterns: list[str]) -> Column:
    found = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def organism_name(text: Column) -> Column:
    """Two-word name, else bracketed text, else null."""
    return F.trim(_first(text, NAME_PATTERNS))


def taxid(text: Column) -> Column:
    return _first(text, TAXID_PATTERNS).cast("long")


def identity_percent(identical: Column, aligned: Column) -> Column:
    return identical * 100.0 / F.greatest(aligned, F.lit(1))


def coverage_of_span(aligned: Column, start: Column, end: Column) -> Column:
    """Aligned length against the aligned query span."""
    return aligned * 100.0 / F.greatest(end - start, F.lit(1))


def coverage_of_query(aligned: Column, query_length: Column) -> Column:
    return aligned * 100.0 / F.greatest(query_length, F.lit(1))
