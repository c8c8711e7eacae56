"""Column expressions over nucleotide strings and phred arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estuarine.functions.mathx import first_match, ratio


def letter_count(seq: Column, letters: str) -> Column:
    """How many characters of `seq` are among `letters` (case sensitive)."""
    rest = seq
    for letter in letters:
        rest = F.replace(rest, F.lit(letter), F.lit(""))
    return F.length(seq) - F.length(rest)


def gc_content(seq: Column) -> Column:
    return ratio(letter_count(F.upper(seq), "GC"), F.length(seq), 0.0)


def n_fraction(seq: Column) -> Column:
    return ratio(letter_count(F.upper(seq), "N"), F.length(seq), 0.0)


def mean_phred(qual: Column) -> Column:
    """Mean quality; null without qualities."""
    total = F.aggregate(qual, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(qual) > 0, total.cast("double") / F.size(qual))


def phred_from_text(q: Column, offset: int = 33) -> Column:
    """Quality characters to integers."""
    return F.transform(F.split(q, ""), lambda c: F.ascii(c) - offset)


def pseudo_phred(seq: Column) -> Column:
    """Deterministic stand-in qualities for data that has none."""
    return F.when(
        F.length(seq) > 0,
        F.transform(F.split(seq, ""), lambda c, i: (F.ascii(c) + i * 7) % 42),
    ).otherwise(F.array().cast("array<int>"))


def kmers(seq: Column, k: int, clean: bool = True) -> Column:
    """All k-long windows at stride 1, optionally without those holding N or X.

    An empty match with a look-ahead group yields the overlapping windows in one pass;
    substrings at growing offsets would cost the square of the length.
    """
    letter = "[^NX]" if clean else "(?s:.)"
    return F.regexp_extract_all(seq, F.lit(f"(?=({letter}{{{k}}}))"), F.lit(1))


#: Windows that a long sequence is cut into before its k-mers are taken.
WINDOW = 65_536


def kmer_windows(seq: Column, k: int, size: int | None = None) -> Column:
    """Stretches of `size` + k - 1 bases that overlap by k - 1: each k-mer of `seq` is in exactly one of them."""
    size = size or WINDOW
    last = F.greatest(F.length(seq) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(size)), lambda i: F.substring(seq, i + 1, F.lit(size + k - 1)))


def distinct_kmer_hashes(seq: Column, k: int, size: int | None = None) -> Column:
    """Hashes of the distinct k-mers, window by window, in the order they first occur."""
    none = F.array().cast("array<bigint>")
    join = lambda found, text: F.array_union(found, F.transform(kmers(text, k), lambda w: F.xxhash64(w)))
    return F.aggregate(kmer_windows(seq, k, size), none, join)


def chunk_spans(length: Column, size: int, overlap: int) -> Column:
    """Start/stop pairs covering `length` tokens, neighbours sharing `overlap`."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the chunk size")
    last = F.greatest(F.ceil((length - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")
    return F.when(
        length > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                (i * step).alias("start"), F.least(i * step + size, length).alias("stop")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def chunks(tokens: Column, size: int, overlap: int) -> Column:
    """Overlapping slices of a token array; the last may be short."""
    spans = chunk_spans(F.size(tokens), size, overlap)
    return F.transform(
        spans, lambda s: F.slice(tokens, s["start"] + 1, s["stop"] - s["start"])
    )


# Marker genes in match order.
MARKER_GENES = ["18S", "16S", "COI", "12S", "ITS"]


def marker_gene(description: Column, seq: Column, genes: list[str] | None = None, head_bases: int | None = None) -> Column:
    """First gene found in the description or the sequence; null if none.

    `head_bases` looks at that many bases from the start instead of the whole sequence.
    """
    text, head = F.upper(description), F.upper(seq.substr(1, head_bases) if head_bases else seq)
    rules = [
        (text.contains(g.upper()) | head.contains(g.upper()), g) for g in (genes or MARKER_GENES)
    ]
    return first_match(rules).cast("string")


def exact_base_rank(kmer: Column) -> Column:
    """Position of a k-mer in the lexicographic enumeration of ACGT words, from 0."""
    digits = F.split(F.translate(kmer, "ACGT", "0123"), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 4 + d.cast("long"))
