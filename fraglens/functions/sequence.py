"""Column functions on DNA sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """ACGT (either case) to their complements in upper case, backwards; other letters stay."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def gc_content(seq: Column) -> Column:
    """Share of G and C."""
    return F.try_divide((F.length(seq) - F.length(F.translate(F.upper(seq), "GC", ""))).cast("double"), F.length(seq).cast("double"))
