"""Orders of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column | str) -> Column:
    """A text that sorts names with numbers by the numbers' size: g2 before g10. Each run of digits gets its length before it."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def spelt(x: Column) -> Column:
        digits = F.regexp_replace(x, r"^0+(?=\d)", "")
        return F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(x)

    return F.concat_ws("", F.transform(parts, spelt))
