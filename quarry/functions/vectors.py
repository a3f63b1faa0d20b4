"""L2 normalisation and the bucket count of the default text encoder
(``operators.embed``)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import col_of

__all__ = ["l2_normalise", "DEFAULT_BUCKETS"]

# Fixed value of the default encoder: 4096 hash buckets.
DEFAULT_BUCKETS = 4096


def l2_normalise(v) -> Column:
    """Divide by the L2 norm (doubles); a zero vector stays zero.  The norm
    is passed into the division as an array, so it is computed once per row
    rather than once per element."""
    v = col_of(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.zip_with(v, F.array_repeat(safe, F.size(v)), lambda x, n: x.cast("double") / n)
