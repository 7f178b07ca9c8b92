"""Vector functions as column expressions, in double."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance thresholds by embedding model; unknown models take the least.
THRESHOLDS = {"small": 0.42, "large": 0.55}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def threshold(model: Column) -> Column:
    out = F.lit(min(THRESHOLDS.values()))
    for name, value in THRESHOLDS.items():
        out = F.when(model == name, value).otherwise(out)
    return out


def of_width(v: Column, dims: int) -> Column:
    """v, or an error if it hasn't dims numbers."""
    return F.when(F.size(v) == dims, v).otherwise(F.raise_error(F.concat(F.lit("vector of width "), F.size(v).cast("string"))))
