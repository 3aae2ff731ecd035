"""Vector column expressions (arrays of floats/doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product of two equal-length arrays (summed in index order)."""
    prod = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def l2norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def with_normalised(df, col: str, out: str):
    """``df`` plus ``out`` = unit-length copy of ``col`` (a zero vector stays zero).

    The norm is its own projection so the lambda reads a column, not an
    expression it would re-evaluate per element.
    """
    tmp = f"_{out}_norm"
    step = df.withColumn(tmp, l2norm(col))
    unit = F.when(F.col(tmp) > 0, F.transform(as_double(col), lambda x: x / F.col(tmp))).otherwise(as_double(col))
    return step.withColumn(out, unit).drop(tmp)
