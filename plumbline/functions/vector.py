"""Column functions over ``array<float>`` vectors; all sums run in double, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")
        )
    )


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(vector)
    unit = F.transform(vector, lambda v: v.cast("double") / length)
    return F.when(length > 0, unit).otherwise(vector.cast("array<double>"))


def narrow(vector: Column) -> Column:
    """Storage type. Spark has no half precision, so single precision is the narrowest."""
    return vector.cast("array<float>")
