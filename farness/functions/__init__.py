"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZATIONS = ("classic", "wf", "reachable")


def closeness_of(r: Column, d: Column, n: int, normalization: str) -> Column:
    """Closeness from r (others reached), d (the sum of their distances) and n (all vertices); 0.0 where d is 0 or null.

    classic (n-1)/d, wf r*r/((n-1)*d), reachable r/d.
    """
    one = {
        "classic": lambda: F.lit(float(n - 1)) / d,
        "wf": lambda: (r.cast("double") * r) / (F.lit(float(n - 1)) * d),
        "reachable": lambda: r.cast("double") / d,
    }[normalization]
    return F.when(d > 0, one()).otherwise(F.lit(0.0))


def strict_double(text: Column) -> Column:
    """The number that the whole text is, without blanks around it; else null."""
    return F.when(F.rlike(text, F.lit(r"\A[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|nan)\z")), text.try_cast("double"))


