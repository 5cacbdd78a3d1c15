"""From class logits to scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlab.functions.vectors import bound, vector_sum


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(col) -> Column:
    """Probabilities of a logit vector, shifted by its maximum for safety."""
    col = _col(col).cast("array<double>")

    def shares(powers):
        return bound(vector_sum(powers), lambda total: F.transform(powers, lambda v: v / total))

    return bound(F.array_max(col), lambda top: bound(F.transform(col, lambda v: F.exp(v - top)), shares))


def positive_score(logits) -> Column:
    """Probability of class 1 of a two-class logit vector, without building arrays."""
    logits = _col(logits)
    gap = F.get(logits, F.lit(0)).cast("double") - F.get(logits, F.lit(1)).cast("double")
    return 1.0 / (1.0 + F.exp(gap))


def predict_label(score) -> Column:
    """Class of the larger probability; a tie gives class 0."""
    return (_col(score) > F.lit(0.5)).cast("int")
