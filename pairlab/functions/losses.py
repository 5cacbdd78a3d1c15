"""Classification losses as column expressions.

Every row loss takes the label and either the class-1 ``score`` (clipped away
from 0 and 1 before the logarithm) or the two-class ``logits`` (no clipping
needed).  ``loss`` reduces one of them to a single number per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-15


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))


def log_probabilities(score=None, logits=None) -> tuple[Column, Column]:
    """(ln p of class 0, ln p of class 1)."""
    if (score is None) == (logits is None):
        raise ValueError("give exactly one of score and logits")
    if score is not None:
        p = _col(score).cast("double")
        return F.log(_clipped(1.0 - p)), F.log(_clipped(p))
    z0 = F.get(_col(logits), F.lit(0)).cast("double")
    z1 = F.get(_col(logits), F.lit(1)).cast("double")
    top = F.greatest(z0, z1)
    norm = top + F.log(F.exp(z0 - top) + F.exp(z1 - top))
    return z0 - norm, z1 - norm


def _by_label(label, one: Column, zero: Column) -> Column:
    return F.when(_col(label) == 1, one).otherwise(zero)


def ce_loss(label, score=None, logits=None) -> Column:
    """Cross-entropy: -ln p(true class)."""
    lp0, lp1 = log_probabilities(score, logits)
    return -_by_label(label, lp1, lp0)


def focal_loss(label, score=None, logits=None, alpha=0.25, gamma: float = 2.0) -> Column:
    """a_t (1 - p_t)^gamma ce; ``alpha`` is the class-1 share or a (class 0, class 1) pair."""
    a0, a1 = (1.0 - alpha, alpha) if isinstance(alpha, (int, float)) else alpha
    ce = ce_loss(label, score, logits)
    weight = _by_label(label, F.lit(float(a1)), F.lit(float(a0)))
    return weight * F.pow(1.0 - F.exp(-ce), F.lit(float(gamma))) * ce


def label_smoothing_loss(label, score=None, logits=None, eps: float = 0.1, classes: int = 2) -> Column:
    """Cross-entropy against a target that leaves ``eps`` for the other classes."""
    lp0, lp1 = log_probabilities(score, logits)
    true, other = _by_label(label, lp1, lp0), _by_label(label, lp0, lp1)
    return -(1.0 - eps) * true - (eps / (classes - 1)) * other


def class_weight(label, weights: Sequence[float] | None = None) -> Column:
    """The weight of a row's class, [class 0, class 1]; none given means 1 for both."""
    w0, w1 = weights or (1.0, 1.0)
    return _by_label(label, F.lit(float(w1)), F.lit(float(w0)))


def row_loss(kind: str, label, score=None, logits=None, *, alpha=0.25, gamma=2.0, eps=0.1) -> Column:
    """One row's loss of the named kind (unweighted for weighted_ce)."""
    if kind in ("ce", "weighted_ce"):
        return ce_loss(label, score, logits)
    if kind == "focal":
        return focal_loss(label, score, logits, alpha, gamma)
    if kind == "label_smoothing":
        return label_smoothing_loss(label, score, logits, eps)
    raise ValueError(f"unknown loss {kind!r}")


def reduce_loss(row: Column, reduction: str = "mean") -> Column:
    """Aggregate expression for a row loss; ``none`` returns it unchanged."""
    if reduction == "mean":
        return F.avg(row)
    if reduction == "sum":
        return F.sum(row)
    if reduction == "none":
        return row
    raise ValueError(f"unknown reduction {reduction!r}")


def weighted_ce_loss(label, score=None, logits=None, weights=None) -> Column:
    """sum(w_y ce) / sum(w_y) as an aggregate expression."""
    w = class_weight(label, weights)
    return F.sum(w * ce_loss(label, score, logits)) / F.sum(w)


def loss(kind: str, label, score=None, logits=None, *, weights=None, reduction="mean", **params) -> Column:
    """Dispatch by name to an aggregate loss expression."""
    if kind == "weighted_ce":
        return weighted_ce_loss(label, score, logits, weights)
    return reduce_loss(row_loss(kind, label, score, logits, **params), reduction)
