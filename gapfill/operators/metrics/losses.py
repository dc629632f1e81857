"""Training losses as aggregates over a table of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_EPSILON = 1e-8


def masked_mse(pairs: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Squared error over observed cells; each item is (prediction, target, observed)."""
    num, den = F.lit(0.0), F.lit(0.0)
    for pred, target, mask in pairs:
        m = mask.cast("double")
        num = num + F.sum(F.when(mask, m * (pred - target) * (pred - target)).otherwise(0.0))
        den = den + F.sum(m)
    return num / (den + MASK_EPSILON)


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target] of one row, with the usual max shift."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.log(total) + top - F.element_at(logits, target + 1)


def masked_cross_entropy(logits: Column, target: Column, mask: Column) -> Column:
    m = mask.cast("double")
    return F.sum(F.when(mask, cross_entropy(logits, target)).otherwise(0.0)) / (F.sum(m) + MASK_EPSILON)


def reconstruction_loss(numeric: Sequence[tuple[Column, Column, Column]],
                        categorical: Sequence[tuple[Column, Column, Column]],
                        num_weight: float = 1.0, cat_weight: float = 1.0) -> Column:
    """Weighted numeric MSE plus the mean cross-entropy of the categorical columns."""
    loss = F.lit(0.0)
    if numeric:
        loss = loss + num_weight * masked_mse(numeric)
    if categorical:
        ce = F.lit(0.0)
        for logits, target, mask in categorical:
            ce = ce + masked_cross_entropy(logits, target, mask)
        loss = loss + cat_weight * ce / len(categorical)
    return loss


def gaussian_kl(mu: Column, logvar: Column) -> Column:
    """Mean KL divergence of N(mu, exp(logvar)) from the standard normal."""
    terms = F.zip_with(mu.cast("array<double>"), logvar.cast("array<double>"), lambda m, v: 1.0 + v - m * m - F.exp(v))
    return F.avg(-0.5 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def elbo(numeric, categorical, mu: Column, logvar: Column, kl_weight: float = 1.0) -> Column:
    return reconstruction_loss(numeric, categorical) + kl_weight * gaussian_kl(mu, logvar)
