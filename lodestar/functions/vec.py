"""Vector expressions over array columns; elements may be float, sums are double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.config import Cooccurrence, Fusion


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """a / |a|; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_or_null(a: Column, b: Column) -> Column:
    """Null where a vector is missing, sizes differ or a norm is 0."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def cosine_or_minus_one(a: Column, b: Column) -> Column:
    return F.coalesce(cosine_or_null(a, b), F.lit(-1.0))


def cosine_unit_zero(a: Column, b: Column) -> Column:
    """A norm of 0 counts as 1."""
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def phi(position: Column, n: Column, c: Cooccurrence = Cooccurrence()) -> Column:
    return F.when(n <= 1, F.lit(c.phi_first)).otherwise(F.lit(c.phi_first) - F.lit(c.phi_span) * (position - 1) / (n - 1))


def distance_decay(distance: Column, c: Cooccurrence = Cooccurrence()) -> Column:
    if c.distance_decay <= 0:
        return F.lit(1.0)
    return F.exp(-F.lit(c.distance_decay) * (F.greatest(F.lit(1), distance) - 1))


def semantic_gain(similarity: Column, c: Cooccurrence = Cooccurrence()) -> Column:
    """A null similarity, or one not above 0, counts as low_similarity; one that is no number gives 1."""
    s = F.when(similarity.isNull() | (similarity <= 0), F.lit(c.low_similarity)).otherwise(similarity)
    bell = 0.5 + 0.8 * F.exp(-F.pow(s - c.peak, 2) / (2 * c.sigma**2))
    return F.when(F.isnan(s), F.lit(1.0)).when(s < 0.15, 0.4 + s).otherwise(bell)


def mix(a: Column, b: Column, wa: Column | float, wb: Column | float) -> Column:
    """normalize(wa * a + wb * b); the shorter vector is padded with zeros, a missing b gives normalize(a)."""
    wa, wb = (x if isinstance(x, Column) else F.lit(x) for x in (wa, wb))
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return F.when(b.isNull(), normalize(a)).otherwise(normalize(F.zip_with(a, b, lambda x, y: wa * zero(x) + wb * zero(y))))


def fir_weights(hops: int = 4, gamma: float = 0.6) -> list[float]:
    taps = [gamma**h for h in range(hops + 1)]
    return [t / sum(taps) for t in taps]


def activation_multiplier(activation: Column, c: Fusion = Fusion()) -> Column:
    return c.activation_min + activation * (c.activation_max - c.activation_min)


def effective_boost(depth: Column, entropy: Column, resonance: Column, activation: Column, c: Fusion = Fusion()) -> Column:
    factor = depth * (1 + F.log(1 + resonance)) / (1 + 0.5 * entropy) * activation_multiplier(activation, c)
    return c.base_boost * F.greatest(F.lit(c.boost_min), F.least(F.lit(c.boost_max), factor))


def core_boost(depth: Column, coverage: Column, c: Fusion = Fusion()) -> Column:
    return c.core_min + (0.5 * depth + 0.5 * (1 - coverage)) * (c.core_max - c.core_min)
