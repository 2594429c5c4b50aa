"""Distributions over options as map<string,double>, and vectors as array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_TOLERANCE, ARGMAX_TOLERANCE = 0.02, 1e-4


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(x: Column) -> Column:
    """Stable softmax of an array: the largest and the sum are found once."""
    e = bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return bound(e, lambda powers: bound(F.aggregate(powers, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(powers, lambda v: v / total)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def low_rank_update(w: Column, b: Column, a: Column) -> Column:
    """w + b * a for a row w of weights, a factor b and a row a."""
    return F.zip_with(w, a, lambda x, y: x + b * y)


def valid(p: Column, keys: Column, choice: Column) -> Column:
    """Keys match, all values are finite and in 0..1, they sum to about 1, and the choice is an argmax."""
    v = F.map_values(p)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    same = F.sort_array(F.map_keys(p)) == F.sort_array(keys)
    within = F.forall(v, lambda x: ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce(same & within & (F.abs(total - 1) <= SUM_TOLERANCE) & (F.try_element_at(p, choice) >= F.array_max(v) - ARGMAX_TOLERANCE), F.lit(False))


def renormalised(p: Column) -> Column:
    return bound(F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + x), lambda total: F.transform_values(p, lambda k, v: v / total))


def argmax(p: Column) -> Column:
    """The option of the largest probability; of equal ones the first by name."""
    return bound(F.array_max(F.map_values(p)), lambda top: F.array_min(F.map_keys(F.map_filter(p, lambda k, v: v == top))))


def one_hot(options: Column, choice: Column) -> Column:
    return F.map_from_arrays(options, F.transform(options, lambda m: F.when(m == choice, 1.0).otherwise(0.0)))


def margin(p: Column, gold: Column) -> Column:
    """Probability of gold less the best of the others (0 without others)."""
    others = F.map_values(F.map_filter(p, lambda k, v: k != gold))
    return F.coalesce(F.try_element_at(p, gold), F.lit(0.0)) - F.coalesce(F.array_max(others), F.lit(0.0))


def cross_entropy(p: Column, gold: Column, floor: float = 1e-12) -> Column:
    return -F.log(F.greatest(F.coalesce(F.try_element_at(p, gold), F.lit(0.0)), F.lit(floor)))


def entropy(p: Column, floor: float = 1e-8) -> Column:
    return -F.aggregate(F.map_values(p), F.lit(0.0), lambda a, v: a + v * F.log(F.greatest(v, F.lit(floor))))
