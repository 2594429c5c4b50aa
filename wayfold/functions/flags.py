"""Row predicates as maps of named flags, and what is computed from such maps.

A flag that is missing or null counts as false.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPPOSITE = {"up": "down", "down": "up", "left": "right", "right": "left"}


def flag_map(flags: Mapping[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*[F.coalesce(c, F.lit(False)) for c in flags.values()]))


def true_names(flags: Column) -> Column:
    """Sorted names of the true flags."""
    return F.sort_array(F.map_keys(F.map_filter(flags, lambda k, v: F.coalesce(v, F.lit(False)))))


def flag(flags: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(flags, F.lit(name)), F.lit(False))


def primary(flags: Column, order: Sequence[str], strict: bool = False) -> Column:
    """The first true flag of order; without one null, or an error if strict."""
    none = F.raise_error(F.lit("no scenario applies")) if strict else F.lit(None)
    out = None
    for name in order:
        out = F.when(flag(flags, name), name) if out is None else out.when(flag(flags, name), name)
    return out.otherwise(none.cast("string"))


def mixed_risk(risks: Column) -> Column:
    """Some options are fatal and some are not (map of option to struct with life_lost)."""
    v = F.map_values(risks)
    return F.exists(v, lambda r: r["life_lost"]) & ~F.forall(v, lambda r: r["life_lost"])


def all_fatal(risks: Column) -> Column:
    return (F.cardinality(risks) > 0) & F.forall(F.map_values(risks), lambda r: r["life_lost"])


def choice_fatal(risks: Column, choice: Column) -> Column:
    return F.coalesce(F.try_element_at(risks, choice)["life_lost"], F.lit(False))


def avoidable(risks: Column, choice: Column) -> Column:
    """The choice is fatal where another option is not."""
    return choice_fatal(risks, choice) & mixed_risk(risks)


def reverse(move: Column, heading: Column) -> Column:
    """move goes back against heading."""
    opposite = F.create_map(*[F.lit(x) for kv in OPPOSITE.items() for x in kv])
    return F.coalesce(F.try_element_at(opposite, heading) == move, F.lit(False))


def power_transition(before: Column, after: Column) -> Column:
    """Remaining time before and after, and whether it ran out during the action."""
    return F.struct(before.alias("before"), after.alias("after"), ((before > 0) & (after == 0)).alias("expired"))


def nearest(distances: Column, names: Column | None = None, default: int = 999) -> Column:
    """Smallest value of a map of distances (of the given keys), default without one."""
    d = distances if names is None else F.map_filter(distances, lambda k, v: F.array_contains(names, k))
    return F.coalesce(F.array_min(F.map_values(d)), F.lit(default))


def targeted(options: Column, risks: Column, choice: Column, hard: Column) -> Column:
    """At least two options, a safe choice and some hard flag."""
    return (F.size(options) >= 2) & ~choice_fatal(risks, choice) & (F.size(true_names(hard)) > 0)


def sampled(index: Column, strata: Column, every: int, always: Sequence[str]) -> Column:
    """Every n-th row, and all rows of some strata."""
    hit = index % every == 0
    for name in always:
        hit = hit | flag(strata, name)
    return hit


def mismatches(pairs: Column) -> Column:
    """Of a map of struct(saved, expected) the entries that differ."""
    return F.map_filter(pairs, lambda k, v: ~v["saved"].eqNullSafe(v["expected"]))


def collectable(turn: Column, legal: Column, first: int = 12, every: int = 4) -> Column:
    """The part of the collection rule that one row tells: late enough, on an every-th turn, with a choice; the state must be unseen too."""
    return (turn >= first) & (turn % every == 0) & (F.size(legal) >= 2)
