"""Arithmetic reconciliation of two numbers with the other numbers of a document (M1-M6)."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.positions import let

MOST_PARTS, MOST_CANDIDATES = 6, 10


def close(a: Column, b: Column, relative: float = 0.03, absolute: float = 0.05) -> Column:
    """M1."""
    top = F.greatest(F.abs(a), F.abs(b))
    return (F.abs(a - b) <= F.greatest(relative * top, F.lit(absolute))) | ((a != 0) & (b != 0) & (F.abs(a - b) <= relative * top))


def subsets(n: int = MOST_CANDIDATES) -> list[list[int]]:
    """Index sets of 2 to ``MOST_PARTS`` of n candidates, by size and then in combination order."""
    return [list(c) for k in range(2, MOST_PARTS + 1) for c in combinations(range(n), k)]


def parts_of(target: Column, universe: Column, relative: float = 0.03) -> Column:
    """M2, M6: the first subset (by size, then order) of the first ten candidates below 1.2 times the target whose sum is close
    to it; null if none. All index sets are one literal, so no rows are multiplied."""
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda t, v: t + v)

    def first(candidates: Column) -> Column:
        usable = F.get(F.from_json(F.lit(json.dumps([subsets(n) for n in range(MOST_CANDIDATES + 1)])), "array<array<array<int>>>"), F.size(candidates))
        picked = F.transform(usable, lambda s: F.transform(s, lambda i: F.get(candidates, i)))
        return F.get(F.filter(picked, lambda p: let(total(p), lambda t: close(t, target, relative))), F.lit(0))

    return let(F.slice(F.filter(universe, lambda v: (v > 0) & (v < target * 1.2)), 1, MOST_CANDIDATES), first)


def share_of_whole(part: Column, whole: Column, percent: Column, relative: float = 0.03) -> Column:
    """M3: the part is that percentage of the whole, unless both look like percentages."""
    guarded = (percent > 0) & (whole > 0) & (percent < 100) & ~((part < 100) & (part < percent * 5))
    return guarded & close(whole * (percent / 100.0), part, relative)


def growth_matches(start: Column, end: Column, years: Column, percent: Column) -> Column:
    """M4: compound annual growth."""
    actual = (F.pow(end / F.nullif(start, F.lit(0.0)), 1.0 / F.nullif(years, F.lit(0))) - 1.0) * 100.0
    return F.when((start > 0) & (end > 0) & (years > 0), close(actual, percent, 0.05, 0.2)).otherwise(F.lit(False))


def delta_matches(start: Column, end: Column, delta: Column) -> Column:
    """M4."""
    return close(end - start, delta)


def reconcile_pair(a: Column, b: Column, universe: Column) -> Column:
    """M5: the first relation that makes both numbers consistent, or null: rounding, a sum that contains the other, a share."""
    holds = lambda parts, v: F.exists(parts, lambda p: F.abs(p) == F.abs(v))
    sum_a, sum_b = parts_of(a, F.array_append(universe, b)), parts_of(b, F.array_append(universe, a))
    share = F.exists(universe, lambda w: share_of_whole(a, w, b) | share_of_whole(b, w, a))
    some = F.size(universe) > 0
    return (
        F.when(close(a, b, 0.02), "rounding")
        .when(some & F.coalesce(holds(sum_a, b), F.lit(False)), "sum_of_parts_a_contains_b")
        .when(some & F.coalesce(holds(sum_b, a), F.lit(False)), "sum_of_parts_b_contains_a")
        .when(some & share, "share_of_whole")
    )
