"""Scalar line functions: guarded divisions, three-way comparison, conditions and element-wise folds."""

from __future__ import annotations

import functools
from collections.abc import Callable

from barloom.plans.lines import Line, line, op


def div_by_zero(a, b, zero: float = 0.0) -> Line:
    """a / b, and `zero` where b is 0."""
    return op("CASE WHEN {1} = 0 THEN {2} ELSE {0} / nullif({1}, 0) END", a, b, zero)


def div_zero_by_zero(a, b, single: float | None = None, dual: float = 0.0) -> Line:
    """a / b; where b is 0 `dual` if a is 0 too, else `single` (null for an infinite quotient)."""
    return op("CASE WHEN {1} = 0 THEN CASE WHEN {0} = 0 THEN {3} ELSE {2} END ELSE {0} / nullif({1}, 0) END", a, b, single, dual)


def sign_of_difference(a, b) -> Line:
    return op("CAST(sign({0} - {1}) AS DOUBLE)", a, b)


def choose_by_order(a, b, less, equal, greater) -> Line:
    return op("CASE WHEN {0} < {1} THEN {2} WHEN {0} = {1} THEN {3} WHEN {0} > {1} THEN {4} END", a, b, less, equal, greater)


def if_else(condition, yes, no) -> Line:
    """`yes` where the condition isn't 0; null where it is null."""
    return op("CASE WHEN {0} <> 0 THEN {1} WHEN {0} = 0 THEN {2} END", condition, yes, no)


def _joined(sign: str, args) -> Line:
    test = f" {sign} ".join(f"{{{k}}} <> 0" for k in range(len(args)))
    known = " AND ".join(f"{{{k}}} IS NOT NULL" for k in range(len(args)))
    return op(f"CASE WHEN NOT ({known}) THEN NULL WHEN {test} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", *args)


def all_of(*args) -> Line:
    return _joined("AND", args)


def any_of(*args) -> Line:
    return _joined("OR", args)


def _picked(function: str, args) -> Line:
    """The extreme of the values; null if any is null, which greatest and least alone would pass over."""
    known = " AND ".join(f"{{{k}}} IS NOT NULL" for k in range(len(args)))
    return op(f"CASE WHEN {known} THEN {function}({', '.join(f'{{{k}}}' for k in range(len(args)))}) END", *args)


def max_of(*args) -> Line:
    return _picked("greatest", args)


def min_of(*args) -> Line:
    return _picked("least", args)


def sum_of(*args) -> Line:
    return functools.reduce(lambda a, b: a + b, map(line, args))


def reduce_of(function: Callable[[Line, Line], Line], *args) -> Line:
    return functools.reduce(function, map(line, args))
