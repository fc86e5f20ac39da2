"""Costs of a seam crossing the edge between two neighbouring pixels, by name.

``d1``, ``d2`` are the differences (this pixel minus its neighbour) in the two images. The ``c`` forms
give flat edges 1e10; those without ``_int`` wrap differences (and a7c their sum) like bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE, _FLAT, _EPS, _INF = 1.0, 1e10, 1e-18, float("inf")


def _over(d: Column) -> Column:
    return F.when(d == 0, F.lit(_FLAT)).otherwise(F.lit(_ONE) / d.cast("double"))


def _wrap(d: Column) -> Column:
    return F.pmod(d, F.lit(256))


def _sum(a: Column, b: Column, total: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(_FLAT)).when(total == 0, F.lit(_INF)).otherwise(F.lit(_ONE) / total.cast("double"))


COSTS: dict[str, Callable[[Column, Column], Column]] = {
    "a6": lambda a, b: F.lit(_ONE) / (F.abs(a) + F.lit(_EPS)) + F.lit(_ONE) / (F.abs(b) + F.lit(_EPS)),
    "a7": lambda a, b: F.lit(_ONE) / ((F.abs(a) + F.lit(_EPS)) + (F.abs(b) + F.lit(_EPS))),
    "a6c": lambda a, b: _over(_wrap(a)) + _over(_wrap(b)),
    "a7c": lambda a, b: _sum(_wrap(a), _wrap(b), _wrap(_wrap(a) + _wrap(b))),
    "a6c_int": lambda a, b: _over(F.abs(a)) + _over(F.abs(b)),
    "a7c_int": lambda a, b: _sum(F.abs(a), F.abs(b), F.abs(a) + F.abs(b)),
}


def cost(name: str, d1: Column, d2: Column) -> Column:
    if name not in COSTS:
        raise ValueError(f"unknown seam cost {name!r}; known: {', '.join(COSTS)}")
    return COSTS[name](d1, d2)
