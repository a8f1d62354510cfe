"""Three-component vectors of columns. Sums run x, y, z so that any engine adds in the same order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, name: str, suffix: str = "") -> Vec:
        """The columns ``name_x``, ``name_y``, ``name_z``."""
        return cls(*(F.col(f"{name}_{c}{suffix}") for c in "xyz"))

    def named(self, name: str) -> list[Column]:
        return [v.alias(f"{name}_{c}") for v, c in zip(self, "xyz")]


def plus(a: Vec, b: Vec) -> Vec:
    return Vec(*(u + v for u, v in zip(a, b)))


def minus(a: Vec, b: Vec) -> Vec:
    return Vec(*(u - v for u, v in zip(a, b)))


def times(a: Vec, k) -> Vec:
    return Vec(*(u * k for u in a))


def over(a: Vec, k) -> Vec:
    return Vec(*(u / k for u in a))


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))
