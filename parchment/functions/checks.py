"""Checks of numbers that a pattern has proposed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip


def ean13(s: Column) -> Column:
    """13 digits of which the last is right."""
    digits = F.regexp_replace(s, r"\P{Nd}", "")
    values = F.transform(F.split(digits, ""), lambda c: c.try_cast("int"))
    total = F.aggregate(F.transform(F.slice(values, 1, 12), lambda v, i: v * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, v: a + v)
    return F.coalesce((F.length(digits) == 13) & ((10 - total % 10) % 10 == F.get(values, F.lit(12))), F.lit(False))


def iban(s: Column) -> Column:
    """15 to 34 letters and digits that leave 1 by 97, the first four moved to the end."""
    bare = F.upper(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return F.length(bare).between(15, 34) & (rest == 1)


def _coordinates(s: Column) -> tuple[Column, Column]:
    parts = F.transform(F.split(strip(s), rf"[{SPACE},/]+"), lambda p: F.regexp_replace(p, r"[^0-9.]", "").try_cast("double"))
    return F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)


def _inside(s: Column, e: tuple[int, int], n: tuple[int, int]) -> Column:
    east, north = _coordinates(s)
    return F.coalesce(east.between(*e) & north.between(*n), F.lit(False))


# The boxes of the two national grids.
def lv95(s: Column) -> Column:
    return _inside(s, (2_480_000, 2_840_000), (1_070_000, 1_300_000))


def lv03(s: Column) -> Column:
    return _inside(s, (480_000, 840_000), (70_000, 300_000))


CHECKS = {"ean13": ean13, "iban": iban, "lv95": lv95, "lv03": lv03}
