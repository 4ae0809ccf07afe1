"""Smallest unused colour, partition arithmetic and packed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mex(used: Column) -> Column:
    """The smallest number from 0 that is not in an array of integers."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used)).cast("int")


def _parts(total: Column, parts: Column) -> tuple[Column, Column]:
    base = F.floor(total / parts)
    return base, total - base * parts


def range_start(total: Column, parts: Column, part: Column) -> Column:
    """First index of a part; the first ``total % parts`` parts have one more."""
    base, extra = _parts(total, parts)
    return base * part + F.least(part, extra)


def range_end(total: Column, parts: Column, part: Column) -> Column:
    return range_start(total, parts, part + 1)


def part_of(total: Column, parts: Column, index: Column) -> Column:
    """The part that holds an index: the exact inverse of the ranges."""
    base, extra = _parts(total, parts)
    wide = extra * (base + 1)
    return F.when(index < wide, F.floor(index / (base + 1))).otherwise(extra + F.floor((index - wide) / F.greatest(base, F.lit(1))))


def numeric_id(node: Column, local: Column) -> Column:
    """The local id above the node, 32 bits each."""
    return F.shiftleft(local.cast("bigint"), 32).bitwiseOR(node.cast("bigint"))


def id_string(node: Column, local: Column) -> Column:
    return F.format_string("(%d,%d)", node, local)
