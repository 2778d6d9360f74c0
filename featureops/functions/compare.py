"""Threshold comparisons in which a NaN never passes (Spark sorts NaN above every number)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def above(value: Column, limit: Column | float) -> Column:
    return ~F.isnan(value) & (value > limit)


def at_least(value: Column, limit: Column | float) -> Column:
    return ~F.isnan(value) & (value >= limit)


def below(value: Column, limit: Column | float) -> Column:
    return ~F.isnan(value) & (value < limit)


def at_most(value: Column, limit: Column | float) -> Column:
    return ~F.isnan(value) & (value <= limit)
