"""Scalar functions of the processors and checks, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def capture(name: Column, pattern: str | None) -> Column:
    """Group 1 of the first match; null (unset) without a match or without a group; the name itself without a pattern."""
    if not pattern:
        return name
    if re.compile(pattern).groups == 0:
        return F.lit(None).cast("string")
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))


def first_replaced(name: Column, logical: str, target: str) -> Column:
    """The name with the first occurrence of ``logical`` replaced; unchanged without one."""
    at = F.instr(name, F.lit(logical))
    return F.when(at > 0, F.overlay(name, F.lit(target), at, F.lit(len(logical)))).otherwise(name)


def older_than(column: Column, now: Column | str, skip_seconds: int, kind: str = "time") -> Column:
    """column < now - skip: kind is time (a timestamp), sec, milli or nano (numbers since the epoch)."""
    at = (F.lit(now).cast("timestamp") if isinstance(now, str) else now) - F.expr(f"interval {int(skip_seconds)} seconds")
    if kind == "time":
        return column < at
    if kind == "nano":
        return column < F.unix_micros(at) * 1000
    return column < (F.unix_seconds(at) if kind == "sec" else F.unix_millis(at)) * 1
