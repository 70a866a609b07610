"""Ordered rule tables: the first matching rule gives the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``equal``: column → value it must have. ``between``: column → (low, high), inclusive; low = high means any."""

    result: str
    equal: dict[str, object] = field(default_factory=dict)
    between: dict[str, tuple[float, float]] = field(default_factory=dict)

    def holds(self) -> Column:
        test = F.lit(True)
        for name, value in self.equal.items():
            test = test & (F.col(name) == F.lit(value))
        for name, (low, high) in self.between.items():
            if low != high:
                test = test & F.col(name).between(low, high)
        return test


def first_match(rules: Sequence[Rule], none: object = None) -> Column:
    """The result of the first rule that holds, as one compiled expression: no join, no shuffle; ``none`` if none holds."""
    out = F.lit(none)
    for rule in reversed(rules):
        out = F.when(rule.holds(), F.lit(rule.result)).otherwise(out)
    return out


def attribute_matches(tags: str, name: str, pattern: str) -> Column:
    """Pattern on an open attribute: ``-`` null, ``!-`` not null, ``*`` not empty, else equality."""
    value = F.col(tags)[name]
    if pattern == "-":
        return value.isNull()
    if pattern == "!-":
        return value.isNotNull()
    if pattern == "*":
        return value.isNotNull() & (value != "")
    return F.coalesce(value == pattern, F.lit(False))


def first_attribute_match(tags: str, rules: Sequence[tuple[dict[str, str], str | None]]) -> Column:
    """Result of the first rule all of whose patterns match; None rejects."""
    out = F.lit(None).cast("string")
    for patterns, result in reversed(rules):
        test = F.lit(True)
        for name, pattern in patterns.items():
            test = test & attribute_matches(tags, name, pattern)
        out = F.when(test, F.lit(result).cast("string")).otherwise(out)
    return out
