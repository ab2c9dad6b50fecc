"""Predicates over a document's metadata map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class MetadataFilter:
    """All of some keys must have exactly the given values. No condition at all is met by every row.

    A key asked for two different values is met by none.
    """

    def __init__(self, conditions: tuple[tuple[str, str], ...] = ()):
        self.conditions = tuple(conditions)

    def add(self, key: str, value: str) -> MetadataFilter:
        return MetadataFilter((*self.conditions, (key, value)))

    def matches(self, metadata: Column) -> Column:
        met = [F.coalesce(F.try_element_at(metadata, F.lit(k)) == v, F.lit(False)) for k, v in self.conditions]
        return reduce(lambda a, b: a & b, met, F.lit(True))


def any_value_contains(metadata: Column, part: str) -> Column:
    """Whether some value contains ``part``; the empty string needs at least one value."""
    return F.exists(F.map_values(metadata), lambda v: F.contains(v, F.lit(part)))


def preview(content: Column, chars: int = 200) -> Column:
    """The first characters and three dots, which stand there always."""
    return F.concat(F.substring(content, 1, chars), F.lit("..."))
