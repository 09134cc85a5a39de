"""Kinds of graded equality of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of a match, best first.
KINDS = ["exact", "homoglyph", "translit", "fuzzy"]


def kind(rank_of: Column) -> Column:
    return F.coalesce(*[F.when(rank_of == i, F.lit(k)) for i, k in enumerate(KINDS)])
