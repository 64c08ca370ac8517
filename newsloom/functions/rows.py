"""Row-wise helpers for whole DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``withColumns`` for costly values: each is computed once per row whatever is done with it later.

    Catalyst moves filters below projections by copying the projected expressions into them, so a filter on a scored
    column would score every row twice, and a ladder of such columns grows with each copy. Values that come out of a
    generator are not copied. One row in, one row out; nothing is moved between partitions.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*kept, F.inline_outer(packed))
