"""Computing costly columns once.

The optimizer may copy an expression into every filter and projection that uses it. A
one-element explode is a step it does not look through, so what is staged is evaluated
once per row however often it is used later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read instead of computing them again."""
    step = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__stage")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, step).select(*kept, "__stage.*")
