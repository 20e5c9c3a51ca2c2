"""Row numbers and running values that do not put one group into one task.

A window over a whole group sends the group to a single task. Here each group is cut
into buckets by a value that rises with the sort order (a page band, a day, a block of
positions). Rows are only windowed inside (group, bucket); the buckets themselves are
pre-aggregated, so the window over a group sees one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.session import stored, written

BLOCK = 4096  # rows per bucket when buckets are cut from a position


def position_block(position: Column, size: int = BLOCK) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def even_buckets(df: DataFrame, group: Sequence[str], levels: Sequence[Column], name: str, size: int = BLOCK) -> DataFrame:
    """`df` with a bucket `name` of about `size` rows that rises with `levels`, from coarse to fine.

    Every level must rise with the order of the rows that agree in the levels before it. Rows are
    counted by level; where more than `size` rows share the levels so far, the next one cuts them
    where the running count passes a multiple of `size`. The counts are pre-aggregated, so a window
    sees the values of one level inside one value of the level above, never the rows; cuts are kept
    for crowded values only. The result depends on the rows alone, so every reader gets the same buckets.
    """
    marks = [f"__l{i}" for i in range(len(levels))]
    base = df.withColumns(dict(zip(marks, levels)))
    out, parts = base, [F.col("__l0").alias("l0")]
    for i in range(1, len(levels)):
        path = [*group, *marks[:i]]
        inside = Window.partitionBy(*path)
        earlier = inside.orderBy(marks[i]).rowsBetween(Window.unboundedPreceding, -1)
        cells = base.groupBy(*path, marks[i]).agg(F.count(F.lit(1)).alias("__n"))
        cut = F.floor(F.coalesce(F.sum("__n").over(earlier), F.lit(0)) / F.lit(size))
        keys = [*path, marks[i]]
        cuts = (cells.select(*keys, F.sum("__n").over(inside).alias("__all"), cut.alias("__c")).where(F.col("__all") > size)
                .select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__c").alias(f"__c{i}")))
        on = F.lit(True)
        for n, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{n}"))
        out = out.join(cuts, on, "left").drop(*[f"__k{n}" for n in range(len(keys))])
        parts.append(F.coalesce(f"__c{i}", F.lit(0)).alias(f"c{i}"))
    return out.withColumn(name, F.struct(*parts)).drop(*marks, *[f"__c{i}" for i in range(1, len(levels))])


def _keyed(df: DataFrame, group: Sequence[str], bucket: Column | Sequence[Column]) -> DataFrame:
    if isinstance(bucket, Column):
        return df.withColumn("__bucket", bucket)
    return even_buckets(df, group, bucket, "__bucket")


def _bucket_prefix(df: DataFrame, group: Sequence[str], aggregates: dict[str, Column],
                   carries: dict[str, Column]) -> DataFrame:
    earlier = (Window.partitionBy(*group).orderBy("__bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    per_bucket = df.groupBy(*group, "__bucket").agg(*[c.alias(n) for n, c in aggregates.items()])
    return per_bucket.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__bucket").alias("__bk"),
        *[c.over(earlier).alias(f"__carry_{n}") for n, c in carries.items()],
    )


def _join_prefix(df: DataFrame, prefix: DataFrame, group: Sequence[str]) -> DataFrame:
    on = F.col("__bucket") == F.col("__bk")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return df.join(prefix, on, "inner").drop("__bk", *[f"__g{i}" for i in range(len(group))])


def split_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                     bucket: Column | Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Dense 0-based number of each row in its group; `bucket` must rise with `order`, or is a list of levels (`even_buckets`)."""
    keyed = _keyed(df, group, bucket)
    prefix = _bucket_prefix(keyed, group, {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    numbered = keyed.withColumn("__rn", F.row_number().over(inside))
    return (_join_prefix(numbered, prefix, group)
            .withColumn(name, (F.coalesce("__carry_n", F.lit(0)) + F.col("__rn") - 1 + start)
                        .cast("bigint"))
            .drop("__rn", "__bucket", "__carry_n"))


def written_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column | Sequence[Column],
                       name: str, held: bool = False, most: int = BLOCK) -> DataFrame:
    """`split_row_number` of rows that are costly to make: they are made once and written.

    The lazy form makes its rows once for every step that reads them and joins all of them with their
    buckets. Here only groups of more than `most` rows go through buckets; the others are numbered in one
    window. Pass rows that are read from a written table as they are with `held=True`.
    """
    rows = df.where(bucket.isNotNull()) if isinstance(bucket, Column) else df
    rows = rows if held else written(rows)

    def whole(part: DataFrame) -> DataFrame:
        inside = Window.partitionBy(*group).orderBy(*order)
        return part.withColumn(name, (F.row_number().over(inside) - 1).cast("bigint"))

    if isinstance(bucket, Column):
        low, high = rows.agg(F.min(bucket), F.max(bucket)).first()
        if low == high:  # one bucket for all, so no group has another
            return whole(rows)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    crowded = stored(sizes.select(*[F.col(g).alias(f"__h{i}") for i, g in enumerate(group)]))
    if crowded.limit(1).count() == 0:
        return whole(rows)
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__h{i}"))
    few, many = rows.join(crowded, on, "left_anti"), rows.join(crowded, on, "left_semi")
    return whole(few).unionByName(split_row_number(many, group, order, bucket, name))


def split_running(df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column | Sequence[Column],
                  sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
                  mins: dict[str, Column] | None = None, include_current: bool = True) -> DataFrame:
    """Running sum / last non-null value / minimum of earlier rows of the group."""
    sums, lasts, mins = sums or {}, lasts or {}, mins or {}
    keyed = _keyed(df, group, bucket)
    rank = F.struct(*order)
    aggregates: dict[str, Column] = {}
    carries: dict[str, Column] = {}
    for n, c in sums.items():
        aggregates[n], carries[n] = F.sum(c), F.sum(n)
    for n, c in lasts.items():
        aggregates[n] = F.max_by(c, F.when(c.isNotNull(), rank))
        carries[n] = F.last(n, ignorenulls=True)
    for n, c in mins.items():
        aggregates[n], carries[n] = F.min(c), F.min(n)
    prefix = _bucket_prefix(keyed, group, aggregates, carries)
    inside = (Window.partitionBy(*group, "__bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1))
    for n, c in sums.items():
        keyed = keyed.withColumn(f"__in_{n}", F.sum(c).over(inside))
    for n, c in lasts.items():
        keyed = keyed.withColumn(f"__in_{n}", F.last(c, ignorenulls=True).over(inside))
    for n, c in mins.items():
        keyed = keyed.withColumn(f"__in_{n}", F.min(c).over(inside))
    joined = _join_prefix(keyed, prefix, group)
    for n in sums:
        joined = joined.withColumn(n, F.coalesce(f"__in_{n}", F.lit(0)) + F.coalesce(f"__carry_{n}", F.lit(0)))
    for n in lasts:
        joined = joined.withColumn(n, F.coalesce(f"__in_{n}", f"__carry_{n}"))
    for n in mins:
        joined = joined.withColumn(n, F.least(f"__in_{n}", f"__carry_{n}"))
    names = [*sums, *lasts, *mins]
    return joined.drop("__bucket", *[f"__in_{n}" for n in names], *[f"__carry_{n}" for n in names])
