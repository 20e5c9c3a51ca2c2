"""Connected components of pair tables.

Page graphs are usually tiny, so a page with few edges is labelled in one native fold.
Pages above the edge bound go through alternating star contraction, which only uses
minimum aggregations and joins and needs a logarithmic number of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.session import materialise
from boxloom.session import stored as write

FOLD_EDGES = 256
HEAVY = 1000  # a node with more than this part of all rows is dealt over several keys
LEAST_DEAL = 64


def dealt_join(rows: DataFrame, ones: DataFrame, on: Sequence[str], by: str, total: int) -> DataFrame:
    """Join of `rows` with `ones`, which holds one row for each `on` and in `n` a bound of how many rows meet it.

    Rows of a node that more than a thousandth of the `total` rows meet are dealt over several keys by `by`,
    and its one row is repeated for each. There are at most 2000 such nodes, so they are broadcast.
    """
    on = list(on)
    chunk = max(LEAST_DEAL, total // HEAVY)
    parts = F.ceil(F.col("n") / chunk).cast("int")
    heavy = ones.where(F.col("n") > chunk).select(*on, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(heavy), on, "left").withColumn(
        "__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    spread = ones.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return dealt.join(spread, [*on, "__part"]).drop("__part")


def _fold_labels(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    edges = F.sort_array(F.collect_list(F.struct("u", "v")))
    per_page = pairs.groupBy(*keys).agg(edges.alias("es")).withColumn(
        "ns", F.array_sort(F.array_union(F.transform("es", lambda e: e["u"]),
                                         F.transform("es", lambda e: e["v"]))))
    indexed = F.transform("es", lambda e: F.struct(
        F.array_position("ns", e["u"]).cast("int").alias("x"),
        F.array_position("ns", e["v"]).cast("int").alias("y")))

    def union(labels, edge):
        a, b = F.element_at(labels, edge["x"]), F.element_at(labels, edge["y"])
        return F.transform(labels, lambda v: F.when(v == F.greatest(a, b), F.least(a, b)).otherwise(v))

    labels = F.aggregate(indexed, F.col("ns"), union)
    return (per_page.withColumn("z", F.arrays_zip(F.col("ns").alias("node"), labels.alias("label")))
            .select(*keys, F.explode("z").alias("z"))
            .select(*keys, F.col("z.node").alias("node"), F.col("z.label").alias("label")))


def _star_labels(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    edges = materialise(pairs.select(*keys, "u", "v").where("u <> v").distinct())
    rows = edges.count()
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = (dealt_join(both.where("v > u"), low, [*keys, "u"], "v", rows)
                 .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.where("u <> v").distinct()
        low = down.groupBy(*keys, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (dealt_join(down, low, [*keys, "u"], "v", rows).where("v <> m")
                 .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
        after = materialise(small.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct())
        moved = after.join(edges, [*keys, "u", "v"], "left_anti").limit(1).count()
        before, rows = rows, after.count()
        same = moved == 0 and rows == before
        edges = after
        if same:
            break
    roots = edges.select(*keys, F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def component_labels(pairs: DataFrame, keys: Sequence[str], fold_edges: int = FOLD_EDGES,
                     stored: bool = False) -> DataFrame:
    """(keys, node, label): smallest node of the component, for every node in a pair.

    `pairs` has the keys and node columns `u`, `v` (u <> v). Nodes without a pair are absent.
    Pass an already materialised table as it is with `stored=True`.
    """
    if not stored:
        pairs = write(pairs.select(*keys, "u", "v"))
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.where(F.col("__n") > fold_edges).select(*keys)
    if large.limit(1).count() == 0:
        return _fold_labels(pairs, keys)
    large = write(large)
    regular = pairs.join(large, list(keys), "left_anti")
    hot = pairs.join(large, list(keys), "left_semi")
    return _fold_labels(regular, keys).unionByName(_star_labels(hot, keys))
