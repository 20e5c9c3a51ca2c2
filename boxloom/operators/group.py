"""Grouping of neighbouring detections into ordered text regions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import geometry as geo
from boxloom.functions.staging import staged
from boxloom.operators.graph import component_labels
from boxloom.operators.ranking import written_row_number
from boxloom.session import stored

PAGE = ("book_id", "page")
SIDES = ("l", "t", "r", "b")


@dataclass(frozen=True)
class MergeRules:
    """Fixed values of the merge relation, in pixels or as ratios."""
    side_overlap: float = 0.1
    side_gap_min: float = 8
    side_gap_max: float = 12
    side_gap_width_ratio: float = 1.2
    side_gap_height_ratio: float = 0.06
    side_height_ratio: float = 3.0
    center_ratio: float = 0.55
    center_min: float = 12
    center_max: float = 96
    stack_overlap: float = 0.1
    stack_gap_min: float = 4
    stack_gap_max: float = 8
    stack_gap_width_ratio: float = 0.8
    stack_gap_height_ratio: float = 0.05
    vertical_overlap: float = 0.25
    vertical_gap: float = 24
    vertical_aspect: float = 2.2
    vertical_width: float = 48
    vertical_combined_width: float = 120
    vertical_center_ratio: float = 1.05
    vertical_top_delta: float = 32


CROWDED = 1024  # boxes of both sides of a page from which on its pairs are searched through cells
BLOCK = 256  # boxes of a side that meet in one join key
CELL_BOXES = 2048  # boxes of a side from which on a cell of a pair search is cut into blocks
BAND = 5  # levels of cells that lie in tiles of one size
TILE_BOXES = 4 * CELL_BOXES  # boxes from which on those of a tile go to each of their cells
TASK_BOXES = 1 << 17  # boxes that a task lays into cells
FOLD_BOXES = 64  # boxes of a page that are merged in one native fold


def _usable() -> Column:
    return F.coalesce((F.col("r") >= F.col("l")) & (F.col("b") >= F.col("t")), F.lit(False))


def bad_regions(boxes: DataFrame) -> DataFrame:
    """Boxes that take no part in a pair search, with `code`: a side is missing, or right of or below its opposite."""
    missing = F.col("l").isNull() | F.col("t").isNull() | F.col("r").isNull() | F.col("b").isNull()
    code = F.when(missing, "missing_side").otherwise("inverted")
    return boxes.where(~_usable()).select("*", code.alias("code"))


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], match: Column,
               reach_x: float = 0, reach_y: float = 0, cell: int = 16, crowded: int = CROWDED, block: int = CELL_BOXES,
               tile_boxes: int = TILE_BOXES) -> DataFrame:
    """Join regions of `left` (alias a) and `right` (alias b) that can be within reach.

    `match` must be false for regions further apart than the reach. Regions that `bad_regions` names
    take no part. Pages with up to `crowded` regions are joined as they are; their pairs per page are
    bounded. The others go through cells made from their boxes (`cell_pairs`), whatever the number,
    the size and the place of these.
    """
    a, b = left.where(_usable()), right.where(_usable())
    on = match
    for key in keys:
        on = on & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    if left is right:
        counts = a.groupBy(*keys).agg((F.count(F.lit(1)) * 2).alias("__n"))
    else:
        counts = a.select(*keys).unionAll(b.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = stored(counts.where(F.col("__n") > crowded).select(*keys))
    if hot.limit(1).count() == 0:
        return a.alias("a").join(b.alias("b"), on, "inner")
    few = a.join(hot, list(keys), "left_anti").alias("a").join(b.join(hot, list(keys), "left_anti").alias("b"), on, "inner")
    inside = stored(a.join(hot, list(keys), "left_semi"))
    cells = cell_pairs(inside, inside if left is right else stored(b.join(hot, list(keys), "left_semi")), keys, reach_x, reach_y, cell, block, tile_boxes)
    every = [f"{side}.{c}" for side, df in (("a", a), ("b", b)) for c in df.columns]
    told = [F.col(c).alias(c.replace(".", "__", 1)) for c in every]
    both = few.select(*told).unionByName(cells.where(on).select(*told))
    pair = [F.struct(*[F.col(f"{side}__{c}").alias(c) for c in df.columns]).alias(side) for side, df in (("a", a), ("b", b))]
    return both.select(*pair)


def _side_cells(rows: DataFrame, levels: list[int], own: bool | None, reach_x: float, reach_y: float, cell: int) -> DataFrame:
    """Every row in the cells it covers: of its own level, of all higher ones, or (None) of both."""
    def span(low: str, high: str, reach: float) -> Column:
        side = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
        at = lambda v: F.floor(F.greatest(v, F.lit(0)) / side)  # noqa: E731  what is left of or above the page belongs to the first cell
        return F.sequence(at(F.col(low) - reach / 2.0), at(F.col(high) + reach / 2.0))

    known = F.array(*[F.lit(n) for n in levels])
    places = F.array("own") if own else F.filter(known, lambda n: n >= F.col("own") if own is None else n > F.col("own"))
    spread = rows.select("*", F.explode(places).alias("level"))
    return spread.select("*", F.explode(span("l", "r", reach_x)).alias("cx")).select("*", F.explode(span("t", "b", reach_y)).alias("cy"))


def _sized(left: DataFrame, right: DataFrame, reach_x: float, reach_y: float, cell: int) -> tuple[list[DataFrame], list[int]]:
    """Both sides with the level `own` of every box, and all levels."""
    size = F.greatest(F.col("r") - F.col("l") + F.lit(reach_x), F.col("b") - F.col("t") + F.lit(reach_y), F.lit(cell)).cast("double")
    with_level = lambda df: df.select("*", F.ceil(F.log2(size / F.lit(float(cell)))).cast("int").alias("own"))
    first = with_level(left)
    sides = [first, first if left is right else with_level(right)]
    levels = sorted(r["own"] for r in sides[0].select("own").unionAll(sides[1].select("own")).distinct().collect())  # 64 at most
    return sides, levels


def cell_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], reach_x: float = 0, reach_y: float = 0,
                cell: int = 16, block: int = BLOCK, only: DataFrame | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of tables that meet on (keys, level, cx, cy, block_a, block_b), every two near boxes in at least one of them.

    A box belongs to the level whose cells, sides doubling from level to level, are as large as
    itself, so it covers four cells at most. Two boxes meet in the cells of the level of the larger
    one: the boxes of a level meet those of its own and of all lower levels. Cells that hold more than `block` boxes of a
    side are cut into blocks, and every block of one side meets every block of the other under a key
    of its own, so no key has more than about `block` times `block` candidates. With `only`, a table of
    (keys, level, cx, cy), the other cells are left out.
    """
    sized, levels = _sized(left, right, reach_x, reach_y, cell)
    place = [*keys, "level", "cx", "cy"]

    def spread(i: int, own: bool) -> DataFrame:
        cells = _side_cells(sized[i], levels, own, reach_x, reach_y, cell)
        return cells if only is None else cells.join(only, place, "left_semi")

    out = []
    for a, b in ((spread(0, True), spread(1, True)), (spread(0, True), spread(1, False)), (spread(0, False), spread(1, True))):
        n_a, n_b = (df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n)) for df, n in ((a, "n_a"), (b, "n_b")))
        sizes = stored(n_a.join(n_b, place))
        spot = lambda df: F.xxhash64(*[c for c in df.columns if c not in place])
        a = a.withColumn("__at", spot(a)).join(sizes, place).withColumn("block_a", F.pmod("__at", "n_a")).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
        b = b.withColumn("__at", spot(b)).join(sizes, place).withColumn("block_b", F.pmod("__at", "n_b").cast("int")).withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)))
        out.append((a.withColumn("block_a", F.col("block_a").cast("int")).drop("__at", "n_a", "n_b"), b.drop("__at", "n_a", "n_b")))
    return out


def _band(level: Column) -> Column:
    return F.floor(level / F.lit(BAND)).cast("int")


def _side_tiles(rows: DataFrame, levels: list[int], reach_x: float, reach_y: float, cell: int) -> DataFrame:
    """Every row in the tiles (band, cx, cy) it covers, of the band of its own level (four at most) and of higher ones.

    The tiles of a band have twice the side of its largest cells, so a cell lies in one tile.
    """
    def span(low: str, high: str, reach: float) -> Column:
        side = F.lit(cell) * F.pow(F.lit(2.0), (F.col("band") + 1) * BAND)
        at = lambda v: F.floor(F.greatest(v, F.lit(0)) / side)
        return F.sequence(at(F.col(low) - reach / 2.0), at(F.col(high) + reach / 2.0))

    known = F.array(*[F.lit(n) for n in sorted({n // BAND for n in levels})])
    spread = rows.select("*", F.explode(F.filter(known, lambda n: n >= _band(F.col("own")))).alias("band"))
    return spread.select("*", F.explode(span("l", "r", reach_x)).alias("cx")).select("*", F.explode(span("t", "b", reach_y)).alias("cy"))


def _tile_cells(rows: DataFrame, levels: list[int], reach_x: float, reach_y: float, cell: int) -> DataFrame:
    """Every row of a tile in the cells (level, fx, fy) of that tile it covers, of its own level and of all higher ones."""
    def span(low: str, high: str, reach: float, at: str) -> Column:
        side = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
        wide = F.pow(F.lit(2.0), (F.col("band") + 1) * BAND - F.col("level")).cast("bigint")
        place = lambda v: F.floor(F.greatest(v, F.lit(0)) / side)
        return F.sequence(F.greatest(place(F.col(low) - reach / 2.0), F.col(at) * wide),
                          F.least(place(F.col(high) + reach / 2.0), F.col(at) * wide + wide - 1))

    known = F.array(*[F.lit(n) for n in levels])
    spread = rows.select("*", F.explode(F.filter(known, lambda n: (_band(n) == F.col("band")) & (n >= F.col("own")))).alias("level"))
    return spread.select("*", F.explode(span("l", "r", reach_x, "cx")).alias("fx")).select("*", F.explode(span("t", "b", reach_y, "cy")).alias("fy"))


def _home(a: geo.Region, b: geo.Region, level: Column, at: tuple[Column, Column], reach_x: float, reach_y: float, cell: int) -> Column:
    """Does the cell hold the corner of the common area of two regions?"""
    side = F.lit(cell) * F.pow(F.lit(2.0), level)
    corner = lambda x, y, reach: F.floor(F.greatest(F.greatest(x, y) - reach / 2.0, F.lit(0)) / side)
    return (corner(a.l, b.l, reach_x) == at[0]) & (corner(a.t, b.t, reach_y) == at[1])


def cell_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], reach_x: float, reach_y: float, cell: int, block: int,
               tile_boxes: int = TILE_BOXES) -> DataFrame:
    """Boxes (structs a, b) that share a cell, each pair once: in the cell that holds the corner of their common area.

    The boxes of both sides go to the tiles around these cells in one shuffle (once for a side that meets itself) and are
    laid into the cells there, so only few are sent more than once. A box of a cell's own level meets those of its own
    and of lower levels. The boxes of tiles with more than `tile_boxes` go to each of their cells in a shuffle of their
    own (`_crowded_pairs`).
    """
    tile = [*keys, "band", "cx", "cy"]
    sized, levels = _sized(left, right, reach_x, reach_y, cell)
    spots = [_side_tiles(df, levels, reach_x, reach_y, cell) for df in (sized[:1] if left is right else sized)]
    counts = reduce(DataFrame.unionAll, [df.select(*tile) for df in spots]).groupBy(*tile).agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(counts.where(F.col("n") > tile_boxes).select(*tile))
    some = crowded.limit(1).count() > 0

    rest = {side: [c for c in df.columns if c not in keys] for side, df in (("a", left), ("b", right))}

    def sent(df: DataFrame, side: str) -> DataFrame:
        df = df.join(crowded, tile, "left_anti") if some else df
        return df.select(*tile, "own", F.struct(*rest[side]).alias(f"of_{side}"))

    rows = sent(spots[0], "a")
    if left is not right:
        rows = rows.unionByName(sent(spots[1], "b"), allowMissingColumns=True)
    there = [side for side in "ab" if f"of_{side}" in rows.columns]
    box = [F.coalesce(*[F.col(f"of_{side}.{s}") for side in there]).alias(s) for s in SIDES]
    boxes = sum(df.count() for df in ([left] if left is right else [left, right]))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-boxes // TASK_BOXES))  # few bytes are much work here
    laid = _tile_cells(rows.repartition(tasks, *tile).select("*", *box), levels, reach_x, reach_y, cell)
    mine = F.col("own") == F.col("level")
    lists = [F.collect_list(F.when(mine if own else ~mine, F.col(f"of_{side}"))).alias(f"{'own' if own else 'low'}_{side}")
             for side in there for own in (True, False)]
    met = laid.groupBy(*tile, "level", "fx", "fy").agg(*lists)
    other = there[-1]
    # those of lower levels meet the cell's own only
    tagged = F.concat(F.transform("own_a", lambda x: F.struct(x.alias("a"), F.lit(False).alias("low"))),
                      F.transform("low_a", lambda x: F.struct(x.alias("a"), F.lit(True).alias("low"))))
    ones = met.where(F.size("own_a") + F.size(f"own_{other}") > 0).select(
        *keys, "level", "fx", "fy", f"own_{other}", F.concat(f"own_{other}", f"low_{other}").alias("all"), F.explode(tagged).alias("x"))
    pairs = ones.select(*keys, "level", "fx", "fy", "x.a", F.explode(F.when(F.col("x.low"), F.col(f"own_{other}")).otherwise(F.col("all"))).alias("b"))
    pairs = pairs.where(_home(geo.region("a"), geo.region("b"), F.col("level"), (F.col("fx"), F.col("fy")), reach_x, reach_y, cell))
    found = pairs.select(*[F.struct(*[F.col(c if c in keys else f"{x}.{c}").alias(c) for c in df.columns]).alias(x) for x, df in (("a", left), ("b", right))])
    if not some:
        return found
    cells = [_tile_cells(df.join(crowded, tile, "left_semi"), levels, reach_x, reach_y, cell)
             .drop("band", "cx", "cy").withColumnsRenamed({"fx": "cx", "fy": "cy"}) for df in spots]
    return found.unionAll(_crowded_pairs(cells, left, right, keys, reach_x, reach_y, cell, block))


def _crowded_pairs(cells: list[DataFrame], left: DataFrame, right: DataFrame, keys: Sequence[str], reach_x: float, reach_y: float,
                   cell: int, block: int) -> DataFrame:
    """`cell_pairs` of boxes that are sent to each of their cells (`cells`: one table if a side meets itself, or two).

    The boxes of a side go there in one shuffle, whether they meet there as boxes of the cell's own level or of a
    lower one. Only cells with more than `block` boxes go through `cell_blocks`.
    """
    place = [*keys, "level", "cx", "cy"]
    mine = F.col("own") == F.col("level")
    full = [df.groupBy(*place).agg(F.count_if(mine).alias("n"), F.count_if(~mine).alias("m")).where((F.col("n") > block) | (F.col("m") > block)).select(*place)
            for df in cells]
    crowded = stored(full[0] if left is right else full[0].unionAll(full[1]).distinct())
    some = crowded.limit(1).count() > 0
    # staged after the shuffle: a filter on it is not pushed below, so the readers of a side share its shuffle
    sides = [staged((df.join(crowded, place, "left_anti") if some else df).repartition(*place), mine=mine) for df in cells]
    own, low = ([df.where("mine" if x else "NOT mine").drop("mine") for df in (sides[0], sides[-1])] for x in (True, False))
    met = [(a, b, place) for a, b in ((own[0], own[1]), (own[0], low[1]), (low[0], own[1]))]
    if some:
        blocks = cell_blocks(left, right, keys, reach_x, reach_y, cell, block, only=crowded)
        met += [(a, b, [*place, "block_a", "block_b"]) for a, b in blocks]
    found = None
    for a, b, shared in met:
        on = _home(geo.region("a"), geo.region("b"), F.col("a.level"), (F.col("a.cx"), F.col("a.cy")), reach_x, reach_y, cell)
        for c in shared:
            on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        pairs = a.alias("a").join(b.alias("b"), on).select(
            F.struct(*[F.col(f"a.{c}").alias(c) for c in left.columns]).alias("a"), F.struct(*[F.col(f"b.{c}").alias(c) for c in right.columns]).alias("b"))
        found = pairs if found is None else found.unionAll(pairs)
    return found


def pair_measures(a: geo.Region, b: geo.Region) -> dict[str, Column]:
    """What the merge rules look at, for two regions."""
    return {
        "wa": geo.width(a), "wb": geo.width(b), "ha": geo.height(a), "hb": geo.height(b),
        "share_x": geo.x_overlap(a, b), "share_y": geo.y_overlap(a, b), "gap_x": geo.x_gap(a, b), "gap_y": geo.y_gap(a, b),
        "off_center": F.abs(geo.center_y(a) - geo.center_y(b)), "off_top": F.abs(a.t - b.t),
        "span_x": F.greatest(a.r, b.r) - F.least(a.l, b.l),
    }


def merge_rule(m: dict[str, Column], rules: MergeRules = MergeRules()) -> dict[str, Column]:
    """The three ways two regions belong together, as named boolean columns over pair measures.

    Regions without extent belong to nothing.
    """
    low_w, low_h = F.least(m["wa"], m["wb"]), F.least(m["ha"], m["hb"])
    solid = (low_w > 0) & (low_h > 0)

    def limit(low: float, high: float, by_width: float, by_height: float) -> Column:
        return geo.clip(F.greatest(low_w * F.lit(by_width), low_h * F.lit(by_height)), float(low), float(high))

    def ratio(part: Column, whole: Column) -> Column:
        return part / F.greatest(whole, F.lit(1e-9))

    side = ((ratio(m["share_y"], low_h) >= rules.side_overlap)
            & (m["gap_x"] <= limit(rules.side_gap_min, rules.side_gap_max, rules.side_gap_width_ratio,
                                   rules.side_gap_height_ratio))
            & (ratio(F.greatest(m["ha"], m["hb"]), low_h) <= rules.side_height_ratio)
            & (m["off_center"] <= geo.clip(low_h * F.lit(rules.center_ratio), float(rules.center_min),
                                           float(rules.center_max))))

    def narrow(w: Column, h: Column) -> Column:
        return (w <= rules.vertical_width) & (h / F.greatest(F.lit(1), w) >= rules.vertical_aspect)

    vertical = (narrow(m["wa"], m["ha"]) & narrow(m["wb"], m["hb"])
                & (ratio(m["share_y"], low_h) >= rules.vertical_overlap) & (m["gap_x"] <= rules.vertical_gap)
                & (m["span_x"] <= rules.vertical_combined_width) & (m["off_top"] <= rules.vertical_top_delta)
                & (m["off_center"] <= F.greatest(F.lit(float(rules.center_min)),
                                                 low_h * F.lit(rules.vertical_center_ratio))))
    stack = ((ratio(m["share_x"], low_w) >= rules.stack_overlap)
             & (m["gap_y"] <= limit(rules.stack_gap_min, rules.stack_gap_max, rules.stack_gap_width_ratio,
                                    rules.stack_gap_height_ratio)))
    return {"side": solid & side, "vertical": solid & vertical, "stack": solid & stack}


def merge_candidates(boxes: DataFrame, rules: MergeRules = MergeRules(), node: str = "boxno") -> DataFrame:
    """Pairs (u < v) of boxes of a page that belong together, with the rules that say so."""
    return _candidates(stored(boxes.select(*PAGE, node, *SIDES)), rules, node)


def _candidates(slim: DataFrame, rules: MergeRules, node: str) -> DataFrame:
    """`merge_candidates` of a written table, which is read three times."""
    a, b = geo.region("a"), geo.region("b")
    reach_x, reach_y = max(rules.side_gap_max, rules.vertical_gap), rules.stack_gap_max
    near = ((F.col(f"a.{node}") < F.col(f"b.{node}")) & (geo.x_gap(a, b) <= reach_x) & (geo.y_gap(a, b) <= reach_y))
    pairs = near_pairs(slim, slim, PAGE, near, reach_x, reach_y).select(
        *[F.col(f"a.{k}").alias(k) for k in PAGE], F.col(f"a.{node}").alias("u"), F.col(f"b.{node}").alias("v"),
        *[F.col(f"{side}.{s}").alias(f"{side}{s}") for side in "ab" for s in SIDES])
    # the measures are taken once per pair; the rules then only compare them
    measured = staged(pairs, **pair_measures(geo.region(prefix="a"), geo.region(prefix="b")))
    names = pair_measures(geo.region(prefix="a"), geo.region(prefix="b"))
    found = merge_rule({n: F.col(n) for n in names}, rules)
    return (measured.select(*PAGE, "u", "v", *[c.alias(n) for n, c in found.items()])
            .where(F.col("side") | F.col("vertical") | F.col("stack")))


def _distinct_regions(boxes: DataFrame) -> DataFrame:
    """One row per region of a page, named by its smallest box number.

    Equal regions of positive size always belong together, so only one of them takes part
    in the pair search, whatever the number of copies.
    """
    return boxes.groupBy(*PAGE, *SIDES).agg(F.min("boxno").alias("rep"))


def connected_groups(boxes: DataFrame, rules: MergeRules = MergeRules()) -> DataFrame:
    """Every box with `label`, the smallest box number of its group."""
    reps = stored(_distinct_regions(boxes))
    solid = reps.where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t"))).select(*PAGE, "rep", *SIDES)
    pairs = _candidates(solid, rules, node="rep")
    labels = component_labels(pairs, PAGE).withColumnRenamed("node", "rep")
    named = reps.join(labels, [*PAGE, "rep"], "left")
    solid_row = (F.col("r") > F.col("l")) & (F.col("b") > F.col("t"))
    return (boxes.join(named.select(*PAGE, *SIDES, "rep", "label"), [*PAGE, *SIDES], "inner")
            .withColumn("label", F.when(solid_row, F.coalesce("label", "rep")).otherwise(F.col("boxno")))
            .drop("rep"))


def reading_key(right_to_left: bool = True) -> list[Column]:
    """Order of boxes inside one group."""
    cx = geo.center_x(geo.region())
    return [-cx if right_to_left else cx, geo.center_y(geo.region())]


def group_rows(labelled: DataFrame, page_width: Column, page_height: Column,
               right_to_left: bool = True) -> DataFrame:
    """One row per group: bounding region on the page and ordered source boxes and texts.

    Rows whose region lies outside the page come back with `valid` false.
    """
    across, down = reading_key(right_to_left)
    member = F.struct(across.alias("x"), down.alias("y"), F.col("boxno").alias("boxno"),
                      F.coalesce("text", F.lit("")).alias("text"))
    grouped = labelled.groupBy(*PAGE, "label").agg(
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
        F.sort_array(F.collect_list(member)).alias("m"))
    g = geo.rounded(geo.region())
    g = geo.Region(F.greatest(F.lit(0), g.l), F.greatest(F.lit(0), g.t),
                   F.least(page_width, g.r), F.least(page_height, g.b))
    texts = F.transform("m", lambda x: x["text"])
    return grouped.select(
        *PAGE, "label", *[c.cast("bigint").alias(n) for c, n in zip(g, SIDES)],
        F.transform("m", lambda x: x["boxno"]).alias("source_boxnos"), texts.alias("source_texts"),
        F.array_join(texts, "" if right_to_left else "\n").alias("text"),
        geo.is_positive(g).alias("valid"))


def band(top: Column) -> Column:
    return geo.half_even(top / F.lit(80.0))


def page_order(groups: DataFrame, right_to_left: bool = True, tie: str = "label",
               name: str = "boxno") -> DataFrame:
    """Number groups on a page: coarse bands from the top, then across, then down."""
    g = geo.region()
    cx = geo.center_x(g)
    order = [band(g.t), -cx if right_to_left else cx, geo.center_y(g), F.col(tie)]
    return written_row_number(groups, PAGE, order, order[:3], name)


def group_detections(boxes: DataFrame, page_width: Column, page_height: Column,
                     right_to_left: bool = True, rules: MergeRules = MergeRules()) -> DataFrame:
    """Detections to ordered, numbered text regions."""
    groups = group_rows(connected_groups(boxes, rules), page_width, page_height, right_to_left)
    return page_order(groups, right_to_left)


def _closed(boxes: Column) -> Column:
    """Boxes of one page, touching ones merged until no two touch: each box in turn takes in what it touches.

    The merged boxes do not depend on the order. A box passes over the others again as long as it grows.
    """
    def union(x: Column, y: Column) -> Column:
        return F.struct(*[(F.least if s in "lt" else F.greatest)(x[s], y[s]).alias(s) for s in SIDES])

    none = F.filter(boxes, lambda _: F.lit(False))

    def meet(state: Column, other: Column) -> Column:
        near = geo.touches(geo.Region(*[state["box"][s] for s in SIDES]), geo.Region(*[other[s] for s in SIDES]))
        return (F.when(near, F.struct(union(state["box"], other).alias("box"), state["rest"].alias("rest"), F.lit(True).alias("grown")))
                .otherwise(F.struct(state["box"].alias("box"), F.concat(state["rest"], F.array(other)).alias("rest"), state["grown"].alias("grown"))))

    def again(state: Column, _: Column) -> Column:
        start = F.struct(state["box"].alias("box"), none.alias("rest"), F.lit(False).alias("grown"))
        return F.when(state["grown"], F.aggregate(state["rest"], start, meet)).otherwise(state)

    def take(done: Column, box: Column) -> Column:
        start = F.struct(box.alias("box"), done.alias("rest"), F.lit(True).alias("grown"))
        return F.aggregate(F.sequence(F.lit(0), F.size(done)), start, again, lambda s: F.concat(s["rest"], F.array(s["box"])))

    return F.when(F.size(boxes) == 1, boxes).otherwise(F.aggregate(boxes, none, take))


def bbox_closure(boxes: DataFrame, keys: Sequence[str] = PAGE, fold_boxes: int = FOLD_BOXES) -> DataFrame:
    """Merge touching boxes into their bounding boxes until no two touch.

    Pages of up to `fold_boxes` boxes are merged in one native fold, the others in rounds; every
    round leaves fewer boxes. Boxes without a page touch nothing.
    """
    current = stored(boxes.where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t"))).select(*keys, *SIDES).distinct())
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    placed, loose = current.where(known), current.where(~known)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    crowded = stored(sizes.where(F.col("__n") > fold_boxes).select(*keys))
    few, many = placed, None
    if crowded.limit(1).count() > 0:
        few, many = placed.join(crowded, list(keys), "left_anti"), placed.join(crowded, list(keys), "left_semi")
    listed = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*SIDES))).alias("m"))
    merged = listed.select(*keys, F.explode(_closed(F.col("m"))).alias("m")).select(*keys, *[F.col(f"m.{s}").alias(s) for s in SIDES])
    out = merged.unionByName(loose)
    return out if many is None else out.unionByName(_closed_in_rounds(stored(many), keys))


def _closed_in_rounds(current: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = geo.region("a"), geo.region("b")
    while True:
        # a region is its own name: distinct rows, so the four sides identify it on a page
        named = current.withColumn("node", F.struct(*SIDES))
        match = (F.col("a.node") < F.col("b.node")) & geo.touches(a, b)
        pairs = stored(near_pairs(named, named, keys, match).select(
            *[F.col(f"a.{k}").alias(k) for k in keys],
            F.col("a.node").alias("u"), F.col("b.node").alias("v")))
        if pairs.limit(1).count() == 0:
            return current
        labels = component_labels(pairs, keys, stored=True)
        current = stored(
            named.join(labels, [*keys, "node"], "left")
            .withColumn("label", F.coalesce("label", "node"))
            .groupBy(*keys, "label")
            .agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
            .drop("label").distinct())


def rebuild_groups(groups: DataFrame, detections: DataFrame) -> DataFrame:
    """Bring edited groups in line with the detections that still exist.

    `groups`: book_id, page, group_no, source_boxnos, l, t, r, b (nullable). Unknown and
    repeated sources go, groups without sources go, and a drawn region stays only when its
    sources did not change.
    """
    members = groups.select(*PAGE, "group_no", F.posexplode("source_boxnos").alias("pos", "boxno"))
    first = members.groupBy(*PAGE, "group_no", "boxno").agg(F.min("pos").alias("pos"))
    raw = detections.select(*PAGE, "boxno", F.coalesce("text", F.lit("")).alias("text"), *SIDES)
    kept = first.join(raw, [*PAGE, "boxno"], "inner").groupBy(*PAGE, "group_no").agg(
        F.sort_array(F.collect_list(F.struct("pos", "boxno", "text"))).alias("m"),
        *[(F.min if s in "lt" else F.max)(s).alias(f"u_{s}") for s in SIDES])
    sources = F.transform("m", lambda x: x["boxno"])
    texts = F.transform("m", lambda x: x["text"])
    joined = groups.join(kept, [*PAGE, "group_no"], "inner")
    same = (sources == F.col("source_boxnos")) & F.col("l").isNotNull()
    return joined.select(
        *PAGE, "group_no", sources.alias("source_boxnos"), texts.alias("source_texts"),
        F.array_join(texts, "").alias("text"),
        *[F.when(same, F.col(s)).otherwise(F.col(f"u_{s}")).alias(s) for s in SIDES])
