"""Raw detector results to clean detection rows: shaping, filtering, tiling, de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import answer_json as aj
from boxloom.functions import geometry as geo
from boxloom.functions import text as tx
from boxloom.functions.staging import staged
from boxloom.operators.group import PAGE, SIDES, near_pairs
from boxloom.operators.ranking import position_block, written_row_number
from boxloom.session import stored

# Fixed values
SKIPPED_LABELS = ("image", "header_image", "footer_image")
LABEL_KEYS = ("block_label", "label")
TEXT_KEYS = ("block_content", "content", "text", "rec_text", "markdown")
SCORE_KEYS = ("score", "block_score", "confidence", "rec_score")
POINT_KEYS = ("block_polygon_points", "polygon_points", "points", "poly", "polygon")
BOX_KEYS = ("block_bbox", "bbox", "box", "coordinate", "region")
RESULT_KEYS = ("rec_texts", "rec_scores", "rec_polys", "rec_boxes")


def renumber(rows: DataFrame, order: str, name: str = "boxno") -> DataFrame:
    """0-based dense number per page in the order of a non-negative position column."""
    return written_row_number(rows, PAGE, [F.col(order)], position_block(F.col(order)), name)


def min_score(rows: DataFrame, lowest: float = 0.75) -> DataFrame:
    """Rows without a score pass."""
    return rows.where(F.coalesce(F.col("score") >= lowest, F.lit(True)))


def _box_points(box: Column) -> Column:
    l, t, r, b = (F.get(box, F.lit(i)) for i in range(4))
    return F.array(F.array(l, t), F.array(r, t), F.array(r, b), F.array(l, b))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _usable_points(points: Column) -> Column:
    """Points with two finite values; null when fewer than two are left."""
    good = F.filter(points, lambda p: F.coalesce(
        (F.size(p) >= 2) & _finite(F.get(p, F.lit(0))).isNotNull() & _finite(F.get(p, F.lit(1))).isNotNull(), F.lit(False)))
    return aj.once(good, lambda x: F.when(F.size(x) >= 2, x))


def _usable_box(box: Column) -> Column:
    return aj.once(box, lambda x: F.when((F.size(x) == 4) & F.forall(x, lambda v: _finite(v).isNotNull()), _box_points(x)))


def _with_region(rows: DataFrame) -> DataFrame:
    """Bounding box of `points` on the page (width, height); rows without extent are dropped."""
    g = geo.polygon_region(F.col("points"), F.col("width"), F.col("height"))
    return staged(rows, **dict(zip(SIDES, g))).where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))


def normalize_detections(results: DataFrame, lowest: float = 0.75) -> DataFrame:
    """Column-wise results of any lengths to numbered rows.

    `results`: book_id, page, width, height, rec_texts, rec_scores, rec_polys, rec_boxes.
    """
    ragged = F.arrays_zip(*[F.coalesce(F.col(c), F.array()).alias(c) for c in RESULT_KEYS])
    rows = results.select(*PAGE, "width", "height", F.posexplode(ragged).alias("pos", "x"))
    rows = staged(rows, text=F.coalesce("x.rec_texts", F.lit("")), score=_finite(F.col("x.rec_scores")),
                  points=F.coalesce(_usable_points(F.col("x.rec_polys")), _usable_box(F.col("x.rec_boxes")))).drop("x")
    kept = _with_region(min_score(rows, lowest).where(F.col("points").isNotNull()))
    return renumber(kept, "pos").select(*PAGE, "boxno", *SIDES, "points", "text", "score")


def _first(block: str, names: tuple[str, ...]) -> Column:
    """The first of some fields of a block (a struct of them) that is there and no JSON null."""
    def present(name: str) -> Column:
        value = F.col(f"{block}.{name}")
        return F.when(value.isNotNull() & ~F.is_variant_null(value), value)
    return F.coalesce(*[present(n) for n in names])


def _points_of(value: Column) -> Column:
    """Points of a polygon, or the corners of four numbers."""
    corners = _usable_box(aj.as_numbers(value))
    points = _usable_points(F.transform(aj.values(value), aj.as_numbers))
    return F.coalesce(corners, points)


def normalize_blocks(results: DataFrame, lowest: float = 0.75) -> DataFrame:
    """Layout blocks to detection rows, scaled to the page and numbered in block order.

    `results`: book_id, page, width, height, blocks (JSON text of an array), block_width and
    block_height (size the blocks refer to, null for the page size).
    """
    blocks = aj.values(F.try_parse_json("blocks"))
    rows = results.select(*PAGE, "width", "height", F.coalesce("block_width", "width").alias("bw"),
                          F.coalesce("block_height", "height").alias("bh"), F.posexplode(blocks).alias("pos", "block"))
    rows = staged(rows, block=aj.fields(F.col("block"), (*LABEL_KEYS, *TEXT_KEYS, *SCORE_KEYS, *POINT_KEYS, *BOX_KEYS)))
    rows = staged(rows, v_label=_first("block", LABEL_KEYS), v_text=_first("block", TEXT_KEYS), v_score=_first("block", SCORE_KEYS),
                  v_points=_first("block", POINT_KEYS), v_box=_first("block", BOX_KEYS)).drop("block")
    joined = F.array_join(F.filter(F.transform(aj.values(F.col("v_text")), lambda v: F.try_variant_get(v, "$", "string")),
                                   lambda v: v.isNotNull()), "\n")
    rows = staged(rows, label=F.coalesce(tx.strip(aj.as_text(F.col("v_label"))), F.lit("")),
                  text=tx.strip(F.when(aj.is_array(F.col("v_text")), joined).otherwise(F.try_variant_get("v_text", "$", "string"))),
                  score=F.coalesce(aj.as_number(F.col("v_score")), aj.as_text(F.col("v_score")).try_cast("double")))
    rows = rows.where(~F.lower("label").isin(*SKIPPED_LABELS) & (F.col("text") != ""))
    rows = staged(rows, raw_points=F.coalesce(_points_of(F.col("v_points")), _points_of(F.col("v_box"))))
    rows = staged(rows.where(F.col("raw_points").isNotNull()), points=geo.scale_points(
        F.col("raw_points"), F.col("bw"), F.col("bh"), F.col("width"), F.col("height")))
    kept = _with_region(min_score(rows, lowest))
    return renumber(kept, "pos").select(*PAGE, "boxno", *SIDES, "points", "text", "score",
                                        F.nullif("label", F.lit("")).alias("block_label"))


def unknown_results(results: DataFrame) -> DataFrame:
    """Pages whose result has no known structure, as against a known but empty one.

    `results`: book_id, page, raw (JSON text).
    """
    read = results.select(*PAGE, F.try_parse_json("raw").alias("v"))
    v = F.col("v")

    def blank(x: Column) -> Column:
        return F.is_variant_null(x) | (aj.is_array(x) & (F.size(aj.values(x)) == 0))

    def known(x: Column) -> Column:
        # a nested `res` object holds the result when there is one
        inner = F.when(aj.is_object(aj.field(x, "res")), aj.field(x, "res")).otherwise(x)
        return F.exists(F.array(*[F.lit(k) for k in RESULT_KEYS]),
                        lambda k: F.array_contains(F.map_keys(F.try_variant_get(inner, "$", "map<string,variant>")), k))

    items = F.when(aj.is_array(v), aj.values(v)).otherwise(F.array(v))
    fine = blank(v) | F.forall(items, blank) | F.exists(items, lambda x: F.coalesce(known(x), F.lit(False)))
    return read.where(~F.coalesce(fine, F.lit(False))).select(*PAGE, F.lit("unknown_structure").alias("code"))


# tiles -----------------------------------------------------------------------------------

def page_tiles(pages: DataFrame, tile: int = 750, overlap: int = 256) -> DataFrame:
    """Overlapping tiles that cover each page; `pages` has width and height."""
    return (pages.select(*PAGE, "width", "height", F.explode(geo.tile_starts(F.col("height"), tile, overlap)).alias("y"))
            .select("*", F.explode(geo.tile_starts(F.col("width"), tile, overlap)).alias("x"))
            .select(*PAGE, "x", "y", F.least(F.lit(tile), F.col("width") - F.col("x")).alias("tile_width"),
                    F.least(F.lit(tile), F.col("height") - F.col("y")).alias("tile_height"), "width", "height"))


def shift_tile_detections(rows: DataFrame) -> DataFrame:
    """Tile detections in page pixels, with a flag for boxes cut by an inner tile edge.

    `rows`: detections with x, y, tile_width, tile_height, width, height.
    """
    moved = geo.shift_region(geo.region(), F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    moved_rows = rows.withColumns(dict(zip(SIDES, moved))).where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))
    tile = geo.Region(F.col("x"), F.col("y"), F.col("x") + F.col("tile_width"), F.col("y") + F.col("tile_height"))
    return moved_rows.withColumn("edge_touch", geo.touches_inner_edge(geo.region(), tile, F.col("width"), F.col("height"))) \
                     .withColumn("source", F.lit("tile"))


def combine_sources(full: DataFrame, tiles: DataFrame, held: bool = False) -> DataFrame:
    """Whole-page detections first, then tile detections row by row of tiles; `pos` is the order.

    The rows are written once, unless both tables are read from written ones as they are (`held`). Pages of ordinary
    size are numbered in one window, so their rows are sent once.
    """
    first = full.withColumn("source", F.lit("full_image")).withColumn("edge_touch", F.lit(False)).withColumn("__k", F.lit(0))
    rows = first.unionByName(tiles.withColumn("__k", F.lit(1)), allowMissingColumns=True)
    order = [F.col("__k"), F.coalesce("y", F.lit(-1)), F.coalesce("x", F.lit(-1)), F.col("boxno")]
    levels = [F.struct(order[0], order[1].alias("y")), order[2], position_block(F.col("boxno"))]
    return written_row_number(rows, PAGE, order, levels, "pos", held=held).drop("__k")


# duplicates ------------------------------------------------------------------------------

def duplicate_pairs(boxes: DataFrame, iou: float = 0.55, containment: float = 0.88, node: str = "boxno") -> DataFrame:
    """Pairs (u < v) of overlapping boxes that show the same text."""
    slim = boxes.select(*PAGE, node, *SIDES, tx.squeeze(F.col("text")).alias("squeezed"))
    a, b = geo.region("a"), geo.region("b")
    agree = ((F.col("a.squeezed") == "") | (F.col("b.squeezed") == "")
             | F.contains(F.col("a.squeezed"), F.col("b.squeezed")) | F.contains(F.col("b.squeezed"), F.col("a.squeezed")))
    match = ((F.col(f"a.{node}") < F.col(f"b.{node}")) & (geo.intersection(a, b) > 0)
             & ((geo.iou(a, b) >= iou) | ((geo.containment(a, b) >= containment) & agree)))
    return near_pairs(slim, slim, PAGE, match).select(
        *[F.col(f"a.{k}").alias(k) for k in PAGE], F.col(f"a.{node}").alias("u"), F.col(f"b.{node}").alias("v"))


def _replaces(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Does a later duplicate take the place of the kept record?"""
    by_score = (F.when(new["score"] > old["score"] + 0.05, True).when(new["score"] < old["score"], False)
                .otherwise(new["size"] > old["size"]))
    return (F.when((old["size"] == 0) & (new["size"] > 0), True).when((old["size"] > 0) & (new["size"] == 0), False)
            .when(old["edge"] != new["edge"], old["edge"]).otherwise(by_score))


def _slots(rows: DataFrame, reach: DataFrame) -> DataFrame:
    """(book_id, page, slot, kept): the record that every slot holds at the end, for components of any size.

    `rows`, a written table: book_id, page, boxno, cls, score, edge, size; `reach`: the classes (`other`) that a class
    duplicates, itself among them. A box joins the first slot whose holder, when its turn comes, it
    duplicates, may take the place of that holder, and founds a slot if there is none. A guess of all
    holders, each with the box that ends it, tells what every box would do; from that the next guess
    is made, for all boxes at once. Of several boxes that would end the same holder, or would newly
    found a slot for the same class, only the first is believed. What the boxes up to some number do is
    right in the round after those before them are right, and stays so; mostly all of a page is right
    after a few rounds. Pages that a round does not change are done.
    """
    of = ["score", "edge", "size"]
    reach = stored(reach)
    holders = rows.groupBy(*PAGE, "cls").agg(F.min_by(F.struct("boxno", *of), "boxno").alias("x")).select(
        *PAGE, F.col("x.boxno").alias("slot"), F.col("x.boxno").alias("holder"), "cls", *[f"x.{c}" for c in of], F.lit(None).cast("bigint").alias("end"))
    holders = stored(holders)
    parts = []
    while True:
        seen = holders.select(*PAGE, F.col("cls").alias("other"), "slot", "holder", "end", *[F.col(c).alias(f"o_{c}") for c in of])
        near = reach.join(seen, [*PAGE, "other"]).drop("other")
        met = rows.join(near, [*PAGE, "cls"]).where((F.col("holder") < F.col("boxno")) & (F.col("end").isNull() | (F.col("end") >= F.col("boxno"))))
        first = met.groupBy(*PAGE, "boxno").agg(F.min_by(F.struct("slot", "holder", *[f"o_{c}" for c in of]), "slot").alias("o"))
        turn = rows.join(first, [*PAGE, "boxno"], "left")
        better = _replaces({c: F.col(f"o.o_{c}") for c in of}, {c: F.col(c) for c in of})
        acts = stored(turn.where(F.col("o").isNull() | better).select(*PAGE, "boxno", "cls", *of, F.col("o.slot").alias("o_slot"), F.col("o.holder").alias("old")))
        ending = acts.where(F.col("old").isNotNull()).groupBy(*PAGE, "old").agg(F.min_by(F.struct("boxno", "cls", *of, "o_slot"), "boxno").alias("x"))
        ended = ending.select(*PAGE, F.col("old").alias("holder"), F.col("x.boxno").alias("end"))
        taken = ending.select(*PAGE, F.col("x.o_slot").alias("slot"), F.col("x.boxno").alias("holder"), "x.cls", *[f"x.{c}" for c in of])
        known = holders.where("slot = holder").select(*PAGE, F.col("holder").alias("boxno"), F.lit(True).alias("known"))
        fresh = acts.where(F.col("old").isNull()).join(known, [*PAGE, "boxno"], "left")
        founder = lambda df: df.select(*PAGE, F.col("boxno").alias("slot"), F.col("boxno").alias("holder"), "cls", *of)
        one = fresh.where("known IS NULL").groupBy(*PAGE, "cls").agg(F.min_by(F.struct("boxno", *of), "boxno").alias("x")).select(*PAGE, "x.boxno", "cls", *[f"x.{c}" for c in of])
        made = founder(fresh.where("known")).unionByName(founder(one)).unionByName(taken)
        after = stored(made.join(ended, [*PAGE, "holder"], "left").select(*holders.columns))
        told = lambda df, n: df.select(*PAGE, "holder", "slot", "end", F.lit(n).alias("n"))
        moved = (told(holders, 1).unionByName(told(after, 2)).groupBy(*PAGE, "holder", "slot", "end").agg(F.sum("n").alias("n"))
                 .where("n <> 3").select(*PAGE).distinct())
        if moved.limit(1).count() == 0:
            parts.append(after)
            break
        parts.append(after.join(moved, list(PAGE), "left_anti"))
        holders, rows, reach = (df.join(moved, list(PAGE), "left_semi") for df in (after, rows, reach))
    return reduce(DataFrame.unionByName, parts).where(F.col("end").isNull()).select(*PAGE, "slot", F.col("holder").alias("kept"))


def dedupe_detections(boxes: DataFrame, iou: float = 0.55, containment: float = 0.88) -> DataFrame:
    """Drop duplicate boxes, keeping the better record in the place of the first.

    Boxes with equal region and text form one class, and pairs are found between classes. The walk
    through the boxes of a page is one way for pages of any size, see `_slots`. `edge_touch`
    (optional) marks boxes cut by a tile edge.
    """
    edge = F.coalesce("edge_touch", F.lit(False)) if "edge_touch" in boxes.columns else F.lit(False)
    slim = stored(boxes.select(*PAGE, "boxno", *SIDES, tx.squeeze(F.col("text")).alias("text"),
                               F.coalesce(F.col("score").cast("double"), F.lit(-1.0)).alias("score"), edge.alias("edge")))
    class_key = [*PAGE, *SIDES, "text"]
    solid = (F.col("r") > F.col("l")) & (F.col("b") > F.col("t"))
    classes = stored(slim.where(solid).groupBy(*class_key).agg(F.min("boxno").alias("cls"), F.count(F.lit(1)).alias("n")))
    pairs = stored(duplicate_pairs(classes, iou, containment, node="cls"))
    ways = pairs.select(*PAGE, F.col("u").alias("cls"), F.col("v").alias("other")).unionByName(
        pairs.select(*PAGE, F.col("v").alias("cls"), F.col("u").alias("other")))
    paired = ways.select(*PAGE, "cls").distinct().withColumn("paired", F.lit(True))
    shared = classes.join(paired, [*PAGE, "cls"], "left").where("paired OR n > 1").select(*class_key, "cls")
    members = stored(slim.join(shared, class_key).select(*PAGE, "boxno", "cls", "score", "edge", F.length("text").alias("size")))
    found = _slots(members, ways.unionByName(shared.select(*PAGE, "cls", F.col("cls").alias("other"))))
    in_component = members.select(*PAGE, "boxno", F.lit(True).alias("__member"))
    alone = boxes.join(in_component, [*PAGE, "boxno"], "left_anti").withColumn("__slot", F.col("boxno"))
    kept = boxes.join(found.select(*PAGE, F.col("kept").alias("boxno"), F.col("slot").alias("__slot")), [*PAGE, "boxno"])
    rows = alone.unionByName(kept).withColumnRenamed("boxno", "source_boxno")
    return renumber(rows, "__slot").drop("__slot")
