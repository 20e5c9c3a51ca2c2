"""Rows are sent and written as few times as needed, and what nobody reads again does not stay on disk."""

import os
import random

from pyspark.sql import functions as F

from boxloom.operators import detect, group, overlay
from boxloom.plans import REGISTRY, registry
from boxloom.plans.registry import Source
from boxloom.session import ensure_checkpoint_dir, stored, stored_in_turn

BOX = "book_id string, page long, boxno long, l long, t long, r long, b long"
LINE = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, "
        "l_tax double, l_shipdate timestamp, l_returnflag string, l_linestatus string")


def lines(spark, path, orders=40, seed=1):
    rng = random.Random(seed)
    keys = [rng.choice([None, *range(orders)]) for _ in range(orders * 4)]
    rows = [(k, rng.choice([1, 2, 3]), rng.randrange(500), rng.randrange(400), rng.random(), float(rng.randint(1, 50)), rng.randint(0, 10) / 100, 0.0, None, "A", "F") for k in keys]
    spark.createDataFrame(rows + rows[:9], LINE).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def plain_pairs(left, right, reach=(0, 0)):
    return sorted((a[2], c[2]) for a in left for c in right if a[1] == c[1] and max(a[3], c[3]) - min(a[5], c[5]) <= reach[0] and max(a[4], c[4]) - min(a[6], c[6]) <= reach[1])


def box_rows(count, first, seed, sides=(0, 3, 20, 90, 400, 6000)):
    rng = random.Random(seed)
    out = []
    for n in range(first, first + count):
        l, t, side = rng.randrange(-40, 1200), rng.randrange(-40, 1200), rng.choice(sides)
        out.append(("b", 0, n, l, t, l + rng.randint(0, side), t + rng.randint(0, side)))
    return out


def test_boxes_of_a_crowded_page_are_sent_to_tiles_not_to_each_of_their_cells(spark):
    rows, others = box_rows(150, 0, 3), box_rows(90, 500, 4)
    left, right = (stored(spark.createDataFrame(x, BOX)) for x in (rows, others))
    a, b = group.geo.region("a"), group.geo.region("b")
    near = (group.geo.x_gap(a, b) <= 5) & (group.geo.y_gap(a, b) <= 2)
    pair = (F.col("a.boxno").alias("x"), F.col("b.boxno").alias("y"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = group.near_pairs(left, left, group.PAGE, near, 5, 2, crowded=10)
        assert sorted(map(tuple, found.select(*pair).collect())) == plain_pairs(rows, rows, (5, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    sent = [x for x in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
            if "- Exchange hashpartitioning" in x and "cx#" in x]
    assert sent and not any("level#" in x for x in sent)
    for tile_boxes in (0, 30, 10_000):
        met = group.near_pairs(left, right, group.PAGE, near, 5, 2, crowded=10, block=16, tile_boxes=tile_boxes).select(*pair)
        assert sorted(map(tuple, met.collect())) == plain_pairs(rows, others, (5, 2))


def test_a_box_is_sent_to_few_tiles(spark):
    boxes = stored(spark.createDataFrame([("b", 0, n, l, t, l + 57, t + 50) for n, l, t in ((n, n * 7919 % 20_000, n * 104_729 % 20_000) for n in range(5000))], BOX))
    sized, levels = group._sized(boxes, boxes, 3, 2, 16)
    assert group._side_tiles(sized[0], [0, 1, *levels], 3, 2, 16).count() < 1.5 * 5000


def test_shuffles_of_a_written_table_go_with_it(spark):
    frame = spark.range(2000).groupBy((F.col("id") % 300).alias("k")).agg(F.collect_list("id").alias("x"))
    before = shuffle_files(spark)
    table = stored(frame)
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sorted_rows(table.select("k", F.sort_array("x"))) == sorted_rows(frame.select("k", F.sort_array("x")))


def test_what_a_part_wrote_on_its_way_is_removed(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    kept = stored(spark.range(5))
    before = {x for x in os.listdir(folder) if x.startswith("table-")}
    seen = []

    def parts():
        for i in range(3):
            seen.append(len({x for x in os.listdir(folder) if x.startswith("table-")} - before))
            yield stored(stored(spark.range(i * 10, i * 10 + 10)).where("id % 2 = 0"))

    out = stored_in_turn(spark, parts())
    assert sorted(r.id for r in out.collect()) == list(range(0, 30, 2)) and kept.count() == 5
    assert len({x for x in os.listdir(folder) if x.startswith("table-")} - before) == 1 and max(seen) <= 1


def test_boxes_kept_share_by_share_are_all_boxes(spark, tmp_path, monkeypatch):
    folder = lines(spark, tmp_path)
    want = sorted_rows(Source(spark, folder).boxes)
    monkeypatch.setattr(registry, "SHARE_ROWS", 30)
    source = Source(spark, folder)
    assert source._shares() > 3
    assert sorted_rows(source.kept("boxes")) == want


def test_detections_of_ordinary_pages_are_numbered_in_one_shuffle(spark):
    rng = random.Random(7)
    rows = [("b", page, n, rng.randrange(3), rng.randrange(2)) for page, count in ((None, 5), (1, 6), (2, 1)) for n in range(count)]
    crowd = [("b", 3, n, n % 3, n % 2) for n in range(2500)]
    shape = "book_id string, page long, boxno long, x long, y long"

    def numbered(some):
        full = stored(spark.createDataFrame(some, shape))
        tiles = full.withColumn("source", F.lit("tile"))
        return detect.combine_sources(full.drop("x", "y"), tiles, held=True).select("page", "boxno", "source", "pos")

    def plain(some):
        out = []
        for page in {r[1] for r in some}:
            here = [r for r in some if r[1] == page]
            order = sorted([(0, -1, -1, r[2]) for r in here] + [(1, r[4], r[3], r[2]) for r in here])
            out += [(str(page), no, "tile" if k else "full_image", pos) for pos, (k, _, _, no) in enumerate(order)]
        return sorted(out)

    for some in (rows, rows + crowd):
        made = numbered(some)
        assert sorted((str(r.page), r.boxno, r.source, r.pos) for r in made.collect()) == plain(some)
        if some is rows:
            assert made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    full = stored(spark.createDataFrame(rows, shape))
    lazy = detect.combine_sources(full.drop("x", "y"), full.withColumn("source", F.lit("tile")))
    assert sorted((str(r.page), r.boxno, r.source, r.pos) for r in lazy.collect()) == plain(rows)


def test_sources_are_combined_share_by_share(spark, tmp_path, monkeypatch):
    folder = lines(spark, tmp_path)
    want = sorted_rows(REGISTRY["combine_sources"].run(spark, folder))
    monkeypatch.setattr(registry, "SHARE_ROWS", 60)
    assert sorted_rows(REGISTRY["combine_sources"].run(spark, folder)) == want


def test_groups_that_ask_for_the_same_number(spark):
    groups = spark.createDataFrame([("b", 0, g, [g], "x", 0, 0, 9, 9) for g in range(3)],
                                   "book_id string, page long, boxno long, source_boxnos array<long>, text string, l long, t long, r long, b long")
    boxes = spark.createDataFrame([("b", 0, n, 0, 0, 9, 9) for n in range(3)], BOX).withColumn("text", F.lit("x"))
    shape = groups.select("book_id", "page", "boxno", "source_boxnos")
    saved = spark.createDataFrame([("b", 0, 7, [1]), ("b", 0, 7, [2])], shape.schema)
    none = shape.where("false")
    out = overlay.pending_descendants(groups, boxes, none, saved, none.withColumn("source", F.col("boxno")), shape.where("boxno = 0"))
    assert sorted((r.source_boxnos[0], r.boxno) for r in out.collect()) == [(0, 8), (1, 7), (2, 2)]


def test_pending_groups_are_made_share_by_share(spark, tmp_path, monkeypatch):
    folder = lines(spark, tmp_path)
    whole = REGISTRY["pending_descendants"].run(spark, folder)
    want = sorted_rows(whole)
    assert want and "Window" in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(registry, "SHARE_ROWS", 60)
    shared = REGISTRY["pending_descendants"].run(spark, folder)
    assert sorted_rows(shared) == want
    assert "Exchange" not in shared._jdf.queryExecution().executedPlan().toString()
