"""The distributed paths for oversized groups give the same results as plain Python rules."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import batching, detect, graph, group, layout, ranking
from boxloom.session import stored

BOX = "book_id string, page bigint, boxno bigint, l bigint, t bigint, r bigint, b bigint, score double, text string, edge_touch boolean"


def random_boxes(pages, per_page, seed):
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        shapes = [(rng.randrange(0, 60), rng.randrange(0, 60), rng.randrange(10, 50), rng.randrange(10, 50)) for _ in range(6)]
        for n in range(per_page):
            l, t, w, h = rng.choice(shapes)
            if rng.random() < 0.3:
                l, w = l + rng.randrange(0, 6), w + rng.randrange(0, 6)
            rows.append(("b", page, n, l, t, l + w, t + h, rng.choice([None, 0.5, 0.54, 0.56, 0.7, 0.9]), rng.choice(["", "a", "ab", "x y"]), rng.random() < 0.3))
    return rows


def plain_dedupe(rows):
    def area(x):
        return (x[5] - x[3]) * (x[6] - x[4])

    def duplicate(a, b):
        inter = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
        if inter <= 0:
            return False
        if inter / (area(a) + area(b) - inter) >= 0.55:
            return True
        x, y = "".join(a[8].split()), "".join(b[8].split())
        return inter / min(area(a), area(b)) >= 0.88 and (not x or not y or x in y or y in x)

    def better(old, new):
        x, y = "".join(old[8].split()), "".join(new[8].split())
        if bool(x) != bool(y):
            return bool(y)
        if old[9] != new[9]:
            return old[9]
        p, q = (-1 if v[7] is None else v[7] for v in (old, new))
        return q > p + 0.05 or (q >= p and len(y) > len(x))

    slots = []
    for row in rows:
        at = next((i for i, kept in enumerate(slots) if duplicate(row, kept)), None)
        if at is None:
            slots.append(row)
        elif better(slots[at], row):
            slots[at] = row
    return [s[2] for s in slots]


def test_dedupe_matches_a_plain_walk(spark):
    rows = random_boxes(pages=2, per_page=9, seed=5)
    out = detect.dedupe_detections(spark.createDataFrame(rows, BOX)).select("page", "boxno", "source_boxno").collect()
    for page in range(2):
        got = [r.source_boxno for r in sorted((r for r in out if r.page == page), key=lambda r: r.boxno)]
        assert got == plain_dedupe([r for r in rows if r[1] == page])


def test_many_copies_need_few_rounds(spark):
    rows = [("b", 0, n, 0, 0, 50, 50, 0.9 if n == 200 else 0.5, "same", False) for n in range(300)]
    out = detect.dedupe_detections(spark.createDataFrame(rows, BOX)).collect()
    assert [(r.boxno, r.source_boxno) for r in out] == [(0, 200)]


@pytest.mark.parametrize("fold_edges", [256, 0])
def test_components(spark, fold_edges):
    rng = random.Random(3)
    edges = [("b", p, a, c) for p in range(2) for a, c in {tuple(sorted(rng.sample(range(20), 2))) for _ in range(12)}]
    edges += [("b", 9, n, n + 1) for n in range(20)] + [("b", 10, 500, n) for n in range(501, 800)]  # a chain, a hub
    pairs = spark.createDataFrame(edges, "book_id string, page bigint, u bigint, v bigint")
    got = {(r.page, r.node): r.label for r in graph.component_labels(pairs, ["book_id", "page"], fold_edges=fold_edges).collect()}
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, p, a, c in edges:
        parent.setdefault((p, a), (p, a)), parent.setdefault((p, c), (p, c))
        x, y = find((p, a)), find((p, c))
        parent[max(x, y)] = min(x, y)
    assert got == {k: find(k)[1] for k in parent}


PLACED = "book_id string, page bigint, boxno bigint, sl bigint, st bigint, sr bigint, sb bigint, pl bigint, pt bigint, pr bigint, pb bigint"


def plain_cuts(rows):
    """Regions after the cuts of all pairs of a page, one pair after the other."""
    want = {(r[1], r[2]): list(r[7:]) for r in rows}
    source = {(r[1], r[2]): r[3:7] for r in rows}
    for page in {r[1] for r in rows}:
        numbers = sorted(n for p, n in want if p == page)
        for i in numbers:
            for j in (n for n in numbers if n > i):
                a, c, s, z = want[page, i], want[page, j], source[page, i], source[page, j]
                if min(a[2], c[2]) <= max(a[0], c[0]) or min(a[3], c[3]) <= max(a[1], c[1]):
                    continue
                across, down = max(s[0], z[0]) - min(s[2], z[2]), max(s[1], z[1]) - min(s[3], z[3])
                if across <= 0 and down <= 0:
                    continue
                k = 1 if down > across else 0
                (lead, ls), (follow, fs) = ((a, s), (c, z)) if s[k] <= z[k] else ((c, z), (a, s))
                cut = round((ls[k + 2] + fs[k]) / 2)
                lead[k + 2], follow[k] = min(lead[k + 2], cut), max(follow[k], cut)
    return {k: tuple(v) for k, v in want.items()}


def test_overlaps_are_cut_in_pair_order(spark):
    rng = random.Random(11)
    rows = []
    for page in range(2):
        for n in range(5):
            l, t = rng.randrange(0, 70), rng.randrange(0, 70)
            w, h = rng.randrange(5, 25), rng.randrange(5, 25)
            rows.append(("b", page, n, l, t, l + w, t + h, max(0, l - 20), max(0, t - 20), l + w + 20, t + h + 20))
    schema = "book_id string, page bigint, boxno bigint, sl bigint, st bigint, sr bigint, sb bigint, pl bigint, pt bigint, pr bigint, pb bigint"
    got = {(r.page, r.boxno): (r.pl, r.pt, r.pr, r.pb) for r in layout.resolve_overlaps(spark.createDataFrame(rows, schema)).collect()}
    assert got == plain_cuts(rows)


@pytest.mark.parametrize("block", [4096, 12])
def test_batches_match_a_plain_walk(spark, block):
    rng = random.Random(2)
    costs = [(f"b{k}", p * 3, rng.randrange(1, 8), rng.randrange(10, 90)) for k in range(2) for p in range(40)]
    frame = spark.createDataFrame(costs, "book_id string, page bigint, records bigint, chars bigint")
    got = {(r.book_id, r.page): r.batch for r in batching.budget_batches(frame, 6, 100, block=block).collect()}
    want = {}
    for book in ("b0", "b1"):
        n = c = batch = 0
        for _, page, records, chars in (x for x in costs if x[0] == book):
            if n and (n + records > 6 or c + chars > 100):
                n, c, batch = 0, 0, batch + 1
            n, c = n + records, c + chars
            want[book, page] = batch
    assert got == want


def test_numbers_and_running_values_do_not_depend_on_buckets(spark):
    rng = random.Random(7)
    rows = [("g", i, rng.choice([None, rng.randrange(100)])) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    bucket = ranking.position_block(F.col("i"), 16)
    out = ranking.split_running(ranking.split_row_number(frame, ["g"], [F.col("i")], bucket, "n"), ["g"], [F.col("i")], bucket,
                                sums={"total": F.coalesce("v", F.lit(0))}, lasts={"last": F.col("v")}, mins={"low": F.col("v")}).orderBy("i").collect()
    total, last, low = 0, None, None
    for (_, i, v), r in zip(rows, out):
        total += v or 0
        last = v if v is not None else last
        low = v if low is None else (min(low, v) if v is not None else low)
        assert (r.n, r.total, r.last, r.low) == (i, total, last, low)


def test_pairs_across_grid_cells_are_found_once(spark):
    rng = random.Random(4)
    rows = [("b", 0, n, l, t, l + rng.randrange(1, 60), t + rng.randrange(1, 60), 0.5, "", False)
            for n in range(120) for l, t in [(rng.randrange(0, 400), rng.randrange(0, 400))]]
    frame = spark.createDataFrame(rows, BOX)
    match = (F.col("a.boxno") < F.col("b.boxno")) & group.geo.touches(group.geo.region("a"), group.geo.region("b"))
    got = sorted((r.x, r.y) for r in group.near_pairs(frame, frame, group.PAGE, match, cell=32).select(
        F.col("a.boxno").alias("x"), F.col("b.boxno").alias("y")).collect())
    assert got == sorted((a[2], c[2]) for a in rows for c in rows if a[2] < c[2] and a[5] >= c[3] and c[5] >= a[3] and a[6] >= c[4] and c[6] >= a[4])


def plain_pairs(rows, reach=(0, 0)):
    return sorted((a[2], c[2]) for a in rows for c in rows if a[2] < c[2] and max(a[3], c[3]) - min(a[5], c[5]) <= reach[0] and max(a[4], c[4]) - min(a[6], c[6]) <= reach[1])


@pytest.mark.parametrize("crowded", [0, 40, 1024])
def test_pairs_of_boxes_of_every_size(spark, crowded):
    rng = random.Random(9)
    rows = []
    for n in range(150):
        side = rng.choice([0, 1, 5, 20, 60, 300, 4000])
        l, t = rng.randrange(-50, 500), rng.randrange(-50, 500)
        rows.append(("b", 0, n, l, t, l + rng.randint(0, side), t + rng.randint(0, side), 0.5, "", False))
    rows += [("b", 0, 200, 0, 0, 100_000_000, 100_000_000, 0.5, "", False), ("b", 1, 0, 0, 0, 9, 9, 0.5, "", False), ("b", 1, 1, 9, 9, 20, 20, 0.5, "", False)]
    bad = [("b", 0, 300, 9, 0, 3, 5, 0.5, "", False), ("b", 0, 301, 9, 0, None, 5, 0.5, "", False)]
    frame = spark.createDataFrame(rows + bad, BOX)
    a, c = group.geo.region("a"), group.geo.region("b")
    match = (F.col("a.boxno") < F.col("b.boxno")) & (group.geo.x_gap(a, c) <= 7) & (group.geo.y_gap(a, c) <= 3)
    out = group.near_pairs(frame, frame, group.PAGE, match, 7, 3, crowded=crowded, block=8).select(F.col("a.page").alias("p"), F.col("a.boxno").alias("x"), F.col("b.boxno").alias("y")).collect()
    for page in (0, 1):
        assert sorted((r.x, r.y) for r in out if r.p == page) == plain_pairs([r for r in rows if r[1] == page], (7, 3))
    assert sorted((r.boxno, r.code) for r in group.bad_regions(frame).collect()) == [(300, "inverted"), (301, "missing_side")]


def test_boxes_of_a_crowded_page_go_to_their_cells_in_one_shuffle(spark):
    rng = random.Random(10)
    rows = [("b", 0, n, l, t, l + rng.randint(1, 90), t + rng.randint(1, 90), 0.5, "", False)
            for n in range(200) for l, t in [(rng.randrange(0, 600), rng.randrange(0, 600))]]
    frame = stored(spark.createDataFrame(rows, BOX))
    match = (F.col("a.boxno") < F.col("b.boxno")) & group.geo.touches(group.geo.region("a"), group.geo.region("b"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = group.near_pairs(frame, frame, group.PAGE, match, crowded=40)
        got = sorted((r.a.boxno, r.b.boxno) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == plain_pairs(rows)
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([x for x in final.splitlines() if "- Exchange hashpartitioning" in x and "cx#" in x]) == 1


@pytest.mark.parametrize("layout_of_boxes", ["spread", "one place", "one large"])
def test_no_key_of_a_crowded_page_holds_many_candidates(spark, layout_of_boxes):
    n = F.col("id")
    if layout_of_boxes == "spread":
        l, t, side = n * 7919 % 2000, n * 104729 % 3000, 4 + n % 9
    elif layout_of_boxes == "one place":
        l, t, side = n % 3, n % 2, F.lit(10)
    else:
        l, t, side = n * 7919 % 2000, n * 104729 % 3000, F.when(n == 0, 5000).otherwise(5)
    count = 100_000 if layout_of_boxes != "one place" else 5_000
    boxes = spark.range(count).select(F.lit("b").alias("book_id"), F.lit(0).alias("page"), n.alias("boxno"), l.alias("l"), t.alias("t"), (l + side).alias("r"), (t + side).alias("b"))
    keys = [*group.PAGE, "level", "cx", "cy", "block_a", "block_b"]
    total = most = 0
    for a, b in group.cell_blocks(boxes, boxes, group.PAGE):
        met = a.groupBy(*keys).count().withColumnRenamed("count", "x").join(b.groupBy(*keys).count(), keys)
        row = met.agg(F.sum(F.col("x") * F.col("count")).alias("s"), F.max(F.col("x") * F.col("count")).alias("m")).first()
        total, most = total + (row.s or 0), max(most, row.m or 0)
    assert most <= 0.02 * total
    assert total < {"spread": 40_000_000, "one place": 5_000 ** 2 * 5, "one large": 40_000_000}[layout_of_boxes]


def test_a_box_that_overlaps_two_thousand_is_cut_in_pair_order(spark):
    rng = random.Random(6)
    rows = [("b", 0, 1000, 4000, 4000, 4050, 4050, 0, 0, 9000, 9000)]
    for n in [*range(1000), *range(1001, 2001)]:
        l, t = rng.randrange(0, 8900), rng.randrange(0, 8900)
        rows.append(("b", 0, n, l, t, l + 20, t + 20, max(0, l - 60), max(0, t - 60), l + 80, t + 80))
    out = layout.resolve_overlaps(spark.createDataFrame(rows, PLACED))
    assert {(r.page, r.boxno): (r.pl, r.pt, r.pr, r.pb) for r in out.collect()} == plain_cuts(rows)


def test_prior_positions_name_the_prior_translations(spark):
    rng = random.Random(12)
    rows = [("b", p, n, rng.choice([None, "x", "y"])) for p in range(700) if rng.random() < 0.6 for n in range(rng.randint(1, 3))]
    frame = spark.createDataFrame(rows, "book_id string, page bigint, boxno bigint, english_text string")
    asked = spark.createDataFrame([("b", p) for p in (-1, 0, 3, 255, 256, 257, 600, 900)] + [("c", 5)], "book_id string, page bigint")
    records, pages = (t.collect() for t in batching.prior_index(frame, asked))
    want = {(r.for_page, r.page, r.boxno) for r in batching.prior_translations(frame, asked).collect()}
    assert {(p.for_page, r.page, r.boxno) for p in pages for r in records if r.book_id == p.book_id and r.place < p.until} == want
    assert len(pages) == 9 and sorted(r.place for r in records) == list(range(len(records)))


@pytest.mark.parametrize("count,spread", [(60, 60), (1500, 260)])
def test_large_components_are_walked_in_box_order(spark, count, spread):
    rng = random.Random(count)
    rows = []
    for n in range(count):
        l, t, w, h = rng.randrange(0, spread), rng.randrange(0, spread), rng.randrange(30, 50), rng.randrange(30, 50)
        if n % 5 == 4:  # copies of earlier regions
            l, t, w, h = rows[rng.randrange(n)][3:5] + (40, 40)
        rows.append(("b", 0, n, l, t, l + w, t + h, rng.choice([None, 0.5, 0.54, 0.56, 0.7, 0.9]), rng.choice(["", "a", "ab", "x y"]), rng.random() < 0.3))
    out = detect.dedupe_detections(spark.createDataFrame(rows, BOX)).collect()
    assert [r.source_boxno for r in sorted(out, key=lambda r: r.boxno)] == plain_dedupe(rows)


def test_buckets_of_a_crowded_day_are_even(spark):
    n = F.col("id")
    # a million rows of one key in one day: half in one second, a tenth at one instant
    us = F.when(n % 10 == 0, F.lit(5_000_000)).when(n % 2 == 0, 5_000_000 + n % 9000).otherwise(n * 7919 % 86_400_000_000)
    rows = spark.range(1_000_000).select(F.lit("k").alias("job_id"), F.timestamp_micros(us).alias("at"), n.alias("seq"))
    from boxloom.operators.jobs import _instants
    cut = ranking.even_buckets(rows, ["job_id"], _instants("at"), "bucket")
    sizes = [r[1] for r in cut.groupBy("bucket").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) <= 0.02 * 1_000_000
    ranges = cut.groupBy("bucket").agg(F.min(F.struct("at", "seq")).alias("a"), F.max(F.struct("at", "seq")).alias("z")).orderBy("bucket").collect()
    assert all(x.z < y.a for x, y in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_numbers_by_levels_are_those_of_a_plain_sort(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", None]), rng.choice([None, 0, 1]), rng.choice([None, 3, 4, 5]), n) for n in range(200)]
    frame = spark.createDataFrame(rows, "g string, x bigint, y bigint, n bigint")
    cut = ranking.even_buckets(frame, ["g"], [F.col("x"), F.col("y"), F.col("n")], "bucket", size)
    placed = ranking.split_row_number(cut, ["g"], [F.col("x"), F.col("y"), F.col("n")], F.col("bucket"), "place").collect()
    low = lambda v: -1 if v is None else v
    for g in ("a", None):
        order = sorted((r for r in placed if r.g == g), key=lambda r: (low(r.x), low(r.y), r.n))
        assert [r.place for r in order] == list(range(len(order)))
    assert len(placed) == 200
    assert max(r[2] for r in cut.groupBy("g", "bucket").count().collect()) <= 2 * size


def test_signature_sees_every_change_of_a_page_of_many_blocks(spark):
    from boxloom.operators import overlay
    base = spark.range(10_000).select(F.lit("b").alias("book_id"), F.lit(0).alias("page"), F.col("id").alias("pos"), F.concat(F.lit("t"), "id").alias("text"))

    def signed(df):
        return overlay.record_signature(df, ["text"]).first().signature

    want = signed(base)
    swapped = base.withColumn("pos", F.when(F.col("pos") == 10, 5000).when(F.col("pos") == 5000, 10).otherwise(F.col("pos")))
    changed = base.withColumn("text", F.when(F.col("pos") == 9999, None).otherwise(F.col("text")))
    assert signed(base.repartition(7)) == want
    assert len({want, signed(swapped), signed(changed), signed(base.union(base.limit(1))), signed(base.where("pos <> 4096"))}) == 5
    assert overlay.record_signature(base.where("pos < 0"), ["text"]).count() == 0
