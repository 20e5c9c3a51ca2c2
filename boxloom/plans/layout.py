"""Placement of text over the box table, and every geometry function over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import geometry as geo
from boxloom.operators import layout
from boxloom.plans.answering import FAULTS, answer_table, page_sizes
from boxloom.plans.grouping import page_size
from boxloom.plans.registry import query

PAGE = ("book_id", "page")
R = "cast(round_even({}, 0) AS bigint)"


def rnd(x: str) -> str:
    return f"cast(round_even({x}, 0) AS bigint)"


@query("geometry_measures", """
    SELECT a.book_id, a.page, a.boxno, a.r - a.l AS w, a.b - a.t AS h, (a.l + a.r) / 2.0 AS cx, (a.t + a.b) / 2.0 AS cy,
      greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) AS xo, greatest(0, greatest(a.t, b.t) - least(a.b, b.b)) AS yg,
      (a.r - a.l) * (a.b - a.t) AS area, greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t)) AS inter,
      (greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t))) /
        ((a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) - greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t))) AS iou,
      (greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t))) / least((a.r - a.l) * (a.b - a.t), (b.r - b.l) * (b.b - b.t)) AS containment
    FROM boxes a JOIN boxes b ON a.book_id = b.book_id AND a.page = b.page AND b.boxno = a.boxno + 1
    WHERE least((a.r - a.l) * (a.b - a.t), (b.r - b.l) * (b.b - b.t)) > 0""", ("boxes",))
def geometry_measures(s):
    boxes = s.boxes
    after = boxes.select(*PAGE, (F.col("boxno") - 1).alias("boxno"), *[F.col(c).alias(f"n_{c}") for c in "ltrb"])
    a, b = geo.region(), geo.region(prefix="n_")
    joined = boxes.join(after, [*PAGE, "boxno"]).where((geo.area(a) > 0) & (geo.area(b) > 0))
    return joined.select(*PAGE, "boxno", geo.width(a).alias("w"), geo.height(a).alias("h"), geo.center_x(a).alias("cx"),
                         geo.center_y(a).alias("cy"), geo.x_overlap(a, b).alias("xo"), geo.y_gap(a, b).alias("yg"),
                         geo.area(a).alias("area"), geo.intersection(a, b).alias("inter"), geo.iou(a, b).alias("iou"),
                         geo.containment(a, b).alias("containment"))


@query("polygon_region", """
    SELECT book_id, page, boxno, greatest(0, l - 3) AS l, t, least(320, r + 1) AS r, least(480, b + 1) AS b FROM boxes""", ("boxes",))
def polygon_region(s):
    x, y, w, h = (F.col(c).cast("double") for c in "ltrb")
    points = F.array(F.array(x - 2.5, y + 0.5), F.array(w + 0.25, y), F.array(w, h + 0.75))
    return s.boxes.select(*PAGE, "boxno", *geo.polygon_region(points, *page_size()).columns())


@query("pad_and_clip", """
    SELECT book_id, page, boxno, greatest(0, l - 4) AS l, greatest(0, t - 6) AS t, least(320, r + 4) AS r, least(480, b + 6) AS b FROM boxes""", ("boxes",))
def pad_and_clip(s):
    w, h = page_size()
    return s.boxes.select(*PAGE, "boxno", *[c.cast("bigint").alias(n) for c, n in zip(geo.pad_region(geo.region(), 4, 6, w, h), "ltrb")])


@query("scale_region", f"""
    SELECT book_id, page, boxno, {rnd('l * (750 / 320)')} AS l, {rnd('t * (1000 / 480)')} AS t, {rnd('r * (750 / 320)')} AS r, {rnd('b * (1000 / 480)')} AS b,
      l * (750 / 320) AS px FROM boxes""", ("boxes",))
def scale_region(s):
    w, h = page_size()
    to_w, to_h = F.lit(750), F.lit(1000)
    points = geo.scale_points(F.array(F.array(F.col("l").cast("double"), F.col("t").cast("double"))), w, h, to_w, to_h)
    return s.boxes.select(*PAGE, "boxno", *geo.scale_region(geo.region(), w, h, to_w, to_h).columns(),
                          F.get(F.get(points, F.lit(0)), F.lit(0)).alias("px"))


@query("region_to_thousandths", f"""
    SELECT book_id, page, boxno, {rnd('t / 480 * 1000')} AS y0, {rnd('l / 320 * 1000')} AS x0, {rnd('b / 480 * 1000')} AS y1, {rnd('r / 320 * 1000')} AS x1 FROM boxes""", ("boxes",))
def region_to_thousandths(s):
    box = geo.region_to_thousandths(geo.region(), *page_size())
    return s.boxes.select(*PAGE, "boxno", *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("y0", "x0", "y1", "x1"))])


EXPANDED = f"""
    e AS (SELECT *, (l + r) / 2.0 AS cx, (t + b) / 2.0 AS cy, (r - l) * (1 + 0.5) / 2 AS hw, (b - t) * (1 + 0.25) / 2 AS hh FROM boxes)"""


@query("expand", EXPANDED + f"""
    SELECT book_id, page, boxno, greatest(0, {rnd('cx - hw')}) AS l, greatest(0, {rnd('cy - hh')}) AS t, least(320, {rnd('cx + hw')}) AS r, least(480, {rnd('cy + hh')}) AS b FROM e""", ("boxes",))
def expand(s):
    g = geo.expand(geo.region(), F.lit(0.5), F.lit(0.25), *page_size())
    return s.boxes.select(*PAGE, "boxno", *[c.cast("bigint").alias(n) for c, n in zip(g, "ltrb")])


CONTAINER = f"""
    e AS (SELECT *, (l + r) / 2.0 AS cx, (t + b) / 2.0 AS cy, (b - t) * (1 + 0.25) / 2 AS hh, 0.1 * 320 AS cl, 0.7 * 320 AS cr FROM boxes),
    f AS (SELECT *, least(cr - cl, greatest(cast(r - l AS double), (cr - cl) * 0.5)) AS tw FROM e),
    g AS (SELECT *, CASE WHEN cx - tw / 2 < cl THEN cl ELSE cx - tw / 2 END AS x0, CASE WHEN cx - tw / 2 < cl THEN cx + tw / 2 + (cl - (cx - tw / 2)) ELSE cx + tw / 2 END AS x1 FROM f)"""


@query("expand_to_container", CONTAINER.replace("0.1 * 320", "cast(0.1 AS double) * 320").replace("0.7 * 320", "cast(0.7 AS double) * 320") + f"""
    SELECT book_id, page, boxno, {rnd('greatest(0.0, CASE WHEN x1 > cr THEN x0 - (x1 - cr) ELSE x0 END)')} AS l, {rnd('greatest(0.0, cy - hh)')} AS t,
      {rnd('least(320.0, least(x1, cr))')} AS r, {rnd('least(480.0, cy + hh)')} AS b FROM g""", ("boxes",))
def expand_to_container(s):
    g = geo.expand_to_container(geo.region(), F.lit(0.5), F.lit(0.1), F.lit(0.7), F.lit(0.25), *page_size())
    return s.boxes.select(*PAGE, "boxno", *g.columns())


@query("crop_with_margin", """
    h AS (SELECT book_id, page, boxno, cast(floor((l + r) / 2) AS bigint) - cast(floor((r - l + 60) / 2) AS bigint) AS x0, cast(floor((l + r) / 2) AS bigint) + cast(floor((r - l + 60) / 2) AS bigint) AS x1,
        cast(floor((t + b) / 2) AS bigint) - cast(floor((b - t + 60) / 2) AS bigint) AS y0, cast(floor((t + b) / 2) AS bigint) + cast(floor((b - t + 60) / 2) AS bigint) AS y1 FROM boxes)
    SELECT book_id, page, boxno, greatest(0, greatest(x0, 0) - greatest(0, x1 - 320)) AS l, greatest(0, greatest(y0, 0) - greatest(0, y1 - 480)) AS t,
      least(320, least(x1, 320) + greatest(0, -x0)) AS r, least(480, least(y1, 480) + greatest(0, -y0)) AS b FROM h""", ("boxes",))
def crop_with_margin(s):
    return s.boxes.select(*PAGE, "boxno", *[c.cast("bigint").alias(n) for c, n in zip(geo.crop_with_margin(geo.region(), *page_size(), 30), "ltrb")])


@query("found_area", f"""
    f AS (SELECT *, r - l AS w, b - t AS h, (r - l) - 4 AS sw, (b - t) - (boxno % 9) AS sh, boxno % 6 AS hits, boxno % 5 AS cardinal FROM boxes)
    SELECT book_id, page, boxno, CASE WHEN w <= 12 OR h <= 12 THEN 0 ELSE 4 END AS inset_px,
      CASE WHEN cardinal < 3 THEN 'insufficient_cardinal_ray_boundaries' WHEN hits < 4 THEN 'insufficient_total_ray_boundaries'
        WHEN w < 8 OR h < 8 THEN 'ray_region_too_small' WHEN w * h > 320 * 480 * 0.5 THEN 'ray_region_too_large'
        WHEN w <= greatest(sw + 4, {rnd('sw * 1.15')}) AND h <= greatest(sh + 4, {rnd('sh * 1.05')}) THEN 'ray_region_not_larger_than_ocr_box' END AS reason FROM f""", ("boxes",))
def found_area(s):
    g, n = geo.region(), F.col("boxno")
    source = geo.Region(g.l + 2, g.t, g.r - 2, g.b - n % 9)
    return s.boxes.select(*PAGE, "boxno", geo.inset_region(g)[1].cast("int").alias("inset_px"),
                          geo.found_area_rejection(g, source, *page_size(), n % 6, n % 5).alias("reason"))


@query("point_sizes", """
    p AS (SELECT book_id, page, boxno, r - l AS w, b - t AS h, cast(600 + page % 4000 AS double) AS ph, CASE WHEN boxno % 3 = 0 THEN 2.0 WHEN boxno % 3 = 1 THEN 0.0 END AS sw,
        CASE WHEN boxno % 2 = 0 THEN 20.0 END AS lo, CASE WHEN boxno % 4 = 1 THEN 30.0 END AS hi FROM boxes),
    q AS (SELECT *, greatest(coalesce(greatest(1.0, lo), 14.0), greatest(14.0, ph * cast(0.008 AS double))) AS mn FROM p)
    SELECT book_id, page, boxno, CASE WHEN coalesce(sw, 3.0) = 0 THEN 0.0 ELSE cast(greatest(coalesce(sw, 3.0), greatest(3.0, round_even(ph * 0.0012, 0))) AS double) END AS stroke,
      cast(mn AS double) AS min_point, cast(greatest(mn, least(coalesce(hi, 1e9), greatest(mn, greatest(1.0, ph * cast(0.024 AS double))), greatest(mn, w * cast(0.24 AS double)), greatest(mn, h * cast(0.3 AS double)))) AS double) AS max_point FROM q""", ("boxes",))
def point_sizes(s):
    n, g = F.col("boxno"), geo.region()
    ph = (600 + F.col("page") % 4000).cast("double")
    stroke = F.when(n % 3 == 0, 2.0).when(n % 3 == 1, 0.0)
    low, high = F.when(n % 2 == 0, 20.0), F.when(n % 4 == 1, 30.0)
    return s.boxes.select(*PAGE, "boxno", geo.scaled_stroke_width(stroke, ph).alias("stroke"), geo.scaled_min_point(low, ph).alias("min_point"),
                          geo.scaled_max_point(low, high, geo.width(g), geo.height(g), ph).alias("max_point"))


# placements ------------------------------------------------------------------------------

PLACED = """
    placed AS (SELECT book_id, page, boxno, l AS sl, t AS st, r AS sr, b AS sb, greatest(0, l - 20) AS pl, greatest(0, t - 12) AS pt, least(320, r + 20) AS pr, least(480, b + 12) AS pb FROM boxes)"""


def placed(boxes):
    w, h = page_size()
    return boxes.select(*PAGE, "boxno", *[F.col(c).alias(f"s{c}") for c in "ltrb"],
                        *[c.cast("bigint").alias(n) for c, n in zip(geo.pad_region(geo.region(), 20, 12, w, h), layout.PLACED)])


OVERLAPS = PLACED + f""",
    pr AS (SELECT a.book_id, a.page, a.boxno AS u, b.boxno AS v, greatest(a.sl, b.sl) - least(a.sr, b.sr) AS hg, greatest(a.st, b.st) - least(a.sb, b.sb) AS vg,
        a.sl AS al, a.st AS at_, a.sr AS ar, a.sb AS ab, b.sl AS bl, b.st AS bt, b.sr AS br, b.sb AS bb
      FROM placed a JOIN placed b ON a.book_id = b.book_id AND a.page = b.page AND a.boxno < b.boxno
      WHERE least(a.pr, b.pr) > greatest(a.pl, b.pl) AND least(a.pb, b.pb) > greatest(a.pt, b.pt)),
    cuts AS (SELECT book_id, page, u, v, CASE WHEN vg > hg THEN 'vertical' ELSE 'horizontal' END AS axis,
        {rnd("(CASE WHEN vg > hg THEN CASE WHEN at_ <= bt THEN ab + bt ELSE bb + at_ END ELSE CASE WHEN al <= bl THEN ar + bl ELSE br + al END END) / 2.0")} AS cut,
        CASE WHEN vg > hg THEN at_ <= bt ELSE al <= bl END AS u_first FROM pr WHERE hg > 0 OR vg > 0)"""


@query("overlap_pairs", OVERLAPS + " SELECT * FROM cuts", ("boxes",))
def overlap_pairs(s):
    return layout.overlap_pairs(placed(s.boxes))


@query("resolve_overlaps", OVERLAPS + """,
    ord AS (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY u, v) AS k, count(*) OVER (PARTITION BY book_id, page) AS n FROM cuts),
    walk AS (SELECT book_id, page, boxno, pl, pt, pr, pb, false AS adjusted, cast(0 AS bigint) AS k FROM placed
      UNION ALL
      SELECT w.book_id, w.page, w.boxno, CASE WHEN hit AND NOT low_side AND c.axis = 'horizontal' THEN greatest(w.pl, c.cut) ELSE w.pl END,
        CASE WHEN hit AND NOT low_side AND c.axis = 'vertical' THEN greatest(w.pt, c.cut) ELSE w.pt END,
        CASE WHEN hit AND low_side AND c.axis = 'horizontal' THEN least(w.pr, c.cut) ELSE w.pr END,
        CASE WHEN hit AND low_side AND c.axis = 'vertical' THEN least(w.pb, c.cut) ELSE w.pb END, w.adjusted OR hit, w.k + 1
      FROM walk w JOIN ord c ON c.book_id = w.book_id AND c.page = w.page AND c.k = w.k + 1
        JOIN walk a ON a.book_id = w.book_id AND a.page = w.page AND a.boxno = c.u AND a.k = w.k
        JOIN walk b ON b.book_id = w.book_id AND b.page = w.page AND b.boxno = c.v AND b.k = w.k
        CROSS JOIN LATERAL (SELECT (w.boxno = c.u OR w.boxno = c.v) AND least(a.pr, b.pr) > greatest(a.pl, b.pl) AND least(a.pb, b.pb) > greatest(a.pt, b.pt) AS hit,
          (w.boxno = c.u) = c.u_first AS low_side) h)
    SELECT book_id, page, boxno, pl, pt, pr, pb, adjusted FROM (SELECT *, max(k) OVER (PARTITION BY book_id, page) AS last FROM walk) x WHERE k = last""", ("boxes",))
def resolve_overlaps(s):
    return layout.resolve_overlaps(placed(s.boxes)).select(*PAGE, "boxno", *layout.PLACED, "adjusted")


BLOCKERS = f"""
    d AS (SELECT *, r - l AS w, b - t AS h FROM boxes),
    hp AS (SELECT *, {rnd('greatest(2.0, least(6.0, w * 0.05))')} AS px, {rnd('greatest(4.0, least(8.0, h * 0.04))')} AS py, {rnd('greatest(24.0, least(48.0, h * 0.22))')} AS sy,
        least(w, greatest(18, {rnd('w * 0.55')})) AS sw FROM d WHERE r > l AND b > t),
    blk AS (SELECT book_id, page, boxno, 'hard' AS kind, greatest(0, l - px) AS l, greatest(0, t - py) AS t, least(320, r + px) AS r, least(480, b + py) AS b FROM hp
      UNION ALL SELECT book_id, page, boxno, 'shadow', greatest(0, {rnd('(l + r) / 2.0 - sw / 2.0')}), greatest(0, t - sy), least(320, {rnd('(l + r) / 2.0 + sw / 2.0')}), least(480, b + sy) FROM hp)"""


@query("blocker_regions", BLOCKERS + " SELECT * FROM blk", ("boxes",))
def blocker_regions(s):
    return layout.blocker_regions(s.boxes.join(page_sizes(s.boxes), list(PAGE)))


@query("blockers_in_search", BLOCKERS + f""",
    win AS (SELECT book_id, page, boxno, greatest(0, l - px) AS l, greatest(0, t - py) AS t, least(320, r + px) AS r, least(480, b + py) AS b FROM
      (SELECT *, greatest(80, (r - l) * 3, {rnd('greatest(r - l, b - t) * 1.5')}) AS px, greatest(80, (b - t) * 3, {rnd('greatest(r - l, b - t) * 1.5')}) AS py FROM boxes WHERE boxno % 3 <> 0) x)
    SELECT w.book_id, w.page, w.boxno, k.boxno AS blocker, k.kind, k.l, k.t, k.r, k.b FROM win w JOIN blk k ON w.book_id = k.book_id AND w.page = k.page AND w.boxno <> k.boxno
    WHERE least(w.r, k.r) > greatest(w.l, k.l) AND least(w.b, k.b) > greatest(w.t, k.t)""", ("boxes",))
def blockers_in_search(s):
    boxes = s.boxes.join(page_sizes(s.boxes), list(PAGE))
    window = geo.search_window(geo.region(), F.col("width"), F.col("height"))
    search = boxes.where(F.col("boxno") % 3 != 0).select(*PAGE, "boxno", *[c.cast("bigint").alias(n) for c, n in zip(window, "ltrb")])
    return layout.blockers_in_search(boxes, search)


@query("combine_placements", CONTAINER.replace("0.1 * 320", "cast(0.1 AS double) * 320").replace("0.7 * 320", "cast(0.7 AS double) * 320") + f""",
    rel AS (SELECT book_id, page, boxno, (l + r) / 2.0 AS cx, (t + b) / 2.0 AS cy, (r - l) * (1 + 0.5) / 2 AS hw, (b - t) * (1 + 0.25) / 2 AS hh FROM boxes)
    SELECT book_id, page, boxno, 'answer' AS method, l + 1 AS pl, t + 1 AS pt, r + 1 AS pr, b + 1 AS pb FROM boxes WHERE boxno % 4 = 0
    UNION ALL SELECT book_id, page, boxno, 'region', l, t, r, b FROM boxes WHERE boxno % 4 = 1
    UNION ALL SELECT book_id, page, boxno, 'container', {rnd('greatest(0.0, CASE WHEN x1 > cr THEN x0 - (x1 - cr) ELSE x0 END)')}, {rnd('greatest(0.0, cy - hh)')},
      {rnd('least(320.0, least(x1, cr))')}, {rnd('least(480.0, cy + hh)')} FROM g WHERE boxno % 4 = 2
    UNION ALL SELECT book_id, page, boxno, 'relative', greatest(0, {rnd('cx - hw')}), greatest(0, {rnd('cy - hh')}), least(320, {rnd('cx + hw')}), least(480, {rnd('cy + hh')}) FROM rel WHERE boxno % 4 = 3""", ("boxes",))
def combine_placements(s):
    boxes, n = s.boxes.withColumn("open_lettering", F.col("boxno") % 4 == 0), F.col("boxno")
    answered = boxes.where("open_lettering").select(*PAGE, "boxno", *[(F.col(c) + 1).alias(f"p{c}") for c in "ltrb"])
    given, contained = n % 4 == 1, n % 4 == 2
    expansions = boxes.where(~F.col("open_lettering")).select(
        *PAGE, "boxno", *[F.when(given, F.col(c)).alias(f"p{c}") for c in "ltrb"],
        F.when(contained, 0.5).alias("target_width_ratio"), F.when(contained, 0.1).alias("container_x_min"),
        F.when(contained, 0.7).alias("container_x_max"), F.lit(0.5).alias("box_widening"), F.lit(0.25).alias("height_increase"))
    return layout.combine_placements(boxes, answered, expansions, page_sizes(boxes)).select(*PAGE, "boxno", "method", *layout.PLACED)


@query("attach_placements", FAULTS + f""",
    th AS (SELECT book_id, page, boxno, round_even(t / 480 * 1000, 0) AS y0, round_even(l / 320 * 1000, 0) AS x0, round_even(b / 480 * 1000, 0) AS y1, round_even(r / 320 * 1000, 0) AS x1 FROM boxes JOIN good USING (book_id, page))
    SELECT book_id, page, boxno, CASE WHEN boxno % 2 = 0 THEN {rnd('x0 / 1000 * 320')} ELSE 32 END AS pl, CASE WHEN boxno % 2 = 0 THEN {rnd('y0 / 1000 * 480')} ELSE 48 END AS pt,
      CASE WHEN boxno % 2 = 0 THEN {rnd('x1 / 1000 * 320')} ELSE 96 END AS pr, CASE WHEN boxno % 2 = 0 THEN {rnd('y1 / 1000 * 480')} ELSE 144 END AS pb,
      CASE WHEN boxno % 3 = 0 THEN 'NATION_3.ttf' END AS font, 'white' AS fill, CASE WHEN boxno % 3 = 1 THEN cast(2.5 AS double) END AS size_percent FROM th""", ("boxes",))
def attach_placements(s):
    n = F.col("boxno")
    where = F.when(n % 2 == 0, F.concat(F.lit('"placementRegion":['), F.concat_ws(",", "l", "t", "r", "b"), F.lit('],"box_2d":[0,0,9,9]'))) \
             .otherwise('"box_2d":[100,100,300,300]')
    row = F.concat(F.lit('{"page":'), "page", F.lit(',"boxno":'), n, F.lit(","), where, F.lit(',"color":"White"'),
                   F.when(n % 3 == 0, ',"font":"x/NATION_3.ttf"').when(n % 3 == 1, ',"fontSizeWidthPercent":2.5').otherwise(""), F.lit("}"))
    extra = F.concat(F.lit('{"page":'), F.col("page"), F.lit(',"boxno":#,"box_2d":[0,0,9,9]}'))
    boxes = s.kept("boxes")
    rows = boxes.where(F.col("book_id").isNotNull() & F.col("page").isNotNull())
    answers = answer_table(rows, row, extra)
    fonts = s.nation.select(F.concat("n_name", F.lit(".ttf")).alias("font"))
    return layout.attach_placements(boxes, answers, page_sizes(boxes), fonts)[0].select(
        *PAGE, "boxno", *layout.PLACED, "font", "fill", F.col("fontSizeWidthPercent").alias("size_percent"))


# render ----------------------------------------------------------------------------------

@query("render_rows", """
    SELECT book_id, page, boxno, CASE WHEN boxno % 3 = 0 THEN l + 5 ELSE l END AS l, t, r, b, CASE WHEN boxno % 4 = 1 THEN concat(text, chr(10), 'x') WHEN boxno % 5 <> 2 THEN text END AS text,
      CASE WHEN boxno % 2 = 0 THEN 'f.ttf' ELSE 'default' END AS font, CASE WHEN boxno % 3 = 1 THEN 'White' ELSE 'black' END AS fill,
      CASE WHEN boxno % 6 = 5 THEN 'red' WHEN boxno % 3 = 1 THEN 'black' ELSE 'white' END AS stroke, CASE WHEN boxno % 2 = 1 THEN 1.5 ELSE 3.0 END AS stroke_width, 'center' AS gravity, boxno % 5 <> 2 AS translated,
      CASE WHEN boxno % 4 = 1 THEN concat(text, chr(10), 'x') END AS manual_line_breaks, CASE WHEN boxno % 3 = 2 THEN cast(boxno AS double) END AS rotation, cast(boxno + 1 AS double) AS line_spacing FROM boxes""".replace("1.5 ELSE 3.0", "cast(1.5 AS double) ELSE cast(3.0 AS double)"), ("boxes",))
def render_rows(s):
    n = F.col("boxno")
    records = s.boxes.select(
        *PAGE, "boxno", "l", "t", "r", "b", F.when(n % 3 == 0, F.col("l") + 5).alias("pl"), F.col("t").alias("pt"), F.col("r").alias("pr"), F.col("b").alias("pb"),
        F.when(n % 5 != 2, F.col("text")).alias("english_text"),
        F.when(n % 4 == 1, F.concat("text", F.lit("\nx"))).when(n % 4 == 2, "  ").alias("manual_line_breaks"),
        F.when(n % 2 == 0, "f.ttf").otherwise(" ").alias("font"), F.when(n % 3 == 1, "White").alias("fill"), F.when(n % 6 == 5, "red").alias("stroke"),
        F.when(n % 2 == 1, 1.5).alias("stroke_width"), F.lit(None).cast("string").alias("gravity"),
        F.when(n % 3 == 2, n).alias("rotation"), (n + 1).alias("line_spacing"))
    return layout.render_rows(records)


@query("clean_rows", """
    u AS (SELECT book_id, page, boxno, l, t, r, b, 'record' AS origin FROM boxes WHERE boxno % 3 <> 0
      UNION ALL SELECT book_id, page, boxno, l + 100, t, r + 100, b, 'manual' FROM boxes WHERE boxno % 5 = 0),
    p AS (SELECT book_id, page, boxno, origin, greatest(0, l - 4) AS l, greatest(0, t - 4) AS t, least(320, r + 4) AS r, least(480, b + 4) AS b FROM u)
    SELECT * FROM p WHERE r > l AND b > t""", ("boxes",))
def clean_rows(s):
    boxes = s.boxes.withColumn("open_lettering", F.col("boxno") % 3 == 0)
    manual = boxes.where(F.col("boxno") % 5 == 0).select(*PAGE, "boxno", (F.col("l") + 100).alias("l"), "t", (F.col("r") + 100).alias("r"), "b")
    rows = layout.clean_rows(boxes, manual, page_sizes(boxes))
    return rows.select(*PAGE, "boxno", "origin", *[F.col(c).cast("bigint").alias(c) for c in "ltrb"])


CLAMPED = """
    m AS (SELECT book_id, page, boxno, cast(round_even(l + 150.5, 0) AS bigint) AS l, cast(round_even(t - 60.5, 0) AS bigint) AS t, cast(round_even(r + 150.5, 0) AS bigint) AS r, cast(round_even(b - 60.5, 0) AS bigint) AS b FROM boxes),
    c AS (SELECT book_id, page, boxno, l AS l0, greatest(0, least(320, l)) AS l, greatest(0, least(480, t)) AS t, greatest(0, least(320, r)) AS r, greatest(0, least(480, b)) AS b FROM m)"""


@query("clamp_regions", CLAMPED + " SELECT book_id, page, boxno, l, t, r, b, r > l AND b > t AS valid FROM c", ("boxes",))
def clamp_regions(s):
    moved = s.boxes.select(*PAGE, "boxno", (F.col("l") + 150.5).alias("l"), (F.col("t") - 60.5).alias("t"), (F.col("r") + 150.5).alias("r"), (F.col("b") - 60.5).alias("b"))
    rows = layout.clamp_regions(moved.join(page_sizes(s.boxes), list(PAGE)))
    return rows.select(*PAGE, "boxno", *[F.col(c).cast("bigint").alias(c) for c in "ltrb"], "valid")


@query("render_check", """
    SELECT book_id, page, boxno, 'rotation' AS code FROM boxes WHERE boxno % 3 = 0 AND page % 400 > 180
    UNION ALL SELECT book_id, page, boxno, 'skew_x' FROM boxes WHERE boxno % 4 = 1 AND page % 100 > 60
    UNION ALL SELECT book_id, page, boxno, 'stroke_width' FROM boxes WHERE page % 7 = 0
    UNION ALL SELECT book_id, page, boxno, 'font_size_width_percent' FROM boxes WHERE page % 200 = 0 OR page % 200 > 100
    UNION ALL SELECT book_id, page, boxno, 'text' FROM boxes WHERE boxno % 5 = 2
    UNION ALL SELECT book_id, page, boxno, 'outside_page' FROM boxes WHERE boxno = 6
    UNION ALL SELECT book_id, page, boxno, 'empty_region' FROM boxes WHERE boxno = 7
    UNION ALL SELECT book_id, page, boxno, 'render_bleed_page' FROM boxes WHERE page % 11 = 3""", ("boxes",))
def render_check(s):
    n, p = F.col("boxno"), F.col("page")
    null = F.lit(None).cast("double")
    move = F.when(n == 6, 1000).otherwise(0)
    rows = s.boxes.select(
        *PAGE, "boxno", (F.col("l") + move).alias("l"), "t", F.when(n == 7, F.col("l")).otherwise(F.col("r") + move).alias("r"), "b",
        F.lit(320).alias("width"), F.lit(480).alias("height"), F.when(n % 5 != 2, F.col("text")).alias("text"),
        F.when(n % 3 == 0, -(p % 400)).alias("rotation"), F.when(n % 4 == 1, p % 100).alias("skew_x"), null.alias("skew_y"), null.alias("line_spacing"),
        F.when(p % 7 == 0, -1).otherwise(2).alias("stroke_width"), null.alias("min_point_size"), F.lit(9).alias("max_point_size"),
        (p % 200).alias("font_size_width_percent"), F.when(p % 11 == 3, 600).alias("render_bleed"), F.lit("x").alias("manual_line_breaks"))
    return layout.render_check(rows)


CLEANBOX = """
    cb AS (SELECT book_id, page, CASE WHEN page % 9 = 0 AND boxno = 1 THEN 'm0' WHEN page % 9 = 1 AND boxno = 0 THEN '' ELSE concat('m', boxno) END AS record_id,
        CASE WHEN page % 9 = 2 AND boxno = 2 THEN 0 ELSE boxno END AS boxno, CASE WHEN page % 9 = 3 THEN l + 400 ELSE l END AS l, t, CASE WHEN page % 9 = 3 THEN r + 400 ELSE r END AS r, b FROM boxes),
    ce AS (SELECT book_id, page, 'repeated_record_id' AS code, record_id AS key FROM cb GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT book_id, page, 'repeated_boxno', cast(boxno AS varchar) FROM cb GROUP BY ALL, boxno HAVING count(*) > 1
      UNION ALL SELECT book_id, page, CASE WHEN record_id = '' THEN 'bad_record_id' ELSE 'outside_page' END, record_id FROM cb WHERE record_id = '' OR l >= 320)"""


def _clean_check(s):
    n, p = F.col("boxno"), F.col("page")
    move = F.when(p % 9 == 3, 400).otherwise(0)
    rows = s.boxes.select(
        *PAGE, F.when((p % 9 == 0) & (n == 1), "m0").when((p % 9 == 1) & (n == 0), "").otherwise(F.concat(F.lit("m"), n)).alias("record_id"),
        F.when((p % 9 == 2) & (n == 2), 0).otherwise(n).alias("boxno"), (F.col("l") + move).alias("l"), "t", (F.col("r") + move).alias("r"), "b")
    return layout.clean_box_check(rows.withColumn("width", F.lit(320)).withColumn("height", F.lit(480)))


@query("clean_box_check_errors", CLEANBOX.replace("GROUP BY ALL, boxno", "GROUP BY book_id, page, boxno") + " SELECT * FROM ce", ("boxes",))
def clean_box_check_errors(s):
    return _clean_check(s)[1]


@query("clean_box_check", CLEANBOX.replace("GROUP BY ALL, boxno", "GROUP BY book_id, page, boxno") + """
    SELECT book_id, page, record_id, boxno, l, t, r, b FROM cb WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.book_id = cb.book_id AND ce.page = cb.page)""", ("boxes",))
def clean_box_check(s):
    return _clean_check(s)[0]


SAMPLES = """
    smp AS (SELECT concat('b', l_orderkey % 16) AS book_id, l_suppkey AS page, CASE WHEN l_suppkey % 3 = 0 THEN 200 + l_partkey % 56 WHEN l_suppkey % 3 = 1 THEN 91 + l_partkey % 80 ELSE (l_partkey * 13) % 256 END AS value FROM lineitem)"""


def samples(s):
    return s.lineitem.select(
        F.concat(F.lit("b"), F.col("l_orderkey") % 16).alias("book_id"), F.col("l_suppkey").alias("page"),
        F.when(F.col("l_suppkey") % 3 == 0, 200 + F.col("l_partkey") % 56).when(F.col("l_suppkey") % 3 == 1, 91 + F.col("l_partkey") % 80)
        .otherwise((F.col("l_partkey") * 13) % 256).alias("value"))


TONES = SAMPLES + """,
    st AS (SELECT book_id, page, list_sort(list(value)) AS vs, list_sort(list(value) FILTER (value >= 180)) AS br, list_sort(list(value) FILTER (value <= 90)) AS dk, count(*) AS n,
        count(*) FILTER (value >= 180) / count(*) AS b, count(*) FILTER (value <= 90) / count(*) AS d FROM smp GROUP BY ALL),
    tn AS (SELECT book_id, page, CASE WHEN b >= 0.20 AND b >= d * 0.75 THEN br[cast(round_even((len(br) - 1) * cast(0.7 AS double), 0) AS bigint) + 1]
        WHEN d >= 0.20 AND d > b THEN dk[cast(round_even((len(dk) - 1) * cast(0.3 AS double), 0) AS bigint) + 1] END AS dominant, vs[cast(round_even((n - 1) * 0.5, 0) AS bigint) + 1] AS median FROM st)"""


@query("rank_percentile", """
    q AS (SELECT l_partkey, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_partkey, v[cast(round_even((n - 1) * cast(0.7 AS double), 0) AS bigint) + 1] AS price FROM q""")
def rank_percentile(s):
    return layout.rank_percentile(s.lineitem, ["l_partkey"], "l_extendedprice", 0.7, "price")


@query("dominant_tone", TONES + " SELECT book_id, page, dominant, median FROM tn")
def dominant_tone(s):
    return layout.tone(samples(s), PAGE)


@query("recommended_fill", TONES + """
    SELECT book_id, page, coalesce(dominant, median) AS brightness, CASE WHEN coalesce(dominant, median) >= 160 THEN 'black' WHEN coalesce(dominant, median) <= 95 THEN 'white' ELSE 'black' END AS fill FROM tn""")
def recommended_fill(s):
    rows = samples(s)
    return layout.recommended_fill(rows, PAGE, rows.select(*PAGE).distinct().withColumn("fill", F.lit("black")))
