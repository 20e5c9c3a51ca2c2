"""Detector results derived from the box table: shaping, tiles, duplicates, keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import geometry as geo
from boxloom.operators import detect, merge
from boxloom.plans.grouping import page_size
from boxloom.plans.registry import query

PAGE = ("book_id", "page")


def columnwise(boxes):
    """Column-wise results: boxes in order, polygons only for even boxes, one text fewer than boxes."""
    m = F.sort_array(F.collect_list(F.struct("boxno", "l", "t", "r", "b", "text", "score")))
    per_page = boxes.groupBy(*PAGE).agg(m.alias("m"))
    w, h = page_size()

    def double(c):
        return c.cast("double")

    poly = F.transform("m", lambda x: F.when(x["boxno"] % 2 == 0, F.array(
        F.array(double(x["l"]) + 0.25, double(x["t"])), F.array(double(x["r"]) + 0.5, double(x["t"]) - 0.5),
        F.array(double(x["r"]), double(x["b"]) + 0.75))))
    return per_page.select(
        *PAGE, w.alias("width"), h.alias("height"),
        F.slice(F.transform("m", lambda x: x["text"]), 1, F.greatest(F.size("m") - 1, F.lit(0))).alias("rec_texts"),
        F.transform("m", lambda x: F.when(x["boxno"] % 5 != 4, x["score"])).alias("rec_scores"), poly.alias("rec_polys"),
        F.transform("m", lambda x: F.array(*[double(x[c]) for c in "ltrb"])).alias("rec_boxes"))


@query("normalize_detections", """
    src AS (SELECT *, count(*) OVER (PARTITION BY book_id, page) AS n FROM boxes),
    shaped AS (SELECT book_id, page, boxno AS pos, CASE WHEN boxno % 5 <> 4 THEN score END AS score,
        CASE WHEN boxno < n - 1 THEN text ELSE '' END AS text, l AS l0,
        CASE WHEN boxno % 2 = 0 THEN greatest(0, t - 1) ELSE t END AS t, CASE WHEN boxno % 2 = 0 THEN least(320, r + 1) ELSE r END AS r,
        CASE WHEN boxno % 2 = 0 THEN least(480, b + 1) ELSE b END AS b FROM src)
    SELECT book_id, page, row_number() OVER (PARTITION BY book_id, page ORDER BY pos) - 1 AS boxno, l0 AS l, t, r, b, text, score
    FROM shaped WHERE (score IS NULL OR score >= 0.75) AND r > l0 AND b > t""", ("boxes",))
def normalize_detections(s):
    return detect.normalize_detections(columnwise(s.boxes)).select(*PAGE, "boxno", "l", "t", "r", "b", "text", "score")


@query("normalize_blocks", """
    kept AS (SELECT book_id, page, boxno, l * 2 AS l, t * 2 AS t, r * 2 AS r, b * 2 AS b, text, CASE WHEN boxno % 3 = 0 THEN score END AS score
      FROM boxes WHERE boxno % 4 <> 1 AND NOT (boxno % 3 = 0 AND score < 0.75))
    SELECT book_id, page, row_number() OVER (PARTITION BY book_id, page ORDER BY boxno) - 1 AS boxno, l, t, r, b,
      CASE WHEN boxno % 3 = 2 THEN concat(text, chr(10), 'x') ELSE text END AS text, score FROM kept""", ("boxes",))
def normalize_blocks(s):
    n = F.col("boxno")
    body = F.concat(
        F.lit('{"block_label":"'), F.when(n % 4 == 1, "Image").otherwise("text"), F.lit('",'),
        F.when(n % 3 == 2, F.concat(F.lit('"content":["'), "text", F.lit('",null,"x"],')))
        .otherwise(F.concat(F.lit('"block_content":null,"text":" '), "text", F.lit('",'))),
        F.when(n % 3 == 0, F.concat(F.lit('"confidence":'), "score", F.lit(","))).otherwise(""),
        F.when(n % 2 == 0, F.concat(F.lit('"bbox":['), F.concat_ws(",", "l", "t", "r", "b"), F.lit("]}")))
        .otherwise(F.concat(F.lit('"poly":[['), F.concat_ws(",", "l", "t"), F.lit("],["), F.concat_ws(",", "r", "b"), F.lit("]]}"))))
    w, h = page_size()
    blocks = s.boxes.groupBy(*PAGE).agg(F.concat(F.lit("["), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("boxno", body.alias("x")))), lambda m: m["x"]), ","), F.lit("]")).alias("blocks"))
    results = blocks.select(*PAGE, (w * 2).alias("width"), (h * 2).alias("height"), "blocks",
                            w.alias("block_width"), h.alias("block_height"))
    return detect.normalize_blocks(results).select(*PAGE, "boxno", "l", "t", "r", "b", "text", "score")


@query("unknown_results", """
    SELECT book_id, page, 'unknown_structure' AS code FROM (SELECT DISTINCT book_id, page FROM boxes) x WHERE page % 6 IN (3, 5)""", ("boxes",))
def unknown_results(s):
    k = F.col("page") % 6
    raw = (F.when(k == 0, "[]").when(k == 1, '[null,[]]').when(k == 2, '{"rec_texts":[]}').when(k == 3, '{"words":[1]}')
           .when(k == 4, '[{"res":{"rec_boxes":[]}}]').otherwise('["odd"]'))
    return detect.unknown_results(s.boxes.select(*PAGE).distinct().withColumn("raw", raw))


@query("min_score", "SELECT book_id, page, boxno, score FROM boxes WHERE score >= 0.9", ("boxes",))
def min_score(s):
    return detect.min_score(s.boxes, 0.9).select(*PAGE, "boxno", "score")


@query("renumber", """
    SELECT book_id, page, boxno AS old, row_number() OVER (PARTITION BY book_id, page ORDER BY boxno) - 1 AS boxno
    FROM boxes WHERE (page + boxno) % 3 <> 0""", ("boxes",))
def renumber(s):
    kept = s.boxes.where((F.col("page") + F.col("boxno")) % 3 != 0).select(*PAGE, F.col("boxno").alias("old"))
    return detect.renumber(kept, "old")


SIZES = """
    sizes AS (SELECT concat('b', page_id % 8) AS book_id, page_id AS page, 500 + (page_id * 37) % 2500 AS width, 600 + (page_id * 53) % 4000 AS height FROM pages)"""


@query("page_tiles", SIZES + """,
    k AS (SELECT unnest(range(0, 40)) AS i),
    xs AS (SELECT DISTINCT book_id, page, CASE WHEN width <= 750 THEN 0 ELSE least(i * 494, width - 750) END AS x FROM sizes, k),
    ys AS (SELECT DISTINCT book_id, page, CASE WHEN height <= 750 THEN 0 ELSE least(i * 494, height - 750) END AS y FROM sizes, k)
    SELECT book_id, page, x, y, least(750, width - x) AS tile_width, least(750, height - y) AS tile_height
    FROM sizes JOIN xs USING (book_id, page) JOIN ys USING (book_id, page)""")
def page_tiles(s):
    p = F.col("page_id")
    sizes = s.pages.select(F.concat(F.lit("b"), p % 8).alias("book_id"), p.alias("page"),
                           (500 + (p * 37) % 2500).alias("width"), (600 + (p * 53) % 4000).alias("height"))
    return detect.page_tiles(sizes).drop("width", "height")


TILED = """
    placed AS (SELECT book_id, page, boxno, l, t, r, b, (boxno % 3) * 160 AS x, (page % 2) * 240 AS y FROM boxes),
    moved AS (SELECT book_id, page, boxno, x, y, least(640, l + x) AS l, least(720, t + y) AS t, least(640, r + x) AS r, least(720, b + y) AS b FROM placed)"""


def tiled(boxes):
    n, p = F.col("boxno"), F.col("page")
    return boxes.select(*PAGE, "boxno", "l", "t", "r", "b", ((n % 3) * 160).alias("x"), ((p % 2) * 240).alias("y"),
                        F.lit(320).alias("tile_width"), F.lit(480).alias("tile_height"), F.lit(640).alias("width"), F.lit(720).alias("height"))


@query("shift_tile_detections", TILED + """
    SELECT book_id, page, boxno, l, t, r, b, (x > 0 AND l <= x + 8) OR (y > 0 AND t <= y + 8) OR (x + 320 < 640 AND r >= x + 312)
      OR (y + 480 < 720 AND b >= y + 472) AS edge_touch FROM moved WHERE r > l AND b > t""", ("boxes",))
def shift_tile_detections(s):
    return detect.shift_tile_detections(tiled(s.boxes)).select(*PAGE, "boxno", "l", "t", "r", "b", "edge_touch")


@query("combine_sources", TILED + """,
    u AS (SELECT book_id, page, boxno, 'full_image' AS source, 0 AS k, -1 AS y, -1 AS x FROM boxes
      UNION ALL SELECT book_id, page, boxno, 'tile', 1, y, x FROM moved WHERE r > l AND b > t)
    SELECT book_id, page, boxno, source, row_number() OVER (PARTITION BY book_id, page ORDER BY k, y, x, boxno) - 1 AS pos FROM u""", ("boxes",))
def combine_sources(s):
    def combined(part):
        boxes = part.kept("boxes")
        return detect.combine_sources(boxes, detect.shift_tile_detections(tiled(boxes)), held=True).select(*PAGE, "boxno", "source", "pos")

    return s.in_turns(combined)


DUPLICATES = """
    m AS (SELECT a.book_id, a.page, a.boxno AS u, b.boxno AS v, a.text AS ta, b.text AS tb, (a.r - a.l) * (a.b - a.t) AS aa, (b.r - b.l) * (b.b - b.t) AS ab,
        greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t)) AS i
      FROM boxes a JOIN boxes b ON a.book_id = b.book_id AND a.page = b.page AND a.boxno < b.boxno),
    dup AS (SELECT book_id, page, u, v FROM m WHERE i > 0 AND least(aa, ab) > 0
      AND (i / (aa + ab - i) >= 0.55 OR (i / least(aa, ab) >= 0.88 AND (contains(ta, tb) OR contains(tb, ta)))))"""


@query("duplicate_pairs", DUPLICATES + " SELECT * FROM dup", ("boxes",))
def duplicate_pairs(s):
    return detect.duplicate_pairs(s.boxes)


@query("dedupe_detections", DUPLICATES + """,
    lone AS (SELECT b.book_id, b.page, b.boxno FROM boxes b),
    -- walk each page in box order; state: kept slots as a list of box numbers
    walk AS (SELECT book_id, page, cast(-1 AS bigint) AS at_box, cast([] AS bigint[]) AS slots, max(boxno) AS last FROM boxes GROUP BY book_id, page
      UNION ALL
      SELECT w.book_id, w.page, w.at_box + 1, CASE WHEN h.pos IS NULL THEN list_append(w.slots, w.at_box + 1)
          WHEN h.better THEN list_concat(list_concat(list_slice(w.slots, 1, h.pos - 1), [w.at_box + 1]), list_slice(w.slots, h.pos + 1, len(w.slots)))
          ELSE w.slots END, w.last
      FROM walk w LEFT JOIN (SELECT d.book_id, d.page, d.u, d.v, o.score AS os, n.score AS ns, n.score > o.score + 0.05 OR (n.score >= o.score AND length(n.text) > length(o.text)) AS better_pair
              FROM dup d JOIN boxes o ON o.book_id = d.book_id AND o.page = d.page AND o.boxno = d.u JOIN boxes n ON n.book_id = d.book_id AND n.page = d.page AND n.boxno = d.v) e
          ON e.book_id = w.book_id AND e.page = w.page AND e.v = w.at_box + 1 AND list_contains(w.slots, e.u)
          AND NOT EXISTS (SELECT 1 FROM dup f WHERE f.book_id = e.book_id AND f.page = e.page AND f.v = e.v AND list_contains(w.slots, f.u)
            AND list_position(w.slots, f.u) < list_position(w.slots, e.u))
        CROSS JOIN LATERAL (SELECT list_position(w.slots, e.u) AS pos, e.better_pair AS better) h
      WHERE w.at_box < w.last)
    SELECT book_id, page, generate_subscripts(slots, 1) - 1 AS boxno, unnest(slots) AS source_boxno FROM walk WHERE at_box = last""", ("boxes",))
def dedupe_detections(s):
    return detect.dedupe_detections(s.boxes).select(*PAGE, "boxno", "source_boxno")


MASTER = """
    master AS (SELECT book_id, page, boxno, l, t, r, b, boxno % 4 = 2 AS sfx, false AS open_lettering, CASE WHEN boxno <> 5 THEN text END AS text,
        concat('en ', text) AS english_text FROM boxes WHERE boxno % 3 <> 2),
    excerpt AS (SELECT book_id, page, boxno, l + 1 AS l, t, r + 1 AS r, b, true AS sfx, boxno % 2 = 0 AS open_lettering,
        CASE WHEN boxno % 2 = 0 THEN text ELSE concat(text, '!') END AS text FROM boxes WHERE (page + boxno) % 4 < 2)"""


def master_table(boxes):
    n = F.col("boxno")
    return boxes.where(n % 3 != 2).select(*PAGE, "boxno", "l", "t", "r", "b", (n % 4 == 2).alias("sfx"), F.lit(False).alias("open_lettering"),
                                          F.when(n != 5, F.col("text")).alias("text"), F.concat(F.lit("en "), "text").alias("english_text"))


@query("upsert_ocr", MASTER + """
    SELECT book_id, page, boxno, CASE WHEN e.page IS NOT NULL THEN e.l ELSE m.l END AS l, coalesce(e.sfx, m.sfx) AS sfx,
      coalesce(e.open_lettering, m.open_lettering) AS open_lettering, CASE WHEN e.page IS NOT NULL THEN e.text ELSE m.text END AS text,
      CASE WHEN m.text IS NOT NULL AND e.page IS NOT NULL AND m.text <> e.text THEN NULL ELSE m.english_text END AS english_text
    FROM master m FULL OUTER JOIN excerpt e USING (book_id, page, boxno)""", ("boxes",))
def upsert_ocr(s):
    boxes, n = s.boxes, F.col("boxno")
    excerpt = boxes.where((F.col("page") + n) % 4 < 2).select(
        *PAGE, "boxno", (F.col("l") + 1).alias("l"), "t", (F.col("r") + 1).alias("r"), "b", F.lit(True).alias("sfx"),
        (n % 2 == 0).alias("open_lettering"), F.when(n % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"))
    return merge.upsert_ocr(master_table(boxes), excerpt).select(*PAGE, "boxno", "l", "sfx", "open_lettering", "text", "english_text")


TRANSLATED = MASTER + """,
    given AS (SELECT book_id, page, boxno, CASE WHEN boxno % 4 = 1 THEN 'other' ELSE text END AS text, concat('new ', boxno) AS english_text FROM boxes WHERE page % 2 = 0)"""


def _translate(s):
    boxes, n = s.boxes, F.col("boxno")
    given = boxes.where(F.col("page") % 2 == 0).select(*PAGE, "boxno", F.when(n % 4 == 1, "other").otherwise(F.col("text")).alias("text"),
                                                       F.concat(F.lit("new "), n).alias("english_text"))
    return merge.upsert_translation(master_table(boxes), given)


@query("upsert_translation", TRANSLATED + """
    SELECT m.book_id, m.page, m.boxno, m.text, CASE WHEN m.text = g.text THEN g.english_text ELSE m.english_text END AS english_text
    FROM master m LEFT JOIN given g ON m.book_id = g.book_id AND m.page = g.page AND m.boxno = g.boxno""", ("boxes",))
def upsert_translation(s):
    return _translate(s)[0].select(*PAGE, "boxno", "text", "english_text")


@query("upsert_translation_errors", TRANSLATED + """
    SELECT g.book_id, g.page, g.boxno, CASE WHEN m.page IS NULL THEN 'missing_master' WHEN m.text IS NULL THEN 'master_without_text' ELSE 'text_mismatch' END AS code
    FROM given g LEFT JOIN master m ON m.book_id = g.book_id AND m.page = g.page AND m.boxno = g.boxno WHERE m.text IS NULL OR m.text <> g.text""", ("boxes",))
def upsert_translation_errors(s):
    return _translate(s)[1]


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(s):
    return merge.duplicate_keys(s.lineitem, ["l_orderkey", "l_linenumber"])


@query("invalid_records", """
    SELECT book_id, page, boxno, 'empty_region' AS code FROM boxes WHERE boxno % 3 = 1
    UNION ALL SELECT book_id, page, boxno, 'bad_region' FROM boxes WHERE boxno % 3 = 2""", ("boxes",))
def invalid_records(s):
    n = F.col("boxno")
    broken = s.boxes.withColumn("r", F.when(n % 3 == 1, F.col("l")).otherwise(F.col("r"))) \
                    .withColumn("b", F.when(n % 3 == 2, F.lit(float("nan"))).otherwise(F.col("b").cast("double")))
    return merge.invalid_records(broken)


@query("replace_subset", """
    SELECT book_id, page, coalesce(o.boxno, n.boxno) AS boxno, coalesce(o.pos, (SELECT max(boxno) + 1 FROM boxes z WHERE z.book_id = n.book_id AND z.page = n.page AND z.boxno % 4 <> 3) + n.pos, n.pos) AS pos,
      coalesce(n.text, o.text) AS text
    FROM (SELECT book_id, page, boxno, boxno AS pos, text FROM boxes WHERE boxno % 4 <> 3) o
    FULL OUTER JOIN (SELECT book_id, page, boxno, boxno AS pos, concat(text, '*') AS text FROM boxes WHERE boxno % 2 = 1) n USING (book_id, page, boxno)""", ("boxes",))
def replace_subset(s):
    base = s.boxes.select(*PAGE, "boxno", F.col("boxno").alias("pos"), "text")
    fresh = base.where(F.col("boxno") % 2 == 1).withColumn("text", F.concat("text", F.lit("*")))
    return merge.replace_subset(base.where(F.col("boxno") % 4 != 3), fresh, [*PAGE, "boxno"], "pos")
