"""Detection grouping over the derived box table."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import geometry as geo
from boxloom.operators import group
from boxloom.plans.inputs import PAGE_HEIGHT, PAGE_WIDTH
from boxloom.plans.registry import query


def page_size():
    return F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT)


def sql_pair_terms() -> str:
    """Per pair of boxes of a page: the measures the merge rules use."""
    return """
    pr AS (SELECT a.book_id, a.page, a.boxno AS u, b.boxno AS v,
        a.r - a.l AS wa, b.r - b.l AS wb, a.b - a.t AS ha, b.b - b.t AS hb,
        a.l AS al, a.r AS ar, a.t AS at_, b.l AS bl, b.r AS br, b.t AS bt,
        greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) AS xo, greatest(0, least(a.b, b.b) - greatest(a.t, b.t)) AS yo,
        greatest(0, greatest(a.l, b.l) - least(a.r, b.r)) AS xg, greatest(0, greatest(a.t, b.t) - least(a.b, b.b)) AS yg,
        abs((a.t + a.b) / 2.0 - (b.t + b.b) / 2.0) AS dc
      FROM boxes a JOIN boxes b ON a.book_id = b.book_id AND a.page = b.page AND a.boxno < b.boxno
      WHERE a.r > a.l AND a.b > a.t AND b.r > b.l AND b.b > b.t),
    cand AS (SELECT book_id, page, u, v, side, vertical, stack FROM (SELECT *,
        yo / least(ha, hb) >= 0.1 AND xg <= greatest(8.0, least(12.0, greatest(least(wa, wb) * 1.2, least(ha, hb) * 0.06)))
          AND greatest(ha, hb) / least(ha, hb) <= 3.0
          AND dc <= greatest(12.0, least(96.0, least(ha, hb) * 0.55)) AS side,
        wa <= 48 AND wb <= 48 AND ha / greatest(1, wa) >= 2.2 AND hb / greatest(1, wb) >= 2.2
          AND yo / least(ha, hb) >= 0.25 AND xg <= 24 AND greatest(ar, br) - least(al, bl) <= 120
          AND abs(at_ - bt) <= 32 AND dc <= greatest(12.0, least(ha, hb) * 1.05) AS vertical,
        xo / least(wa, wb) >= 0.1
          AND yg <= greatest(4.0, least(8.0, greatest(least(wa, wb) * 0.8, least(ha, hb) * 0.05))) AS stack
      FROM pr) x WHERE side OR vertical OR stack)"""


def sql_groups(rtl: bool = True) -> str:
    sep = "''" if rtl else "chr(10)"
    sign = "-" if rtl else ""
    return sql_pair_terms() + f""",
    both_ways AS (SELECT book_id, page, u, v FROM cand UNION ALL SELECT book_id, page, v, u FROM cand),
    reach(book_id, page, x, y) AS (SELECT book_id, page, boxno, boxno FROM boxes
      UNION SELECT r.book_id, r.page, r.x, e.v FROM reach r JOIN both_ways e ON r.book_id = e.book_id AND r.page = e.page AND r.y = e.u),
    lab AS (SELECT book_id, page, x AS boxno, min(y) AS label FROM reach GROUP BY ALL),
    grp AS (SELECT d.book_id, d.page, lab.label,
        greatest(0, min(d.l)) AS l, greatest(0, min(d.t)) AS t, least({PAGE_WIDTH}, max(d.r)) AS r, least({PAGE_HEIGHT}, max(d.b)) AS b,
        string_agg(cast(d.boxno AS varchar), ',' ORDER BY {sign}(d.l + d.r) / 2.0, (d.t + d.b) / 2.0, d.boxno) AS sources,
        string_agg(d.text, {sep} ORDER BY {sign}(d.l + d.r) / 2.0, (d.t + d.b) / 2.0, d.boxno) AS text
      FROM boxes d JOIN lab ON d.book_id = lab.book_id AND d.page = lab.page AND d.boxno = lab.boxno GROUP BY ALL),
    ordered AS (SELECT book_id, page, label, row_number() OVER (PARTITION BY book_id, page ORDER BY
        round_even(t / 80.0, 0), {sign}(l + r) / 2.0, (t + b) / 2.0, label) - 1 AS boxno, l, t, r, b, sources, text FROM grp)"""


def flat_groups(df):
    return df.select("book_id", "page", "boxno", "l", "t", "r", "b",
                     F.array_join("source_boxnos", ",").alias("sources"), "text")


@query("merge_candidates", sql_pair_terms() + " SELECT * FROM cand", ("boxes",))
def merge_candidates(s):
    return group.merge_candidates(s.boxes)


@query("connected_groups", sql_groups() + " SELECT book_id, page, boxno, label FROM lab", ("boxes",))
def connected_groups(s):
    return group.connected_groups(s.kept("boxes")).select("book_id", "page", "boxno", "label")


GROUP_COLUMNS = "SELECT book_id, page, boxno, l, t, r, b, sources, text FROM ordered"


@query("group_detections", sql_groups() + GROUP_COLUMNS, ("boxes",))
def group_detections(s):
    return flat_groups(group.group_detections(s.kept("boxes"), *page_size()))


@query("group_detections_left_to_right", sql_groups(rtl=False) + GROUP_COLUMNS, ("boxes",))
def group_detections_left_to_right(s):
    return flat_groups(group.group_detections(s.kept("boxes"), *page_size(), right_to_left=False))


@query("group_rows", """
    g AS (SELECT book_id, page, boxno - boxno % 2 AS label, l, t, r, b, boxno, text FROM boxes)
    SELECT book_id, page, label, greatest(0, min(l)) AS l, greatest(0, min(t)) AS t,
      least(320, max(r)) AS r, least(480, max(b)) AS b,
      string_agg(cast(boxno AS varchar), ',' ORDER BY -(l + r) / 2.0, (t + b) / 2.0, boxno) AS sources,
      string_agg(text, '|' ORDER BY -(l + r) / 2.0, (t + b) / 2.0, boxno) AS texts
    FROM g GROUP BY ALL""", ("boxes",))
def group_rows(s):
    labelled = s.boxes.withColumn("label", F.col("boxno") - F.col("boxno") % 2)
    return group.group_rows(labelled, *page_size()).select(
        "book_id", "page", "label", "l", "t", "r", "b", F.array_join("source_boxnos", ",").alias("sources"),
        F.array_join("source_texts", "|").alias("texts"))


@query("source_order", """
    SELECT book_id, page, string_agg(cast(boxno AS varchar), ',' ORDER BY -(l + r) / 2.0, (t + b) / 2.0, boxno) AS rtl,
      string_agg(cast(boxno AS varchar), ',' ORDER BY (l + r) / 2.0, (t + b) / 2.0, boxno) AS ltr
    FROM boxes GROUP BY ALL""", ("boxes",))
def source_order(s):
    def ordered(rtl: bool):
        across, down = group.reading_key(rtl)
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            across.alias("x"), down.alias("y"), F.col("boxno").alias("n")))), lambda m: m["n"]), ",")
    return s.boxes.groupBy("book_id", "page").agg(ordered(True).alias("rtl"), ordered(False).alias("ltr"))


@query("page_order", """
    SELECT book_id, page, boxno, row_number() OVER (PARTITION BY book_id, page
      ORDER BY round_even(t / 80.0, 0), -(l + r) / 2.0, (t + b) / 2.0, boxno) - 1 AS position FROM boxes""", ("boxes",))
def page_order(s):
    return group.page_order(s.boxes, tie="boxno", name="position").select("book_id", "page", "boxno", "position")


@query("bbox_closure", """
    start AS (SELECT DISTINCT book_id, page, l, t, r, b FROM boxes WHERE r > l AND b > t),
    seed AS (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY l, t, r, b) AS i FROM start),
    grow AS (SELECT 0 AS k, * FROM seed UNION ALL
      SELECT a.k + 1, a.book_id, a.page, min(c.l), min(c.t), max(c.r), max(c.b), a.i
      FROM grow a JOIN grow c ON a.book_id = c.book_id AND a.page = c.page
        AND a.r >= c.l AND c.r >= a.l AND a.b >= c.t AND c.b >= a.t
      WHERE a.k < 12 GROUP BY a.k, a.book_id, a.page, a.i)
    SELECT DISTINCT book_id, page, l, t, r, b FROM grow WHERE k = 12""", ("boxes",))
def bbox_closure(s):
    return group.bbox_closure(s.boxes)


REBUILD_INPUT = """
    edited AS (SELECT book_id, page, cast(floor(boxno / 2) AS bigint) AS group_no, min(boxno) AS b0, max(boxno) AS b1,
        min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM boxes GROUP BY book_id, page, cast(floor(boxno / 2) AS bigint))"""


@query("rebuild_groups", REBUILD_INPUT + """,
    src AS (SELECT book_id, page, group_no, i AS pos, CASE i WHEN 0 THEN b1 WHEN 1 THEN b0 WHEN 2 THEN b1 ELSE 900 END AS boxno
            FROM edited, (VALUES (0), (1), (2), (3)) n(i) WHERE i < 2 OR page % 3 = 0),
    first AS (SELECT book_id, page, group_no, boxno, min(pos) AS pos FROM src GROUP BY ALL),
    live AS (SELECT * FROM boxes WHERE (page + boxno) % 5 <> 0),
    agg AS (SELECT f.book_id, f.page, f.group_no, string_agg(cast(f.boxno AS varchar), ',' ORDER BY pos) AS sources,
        string_agg(d.text, '' ORDER BY pos) AS text, min(d.l) AS ul, min(d.t) AS ut, max(d.r) AS ur, max(d.b) AS ub
      FROM first f JOIN live d ON d.book_id = f.book_id AND d.page = f.page AND d.boxno = f.boxno GROUP BY ALL),
    given AS (SELECT book_id, page, group_no, string_agg(cast(boxno AS varchar), ',' ORDER BY pos) AS given_sources FROM src GROUP BY ALL)
    SELECT book_id, page, group_no, sources, text,
      CASE WHEN sources = given_sources THEN e.l - 2 ELSE ul END AS l, CASE WHEN sources = given_sources THEN e.t - 2 ELSE ut END AS t,
      CASE WHEN sources = given_sources THEN e.r + 2 ELSE ur END AS r, CASE WHEN sources = given_sources THEN e.b + 2 ELSE ub END AS b
    FROM agg JOIN given USING (book_id, page, group_no) JOIN edited e USING (book_id, page, group_no)""", ("boxes",))
def rebuild_groups(s):
    boxes = s.boxes
    edited = boxes.groupBy("book_id", "page", F.floor(F.col("boxno") / 2).alias("group_no")).agg(
        F.min("boxno").alias("b0"), F.max("boxno").alias("b1"),
        *[(F.min if c in "lt" else F.max)(c).alias(c) for c in "ltrb"])
    drawn = edited.select(
        "book_id", "page", "group_no",
        F.when(F.col("page") % 3 == 0, F.array("b1", "b0", "b1", F.lit(900).cast("bigint")))
        .otherwise(F.array("b1", "b0")).alias("source_boxnos"),
        (F.col("l") - 2).alias("l"), (F.col("t") - 2).alias("t"), (F.col("r") + 2).alias("r"), (F.col("b") + 2).alias("b"))
    live = boxes.where((F.col("page") + F.col("boxno")) % 5 != 0)
    return group.rebuild_groups(drawn, live).select(
        "book_id", "page", "group_no", F.array_join("source_boxnos", ",").alias("sources"), "text", "l", "t", "r", "b")


SHEET = """
    sheet AS (SELECT book_id, page * 100 + boxno AS node, l + (page % 97) * 400 AS l, t + (page // 97 % 50) * 500 AS t,
        CASE WHEN boxno % 7 = 3 THEN l - 1 ELSE r END + (page % 97) * 400 AS r, CASE WHEN boxno % 11 <> 4 THEN b + (page // 97 % 50) * 500 END AS b FROM boxes)"""


def _sheets(boxes):
    """All pages of a book beside each other on one sheet; some regions are inverted, some lack a side."""
    x, y = F.col("page") % 97 * 400, F.floor(F.col("page") / 97) % 50 * 500
    return boxes.select("book_id", (F.col("page") * 100 + F.col("boxno")).alias("node"), (F.col("l") + x).alias("l"), (F.col("t") + y).alias("t"),
                          (F.when(F.col("boxno") % 7 == 3, F.col("l") - 1).otherwise(F.col("r")) + x).alias("r"),
                          F.when(F.col("boxno") % 11 != 4, F.col("b") + y).alias("b"))


@query("bad_regions", SHEET + """
    SELECT book_id, node, CASE WHEN b IS NULL THEN 'missing_side' ELSE 'inverted' END AS code FROM sheet WHERE b IS NULL OR r < l OR b < t""", inputs=("boxes",))
def bad_regions(s):
    return group.bad_regions(_sheets(s.boxes)).select("book_id", "node", "code")


@query("sheet_pairs", SHEET + """
    SELECT a.book_id, a.node AS u, b.node AS v FROM sheet a JOIN sheet b ON a.book_id = b.book_id AND a.node < b.node
    WHERE a.r >= a.l AND a.b >= a.t AND b.r >= b.l AND b.b >= b.t AND greatest(a.l, b.l) - least(a.r, b.r) <= 3 AND greatest(a.t, b.t) - least(a.b, b.b) <= 2""", inputs=("boxes",))
def sheet_pairs(s):
    """Near boxes of crowded pages, which are searched through cells."""
    rows = _sheets(s.kept("boxes"))
    a, b = geo.region("a"), geo.region("b")
    match = (F.col("a.node") < F.col("b.node")) & (geo.x_gap(a, b) <= 3) & (geo.y_gap(a, b) <= 2)
    return group.near_pairs(rows, rows, ["book_id"], match, 3, 2).select(F.col("a.book_id").alias("book_id"), F.col("a.node").alias("u"), F.col("b.node").alias("v"))
