"""Edits over records derived from the box table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import overlay
from boxloom.plans.registry import query
from boxloom.session import stored

PAGE = ("book_id", "page")
OWN = ("record_id", "pos", "boxno", "l", "t", "r", "b", "text")
RECORD = "struct<record_id:string,pos:bigint,boxno:bigint,l:bigint,t:bigint,r:bigint,b:bigint,text:string>"

BASE = """
    base AS (SELECT book_id, page, concat('r', boxno) AS record_id, boxno AS pos, boxno, l, t, r, b, text FROM boxes)"""


def records(s) -> DataFrame:
    return s.kept("boxes").select(*PAGE, F.concat(F.lit("r"), F.col("boxno")).alias("record_id"), F.col("boxno").alias("pos"),
                          "boxno", "l", "t", "r", "b", "text")


def edit_table(base: DataFrame, stage: str = "structure", artifact: str = "ocr_structured") -> DataFrame:
    """Edits of every kind on some pages; see EDITED for the same rules in SQL."""
    n, p = F.col("boxno"), F.col("page")
    null = F.lit(None)

    def edit(when, kind, protected, record_id=F.col("record_id"), field=null, value=null, region=False, ordinal=null, record=null):
        sides = [(F.col(c) if region else null).cast("bigint").alias(c) for c in "ltrb"]
        return F.when(when, F.struct(
            F.lit(kind).alias("kind"), record_id.alias("record_id"), field.cast("string").alias("field"), value.cast("string").alias("value"),
            protected.alias("protected"), *sides, ordinal.cast("bigint").alias("ordinal"), record.cast(RECORD).alias("record")))

    new = F.struct(F.lit("new"), F.lit(0), F.lit(50), F.lit(1), F.lit(2), F.lit(30), F.lit(40), F.lit("added"))
    frozen = F.struct("record_id", "pos", "boxno", "l", "t", "r", "b", F.lit("frozen"))
    made = F.array_compact(F.array(
        edit((p % 3 == 0) & (n % 2 == 0), "field", n % 4 == 0, field=F.lit("text"), value=F.concat("text", F.lit("*"))),
        edit((p % 4 == 1) & (n == 1), "deleted", p % 8 == 1, region=True),
        edit((n == 0) & (p % 5 == 0), "added", p % 10 == 0, record_id=F.lit("new"), record=new),
        edit((p % 6 == 0) & (n < 3), "order", F.lit(True), ordinal=2 - n),
        edit((p % 11 == 0) & (n < 2), "freeze", p % 2 == 0, record=frozen)))
    return base.select(*PAGE, F.lit(stage).alias("stage"), F.lit(artifact).alias("artifact"), F.explode(made).alias("e")).select(
        *PAGE, "stage", "artifact", "e.*")


def edited_sql(protected_only: bool) -> str:
    guard = (lambda c: f" AND ({c})") if protected_only else (lambda c: "")
    return BASE + f""",
    frz AS (SELECT book_id, page, record_id, boxno AS pos, boxno, 'frozen' AS text FROM base WHERE page % 11 = 0 AND boxno < 2{guard('page % 2 = 0')}),
    frp AS (SELECT DISTINCT book_id, page FROM frz),
    kept AS (SELECT b.book_id, b.page, b.record_id, b.boxno, b.pos AS old, CASE WHEN b.page % 3 = 0 AND b.boxno % 2 = 0{guard('b.boxno % 4 = 0')} THEN concat(b.text, '*') ELSE b.text END AS text
      FROM base b LEFT JOIN frp USING (book_id, page) WHERE frp.page IS NULL AND NOT (b.page % 4 = 1 AND b.boxno = 1{guard('b.page % 8 = 1')})),
    addp AS (SELECT b.book_id, b.page, 'new' AS record_id, cast(50 AS bigint) AS boxno, 1000 AS old, 'added' AS text FROM base b LEFT JOIN frp USING (book_id, page)
      WHERE frp.page IS NULL AND b.boxno = 0 AND b.page % 5 = 0{guard('b.page % 10 = 0')}),
    al AS (SELECT * FROM kept UNION ALL SELECT * FROM addp),
    res AS (SELECT book_id, page, record_id, row_number() OVER (PARTITION BY book_id, page ORDER BY CASE WHEN page % 6 = 0 AND boxno < 3 THEN 2 - boxno ELSE 100 END, old) - 1 AS pos, boxno, text FROM al
      UNION ALL SELECT book_id, page, record_id, pos, boxno, text FROM frz)"""


def flat(df: DataFrame) -> DataFrame:
    return df.select(*PAGE, "record_id", F.col("pos").cast("bigint").alias("pos"), "boxno", "text")


@query("apply_overrides", edited_sql(False) + " SELECT * FROM res", ("boxes",))
def apply_overrides(s):
    base = records(s)
    return flat(overlay.apply_overrides(base, edit_table(base), "ocr_structured", ["text"]))


@query("apply_overrides_protected_only", edited_sql(True) + " SELECT * FROM res", ("boxes",))
def apply_overrides_protected_only(s):
    base = records(s)
    return flat(overlay.apply_overrides(base, edit_table(base), "ocr_structured", ["text"], protected_only=True))


def array_edits(base: DataFrame) -> DataFrame:
    """Edits of an array and a region field as JSON, some of them unreadable."""
    n, null = F.col("boxno"), F.lit(None)
    made = F.array_compact(F.array(
        F.when(n % 2 == 0, F.struct(F.lit("source_boxnos").alias("field"), F.when(n % 6 == 4, "oops").otherwise(F.concat(F.lit("[7, "), n, F.lit("]"))).alias("value"))),
        F.when(n % 3 == 1, F.struct(F.lit("region").alias("field"), F.when(n == 1, F.lit('{"l": 1, "t": 2, "r": 3, "b": 4}')).alias("value"))),
        F.when(n == 3, F.struct(F.lit("colour").alias("field"), F.lit("red").alias("value")))))
    record = base.drop(*PAGE).schema.simpleString()
    return base.select(*PAGE, "record_id", F.explode(made).alias("e")).select(
        *PAGE, F.lit("field").alias("kind"), "record_id", "e.field", "e.value", F.lit(True).alias("protected"),
        null.cast("bigint").alias("ordinal"), null.cast(record).alias("record"))


def nested_records(s) -> DataFrame:
    return records(s).select(*PAGE, "record_id", "pos", "boxno", F.array("boxno", F.col("boxno") + 1).alias("source_boxnos"), F.struct("l", "t", "r", "b").alias("region"))


@query("apply_overrides_arrays", BASE + """
    SELECT book_id, page, record_id, pos, CASE WHEN boxno % 6 = 4 THEN NULL WHEN boxno % 2 = 0 THEN concat('7,', boxno) ELSE concat(boxno, ',', boxno + 1) END AS sources,
      CASE WHEN boxno = 1 THEN 1 WHEN boxno % 3 <> 1 THEN l END AS l, CASE WHEN boxno = 1 THEN 4 WHEN boxno % 3 <> 1 THEN b END AS b FROM base""", ("boxes",))
def apply_overrides_arrays(s):
    base = nested_records(s)
    made = overlay.apply_overrides(base, array_edits(base), "ocr_structured", ["source_boxnos", "region"])
    return made.select(*PAGE, "record_id", "pos", F.array_join("source_boxnos", ",").alias("sources"), "region.l", "region.b")


@query("unreadable_edits", BASE + """
    SELECT book_id, page, record_id, 'source_boxnos' AS field, 'oops' AS value, 'bad_value' AS code FROM base WHERE boxno % 6 = 4
    UNION ALL SELECT book_id, page, record_id, 'colour', 'red', 'unknown_field' FROM base WHERE boxno = 3""", ("boxes",))
def unreadable_edits(s):
    base = nested_records(s)
    return overlay.unreadable_edits(base, array_edits(base), ["source_boxnos", "region"])


@query("effective_records", edited_sql(False) + """
    SELECT book_id, page, record_id, pos, boxno, CASE WHEN boxno % 3 = 1 AND page % 2 = 0 AND record_id <> 'new' THEN concat('erase ', boxno) ELSE text END AS text FROM res""", ("boxes",))
def effective_records(s):
    base = records(s)
    n = F.col("boxno")
    extra = base.where((n % 3 == 1) & (F.col("page") % 2 == 0)).select(
        *PAGE, F.lit("erase").alias("stage"), F.lit("ocr_structured").alias("artifact"), F.lit("field").alias("kind"), "record_id",
        F.lit("text").alias("field"), F.concat(F.lit("erase "), n).alias("value"), F.lit(True).alias("protected"))
    edits = edit_table(base).unionByName(extra, allowMissingColumns=True)
    return flat(overlay.effective_records(base, edits, "ocr_structured", {"structure": ["text"], "erase": ["text"]}))


@query("tombstone_antijoin", BASE + """,
    del AS (SELECT book_id, page, concat('x', boxno) AS record_id, l + 2 AS l, t + 1 AS t, r + 2 AS r, b + 1 AS b FROM base WHERE boxno % 3 = 0 AND page % 2 = 0
      UNION ALL SELECT book_id, page, record_id, NULL, NULL, NULL, NULL FROM base WHERE boxno % 5 = 1)
    SELECT b.book_id, b.page, b.record_id FROM base b WHERE NOT EXISTS (SELECT 1 FROM del d WHERE d.book_id = b.book_id AND d.page = b.page AND (d.record_id = b.record_id
      OR (d.l IS NOT NULL AND b.r > b.l AND b.b > b.t AND greatest(0, least(b.r, d.r) - greatest(b.l, d.l)) * greatest(0, least(b.b, d.b) - greatest(b.t, d.t)) >= 0.5 *
        ((b.r - b.l) * (b.b - b.t) + (d.r - d.l) * (d.b - d.t) - greatest(0, least(b.r, d.r) - greatest(b.l, d.l)) * greatest(0, least(b.b, d.b) - greatest(b.t, d.t))))))""", ("boxes",))
def tombstone_antijoin(s):
    base, n = records(s), F.col("boxno")
    null = F.lit(None).cast("bigint")
    by_region = base.where((n % 3 == 0) & (F.col("page") % 2 == 0)).select(
        *PAGE, F.concat(F.lit("x"), n).alias("record_id"), (F.col("l") + 2).alias("l"), (F.col("t") + 1).alias("t"), (F.col("r") + 2).alias("r"), (F.col("b") + 1).alias("b"))
    by_id = base.where(n % 5 == 1).select(*PAGE, "record_id", *[null.alias(c) for c in "ltrb"])
    deleted = by_region.unionByName(by_id).withColumn("protected", F.lit(True))
    return overlay.tombstone_antijoin(base, deleted, by_region=True).select(*PAGE, "record_id")


@query("saved_order", BASE + """
    SELECT book_id, page, record_id, row_number() OVER (PARTITION BY book_id, page ORDER BY CASE WHEN page % 2 = 0 AND boxno % 2 = 1 THEN 100 - boxno ELSE 1000 END, boxno) - 1 AS pos FROM base""", ("boxes",))
def saved_order(s):
    base = records(s)
    order = base.where((F.col("page") % 2 == 0) & (F.col("boxno") % 2 == 1)).select(*PAGE, "record_id", (100 - F.col("boxno")).alias("ordinal"))
    return overlay.saved_order(base, order).select(*PAGE, "record_id", "pos")


@query("diff_overrides", BASE + """,
    sub AS (SELECT book_id, page, record_id, CASE WHEN page % 3 = 1 THEN 100 - boxno ELSE boxno END AS pos, CASE WHEN boxno % 2 = 1 THEN concat(text, '!') ELSE text END AS text, boxno
      FROM base WHERE NOT (boxno = 2 AND page % 4 = 0)),
    n AS (SELECT book_id, page, count(*) AS n FROM base GROUP BY ALL),
    seq AS (SELECT book_id, page, record_id, row_number() OVER (PARTITION BY book_id, page ORDER BY pos) - 1 AS j FROM (SELECT book_id, page, record_id, pos FROM sub UNION ALL SELECT book_id, page, 'extra', 500 FROM n WHERE page % 5 = 0) z),
    mv AS (SELECT book_id, page FROM n WHERE page % 5 = 0 OR (page % 3 = 1 AND (n > 3 OR (n = 3 AND page % 4 <> 0) OR (n = 2))) OR (page % 4 = 0 AND n > 2))
    SELECT book_id, page, 'field' AS kind, record_id, 'text' AS field, text AS value, NOT (page % 2 = 0 AND boxno = 1) AS protected, cast(NULL AS bigint) AS l FROM sub WHERE boxno % 2 = 1
    UNION ALL SELECT book_id, page, 'added', 'extra', NULL, '{"text":"x"}', true, NULL FROM n WHERE page % 5 = 0
    UNION ALL SELECT book_id, page, 'deleted', record_id, NULL, NULL, page % 8 <> 0, CASE WHEN page % 16 <> 4 THEN l END FROM base WHERE boxno = 2 AND page % 4 = 0
    UNION ALL SELECT book_id, page, 'deleted', 'old', NULL, NULL, false, 7 FROM n WHERE page % 7 = 0
    UNION ALL SELECT book_id, page, 'order', record_id, NULL, cast(j AS varchar), true, NULL FROM seq JOIN mv USING (book_id, page)""", ("boxes",))
def diff_overrides(s):
    n, p = F.col("boxno"), F.col("page")
    base = records(s).withColumn("source", F.when(p % 16 == 4, "manual"))
    sub = base.where(~((n == 2) & (p % 4 == 0))).withColumn("pos", F.when(p % 3 == 1, 100 - n).otherwise(n)).withColumn(
        "text", F.when(n % 2 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    extra = base.where((n == 0) & (p % 5 == 0)).withColumns({"record_id": F.lit("extra"), "pos": F.lit(500).cast("bigint"), "text": F.lit("x")})
    null = F.lit(None)
    shape = [null.cast("bigint").alias("ordinal")]
    old = reduce(DataFrame.unionByName, [
        base.where((n == 1) & (p % 2 == 0)).select(*PAGE, F.lit("field").alias("kind"), "record_id", F.lit("text").alias("field"), F.concat("text", F.lit("!")).alias("value"),
                                                   F.lit(False).alias("protected"), *[null.cast("bigint").alias(c) for c in "ltrb"], *shape),
        base.where((n == 2) & (p % 8 == 0)).select(*PAGE, F.lit("deleted").alias("kind"), "record_id", null.cast("string").alias("field"), null.cast("string").alias("value"),
                                                   F.lit(False).alias("protected"), *[F.col(c) for c in "ltrb"], *shape),
        base.where((n == 0) & (p % 7 == 0)).select(*PAGE, F.lit("deleted").alias("kind"), F.lit("old").alias("record_id"), null.cast("string").alias("field"), null.cast("string").alias("value"),
                                                   F.lit(False).alias("protected"), *[F.lit(7).cast("bigint").alias(c) for c in "ltrb"], *shape)])
    return overlay.diff_overrides(base, sub.unionByName(extra), old, ["text"]).select(*PAGE, "kind", "record_id", "field", "value", "protected", "l")


@query("diff_overrides_editable", BASE + """
    SELECT book_id, page, 'field' AS kind, record_id, 'text' AS field, concat(text, '!') AS value FROM base WHERE boxno % 2 = 1""", ("boxes",))
def diff_overrides_editable(s):
    base = records(s).withColumn("source", F.lit(None).cast("string"))
    odd = F.col("boxno") % 2 == 1
    changed = base.withColumns({"text": F.when(odd, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "boxno": F.col("boxno") + 100})
    old = edit_table(base).where("false")
    return overlay.diff_overrides(base, changed, old, ["text", "boxno"], "structure", "ocr_structured").select(*PAGE, "kind", "record_id", "field", "value")


# lineage: groups of two boxes, structured records one per group ---------------------------

LINEAGE = """
    grp AS (SELECT book_id, page, cast(floor(boxno / 2) AS bigint) AS g, min(boxno) AS b0, max(boxno) AS b1, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b,
        string_agg(text, '' ORDER BY boxno) AS text FROM boxes GROUP BY book_id, page, cast(floor(boxno / 2) AS bigint)),
    live AS (SELECT * FROM boxes WHERE NOT (page % 3 = 0 AND boxno % 4 IN (0, 1)) AND NOT (page % 3 = 1 AND boxno % 4 = 2)),
    vis AS (SELECT g.book_id, g.page, g.g AS boxno, g.b0, g.b1, string_agg(cast(x.boxno AS varchar), ',' ORDER BY x.boxno) AS sources, string_agg(x.text, '' ORDER BY x.boxno) AS text,
        min(x.l) AS l, min(x.t) AS t, max(x.r) AS r, max(x.b) AS b FROM grp g JOIN live x ON x.book_id = g.book_id AND x.page = g.page AND x.boxno IN (g.b0, g.b1)
      WHERE NOT (g.page % 5 = 0 AND g.g = 0) GROUP BY ALL)"""


def lineage_tables(s):
    boxes, n, p = s.kept("boxes"), F.col("boxno"), F.col("page")
    groups = boxes.groupBy(*PAGE, F.floor(n / 2).alias("boxno_g")).agg(
        F.sort_array(F.collect_list("boxno")).alias("source_boxnos"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("boxno", "text"))), lambda x: x["text"]), "").alias("text"),
        *[(F.min if c in "lt" else F.max)(c).alias(c) for c in "ltrb"]).withColumnRenamed("boxno_g", "boxno")
    groups = stored(groups)  # read by every step of a cascade
    dead = ((p % 3 == 0) & (n % 4).isin(0, 1)) | ((p % 3 == 1) & (n % 4 == 2))
    return boxes, groups, boxes.where(~dead), boxes.where(dead).select(*PAGE, "boxno")


@query("visible_groups", LINEAGE.replace("WHERE NOT (g.page % 5 = 0 AND g.g = 0) GROUP", "GROUP") + """
    SELECT book_id, page, boxno, sources, text, l, t, r, b FROM vis""", ("boxes",))
def visible_groups(s):
    _, groups, live, dead = lineage_tables(s)
    return overlay.visible_groups(groups, live, dead).select(*PAGE, "boxno", F.array_join("source_boxnos", ",").alias("sources"), "text", "l", "t", "r", "b")


@query("lineage_cascade", LINEAGE + """,
    act AS (SELECT DISTINCT v.book_id, v.page, x.boxno AS source FROM vis v JOIN live x ON x.book_id = v.book_id AND x.page = v.page AND x.boxno IN (v.b0, v.b1)),
    hid AS (SELECT b.book_id, b.page, b.boxno AS source FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.book_id = b.book_id AND a.page = b.page AND a.source = b.boxno)),
    rej AS (SELECT book_id, page, g, b0, b1 FROM grp WHERE page % 4 = 1 AND g = 1),
    st AS (SELECT g.book_id, g.page, g.g AS boxno, g.b0, g.b1, (SELECT count(*) FROM hid h WHERE h.book_id = g.book_id AND h.page = g.page AND h.source IN (g.b0, g.b1)) AS hc,
        EXISTS (SELECT 1 FROM rej r WHERE r.book_id = g.book_id AND r.page = g.page AND r.g = g.g) AS rj, CASE WHEN g.b0 = g.b1 THEN 1 ELSE 2 END AS n FROM grp g),
    stay AS (SELECT * FROM st WHERE NOT (hc = n OR rj)),
    num AS (SELECT book_id, page, boxno FROM st WHERE hc = n OR rj)
    SELECT book_id, page, 'structured' AS artifact, boxno FROM stay
    UNION ALL SELECT s.book_id, s.page, 'translations', s.boxno FROM st s WHERE NOT (s.hc = s.n OR s.rj)
    UNION ALL SELECT s.book_id, s.page, 'placements', s.boxno FROM st s WHERE NOT EXISTS (SELECT 1 FROM num x WHERE x.book_id = s.book_id AND x.page = s.page AND x.boxno = s.boxno)""", ("boxes",))
def lineage_cascade(s):
    _, groups, live, dead = lineage_tables(s)
    gone = (F.col("page") % 5 == 0) & (F.col("boxno") == 0)
    rejected = groups.where((F.col("page") % 4 == 1) & (F.col("boxno") == 1))
    shape = [*PAGE, "boxno", "source_boxnos"]
    later = groups.select(*shape, F.lit("translations").alias("artifact")).unionByName(
        groups.select(*PAGE, "boxno", F.array().cast("array<bigint>").alias("source_boxnos"), F.lit("placements").alias("artifact")))
    out = overlay.lineage_cascade(live, groups.where(~gone), groups.select(*shape), later, dead, groups.where(gone).select(*shape), rejected.select(*shape))
    return out["structured"].select(*PAGE, F.lit("structured").alias("artifact"), "boxno").unionByName(out["later"].select(*PAGE, "artifact", "boxno"))


@query("allocate_numbers", BASE + """
    SELECT b.book_id, b.page, b.record_id, coalesce(m.top + 1, 0) + row_number() OVER (PARTITION BY b.book_id, b.page ORDER BY pos) - 1 AS boxno
    FROM base b LEFT JOIN (SELECT book_id, page, max(boxno) AS top FROM base WHERE boxno % 3 = 0 AND page % 2 = 0 GROUP BY ALL) m USING (book_id, page) WHERE b.boxno % 3 <> 0""", ("boxes",))
def allocate_numbers(s):
    base, n = records(s), F.col("boxno")
    used = base.where((n % 3 == 0) & (F.col("page") % 2 == 0))
    return overlay.allocate_numbers(used, base.where(n % 3 != 0).drop("boxno"), "pos").select(*PAGE, "record_id", "boxno")


@query("complete_groups", """
    g AS (SELECT book_id, page, boxno, boxno AS src FROM boxes WHERE boxno % 3 = 0),
    d AS (SELECT book_id, page, boxno, boxno AS src FROM boxes WHERE boxno % 3 = 1 AND page % 2 = 0),
    u AS (SELECT book_id, page, max(boxno) + 1 AS nxt FROM (SELECT * FROM g UNION ALL SELECT * FROM d) z GROUP BY ALL),
    m AS (SELECT b.book_id, b.page, b.boxno FROM boxes b WHERE b.boxno % 2 = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM g UNION ALL SELECT * FROM d) z WHERE z.book_id = b.book_id AND z.page = b.page AND z.src = b.boxno))
    SELECT book_id, page, boxno, concat('g', boxno) AS record_id, cast(src AS varchar) AS sources FROM g
    UNION ALL SELECT m.book_id, m.page, coalesce(nxt, 0) + row_number() OVER (PARTITION BY m.book_id, m.page ORDER BY m.boxno) - 1, concat('group_r', m.boxno), cast(m.boxno AS varchar) FROM m LEFT JOIN u USING (book_id, page)""", ("boxes",))
def complete_groups(s):
    base, n = records(s), F.col("boxno")
    groups = base.where(n % 3 == 0).select(*PAGE, "boxno", F.concat(F.lit("g"), n).alias("record_id"), F.array("boxno").alias("source_boxnos"), "text", "l", "t", "r", "b")
    deleted = base.where((n % 3 == 1) & (F.col("page") % 2 == 0)).select(*PAGE, "boxno", F.array("boxno").alias("source_boxnos"))
    raw = base.withColumn("source", F.when(n % 2 == 1, "manual").otherwise("full_image"))
    return overlay.complete_groups(groups, raw, deleted).select(*PAGE, "boxno", "record_id", F.array_join("source_boxnos", ",").alias("sources"))


PENDING = """
    tot AS (SELECT book_id, page, cast(floor(boxno / 2) AS bigint) AS g, count(*) AS n FROM boxes GROUP BY ALL),
    o AS (SELECT *, cast(floor(boxno / 2) AS bigint) AS g FROM boxes WHERE boxno <> 5 AND NOT (page % 2 = 0 AND boxno % 6 = 0)),
    p AS (SELECT book_id, page, g, count(*) AS n, string_agg(cast(boxno AS varchar), ',' ORDER BY boxno) AS sources, string_agg(text, '' ORDER BY boxno) AS text,
        min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM o GROUP BY book_id, page, g),
    sv AS (SELECT book_id, page, g, cast(9 AS bigint) AS no FROM tot WHERE (g = 1 AND page % 3 = 0) OR (g = 3 AND page % 15 = 0)),
    ordered AS (SELECT p.*, sv.no AS want, row_number() OVER (PARTITION BY p.book_id, p.page ORDER BY p.g) AS i
      FROM p JOIN tot USING (book_id, page, g) LEFT JOIN sv ON sv.book_id = p.book_id AND sv.page = p.page AND sv.g = p.g AND tot.n = p.n),
    st AS (SELECT book_id, page, g AS no FROM tot WHERE g % 3 = 0 AND page % 2 = 0),
    lists AS (SELECT t.book_id, t.page, coalesce((SELECT list(no) FROM (SELECT no FROM st WHERE st.book_id = t.book_id AND st.page = t.page UNION SELECT no FROM sv WHERE sv.book_id = t.book_id AND sv.page = t.page) z), []) AS reserved,
        coalesce((SELECT list(no) FROM st WHERE st.book_id = t.book_id AND st.page = t.page), []) AS structured FROM (SELECT DISTINCT book_id, page FROM tot) t),
    walk AS (SELECT book_id, page, cast(0 AS bigint) AS i, cast(NULL AS bigint) AS no, reserved, structured FROM lists
      UNION ALL SELECT book_id, page, i, no, list_append(reserved, no), list_append(structured, no)
      FROM (SELECT o.book_id, o.page, o.i, w.reserved, w.structured, CASE WHEN o.want IS NOT NULL AND NOT list_contains(w.structured, o.want) THEN o.want
          WHEN list_contains(w.reserved, o.g) THEN coalesce(list_max(w.reserved), -1) + 1 ELSE o.g END AS no
        FROM walk w JOIN ordered o ON o.book_id = w.book_id AND o.page = w.page AND o.i = w.i + 1) x)"""


@query("pending_descendants", PENDING + """
    SELECT book_id, page, w.no AS boxno, sources, text, l, t, r, b, 'unclear' AS reason FROM walk w JOIN ordered USING (book_id, page, i)""", ("boxes",))
def pending_descendants(s):
    return s.in_turns(_pending)


def _pending(s):
    boxes, groups, _, _ = lineage_tables(s)
    n, p = F.col("boxno"), F.col("page")
    shape = [*PAGE, "boxno", "source_boxnos"]
    structured = groups.where((n % 3 == 0) & (p % 2 == 0)).select(*PAGE, "boxno", F.slice("source_boxnos", 1, 1).alias("source_boxnos"))
    saved = groups.where(((n == 1) & (p % 3 == 0)) | ((n == 3) & (p % 15 == 0))).select(
        *PAGE, F.lit(9).cast("bigint").alias("boxno"), "source_boxnos", F.lit("translations").alias("artifact"))
    reserved = structured.select(*PAGE, "boxno")
    rejected = boxes.where(n == 5).select(*PAGE, F.col("boxno").alias("source"))
    made = overlay.pending_descendants(groups.select(*shape, "text", "l", "t", "r", "b"), boxes, structured, saved, rejected, reserved)
    return made.select(*PAGE, "boxno", F.array_join("source_boxnos", ",").alias("sources"), "text", "l", "t", "r", "b", "reason")


@query("placeholder_rows", """
    SELECT book_id, page, 'translations' AS artifact, cast(floor(boxno / 2) AS bigint) AS boxno, string_agg(cast(boxno AS varchar), ',' ORDER BY boxno) AS sources
    FROM boxes WHERE NOT (page % 4 = 1) AND cast(floor(boxno / 2) AS bigint) % 2 = 1 GROUP BY book_id, page, cast(floor(boxno / 2) AS bigint)
    UNION ALL SELECT book_id, page, 'translations', cast(floor(boxno / 2) AS bigint), string_agg(cast(boxno AS varchar), ',' ORDER BY boxno)
    FROM boxes WHERE page % 4 = 1 GROUP BY book_id, page, cast(floor(boxno / 2) AS bigint)""", ("boxes",))
def placeholder_rows(s):
    groups = lineage_tables(s)[1]
    existing = groups.where((F.col("boxno") % 2 == 0) & (F.col("page") % 4 != 1))
    return overlay.placeholder_rows(groups, existing, "translations").select(*PAGE, "artifact", "boxno", F.array_join("source_boxnos", ",").alias("sources"))


@query("visible_merge", BASE + """,
    hid AS (SELECT * FROM base WHERE boxno % 3 = 2),
    sent AS (SELECT book_id, page, record_id, row_number() OVER (PARTITION BY book_id, page ORDER BY boxno DESC) - 1 AS k FROM base WHERE boxno % 3 <> 2 AND boxno <> 4),
    slot AS (SELECT book_id, page, pos, row_number() OVER (PARTITION BY book_id, page ORDER BY pos) - 1 AS k FROM base WHERE boxno % 3 <> 2 AND boxno <> 4),
    u AS (SELECT book_id, page, record_id, pos, true AS hidden FROM hid UNION ALL SELECT book_id, page, record_id, slot.pos, false FROM sent JOIN slot USING (book_id, page, k))
    SELECT book_id, page, record_id, hidden, row_number() OVER (PARTITION BY book_id, page ORDER BY pos) - 1 AS pos FROM u""", ("boxes",))
def visible_merge(s):
    base, n = records(s), F.col("boxno")
    shown = base.where(n % 3 != 2)
    sent = base.where(n != 4).withColumn("pos", 100 - n)
    return overlay.visible_merge(base, shown, sent).select(*PAGE, "record_id", "hidden", "pos")


# edits of edits --------------------------------------------------------------------------

FLAT_EDITS = BASE + """,
    ed AS (SELECT book_id, page, 'field' AS kind, record_id, boxno, boxno % 4 = 0 AS protected FROM base WHERE page % 3 = 0 AND boxno % 2 = 0
      UNION ALL SELECT book_id, page, 'deleted', record_id, boxno, page % 8 = 1 FROM base WHERE page % 4 = 1 AND boxno = 1
      UNION ALL SELECT book_id, page, 'added', 'new', 50, page % 10 = 0 FROM base WHERE page % 5 = 0 AND boxno = 0
      UNION ALL SELECT book_id, page, 'order', record_id, boxno, true FROM base WHERE page % 6 = 0 AND boxno < 3
      UNION ALL SELECT book_id, page, 'freeze', record_id, boxno, page % 2 = 0 FROM base WHERE page % 11 = 0 AND boxno < 2)"""
ED = "SELECT book_id, page, kind, record_id, {} AS protected FROM ed"


def flat_edits(df: DataFrame) -> DataFrame:
    return df.select(*PAGE, "kind", "record_id", "protected")


@query("set_protection", FLAT_EDITS + ED.format("CASE WHEN kind IN ('field', 'added', 'deleted') AND record_id IN ('r0', 'r1', 'new') THEN true ELSE protected END"), ("boxes",))
def set_protection(s):
    base = records(s)
    targets = base.where("boxno < 2").select(*PAGE, "record_id").unionByName(base.where("boxno = 0").select(*PAGE, F.lit("new").alias("record_id")))
    return flat_edits(overlay.set_protection(edit_table(base), targets.withColumn("protected", F.lit(True)), [*PAGE, "record_id"]))


@query("set_artifact_protection", FLAT_EDITS + ED.format("CASE WHEN kind <> 'freeze' AND page % 2 = 0 THEN false ELSE protected END"), ("boxes",))
def set_artifact_protection(s):
    base = records(s)
    targets = base.where("page % 2 = 0").select(*PAGE, F.lit("structure").alias("stage"), F.lit("ocr_structured").alias("artifact")).distinct()
    return flat_edits(overlay.set_protection(edit_table(base), targets.withColumn("protected", F.lit(False)), [*PAGE, "stage", "artifact"]))


@query("discard_unprotected", FLAT_EDITS + ED.format("protected") + " WHERE NOT (page % 2 = 1 AND NOT protected AND kind <> 'freeze')", ("boxes",))
def discard_unprotected(s):
    base = records(s)
    return flat_edits(overlay.discard_unprotected(edit_table(base), base.where("page % 2 = 1").select(*PAGE).distinct(), PAGE))


@query("remove_edits", FLAT_EDITS + ED.format("protected") + """ WHERE kind = 'freeze' OR (kind = 'order' AND NOT page % 4 = 0) OR (kind NOT IN ('order', 'freeze') AND NOT (page % 4 = 0 AND record_id = 'r0'))""", ("boxes",))
def remove_edits(s):
    base = records(s)
    return flat_edits(overlay.remove_edits(edit_table(base), base.where("page % 4 = 0 AND boxno = 0").select(*PAGE, "record_id"), [*PAGE, "record_id"]))


@query("freeze_stage", FLAT_EDITS + ED.format("protected") + """ WHERE NOT (kind = 'freeze' AND (page % 2 = 0 OR page % 3 = 0))
    UNION ALL SELECT book_id, page, 'freeze', record_id, true FROM base WHERE page % 2 = 0
    UNION ALL SELECT DISTINCT book_id, page, 'freeze', cast(NULL AS varchar), true FROM base WHERE page % 2 = 0""", ("boxes",))
def freeze_stage(s):
    base, p = records(s), F.col("page")
    pages = base.select(*PAGE).distinct().where((p % 2 == 0) | (p % 3 == 0)).withColumn("frozen", p % 2 == 0)
    return flat_edits(overlay.freeze_stage(edit_table(base), pages, "structure", {"ocr_structured": base}))


@query("frozen_records", BASE + " SELECT book_id, page, record_id, pos, boxno, text FROM base WHERE page % 4 <> 0", ("boxes",))
def frozen_records(s):
    base = records(s)
    pages = base.select(*PAGE).distinct().withColumn("frozen", F.lit(True))
    edits = overlay.freeze_stage(edit_table(base), pages, "structure", {"ocr_structured": base.where(F.col("page") % 4 != 0)})
    return flat(overlay.apply_overrides(base, edits, "ocr_structured", ["text"]))


@query("protection_summary", FLAT_EDITS + """
    SELECT book_id, page, record_id, count(*) FILTER (kind = 'field' AND protected) AS protected_fields, count(*) FILTER (kind = 'field' AND NOT protected) AS open_fields,
      max(CASE WHEN kind <> 'field' THEN kind END) AS state, max(CASE WHEN kind <> 'field' THEN protected END) AS state_protected FROM ed WHERE kind IN ('field', 'added', 'deleted') GROUP BY ALL""", ("boxes",))
def protection_summary(s):
    return overlay.protection_summary(edit_table(records(s))).drop("stage")


PATCH = BASE + """,
    pe AS (SELECT book_id, page, CASE WHEN boxno % 2 = 0 THEN 'ocr_structured' ELSE 'translations' END AS artifact, CASE WHEN boxno = 5 THEN 70 ELSE boxno END AS boxno, CASE WHEN boxno = 4 THEN 'zz' ELSE record_id END AS record_id,
        CASE WHEN page % 3 = 0 THEN text ELSE concat(text, '?') END AS value, text, boxno AS n FROM base
      UNION ALL SELECT book_id, page, 'ocr_structured', 0, 'r0', 'again', text, 0 FROM base WHERE boxno = 0 AND page % 7 = 0),
    pj AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY book_id, page, artifact, boxno) > 1 THEN 'repeated_edit' WHEN n IN (5, 6) THEN 'no_placement' WHEN n = 4 THEN 'other_record' END AS code FROM pe)"""


def _patch(s):
    base, n = records(s), F.col("boxno")
    edits = base.select(*PAGE, F.when(n % 2 == 0, "ocr_structured").otherwise("translations").alias("artifact"), F.when(n == 5, 70).otherwise(n).alias("boxno"),
                        F.when(n == 4, "zz").otherwise(F.col("record_id")).alias("record_id"),
                        F.when(F.col("page") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("?"))).alias("value"))
    again = base.where((n == 0) & (F.col("page") % 7 == 0)).select(*PAGE, F.lit("ocr_structured").alias("artifact"), "boxno", "record_id", F.lit("again").alias("value"))
    translations = base.where(n % 4 == 1).withColumn("english_text", F.col("text"))
    return overlay.patch_text(edits.unionByName(again), base, translations, base.where("boxno <> 6"))


@query("patch_text", PATCH + """
    SELECT book_id, page, artifact, boxno, record_id, value, artifact = 'translations' AND n % 4 <> 1 AS created FROM pj
    WHERE code IS NULL AND value <> CASE WHEN artifact = 'translations' AND n % 4 <> 1 THEN '' ELSE text END""", ("boxes",))
def patch_text(s):
    return _patch(s)[0].drop("field")


@query("patch_text_errors", PATCH + " SELECT book_id, page, artifact, boxno, code FROM pj WHERE code IS NOT NULL", ("boxes",))
def patch_text_errors(s):
    return _patch(s)[1]


@query("record_ids", """
    SELECT book_id, page, boxno, concat('raw_', substr(sha256(concat('[', page, ',[', boxno, ',[', l, ',', t, ',', r, ',', b, '],"', text, '"]]')), 1, 16)) AS raw_id,
      concat('text_', substr(sha256(concat('[', page, ',[', boxno, ',[', boxno + 1, ']]]')), 1, 16)) AS text_id FROM boxes""", ("boxes",))
def record_ids(s):
    raw = overlay.record_id("ocr_raw", F.col("page"), F.col("boxno"), region=F.array("l", "t", "r", "b"), text=F.col("text"))
    text = overlay.record_id("translations", F.col("page"), F.col("boxno"), sources=F.array(F.col("boxno") + 1))
    return s.boxes.select(*PAGE, "boxno", raw.alias("raw_id"), text.alias("text_id"))


# a page keeps its records, has one edited, two swapped or the last one repeated; other columns change everywhere
@query("record_signature", BASE + """,
    cnt AS (SELECT book_id, page, max(boxno) AS last FROM boxes GROUP BY ALL),
    aft AS (SELECT b.book_id, b.page, CASE WHEN page % 4 = 2 AND last > 0 AND pos < 2 THEN 1 - pos ELSE pos END AS pos, record_id, boxno,
          CASE WHEN page % 4 = 1 AND boxno = 1 THEN concat('edited "', text, '"') ELSE text END AS text FROM base b JOIN cnt USING (book_id, page)
        UNION ALL SELECT b.book_id, b.page, pos + 1, record_id, boxno, text FROM base b JOIN cnt USING (book_id, page) WHERE page % 4 = 3 AND boxno = last),
    sides AS (SELECT 'x' AS side, book_id, page, pos, record_id, boxno, text FROM base UNION ALL SELECT 'y', * FROM aft),
    leaf AS (SELECT side, book_id, page, pos, sha256(concat('{"boxno":', boxno, ',"record_id":"', record_id, '","text":"', replace(text, '"', chr(92) || '"'), '"}')) AS h FROM sides),
    blk AS (SELECT side, book_id, page, pos // 4096 AS block, sha256(string_agg(concat(pos, ':', h), chr(10) ORDER BY pos, h)) AS h FROM leaf GROUP BY ALL),
    sig AS (SELECT side, book_id, page, sha256(string_agg(concat(block, ':', h), chr(10) ORDER BY block)) AS signature FROM blk GROUP BY ALL)
    SELECT a.book_id, a.page, a.signature AS before, b.signature, a.signature = b.signature AS same
    FROM sig a JOIN sig b ON a.book_id = b.book_id AND a.page = b.page WHERE a.side = 'x' AND b.side = 'y'""", ("boxes",))
def record_signature(s):
    base = records(s)
    page, pos = F.col("page") % 4, F.col("pos")
    last = base.groupBy(*PAGE).agg(F.max("boxno").alias("last"))
    known = base.join(last, list(PAGE))
    edited = known.withColumn("text", F.when((page == 1) & (F.col("boxno") == 1), F.concat(F.lit('edited "'), "text", F.lit('"'))).otherwise(F.col("text")))
    swapped = edited.withColumn("pos", F.when((page == 2) & (F.col("last") > 0) & (pos < 2), 1 - pos).otherwise(pos)).withColumn("l", F.col("l") + 1)
    after = swapped.unionByName(known.where((page == 3) & (F.col("boxno") == F.col("last"))).withColumn("pos", pos + 1))
    fields = ["record_id", "boxno", "text"]
    a = overlay.record_signature(base, fields).withColumnRenamed("signature", "before")
    b = overlay.record_signature(after, fields)
    return a.join(b, list(PAGE)).withColumn("same", F.col("before") == F.col("signature"))


# stages ----------------------------------------------------------------------------------

STAGE_EVENTS = """
    st(k, stage) AS (VALUES (1, 'ocr'), (2, 'structure'), (3, 'erase'), (4, 'translation'), (5, 'placement')),
    ev AS (SELECT concat('b', user_id % 4) AS book_id, user_id AS page, event_id AS revision, CASE event_type WHEN 'click' THEN 'regenerated' WHEN 'view' THEN 'edited' ELSE 'saved' END AS kind,
        cast(1 + event_id % 5 AS integer) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    run AS (SELECT book_id, page, cast(0 AS bigint) AS i, cast([] AS integer[]) AS p, cast([] AS integer[]) AS s FROM ev WHERE i = 1
      UNION ALL SELECT w.book_id, w.page, e.i, n.p, CASE WHEN e.kind = 'regenerated' THEN list_sort(list_distinct(list_concat([x FOR x IN w.s IF x < e.r], [x FOR x IN [1, 2, 3, 4, 5] IF len(n.p) > 0 AND x > list_min(n.p)])))
          WHEN e.kind = 'saved' THEN list_sort(list_distinct(list_concat([x FOR x IN w.s IF x > e.r], [x FOR x IN [1, 2, 3, 4, 5] IF x > e.r])))
          ELSE list_sort(list_distinct(list_concat(w.s, [x FOR x IN [1, 2, 3, 4, 5] IF x > e.r]))) END
      FROM run w JOIN ev e ON e.page = w.page AND e.i = w.i + 1 CROSS JOIN LATERAL (SELECT CASE e.kind WHEN 'regenerated' THEN [x FOR x IN w.p IF x < e.r]
        WHEN 'saved' THEN list_sort(list_concat([x FOR x IN w.p IF x > e.r], [e.r])) ELSE list_sort(list_distinct(list_concat(w.p, [e.r]))) END AS p) n)"""


def stage_events(s) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "regenerated").when(F.col("event_type") == "view", "edited").otherwise("saved")
    names = F.array(*[F.lit(x) for x in overlay.STAGES])
    return s.events.select(F.concat(F.lit("b"), F.col("user_id") % 4).alias("book_id"), F.col("user_id").alias("page"), F.col("event_id").alias("revision"),
                           kind.alias("kind"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("stage"))


@query("stale_after_events", STAGE_EVENTS + """
    SELECT book_id, page, array_to_string([['ocr', 'structure', 'erase', 'translation', 'placement'][x] FOR x IN p], ',') AS pending,
      array_to_string([['ocr', 'structure', 'erase', 'translation', 'placement'][x] FOR x IN s], ',') AS stale
    FROM (SELECT *, max(i) OVER (PARTITION BY page) AS last FROM run) z WHERE i = last""")
def stale_after_events(s):
    return overlay.stale_after_events(stage_events(s)).select(*PAGE, F.array_join("pending", ",").alias("pending"), F.array_join("stale", ",").alias("stale"))


@query("earliest_rerun", STAGE_EVENTS + """
    SELECT e.book_id, e.page, CASE min(CASE WHEN revision % 7 = 0 THEN r END) WHEN 1 THEN 'ocr_structured' WHEN 2 THEN 'alt_placement' WHEN 3 THEN 'translations' WHEN 4 THEN 'placements' ELSE 'render' END AS phase
    FROM ev e GROUP BY ALL""")
def earliest_rerun(s):
    events = stage_events(s)
    return overlay.earliest_rerun(events.where("revision % 7 = 0"), events.select(*PAGE).distinct())


@query("reset_pending", """
    st(k, stage) AS (VALUES (1, 'ocr'), (2, 'structure'), (3, 'erase'), (4, 'translation'), (5, 'placement')),
    x AS (SELECT concat('b', o_custkey % 8) AS book_id, o_orderkey AS page, k, stage, (o_orderkey + k) % 3 = 0 AS pending, CASE WHEN (o_orderkey + k) % 4 < 2 THEN 'a' END AS base,
        CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS before, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS after, k <= 1 + o_orderkey % 5 AS reset FROM orders, st),
    y AS (SELECT *, CASE WHEN reset THEN CASE WHEN base IS NOT NULL THEN after <> base ELSE NOT pending AND before <> after END ELSE pending END AS now FROM x)
    SELECT book_id, page, stage, now AS pending, coalesce(k > min(CASE WHEN now THEN k END) OVER (PARTITION BY book_id, page), false) AS stale FROM y""")
def reset_pending(s):
    names = F.array(*[F.lit(x) for x in overlay.STAGES])
    rows = s.orders.select(F.concat(F.lit("b"), F.col("o_custkey") % 8).alias("book_id"), F.col("o_orderkey").alias("page"), F.posexplode(names).alias("i", "stage"))
    k, p = F.col("i") + 1, F.col("page")
    return overlay.reset_pending(rows.select(
        *PAGE, "stage", ((p + k) % 3 == 0).alias("pending"), F.when((p + k) % 4 < 2, "a").alias("base"), F.when(k % 2 == 0, "a").otherwise("b").alias("before"),
        F.when(p % 2 == 0, "a").otherwise("b").alias("after"), (k <= 1 + p % 5).alias("reset")))


@query("stage_status", FLAT_EDITS + """,
    st(k, stage) AS (VALUES (1, 'ocr'), (2, 'structure'), (3, 'erase'), (4, 'translation'), (5, 'placement')),
    pg AS (SELECT DISTINCT book_id, page FROM boxes), ep AS (SELECT DISTINCT book_id, page FROM ed),
    s AS (SELECT pg.book_id, pg.page, stage, stage = 'structure' AND ep.page IS NOT NULL AS changed, (pg.page + k) % 3 = 0 AS stale, (pg.page + k) % 4 = 0 AS pending, pg.page % 5 > 1 AS frozen, cast(pg.page * k AS bigint) AS saved_revision
      FROM pg CROSS JOIN st LEFT JOIN ep USING (book_id, page))
    SELECT * FROM s UNION ALL SELECT book_id, page, 'text', bool_or(changed), bool_or(stale), bool_or(pending), bool_and(frozen), max(saved_revision) FROM s
    WHERE stage IN ('structure', 'erase', 'translation') GROUP BY ALL""", ("boxes",))
def stage_status(s):
    base = records(s)
    k, p = F.col("i") + 1, F.col("page")
    names = F.array(*[F.lit(x) for x in overlay.STAGES])
    states = base.select(*PAGE).distinct().select(*PAGE, F.posexplode(names).alias("i", "stage")).select(
        *PAGE, "stage", ((p + k) % 3 == 0).alias("stale"), ((p + k) % 4 == 0).alias("pending"), (p % 5 > 1).alias("frozen"), (p * k).alias("saved_revision"))
    return overlay.stage_status(edit_table(base), states)


@query("state_at_revision", """
    SELECT user_id, k, value FROM (SELECT user_id, event_id % 7 AS k, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS last FROM events
      WHERE event_id <= 5000 GROUP BY ALL) x WHERE last <> 'error'""")
def state_at_revision(s):
    history = s.events.select("user_id", (F.col("event_id") % 7).alias("k"), F.col("event_id").alias("revision"), "value", (F.col("event_type") == "error").alias("removed"))
    return overlay.state_at(history, 5000, ["user_id", "k"])


@query("revisions", "SELECT concat('b', user_id % 4) AS book_id, cast(floor(event_id / 10) AS bigint) AS revision, max(ts) AS updated_at, count(*) AS edits FROM events GROUP BY ALL")
def revisions(s):
    return overlay.revisions(s.events.select(F.concat(F.lit("b"), F.col("user_id") % 4).alias("book_id"), F.floor(F.col("event_id") / 10).alias("revision"), F.col("ts").alias("updated_at")))
