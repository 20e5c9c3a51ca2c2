"""Model answers built from the box table, checked against the boxes they should name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import answer_json as aj
from boxloom.functions import text as tx
from boxloom.operators import answers as ans
from boxloom.plans.inputs import PAGE_HEIGHT, PAGE_WIDTH
from boxloom.plans.registry import query

PAGE = ("book_id", "page")
# which pages get a faulty answer, and how
FAULTS = """
    pg AS (SELECT DISTINCT book_id, page FROM boxes),
    good AS (SELECT book_id, page FROM pg WHERE page % 10 > 2 AND page % 50 <> 3)"""
FAULT_ERRORS = """
    SELECT book_id, page, 'invalid_json' AS code, cast(NULL AS bigint) AS key, cast(NULL AS bigint) AS pos FROM pg WHERE page % 50 = 3
    UNION ALL SELECT book_id, page, 'missing', cast(0 AS bigint), NULL FROM pg WHERE page % 10 = 0
    UNION ALL SELECT book_id, page, 'duplicate', cast(0 AS bigint), cast(n AS bigint) FROM pg JOIN (SELECT book_id, page, count(*) AS n FROM boxes GROUP BY ALL) c USING (book_id, page) WHERE page % 10 = 1
    UNION ALL SELECT book_id, page, 'unknown', cast(99 AS bigint), cast(n AS bigint) FROM pg JOIN (SELECT book_id, page, count(*) AS n FROM boxes GROUP BY ALL) c USING (book_id, page) WHERE page % 10 = 2"""


def answer_table(boxes: DataFrame, row: Column, extra: Column) -> DataFrame:
    """One answer text per page: a row per box in falling box order, with the faults above.

    `extra` is the row text for box `n`, used for the repeated and the unknown key.
    """
    listed = F.col("book_id").isNotNull() & F.col("page").isNotNull() & ~((F.col("page") % 10 == 0) & (F.col("boxno") == 0))
    pages = boxes.groupBy(*PAGE).agg(F.transform(
        F.sort_array(F.collect_list(F.when(listed, F.struct((-F.col("boxno")).alias("o"), row.alias("x"))))), lambda m: m["x"]).alias("rows"))
    none = F.array().cast("array<string>")
    more = (F.when(F.col("page") % 10 == 1, F.array(F.replace(extra, F.lit("#"), F.lit("0"))))
            .when(F.col("page") % 10 == 2, F.array(F.replace(extra, F.lit("#"), F.lit("99")))).otherwise(none))
    body = F.array_join(F.concat("rows", more), ",")
    text = (F.when(F.col("page") % 50 == 3, F.concat(F.lit("[["), body))
            .when(F.col("page") % 2 == 0, F.concat(F.lit("```json\n["), body, F.lit(",]\n```")))
            .when(F.col("page") % 3 == 0, F.concat(F.lit('{"rows":['), body, F.lit("]}")))
            .otherwise(F.concat(F.lit("["), body, F.lit("]"))))
    return pages.select(*PAGE, text.alias("raw"))


def as_groups(boxes: DataFrame) -> DataFrame:
    return boxes.select(*PAGE, "boxno", F.array(F.col("boxno") + 10).alias("source_boxnos"), "l", "t", "r", "b", "text")


def structure_answers(boxes: DataFrame) -> DataFrame:
    n = F.col("boxno")
    kind = F.when(n % 4 == 3, "reject").when(n % 4 == 2, "sfx").otherwise("text")
    named = F.concat(F.lit("["), n, F.lit(',"'), kind,
                     F.when(n % 3 == 1, F.concat(F.lit('","fix, '), n, F.lit('"]'))).otherwise(F.lit('"]')))
    compact = F.concat(F.lit("["), n, F.lit(","), F.when(n % 4 == 3, "1]").otherwise(
        F.concat(F.lit("0,"), F.when(n % 4 == 2, "true").otherwise("false"),
                 F.when(n % 3 == 1, F.concat(F.lit(',"fix, '), n, F.lit('"]'))).otherwise(F.lit("]")))))
    as_object = F.concat(F.lit('{"mergedBoxno":'), n, F.lit(',"reject":'), F.when(n % 4 == 3, "true").otherwise("false"),
                         F.lit(',"sfx":'), F.when(n % 4 == 2, "true").otherwise("false"),
                         F.when(n % 3 == 1, F.concat(F.lit(',"textCorrection":"fix, '), n, F.lit('"}'))).otherwise(F.lit("}")))
    p = F.col("page")
    row = F.when(p % 5 == 4, compact).when(p % 7 == 4, as_object).otherwise(named)
    return answer_table(boxes, row, F.lit('[#,"text"]'))


STRUCTURED = FAULTS + """,
    kept AS (SELECT book_id, page, boxno, row_number() OVER (PARTITION BY book_id, page ORDER BY boxno DESC) - 1 AS new_no,
        boxno % 4 = 2 AS sfx, CASE WHEN boxno % 3 = 1 THEN concat('fix, ', boxno) ELSE text END AS text
      FROM boxes JOIN good USING (book_id, page) WHERE boxno % 4 <> 3)"""


@query("apply_structure", STRUCTURED + """
    SELECT book_id, page, new_no AS boxno, cast(boxno + 10 AS varchar) AS sources, sfx, false AS open_lettering, text FROM kept""", ("boxes",))
def apply_structure(s):
    boxes = s.kept("boxes")
    rows, _ = ans.apply_structure(as_groups(boxes), structure_answers(boxes))
    return rows.select(*PAGE, "boxno", F.array_join("source_boxnos", ",").alias("sources"), "sfx", "open_lettering", "text")


@query("apply_structure_errors", FAULTS + FAULT_ERRORS, ("boxes",))
def apply_structure_errors(s):
    boxes = s.kept("boxes")
    return ans.apply_structure(as_groups(boxes), structure_answers(boxes))[1]


@query("validate_keys", FAULTS + """,
    got AS (SELECT book_id, page, boxno + (CASE WHEN boxno % 5 = 4 THEN 100 ELSE 0 END) AS boxno, boxno AS pos,
              CASE WHEN page % 6 = 0 AND boxno = 1 THEN page + 1 ELSE page END AS item_page FROM boxes
            UNION ALL SELECT book_id, page, boxno, boxno + 50, page FROM boxes WHERE boxno % 3 = 0)
    SELECT book_id, page, 'wrong_page' AS code, boxno AS key, pos FROM got WHERE item_page <> page
    UNION ALL SELECT g.book_id, g.page, 'unknown', g.boxno, g.pos FROM got g WHERE item_page = page
      AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.book_id = g.book_id AND b.page = g.page AND b.boxno = g.boxno)
    UNION ALL SELECT book_id, page, 'duplicate', boxno, pos FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page, boxno ORDER BY pos) AS k
      FROM got WHERE item_page = page) x WHERE k > 1 AND boxno < 100
    UNION ALL SELECT book_id, page, 'missing', boxno, NULL FROM boxes b WHERE NOT EXISTS
      (SELECT 1 FROM got g WHERE g.item_page = g.page AND b.book_id = g.book_id AND b.page = g.page AND b.boxno = g.boxno)""", ("boxes",))
def validate_keys(s):
    boxes = s.boxes
    n = F.col("boxno")
    page = F.when((F.col("page") % 6 == 0) & (n == 1), F.col("page") + 1).otherwise(F.col("page"))
    got = boxes.select(*PAGE, (n + F.when(n % 5 == 4, 100).otherwise(0)).alias("boxno"), n.alias("pos"), page.alias("item_page"))
    again = boxes.where(n % 3 == 0).select(*PAGE, "boxno", (n + 50).alias("pos"), F.col("page").alias("item_page"))
    return ans.validate_keys(boxes, got.unionByName(again))


@query("first_valid_attempt", """
    err AS (SELECT book_id, page, 1 AS attempt FROM boxes WHERE page % 4 <> 0
            UNION SELECT book_id, page, 2 FROM boxes WHERE page % 8 > 4 UNION SELECT book_id, page, 3 FROM boxes WHERE page % 16 = 7 UNION SELECT book_id, page, 4 FROM boxes WHERE page % 32 = 7),
    tried AS (SELECT DISTINCT book_id, page, cast(i AS integer) AS attempt FROM boxes, (VALUES (1), (2), (3), (4)) n(i)),
    ok AS (SELECT book_id, page, min(attempt) AS attempt FROM tried t WHERE NOT EXISTS
             (SELECT 1 FROM err e WHERE e.book_id = t.book_id AND e.page = t.page AND e.attempt = t.attempt) GROUP BY ALL)
    SELECT p.book_id, p.page, ok.attempt, ok.attempt IS NULL AS failed,
      CASE WHEN coalesce(ok.attempt, 5) > 1 THEN concat('missing ', coalesce(ok.attempt, 5) - 1) END AS previous_error
    FROM (SELECT DISTINCT book_id, page FROM boxes) p LEFT JOIN ok USING (book_id, page)""", ("boxes",))
def first_valid_attempt(s):
    pages = s.boxes.select(*PAGE).distinct()
    tried = pages.select(*PAGE, F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("attempt"))
    p, a = F.col("page"), F.col("attempt")
    failing = ((a == 1) & (p % 4 != 0)) | ((a == 2) & (p % 8 > 4)) | ((a == 3) & (p % 16 == 7)) | ((a == 4) & (p % 32 == 7))
    errors = tried.where(failing).select(*PAGE, "attempt", F.concat(F.lit("missing "), a).alias("code"),
                                         F.lit(0).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("pos"))
    return ans.first_valid_attempt(tried, errors, PAGE)


def erase_answers(boxes: DataFrame) -> DataFrame:
    n, p = F.col("boxno"), F.col("page")
    code = (n + p) % 11
    listed = F.concat(F.lit("["), n, F.lit(","), F.when(n % 3 == 0, "0").when(n % 3 == 1, '"yes"').otherwise("true"),
                      F.lit(","), code, F.lit("]"))
    legacy = F.concat(F.lit('{"boxno":'), n, F.lit(',"needsAlternatePlacement":'), F.when(n % 3 == 0, "true").otherwise("false"),
                      F.lit(',"reason":"Over-Art"}'))
    return answer_table(boxes, F.when(p % 4 == 3, legacy).otherwise(listed), F.lit("[#,1]"))


ERASE = FAULTS + """,
    erased AS (SELECT book_id, page, boxno, boxno % 3 <> 0 AS safe_to_erase, boxno % 3 = 0 AS open_lettering,
        CASE WHEN page % 4 = 3 THEN 'over_art' ELSE CASE (boxno + page) % 11 WHEN 0 THEN 'bubble' WHEN 1 THEN 'caption_box'
          WHEN 2 THEN 'bordered_box' WHEN 3 THEN 'blank_text_area' WHEN 4 THEN 'sign_label' WHEN 5 THEN 'over_art'
          WHEN 6 THEN 'over_face_body' WHEN 7 THEN 'integrated_sfx' WHEN 8 THEN 'unclear'
          ELSE CASE WHEN boxno % 3 <> 0 THEN 'blank_text_area' ELSE 'unclear' END END END AS reason
      FROM boxes JOIN good USING (book_id, page))"""


@query("apply_erase", ERASE + " SELECT * FROM erased", ("boxes",))
def apply_erase(s):
    boxes = s.kept("boxes")
    return ans.apply_erase(boxes, erase_answers(boxes))[0]


@query("apply_erase_errors", FAULTS + FAULT_ERRORS, ("boxes",))
def apply_erase_errors(s):
    boxes = s.kept("boxes")
    return ans.apply_erase(boxes, erase_answers(boxes))[1]


@query("hydrate_erase", ERASE + """
    SELECT b.book_id, b.page, b.boxno, CASE WHEN e.boxno IS NOT NULL THEN e.safe_to_erase
        WHEN b.boxno % 4 = 0 THEN b.boxno % 8 <> 0 WHEN b.boxno % 4 = 1 THEN b.page % 2 = 0 ELSE true END AS safe_to_erase,
      CASE WHEN e.boxno IS NOT NULL THEN e.open_lettering
        WHEN b.boxno % 4 = 0 THEN b.boxno % 8 = 0 WHEN b.boxno % 4 = 1 THEN b.page % 2 <> 0 ELSE false END AS open_lettering,
      CASE WHEN e.boxno IS NOT NULL THEN e.reason WHEN b.boxno = 6 THEN 'kept'
        WHEN (b.boxno % 4 = 0 AND b.boxno % 8 = 0) OR (b.boxno % 4 = 1 AND b.page % 2 <> 0) THEN 'unclear' ELSE 'blank_text_area' END AS reason
    FROM boxes b LEFT JOIN erased e ON b.book_id = e.book_id AND b.page = e.page AND b.boxno = e.boxno AND b.page % 6 <> 0""", ("boxes",))
def hydrate_erase(s):
    boxes, n = s.kept("boxes"), F.col("boxno")
    records = boxes.select(
        *PAGE, "boxno", F.when(n % 4 == 0, n % 8 == 0).alias("open_lettering"),
        F.when(n % 4 == 1, F.col("page") % 2 == 0).alias("safe_to_erase"), F.when(n == 6, "kept").alias("reason"))
    saved = erase_answers(boxes).where(F.col("page") % 6 != 0)
    return ans.hydrate_erase(records, saved)


def translation_answers(boxes: DataFrame) -> DataFrame:
    n, p = F.col("boxno"), F.col("page")
    english = F.concat(F.lit('"en [,] '), n, F.lit('"'))
    two = F.concat(F.lit("["), n, F.lit(","), english, F.lit("]"))
    four = F.concat(F.lit("["), p, F.lit(","), n, F.lit(',"w'), n % 5, F.lit('",'), english, F.lit("]"))
    obj = F.concat(F.lit('{"boxno":"'), n, F.lit('","text":"'), F.col("text"), F.lit('","englishText":'), english, F.lit("}"))
    return answer_table(boxes, F.when(p % 4 == 3, four).when(p % 4 == 2, obj).otherwise(two), F.lit('[#,"again"]'))


@query("attach_translations", FAULTS + """
    SELECT book_id, page, boxno, text, concat('en [,] ', boxno) AS english_text FROM boxes JOIN good USING (book_id, page)""", ("boxes",))
def attach_translations(s):
    boxes = s.kept("boxes")
    return ans.attach_translations(boxes, translation_answers(boxes))[0]


@query("attach_translations_warnings", FAULTS + """
    SELECT book_id, page, boxno, concat('w', boxno % 5) AS echo, text FROM boxes JOIN good USING (book_id, page)
    WHERE page % 4 = 3 AND concat('w', boxno % 5) <> text""", ("boxes",))
def attach_translations_warnings(s):
    boxes = s.kept("boxes")
    return ans.attach_translations(boxes, translation_answers(boxes))[2]


@query("attach_translations_errors", FAULTS + FAULT_ERRORS, ("boxes",))
def attach_translations_errors(s):
    boxes = s.kept("boxes")
    return ans.attach_translations(boxes, translation_answers(boxes))[1]


CORRECTIONS = """
    rowsin AS (SELECT concat('b', conv_id % 8) AS book_id, conv_id AS batch, turn AS row_no, concat('t', turn) AS english_text FROM conversations),
    bad AS (SELECT DISTINCT book_id, batch FROM rowsin WHERE batch % 6 IN (3, 4, 5))"""


@query("apply_corrections", CORRECTIONS + """
    SELECT book_id, batch, row_no, CASE WHEN batch % 6 IN (1, 2) AND row_no % 2 = 0 THEN concat('fixed ', row_no) ELSE english_text END AS english_text
    FROM rowsin WHERE batch % 6 < 3""")
def apply_corrections(s):
    return _corrections(s)[0]


@query("apply_corrections_errors", CORRECTIONS + """
    SELECT DISTINCT book_id, batch, CASE batch % 6 WHEN 3 THEN 'bad_line' WHEN 4 THEN 'removed_text' ELSE 'unknown' END AS code,
      cast(CASE batch % 6 WHEN 4 THEN 0 WHEN 5 THEN 77 END AS bigint) AS key, cast(0 AS bigint) AS pos FROM rowsin WHERE batch % 6 > 2""")
def apply_corrections_errors(s):
    errors = _corrections(s)[1]
    # a line without a tab has its text in place of the number
    return errors.withColumn("key", F.when(F.col("code") == "bad_line", F.lit(None)).otherwise(F.col("key")))


def _corrections(s):
    rows = s.conversations.select(F.concat(F.lit("b"), F.col("conv_id") % 8).alias("book_id"), F.col("conv_id").alias("batch"),
                                  F.col("turn").alias("row_no"), F.concat(F.lit("t"), F.col("turn")).alias("english_text"))
    line = F.concat("row_no", F.lit("\tfixed "), "row_no")
    listed = F.array_join(F.sort_array(F.collect_list(F.when(F.col("row_no") % 2 == 0, line))), "\n")
    k = F.col("batch") % 6
    raw = (F.when(k == 0, "<NO_CHANGES>").when(k == 1, F.col("listed")).when(k == 2, F.concat(F.lit("```\n"), "listed", F.lit("\n```")))
           .when(k == 3, "Only one").when(k == 4, "0\t<EMPTY>").otherwise("77\tx"))
    replies = rows.groupBy("book_id", "batch").agg(listed.alias("listed")).select("book_id", "batch", raw.alias("raw"))
    return ans.apply_corrections(rows, replies)


@query("open_labels", """
    SELECT book_id, page, boxno, row_number() OVER (PARTITION BY book_id, page ORDER BY boxno) - 1 AS label
    FROM boxes WHERE boxno % 3 = 0""", ("boxes",))
def open_labels(s):
    return ans.open_labels(s.boxes.withColumn("open_lettering", F.col("boxno") % 3 == 0)).select(*PAGE, "boxno", "label")


def page_sizes(boxes: DataFrame) -> DataFrame:
    return boxes.select(*PAGE).distinct().withColumn("width", F.lit(PAGE_WIDTH)).withColumn("height", F.lit(PAGE_HEIGHT))


@query("apply_open_placements", FAULTS + """,
    lab AS (SELECT book_id, page, boxno, row_number() OVER (PARTITION BY book_id, page ORDER BY boxno) - 1 AS k FROM boxes WHERE boxno % 3 = 0),
    box AS (SELECT *, (k * 131) % 700 - 40 AS y0, (k * 77 + page) % 900 - 50 AS x0 FROM lab JOIN good USING (book_id, page)),
    c AS (SELECT book_id, page, boxno, y0, x0, y0 + 150.0 AS y1, x0 + 220.0 AS x1,
      CASE WHEN y0 < 0 THEN 0.0 ELSE y0 END AS ya, CASE WHEN y0 < 0 THEN 150.0 ELSE y0 + 150.0 END AS yb,
      CASE WHEN x0 < 0 THEN 0.0 WHEN x0 + 220 > 1000 THEN 780.0 ELSE x0 END AS xa,
      CASE WHEN x0 < 0 THEN 220.0 WHEN x0 + 220 > 1000 THEN 1000.0 ELSE x0 + 220.0 END AS xb FROM box)
    SELECT book_id, page, boxno, cast(round_even(xa / 1000.0 * 320, 0) AS bigint) AS pl, cast(round_even(ya / 1000.0 * 480, 0) AS bigint) AS pt,
      cast(round_even(xb / 1000.0 * 320, 0) AS bigint) AS pr, cast(round_even(yb / 1000.0 * 480, 0) AS bigint) AS pb FROM c""", ("boxes",))
def apply_open_placements(s):
    boxes = s.kept("boxes").withColumn("open_lettering", F.col("boxno") % 3 == 0)
    labels = ans.open_labels(boxes).select(*PAGE, "boxno", "label")
    k, p = F.col("boxno"), F.col("page")
    y0, x0 = (k * 131) % 700 - 40, (k * 77 + p) % 900 - 50
    row = F.concat(F.lit("["), k, F.lit(",["), F.concat_ws(",", y0, x0, y0 + 150, x0 + 220), F.lit("]]"))
    answers = answer_table(labels.select(*PAGE, F.col("label").alias("boxno")), row, F.lit("[#,[0,0,10,10]]"))
    return ans.apply_open_placements(boxes, answers, page_sizes(boxes))[0].select(*PAGE, "boxno", "pl", "pt", "pr", "pb")


@query("apply_styles", FAULTS + """
    SELECT book_id, page, boxno, CASE boxno % 3 WHEN 0 THEN 'plain.ttf' WHEN 1 THEN 'NATION_1.ttf' ELSE 'NATION_2.ttf' END AS font,
      CASE WHEN boxno % 2 = 0 THEN 'black' ELSE 'white' END AS fill FROM boxes JOIN good USING (book_id, page)""", ("boxes",))
def apply_styles(s):
    boxes, n = s.boxes, F.col("boxno")
    font = F.when(n % 3 == 0, '""').when(n % 3 == 1, '"[NATION_1.ttf]"').otherwise('"fonts/NATION_2.ttf"')
    row = F.concat(F.lit("["), n, F.lit(","), font, F.lit(","), F.when(n % 2 == 0, '" Black"').otherwise('"white"'), F.lit("]"))
    fonts = s.nation.select(F.concat("n_name", F.lit(".ttf")).alias("font"))
    return ans.apply_styles(boxes, answer_table(boxes, row,
                            F.lit('[#,"","white"]')), fonts, "plain.ttf")[0]


@query("answer_repair", """
    SELECT page_id, CASE page_id % 7 WHEN 5 THEN NULL ELSE cast(2 AS integer) END AS items FROM pages""")
def answer_repair(s):
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)", 1), r'["\\]', "")
    a = F.concat(F.lit('[0,"'), title, F.lit(' ,] end"]'))
    b = F.concat(F.lit('[1,"'), F.col("url"), F.lit('"]'))
    pair = F.concat(a, F.lit(","), b)
    k = F.col("page_id") % 7
    raw = (F.when(k == 0, F.concat(F.lit("["), pair, F.lit("]"))).when(k == 1, pair)
           .when(k == 2, F.concat(F.lit("```json\n["), pair, F.lit(", ]\n```")))
           .when(k == 3, F.concat(pair, F.lit("]"))).when(k == 4, F.concat(F.lit('{"rows":['), pair, F.lit("]}")))
           .when(k == 5, F.concat(a, F.lit(" trailing text"))).otherwise(F.concat(pair, F.lit(" ,"))))
    read = aj.read_rows(s.pages.select("page_id", raw.alias("raw")), ["page_id"])
    return read.select("page_id", F.when(F.col("items").isNotNull(), F.size("items")).alias("items"))


@query("open_and_other_records", """
    SELECT book_id, page, boxno, boxno % 3 = 0 AS open_lettering FROM boxes""", ("boxes",))
def open_and_other_records(s):
    boxes = s.boxes.withColumn("open_lettering", F.when(F.col("boxno") % 3 < 2, F.col("boxno") % 3 == 0)).select(*PAGE, "boxno", "open_lettering")
    parts = {True: ans.open_only(boxes), False: ans.non_open(boxes)}
    return parts[True].withColumn("open_lettering", F.lit(True)).unionByName(parts[False].withColumn("open_lettering", F.lit(False)))


@query("drop_untranslatable", """
    SELECT book_id, page, row_number() OVER (PARTITION BY book_id, page ORDER BY boxno) - 1 AS boxno, text FROM (SELECT book_id, page, boxno, CASE WHEN boxno % 3 = 0 THEN chr(12395) ELSE concat(text, chr(12395)) END AS text FROM boxes WHERE boxno % 3 < 2) x""", ("boxes",))
def drop_untranslatable(s):
    n = F.col("boxno")
    kana = F.lit("\u306b")
    rows = s.boxes.select(*PAGE, "boxno", F.when(n % 3 == 0, kana).when(n % 3 == 1, F.concat("text", kana)).otherwise(F.concat(n, F.lit(" !"))).alias("text"))
    return ans.drop_untranslatable(rows, "jp")


@query("default_erase", "SELECT book_id, page, boxno, true AS safe_to_erase, false AS open_lettering, 'disabled' AS reason FROM boxes", ("boxes",))
def default_erase(s):
    return ans.default_erase(s.boxes)


@query("needs_translation", """
    SELECT doc_id, cast(i AS integer) AS line, regexp_matches(parts[i], '\\p{L}') AND regexp_matches(parts[i], '[^\\p{Latin}\\P{L}]') AS foreign_text,
      FALSE AS korean_script
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) x""")
def needs_translation(s):
    lines = s.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line_text"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), tx.needs_translation(F.col("line_text"), "jp").alias("foreign_text"),
                        F.rlike("line_text", F.lit(tx.SOURCE_SCRIPTS["kr"])).alias("korean_script"))
