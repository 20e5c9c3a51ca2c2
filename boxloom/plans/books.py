"""Batches and context, chapters of series, jobs, logs, traces and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import text as tx
from boxloom.operators import batching, jobs, series
from boxloom.operators.ranking import split_row_number
from boxloom.plans.registry import query

PAGE = ("book_id", "page")

# batches ---------------------------------------------------------------------------------

REVIEW = """
    rv AS (SELECT book_id, page, boxno, boxno % 4 = 2 AS sfx, boxno % 3 = 0 AS open_lettering, concat(text, chr(9), 'x') AS text, concat('en ', repeat(text, cast(page % 40 AS integer))) AS english_text FROM boxes),
    ln AS (SELECT book_id, page, boxno, concat_ws(chr(9), page, boxno, CASE WHEN sfx THEN '1' ELSE '0' END, CASE WHEN open_lettering THEN '1' ELSE '0' END,
        trim(translate(text, concat(chr(9), chr(13), chr(10)), '   ')), trim(english_text)) AS line FROM rv),
    cost AS (SELECT book_id, page, count(*) AS records, cast(sum(length(line) + 1) + 51 AS bigint) AS chars FROM ln GROUP BY ALL)"""


def review_records(s):
    n = F.col("boxno")
    return s.boxes.select(*PAGE, "boxno", (n % 4 == 2).alias("sfx"), (n % 3 == 0).alias("open_lettering"), F.concat("text", F.lit("\tx")).alias("text"),
                          F.concat(F.lit("en "), F.repeat("text", (F.col("page") % 40).cast("int"))).alias("english_text"))


@query("review_lines", REVIEW + " SELECT * FROM ln", ("boxes",))
def review_lines(s):
    return batching.review_lines(review_records(s))


@query("request_tables", """
    SELECT book_id, page, concat('{"cols":["boxno","region","text","sfx"],"rows":[', string_agg(concat('[', boxno, ',[', l, ',', t, '],"', text, '",', CASE WHEN boxno % 2 = 0 THEN 1 ELSE 0 END, ']'), ',' ORDER BY boxno), ']}') AS request
    FROM boxes GROUP BY ALL""", ("boxes",))
def request_tables(s):
    rows = s.boxes.select(*PAGE, "boxno", F.array("l", "t").alias("region"), "text", (F.col("boxno") % 2 == 0).alias("sfx"))
    return batching.request_tables(rows, ["boxno", "region", "text", "sfx"])


BATCHES = REVIEW + """,
    pc AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page) - 1 AS i FROM cost),
    walk AS (SELECT book_id, page, i, records AS n, chars AS c, cast(0 AS bigint) AS batch FROM pc WHERE i = 0
      UNION ALL SELECT p.book_id, p.page, p.i, CASE WHEN w.n + p.records > 80 OR w.c + p.chars > 16000 THEN p.records ELSE w.n + p.records END,
        CASE WHEN w.n + p.records > 80 OR w.c + p.chars > 16000 THEN p.chars ELSE w.c + p.chars END, CASE WHEN w.n + p.records > 80 OR w.c + p.chars > 16000 THEN w.batch + 1 ELSE w.batch END
      FROM walk w JOIN pc p ON p.book_id = w.book_id AND p.i = w.i + 1)"""


@query("budget_batches", BATCHES + " SELECT w.book_id, w.page, w.batch, p.records, p.chars FROM walk w JOIN pc p USING (book_id, page)", ("boxes",))
def budget_batches(s):
    return batching.budget_batches(batching.page_costs(review_records(s)))


@query("rolling_context", """
    rr AS (SELECT concat('b', conv_id % 4) AS book_id, cast(floor(conv_id / 6) AS bigint) AS batch, conv_id AS page, turn AS boxno, role FROM conversations),
    nn AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, boxno) - 1 AS at_ FROM rr),
    st AS (SELECT book_id, batch, min(at_) AS s FROM nn GROUP BY ALL)
    SELECT st.book_id, st.batch, nn.page, nn.boxno, nn.role, nn.at_ - greatest(st.s - 24, 0) AS place FROM st JOIN nn ON nn.book_id = st.book_id AND nn.at_ >= st.s - 24 AND nn.at_ < st.s""")
def rolling_context(s):
    c = F.col("conv_id")
    rows = s.conversations.select(F.concat(F.lit("b"), c % 4).alias("book_id"), F.floor(c / 6).alias("batch"), c.alias("page"), F.col("turn").alias("boxno"), "role")
    return batching.rolling_context(rows)


@query("prior_translations", """
    rq AS (SELECT book_id, max(page) AS for_page FROM boxes GROUP BY ALL UNION SELECT book_id, min(page) + 200 FROM boxes GROUP BY ALL)
    SELECT r.book_id, r.for_page, b.page, b.boxno, b.text AS english_text FROM rq r JOIN boxes b ON b.book_id = r.book_id AND b.page < r.for_page WHERE b.boxno % 2 = 0""", ("boxes",))
def prior_translations(s):
    boxes = s.boxes.withColumn("english_text", F.when(F.col("boxno") % 2 == 0, F.col("text")))
    asked = boxes.groupBy("book_id").agg(F.max("page").alias("a"), (F.min("page") + 200).alias("z")).select("book_id", F.explode(F.array("a", "z")).alias("page"))
    return batching.prior_translations(boxes, asked)


TRANSLATED = "tr AS (SELECT book_id, page, boxno, text, row_number() OVER (PARTITION BY book_id ORDER BY page, boxno) - 1 AS place FROM boxes WHERE boxno % 2 = 0)"


def _prior_index(s):
    return batching.prior_index(s.boxes.withColumn("english_text", F.when(F.col("boxno") % 2 == 0, F.col("text"))), s.boxes.where("page % 3 > 0").select(*PAGE))


@query("prior_positions", TRANSLATED + """,
    rq AS (SELECT DISTINCT book_id, page FROM boxes WHERE page % 3 > 0)
    SELECT r.book_id, r.page AS for_page, coalesce(max(t.place) + 1, 0) AS until FROM rq r LEFT JOIN (SELECT book_id, page, max(place) AS place FROM tr GROUP BY ALL) t ON t.book_id = r.book_id AND t.page < r.page GROUP BY ALL""", ("boxes",))
def prior_positions(s):
    """For two thirds of all pages of all books, how many translated records stand before it."""
    return _prior_index(s)[1]


@query("prior_records", TRANSLATED + " SELECT book_id, place, page, boxno, text AS english_text FROM tr", ("boxes",))
def prior_records(s):
    return _prior_index(s)[0]


@query("notes_for_page", """
    SELECT book_id, page, concat_ws(concat(chr(10), chr(10)), CASE WHEN book_id <> 'b3' THEN concat('Job translation notes:', chr(10), 'about ', book_id) END,
      CASE WHEN page % 3 = 0 THEN concat('Page ', page, ' translation notes:', chr(10), 'note ', page) END) AS notes FROM (SELECT DISTINCT book_id, page FROM boxes) x""", ("boxes",))
def notes_for_page(s):
    pages = s.boxes.select(*PAGE).distinct()
    book = pages.select("book_id").distinct().select("book_id", F.lit(None).cast("bigint").alias("page"),
                                                     F.when(F.col("book_id") != "b3", F.concat(F.lit(" about "), "book_id")).otherwise("  ").alias("note"))
    own = pages.where("page % 3 < 2").select(*PAGE, F.when(F.col("page") % 3 == 0, F.concat(F.lit("note "), "page")).otherwise("　").alias("note"))
    return batching.notes_for_page(pages, book.unionByName(own))


# series ----------------------------------------------------------------------------------

KEYED = """
    ck AS (SELECT *, coalesce(try_cast(nullif(volume, '') AS decimal(38,18)), -1) AS v, cast(chapter AS decimal(38,18)) AS c,
      concat(CASE WHEN volume <> '' THEN concat('Vol. ', volume, ' ') ELSE '' END, 'Ch. ', chapter) AS label FROM chapters),
    cov AS (SELECT series, arg_max(v, (v, c)) AS v, arg_max(c, (v, c)) AS c FROM ck WHERE seq <= 4 GROUP BY ALL)"""


GATE = """,
    pv AS (SELECT *, lag(v) OVER w AS pv, lag(c) OVER w AS pc, lag(label) OVER w AS plabel FROM ck WINDOW w AS (PARTITION BY series ORDER BY v, c)),
    op AS (SELECT series, arg_min(v, (v, c)) AS ov, arg_min(c, (v, c)) AS oc, arg_min(label, (v, c)) AS olabel, arg_min(status, (v, c)) AS ostate FROM ck WHERE status <> 'complete' GROUP BY ALL),
    g AS (SELECT p.series, p.job_id, CASE WHEN ov IS NOT NULL AND (ov < p.v OR (ov = p.v AND oc < p.c)) THEN concat('Waiting for ', olabel, ' (', ostate, ').')
        WHEN has_context THEN '' WHEN cov.v IS NOT NULL AND (cov.v > p.v OR (cov.v = p.v AND cov.c >= p.c)) THEN 'Series notes include this chapter or a later chapter. Publish earlier chapter notes first.'
        WHEN pc IS NOT NULL AND (cov.v IS NULL OR cov.v < pv OR (cov.v = pv AND cov.c < pc)) THEN concat('Waiting for series notes from ', plabel, '.') ELSE '' END AS reason
      FROM pv p LEFT JOIN op USING (series) LEFT JOIN cov USING (series))"""


def gate_tables(s):
    chapters = s.chapters.withColumn("skip_gate", F.lit(False))
    return chapters, series.coverage_boundary(chapters.withColumn("covered", F.col("seq") <= 4))


@query("series_gate", KEYED + GATE + " SELECT series, job_id, reason, reason = '' AS ready FROM g", ("chapters",))
def series_gate(s):
    return series.series_gate(*gate_tables(s))


@query("coverage_boundary", KEYED + " SELECT series, arg_max(volume, (v, c)) AS volume, arg_max(chapter, (v, c)) AS chapter FROM ck WHERE seq <= 4 GROUP BY ALL", ("chapters",))
def coverage_boundary(s):
    return series.coverage_boundary(s.chapters.withColumn("covered", F.col("seq") <= 4))


@query("chapter_conflicts", """
    z AS (SELECT series, job_id, volume, cast(1 + seq % 5 AS varchar) AS chapter FROM chapters)
    SELECT series, job_id, volume, chapter FROM z WHERE (series, volume, chapter) IN (SELECT (series, volume, chapter) FROM (SELECT series, volume, chapter FROM z GROUP BY ALL HAVING count(*) > 1) y)""", ("chapters",))
def chapter_conflicts(s):
    return series.chapter_conflicts(s.chapters.withColumn("chapter", F.concat((1 + F.col("seq") % 5).cast("string"), F.when(F.col("seq") % 2 == 0, ".0").otherwise("")))).withColumn(
        "chapter", F.regexp_replace("chapter", r"\.0$", ""))


@query("notes_rollforward", KEYED + """,
    ch AS (SELECT *, min(CASE WHEN status <> 'complete' OR note = '' THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY v, c ROWS UNBOUNDED PRECEDING) AS ok FROM ck)
    SELECT series, job_id, volume, chapter, last_value(CASE WHEN note NOT LIKE 'No reusable%' THEN note END IGNORE NULLS) OVER (PARTITION BY series ORDER BY v, c ROWS UNBOUNDED PRECEDING) AS notes FROM ch WHERE ok = 1""", ("chapters",))
def notes_rollforward(s):
    return series.notes_rollforward(s.chapters)


@query("context_asof", KEYED + """
    SELECT series, job_id, concat_ws(concat(chr(10), chr(10)), CASE WHEN seq > 0 THEN concat('Fixed series instructions (take priority over other notes):', chr(10), 'rules ', series) END,
      CASE WHEN last_value(nullif(note, '') IGNORE NULLS) OVER w IS NOT NULL THEN concat('Series notes from earlier chapters:', chr(10), last_value(nullif(note, '') IGNORE NULLS) OVER w) END,
      CASE WHEN seq % 2 = 0 THEN concat('Chapter instructions:', chr(10), 'own ', seq) END) AS context
    FROM ck WINDOW w AS (PARTITION BY series ORDER BY v, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ("chapters",))
def context_asof(s):
    chapters = s.chapters.withColumn("published", F.nullif("note", F.lit(""))).withColumn("job_notes", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("own "), "seq")))
    rules = chapters.select("series").distinct().withColumn("instructions", F.concat(F.lit("rules "), "series"))
    return series.context_asof(chapters, rules)


GROUPED = KEYED + """,
    gd AS (SELECT *, CASE WHEN volume <> '' THEN concat('volume:', volume) ELSE concat('chapter:', job_id) END AS group_key FROM ck WHERE status = 'complete')"""


@query("collection_pages", GROUPED + """
    SELECT series, group_key, job_id, p AS page, row_number() OVER (PARTITION BY series, group_key ORDER BY v, c, job_id, p) - 1 AS out_page
    FROM gd, LATERAL (SELECT unnest(range(0, page_count)) AS p) x""", ("chapters",))
def collection_pages(s):
    return series.collection_pages(s.chapters)


@query("collection_info", GROUPED + """
    SELECT series, group_key, cast(sum(page_count) AS bigint) AS page_count, count(*) AS chapters, max(volume) AS volume, CASE WHEN max(volume) <> '' THEN '' ELSE max(chapter) END AS number FROM gd GROUP BY ALL""", ("chapters",))
def collection_info(s):
    return series.collection_info(s.chapters)


NATURAL = "[{{'t': regexp_extract(x, '^[^0-9]*'), 's': CASE WHEN regexp_extract(x, '[0-9]+$') = '' THEN -1 ELSE length(ltrim(regexp_extract(x, '[0-9]+$'), '0')) END, 'n': ltrim(regexp_extract(x, '[0-9]+$'), '0')}} FOR x IN regexp_extract_all(lower({}), '[^0-9]+[0-9]*|[0-9]+')]"


@query("batch_numbering", f"""
    f AS (SELECT concat('u', cast(floor(page_id / 50) AS bigint)) AS upload, regexp_replace(url, '^https?://[^/]*/', '') AS name, page_id AS pos FROM pages)
    SELECT upload, name, regexp_replace(regexp_replace(cast(cast(2.5 AS decimal(20,1)) + row_number() OVER (PARTITION BY upload ORDER BY {NATURAL.format('name')}, pos) - 1 AS varchar), '0+$', ''), '[.]$', '') AS chapter FROM f""")
def batch_numbering(s):
    files = s.pages.select(F.concat(F.lit("u"), F.floor(F.col("page_id") / 50)).alias("upload"), F.regexp_replace("url", "^https?://[^/]*/", "").alias("name"), F.col("page_id").alias("pos"))
    return series.batch_numbering(files, "2.5")[0]


@query("page_index", f"""
    m AS (SELECT concat('b', page_id % 3) AS book_id, concat(regexp_replace(url, '^https?://[^/]*/', ''), CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.PNG' END) AS name FROM pages),
    n AS (SELECT book_id, name, row_number() OVER (PARTITION BY book_id ORDER BY {NATURAL.format('name')}, name) - 1 AS page FROM m WHERE name LIKE '%.PNG' AND regexp_extract(name, '[^/]*$') NOT LIKE '.%')
    SELECT book_id, page, name, concat('page_', lpad(cast(page AS varchar), 4, '0')) AS page_name FROM n""")
def page_index(s):
    name = F.concat(F.regexp_replace("url", "^https?://[^/]*/", ""), F.when(F.col("page_id") % 7 == 0, ".txt").otherwise(".PNG"))
    return series.page_index(s.pages.select(F.concat(F.lit("b"), F.col("page_id") % 3).alias("book_id"), name.alias("name")))


@query("stale_exports", """
    SELECT series, bool_or(seq % 17 = 3 OR seq % 19 = 5) AS stale FROM chapters WHERE status = 'complete' GROUP BY ALL HAVING bool_or(seq % 19 <> 5)""", ("chapters",))
def stale_exports(s):
    done = s.chapters.where("status = 'complete'").select("series", "job_id", "volume", "chapter", "page_count", "seq")
    stored = done.where("seq % 19 <> 5").withColumn("page_count", F.when(F.col("seq") % 17 == 3, F.col("page_count") + 1).otherwise(F.col("page_count")))
    return series.stale_exports(stored, done, ["volume", "chapter", "page_count"])


@query("merged_elements", """
    e AS (SELECT doc_id, 'Title' AS tag, source AS value, 1 AS priority FROM documents UNION ALL SELECT doc_id, 'Title', concat('common ', lang), 2 FROM documents WHERE lang = 'en'
      UNION ALL SELECT doc_id, 'Series', lang, 3 FROM documents UNION ALL SELECT doc_id, 'Writer', source, 1 FROM documents)
    SELECT doc_id, tag, arg_max(value, priority) AS value FROM e GROUP BY ALL""")
def merged_elements(s):
    d = s.documents
    rows = (d.select("doc_id", F.lit("Title").alias("tag"), F.col("source").alias("value"), F.lit(1).alias("priority"))
            .unionByName(d.where("lang = 'en'").select("doc_id", F.lit("Title").alias("tag"), F.concat(F.lit("common "), "lang").alias("value"), F.lit(2).alias("priority")))
            .unionByName(d.select("doc_id", F.lit("Series").alias("tag"), F.col("lang").alias("value"), F.lit(3).alias("priority")))
            .unionByName(d.select("doc_id", F.lit("Writer").alias("tag"), F.col("source").alias("value"), F.lit(1).alias("priority")))
            .unionByName(d.select("doc_id", F.lit("Pages").alias("tag"), F.lit("x").alias("value"), F.lit(9).alias("priority"))))
    return series.merged_elements(rows, ["doc_id"])


@query("chapter_numbers", """
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN cast(o_orderkey AS varchar) WHEN 1 THEN concat(o_orderkey, '.5') WHEN 2 THEN NULL WHEN 3 THEN '1.5' WHEN 4 THEN NULL ELSE cast(o_orderkey % 10 * 100 AS varchar) END AS chapter FROM orders""")
def chapter_numbers(s):
    k = F.col("o_orderkey")
    raw = (F.when(k % 6 == 0, F.concat(F.lit(" 0"), k, F.lit(".00"))).when(k % 6 == 1, F.concat(k, F.lit(".50"))).when(k % 6 == 2, F.concat(F.lit("-1"), k))
           .when(k % 6 == 3, "01.50").when(k % 6 == 4, "NaN").otherwise(F.concat(k % 10, F.lit("e2"))))
    return s.orders.select("o_orderkey", tx.chapter_number(raw).alias("chapter"))


# pages and plans -------------------------------------------------------------------------

@query("page_range", "SELECT DISTINCT book_id, page FROM boxes WHERE page BETWEEN 100 AND 900 AND page < 800 AND page <> 500", ("boxes",))
def page_range(s):
    return jobs.pages_except(jobs.pages_before(jobs.page_range(s.boxes.select(*PAGE).distinct(), 100, 900), 800), 500)


@query("page_selection", """
    SELECT DISTINCT o_orderkey AS request_id, unnest(list_concat(range(o_custkey % 50, o_custkey % 50 + 1 + o_orderkey % 4), [o_orderkey % 30])) AS page FROM orders WHERE o_orderkey % 5 < 2""")
def page_selection(s):
    return jobs.page_selection(_selections(s))[0]


def _selections(s):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    text = (F.when(k % 5 < 2, F.concat(c.cast("string"), F.lit(" - "), (c + k % 4).cast("string"), F.lit(",, "), (k % 30).cast("string")))
            .when(k % 5 == 2, "9-3").when(k % 5 == 3, "x,1").otherwise(F.when(k % 2 == 0, " , ").otherwise("0-10000")))
    return s.orders.select(k.alias("request_id"), text.alias("selection"))


@query("page_selection_errors", """
    SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 2 THEN 'descending' WHEN 3 THEN 'bad_page' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'empty' ELSE 'too_many' END END AS code FROM orders WHERE o_orderkey % 5 > 1""")
def page_selection_errors(s):
    return jobs.page_selection(_selections(s))[1]


MADE = """
    pg AS (SELECT DISTINCT book_id, page FROM boxes)"""


@query("missing_artifacts", MADE + """
    SELECT book_id, page, 'ocr_raw' AS artifact FROM pg WHERE page % 7 = 0 OR book_id = 'b3' UNION ALL SELECT book_id, page, 'placements' FROM pg WHERE page % 5 = 0""", ("boxes",))
def missing_artifacts(s):
    pages = s.boxes.select(*PAGE).distinct()
    made = pages.where("page % 7 <> 0 AND book_id <> 'b3'").withColumn("artifact", F.lit("ocr_raw")).unionByName(pages.where("page % 5 <> 0").withColumn("artifact", F.lit("placements")))
    return jobs.missing_artifacts(pages, made, ("ocr_raw", "placements"))


@query("resume_page", MADE + """,
    rq AS (SELECT book_id, page AS asked FROM pg)
    SELECT book_id, asked, coalesce((SELECT min(page) FROM pg WHERE pg.book_id = rq.book_id AND pg.page < rq.asked AND (page * 7) % 101 = 3), asked) AS page FROM rq""", ("boxes",))
def resume_page(s):
    pages = s.boxes.select(*PAGE).distinct()
    return jobs.resume_page(pages, pages, pages.where("(page * 7) % 101 <> 3"))


@query("pages_to_finish", MADE + " SELECT book_id, page FROM pg WHERE page % 6 = 0 OR page % 4 = 1", ("boxes",))
def pages_to_finish(s):
    pages = s.boxes.select(*PAGE).distinct()
    return jobs.pages_to_finish(pages, pages.where("page % 6 = 0"), pages.where("page % 4 <> 1"))


def _reruns(s):
    k = F.col("o_orderkey")
    book = F.concat(F.lit("b"), k)
    chosen = F.when(k % 3 == 0, F.array().cast("array<bigint>")).when(k % 3 == 1, F.array(F.lit(2), F.lit(0), F.lit(2)).cast("array<bigint>")).otherwise(
        F.array(F.lit(1), k % 9 + 3).cast("array<bigint>"))
    requests = s.orders.select(book.alias("book_id"), chosen.alias("pages"))
    counts = s.orders.select(book.alias("book_id"), (k % 6).alias("page_count"))
    per_page = s.orders.where(k % 4 == 0).select(book.alias("book_id"), F.lit(0).cast("bigint").alias("page"), F.when(k % 8 == 0, "ocr_merge").otherwise("odd").alias("stage"))
    return jobs.rerun_plan(requests, counts, "translations", per_page)


RERUNS = """
    rq AS (SELECT o_orderkey AS k, concat('b', o_orderkey) AS book_id, o_orderkey % 6 AS n, unnest(CASE o_orderkey % 3 WHEN 0 THEN range(0, o_orderkey % 6) WHEN 1 THEN [2, 0] ELSE [1, o_orderkey % 9 + 3] END) AS page FROM orders),
    ok AS (SELECT * FROM rq WHERE n > 0 AND k NOT IN (SELECT k FROM rq WHERE page >= n)),
    odd AS (SELECT DISTINCT k FROM ok WHERE k % 4 = 0 AND k % 8 <> 0 AND page = 0)"""


@query("rerun_plan", RERUNS + """
    SELECT book_id, page, CASE WHEN k % 8 = 0 AND page = 0 THEN 'ocr_structured' ELSE 'translations' END AS phase FROM ok WHERE k NOT IN (SELECT k FROM odd)""")
def rerun_plan(s):
    return _reruns(s)[0]


@query("rerun_plan_errors", RERUNS + """
    SELECT concat('b', o_orderkey) AS book_id, 'no_pages' AS code, cast(NULL AS bigint) AS page FROM orders WHERE o_orderkey % 6 = 0
    UNION ALL SELECT book_id, 'outside', min(page) FROM rq WHERE n > 0 AND page >= n GROUP BY book_id UNION ALL SELECT concat('b', k), 'bad_stage', 0 FROM odd""")
def rerun_plan_errors(s):
    return _reruns(s)[1]


# archives --------------------------------------------------------------------------------

MEMBERS = """
    mb AS (SELECT concat('a', page_id % 20) AS book_id, CASE page_id % 10 WHEN 0 THEN concat('/abs/', page_id) WHEN 1 THEN concat('x/../', page_id, '.png') WHEN 2 THEN concat('__MACOSX/', page_id, '.jpg') WHEN 3 THEN concat('d', page_id, '/')
        WHEN 4 THEN concat('meta/', page_id, '.xml') ELSE concat('p/', page_id, '.JPG') END AS name, cast(length(html) AS bigint) * 10000 AS size, page_id % 10 = 3 AS is_dir FROM pages)"""


def members(s):
    k = F.col("page_id")
    name = (F.when(k % 10 == 0, F.concat(F.lit("/abs/"), k)).when(k % 10 == 1, F.concat(F.lit("x\\..\\"), k, F.lit(".png"))).when(k % 10 == 2, F.concat(F.lit("__MACOSX/"), k, F.lit(".jpg")))
            .when(k % 10 == 3, F.concat(F.lit("d"), k, F.lit("/"))).when(k % 10 == 4, F.concat(F.lit("meta/"), k, F.lit(".xml"))).otherwise(F.concat(F.lit("p/"), k, F.lit(".JPG"))))
    return s.pages.select(F.concat(F.lit("a"), k % 20).alias("book_id"), name.alias("name"), (F.length("html").cast("bigint") * 10000).alias("size"), (k % 10 == 3).alias("is_dir"))


@query("archive_policy", MEMBERS + """,
    t AS (SELECT book_id, count(*) AS n, sum(CASE WHEN NOT is_dir THEN size END) AS total, count(*) FILTER (name LIKE 'p/%' OR name LIKE 'x/%') AS images, sum(CASE WHEN name LIKE 'meta/%' OR name LIKE '/abs/%' THEN size END) AS kept FROM mb GROUP BY ALL)
    SELECT book_id, 'unsafe_name' AS code, replace(name, 'x/../', 'x' || chr(92) || '..' || chr(92)) AS name FROM mb WHERE name LIKE '/abs/%' OR name LIKE 'x/%'
    UNION ALL SELECT book_id, 'member_too_large', name FROM mb WHERE NOT is_dir AND size > 30000000 AND name NOT LIKE '/abs/%' AND name NOT LIKE 'x/%'
    UNION ALL SELECT book_id, 'preserved_too_large', name FROM mb WHERE name LIKE 'meta/%' AND size > 20000000
    UNION ALL SELECT book_id, 'too_many_members', NULL FROM t WHERE n > 12 UNION ALL SELECT book_id, 'total_too_large', NULL FROM t WHERE total > 200000000
    UNION ALL SELECT book_id, 'too_many_images', NULL FROM t WHERE images > 11 UNION ALL SELECT book_id, 'preserved_total_too_large', NULL FROM t WHERE kept > 150000000""")
def archive_policy(s):
    return jobs.archive_policy(members(s), jobs.ArchiveLimits(12, 11, 30_000_000, 200_000_000, 20_000_000, 150_000_000))


@query("classify_members", MEMBERS + """
    SELECT book_id, replace(name, 'x/../', 'x' || chr(92) || '..' || chr(92)) AS name, CASE WHEN is_dir THEN 'directory' WHEN name LIKE '__MACOSX/%' THEN 'ignored' WHEN name LIKE 'meta/%' OR name LIKE '/abs/%' THEN 'preserved' ELSE 'image' END AS kind FROM mb""")
def classify_members(s):
    return jobs.classify_members(members(s)).select("book_id", "name", "kind")


@query("pixel_policy", """
    z AS (SELECT concat('b', o_custkey % 30) AS book_id, o_orderkey AS page, 1000 + o_orderkey % 9000 AS width, 2000 + o_custkey AS height FROM orders)
    SELECT book_id, page, 'page_too_large' AS code FROM z WHERE width * height > 15000000 UNION ALL SELECT book_id, NULL, 'book_too_large' FROM z GROUP BY book_id HAVING sum(width * height) > 400000000""")
def pixel_policy(s):
    k = F.col("o_orderkey")
    rows = s.orders.select(F.concat(F.lit("b"), F.col("o_custkey") % 30).alias("book_id"), k.alias("page"), (1000 + k % 9000).alias("width"), (2000 + F.col("o_custkey")).alias("height"))
    return jobs.pixel_policy(rows, 15_000_000, 400_000_000)


@query("changed_inputs", """
    SELECT concat('d', doc_id) AS book_id, CASE WHEN doc_id % 5 = 0 THEN 'adopted' WHEN doc_id % 5 = 1 THEN 'changed' WHEN doc_id % 5 = 2 THEN 'page_count' ELSE 'same' END AS state FROM documents""")
def changed_inputs(s):
    k = F.col("doc_id")
    now = s.documents.select(F.concat(F.lit("d"), k).alias("book_id"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("size"), (k % 30).alias("page_count"), k)
    old = now.where(k % 5 != 0).withColumn("sha256", F.when(k % 5 == 1, "other").otherwise(F.col("sha256"))).withColumn("page_count", F.when(k % 5 == 2, -1).otherwise(F.col("page_count")))
    return jobs.changed_inputs(old, now)


# jobs ------------------------------------------------------------------------------------

@query("job_flags", """
    z AS (SELECT job_id, coalesce(nullif(status, ''), 'unknown') AS st, n % 4 = 0 AS active, n % 7 <> 0 AS has_input, n % 3 = 0 AS review, n % 5 AS orig, n % 2 AS fin FROM jobs)
    SELECT job_id, (st IN ('failed', 'cancelled') OR (st = 'paused' AND NOT active)) AND has_input AS can_restart, st IN ('running', 'paused', 'terminating') AND active AS can_terminate,
      st IN ('complete', 'failed', 'cancelled') AND NOT active AS can_delete, st NOT IN ('queued', 'running') AND NOT active AS can_rename, st = 'complete' AS can_rerun,
      st = 'complete' OR (st = 'paused' AND review AND NOT active) AS can_edit, st = 'complete' AND fin > 0 AS can_view, orig > 0 AS can_view_original,
      NOT active AND st IN ('queued', 'failed', 'cancelled', 'paused', 'complete') AS can_change_options FROM z""", ("jobs",))
def job_flags(s):
    n = F.col("n")
    return jobs.job_flags(s.jobs.select("job_id", F.nullif("status", F.lit("")).alias("status"), (n % 4 == 0).alias("active"), (n % 7 != 0).alias("has_input"), (n % 3 == 0).alias("review_checkpoint"),
                                        (n % 5).alias("original_pages"), (n % 2).alias("final_pages")))


@query("job_summary", "SELECT category, job_id, status, created FROM jobs WHERE category = 'c7' AND status = 'complete'", ("jobs",))
def job_summary(s):
    return jobs.job_summary(s.jobs, ["category", "job_id", "status", "created"], category="c7", status="complete").withColumn("created", F.col("created").cast("timestamp_ntz"))


@query("status_counts", "SELECT category, coalesce(nullif(status, ''), 'unknown') AS status, count(*) AS n FROM jobs GROUP BY ALL", ("jobs",))
def status_counts(s):
    return jobs.status_counts(s.jobs)


@query("newest_first", "SELECT job_id, row_number() OVER (PARTITION BY category ORDER BY created DESC, job_id) AS place FROM jobs", ("jobs",))
def newest_first(s):
    return jobs.newest_first(s.jobs).select("job_id", "place")


@query("last_chapters_first", """
    SELECT series, job_id, row_number() OVER (PARTITION BY series ORDER BY CASE WHEN volume = '' THEN -1 ELSE cast(volume AS integer) END DESC, seq / 2.0 DESC, job_id) AS place FROM chapters""", ("chapters",))
def last_chapters_first(s):
    return jobs.last_chapters_first(s.chapters.withColumn("chapter", (F.col("seq") / 2).cast("string")))


@query("title_choice", """
    z AS (SELECT job_id, CASE WHEN n % 9 = 0 THEN NULL ELSE concat('t', n) END AS src, CASE WHEN n % 2 = 0 THEN concat('e', n) END AS tr, n % 3 = 0 AS tm, n % 4 < 2 AS alt FROM jobs)
    SELECT job_id, CASE WHEN src IS NOT NULL THEN CASE WHEN tm AND tr IS NOT NULL THEN tr ELSE src END END AS title, CASE WHEN src IS NOT NULL AND alt THEN CASE WHEN tm THEN src ELSE tr END END AS alternate FROM z""", ("jobs",))
def title_choice(s):
    n = F.col("n")
    return jobs.title_choice(s.jobs.select("job_id", F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit(" t"), n)).alias("source_title"), F.when(n % 2 == 0, F.concat(F.lit("e"), n)).alias("translated_title"),
                                           F.when(n % 3 == 0, "translated").otherwise("odd").alias("mode"), (n % 4 < 2).alias("alt_in_notes")))


@query("apply_settings", """
    SELECT job_id, CASE WHEN status = 'queued' THEN CASE WHEN cast(substr(category, 2) AS integer) % 2 = 0 THEN 'm2' ELSE 'base' END ELSE 'own' END AS model FROM jobs""", ("jobs",))
def apply_settings(s):
    rows = s.jobs.withColumn("model", F.lit("own"))
    settings = rows.select("category").distinct().where(F.substring("category", 2, 9).cast("int") % 4 != 1).withColumn(
        "model", F.when(F.substring("category", 2, 9).cast("int") % 2 == 0, "m2"))
    return jobs.apply_settings(rows, settings, ["model"], {"model": "base"}).select("job_id", "model")


@query("trace_rollup", """
    t AS (SELECT event_type AS phase, concat('m', user_id % 3) AS model, event_id % 11 = 0 AS failed, CASE WHEN event_id % 4 = 0 THEN cast(event_id % 100 AS bigint) END AS ct, event_id % 50 AS gt, cast(floor(value * 100) AS bigint) AS ms FROM events)
    SELECT phase, model, count(*) AS attempts, count(*) FILTER (failed) AS failures, cast(sum(coalesce(ct, gt)) AS bigint) AS tokens, cast(sum(ms) AS bigint) AS elapsed_ms,
      cast(sum(coalesce(ct, gt)) AS bigint) / greatest(cast(sum(ms) AS bigint) / cast(1000 AS double), cast(0.001 AS double)) AS tokens_per_second FROM t GROUP BY ALL""")
def trace_rollup(s):
    e = F.col("event_id")
    return jobs.trace_rollup(s.events.select(F.col("event_type").alias("phase"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), (e % 11 == 0).alias("failed"),
                                             F.when(e % 4 == 0, e % 100).alias("completion_tokens"), (e % 50).alias("generated_tokens"), F.floor(F.col("value") * 100).alias("elapsed_ms")))


@query("runtime_summary", """
    SELECT c.book_id, CASE WHEN c.k % 4 = 0 THEN cast(0.001 AS double) ELSE cast(c.k AS double) END AS elapsed, coalesce(n, 0) AS pages, CASE WHEN n > 0 THEN (CASE WHEN c.k % 4 = 0 THEN cast(0.001 AS double) ELSE cast(c.k AS double) END) / n END AS per_page
    FROM (SELECT concat('b', c_custkey) AS book_id, c_custkey AS k FROM customer) c LEFT JOIN (SELECT concat('b', o_custkey) AS book_id, count(*) AS n FROM orders GROUP BY ALL) o USING (book_id)""")
def runtime_summary(s):
    k = F.col("c_custkey")
    runs = s.customer.select(F.concat(F.lit("b"), k).alias("book_id"), F.when(k % 4 == 0, 0.0).otherwise(k.cast("double")).alias("elapsed_seconds"))
    return jobs.runtime_summary(runs, s.orders.select(F.concat(F.lit("b"), F.col("o_custkey")).alias("book_id")))


RUNTIME = """
    ev AS (SELECT user_id, ts, event_id, event_type, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
      FROM events WHERE event_type IN ('view', 'click')),
    sp AS (SELECT user_id, island, min(CASE WHEN event_type = 'view' THEN ts END) AS a, max(CASE WHEN event_type = 'click' THEN ts END) AS z FROM ev GROUP BY ALL)"""


RUNTIME_RESULT = """
    SELECT concat('j', user_id) AS job_id, cast(sum(CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN greatest(0, epoch_us(z) - epoch_us(a)) ELSE 0 END) AS bigint) AS elapsed_micros, max(CASE WHEN z IS NULL THEN a END) AS running_since FROM sp GROUP BY ALL"""


def runtime_events(s):
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "stop").otherwise("other")
    return s.events.select(F.concat(F.lit("j"), F.col("user_id")).alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"))


@query("active_runtime", RUNTIME + RUNTIME_RESULT)
def active_runtime(s):
    return jobs.active_runtime(runtime_events(s)).withColumn("running_since", F.col("running_since").cast("timestamp_ntz"))


# logs ------------------------------------------------------------------------------------

@query("log_lines", """
    x AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]')) AS raw, unnest(range(0, len(regexp_split_to_array(text, '[\\r\\n]')))) AS seq FROM documents)
    SELECT concat('j', doc_id) AS job_id, cast(seq AS integer) AS seq, md5(trim(raw)) AS line FROM x WHERE trim(raw) <> ''""")
def log_lines(s):
    lines = jobs.log_lines(s.documents.select(F.concat(F.lit("j"), F.col("doc_id")).alias("job_id"), F.col("text").alias("body")))
    return lines.select("job_id", "seq", F.md5("line").alias("line"))


def made_log(s):
    """Progress lines derived from the events: one log per user."""
    e = F.col("event_id")
    line = (F.when(e % 9 == 0, F.concat(F.lit("OCR page "), e % 40)).when(e % 9 == 1, F.concat(F.lit("Skip VLM alt-placement page "), e % 40, F.lit(": disabled")))
            .when(e % 9 == 2, "VLM proofread translations batch 1/2").when(e % 9 == 3, F.concat(F.lit("Render page "), e % 40)).when(e % 9 == 4, F.concat(F.lit("Detect placement containers page "), e % 40))
            .when(e % 9 == 5, "VLM structure page x").otherwise(F.concat(F.lit("note OCR page "), e)))
    return s.events.select(F.concat(F.lit("j"), F.col("user_id")).alias("job_id"), e.alias("seq"), line.alias("line"))


LOG = """
    pl AS (SELECT concat('j', user_id) AS job_id, event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'OCR' WHEN 1 THEN 'Alt placement' WHEN 2 THEN 'Proofreading' WHEN 3 THEN 'Render' WHEN 4 THEN 'Placement expansion' END AS phase,
        CASE WHEN event_id % 9 IN (0, 1, 3, 4) THEN event_id % 40 END AS page, CASE event_id % 9 WHEN 0 THEN 'ocr_raw' WHEN 1 THEN 'alt_placement' WHEN 2 THEN 'proofreading' WHEN 3 THEN 'render' WHEN 4 THEN 'placements' END AS target,
        CASE WHEN event_id % 9 = 2 THEN 0 ELSE event_id % 40 END AS target_page FROM events WHERE event_id % 9 < 5)"""


@query("progress_lines", LOG + " SELECT job_id, seq, phase, page, target AS resume_from, target_page AS resume_page FROM pl")
def progress_lines(s):
    return jobs.progress(made_log(s)).select("job_id", "seq", "phase", "page", F.col("target.phase").alias("resume_from"), F.col("target.page").alias("resume_page"))


@query("latest_progress", LOG + """
    SELECT job_id, arg_max(phase, seq) AS phase, CASE WHEN arg_max(phase, seq) <> 'Proofreading' THEN arg_max(coalesce(page, -1), seq) END AS page, arg_max(target, seq) AS resume_from, arg_max(target_page, seq) AS resume_page
    FROM pl WHERE job_id NOT LIKE '%3' GROUP BY ALL""")
def latest_progress(s):
    log = made_log(s)
    return jobs.latest_progress(log, log.where(F.col("job_id").endswith("3")).select("job_id"))


@query("restart_target", LOG + """,
    z AS (SELECT job_id, arg_max(target, seq) AS t, arg_max(target_page, seq) AS p FROM pl GROUP BY ALL),
    u AS (SELECT DISTINCT user_id, concat('j', user_id) AS job_id FROM events)
    SELECT u.job_id, CASE u.user_id % 4 WHEN 0 THEN 'translations' WHEN 1 THEN 'placements' WHEN 2 THEN 'translation_notes' ELSE z.t END AS resume_from, CASE u.user_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE z.p END AS resume_page
    FROM u LEFT JOIN z USING (job_id)""")
def restart_target(s):
    k = F.col("user_id") % 4
    rows = s.events.select("user_id").distinct().select(
        F.concat(F.lit("j"), F.col("user_id")).alias("job_id"), F.when(k == 0, "translations").otherwise("odd").alias("last_resume_from"), F.lit(7).alias("last_resume_page"),
        F.when(k == 1, "Placement style").alias("last_phase"), F.lit(3).alias("last_page"), F.when(k == 2, "Translation notes").alias("phase"), F.lit(None).cast("bigint").alias("page"))
    return jobs.restart_target(rows, made_log(s))


@query("last_lines", """
    SELECT job_id, seq FROM (SELECT concat('j', user_id) AS job_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) x WHERE k <= 20""")
def last_lines(s):
    return jobs.last_lines(made_log(s), 20).select("job_id", "seq")


LIMITER = """
    a AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'signup' AS ok, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events WHERE event_type IN ('error', 'signup')),
    w AS (SELECT user_id, event_id, us, count(CASE WHEN NOT ok THEN 1 END) OVER z AS failures, min(CASE WHEN NOT ok THEN us END) OVER z AS oldest FROM a
      WINDOW z AS (PARTITION BY user_id, isl ORDER BY us RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW))
    SELECT user_id AS client, event_id AS seq, failures, CASE WHEN failures >= 3 THEN greatest(1, cast(round_even(259200.0 - (us - oldest) / 1e6, 0) AS bigint)) ELSE 0 END AS retry_after FROM w"""


def attempts(s):
    return s.events.where(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("ok"))


@query("failure_limiter", LIMITER)
def failure_limiter(s):
    return jobs.failure_limiter(attempts(s), limit=3, window_seconds=259_200)


TOKENS = """
    SELECT user_id AS call, count(*) FILTER (event_type IN ('view', 'error')) AS reasoning_chunks, count(*) FILTER (event_type = 'click') AS answer_chunks,
      coalesce(arg_max(CASE WHEN event_id % 97 = 0 THEN event_id END, CASE WHEN event_id % 97 = 0 THEN event_id END), count(*) FILTER (event_type IN ('view', 'error', 'click'))) AS tokens FROM events GROUP BY ALL"""


def token_chunks(s):
    kind = F.when(F.col("event_type").isin("view", "error"), "reasoning").when(F.col("event_type") == "click", "answer").otherwise("none")
    e = F.col("event_id")
    return s.events.select(F.col("user_id").alias("call"), e.alias("seq"), kind.alias("kind"), F.when(e % 97 == 0, e).alias("usage"))


@query("token_meter", TOKENS)
def token_meter(s):
    return jobs.token_meter(token_chunks(s))


# text functions --------------------------------------------------------------------------

@query("captions", r"""
    SELECT doc_id, md5(array_to_string([y FOR y IN [regexp_replace(trim(regexp_replace(x, '[ \t]+', ' ', 'g')), ' ([,.;:!?%~)\]}»”’…]+)', '\1', 'g') FOR x IN string_split(text, chr(10))] IF y <> ''], chr(10))) AS caption FROM documents""")
def captions(s):
    return s.documents.select("doc_id", F.md5(tx.caption(F.col("text"))).alias("caption"))


@query("squeezed_texts", r"""
    SELECT a.doc_id, length(regexp_replace(a.text, '\s', '', 'g')) AS n, contains(regexp_replace(a.text, '\s', '', 'g'), regexp_replace(b.text, '\s', '', 'g')) OR contains(regexp_replace(b.text, '\s', '', 'g'), regexp_replace(a.text, '\s', '', 'g')) AS agrees
    FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def squeezed_texts(s):
    d = s.documents.select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(after, "doc_id").select("doc_id", F.length(tx.squeeze(F.col("text"))).cast("bigint").alias("n"), tx.texts_agree(F.col("text"), F.col("other")).alias("agrees"))


@query("titles_and_names", r"""
    t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, url FROM pages)
    SELECT page_id, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS title, CASE WHEN url LIKE '%/' THEN '.cbz' ELSE regexp_replace(url, '^.*/', '') END AS job_name FROM t""")
def titles_and_names(s):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    quoted = F.concat(F.lit(' "'), title, F.lit('"\n'))
    return s.pages.select("page_id", tx.clean_title(quoted).alias("title"), tx.default_job_name(F.concat(F.col("url"), F.lit(".cbz")), F.lit("j")).alias("job_name"))


# addresses repeated until many pass the longest names
@query("safe_names", r"""
    n AS (SELECT page_id, repeat(concat(url, '/'), cast(1 + page_id % 9 AS integer)) AS url FROM pages)
    SELECT page_id, rtrim(substr(trim(regexp_replace(regexp_replace(url, '[\\/\x00-\x1f\x7f]+', ' - ', 'g'), '\s+', ' ', 'g'), ' .'), 1, 256), ' .') AS job_name,
      substr(trim(regexp_replace(url, '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '. '), 1, 180) AS file_name FROM n""")
def safe_names(s):
    url = F.repeat(F.concat("url", F.lit("/")), (1 + F.col("page_id") % 9).cast("int"))
    return s.pages.select("page_id", tx.safe_job_name(url, F.lit("x")).alias("job_name"), tx.safe_file_name(url, F.lit("x")).alias("file_name"))


@query("languages", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'jp' WHEN 'fr' THEN 'kr' WHEN 'de' THEN 'cn' END AS code, CASE lang WHEN 'en' THEN true WHEN 'fr' THEN false WHEN 'de' THEN true END AS rtl FROM documents""")
def languages(s):
    name = F.when(F.col("lang") == "en", " Japanese").when(F.col("lang") == "fr", "KO").when(F.col("lang") == "de", "zh").otherwise("elvish")
    code = tx.source_language(name)
    return s.documents.select("doc_id", code.alias("code"), tx.reads_right_to_left(code).alias("rtl"))


@query("target_languages", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'en' END AS code FROM documents""")
def target_languages(s):
    name = F.when(F.col("lang") == "en", " English ").when(F.col("lang") == "fr", "elvish").when(F.col("lang") == "de", F.lit(None)).otherwise("?")
    return s.documents.select("doc_id", tx.target_language(name).alias("code"))


@query("job_times", """
    z AS (SELECT job_id, CASE WHEN n % 77 <> 0 THEN epoch(cast('2030-01-01 01:00:00' AS timestamp)) - epoch(cast(created AS timestamp)) END AS age,
        CASE WHEN n % 7 <> 0 OR n % 3 = 0 THEN CASE WHEN n % 7 = 0 THEN 0.0 ELSE n % 5000 + 0.5 END + CASE WHEN n % 3 = 0 THEN 3600 ELSE 0 END END AS el FROM jobs),
    y AS (SELECT *, cast(floor(el / 60) AS bigint) AS m, cast(floor(age / 60) AS bigint) AS am FROM z)
    SELECT job_id, cast(age AS double) AS age_seconds, cast(el AS double) AS elapsed_seconds,
      CASE WHEN age IS NULL THEN '' ELSE concat(am // 1440, 'd ', (am // 60) % 24, 'h') END AS age,
      CASE WHEN el IS NULL THEN '' WHEN el < 60 THEN printf('%.1fs', cast(el AS double)) WHEN m < 60 THEN concat(m, 'm ', cast(round_even(cast(el - m * 60 AS double), 0) AS bigint), 's') ELSE concat(m // 60, 'h ', m % 60, 'm') END AS elapsed FROM y""", ("jobs",))
def job_times(s):
    n, null, day = F.col("n"), F.lit(None).cast("string"), F.date_format("created", "yyyy-MM-dd")
    rows = s.jobs.select("job_id", F.when(n % 11 != 0, day).alias("created_at"), null.alias("updated_at"), F.when(n % 7 != 0, day).alias("started_at"), null.alias("finished_at"),
                         F.when(n % 3 == 0, "2030-01-01T01:00:00+01:00").alias("active_started_at"), F.when(n % 7 == 0, "-3").otherwise((n % 5000 + 0.5).cast("string")).alias("elapsed_seconds"))
    return jobs.job_times(rows, F.timestamp_micros(F.unix_micros(tx.iso_timestamp(F.lit("2030-01-01T01:00:00Z")))))


@query("lenient_values", """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS idx, CASE o_orderkey % 3 WHEN 0 THEN cast(o_orderkey % 200 AS double) / 100 WHEN 1 THEN cast(o_orderkey % 5 AS double) END AS ratio,
      CASE o_orderkey % 3 WHEN 0 THEN least(1.0, cast(o_orderkey % 200 AS double) / 100) WHEN 1 THEN least(1.0, cast(o_orderkey % 5 AS double)) END AS part FROM orders""")
def lenient_values(s):
    k = F.col("o_orderkey")
    flag = F.when(k % 4 == 0, " YES").when(k % 4 == 1, "0").when(k % 4 == 2, "maybe").otherwise("2")
    index = F.when(k % 3 == 0, F.concat(F.lit(" "), k)).when(k % 3 == 1, F.concat(F.lit("0"), k)).otherwise(F.concat(F.lit("-"), k))
    ratio = F.when(k % 3 == 0, F.concat((k % 200).cast("string"), F.lit("%"))).when(k % 3 == 1, (k % 5).cast("string")).otherwise(F.lit("nan"))
    return s.orders.select("o_orderkey", tx.lenient_bool(flag).alias("flag"), tx.lenient_index(index).alias("idx"), tx.expansion_ratio(ratio).alias("ratio"), tx.fraction(ratio).alias("part"))


@query("time_texts", """
    z AS (SELECT event_id, epoch_us(ts) AS us, cast(floor(value * 1000) AS bigint) AS n FROM events)
    SELECT event_id, CASE WHEN n < 60 THEN concat(n, '.0s') WHEN n < 3600 THEN concat(cast(floor(n / 60) AS bigint), 'm ', n % 60, 's') ELSE concat(cast(floor(n / 3600) AS bigint), 'h ', cast(floor(n / 60) AS bigint) % 60, 'm') END AS duration,
      CASE WHEN n < 60 THEN 'less than 1m' WHEN n < 3600 THEN concat(cast(floor(n / 60) AS bigint), 'm') WHEN n < 86400 THEN concat(cast(floor(n / 3600) AS bigint), 'h ', cast(floor(n / 60) AS bigint) % 60, 'm') ELSE concat(cast(floor(n / 86400) AS bigint), 'd ', cast(floor(n / 3600) AS bigint) % 24, 'h') END AS age,
      us AS parsed FROM z""")
def time_texts(s):
    n = F.floor(F.col("value") * 1000)
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return s.events.select("event_id", tx.duration_text(n).alias("duration"), tx.age_text(n).alias("age"), F.unix_micros(tx.iso_timestamp(iso)).alias("parsed"))


@query("size_texts", """
    SELECT doc_id, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size
    FROM (SELECT doc_id, n_chars * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END) AS n FROM documents) x""")
def size_texts(s):
    k = F.col("doc_id") % 3
    n = F.col("n_chars") * F.when(k == 0, 1).when(k == 1, 1024).otherwise(1048576)
    return s.documents.select("doc_id", tx.size_text(n).alias("size"))


@query("marked_notes", """
    SELECT doc_id, concat(source, chr(10), 'Alternate title: ', lang) AS notes FROM documents""")
def marked_notes(s):
    notes = F.concat("source", F.lit("\n  Alternate title: old"))
    return s.documents.select("doc_id", tx.replace_marked_line(notes, "Alternate title:", F.col("lang")).alias("notes"))
