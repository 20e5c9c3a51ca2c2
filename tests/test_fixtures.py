"""Literal cases of FIXTURES.md as small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from boxloom.functions import answer_json as aj
from boxloom.functions import text as tx
from boxloom.operators import answers, batching, detect, group, jobs, layout, merge, overlay, series

BOX = "book_id string, page bigint, boxno bigint, l bigint, t bigint, r bigint, b bigint, text string"


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_detector_result_gives_one_row(spark):
    rows = spark.createDataFrame([("b", 2, 100, 100, ["text"], [0.95], [[[10.0, 20.0], [30.0, 20.0], [30.0, 40.0], [10.0, 40.0]]], [[10.0, 20.0, 30.0, 40.0]])],
                                 "book_id string, page bigint, width int, height int, rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>, rec_boxes array<array<double>>")
    assert values(detect.normalize_detections(rows, 0.5), "page", "boxno", "l", "t", "r", "b", "text") == [(2, 0, 10, 20, 30, 40, "text")]


def test_group_text_follows_the_reading_direction(spark):
    rows = spark.createDataFrame([("b", 0, 0, 0, 10, 10, 20, 30, "L"), ("b", 0, 1, 0, 30, 10, 40, 30, "R")], "book_id string, page bigint, boxno bigint, label bigint, l bigint, t bigint, r bigint, b bigint, text string")
    w = h = F.lit(100)
    ltr = group.group_rows(rows, w, h, right_to_left=False).first()
    rtl = group.group_rows(rows, w, h).first()
    assert (ltr.source_boxnos, ltr.text) == ([0, 1], "L\nR") and (rtl.source_boxnos, rtl.text) == ([1, 0], "RL")


def test_touching_boxes_become_one(spark):
    rows = spark.createDataFrame([("b", 0, i, *x, "") for i, x in enumerate([(10, 10, 20, 20), (20, 12, 30, 18), (100, 100, 110, 110), (31, 5, 40, 11), (28, 30, 29, 40)])], BOX)
    assert values(group.bbox_closure(rows), "l", "t", "r", "b") == [(10, 10, 30, 20), (100, 100, 110, 110), (28, 30, 29, 40), (31, 5, 40, 11)]
    grown = spark.createDataFrame([("b", 0, i, *x, "") for i, x in enumerate([(0, 0, 10, 10), (10, 10, 20, 20), (15, 2, 18, 5)])], BOX)
    assert values(group.bbox_closure(grown), "l", "t", "r", "b") == [(0, 0, 20, 20)]


def test_structure_answer_orders_rejects_and_corrects(spark):
    groups = spark.createDataFrame([("b", 0, n, [10 + n], t) for n, t in enumerate("ABC")], "book_id string, page bigint, boxno bigint, source_boxnos array<bigint>, text string")
    raw = '[[2,"sfx"],[0,"text","A corrected"],[1,"reject"]]'
    rows, errors = answers.apply_structure(groups, spark.createDataFrame([("b", 0, raw)], "book_id string, page bigint, raw string"))
    assert values(rows, "boxno", "source_boxnos", "sfx", "text") == [(0, [12], True, "C"), (1, [10], False, "A corrected")] and errors.count() == 0


def test_flat_erase_row_for_a_single_record(spark):
    one_box = spark.createDataFrame([("b", 1, 0)], "book_id string, page bigint, boxno bigint")
    rows, _ = answers.apply_erase(one_box, spark.createDataFrame([("b", 1, "[0,0,6]")], "book_id string, page bigint, raw string"))
    assert values(rows, "safe_to_erase", "open_lettering", "reason") == [(False, True, "over_face_body")]


def test_empty_translation_is_an_error(spark):
    box = spark.createDataFrame([("b", 0, 0, "x")], "book_id string, page bigint, boxno bigint, text string")
    for raw, count, code in (('[[0,""]]', 0, ["empty_translation"]), ('[[0,"VISIBLE EFFECT"]]', 1, [])):
        rows, errors, _ = answers.attach_translations(box, spark.createDataFrame([("b", 0, raw)], "book_id string, page bigint, raw string"))
        assert rows.count() == count and [r.code for r in errors.where("code <> 'missing'").collect()] == code


def test_answers_are_repaired(spark):
    raws = ['[0,"First"],[1,"Second"]', "[0,1,0],[1,1,2]]", '[0,"First"] trailing text', '[[0,"a, ]b"],]', "[[1],", '```json\n{"rows":[[1]]}\n```', "[NaN]", "[1]] x"]
    frame = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    sizes = {r.k: r.n for r in aj.read_rows(frame, ["k"]).select("k", F.when(F.col("items").isNotNull(), F.size("items")).alias("n")).collect()}
    assert sizes == {0: 2, 1: 2, 2: None, 3: 1, 4: None, 5: 1, 6: None, 7: None}


def test_which_text_needs_translation(spark):
    for value, wanted in (("22%", False), ("!? @#$", False), ("LEVEL 22", False), ("レベル22", True), ("自己紹介", True), ("　", False)):
        assert one(spark, tx.needs_translation(F.lit(value), "jp")) is wanted
    assert one(spark, tx.needs_translation(F.lit("한글"), "kr")) is True


def test_pages_are_packed_whole(spark):
    costs = spark.createDataFrame([("b", 0, 2, 10), ("b", 1, 1, 10), ("b", 2, 1, 10)], "book_id string, page bigint, records bigint, chars bigint")
    assert values(batching.budget_batches(costs, 2, 10_000), "page", "batch") == [(0, 0), (1, 1), (2, 1)]


def test_corrections(spark):
    rows = spark.createDataFrame([("b", k, n, t) for k in range(4) for n, t in enumerate("AB")], "book_id string, batch bigint, row_no bigint, english_text string")
    replies = spark.createDataFrame([("b", 0, "0\tCorrected"), ("b", 1, "<NO_CHANGES>"), ("b", 2, "Only one"), ("b", 3, "1\t<EMPTY>")], "book_id string, batch bigint, raw string")
    out, errors = answers.apply_corrections(rows, replies)
    assert values(out, "batch", "english_text") == [(0, "B"), (0, "Corrected"), (1, "A"), (1, "B")]
    assert values(errors, "batch", "code") == [(2, "bad_line"), (3, "removed_text")]


def test_upserts(spark):
    schema = "book_id string, page bigint, boxno bigint, l int, t int, r int, b int, sfx boolean, open_lettering boolean, text string, english_text string"
    master = spark.createDataFrame([("b", 0, 1, 0, 0, 1, 1, False, False, "old", "stale")], schema)
    fresh = master.drop("english_text").withColumn("text", F.lit("new"))
    assert values(merge.upsert_ocr(master, fresh), "text", "english_text") == [("new", None)]
    merged, errors = merge.upsert_translation(master, master.withColumn("text", F.lit("different source")))
    assert values(errors, "code") == [("text_mismatch",)] and values(merged, "english_text") == [("stale",)]


def test_overlap_between_two_sources(spark):
    rows = spark.createDataFrame([("b", 0, 0, 30, 30, 70, 80, 10, 10, 100, 180), ("b", 0, 1, 35, 120, 75, 170, 20, 60, 110, 230)],
                                 "book_id string, page bigint, boxno bigint, sl bigint, st bigint, sr bigint, sb bigint, pl bigint, pt bigint, pr bigint, pb bigint")
    assert values(layout.resolve_overlaps(rows), "pl", "pt", "pr", "pb", "adjusted") == [(10, 10, 100, 100, True), (20, 100, 110, 230, True)]


def test_new_detection_over_a_deleted_region_is_dropped(spark):
    rows = spark.createDataFrame([("b", 0, "new", 12, 12, 52, 82)], "book_id string, page bigint, record_id string, l bigint, t bigint, r bigint, b bigint")
    gone = spark.createDataFrame([("b", 0, "old", 10, 10, 50, 80, True)], "book_id string, page bigint, record_id string, l bigint, t bigint, r bigint, b bigint, protected boolean")
    assert overlay.tombstone_antijoin(rows, gone, by_region=True, protected_only=True).count() == 0


def test_regeneration_keeps_an_earlier_pending_stage(spark):
    events = spark.createDataFrame([("b", 3, 1, "saved", "placement"), ("b", 1, 2, "saved", "structure"), ("b", 1, 3, "regenerated", "erase")], "book_id string, page bigint, revision bigint, kind string, stage string")
    out = {r.page: (r.pending, r.stale) for r in overlay.stale_after_events(events).collect()}
    assert out[1] == (["structure"], ["erase", "translation", "placement"]) and out[3] == (["placement"], [])


def test_active_time(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at, 1, "start"), ("a", at + dt.timedelta(seconds=50), 2, "stop"), ("a", at + dt.timedelta(seconds=600), 3, "start"), ("a", at + dt.timedelta(seconds=605), 4, "start"), ("a", at + dt.timedelta(seconds=640), 5, "stop")]
    frame = spark.createDataFrame(rows, "job_id string, at timestamp, seq bigint, kind string")
    base = spark.createDataFrame([("a", 10_000)], "job_id string, elapsed_ms bigint")
    assert jobs.active_runtime(frame, base).first().elapsed_micros == 100_000_000


def test_chapter_numbers(spark):
    for value, wanted in (("01.50", "1.5"), ("0", "0"), ("", None), ("-1", None), ("NaN", None), ("Infinity", None), ("1000001", None), ("chapter 1", None), ("1e3", "1000"), ("1e-19", None), (" 7.", "7")):
        assert one(spark, tx.chapter_number(F.lit(value))) == wanted


def test_series_gate(spark):
    schema = "series string, job_id string, volume string, chapter string, status string, has_context boolean, skip_gate boolean"
    none = spark.createDataFrame([], "series string, volume string, chapter string")
    through = spark.createDataFrame([("s", "", "1")], "series string, volume string, chapter string")

    def reason(first, coverage):
        rows = spark.createDataFrame([("s", "j1", "", "1", first, False, False), ("s", "j2", "", "2", "queued", False, False), ("o", "j3", "", "1", "queued", False, False)], schema)
        return {r.job_id: r.reason for r in series.series_gate(rows, coverage).collect()}

    assert reason("failed", none)["j2"] == "Waiting for Ch. 1 (failed)."
    assert reason("complete", none)["j2"] == "Waiting for series notes from Ch. 1."
    done = reason("complete", through)
    assert done["j2"] == "" and done["j3"] == ""


def test_volume_pages_follow_chapter_order(spark):
    rows = spark.createDataFrame([("s", "a", "1", "2", "complete", 1), ("s", "b", "1", "1.5", "complete", 1), ("s", "c", "", "3", "complete", 1)], "series string, job_id string, volume string, chapter string, status string, page_count int")
    assert values(series.collection_pages(rows), "group_key", "job_id", "out_page") == [("chapter:c", "c", 0), ("volume:1", "a", 1), ("volume:1", "b", 0)]
    assert values(series.collection_info(rows), "group_key", "page_count", "number") == [("chapter:c", 1, "3"), ("volume:1", 2, "")]


def test_missing_duration_is_blank(spark):
    assert one(spark, tx.duration_text(F.lit(None).cast("double"))) == "" and one(spark, tx.age_text(F.lit(None).cast("double"))) == ""
    assert one(spark, tx.duration_text(F.lit(59.96))) == "60.0s" and one(spark, tx.duration_text(F.lit(3725))) == "1h 2m"


def test_a_book_without_any_artifact_is_reported(spark):
    from boxloom.operators import jobs

    pages = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "book_id string, page long")
    made = spark.createDataFrame([("a", 0, "ocr_raw")], "book_id string, page long, artifact string")
    got = {(r.book_id, r.page, r.artifact) for r in jobs.missing_artifacts(pages, made, ("ocr_raw", "placements")).collect()}
    assert got == {("a", 1, "ocr_raw"), ("b", 0, "ocr_raw"), ("a", 0, "placements"), ("a", 1, "placements"), ("b", 0, "placements")}


def test_failures_of_the_same_time_count_in_order(spark):
    from boxloom.operators import jobs

    rows = spark.sql("SELECT * FROM VALUES (1L, 1L, timestamp'2024-01-01 00:00:00', false), (1L, 2L, timestamp'2024-01-01 00:00:00', false), "
                     "(1L, 3L, timestamp'2024-01-01 00:00:30', false) t(client, seq, at, ok)")
    assert {(r.seq, r.failures) for r in jobs.failure_limiter(rows).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_artifact_items_keep_their_place(spark, tmp_path):
    from boxloom.sources import artifacts

    folder = tmp_path / "book" / "ocr"
    folder.mkdir(parents=True)
    (folder / "page_0003.json").write_text('[{"boxno": 5}, {"boxno": 2}, {"boxno": 9}]')
    rows = artifacts.read_artifact(spark, str(tmp_path), "boxno bigint").collect()
    assert sorted((r.book_id, r.page, r.pos, r.boxno) for r in rows) == [("book", 3, 0, 5), ("book", 3, 1, 2), ("book", 3, 2, 9)]
    assert artifacts.read_master(spark, str(tmp_path / "none"), "boxno bigint", allow_missing=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        artifacts.read_master(spark, str(tmp_path / "none"), "boxno bigint")
