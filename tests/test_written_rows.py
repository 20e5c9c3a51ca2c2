"""Costly rows are made once, and ordinary groups take no detour for crowded ones."""

import random
import re

from pyspark.sql import functions as F

from boxloom.functions import answer_json as aj
from boxloom.operators import answers as ans
from boxloom.operators import detect, group, overlay, ranking, series
from boxloom.plans import REGISTRY
from boxloom.plans.registry import Source
from boxloom.session import stored

BOX = "book_id string, page long, boxno long, l long, t long, r long, b long, text string"


def box_rows(pages, per_page, seed=3, size=60):
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        for n in range(per_page):
            l, t = rng.randrange(0, 250), rng.randrange(0, 400)
            rows.append(("b", page, n, l, t, l + rng.randrange(1, size), t + rng.randrange(1, size), f"w{n % 3}"))
    return rows


def counted(spark, df):
    """`df` behind a filter that counts the rows it is asked for."""
    seen = spark.sparkContext.accumulator(0)

    def look(_):
        seen.add(1)
        return True

    return df.where(F.udf(look, "boolean")(F.col("page"))), seen


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_closure(boxes):
    boxes = set(boxes)
    while True:
        pair = next(((x, y) for x in boxes for y in boxes if x < y and x[2] >= y[0] and y[2] >= x[0] and x[3] >= y[1] and y[3] >= x[1]), None)
        if pair is None:
            return boxes
        x, y = pair
        boxes = boxes - {x, y} | {(min(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2]), max(x[3], y[3]))}


def closures(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.page, []).append((r.l, r.t, r.r, r.b))
    assert all(len(set(x)) == len(x) for x in out.values())
    return {page: set(x) for page, x in out.items()}


def test_closure_of_ordinary_pages_is_one_fold(spark, monkeypatch):
    rows = box_rows(30, 9) + [("b", 99, n, 10 * n, 10 * n, 10 * n + 10, 10 * n + 10, "") for n in range(12)]
    want = {page: plain_closure([x[3:7] for x in rows if x[1] == page]) for page in {x[1] for x in rows}}
    boxes = spark.createDataFrame(rows, BOX)
    assert closures(group.bbox_closure(boxes, fold_boxes=10)) == want  # page 99 goes in rounds

    def none(*_):
        raise AssertionError("a pair search for ordinary pages")

    monkeypatch.setattr(group, "near_pairs", none)
    assert closures(group.bbox_closure(boxes)) == want


def test_boxes_without_a_page_touch_nothing(spark):
    rows = [("b", None, 0, 0, 0, 9, 9, ""), ("b", None, 1, 5, 5, 12, 12, ""), ("b", 1, 0, 0, 0, 9, 9, ""), ("b", 1, 1, 5, 5, 12, 12, "")]
    assert closures(group.bbox_closure(spark.createDataFrame(rows, BOX))) == {None: {(0, 0, 9, 9), (5, 5, 12, 12)}, 1: {(0, 0, 12, 12)}}


def test_numbers_of_crowded_and_other_groups(spark):
    rows = [("x", i) for i in range(40)] + [("y", i * 3) for i in range(5)] + [(None, 7 - i) for i in range(6)] + [("z", None)]
    frame = spark.createDataFrame(rows, "g string, i long")
    bucket = ranking.position_block(F.col("i"), 4)
    for most in (3, 5, 100):
        got = ranking.written_row_number(frame, ["g"], [F.col("i")], bucket, "n", most=most).collect()
        for g in ("x", "y", None):
            assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] == list(range(sum(k == g for k, _ in rows)))
        assert len(got) == len(rows) - 1  # a row without a position has no number


def test_numbered_rows_are_made_once(spark):
    boxes = spark.createDataFrame(box_rows(6, 5), BOX)
    rows, seen = counted(spark, boxes)
    assert detect.renumber(rows.withColumnRenamed("boxno", "old"), "old").count() == 30
    assert seen.value == 30
    rows, seen = counted(spark, boxes)
    assert group.page_order(rows, tie="boxno", name="at").count() == 30
    assert seen.value == 30


def test_numbers_of_blocks(spark):
    texts = ["[1, 2.5, 3]", "[1, null]", "[]", "[null]", '[1, "2"]', "[1, true]", "[[1], [2]]", "7", "[12345678901234567890, 1]", '{"a": 1}']
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", F.try_parse_json("j").alias("v"))
    got = [r.n for r in frame.orderBy("i").select(aj.as_numbers(F.col("v")).alias("n")).collect()]
    assert got == [[1.0, 2.5, 3.0], None, [], None, None, None, None, None, [12345678901234567890.0, 1.0], None]


def test_blocks_are_read_once(spark):
    text = '[{"label":"text","text":"a","bbox":[1,2,30,40]},{"block_label":null,"label":"Image","text":"b","bbox":[1,2,3,4]},7,{"text":["x",null,"y"],"poly":[[5,6],[70,80]],"score":"0.9"}]'
    rows, seen = counted(spark, spark.createDataFrame([("b", 1, 320, 480, text, None, None)], "book_id string, page long, width int, height int, blocks string, block_width int, block_height int"))
    got = sorted(detect.normalize_blocks(rows).collect(), key=lambda r: r.boxno)
    assert [(r.boxno, r.l, r.t, r.r, r.b, r.text, r.score) for r in got] == [(0, 1, 2, 30, 40, "a", None), (1, 5, 6, 70, 80, "x\ny", 0.9)]
    assert seen.value == 1


def test_visible_merge_reads_its_tables_once(spark):
    shape = "book_id string, page long, record_id string, pos long"
    current, seen = counted(spark, spark.createDataFrame([("b", 1, i, n) for n, i in enumerate("abcde")] + [("b", 1, None, 5)], shape))
    visible = spark.createDataFrame([("b", 1, i, 0) for i in "bcd"] + [("b", 1, None, 0)], shape)
    sent = spark.createDataFrame([("b", 1, "d", 0), ("b", 1, "a", 1), ("b", 1, "new", 2), ("b", 1, "b", 3)], shape)
    got = overlay.visible_merge(current, visible, sent).collect()
    # a, e and the one without an id are hidden; c is gone; d and the new one take the slots of b and d, b follows
    assert [(r.record_id, r.hidden) for r in sorted(got, key=lambda r: r.pos)] == [
        ("a", True), ("d", False), ("new", False), ("e", True), (None, True), ("b", False)]
    assert seen.value == 6


def test_an_order_of_edits_is_numbered_once(spark):
    base = spark.createDataFrame([("b", 1, f"r{n}", n, n, 0, 0, 9, 9, "t") for n in range(4)],
                                 "book_id string, page long, record_id string, pos long, boxno long, l long, t long, r long, b long, text string").withColumn("source", F.lit(None).cast("string"))
    old = base.select("book_id", "page", F.lit("order").alias("kind"), "record_id", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"),
                      F.lit(False).alias("protected"), "l", "t", "r", "b", F.col("pos").alias("ordinal"))
    out = overlay.diff_overrides(base, base.withColumn("pos", 9 - F.col("pos")), old, ["text"])
    assert {(r.record_id, r.value) for r in out.collect()} == {("r3", "0"), ("r2", "1"), ("r1", "2"), ("r0", "3")}
    assert "Window" not in plan_of(out)


def test_groups_meet_answers_by_source_only_where_asked(spark):
    groups = spark.createDataFrame([("b", p, n, [n + 10], "t") for p in (1, 2) for n in range(2)], "book_id string, page long, boxno long, source_boxnos array<long>, text string")
    numbered = spark.createDataFrame([("b", p, '[[0,"text"],[1,"text"]]') for p in (1, 2)], "book_id string, page long, raw string")
    sourced = spark.createDataFrame([("b", 1, '[[0,"text"],{"sourceBoxnos":[11],"sfx":true}]'), ("b", 2, '[[1,"text"],{"sourceBoxnos":[12],"sfx":true}]')], "book_id string, page long, raw string")
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    watched = groups.withColumn("source_boxnos", F.udf(look, "array<long>")("source_boxnos"))
    assert ans.apply_structure(watched, numbered)[1].count() == 0
    assert seen.value == 0
    rows, errors = ans.apply_structure(groups, sourced)
    assert sorted((r.page, r.boxno, r.sfx) for r in rows.collect()) == [(1, 0, False), (1, 1, True)]
    assert {r.page for r in errors.collect()} == {2}


def test_placements_read_boxes_once(spark):
    boxes, seen = counted(spark, spark.createDataFrame(box_rows(3, 4), BOX).withColumn("page", F.col("page") + 4))
    source = Source(spark, "/nowhere")
    source.__dict__["boxes"], source.__dict__["nation"] = boxes, spark.createDataFrame([("NATION_3",)], "n_name string")
    assert REGISTRY["attach_placements"].build(source).count() == 12
    assert seen.value == 12


def test_pending_groups_are_numbered_from_written_rows(spark):
    boxes, seen = counted(spark, spark.createDataFrame(box_rows(2, 6), BOX))
    groups = spark.createDataFrame([("b", p, g, [2 * g, 2 * g + 1], "x", 0, 0, 9, 9) for p in (0, 1) for g in range(3)],
                                   "book_id string, page long, boxno long, source_boxnos array<long>, text string, l long, t long, r long, b long")
    shape = groups.select("book_id", "page", "boxno", "source_boxnos")
    none = shape.where("false")
    out = overlay.pending_descendants(groups, boxes, shape.where("boxno = 0"), none, none.withColumn("source", F.col("boxno")), none)
    assert sorted((r.page, r.boxno) for r in out.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert seen.value == 12


def test_traces_of_a_run_share_a_file(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"phase": "a",\n "generatedTokens": 3}')
    (tmp_path / "run.json").write_text('[{"phase": "b", "generatedTokens": 4},\n{"phase": "c"}]')
    from boxloom.plans import files
    from boxloom.sources import artifacts
    assert {(r.phase, r.generatedTokens) for r in artifacts.read_traces(spark, str(tmp_path)).collect()} == {("a", 3), ("b", 4), ("c", None)}
    source = Source(spark, "/nowhere")
    source.__dict__["supplier"] = spark.range(2500).coalesce(1).withColumnRenamed("id", "s_suppkey")
    out = files.read_traces(source)
    assert out.count() == 2500 and len(out.inputFiles()) == 3
    assert not re.search(r"_corrupt", str(out.columns))


def test_stages_of_edited_pages_are_not_broadcast(spark):
    edits = spark.createDataFrame([("b", 1, "erase"), ("b", 1, "erase"), ("b", 1, "ocr"), ("b", 1, None), (None, 2, "ocr"), ("b", 3, "made up")], "book_id string, page bigint, stage string")
    states = spark.createDataFrame([("b", p, stage, p * 2) for p in (1, 2, 3) for stage in ("ocr", "erase", None)] + [("b", 1, "ocr", 9), (None, 2, "ocr", 1), ("b", 3, "made up", 1)],
                                   "book_id string, page bigint, stage string, saved_revision int").select(
        "*", F.lit(False).alias("stale"), F.lit(None).cast("boolean").alias("pending"), F.lit(True).alias("frozen"))
    found = overlay.stage_status(stored(edits), stored(states))  # tables of a small known size
    assert "BroadcastHashJoin" not in plan_of(found)
    got = sorted((str(r.book_id), r.page, str(r.stage), r.saved_revision) for r in found.collect() if r.changed)
    assert got == [("b", 1, "erase", 2), ("b", 1, "ocr", 2), ("b", 1, "ocr", 9), ("b", 1, "text", 2), ("b", 3, "made up", 1)]
    assert found.count() == len(states.collect()) + 3


def test_gates_of_ordinary_and_of_crowded_series(spark):
    rng = random.Random(5)
    rows = [(name, f"{name}{n}", rng.choice(["", "1", "2"]), f"{n}.5" if n % 4 else str(n * 30), rng.choice(["complete"] * 6 + ["queued", "", None]), n % 9 == 8, n % 11 == 10)
            for name, count in (("x", 30), ("y", 4), ("z", 1), (None, 12)) for n in range(count)]
    chapters = stored(spark.createDataFrame(rows + [("w", "w0", "1", None, "queued", False, False)], "series string, job_id string, volume string, chapter string, status string, has_context boolean, skip_gate boolean"))
    coverage = spark.createDataFrame([("x", "", "60"), (None, "1", "1.5")], "series string, volume string, chapter string")
    gates = [series.series_gate(chapters, coverage, most=most) for most in (1, 8, 100)]
    found = [sorted((str(r.series), r.job_id, r.ready, r.reason) for r in gate.collect()) for gate in gates]
    assert len(found[0]) == len(rows) + 1 and found[0] == found[1] == found[2]
    assert plan_of(gates[2]).split("== Initial Plan ==")[0].count("- Window ") < plan_of(gates[0]).split("== Initial Plan ==")[0].count("- Window ")
