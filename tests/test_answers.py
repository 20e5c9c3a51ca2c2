"""Joins of answers with records, and the reading of answers."""

from pyspark.sql import functions as F

from boxloom.operators import answers as ans
from boxloom.operators import overlay
from boxloom.plans import answering


def records(spark):
    return spark.createDataFrame([("b", p, n, f"w{n}") for p in (13, 14, 15, 16) for n in range(3)], "book_id string, page long, boxno long, text string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_all_records_is_broadcast(spark):
    rows = records(spark)
    answers = answering.translation_answers(rows)
    accepted, errors, warnings = ans.attach_translations(rows, answers)
    for df in (accepted, errors, warnings):
        assert "BroadcastHashJoin" not in plan_of(df)
    assert accepted.count() == 12
    erased = rows.select("book_id", "page", "boxno", F.lit(None).cast("boolean").alias("open_lettering"),
                         F.lit(None).cast("boolean").alias("safe_to_erase"), F.lit(None).cast("string").alias("reason"))
    hydrated = ans.hydrate_erase(erased, answering.erase_answers(rows))
    assert "BroadcastHashJoin" not in plan_of(hydrated)
    assert hydrated.count() == 12


def test_answer_of_a_page_without_listed_boxes(spark):
    rows = records(spark).where("boxno = 0").withColumn("page", F.when(F.col("page") == 13, 10).when(F.col("page") > 14, F.col("page")).cast("bigint"))
    got = {r.page: r.raw for r in answering.answer_table(rows, F.lit("[1]"), F.lit("[#]")).collect()}
    assert got == {10: "```json\n[,]\n```", 15: '{"rows":[[1]]}', 16: "```json\n[[1],]\n```", None: "[]"}


def test_cells_are_read_by_their_kind(spark):
    rows = spark.createDataFrame([("b", 1, n, f"w{n}") for n in range(6)], "book_id string, page long, boxno long, text string")
    raw = '[["0", "a, ]"], [1, "b" , ], [1, 2, "c"], [1, 3, "x", "d",], {"boxno": "4", "englishText": "e"}, [5, "f"]\n,]'
    answers = spark.createDataFrame([("b", 1, raw)], "book_id string, page long, raw string")
    accepted, errors, warnings = ans.attach_translations(rows, answers)
    assert {r.boxno: r.english_text for r in accepted.collect()} == {0: "a, ]", 1: "b", 2: "c", 3: "d", 4: "e", 5: "f"}
    assert errors.count() == 0
    assert [(r.boxno, r.echo) for r in warnings.collect()] == [(3, "x")]


def test_cascade_shuffles_the_sources_once(spark):
    shape = "book_id string, page long, boxno long, source_boxnos array<long>"
    raw = spark.createDataFrame([("b", 1, n, f"w{n}", 0, 0, 9, 9) for n in (0, 1, 3)], "book_id string, page long, boxno long, text string, l long, t long, r long, b long")
    groups = spark.createDataFrame([("b", 1, g, [2 * g, 2 * g + 1]) for g in range(4)], shape).selectExpr("*", "'x' AS text", *[f"cast(0 AS bigint) AS {c}" for c in "ltrb"])
    structured = groups.select("book_id", "page", "boxno", "source_boxnos")
    later = structured.select("*", F.lit("placements").alias("artifact"))
    dead = spark.createDataFrame([("b", 1, 2)], "book_id string, page long, boxno long")
    none = structured.where("false")
    rejected = structured.where("boxno = 1")
    out = overlay.lineage_cascade(raw, groups, structured, later, dead, none, rejected)
    plan = plan_of(out["later"])
    assert plan.count("Exchange hashpartitioning") <= 12 and "BroadcastHashJoin" not in plan
    assert sorted(r.boxno for r in out["structured"].collect()) == [0]  # 1 is rejected, the sources of 2 and 3 are not live
    assert sorted(r.boxno for r in out["later"].collect()) == [0]
