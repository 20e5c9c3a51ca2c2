"""Chapters of a series: order, gates, notes, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import text as tx
from boxloom.operators.ranking import BLOCK, split_row_number, split_running
from boxloom.session import stored

SERIES = ("series",)
# Notes that carry nothing new
PLACEHOLDER_NOTES = ("No translated records were available.", "No reusable translation notes were generated.")


def _decimal(value: Column) -> Column:
    return value.try_cast("decimal(38,18)")


def chapter_key(volume: Column, chapter: Column) -> Column:
    """Order of chapters: by volume (none comes first), then by chapter."""
    return F.struct(F.coalesce(_decimal(F.nullif(volume, F.lit(""))), _decimal(F.lit("-1"))).alias("v"), _decimal(chapter).alias("c"))


def _bucket(key: str) -> Column:
    return F.struct(F.col(f"{key}.v"), F.floor(F.col(f"{key}.c") / 64))


def _keyed(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("key", chapter_key(F.col("volume"), F.col("chapter")))


def chapter_conflicts(chapters: DataFrame) -> DataFrame:
    """Chapters of a series that share a number in a volume."""
    keyed = _keyed(chapters)
    return keyed.groupBy("series", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(
        keyed, ["series", "key"]).select("series", "job_id", "volume", "chapter")


def _unfinished() -> Column:
    state = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))
    return F.when(F.coalesce(F.col("status") != "complete", F.lit(True)), F.struct("key", "label", state.alias("state")))


def _in_one_window(keyed: DataFrame) -> DataFrame:
    """`open`, the first unfinished chapter of the series, and `prev`, the chapter before: one sort of the rows of a series."""
    every = Window.partitionBy("series")
    first = F.when(F.col("series").isNotNull(), F.min(_unfinished()).over(every))
    return keyed.select("*", first.alias("open"), F.lag(F.struct("key", "label")).over(every.orderBy("key")).alias("prev"))


def _in_buckets(keyed: DataFrame) -> DataFrame:
    """The same for series of any length, in buckets of chapters."""
    first = keyed.groupBy("series").agg(F.min(_unfinished()).alias("open"))
    before = split_running(keyed, SERIES, [F.col("key")], _bucket("key"), lasts={"prev": F.struct("key", "label")}, include_current=False)
    return before.join(first, "series", "left")


def series_gate(chapters: DataFrame, coverage: DataFrame, most: int = BLOCK) -> DataFrame:
    """May a chapter start, and what does it wait for?

    `chapters`: series, job_id, volume, chapter, status, has_context, skip_gate;
    `coverage`: series, volume, chapter of the last chapter the series notes cover. Series of more than
    `most` chapters go through buckets.
    """
    keyed = _keyed(chapters).withColumn("label", tx.chapter_label(F.col("volume"), F.col("chapter")))
    covered = coverage.select("series", chapter_key(F.col("volume"), F.col("chapter")).alias("through"))
    sizes = chapters.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(sizes.where(F.col("n") > most).select(F.col("series").alias("__h")))
    of_crowded = F.col("series").eqNullSafe(F.col("__h"))
    if crowded.limit(1).count() == 0:
        before = _in_one_window(keyed)
    else:
        before = _in_one_window(keyed.join(crowded, of_crowded, "left_anti")).unionByName(_in_buckets(keyed.join(crowded, of_crowded, "left_semi")))
    joined = before.join(covered, "series", "left")
    waits = F.col("open.key") < F.col("key")
    late = F.col("prev").isNotNull() & (F.col("through").isNull() | (F.col("through") < F.col("prev.key")))
    reason = (F.when(F.col("skip_gate"), "")
              .when(waits, F.concat(F.lit("Waiting for "), "open.label", F.lit(" ("), "open.state", F.lit(").")))
              .when(F.col("has_context"), "")
              .when(F.col("through") >= F.col("key"), "Series notes include this chapter or a later chapter. Publish earlier chapter notes first.")
              .when(late, F.concat(F.lit("Waiting for series notes from "), "prev.label", F.lit(".")))
              .otherwise(""))
    return joined.select("series", "job_id", (reason == "").alias("ready"), reason.alias("reason"))


def notes_rollforward(chapters: DataFrame) -> DataFrame:
    """Series notes after each chapter of the completed prefix; a blank note stops the chain.

    `chapters`: series, job_id, volume, chapter, status, note.
    """
    keyed = _keyed(chapters)
    blocked = F.coalesce(F.col("status") != "complete", F.lit(True)) | (F.coalesce("note", F.lit("")) == "")
    stop = keyed.where(blocked).groupBy("series").agg(F.min("key").alias("stop"))
    chain = keyed.join(stop, "series", "left").where(F.col("stop").isNull() | (F.col("key") < F.col("stop")))
    own = F.when(~F.col("note").isin(*PLACEHOLDER_NOTES), F.col("note"))
    return split_running(chain, SERIES, [F.col("key")], _bucket("key"), lasts={"notes": own}).select("series", "job_id", "volume", "chapter", "notes")


def context_asof(chapters: DataFrame, series: DataFrame) -> DataFrame:
    """Instructions for each chapter: fixed series instructions, notes of the latest earlier
    chapter that published some, and the chapter's own notes.

    `chapters`: series, job_id, volume, chapter, published (nullable), job_notes; `series`:
    series, instructions.
    """
    keyed = _keyed(chapters)
    before = split_running(keyed, SERIES, [F.col("key")], _bucket("key"), lasts={"earlier": F.col("published")}, include_current=False)
    joined = before.join(series.select("series", "instructions"), "series", "left")

    def section(title: str, body: str) -> Column:
        return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), F.col(body)))

    parts = F.array_compact(F.array(
        section("Fixed series instructions (take priority over other notes)", "instructions"),
        section("Series notes from earlier chapters", "earlier"), section("Chapter instructions", "job_notes")))
    return joined.select("series", "job_id", F.array_join(parts, "\n\n").alias("context"))


def coverage_boundary(chapters: DataFrame) -> DataFrame:
    """The last covered chapter of each series, whatever it is numbered now."""
    last = _keyed(chapters.where("covered")).groupBy("series").agg(F.max(F.struct("key", "volume", "chapter")).alias("x"))
    return last.select("series", "x.volume", "x.chapter")


def collection_pages(chapters: DataFrame, by_volume: bool = True) -> DataFrame:
    """Pages of the completed chapters of each output group, numbered through the group.

    A volume is one group when volumes are wanted and set; any other chapter is its own.
    `chapters`: series, job_id, volume, chapter, status, page_count.
    """
    done = _keyed(chapters.where("status = 'complete'"))
    in_volume = F.lit(by_volume) & (F.coalesce("volume", F.lit("")) != "")
    named = done.withColumn("group_key", F.when(in_volume, F.concat(F.lit("volume:"), "volume")).otherwise(F.concat(F.lit("chapter:"), "job_id")))
    start = split_running(named, ("series", "group_key"), [F.col("key"), F.col("job_id")], _bucket("key"),
                          sums={"start": F.col("page_count")}, include_current=False)
    pages = start.where(F.col("page_count") > 0).withColumn("page", F.explode(F.sequence(F.lit(0), (F.col("page_count") - 1).cast("int"))))
    return pages.select("series", "group_key", "job_id", F.col("page").cast("bigint").alias("page"),
                        (F.col("start") + F.col("page")).cast("bigint").alias("out_page"))


def collection_info(chapters: DataFrame, by_volume: bool = True) -> DataFrame:
    """Metadata of each output group: number and title only when it is a single chapter."""
    done = _keyed(chapters.where("status = 'complete'"))
    in_volume = F.lit(by_volume) & (F.coalesce("volume", F.lit("")) != "")
    named = done.withColumn("group_key", F.when(in_volume, F.concat(F.lit("volume:"), "volume")).otherwise(F.concat(F.lit("chapter:"), "job_id")))
    return named.groupBy("series", "group_key").agg(
        F.sum("page_count").cast("bigint").alias("page_count"), F.count(F.lit(1)).alias("chapters"), F.max("volume").alias("volume"),
        F.when(F.max(in_volume.cast("int")) == 1, F.lit("")).otherwise(F.max("chapter")).alias("number"))


def batch_numbering(files: DataFrame, first: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Chapter numbers for the files of an upload in natural order: first, first + 1, ...

    `files`: upload, name, pos. Uploads with more than `most` files are errors.
    """
    counts = files.groupBy("upload").agg(F.count(F.lit(1)).alias("n"))
    errors = counts.where(F.col("n") > most).select("upload", F.lit("too_many_files").alias("code"))
    kept = files.join(errors.select("upload"), "upload", "left_anti").withColumn("k", tx.natural_key(F.col("name")))
    numbered = split_row_number(kept, ("upload",), [F.col("k"), F.col("pos")], F.lit(0), "i")  # bounded: at most `most` files
    number = tx.chapter_number((F.lit(first).cast("decimal(20,6)") + F.col("i").cast("decimal(20,6)")).cast("string"))
    return numbered.select("upload", "name", number.alias("chapter")), errors


def stale_exports(stored: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Series whose stored inputs differ from the current ones: (series, stale)."""
    key = ["series", "job_id"]
    a = stored.select(*key, F.struct(*fields).alias("was"))
    b = current.select(*key, F.struct(*fields).alias("now"))
    both = a.join(b, key, "full_outer").groupBy("series").agg(F.bool_or(~F.col("was").eqNullSafe(F.col("now"))).alias("stale"))
    return stored.select("series").distinct().join(both, "series")


def merged_elements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata elements by precedence: the row with the highest `priority` wins; Pages is dropped.

    `rows`: keys.., tag, value, priority.
    """
    return rows.where(F.col("tag") != "Pages").groupBy(*keys, "tag").agg(F.max_by("value", "priority").alias("value"))


def page_index(members: DataFrame) -> DataFrame:
    """0-based page numbers of image members in natural order of their names, with a padded name.

    `members`: book_id, name. Names are bucketed by their leading text, which rises with the key.
    """
    images = members.where(tx.is_image_member(F.col("name"))).withColumn("k", tx.natural_key(F.col("name")))
    lead = F.struct(F.get("k", F.lit(0))["text"], F.get("k", F.lit(0))["size"], F.get("k", F.lit(0))["number"])
    numbered = split_row_number(images, ("book_id",), [F.col("k"), F.col("name")], lead, "page")
    padded = F.concat(F.lit("page_"), F.lpad(F.col("page").cast("string"), F.greatest(F.lit(4), F.length(F.col("page").cast("string"))), "0"))
    return numbered.select("book_id", "page", "name", padded.alias("page_name"))
