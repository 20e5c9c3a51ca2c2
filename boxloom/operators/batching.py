"""Packing records into bounded requests and building their context."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import text as tx
from boxloom.operators.group import PAGE
from boxloom.operators.ranking import BLOCK, position_block, split_row_number, split_running
from boxloom.session import materialise

BOOK = ("book_id",)
HEADER = "page\tboxno\tsfx\topenLettering\tsourceText\tenglishText"


def request_tables(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One compact {"cols": [..], "rows": [[..]]} text per page; booleans as 1 and 0."""
    kinds = dict(records.dtypes)

    def cell(name: str) -> Column:
        value = F.col(name)
        if kinds[name] == "boolean":
            value = value.cast("int")
        text = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
        return F.when(value.isNull(), F.lit("null")).otherwise(text)

    row = F.concat(F.lit("["), F.concat_ws(",", *[cell(f) for f in fields]), F.lit("]"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("boxno", row.alias("x")))), lambda m: m["x"]), ",")
    head = '{"cols":[' + ",".join(f'"{f}"' for f in fields) + '],"rows":['
    return records.groupBy(*PAGE).agg(F.concat(F.lit(head), rows, F.lit("]}")).alias("request"))


def review_line(sfx: Column, open_lettering: Column) -> Column:
    return F.concat_ws("\t", F.col("page"), F.col("boxno"), F.when(sfx, "1").otherwise("0"), F.when(open_lettering, "1").otherwise("0"),
                       tx.flat_field(F.col("text")), tx.flat_field(F.col("english_text")))


def review_lines(records: DataFrame) -> DataFrame:
    """A tab-separated line per record."""
    return records.select(*PAGE, "boxno", review_line(F.col("sfx"), F.col("open_lettering")).alias("line"))


def write_review(records: DataFrame, path: str) -> None:
    """Review texts as text files below `book_id=...`: the header and the lines of every page, in order of page and box.

    Rows are dealt out by ranges of pages and boxes, so a book may be many files, which follow each
    other by name, and a page of any size is sorted and written by more than one task.
    """
    heads = records.select(*PAGE).distinct().select(*PAGE, F.lit(None).cast("bigint").alias("boxno"), F.lit(HEADER).alias("line"))
    order = [F.col("book_id"), F.col("page"), F.asc_nulls_first("boxno")]
    rows = review_lines(records).unionByName(heads)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("book_id", "line").write.mode("overwrite").partitionBy("book_id").text(path)


def page_costs(records: DataFrame) -> DataFrame:
    """Records and characters of each page in a review text: header, then a break and a line per record."""
    line = F.length(review_line(F.col("sfx"), F.col("open_lettering")))
    return records.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("records"), (F.sum(line + 1) + len(HEADER)).alias("chars"))


def _following(block: pd.DataFrame, most_records: int, most_chars: int) -> np.ndarray:
    """For every page of a block, the offset of the page that starts the batch after its own."""
    records, chars = block["records"].to_numpy(np.int64), block["chars"].to_numpy(np.int64)
    upto_r, upto_c = np.cumsum(records), np.cumsum(chars)
    by_records = np.searchsorted(upto_r, upto_r - records + most_records, side="right")
    by_chars = np.searchsorted(upto_c, upto_c - chars + most_chars, side="right")
    return np.maximum(np.minimum(by_records, by_chars), np.arange(len(block)) + 1)


def budget_batches(costs: DataFrame, most_records: int = 80, most_chars: int = 16_000, block: int = BLOCK) -> DataFrame:
    """Pack consecutive pages whole into batches; a page over a limit is a batch of its own.

    A greedy walk, cut into blocks of pages: a batch holds at most `most_records` pages, so a
    block can be entered at few places only. Each block maps its entries to the entry of the
    next block, doubling joins find the entries that are really used, and every block then
    marks its batch starts on its own.
    """
    if most_records <= 0 or most_chars <= 0:
        raise ValueError("batch limits must be positive")
    block = max(block, 2 * most_records)
    rows = costs.where(F.col("records") > 0).select(*PAGE, "records", "chars")
    placed = materialise(split_row_number(rows, BOOK, [F.col("page")], position_block(F.col("page")), "at")
                         .withColumn("blk", position_block(F.col("at"), block)))
    near_start = F.col("at") % block < most_records
    spread = F.when(near_start & (F.col("blk") > 0), F.array(F.col("blk"), F.col("blk") - 1)).otherwise(F.array("blk"))
    haloed = placed.withColumn("part", F.explode(spread))

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        start, part = int(pdf["at"].iloc[0]), int(pdf["part"].iloc[0])
        following = _following(pdf, most_records, most_chars)
        own = int((pdf["blk"] == part).sum())
        leave = np.arange(len(pdf))
        for i in range(own - 1, -1, -1):
            leave[i] = following[i] if following[i] >= own else leave[following[i]]
        first = min(own, most_records)
        return pd.DataFrame({"book_id": pdf["book_id"].iloc[0], "at": start + np.arange(first), "to": start + leave[:first]})

    blocks = placed.agg(F.max("blk")).first()[0] or 0
    reached = placed.where("at = 0").select("book_id", "at")
    if blocks > 0:
        jump = materialise(haloed.groupBy("book_id", "part").applyInPandas(entries, "book_id string, at bigint, to bigint"))
        reached = materialise(reached)
        for _ in range(math.ceil(math.log2(blocks + 1))):
            more = reached.join(jump, ["book_id", "at"]).select("book_id", F.col("to").alias("at"))
            reached = materialise(reached.unionByName(more).distinct())
            onward = jump.select("book_id", F.col("at").alias("to"), F.col("to").alias("then"))
            jump = materialise(jump.join(onward, ["book_id", "to"]).select("book_id", "at", F.col("then").alias("to")))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        following = _following(pdf, most_records, most_chars)
        own = pdf["blk"] == pdf["part"]
        flags, i = np.zeros(len(pdf), bool), int(np.argmax(pdf["entry"].to_numpy()))
        while i < len(pdf) and own.iloc[i]:
            flags[i] = True
            i = int(following[i])
        return pdf.assign(starts=flags.astype("int64"))[own][["book_id", "page", "at", "records", "chars", "starts"]]

    marked = (haloed.join(reached.withColumn("entry", F.lit(True)), ["book_id", "at"], "left")
              .withColumn("entry", F.coalesce("entry", F.lit(False)) & (F.col("part") == F.col("blk")))
              .groupBy("book_id", "part").applyInPandas(
                  starts, "book_id string, page bigint, at bigint, records bigint, chars bigint, starts bigint"))
    numbered = split_running(marked, BOOK, [F.col("at")], position_block(F.col("at")), sums={"batch": F.col("starts")})
    return numbered.select(*PAGE, "records", "chars", (F.col("batch") - 1).cast("bigint").alias("batch"))


def rolling_context(records: DataFrame, size: int = 24) -> DataFrame:
    """The last `size` records before the start of each batch, oldest first, one row each.

    `records`: book_id, batch, page, boxno and the columns to carry.
    """
    order = [F.col("page"), F.col("boxno")]
    placed = materialise(split_row_number(records, BOOK, order, position_block(F.col("page")), "at"))
    first = placed.groupBy("book_id", "batch").agg(F.min("at").alias("start"))
    wanted = first.select("book_id", "batch", F.explode(F.sequence(F.greatest(F.col("start") - size, F.lit(0)), F.col("start") - 1)).alias("at"),
                          "start").where(F.col("at") < F.col("start"))
    return wanted.join(placed.drop("batch"), ["book_id", "at"]).withColumn("place", F.col("at") - F.greatest(F.col("start") - size, F.lit(0))).drop("at", "start")


def prior_translations(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Translated records of the pages before each requested page (`requests`: book_id, page)."""
    done = records.where(F.col("english_text").isNotNull()).alias("b")
    asked = requests.select("book_id", F.col("page").alias("for_page")).distinct().alias("a")
    return asked.join(done, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("b.page") < F.col("a.for_page"))).select(
        F.col("a.book_id").alias("book_id"), "for_page", "page", "boxno", "english_text")


def prior_index(records: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `prior_translations` gives, for all requested pages at once and as large as the input.

    Translated records with their place in the book (book_id, place, page, boxno, english_text), and for
    every requested page the number of them before it (book_id, for_page, until): the page's prior
    translations are the records with place < until. Records and requests are counted in one sorted
    run over blocks of pages, so a book of any length is no single task.
    """
    done = records.where(F.col("english_text").isNotNull()).select(*PAGE, "boxno", "english_text", F.lit(1).alias("one"))
    asked = requests.select(*PAGE).distinct().withColumns({"boxno": F.lit(None).cast("bigint"), "english_text": F.lit(None).cast("string"), "one": F.lit(0)})
    # a request stands before the records of its page
    order = [F.col("page"), F.asc_nulls_first("boxno")]
    counted = split_running(done.unionByName(asked), BOOK, order, position_block(F.col("page"), 256), sums={"before": F.col("one")}, include_current=False)
    numbered = counted.where("one = 1").select("book_id", F.col("before").cast("bigint").alias("place"), "page", "boxno", "english_text")
    return numbered, counted.where("one = 0").select("book_id", F.col("page").alias("for_page"), F.col("before").cast("bigint").alias("until"))


def notes_for_page(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Book note and page note of each page under fixed headings; blank ones are skipped.

    `notes`: book_id, page (null for the book), note.
    """
    clean = notes.withColumn("note", F.nullif(tx.strip(F.col("note")), F.lit(""))).where(F.col("note").isNotNull())
    book = clean.where(F.col("page").isNull()).groupBy("book_id").agg(F.max("note").alias("book_note"))
    own = clean.where(F.col("page").isNotNull()).groupBy(*PAGE).agg(F.max("note").alias("page_note"))
    joined = pages.select(*PAGE).join(book, "book_id", "left").join(own, list(PAGE), "left")
    parts = F.array_compact(F.array(
        F.concat(F.lit("Job translation notes:\n"), "book_note"),
        F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" translation notes:\n"), "page_note")))
    return joined.select(*PAGE, F.array_join(parts, "\n\n").alias("notes"))
