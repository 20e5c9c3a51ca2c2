"""Checking model answers against the expected keys and joining them to page records.

Every `apply_*` operator returns the accepted rows and an error table. A page with an error
yields no rows, the other pages are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import answer_json as aj
from boxloom.functions import geometry as geo
from boxloom.functions import text as tx
from boxloom.functions.staging import staged
from boxloom.operators.ranking import position_block, split_row_number
from boxloom.session import stored

PAGE = ("book_id", "page")
# Fixed values
REASONS = ("bubble", "caption_box", "bordered_box", "blank_text_area", "sign_label", "over_art",
           "over_face_body", "integrated_sfx", "unclear")
FILLS = ("black", "white")
NO_CHANGES, EMPTY_MARK = "<NO_CHANGES>", "<EMPTY>"


def answer_items(answers: DataFrame, keys: Sequence[str] = PAGE, cells: int = 0, names: Sequence[str] = ()) -> DataFrame:
    """One row per answer item; an unreadable or empty answer keeps one row without position.

    Adds `unreadable`, `pos`, `item`, `is_list`, `is_object`, `size` and the first values of
    a list item as `c0`, `c1`, ... with their kinds as `k0`, `k1`, ..., and the values of an object
    under `names` as `f_<name>`.
    """
    read = aj.read_rows(answers, keys)
    item = F.col("item")
    rows = read.select(*keys, F.col("items").isNull().alias("unreadable"), F.posexplode_outer("items").alias("pos", "item"))
    rows = staged(rows, __row=aj.values(item))
    is_list = F.col("__row").isNotNull()
    rows = staged(rows, __own=F.when(~is_list, aj.fields(item, names) if names else F.when(aj.is_object(item), F.struct(F.lit(1)))))
    return staged(rows, is_list=is_list, is_object=F.col("__own").isNotNull(), **{f"f_{n}": F.col(f"__own.{n}") for n in names},
                  size=F.when(is_list, F.size("__row")).otherwise(0),
                  **{n: c for i in range(cells) for n, c in (
                      (f"c{i}", F.get("__row", F.lit(i))), (f"k{i}", aj.kind(F.get("__row", F.lit(i)))))}).drop("__row", "__own")


def _error(code, key=None, pos=None) -> list[Column]:
    null = F.lit(None).cast("bigint")
    return [(code if isinstance(code, Column) else F.lit(code)).alias("code"),
            (null if key is None else key.cast("bigint")).alias("key"),
            (null if pos is None else pos.cast("bigint")).alias("pos")]


def open_only(records: DataFrame) -> DataFrame:
    """Records with open lettering; a missing mark is none."""
    return records.where(F.coalesce("open_lettering", F.lit(False)))


def non_open(records: DataFrame) -> DataFrame:
    """The records that `open_only` leaves."""
    return records.where(~F.coalesce("open_lettering", F.lit(False)))


def validate_keys(expected: DataFrame, items: DataFrame, keys: Sequence[str] = PAGE,
                  key: str = "boxno") -> DataFrame:
    """Unknown, repeated, wrong-page and missing keys, as (keys.., code, key, pos).

    `items` has `pos` and may have `item_page` (the page the answer claims) and `bad`
    (an error code of the item itself). Missing keys have no position.
    """
    keys = list(keys)
    cols = items.columns
    bad = F.col("bad") if "bad" in cols else F.lit(None).cast("string")
    wrong = (F.col("item_page") != F.col("page")) if "item_page" in cols else F.lit(False)
    items = items.withColumn("__bad", F.coalesce(bad, F.when(wrong, F.lit("wrong_page"))))
    own = items.where(F.col("__bad").isNotNull()).select(*keys, *_error(F.col("__bad"), F.col(key), F.col("pos")))
    good = items.where(F.col("__bad").isNull()).select(*keys, key, F.lit(False).alias("wanted"), F.col("pos").cast("bigint").alias("pos"))
    wanted = expected.select(*keys, key, F.lit(True).alias("wanted"), F.lit(None).cast("bigint").alias("pos"))
    # one shuffle for all verdicts; the positions of a key are no more than the items of one answer
    met = good.unionByName(wanted).groupBy(*keys, key).agg(F.bool_or("wanted").alias("wanted"), F.sort_array(F.collect_list("pos")).alias("at"))
    at, none = F.col("at"), F.array().cast("array<struct<code:string,pos:bigint>>")

    def each(positions: Column, code: str) -> Column:
        return F.transform(positions, lambda p: F.struct(F.lit(code).alias("code"), p.alias("pos")))

    missing = F.array(F.struct(F.lit("missing").alias("code"), F.lit(None).cast("bigint").alias("pos")))
    again = F.filter(at, lambda p: p > F.array_min(at))
    found = (F.when(F.col(key).isNull(), F.concat(each(at, "unknown"), F.when(F.col("wanted"), missing).otherwise(none)))
             .when(~F.col("wanted"), each(at, "unknown")).when(F.size(at) == 0, missing).otherwise(each(again, "duplicate")))
    rest = met.select(*keys, key, F.explode(found).alias("e")).select(*keys, *_error(F.col("e.code"), F.col(key), F.col("e.pos")))
    return own.unionByName(rest)


def first_error(errors: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """The error that is met first when reading an answer from the start; missing keys come last."""
    place = F.struct(F.coalesce("pos", F.lit(2 ** 62)), F.coalesce("key", F.lit(-1)), F.col("code"))
    return errors.groupBy(*keys).agg(F.min_by("code", place).alias("code"), F.count(F.lit(1)).alias("errors"))


def first_valid_attempt(attempts: DataFrame, errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per page the first attempt without an error, with the error of the attempt before it."""
    tried = attempts.select(*keys, "attempt").distinct()
    verdict = tried.join(first_error(errors, [*keys, "attempt"]), [*keys, "attempt"], "left")
    ok = F.when(F.col("code").isNull(), F.col("attempt"))
    chosen = verdict.groupBy(*keys).agg(F.min(ok).alias("attempt"), F.max("attempt").alias("last"))
    before = verdict.where(F.col("code").isNotNull()).select(
        *keys, (F.col("attempt") + 1).alias("__next"), F.col("code").alias("previous_error"))
    joined = chosen.withColumn("__next", F.coalesce("attempt", F.col("last") + 1)).join(before, [*keys, "__next"], "left")
    return joined.select(*keys, "attempt", F.col("attempt").isNull().alias("failed"), "previous_error")


def by_merge(rows: DataFrame) -> DataFrame:
    """Rows to be met in a sort-merge join. Sizes that are told from a plan with variants (2048 bytes each, by
    the optimizer's rule) shrink with every step that drops one, down to where all rows of all pages are broadcast.
    """
    return rows.hint("merge")


def _accept(rows: DataFrame, errors: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    return rows.join(by_merge(errors.select(*keys).distinct()), list(keys), "left_anti")


def _finish(expected: DataFrame, parsed: DataFrame, key: str = "boxno",
            keys: Sequence[str] = PAGE, held: bool = False) -> tuple[DataFrame, DataFrame]:
    """Store the parsed items once (unless `held`), check their keys, and split accepted rows from errors."""
    parsed = parsed if held else stored(parsed)  # read back, its size is that of its files
    broken = parsed.where("unreadable").select(*keys, *_error("invalid_json"))
    items = parsed.where(F.col("pos").isNotNull()).drop("unreadable")
    # a page whose answer cannot be read has that one error, not one per missing key
    errors = validate_keys(expected, items, keys, key).join(by_merge(broken.select(*keys)), list(keys), "left_anti")
    errors = errors.unionByName(broken)
    return _accept(items, errors, keys), errors


# structure -------------------------------------------------------------------------------

def apply_structure(groups: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order, keep or reject groups as the answer says and number the kept ones anew.

    `groups`: book_id, page, boxno, source_boxnos, text and any further columns, which stay.
    """
    names = ("mergedBoxno", "boxno", "sourceBoxnos", "reject", "sfx", "openLettering", "textCorrection", "text")
    read = answer_items(answers, cells=5, names=names)
    read = staged(read, word=F.lower(tx.strip(aj.as_text(F.col("c1"), F.col("k1"))))).withColumn(
        "listed", F.col("is_list") & F.coalesce(F.col("word").isin("text", "sfx", "reject"), F.lit(False)))
    obj, listed, size, word = F.col("is_object"), F.col("listed"), F.col("size"), F.col("word")
    compact = F.col("is_list") & ~listed

    def optional(name: str, default: bool) -> Column:
        return F.when(F.col(f"f_{name}").isNotNull(), aj.as_bool(F.col(f"f_{name}"))).otherwise(F.lit(default))

    def not_text(value: Column, allow_null: bool) -> Column:
        return value.isNotNull() & ~aj.kind(value).isin("STRING", *(["VOID"] if allow_null else []))

    fourth_text = F.col("k3") == "STRING"
    given_open = (F.when(compact & ((size >= 5) | ((size == 4) & ~fourth_text)), aj.as_bool(F.col("c3"), F.col("k3")))
                  .when(obj, optional("openLettering", False)).otherwise(F.lit(False)))
    fix = (F.when(listed, aj.as_text(F.col("c2"), F.col("k2"))).when(compact & (size >= 5), aj.as_text(F.col("c4"), F.col("k4")))
           .when(compact & (size == 4), aj.as_text(F.col("c3"), F.col("k3")))
           .when(obj, F.coalesce(F.nullif(tx.strip(aj.as_text(F.col("f_textCorrection"))), F.lit("")),
                                 aj.as_text(F.col("f_text")))))
    key = (F.when(F.col("is_list"), aj.as_index(F.col("c0"), F.col("k0")))
           .when(F.col("f_mergedBoxno").isNotNull(), aj.as_index(F.col("f_mergedBoxno")))
           .when(F.col("f_boxno").isNotNull(), aj.as_index(F.col("f_boxno"))))
    by_sources = obj & F.col("f_mergedBoxno").isNull() & F.col("f_boxno").isNull()
    typed = read.select(
        *PAGE, "unreadable", "pos", key.alias("key"),
        F.when(by_sources, F.transform(aj.values(F.col("f_sourceBoxnos")), aj.as_plain_index)).alias("refs"),
        F.when(listed, word == "reject").when(compact, aj.as_bool(F.col("c1"), F.col("k1"))).when(obj, optional("reject", False)).alias("reject"),
        F.when(listed, word == "sfx").when(compact & (size >= 3), aj.as_bool(F.col("c2"), F.col("k2")))
        .when(obj, aj.as_bool(F.col("f_sfx"))).alias("sfx"),
        given_open.alias("open"), F.nullif(tx.strip(fix), F.lit("")).alias("fix"),
        (obj | (F.col("is_list") & (size >= 2))).alias("shaped"), (listed & (size > 3)).alias("long"),
        ((listed & not_text(F.col("c2"), False))
         | (obj & ~optional("reject", False) & (not_text(F.col("f_textCorrection"), True) | not_text(F.col("f_text"), True)))).alias("wrong_text"))
    typed = stored(typed)
    asked = typed.where(F.col("refs").isNotNull())
    named = asked.limit(1).count() > 0  # only items without a number meet the sources of the groups
    if named:
        lookup = groups.groupBy(*PAGE, F.col("source_boxnos").alias("refs")).agg(F.max("boxno").alias("by_sources"))
        found = asked.join(by_merge(lookup), [*PAGE, "refs"], "left")
        typed = found.unionByName(typed.where(F.col("refs").isNull()), allowMissingColumns=True)
    typed = typed.withColumn("boxno", F.coalesce("key", "by_sources") if named else F.col("key"))
    kept = ~F.col("reject")
    bad = (F.when(~F.coalesce("shaped", F.lit(False)), "bad_row").when(F.col("boxno").isNull(), "bad_key")
           .when(F.col("long"), "bad_row").when(F.col("reject").isNull(), "bad_value")
           .when(kept & (F.col("sfx").isNull() | F.col("open").isNull()), "bad_value")
           .when(F.col("wrong_text"), "bad_value"))
    parsed = typed.select(*PAGE, "unreadable", "pos", "boxno", "reject", "sfx", "open", "fix", bad.alias("bad"))
    accepted, errors = _finish(groups, parsed, held=not named)
    rows = (accepted.where(kept).select(*PAGE, "boxno", "pos", "sfx", F.col("open").alias("open_lettering"), "fix")
            .join(by_merge(groups), [*PAGE, "boxno"], "inner"))
    rows = rows.withColumn("text", F.coalesce("fix", "text")).drop("fix", "boxno")
    rows = split_row_number(rows, PAGE, [F.col("pos")], position_block(F.col("pos")), "boxno").drop("pos")
    return rows, errors


def drop_untranslatable(structured: DataFrame, source: str, target: str = "en") -> DataFrame:
    """Keep records whose text needs translation and number them anew."""
    kept = structured.where(tx.needs_translation(F.col("text"), source, target)).withColumnRenamed("boxno", "__old")
    return split_row_number(kept, PAGE, [F.col("__old")], position_block(F.col("__old")), "boxno").drop("__old")


# erase decisions -------------------------------------------------------------------------

def erase_reason(value: Column, safe: Column) -> Column:
    code = F.when(aj.kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    named = F.translate(F.lower(tx.strip(aj.as_text(value))), "- ", "__")
    by_code = F.get(F.array(*[F.lit(r) for r in REASONS]), F.when(code.between(0, len(REASONS) - 1), code).cast("int"))
    return F.coalesce(by_code, F.when(named.isin(*REASONS), named),
                      F.when(safe, F.lit("blank_text_area")).otherwise(F.lit("unclear")))


def apply_erase(structured: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, page, boxno, safe_to_erase, open_lettering, reason) and errors."""
    read = aj.read_rows(answers, PAGE)
    counts = structured.groupBy(*PAGE).agg(F.count_distinct("boxno").alias("__n"))
    head = F.get("items", F.lit(0))
    # one record: its row may come without the outer array
    flat = (F.col("__n") == 1) & (F.size("items") > 0) & ~aj.is_array(head) & ~aj.is_object(head)
    read = read.join(by_merge(counts), list(PAGE), "left").withColumn("flat", F.coalesce(flat, F.lit(False)))
    names = ("page", "boxno", "safeToEraseOriginal", "needsAlternatePlacement", "openLettering", "reason", "altPlacementReason")
    item = F.col("item")
    read = (read.select(*PAGE, "items", "flat", F.posexplode_outer(
                F.when(F.col("flat"), F.slice("items", 1, 1)).otherwise(F.col("items"))).alias("pos", "item"))
            .transform(lambda d: staged(d, row=F.when(F.col("flat"), F.col("items")).otherwise(aj.values(item))))
            .transform(lambda d: staged(d, own=F.when(F.col("row").isNull(), aj.fields(item, names))))
            .select(*PAGE, F.col("items").isNull().alias("unreadable"), "pos", F.col("own").isNotNull().alias("is_object"), "row",
                    *[F.get("row", F.lit(i)).alias(f"c{i}") for i in range(3)],
                    *[F.col(f"own.{n}").alias(f"f_{n}") for n in names]))
    obj, is_list = F.col("is_object"), F.col("row").isNotNull()
    read = read.select(
        *PAGE, "unreadable", "pos", (obj | (is_list & (F.size("row") >= 2))).alias("shaped"),
        F.when(is_list, aj.as_index(F.col("c0"))).otherwise(aj.as_index(F.col("f_boxno"))).alias("boxno"),
        F.when(F.col("f_page").isNotNull(), F.coalesce(aj.as_index(F.col("f_page")), F.lit(-1)))
        .otherwise(F.col("page")).alias("item_page"),
        F.when(is_list, aj.as_bool(F.col("c1")))
        .when(F.col("f_safeToEraseOriginal").isNotNull(), aj.as_bool(F.col("f_safeToEraseOriginal")))
        .when(F.col("f_needsAlternatePlacement").isNotNull(), ~aj.as_bool(F.col("f_needsAlternatePlacement")))
        .otherwise(~aj.as_bool(F.col("f_openLettering"))).alias("safe_to_erase"),
        F.when(is_list, F.col("c2")).when(F.col("f_reason").isNotNull(), F.col("f_reason"))
        .otherwise(F.col("f_altPlacementReason")).alias("given_reason"))
    bad = (F.when(~F.coalesce("shaped", F.lit(False)), "bad_row").when(F.col("boxno").isNull(), "bad_key")
           .when(F.col("safe_to_erase").isNull(), "bad_value"))
    parsed = read.select(*PAGE, "unreadable", "pos", "boxno", "item_page", "safe_to_erase",
                         erase_reason(F.col("given_reason"), F.col("safe_to_erase")).alias("reason"), bad.alias("bad"))
    accepted, errors = _finish(structured, parsed)
    return accepted.select(*PAGE, "boxno", "safe_to_erase", (~F.col("safe_to_erase")).alias("open_lettering"),
                           "reason"), errors


def default_erase(structured: DataFrame, reason: str = "disabled") -> DataFrame:
    return structured.select(*PAGE, "boxno", F.lit(True).alias("safe_to_erase"),
                             F.lit(False).alias("open_lettering"), F.lit(reason).alias("reason"))


def hydrate_erase(structured: DataFrame, answers: DataFrame) -> DataFrame:
    """Take saved decisions page by page; where they do not fit, derive them from the records.

    `structured` has nullable open_lettering, safe_to_erase and reason.
    """
    accepted, errors = apply_erase(structured, answers)
    answered = answers.select(*PAGE).distinct().join(by_merge(errors.select(*PAGE).distinct()), list(PAGE), "left_anti")
    fresh = accepted.select(*PAGE, "boxno", F.col("safe_to_erase").alias("a_safe"),
                            F.col("open_lettering").alias("a_open"), F.col("reason").alias("a_reason"))
    joined = structured.join(by_merge(answered.withColumn("__ok", F.lit(True))), list(PAGE), "left").join(
        by_merge(fresh), [*PAGE, "boxno"], "left")
    own_open = F.coalesce(F.col("open_lettering"), ~F.col("safe_to_erase"), F.lit(False))
    own_reason = F.coalesce("reason", F.when(own_open, F.lit("unclear")).otherwise(F.lit("blank_text_area")))
    ok = F.col("__ok").isNotNull()
    others = [c for c in structured.columns if c not in ("safe_to_erase", "open_lettering", "reason")]
    return joined.select(*others, F.when(ok, F.col("a_safe")).otherwise(~own_open).alias("safe_to_erase"),
                         F.when(ok, F.col("a_open")).otherwise(own_open).alias("open_lettering"),
                         F.when(ok, F.col("a_reason")).otherwise(own_reason).alias("reason"))


# translations ----------------------------------------------------------------------------

def attach_translations(structured: DataFrame, answers: DataFrame,
                        require_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(translations, errors, warnings about echoed source text that differs)."""
    read = answer_items(answers, cells=4, names=("page", "boxno", "text", "englishText"))
    read = read.withColumn("keyed", F.col("is_list") & (F.col("size") >= 3) & (F.col("k0") == "BIGINT")
                           & (F.col("k1") == "BIGINT"))
    is_list, obj, size, keyed = F.col("is_list"), F.col("is_object"), F.col("size"), F.col("keyed")
    typed = read.select(
        *PAGE, "unreadable", "pos", (obj | (is_list & (size >= 2))).alias("shaped"),
        F.when(keyed, F.coalesce(aj.as_index(F.col("c0"), F.col("k0")), F.lit(-1)))
        .when(F.col("f_page").isNotNull(), F.coalesce(aj.as_index(F.col("f_page")), F.lit(-1)))
        .otherwise(F.col("page")).alias("item_page"),
        F.when(keyed, aj.as_index(F.col("c1"), F.col("k1"))).when(is_list, aj.as_index(F.col("c0"), F.col("k0")))
        .otherwise(aj.as_index(F.col("f_boxno"))).alias("boxno"),
        F.when(keyed & (size >= 4), aj.as_text(F.col("c3"), F.col("k3"))).when(keyed, aj.as_text(F.col("c2"), F.col("k2")))
        .when(is_list, aj.as_text(F.col("c1"), F.col("k1"))).otherwise(aj.as_text(F.col("f_englishText"))).alias("english_text"),
        F.when(keyed & (size >= 4), aj.as_text(F.col("c2"), F.col("k2"))).when(obj, aj.as_text(F.col("f_text"))).alias("echo"))
    bad = (F.when(~F.coalesce("shaped", F.lit(False)), "bad_row").when(F.col("boxno").isNull(), "bad_key")
           .when(F.col("english_text").isNull(), "bad_value")
           .when((tx.strip(F.col("english_text")) == "") & F.lit(require_text), "empty_translation"))
    accepted, errors = _finish(structured, typed.withColumn("bad", bad).drop("shaped"))
    joined = accepted.join(by_merge(structured.select(*PAGE, "boxno", "text")), [*PAGE, "boxno"], "inner")
    warnings = joined.where(F.col("echo") != F.col("text")).select(*PAGE, "boxno", "echo", "text")
    return joined.select(*PAGE, "boxno", "text", "english_text"), errors, warnings


def apply_corrections(batches: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace texts by `row<TAB>text` lines of a reply; rows that are not listed stay.

    `batches`: batch keys book_id, batch, row_no, english_text and further columns;
    `replies`: book_id, batch, raw.
    """
    keys = ["book_id", "batch"]
    body = replies.select(*keys, tx.strip_fences(F.col("raw")).alias("body"))
    listed = (body.where((F.col("body") != NO_CHANGES) & (F.col("body") != ""))
              .select(*keys, F.posexplode(tx.lines(F.col("body"))).alias("pos", "line")))
    parts = F.split("line", "\t", 2)
    number = tx.strip(F.get(parts, 0))
    value = tx.strip(F.get(parts, 1))
    read = listed.select(
        *keys, "pos", F.when(F.rlike(number, F.lit(r"^[+-]?[0-9]+$")), number.try_cast("bigint")).alias("row_no"),
        value.alias("fix"), F.size(parts).alias("n"))
    bad = (F.when(F.col("n") < 2, "bad_line").when(F.col("row_no").isNull(), "bad_row_number")
           .when(F.col("fix") == "", "empty_text").when(F.col("fix") == EMPTY_MARK, "removed_text"))
    parsed = read.withColumn("bad", bad)
    wanted = batches.select(*keys, "row_no").distinct()
    errors = validate_keys(wanted, parsed, keys, "row_no").where("code <> 'missing'")
    empty = body.where(F.col("body") == "").select(*keys, *_error("empty_reply"))
    fixed = parsed.where(F.col("bad").isNull()).groupBy(*keys, "row_no").agg(F.min_by("fix", "pos").alias("fix"))
    merged = (batches.join(body.select(*keys), keys, "left_semi").join(fixed, [*keys, "row_no"], "left")
              .withColumn("english_text", F.coalesce("fix", "english_text")).drop("fix"))
    blank = (merged.where(F.coalesce(tx.strip(F.col("english_text")), F.lit("")) == "")
             .select(*keys, *_error("no_translation", F.col("row_no"))))
    errors = errors.unionByName(empty).unionByName(blank)
    return _accept(merged, errors, keys), errors


# placements and styles -------------------------------------------------------------------

def open_labels(structured: DataFrame) -> DataFrame:
    """Open records with a label counted from 0 on each page."""
    return split_row_number(structured.where("open_lettering"), PAGE, [F.col("boxno")],
                            position_block(F.col("boxno")), "label")


def apply_open_placements(structured: DataFrame, answers: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers name labels of the open records; give back box numbers and pixel regions.

    `pages`: book_id, page, width, height.
    """
    labelled = open_labels(structured).select(*PAGE, "label", "boxno")
    read = answer_items(answers, cells=2, names=("page", "label", "box_2d"))
    typed = read.select(
        *PAGE, "unreadable", "pos", (F.col("is_object") | (F.col("is_list") & (F.col("size") >= 2))).alias("shaped"),
        F.when(F.col("is_list"), aj.as_index(F.col("c0"), F.col("k0"))).otherwise(aj.as_index(F.col("f_label"))).alias("label"),
        aj.as_numbers(F.when(F.col("is_list"), F.col("c1")).otherwise(F.col("f_box_2d"))).alias("box_2d"),
        F.when(F.col("f_page").isNotNull(), F.coalesce(aj.as_index(F.col("f_page")), F.lit(-1)))
        .otherwise(F.col("page")).alias("item_page"))
    bad = (F.when(~F.coalesce("shaped", F.lit(False)), "bad_row").when(F.col("label").isNull(), "bad_key")
           .when(F.col("box_2d").isNull() | ~geo.thousandths_valid(F.col("box_2d")), "bad_box"))
    accepted, errors = _finish(labelled, typed.withColumn("bad", bad).drop("shaped"), key="label")
    joined = accepted.join(by_merge(labelled), [*PAGE, "label"]).join(by_merge(pages.select(*PAGE, "width", "height")), list(PAGE))
    g = geo.thousandths_to_region(F.col("box_2d"), F.col("width"), F.col("height"))
    return joined.select(*PAGE, "boxno", "box_2d", *g.columns(("pl", "pt", "pr", "pb"))), errors


def font_file(value: Column) -> Column:
    name = F.trim(tx.strip(value), F.lit("[]"))
    return F.regexp_extract(name, r"[^/]*$", 0)


def apply_styles(structured: DataFrame, answers: DataFrame, fonts: DataFrame, backup_font: str) -> tuple[DataFrame, DataFrame]:
    """Font and fill of every record; `fonts` holds the allowed names in `font`."""
    read = answer_items(answers, cells=3, names=("page", "boxno", "font", "fill", "color", "colour"))
    font = aj.as_text(F.when(F.col("is_list"), F.col("c1")).otherwise(F.col("f_font")))
    fill = aj.as_text(F.when(F.col("is_list"), F.col("c2")).otherwise(F.coalesce("f_fill", "f_color", "f_colour")))
    read = read.select(
        *PAGE, "unreadable", "pos",
        F.when(F.col("is_list"), aj.as_index(F.col("c0"), F.col("k0"))).otherwise(aj.as_index(F.col("f_boxno"))).alias("boxno"),
        F.when(F.col("f_page").isNotNull(), F.coalesce(aj.as_index(F.col("f_page")), F.lit(-1)))
        .otherwise(F.col("page")).alias("item_page"),
        F.nullif(tx.strip(font), F.lit("")).alias("asked"), F.lower(tx.strip(fill)).alias("fill"),
        (F.col("is_object") | (F.col("is_list") & (F.col("size") >= 3))).alias("shaped"))
    allowed = fonts.select(F.col("font").alias("file"), F.lit(True).alias("known")).distinct()
    wanted = F.trim("asked", F.lit("[]"))
    read = read.withColumn("file", font_file(F.col("asked"))).join(allowed, "file", "left")
    chosen = (F.when(F.col("asked").isNull() | (wanted == backup_font), F.lit(backup_font))
              .when(F.col("known"), F.col("file")))
    bad = (F.when(~F.coalesce("shaped", F.lit(False)), "bad_row").when(F.col("boxno").isNull(), "bad_key")
           .when(chosen.isNull(), "bad_font").when(~F.coalesce(F.col("fill").isin(*FILLS), F.lit(False)), "bad_fill"))
    parsed = read.select(*PAGE, "unreadable", "pos", "boxno", "item_page", chosen.alias("font"), "fill", bad.alias("bad"))
    accepted, errors = _finish(structured, parsed)
    return accepted.select(*PAGE, "boxno", "font", "fill"), errors


# requests --------------------------------------------------------------------------------

def answer_requests(requests: DataFrame, provider: Callable, schema: str) -> DataFrame:
    """Answers from a user function over request batches (an iterator of pandas frames)."""
    return requests.mapInPandas(provider, schema)
