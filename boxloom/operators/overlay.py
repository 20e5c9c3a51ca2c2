"""Field-level edits over generated records: overlays, lineage, protection, staleness.

Edits are one long table: book_id, page, stage, artifact, kind, record_id, field, value,
protected, l..b (region of a deleted record), ordinal (place in a saved order), record
(struct of an added or frozen record). `kind` is field, added, deleted, order or freeze.
Records are tables keyed by (book_id, page, record_id) with a position column `pos`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as geo
from boxloom.operators.group import PAGE, SIDES, near_pairs
from boxloom.operators.ranking import position_block, split_row_number, written_row_number
from boxloom.session import materialise, stored, written

ID = (*PAGE, "record_id")
# Stages in order, what each owns, what may be edited, where a rerun starts
STAGES = ("ocr", "structure", "erase", "translation", "placement")
TEXT_STAGES = ("structure", "erase", "translation")
STAGE_ARTIFACTS = {
    "ocr": ("ocr_raw", "ocr_merged"), "structure": ("ocr_structured",), "erase": ("ocr_structured", "alt_placement"),
    "translation": ("translations",), "placement": ("placements", "clean_boxes"),
}
RERUN_FROM = {"ocr": "ocr_structured", "structure": "alt_placement", "erase": "translations",
              "translation": "placements", "placement": "render"}
EDITABLE = {
    ("structure", "ocr_structured"): ("text", "sfx", "reject", "region", "sourceBoxnos", "sourceTexts"),
    ("erase", "ocr_structured"): ("openLettering", "safeToEraseOriginal", "altPlacementReason"),
    ("translation", "translations"): ("englishText", "text"),
    ("placement", "clean_boxes"): ("region",),
    ("placement", "placements"): ("placementRegion", "box_2d", "font", "fill", "stroke", "strokeWidth", "gravity",
                                  "fontSizeWidthPercent", "manualLineBreaks", "lineSpacing", "minPointSize",
                                  "maxPointSize", "rotation", "skewX", "skewY"),
}


# Names of fields that a table holds under another name
COLUMNS_OF = {"region": SIDES, "placementRegion": ("pl", "pt", "pr", "pb"), "safeToEraseOriginal": ("safe_to_erase",),
              "altPlacementReason": ("reason",)}
# artifacts in the order in which a saved number is looked for
SAVED_IN = ("placements", "translations", "alt_placement")


def editable_columns(stage: str, artifact: str, columns: Sequence[str]) -> list[str]:
    """Those of `columns` that a stage may edit in an artifact; all of them where no rule is given."""
    if (stage, artifact) not in EDITABLE:
        return list(columns)
    allowed: set[str] = set()
    for name in EDITABLE[stage, artifact]:
        allowed |= set(COLUMNS_OF.get(name, ())) | {name, re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()}
    return [c for c in columns if c in allowed]


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)


def _stages_of(artifact: str, through: str | None = None) -> list[str]:
    last = STAGES.index(through) if through else len(STAGES) - 1
    return [s for s in STAGES[:last + 1] if artifact in STAGE_ARTIFACTS[s]]


# record ids ------------------------------------------------------------------------------

def canonical_text(value: Column) -> Column:
    """A JSON string literal that keeps characters outside ASCII."""
    return F.when(value.isNull(), F.lit("null")).otherwise(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))


def canonical_numbers(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ","), F.lit("]"))


def record_id(artifact: str, page: Column, boxno: Column, sources: Column | None = None,
              region: Column | None = None, text: Column | None = None) -> Column:
    """Stable id: prefix and 16 hex digits of the hash of page and identity as compact JSON."""
    number = boxno.cast("string")
    if artifact == "ocr_raw":
        prefix, parts = "raw", [number, canonical_numbers(region), canonical_text(text)]
    elif artifact == "ocr_merged":
        prefix, parts = "group", [canonical_numbers(sources), number]
    else:
        prefix, parts = "text", [number, canonical_numbers(sources)]
    identity = F.concat(F.lit("["), page.cast("string"), F.lit(",["), F.concat_ws(",", *parts), F.lit("]]"))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(identity, 256), 1, 16))


def record_signature(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """SHA-256 per page of the records in order, restricted to the fields of a stage.

    A tree of three levels: the hash of a record (its fields as JSON, in the order of their names), of a
    block of 4096 positions (lines `position:hash`) and of the page (lines `block:hash`). Only a block's
    hashes meet in one row, and only one hash per block in the row of a page. Any changed, moved,
    repeated or lost record gives another signature. Records of equal positions go by their hashes.
    """
    def over(column: str, hash_of: str) -> Column:
        lines = F.transform(F.sort_array(F.collect_list(F.struct(column, hash_of))), lambda x: F.concat(x[column].cast("string"), F.lit(":"), x[hash_of]))
        return F.sha2(F.array_join(lines, "\n"), 256)

    record = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    leaves = records.select(*PAGE, "pos", position_block(F.col("pos")).alias("block"), record.alias("h"))
    blocks = leaves.groupBy(*PAGE, "block").agg(over("pos", "h").alias("h"))
    return blocks.groupBy(*PAGE).agg(over("block", "h").alias("signature"))


# overlay ---------------------------------------------------------------------------------

def tombstone_antijoin(records: DataFrame, deleted: DataFrame, by_region: bool, protected_only: bool = False,
                       iou: float = 0.5) -> DataFrame:
    """Drop records that were deleted by id, or (raw detections) cover a deleted region."""
    marks = deleted.where("protected") if protected_only else deleted
    kept = records.join(marks.select(*ID).distinct(), list(ID), "left_anti")
    if not by_region:
        return kept
    regions = marks.where(F.col("l").isNotNull()).select(*PAGE, *SIDES).distinct()
    hits = near_pairs(kept.select(*ID, *SIDES), regions, PAGE, geo.iou(geo.region("a"), geo.region("b")) >= iou)
    gone = hits.select(*[F.col(f"a.{k}").alias(k) for k in ID]).distinct()
    return kept.join(gone, list(ID), "left_anti")


def written_value(value: Column, kind: str) -> Column:
    """A field as the text of an edit: arrays and structs as JSON, other values as they print."""
    return F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string")


def read_value(text: Column, kind: str) -> Column:
    """The text of an edit as a value of a column; null if it is none of that type."""
    if kind.startswith(("array", "struct", "map")):
        return F.try_variant_get(F.try_parse_json(text), "$", kind)
    return text.try_cast(kind)


def unreadable_edits(base: DataFrame, edits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Field edits that name another field than `fields`, or whose value is none of the type of the field."""
    types = dict(base.dtypes)
    known = F.col("field").isin(*fields)
    bad = F.lit(False)
    for f in fields:
        bad = bad | ((F.col("field") == f) & F.col("value").isNotNull() & read_value(F.col("value"), types[f]).isNull())
    code = F.when(~F.coalesce(known, F.lit(False)), "unknown_field").when(bad, "bad_value")
    return edits.where("kind = 'field'").select(*ID, "field", "value", code.alias("code")).where(F.col("code").isNotNull())


def saved_order(records: DataFrame, order: DataFrame, bucket: int = 4096) -> DataFrame:
    """Listed ids by their place, the others after them, as they were. Sets `pos` anew.

    `order`: book_id, page, record_id, ordinal. Pages without a saved order keep theirs.
    """
    place = order.groupBy(*ID).agg(F.max("ordinal").alias("__place"))
    joined = records.join(place, list(ID), "left").withColumnRenamed("pos", "__old")
    listed = F.col("__place").isNotNull()
    keys = [(~listed).cast("int"), F.coalesce("__place", "__old"), F.col("__old")]
    block = F.when(listed, position_block(F.col("__place"), bucket)).otherwise(
        F.lit(1 << 40) + position_block(F.col("__old"), bucket))
    return split_row_number(joined, PAGE, keys, block, "pos").drop("__place", "__old")


def apply_overrides(base: DataFrame, edits: DataFrame, artifact: str, fields: Sequence[str],
                    protected_only: bool = False) -> DataFrame:
    """One stage's edits over base records. A frozen page takes its snapshot and nothing else.

    `edits` holds one stage and artifact; added and frozen records are in the struct column
    `record`, whose fields are the columns of `base` without the page key. The edits of a
    record are folded to one row first, so records and edits meet in a single join. Array and
    struct fields are edited with JSON values; `unreadable_edits` names values that become null.
    A freeze without a record id freezes a page with no records.
    """
    own = [c for c in base.columns if c not in PAGE]
    values = [c for c in own if c not in ("record_id", "pos")]
    types = dict(base.dtypes)
    live = edits.where("protected") if protected_only else edits
    if artifact == "ocr_raw":
        base = tombstone_antijoin(base, live.where("kind = 'deleted'"), by_region=True)
    kind = F.col("kind")
    per_record = live.groupBy(*ID).agg(
        F.max(F.when(kind == "deleted", True)).alias("e_deleted"), F.max(F.when(kind == "added", F.col("record"))).alias("e_added"),
        F.max(F.when(kind == "freeze", F.col("record"))).alias("e_frozen"), F.max(F.when(kind == "order", F.col("ordinal"))).alias("e_place"),
        *[c for f in fields for c in (
            F.max(F.when((kind == "field") & (F.col("field") == f), True)).alias(f"has_{f}"),
            F.max(F.when((kind == "field") & (F.col("field") == f), F.col("value"))).alias(f"new_{f}"))])
    frozen_pages = live.where("kind = 'freeze'").select(*PAGE).distinct().withColumn("e_page", F.lit(True))
    joined = (base.withColumn("e_base", F.lit(True)).join(per_record, list(ID), "full_outer")
              .join(frozen_pages, list(PAGE), "left"))
    frozen = F.col("e_page").isNotNull()
    kept = F.col("e_base").isNotNull() & F.col("e_deleted").isNull()
    added = F.col("e_added").isNotNull()
    present = F.when(frozen, F.col("e_frozen").isNotNull()).otherwise(kept | added)

    def value(name: str) -> Column:
        plain = F.col(name)
        if name in fields:
            plain = F.when(F.col(f"has_{name}"), read_value(F.col(f"new_{name}"), types[name])).otherwise(plain)
        return F.when(frozen, F.col(f"e_frozen.{name}")).when(added, F.col(f"e_added.{name}")).otherwise(plain).alias(name)

    listed = ~frozen & F.col("e_place").isNotNull()
    tier = F.when(listed, 0).when(frozen | kept, 1).otherwise(2)
    place = (F.when(listed, F.col("e_place")).when(frozen, F.col("e_frozen.pos")).when(kept, F.col("pos"))
             .otherwise(F.col("e_added.pos")).cast("bigint"))
    old = F.when(kept, F.col("pos")).otherwise(F.lit(1 << 60))
    rows = joined.where(present).select(*ID, tier.alias("e_tier"), place.alias("e_at"), old.alias("e_old"), *[value(c) for c in values])
    keys = [F.col("e_tier"), F.col("e_at"), F.col("e_old"), F.col("record_id")]
    block = F.col("e_tier") * F.lit(1 << 44) + position_block(F.col("e_at"))
    return written_row_number(rows, PAGE, keys, block, "pos").select(*PAGE, *own)


def effective_records(base: DataFrame, edits: DataFrame, artifact: str, fields_by_stage: dict[str, Sequence[str]],
                      protected_only: bool = False, through_stage: str | None = None) -> DataFrame:
    """Edits of every stage that owns the artifact, in stage order."""
    def one(records: DataFrame, stage: str) -> DataFrame:
        # the result of the stage before is written once, not planned again by each reader
        records = records if records is base else materialise(records)
        part = edits.where((F.col("stage") == stage) & (F.col("artifact") == artifact))
        return apply_overrides(records, part, artifact, fields_by_stage[stage], protected_only)
    return reduce(one, _stages_of(artifact, through_stage), base)


def diff_overrides(base: DataFrame, submitted: DataFrame, old: DataFrame, fields: Sequence[str],
                   stage: str = "", artifact: str = "") -> DataFrame:
    """Edits that lead from `base` to `submitted`: (book_id, page, kind, record_id, field, value, protected, l..b).

    Of `fields`, only those that `stage` may edit in `artifact` give field edits; added records carry them all.

    A value that was unprotected and did not change stays unprotected; everything else is
    protected. Deleted ids that no longer occur anywhere are kept from `old`.
    """
    types = dict(base.dtypes)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*ID, F.col("pos").alias(f"{tag}_pos"), F.struct(*[written_value(F.col(f), types[f]).alias(f) for f in fields]).alias(tag),
                         F.struct(*SIDES, "source").alias(f"{tag}_at"))

    both = side(base, "x").join(side(submitted, "y"), list(ID), "full_outer")
    both = written(both)  # read by every branch below
    in_base, in_new = F.col("x").isNotNull(), F.col("y").isNotNull()
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("was"), F.col(f"y.{f}").alias("value"))
                      for f in editable_columns(stage, artifact, fields)])
    changed = (both.where(in_base & in_new).select(*ID, F.explode(pairs).alias("c"))
               .select(*ID, "c.field", "c.was", "c.value").where(~F.col("was").eqNullSafe(F.col("value"))))
    prior = old.where("kind = 'field'").groupBy(*ID, "field").agg(F.max("value").alias("o_value"), F.max("protected").alias("o_protected"))
    null = F.lit(None).cast("bigint")
    empty = [null.alias(s) for s in SIDES]
    no_field = [F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")]
    field_rows = changed.join(prior, [*ID, "field"], "left").select(
        *PAGE, F.lit("field").alias("kind"), "record_id", "field", "value",
        (~F.coalesce(F.col("o_value").eqNullSafe(F.col("value")) & ~F.col("o_protected"), F.lit(False))).alias("protected"), *empty)

    def state(kind: str) -> DataFrame:
        return old.where(F.col("kind") == kind).groupBy(*ID).agg(
            F.max("protected").alias("o_protected"), F.max(F.struct(*SIDES)).alias("o_at"), F.max("value").alias("o_value"))

    body = F.to_json("y")
    added = both.where(~in_base).join(state("added"), list(ID), "left").select(
        *PAGE, F.lit("added").alias("kind"), "record_id", no_field[0], body.alias("value"),
        (~F.coalesce((F.col("o_value") == body) & ~F.col("o_protected"), F.lit(False))).alias("protected"), *empty)
    manual = F.coalesce(F.col("x_at.source").isin("manual", "manual_crop"), F.lit(False))
    deleted = both.where(~in_new).join(state("deleted"), list(ID), "left").select(
        *PAGE, F.lit("deleted").alias("kind"), "record_id", *no_field, F.coalesce("o_protected", F.lit(True)).alias("protected"),
        *[F.when(~manual, F.col(f"x_at.{s}").cast("bigint")).alias(s) for s in SIDES])
    gone = state("deleted").join(both.select(*ID), list(ID), "left_anti").select(
        *PAGE, F.lit("deleted").alias("kind"), "record_id", *no_field, F.col("o_protected").alias("protected"),
        *[F.col(f"o_at.{s}").cast("bigint").alias(s) for s in SIDES])
    # the order changed when a page lists other ids, or the common ids in another sequence
    seq = both.where(in_base | in_new)
    base_no = written_row_number(seq.where(in_base).select(*ID, "x_pos"), PAGE, [F.col("x_pos")], position_block(F.col("x_pos")), "i", held=True)
    new_no = written_row_number(seq.where(in_new).select(*ID, "y_pos"), PAGE, [F.col("y_pos")], position_block(F.col("y_pos")), "j", held=True)
    new_no = written(new_no.select(*ID, "j"))  # read by every branch below
    lined = base_no.select(*ID, "i").join(new_no, list(ID), "full_outer")
    moved = lined.groupBy(*PAGE).agg(F.max((~F.col("i").eqNullSafe(F.col("j"))).cast("int")).alias("m")).where("m = 1").select(*PAGE)
    listed = written(new_no.join(moved, list(PAGE), "left_semi"))  # read twice
    old_order = old.where("kind = 'order'").groupBy(*ID).agg(F.max("ordinal").alias("o"), F.max("protected").alias("o_protected"))
    compared = listed.join(old_order, list(ID), "full_outer").groupBy(*PAGE).agg(
        F.min(F.coalesce((F.col("j") == F.col("o")) & ~F.col("o_protected"), F.lit(False))).alias("same"))
    order = listed.join(compared, list(PAGE)).select(
        *PAGE, F.lit("order").alias("kind"), "record_id", no_field[0], F.col("j").cast("string").alias("value"),
        (~F.col("same")).alias("protected"), *empty)
    return reduce(DataFrame.unionByName, [field_rows, added, deleted, gone, order])


# lineage ---------------------------------------------------------------------------------

def _sources(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*PAGE, *keep, F.explode("source_boxnos").alias("source"))


def visible_groups(groups: DataFrame, raw: DataFrame, deleted_raw: DataFrame) -> DataFrame:
    """Groups without their deleted sources: all gone hides a group, some gone rebuilds it.

    `groups`: book_id, page, boxno, source_boxnos, text, l..b; `raw` the live detections;
    `deleted_raw`: book_id, page, boxno of deleted detections. A source that is not live is
    gone as well.
    """
    listed = groups.select(*PAGE, F.col("boxno").alias("g"), F.posexplode("source_boxnos").alias("i", "boxno"))
    live = raw.select(*PAGE, "boxno", F.coalesce("text", F.lit("")).alias("text"), *SIDES)
    here = listed.join(live, [*PAGE, "boxno"], "inner")
    rest = here.groupBy(*PAGE, "g").agg(
        F.sort_array(F.collect_list(F.struct("i", "boxno", "text"))).alias("m"),
        *[(F.min if s in "lt" else F.max)(s).alias(f"u_{s}") for s in SIDES]).withColumnRenamed("g", "boxno")
    joined = groups.join(rest, [*PAGE, "boxno"], "left")
    none = F.size("source_boxnos") == 0
    partly = F.col("m").isNotNull() & (F.size("m") < F.size("source_boxnos"))
    kept = joined.where(none | F.col("m").isNotNull())
    return kept.select(
        *PAGE, "boxno", F.when(none, F.col("source_boxnos")).otherwise(F.transform("m", lambda x: x["boxno"])).alias("source_boxnos"),
        F.when(partly, F.array_join(F.transform("m", lambda x: x["text"]), "")).otherwise(F.col("text")).alias("text"),
        *[F.when(partly, F.col(f"u_{s}")).otherwise(F.col(s)).alias(s) for s in SIDES])


def lineage_cascade(raw: DataFrame, groups: DataFrame, structured: DataFrame, later: DataFrame,
                    deleted_raw: DataFrame, deleted_groups: DataFrame, rejected: DataFrame) -> dict[str, DataFrame]:
    """What stays visible after deletions, without touching saved rows.

    `structured` and `later` (artifact, translations and so on): book_id, page, boxno,
    source_boxnos; `deleted_groups` and `rejected` the same. A row hides when all its sources
    are hidden or all are rejected; a later row also when its number is hidden.
    """
    shown = stored(visible_groups(groups, raw, deleted_raw))
    # one row per source with all that is told of it, so the sources of every table are shuffled once
    yes = F.lit(True)
    told = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [
        *[_sources(t).withColumn("named", yes) for t in (groups, structured, later)],
        raw.select(*PAGE, F.col("boxno").alias("source"), yes.alias("live")),
        deleted_raw.select(*PAGE, F.col("boxno").alias("source"), yes.alias("named")),
        _sources(shown).withColumn("active", yes), _sources(deleted_groups).withColumn("dropped", yes), _sources(rejected).withColumn("refused", yes)])
    met = told.groupBy(*PAGE, "source").agg(*[F.max(c).alias(c) for c in ("named", "live", "active", "dropped", "refused")])
    hidden = ((F.col("named").isNotNull() & F.col("live").isNull()) | F.col("dropped").isNotNull()) & F.col("active").isNull()
    marks = stored(met.select(*PAGE, "source", F.when(hidden, 1).alias("h"), F.when(F.col("refused").isNotNull(), 1).alias("r")).where("h = 1 OR r = 1"))

    def gone(rows: DataFrame, *key: str) -> DataFrame:
        counted = (_sources(rows, *key).distinct().join(marks.hint("merge"), [*PAGE, "source"], "left").groupBy(*PAGE, *key)
                   .agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("h"), F.count("r").alias("r")))
        return counted.where("h = n OR r = n").select(*PAGE, *key)

    out_structured = stored(gone(structured, "boxno"))
    stay = structured.join(out_structured.hint("merge"), [*PAGE, "boxno"], "left_anti")
    numbers = (out_structured.unionByName(rejected.select(*PAGE, "boxno")).distinct()
               .join(stay.select(*PAGE, "boxno").distinct().hint("merge"), [*PAGE, "boxno"], "left_anti"))
    out_later = gone(later, "artifact", "boxno")
    rest = later.join(numbers.hint("merge"), [*PAGE, "boxno"], "left_anti").join(out_later.hint("merge"), [*PAGE, "artifact", "boxno"], "left_anti")
    return {"groups": shown, "structured": stay, "later": rest}


def allocate_numbers(existing: DataFrame, new_rows: DataFrame, order: str, name: str = "boxno") -> DataFrame:
    """Number new rows of a page after the largest number ever used there."""
    top = existing.groupBy(*PAGE).agg((F.max(name) + 1).alias("__next"))
    counted = split_row_number(new_rows, PAGE, [F.col(order)], position_block(F.col(order)), "__i")
    return counted.join(top, list(PAGE), "left").withColumn(
        name, (F.coalesce("__next", F.lit(0)) + F.col("__i")).cast("bigint")).drop("__i", "__next")


def complete_groups(groups: DataFrame, raw: DataFrame, deleted_groups: DataFrame) -> DataFrame:
    """Add a group of one for every manual detection that no group holds or ever held.

    `groups`: book_id, page, boxno, record_id, source_boxnos, text, l..b.
    """
    taken = _sources(groups).unionByName(_sources(deleted_groups)).distinct()
    loose = raw.where("source = 'manual'").drop("source").withColumnRenamed("boxno", "source").join(
        taken, [*PAGE, "source"], "left_anti").groupBy(*PAGE, "source").agg(
        F.min_by(F.struct("record_id", "text", *SIDES), "record_id").alias("x"))
    used = groups.select(*PAGE, "boxno").unionByName(deleted_groups.select(*PAGE, "boxno"))
    numbered = allocate_numbers(used, loose, "source")
    singles = numbered.select(*PAGE, "boxno", F.concat(F.lit("group_"), "x.record_id").alias("record_id"),
                              F.array("source").alias("source_boxnos"), F.coalesce("x.text", F.lit("")).alias("text"),
                              *[F.col(f"x.{s}").alias(s) for s in SIDES])
    return groups.select(*singles.columns).unionByName(singles)


def pending_descendants(groups: DataFrame, raw: DataFrame, structured: DataFrame, saved: DataFrame,
                        rejected_sources: DataFrame, reserved: DataFrame) -> DataFrame:
    """Placeholder records for groups with sources that no structured record holds yet.

    Groups of a page take their numbers in the order of `boxno`: the number that a later artifact
    saved for the same set of sources, unless a structured record or an earlier group has it; else
    their own, if it is neither reserved nor given away; else the one after the largest number so
    far. `saved`: book_id, page, boxno, source_boxnos, and artifact if more than one artifact can
    hold a set. `reserved`: book_id, page, boxno; numbers of `saved` are always reserved. Groups
    of a page must not share sources.
    """
    held = _sources(structured).unionByName(rejected_sources.select(*PAGE, "source")).distinct()
    listed = groups.select(*PAGE, F.col("boxno").alias("g"), F.posexplode("source_boxnos").alias("i", "source"))
    open_ones = listed.join(held, [*PAGE, "source"], "left_anti")
    live = raw.select(*PAGE, F.col("boxno").alias("source"), F.coalesce("text", F.lit("")).alias("text"), *SIDES, F.lit(True).alias("live"))
    met = written(open_ones.join(live, [*PAGE, "source"], "left"))  # the shuffles of the two steps are not there at once
    rest = met.groupBy(*PAGE, "g").agg(
        F.sort_array(F.collect_list(F.struct("i", "source", "live", "text"))).alias("m"),
        *[(F.min if s in "lt" else F.max)(s).alias(f"u_{s}") for s in SIDES])
    names = F.transform("m", lambda x: x["source"])
    joined = groups.withColumnRenamed("boxno", "g").join(rest, [*PAGE, "g"]).withColumn("sources", names)
    partly = F.size("sources") < F.size("source_boxnos")
    texts = F.transform(F.filter("m", lambda x: x["live"]), lambda x: x["text"])
    shaped = written(joined.select(
        *PAGE, "g", "sources", F.when(partly, F.array_join(texts, "")).otherwise(F.col("text")).alias("text"),
        *[F.when(partly & F.col(f"u_{s}").isNotNull(), F.col(f"u_{s}")).otherwise(F.col(s)).alias(s) for s in SIDES],
        F.array_sort(F.array_distinct("sources")).alias("lineage")))
    place = F.array_position(F.array(*[F.lit(x) for x in SAVED_IN]), F.col("artifact")) if "artifact" in saved.columns else F.lit(0)
    lineage = saved.where(F.size("source_boxnos") > 0).groupBy(*PAGE, F.array_sort(F.array_distinct("source_boxnos")).alias("lineage")).agg(
        F.min_by("boxno", F.struct(place, F.col("boxno"))).alias("saved_no"))
    taken = structured.select(*PAGE, F.col("boxno").alias("saved_no")).distinct()
    wanted = lineage.join(taken, [*PAGE, "saved_no"], "left_anti")
    asked = written(shaped.join(wanted, [*PAGE, "lineage"], "left"))  # read twice
    claims = asked.where(F.col("saved_no").isNotNull()).groupBy(*PAGE, "saved_no").agg(F.min("g").alias("winner"))
    blocked = reserved.select(*PAGE, F.col("boxno").alias("g")).unionByName(saved.select(*PAGE, F.col("boxno").alias("g"))).distinct()
    top = blocked.groupBy(*PAGE).agg(F.max("g").alias("top"))
    # what is known of a number, so that groups meet it once
    marks = (blocked.select("*", F.lit(True).alias("blocked"), F.lit(None).cast(claims.schema["saved_no"].dataType).alias("won_no"))
             .unionByName(claims.select(*PAGE, F.col("winner").alias("g"), F.lit(None).cast("boolean").alias("blocked"), F.col("saved_no").alias("won_no")))
             .groupBy(*PAGE, "g").agg(F.max("blocked").alias("blocked"), F.collect_set("won_no").alias("won_nos")))
    asked = (asked.join(marks, [*PAGE, "g"], "left").join(top, list(PAGE), "left").withColumn("top", F.coalesce("top", F.lit(-1))))
    won = F.coalesce(F.array_contains("won_nos", F.col("saved_no")), F.lit(False))
    # blocked numbers are at most `top` and come first; every group from there on is pushed up by those before it
    moves = ~won & (F.col("blocked").isNotNull() | (F.col("g") > F.col("top")))
    line = written_row_number(asked.withColumn("moves", moves), [*PAGE, "moves"], [F.col("g")], position_block(F.col("g")), "k")
    number = F.when(won, F.col("saved_no")).when(F.col("moves"), F.greatest("g", F.col("top") + 1 + F.col("k"))).otherwise(F.col("g"))
    return line.select(
        *PAGE, number.cast("bigint").alias("boxno"), F.col("sources").alias("source_boxnos"), "text", *SIDES,
        F.lit(False).alias("sfx"), F.lit(False).alias("open_lettering"), F.lit(True).alias("safe_to_erase"), F.lit("unclear").alias("reason"))


def placeholder_rows(structured: DataFrame, existing: DataFrame, artifact: str) -> DataFrame:
    """Numbers of structured records that an artifact lacks, with their sources."""
    return structured.join(existing.select(*PAGE, "boxno").distinct(), [*PAGE, "boxno"], "left_anti").select(
        *PAGE, F.lit(artifact).alias("artifact"), "boxno", "source_boxnos")


def visible_merge(current: DataFrame, visible: DataFrame, submitted: DataFrame) -> DataFrame:
    """Order after saving a filtered view: hidden rows keep their slots, the submitted rows
    fill the slots of those that were visible and still are, and the rest follow.

    All three: book_id, page, record_id, pos. Gives book_id, page, record_id, pos, hidden.
    """
    # the three tables meet once, by id, and every row learns there which of them hold its id
    told = reduce(DataFrame.unionByName, [df.select(*ID, "pos", F.lit(name).alias("of")) for name, df in (
        ("current", current), ("visible", visible.withColumn("pos", F.lit(None).cast(current.schema["pos"].dataType))), ("sent", submitted))])
    named = F.col("book_id").isNotNull() & F.col("page").isNotNull() & F.col("record_id").isNotNull()  # rows without an id meet no others
    holds = {name: F.max(F.col("of") == name).over(Window.partitionBy(*ID)) for name in ("current", "visible", "sent")}
    met = told.select("*", *[(named & c).alias(f"in_{name}") for name, c in holds.items()]).where("of <> 'visible'")
    in_current, in_visible, in_sent = (F.col(f"in_{name}") for name in holds)
    role = (F.when(F.col("of") == "sent", F.when(~in_current | in_visible, "sent"))
            .when(~in_visible, "hidden").when(in_sent, "slot"))
    # those that are neither sent nor hidden nor a slot still count for the end of the page
    rows = written(met.select(*ID, "pos", "of", role.alias("role")))
    ranked = rows.where(F.col("role").isin("sent", "slot"))
    numbered = written_row_number(ranked, [*PAGE, "role"], [F.col("pos")], position_block(F.col("pos")), "k", held=True)
    slot_no = numbered.where("role = 'slot'").select(*PAGE, "k", "pos")
    top = rows.where("of = 'current'").groupBy(*PAGE).agg((F.max("pos") + 1).alias("top"))
    placed = (numbered.where("role = 'sent'").select(*ID, "k").join(slot_no, [*PAGE, "k"], "left").join(top, list(PAGE), "left")
              .select(*ID, F.coalesce("pos", F.coalesce("top", F.lit(0)) + F.col("k")).alias("pos"), F.lit(False).alias("hidden")))
    kept = rows.where("role = 'hidden'").select(*ID, "pos", F.lit(True).alias("hidden"))
    both = kept.unionByName(placed).withColumnRenamed("pos", "__p")
    return written_row_number(both, PAGE, [F.col("__p")], position_block(F.col("__p")), "pos").drop("__p")


# edits of edits --------------------------------------------------------------------------

def set_protection(edits: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Set `protected` where `targets` (columns `on` and protected) match. Freezes and, unless
    a whole artifact is meant, saved orders are left alone."""
    wanted = targets.select(*on, F.col("protected").alias("__p"))
    by_artifact = "record_id" not in on
    kinds = ("field", "added", "deleted", "order") if by_artifact else (("field",) if "field" in on else ("field", "added", "deleted"))
    joined = edits.join(wanted, list(on), "left")
    return joined.withColumn("protected", F.when(F.col("kind").isin(*kinds) & F.col("__p").isNotNull(), F.col("__p"))
                             .otherwise(F.col("protected"))).drop("__p").select(*edits.columns)


def discard_unprotected(edits: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop unprotected edits of the targets; freezes stay, and orders unless a whole artifact is meant."""
    kinds = ("field", "added", "deleted", "order") if "record_id" not in on else ("field", "added", "deleted")
    hit = edits.join(targets.select(*on).distinct().withColumn("__hit", F.lit(True)), list(on), "left")
    drop = F.coalesce("__hit", F.lit(False)) & ~F.col("protected") & F.col("kind").isin(*kinds)
    return hit.where(~drop).drop("__hit").select(*edits.columns)


def remove_edits(edits: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop edits of a field or record; removing a record that an order lists clears the order."""
    if "field" in on:
        return edits.join(targets.select(*on).distinct().withColumn("kind", F.lit("field")), [*on, "kind"], "left_anti").select(*edits.columns)
    wanted = targets.select(*on).distinct()
    scope = [c for c in on if c != "record_id"]
    cleared = edits.where("kind = 'order'").join(wanted, list(on), "left_semi").select(*scope).distinct()
    orders = edits.where("kind = 'order'").join(cleared, scope, "left_anti")
    freezes = edits.where("kind = 'freeze'")
    others = edits.where("kind NOT IN ('order', 'freeze')").join(wanted, list(on), "left_anti")
    return others.select(*edits.columns).unionByName(orders.select(*edits.columns)).unionByName(freezes)


def freeze_stage(edits: DataFrame, pages: DataFrame, stage: str, records: dict[str, DataFrame]) -> DataFrame:
    """Freeze or release a stage on pages: the snapshots of its artifacts replace those it had.

    `pages`: book_id, page, frozen (one row per page). `records`: effective records by artifact; their
    columns are the fields of `edits.record`. A snapshot is protected, and one row of it without a
    record id marks the page, so a page without records can be frozen as well. Other edits stay.
    """
    own = (F.col("stage") == stage) & (F.col("kind") == "freeze") & F.col("artifact").isin(*STAGE_ARTIFACTS[stage])
    touched = pages.select(*PAGE).distinct()
    kept = edits.where(~own).unionByName(edits.where(own).join(touched, list(PAGE), "left_anti").select(*edits.columns))
    frozen = pages.where("frozen").select(*PAGE).distinct()
    shape = edits.schema["record"].dataType
    out = [kept]
    for artifact in STAGE_ARTIFACTS[stage]:
        marks = frozen.select(*PAGE, F.lit(None).cast("string").alias("record_id"), F.lit(None).cast(shape).alias("record"))
        if artifact in records:
            body = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape.fields])
            marks = marks.unionByName(records[artifact].join(frozen, list(PAGE), "left_semi").select(*PAGE, "record_id", body.alias("record")))
        given = {"stage": F.lit(stage), "artifact": F.lit(artifact), "kind": F.lit("freeze"), "protected": F.lit(True)}
        out.append(marks.select(*[c if c in (*PAGE, "record_id", "record") else given.get(c, F.lit(None)).cast(edits.schema[c].dataType).alias(c)
                                  for c in edits.columns]))
    return reduce(DataFrame.unionByName, out)


def protection_summary(edits: DataFrame) -> DataFrame:
    """Per stage and record: protected and unprotected fields, and the state of the record."""
    keys = [*PAGE, "stage", "record_id"]
    field = F.col("kind") == "field"
    return edits.where("kind IN ('field', 'added', 'deleted')").groupBy(*keys).agg(
        F.count_if(field & F.col("protected")).alias("protected_fields"), F.count_if(field & ~F.col("protected")).alias("open_fields"),
        F.max(F.when(~field, F.col("kind"))).alias("state"), F.max(F.when(~field, F.col("protected"))).alias("state_protected"))


def patch_text(edits: DataFrame, structured: DataFrame, translations: DataFrame, placements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text edits by (artifact, boxno): accepted changes and errors.

    `edits`: book_id, page, artifact, boxno, record_id, value. Only boxes with a placement
    can be edited, unchanged text is skipped, and a translation row is made when missing.
    """
    key = [*PAGE, "artifact", "boxno"]
    ok_shape = (F.col("artifact").isin("ocr_structured", "translations") & (F.col("boxno") >= 0)
                & (F.coalesce("record_id", F.lit("")) != "") & F.col("value").isNotNull() & (F.length("value") <= 100_000))
    counts = edits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    own = structured.select(*PAGE, F.lit("ocr_structured").alias("artifact"), "boxno", F.col("record_id").alias("saved_id"), F.col("text").alias("was")) \
        .unionByName(translations.select(*PAGE, F.lit("translations").alias("artifact"), "boxno", F.col("record_id").alias("saved_id"),
                                         F.col("english_text").alias("was")))
    boxes = structured.select(*PAGE, "boxno", F.lit(True).alias("has_source")).distinct()
    shown = placements.select(*PAGE, "boxno", F.lit(True).alias("has_place")).distinct()
    joined = (edits.join(counts, key, "left").join(own, key, "left").join(boxes, [*PAGE, "boxno"], "left")
              .join(shown, [*PAGE, "boxno"], "left"))
    code = (F.when(~F.coalesce(ok_shape, F.lit(False)), "bad_edit").when(F.col("n") > 1, "repeated_edit")
            .when(F.col("has_place").isNull(), "no_placement")
            .when(F.col("saved_id").isNotNull() & (F.col("saved_id") != F.col("record_id")), "other_record")
            .when(F.col("saved_id").isNull() & ((F.col("artifact") != "translations") | F.col("has_source").isNull()), "no_source"))
    judged = joined.withColumn("code", code)
    changes = judged.where(F.col("code").isNull() & (F.col("value") != F.coalesce("was", F.lit("")))).select(
        *key, "record_id", F.when(F.col("artifact") == "translations", F.lit("english_text")).otherwise(F.lit("text")).alias("field"),
        "value", F.col("saved_id").isNull().alias("created"))
    return changes, judged.where(F.col("code").isNotNull()).select(*key, "code")


# stages ----------------------------------------------------------------------------------

def _rank_to(values: dict[str, str], rank: Column, default: str | None = None) -> Column:
    out = F.get(F.array(*[F.lit(values[s]) for s in STAGES]), (rank - 1).cast("int"))
    return F.coalesce(out, F.lit(default)) if default else out


def earliest_rerun(pending: DataFrame, pages: DataFrame) -> DataFrame:
    """Phase to rerun from per page: that of the first pending stage, else render."""
    first = pending.groupBy(*PAGE).agg(F.min(stage_rank(F.col("stage"))).alias("rank"))
    return pages.select(*PAGE).join(first, list(PAGE), "left").select(*PAGE, _rank_to(RERUN_FROM, F.col("rank"), "render").alias("phase"))


def stale_after_events(events: DataFrame) -> DataFrame:
    """Pending and stale stages per page after saves and regenerations, newest event last.

    `events`: book_id, page, revision, kind ('saved' with `stage`, 'regenerated' with
    `stage`, the first stage that was redone; 'edited' with `stage`). Saving a stage accepts
    the stages before it; editing several stages accepts none; regenerating from a stage
    settles it and all after it, and every stage still pending makes later ones stale.
    """
    rank = stage_rank(F.col("stage"))
    spread = events.select(*PAGE, "revision", "kind", rank.alias("r")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(STAGES)))).alias("k"))
    kind, r, k = F.col("kind"), F.col("r"), F.col("k")
    saved, edited, redone = kind == "saved", kind == "edited", kind == "regenerated"
    # what an event does to stage k: +1 sets, -1 clears, null leaves
    pend = F.when((saved | edited) & (k == r), 1).when(saved & (k < r), -1).when(redone & (k >= r), -1)
    stale = F.when((saved | edited) & (k > r), 1).when(saved & (k <= r), -1).when(redone & (k >= r), -1)
    place = F.col("revision")
    last = spread.groupBy(*PAGE, "k").agg(
        F.max_by(pend, F.when(pend.isNotNull(), place)).alias("p"), F.max_by(stale, F.when(stale.isNotNull(), place)).alias("s"))
    # whatever happened, stages after a pending one are stale
    marks = last.groupBy(*PAGE).agg(
        F.min(F.when(F.col("p") == 1, F.col("k"))).alias("first_pending"),
        F.sort_array(F.collect_list(F.struct("k", "p", "s"))).alias("ks"))
    names = F.array(*[F.lit(s) for s in STAGES])
    pending = F.transform(F.filter("ks", lambda x: x["p"] == 1), lambda x: F.get(names, (x["k"] - 1).cast("int")))
    stale_names = F.transform(F.filter("ks", lambda x: (x["s"] == 1) | (x["k"] > F.col("first_pending"))),
                              lambda x: F.get(names, (x["k"] - 1).cast("int")))
    return marks.select(*PAGE, pending.alias("pending"), stale_names.alias("stale"))


def reset_pending(stages: DataFrame) -> DataFrame:
    """After a reset: is a stage still pending? Its signature is compared with what was applied.

    `stages`: book_id, page, stage, pending, base (signature applied before the first pending
    edit, null when not known), before, after, reset (is the stage being reset).
    """
    known = F.col("base").isNotNull()
    needed = F.when(known, F.col("after") != F.col("base")).otherwise(~F.col("pending") & (F.col("before") != F.col("after")))
    still = F.when(F.col("reset"), needed).otherwise(F.col("pending"))
    first = F.min(F.when(F.col("now"), stage_rank(F.col("stage"))))
    marked = stages.withColumn("now", F.coalesce(still, F.lit(False)))
    lead = marked.groupBy(*PAGE).agg(first.alias("first"))
    return marked.join(lead, list(PAGE)).select(
        *PAGE, "stage", F.col("now").alias("pending"), F.coalesce(stage_rank(F.col("stage")) > F.col("first"), F.lit(False)).alias("stale"))


STATUS_ROWS = 262_144  # states and edited stages of pages that meet in one task


def stage_status(edits: DataFrame, states: DataFrame) -> DataFrame:
    """Per page and stage: changed, stale, pending, frozen, saved revision; `text` sums up the
    three text stages. `states`: book_id, page, stage, stale, pending, frozen, saved_revision."""
    # The size of exploded edits is told too small, so all of them were broadcast; and rows of pages shrink so much in a
    # shuffle that the tasks made from its size hold far more than it tells. So the rows are counted, and met by page.
    states, marks = written(states), written(edits.select(*PAGE, "stage").distinct())
    tasks = 1 + (states.count() + marks.count()) // STATUS_ROWS
    stages = marks.repartition(tasks, *PAGE).groupBy(*PAGE).agg(F.collect_list("stage").alias("__stages"))
    changed = F.coalesce(F.array_contains("__stages", F.col("stage")), F.lit(False))
    rows = states.repartition(tasks, *PAGE).join(stages.hint("merge"), list(PAGE), "left").select(
        *PAGE, "stage", changed.alias("changed"), "stale", "pending", "frozen",
        F.col("saved_revision").cast("bigint").alias("saved_revision"))
    text = rows.where(F.col("stage").isin(*TEXT_STAGES)).groupBy(*PAGE).agg(
        F.lit("text").alias("stage"), F.bool_or("changed").alias("changed"), F.bool_or("stale").alias("stale"),
        F.bool_or("pending").alias("pending"), F.bool_and("frozen").alias("frozen"), F.max("saved_revision").alias("saved_revision"))
    return rows.unionByName(text)


def revisions(history: DataFrame) -> DataFrame:
    """Revisions of a book, newest first."""
    return history.groupBy("book_id", "revision").agg(F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("edits")) \
                  .orderBy("book_id", F.col("revision").desc())


def state_at(history: DataFrame, revision: int, key: Sequence[str]) -> DataFrame:
    """Value of every key as of a revision, from an append-only history; removed keys are absent.

    `history`: key.., revision, value, removed.
    """
    last = history.where(F.col("revision") <= revision).groupBy(*key).agg(
        F.max_by(F.struct("value", "removed"), "revision").alias("x"))
    return last.where(~F.col("x.removed")).select(*key, F.col("x.value").alias("value"))


