"""Keyed merges of excerpts into a master table of page records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("book_id", "page", "boxno")
OCR_FIELDS = ("l", "t", "r", "b", "sfx", "open_lettering", "text")


def upsert_ocr(master: DataFrame, excerpt: DataFrame) -> DataFrame:
    """Insert or update source fields; a translation of changed text is cleared."""
    fresh = excerpt.select(*KEY, F.struct(*OCR_FIELDS).alias("x"))
    joined = master.join(fresh, list(KEY), "full_outer")
    given = F.col("x").isNotNull()
    changed = given & F.col("text").isNotNull() & (F.col("text") != F.col("x.text"))
    out = []
    for name in master.columns:
        if name in OCR_FIELDS:
            out.append(F.when(given, F.col(f"x.{name}")).otherwise(F.col(name)).alias(name))
        elif name == "english_text":
            out.append(F.when(~F.coalesce(changed, F.lit(False)), F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def upsert_translation(master: DataFrame, excerpt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set translations whose key exists and whose source text is the same; others are errors."""
    fresh = excerpt.select(*KEY, F.col("text").alias("x_text"), F.col("english_text").alias("x_english"))
    joined = master.join(fresh, list(KEY), "left")
    fits = F.coalesce(F.col("text") == F.col("x_text"), F.lit(False))
    merged = joined.withColumn("english_text", F.when(fits, F.col("x_english")).otherwise(F.col("english_text"))) \
                   .select(*master.columns)
    checked = fresh.join(master.select(*KEY, "text", F.lit(True).alias("found")), list(KEY), "left")
    code = (F.when(F.col("found").isNull(), "missing_master").when(F.col("text").isNull(), "master_without_text")
            .when(F.col("text") != F.col("x_text"), "text_mismatch"))
    return merged, checked.select(*KEY, code.alias("code")).where(F.col("code").isNotNull())


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def invalid_records(rows: DataFrame) -> DataFrame:
    """Codes of the key and region rules a master record breaks."""
    finite = F.lit(True)
    for side in ("l", "t", "r", "b"):
        value = F.col(side).cast("double")
        finite = finite & F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    rules = F.array_compact(F.array(
        F.when(F.col("page").isNull() | (F.col("page") < 0), F.lit("bad_page")),
        F.when(F.col("boxno").isNull() | (F.col("boxno") < 0), F.lit("bad_boxno")),
        F.when(~finite, F.lit("bad_region")),
        F.when(finite & ((F.col("r") <= F.col("l")) | (F.col("b") <= F.col("t"))), F.lit("empty_region"))))
    return rows.select(*KEY, F.explode(rules).alias("code"))


def replace_subset(existing: DataFrame, replacement: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replace rows with the same key in place; rows with a new key follow the existing ones.

    `order` is the position column of both sides; the result has a new dense `order` space:
    existing rows keep theirs, appended rows come after the largest of their page.
    """
    rest = [c for c in existing.columns if c not in keys and c != order]
    fresh = replacement.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x"), F.min(order).alias("x_order"))
    page = [k for k in keys if k in ("book_id", "page")]
    top = existing.groupBy(*page).agg((F.max(order) + 1).alias("top"))
    joined = existing.withColumn("__old", F.lit(True)).join(fresh, list(keys), "full_outer").join(top, page, "left")
    value = [F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    place = F.when(F.col("__old").isNotNull(), F.col(order)).otherwise(F.coalesce("top", F.lit(0)) + F.col("x_order"))
    return joined.select(*keys, place.alias(order), *value)


def states_of(log: DataFrame, key: Sequence[str], upto: dict[str, int], version: str = "version") -> DataFrame:
    """The last row of every key up to some changes, grouped once: a column of whole rows for each name in `upto`, null where a key has none yet.

    `log` holds whole rows with the number of their change; a change has at most one row of a key.
    """
    rest = F.struct(*[c for c in log.columns if c not in (*key, version)])
    at = F.col(version)
    return log.groupBy(*key).agg(*[F.max_by(rest, F.when(at <= n, at)).alias(name) for name, n in upto.items()])


def present(states: DataFrame, key: Sequence[str], state: str) -> DataFrame:
    """The table of one state of `states_of`, without keys whose last row is `deleted`."""
    return states.select(*key, f"{state}.*").where(~F.col("deleted")).drop("deleted")


def as_of(log: DataFrame, key: Sequence[str], upto: int, version: str = "version") -> DataFrame:
    """A table as it was after change `upto`: the last row of every key, without keys whose last row is `deleted`.

    `log` holds whole rows with the number of their change; a change has at most one row of a key.
    """
    return present(states_of(log.where(F.col(version) <= upto), key, {"__x": upto}, version), key, "__x")
