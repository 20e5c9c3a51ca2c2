"""Reading of model answers: repair of almost-JSON text and typed access to its values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import text as tx
from boxloom.functions.staging import staged

END = "<END>"
TRAILING_COMMA = r'(?s)("(?:[^"\\]|\\.)*(?:"|$))|,(?=[ \t\r\n]*[\]}])'


def kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def is_array(value: Column) -> Column:
    return values(value).isNotNull()


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def values(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def field(value: Column, name: str) -> Column:
    """The value under a name; SQL null when the name is absent."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def at(value: Column, index: int) -> Column:
    return F.try_variant_get(value, f"$[{index}]", "variant")


def as_text(value: Column, of: Column | None = None) -> Column:
    """`of` is the kind of the value, where it is known."""
    return F.when((kind(value) if of is None else of) == "STRING", F.try_variant_get(value, "$", "string"))


def as_index(value: Column, of: Column | None = None) -> Column:
    """Non-negative whole number, given as a number or as plain digits."""
    if of is None:
        return once(kind(value), lambda k: as_index(value, k))
    number = F.when(of == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.when(number >= 0, number).otherwise(F.when(of == "STRING", tx.lenient_index(as_text(value, of))))


def as_plain_index(value: Column) -> Column:
    number = F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.when(number >= 0, number)


def as_bool(value: Column, of: Column | None = None) -> Column:
    if of is None:
        return once(kind(value), lambda k: as_bool(value, k))
    number = F.when(of == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return (F.when(of == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(number.isin(0, 1), number == 1).when(of == "STRING", tx.lenient_bool(as_text(value, of))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is taken once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_number(value: Column) -> Column:
    return F.when(F.rlike(kind(value), F.lit(r"^(BIGINT$|DOUBLE$|DECIMAL)")), F.try_variant_get(value, "$", "double"))


def as_ratio(value: Column) -> Column:
    """Number, or text holding a number or a percentage; null unless finite."""
    return F.coalesce(as_number(value), tx.lenient_ratio(as_text(value)))


def as_numbers(value: Column) -> Column:
    """array<double> when every element is a number, else null."""
    # the kind of the whole array tells that of its elements; beside numbers it hides nulls only
    numeric = F.rlike(kind(value), F.lit(r"^ARRAY<(BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)|VOID)>$"))
    numbers = F.when(numeric, F.try_variant_get(value, "$", "array<double>"))
    return once(numbers, lambda x: F.when(F.forall(x, lambda n: n.isNotNull()), x))


def fields(value: Column, names: Sequence[str]) -> Column:
    """A struct of the values under some names, read in one go; null for what is no object."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'`{n}`:variant' for n in names)}>")


def _sequence(text: Column) -> Column:
    """The comma-separated values of `text`, null unless all of it can be read."""
    read = values(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]'))))
    complete = as_text(F.try_element_at(read, F.lit(-1))) == END
    return F.when(complete, F.slice(read, 1, F.greatest(F.lit(0), F.size(read) - 1)))


def read_rows(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., items): rows of each answer as array<variant>, null when it cannot be used.

    Code fences and commas before a closing bracket are dropped. A whole array, or an
    object with a `rows` array, is taken as it is; two or more rows without their outer
    array (or with only its closing bracket) are recovered. Built in steps, so that each
    text is cleaned and parsed once.
    """
    text = F.col("__text")
    half_open = text.startswith("[") & ~text.startswith("[[") & text.endswith("]]")
    single = (F.size("__found") == 1) & ~F.col("__open_end")

    def rows_only(items: str) -> Column:
        return F.when((F.size(items) >= 2) & F.forall(items, lambda x: is_array(x) | is_object(x)), F.col(items))

    step = staged(answers.select(*keys, "raw"), __plain=tx.plain_lines(F.col("raw"))).drop("raw")
    step = staged(step, __body=tx.without_fences(F.col("__plain"))).drop("__plain")
    # most texts have no comma before a bracket, and searching for one is cheap
    step = staged(step, __text=F.when(F.rlike("__body", F.lit(r",[ \t\r\n]*[\]}]")), F.regexp_replace("__body", TRAILING_COMMA, "$1"))
                  .otherwise(F.col("__body"))).drop("__body")
    step = staged(step, __open_end=F.rlike("__text", F.lit(r",\s*$")), __half=half_open,
                  __found=_sequence(F.regexp_replace("__text", r",\s*$", "")))
    step = staged(step, __inner=F.when(F.col("__half") & F.col("__found").isNull(),
                                       _sequence(F.regexp_replace("__text", r"\s*,?\s*\]$", ""))),
                  __head=F.when(single, F.get("__found", F.lit(0))))
    whole = F.when(is_array(F.col("__head")), values(F.col("__head"))).otherwise(values(field(F.col("__head"), "rows")))
    return staged(step, items=F.when(single, whole).otherwise(
        F.coalesce(rows_only("__found"), rows_only("__inner")))).select(*keys, "items")
