"""Placement of translated text: regions, overlaps, blockers, render rows and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions import answer_json as aj
from boxloom.functions import geometry as geo
from boxloom.functions import text as tx
from boxloom.functions.staging import staged
from boxloom.operators.answers import FILLS, _finish, answer_items, by_merge, font_file
from boxloom.operators.group import PAGE, SIDES, near_pairs
from boxloom.operators.ranking import position_block, split_running
from boxloom.session import stored

PLACED = ("pl", "pt", "pr", "pb")
SOURCE = ("sl", "st", "sr", "sb")
# Fixed values of the blocker pads: smallest, largest, ratio
HARD_X, HARD_Y, SHADOW_Y = (2, 6, 0.05), (4, 8, 0.04), (24, 48, 0.22)
SHADOW_WIDTH_MIN, SHADOW_WIDTH_RATIO = 18, 0.55


def _cols(names: Sequence[str], alias: str | None = None) -> geo.Region:
    return geo.Region(*[F.col(f"{alias}.{n}" if alias else n) for n in names])


# combining -------------------------------------------------------------------------------

def combine_placements(structured: DataFrame, open_placements: DataFrame, expansions: DataFrame,
                       pages: DataFrame) -> DataFrame:
    """Open records take their answered region; others a given region, else a container
    width, else a relative expansion.

    `expansions`: book_id, page, boxno, pl..pb, target_width_ratio, container_x_min,
    container_x_max, box_widening, height_increase (all but the key nullable).
    """
    sized = structured.join(pages.select(*PAGE, "width", "height"), list(PAGE))
    w, h = F.col("width"), F.col("height")
    opened = (sized.where("open_lettering").select(*PAGE, "boxno", "width", "height")
              .join(open_placements.select(*PAGE, "boxno", *PLACED), [*PAGE, "boxno"])
              .withColumn("method", F.lit("answer")))
    others = sized.where(~F.col("open_lettering")).join(expansions, [*PAGE, "boxno"])
    source = geo.region()
    given = F.col("pl").isNotNull()
    contained = ~given & F.col("target_width_ratio").isNotNull()
    wide = geo.expand_to_container(source, F.col("target_width_ratio"), F.col("container_x_min"), F.col("container_x_max"),
                                   F.col("height_increase"), w, h)
    relative = geo.expand(source, F.col("box_widening"), F.col("height_increase"), w, h)
    merged = others.select(
        *PAGE, "boxno", "width", "height",
        *[F.when(given, F.col(n)).when(contained, a).otherwise(b).alias(n) for n, a, b in zip(PLACED, wide, relative)],
        F.when(given, "region").when(contained, "container").otherwise("relative").alias("method"))
    placed = opened.unionByName(merged)
    return placed.withColumn("box_2d", geo.region_to_thousandths(_cols(PLACED), w, h)).drop("width", "height")


def attach_placements(structured: DataFrame, answers: DataFrame, pages: DataFrame, fonts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check saved placement objects again; a pixel region wins over box_2d."""
    texts = ("font", "fill", "color", "colour", "stroke", "gravity", "manualLineBreaks")
    numbers = ("strokeWidth", "fontSizeWidthPercent", "minPointSize", "maxPointSize")
    names = ("page", "boxno", "box_2d", "placementRegion", *texts, *numbers)
    read = answer_items(answers, names=names)
    read = staged(read, region=aj.as_numbers(F.col("f_placementRegion")))
    read = read.join(by_merge(pages.select(*PAGE, "width", "height")), list(PAGE), "left")
    region = F.col("region")
    pixel = geo.Region(*[F.get(region, F.lit(i)) for i in range(4)])
    read = staged(read, box=F.when(F.size(aj.values(F.col("f_placementRegion"))) == 4, geo.region_to_thousandths(
        pixel, F.col("width"), F.col("height")).cast("array<double>")).otherwise(aj.as_numbers(F.col("f_box_2d"))),
        asked=F.nullif(tx.strip(aj.as_text(F.col("f_font"))), F.lit("")),
        fill=F.lower(tx.strip(aj.as_text(F.coalesce("f_fill", "f_color", "f_colour")))))
    allowed = fonts.select(F.col("font").alias("file"), F.lit(True).alias("known")).distinct()
    read = read.withColumn("file", font_file(F.col("asked"))).join(allowed, "file", "left")
    fill_given = F.coalesce("f_fill", "f_color", "f_colour").isNotNull()
    key = aj.as_index(F.col("f_boxno"))
    bad = (F.when(~F.coalesce("is_object", F.lit(False)), "bad_row").when(key.isNull(), "bad_key")
           .when(~geo.thousandths_valid(F.col("box")), "bad_box")
           .when(F.col("asked").isNotNull() & F.col("known").isNull(), "bad_font")
           .when(fill_given & ~F.coalesce(F.col("fill").isin(*FILLS), F.lit(False)), "bad_fill"))
    parsed = read.select(
        *PAGE, "unreadable", "pos", key.alias("boxno"), F.coalesce(aj.as_index(F.col("f_page")), F.lit(-1)).alias("item_page"),
        "box", "width", "height", F.when(F.col("asked").isNotNull(), F.col("file")).alias("font"), "fill",
        *[aj.as_text(F.col(f"f_{n}")).alias(n) for n in ("stroke", "gravity", "manualLineBreaks")],
        *[aj.as_number(F.col(f"f_{n}")).alias(n) for n in numbers], bad.alias("bad"))
    accepted, errors = _finish(structured, parsed)
    g = geo.thousandths_to_region(F.col("box"), F.col("width"), F.col("height"))
    return accepted.select(*PAGE, "boxno", *g.columns(PLACED), "font", "fill", "stroke", "gravity", "manualLineBreaks",
                           *numbers), errors


# overlaps --------------------------------------------------------------------------------

def _overlap(a: geo.Region, b: geo.Region) -> Column:
    return ((F.least(a.r, b.r) > F.greatest(a.l, b.l)) & (F.least(a.b, b.b) > F.greatest(a.t, b.t)))


def separation(first: geo.Region, second: geo.Region) -> tuple[Column, Column, Column]:
    """(axis, cut, first comes first) of two source boxes that do not overlap, else nulls."""
    across = F.greatest(first.l, second.l) - F.least(first.r, second.r)
    down = F.greatest(first.t, second.t) - F.least(first.b, second.b)
    apart = (across > 0) | (down > 0)
    vertical = down > across
    leads = F.when(vertical, first.t <= second.t).otherwise(first.l <= second.l)
    middle = (F.when(vertical & leads, first.b + second.t).when(vertical, second.b + first.t)
              .when(leads, first.r + second.l).otherwise(second.r + first.l))
    axis = F.when(apart, F.when(vertical, F.lit("vertical")).otherwise(F.lit("horizontal")))
    return axis, F.when(apart, geo.half_even(middle / F.lit(2.0))), leads


def _separate_pairs(placements: DataFrame) -> DataFrame:
    """(book_id, page, u, v, axis, cut, u_first, ga, gb): overlapping placements whose source boxes are apart, and their regions."""
    slim = stored(placements.select(*PAGE, "boxno", *SOURCE, *[F.col(p).alias(s) for p, s in zip(PLACED, SIDES)]))  # read three times
    axis, cut, leads = separation(_cols(SOURCE, "a"), _cols(SOURCE, "b"))
    match = (F.col("a.boxno") < F.col("b.boxno")) & _overlap(geo.region("a"), geo.region("b"))
    whole = [F.struct(*[F.col(f"{x}.{s}").cast("bigint").alias(s) for s in SIDES]).alias(f"g{x}") for x in "ab"]
    return near_pairs(slim, slim, PAGE, match).select(
        *[F.col(f"a.{k}").alias(k) for k in PAGE], F.col("a.boxno").alias("u"), F.col("b.boxno").alias("v"),
        axis.alias("axis"), cut.alias("cut"), leads.alias("u_first"), *whole).where(F.col("axis").isNotNull())


def overlap_pairs(placements: DataFrame) -> DataFrame:
    """Overlapping placements (u < v) whose source boxes are apart, with the cut between them.

    `placements`: book_id, page, boxno, pl..pb (placement), sl..sb (source box).
    """
    return _separate_pairs(placements).drop("ga", "gb")


PAIRS_OF_A_TASK = 1024  # box numbers of a bucket of the running cuts


def _ends(pairs: DataFrame) -> DataFrame:
    """Both ends of every pair, with what its cut would do to that box: the least cut of each side, left and
    top with a minus. The pairs of a box in pair order are those in the order of `other`."""
    down = F.col("axis") == "vertical"
    whole = [c for c in pairs.columns if c not in (*PAGE, "u", "v")]

    def end(n: str, other: str, region: str, leads: Column) -> Column:
        return F.struct(F.col(n).alias("n"), F.col(other).alias("other"), F.col(region).alias("g"),
                        F.when(~leads & ~down, -F.col("cut")).alias("l"), F.when(~leads & down, -F.col("cut")).alias("t"),
                        F.when(leads & ~down, F.col("cut")).alias("r"), F.when(leads & down, F.col("cut")).alias("b"))

    both = F.explode(F.array(end("u", "v", "ga", F.col("u_first")), end("v", "u", "gb", ~F.col("u_first")))).alias("e")
    return pairs.select(*PAGE, F.struct(*whole).alias("pair"), both).select(*PAGE, "pair", "e.*")


def _cut_to(g: str, cuts: Sequence[str]) -> Column:
    l, t, r, b = (F.col(c) for c in cuts)
    sides = (F.greatest(f"{g}.l", -l), F.greatest(f"{g}.t", -t), F.least(f"{g}.r", r), F.least(f"{g}.b", b))
    return F.struct(*[c.cast("bigint").alias(n) for c, n in zip(sides, SIDES)])


def _hits(pairs: DataFrame, buckets: bool) -> DataFrame:
    """`pairs` with `hit` as it follows from the `hit` of the pairs before them, and `was`.

    A box before a pair is its region within the least cuts of its earlier pairs that hit: running
    minima. With `buckets` a box of any number of pairs takes them bucket by bucket.
    """
    cuts = [f"cut_{s}" for s in SIDES]
    ends = _ends(pairs)
    mins = {c: F.when(F.col("pair.hit"), F.col(s)) for c, s in zip(cuts, SIDES)}
    if buckets:
        run = split_running(ends, [*PAGE, "n"], [F.col("other")], position_block(F.col("other"), PAIRS_OF_A_TASK), mins=mins, include_current=False)
    else:
        earlier = Window.partitionBy(*PAGE, "n").orderBy("other").rowsBetween(Window.unboundedPreceding, -1)
        run = ends.select("*", *[F.min(m).over(earlier).alias(c) for c, m in mins.items()])
    now = run.select(*PAGE, F.least("n", "other").alias("u"), F.greatest("n", "other").alias("v"), "pair",
                     F.when(F.col("n") < F.col("other"), _cut_to("g", cuts)).alias("a"), F.when(F.col("n") > F.col("other"), _cut_to("g", cuts)).alias("b"))
    both = now.groupBy(*PAGE, "u", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.first("pair").alias("pair"))
    kept = [f"pair.{c}" for c in pairs.columns if c not in (*PAGE, "u", "v", "hit")]
    return both.select(*PAGE, "u", "v", *kept, F.col("pair.hit").alias("was"), _overlap(geo.region("a"), geo.region("b")).alias("hit"))


def resolve_overlaps(placements: DataFrame) -> DataFrame:
    """Split overlapping placements between separate source boxes, in pair order.

    Whether a pair still overlaps when its turn comes depends on the cuts of earlier pairs of its
    boxes. All pairs are taken to overlap at first, and all are then tested again at once: too many
    cuts before a pair make it miss, too few make it hit, so the true hits lie between every two rounds
    in a row and are found when a round changes nothing. A round settles at least the next pair of
    every chain, mostly far more, and pages without a change are done. One way for pages of any size.
    """
    pairs = stored(_separate_pairs(placements).withColumn("hit", F.lit(True)))
    most = pairs.agg(F.max(F.greatest("v", -F.col("u")))).first()[0] or 0
    parts, changed = [], True
    while changed:
        tested = stored(_hits(pairs, most >= PAIRS_OF_A_TASK))
        moved = tested.where("hit <> was").select(*PAGE).distinct()
        changed = moved.limit(1).count() > 0
        parts.append((tested.join(moved, list(PAGE), "left_anti") if changed else tested).drop("was"))
        pairs = tested.join(moved, list(PAGE), "left_semi").drop("was")
    done = reduce(DataFrame.unionByName, parts)
    cuts = _ends(done).where("pair.hit").groupBy(*PAGE, F.col("n").alias("boxno")).agg(
        F.first("g").alias("g"), *[F.min(s).alias(f"cut_{s}") for s in SIDES])
    cuts = cuts.select(*PAGE, "boxno", _cut_to("g", [f"cut_{s}" for s in SIDES]).alias("moved"))
    return placements.join(cuts, [*PAGE, "boxno"], "left").select(
        *[c for c in placements.columns if c not in PLACED],
        *[F.coalesce(f"moved.{s}", n).alias(n) for s, n in zip(SIDES, PLACED)], F.col("moved").isNotNull().alias("adjusted"))


# blockers --------------------------------------------------------------------------------

def blocker_regions(boxes: DataFrame) -> DataFrame:
    """Two padded regions per box (`kind` hard or shadow) that placements should not cross.

    `boxes`: book_id, page, boxno, l..b, width, height.
    """
    w, h = F.col("width"), F.col("height")
    g = geo.clip_region(geo.rounded(geo.region()), w, h)
    rows = staged(boxes.select(*PAGE, "boxno", *SIDES, "width", "height"), **dict(zip(SIDES, g)))
    rows = rows.where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))
    g, bw, bh = geo.region(), F.col("r") - F.col("l"), F.col("b") - F.col("t")

    def pad(size: Column, rule: tuple[float, float, float]) -> Column:
        return geo.half_even(geo.clip(size * F.lit(rule[2]), float(rule[0]), float(rule[1])))

    hard = geo.pad_region(g, pad(bw, HARD_X), pad(bh, HARD_Y), w, h)
    half = F.least(bw, F.greatest(F.lit(SHADOW_WIDTH_MIN), geo.half_even(bw * F.lit(SHADOW_WIDTH_RATIO)))) / F.lit(2.0)
    cx = geo.center_x(g)
    shade = pad(bh, SHADOW_Y)
    shadow = geo.Region(F.greatest(F.lit(0), geo.half_even(cx - half)), F.greatest(F.lit(0), g.t - shade),
                        F.least(w, geo.half_even(cx + half)), F.least(h, g.b + shade))

    def packed(kind: str, r: geo.Region) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[c.cast("bigint").alias(n) for c, n in zip(r, SIDES)])

    return rows.select(*PAGE, "boxno", F.explode(F.array(packed("hard", hard), packed("shadow", shadow))).alias("x")).select(
        *PAGE, "boxno", "x.*")


def blockers_in_search(boxes: DataFrame, search: DataFrame) -> DataFrame:
    """The blockers of other boxes that reach into the search window of a non-open box.

    A blocker outside the window cannot meet a ray of that search, so the pair is not made.
    `search`: book_id, page, boxno, l..b of the window.
    """
    match = ((F.col("a.boxno") != F.col("b.boxno")) & _overlap(geo.region("a"), geo.region("b")))
    pairs = near_pairs(search.select(*PAGE, "boxno", *SIDES), blocker_regions(boxes), PAGE, match)
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in PAGE], F.col("a.boxno").alias("boxno"),
                        F.col("b.boxno").alias("blocker"), F.col("b.kind").alias("kind"),
                        *[F.col(f"b.{n}").alias(n) for n in SIDES])


# render rows -----------------------------------------------------------------------------

PASSED_STYLES = ("rotation", "skew_x", "skew_y", "line_spacing", "font_size_width_percent")


def opposite_fill(fill: Column) -> Column:
    return F.when(F.lower(tx.strip(fill)) == "black", F.lit("white")).otherwise(F.lit("black"))


def render_rows(records: DataFrame, font: str = "default", fill: str = "black", gravity: str = "center",
                stroke_width: float = 3.0) -> DataFrame:
    """One drawing row per record: manual line breaks before the translation, the placement
    before the source region, the record's style before the default. Turns, spacing and size
    are passed on where the records have them; blank manual line breaks are none."""
    chosen = F.coalesce("fill", F.lit(fill))
    manual = F.when(tx.strip(F.col("manual_line_breaks")) != "", F.col("manual_line_breaks"))
    placed = F.col("pl").isNotNull()
    passed = [F.col(c).cast("double").alias(c) for c in PASSED_STYLES if c in records.columns]
    return records.select(
        *PAGE, "boxno", *passed, manual.alias("manual_line_breaks"), *[F.when(placed, F.col(p)).otherwise(F.col(s)).alias(s) for p, s in zip(PLACED, SIDES)],
        F.coalesce(manual, F.col("english_text")).alias("text"),
        F.coalesce(F.nullif(tx.strip(F.col("font")), F.lit("")), F.lit(font)).alias("font"), chosen.alias("fill"),
        F.coalesce("stroke", opposite_fill(chosen)).alias("stroke"),
        F.coalesce(F.col("stroke_width").cast("double"), F.lit(stroke_width)).alias("stroke_width"),
        F.coalesce("gravity", F.lit(gravity)).alias("gravity"), F.col("english_text").isNotNull().alias("translated"))


def clean_rows(records: DataFrame, clean_boxes: DataFrame, pages: DataFrame, padding: int = 4) -> DataFrame:
    """Regions to erase: closed records and manual boxes, padded and clipped to the page."""
    both = (records.where(~F.col("open_lettering")).select(*PAGE, "boxno", *SIDES, F.lit("record").alias("origin"))
            .unionByName(clean_boxes.select(*PAGE, "boxno", *SIDES, F.lit("manual").alias("origin"))))
    sized = both.join(pages.select(*PAGE, "width", "height"), list(PAGE))
    g = geo.pad_region(geo.rounded(geo.region()), padding, padding, F.col("width"), F.col("height"))
    return sized.select(*PAGE, "boxno", "origin", *g.columns()).where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))


def clamp_regions(rows: DataFrame, keep_bad: bool = False) -> DataFrame:
    """Round and clamp; `valid` tells rows that lie on the page. With `keep_bad` the others
    stay as they were."""
    g = geo.clip_region(geo.rounded(geo.region()), F.col("width"), F.col("height"))
    rows = staged(rows, **{f"c_{n}": c.cast("bigint") for n, c in zip(SIDES, g)})
    before = geo.is_positive(geo.rounded(geo.region())) if not keep_bad else F.lit(True)
    valid = before & (F.col("c_r") > F.col("c_l")) & (F.col("c_b") > F.col("c_t"))
    return rows.select(*[c for c in rows.columns if c not in SIDES and not c.startswith("c_")],
                       *[F.when(valid | F.lit(not keep_bad), F.col(f"c_{n}")).otherwise(F.col(n)).alias(n) for n in SIDES],
                       valid.alias("valid"))


def render_check(rows: DataFrame) -> DataFrame:
    """(key, code) of every range rule a drawing row breaks.

    Columns: l..b, width, height, text, rotation, skew_x, skew_y, line_spacing, stroke_width,
    min_point_size, max_point_size, font_size_width_percent, render_bleed (nullable = not set).
    """
    def finite(c: Column) -> Column:
        return ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))

    def broken(name: str, ok: Column) -> Column:
        value = F.col(name)
        return F.when(value.isNotNull() & ~(finite(value) & ok), F.lit(name))

    def within(name: str, limit: float) -> Column:
        return broken(name, F.abs(F.col(name)) <= limit)

    g = geo.region()
    all_finite = finite(g.l) & finite(g.t) & finite(g.r) & finite(g.b)
    clipped = geo.clip_region(geo.Region(*[c.cast("double") for c in g]), F.col("width"), F.col("height"))
    codes = F.array_compact(F.array(
        within("rotation", 180), within("skew_x", 60), within("skew_y", 60), within("line_spacing", 200),
        F.when(F.length("manual_line_breaks") > 100_000, F.lit("manual_line_breaks")),
        F.when(~F.coalesce(all_finite, F.lit(False)), F.lit("region")),
        F.when(all_finite & ~geo.is_positive(g), F.lit("empty_region")),
        F.when(all_finite & geo.is_positive(g) & ~geo.is_positive(clipped), F.lit("outside_page")),
        F.when(F.col("text").isNull(), F.lit("text")), broken("stroke_width", F.col("stroke_width") >= 0),
        broken("min_point_size", F.col("min_point_size") > 0), broken("max_point_size", F.col("max_point_size") > 0),
        broken("font_size_width_percent", (F.col("font_size_width_percent") > 0) & (F.col("font_size_width_percent") <= 100)),
        broken("render_bleed", F.col("render_bleed") >= 0),
        F.when(geo.half_even(F.coalesce(F.col("render_bleed"), F.lit(8))) > F.greatest("width", "height"), F.lit("render_bleed_page"))))
    return rows.select(*PAGE, "boxno", F.explode(codes).alias("code"))


def clean_box_check(rows: DataFrame, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(kept boxes clipped to the page, errors). A page with an error keeps none.

    `rows`: book_id, page, record_id, boxno, l..b, width, height.
    """
    def repeated(key: str, code: str) -> DataFrame:
        return (rows.where(F.col(key).isNotNull()).groupBy(*PAGE, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select(*PAGE, F.lit(code).alias("code"), F.col(key).cast("string").alias("key")))

    crowd = (rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
             .select(*PAGE, F.lit("too_many").alias("code"), F.lit(None).cast("string").alias("key")))
    finite = F.lit(True)
    for n in SIDES:
        finite = finite & F.coalesce(~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) < float("inf")), F.lit(False))
    g = geo.clip_region(geo.rounded(geo.region()), F.col("width"), F.col("height"))
    rid = F.col("record_id")
    code = (F.when(rid.isNull() | (rid == "") | (F.length(rid) > 200), "bad_record_id")
            .when(F.col("boxno").isNull() | (F.col("boxno") < 0), "bad_boxno")
            .when(~finite, "bad_region").when(~geo.is_positive(g), "outside_page"))
    own = rows.select(*PAGE, code.alias("code"), rid.alias("key")).where(F.col("code").isNotNull())
    errors = crowd.unionByName(repeated("record_id", "repeated_record_id")).unionByName(
        repeated("boxno", "repeated_boxno")).unionByName(own)
    kept = rows.join(errors.select(*PAGE).distinct(), list(PAGE), "left_anti")
    return kept.select(*PAGE, "record_id", "boxno", *[c.cast("bigint").alias(n) for c, n in zip(g, SIDES)]), errors


# brightness ------------------------------------------------------------------------------

def rank_percentile(values: DataFrame, keys: Sequence[str], value: str, ratio: float, name: str = "percentile") -> DataFrame:
    """The value at position round((n - 1) * ratio), ties to even, of each sorted group.

    Works on counts of distinct values, and groups are cut by value range.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    upto = split_running(counts, keys, [F.col(value)], F.floor(F.col(value)), sums={"upto": F.col("c")})
    ranked = upto.join(total, list(keys))
    target = F.bround((F.col("n") - 1) * F.lit(ratio), 0)
    return ranked.where(F.col("upto") > target).groupBy(*keys).agg(F.min(value).alias(name))


def _size(levels: str) -> Column:
    return F.aggregate(levels, F.lit(0).cast("bigint"), lambda n, x: n + x["__c"])


def _level(levels: str, ratio: float, kind: T.DataType) -> Column:
    """The value at a rank of sorted (value, count) levels: the last one that starts at or before it."""
    target = F.bround((_size(levels) - 1) * F.lit(ratio), 0)
    walked = F.aggregate(levels, F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast(kind).alias("at")), lambda done, x: F.struct(
        (done["upto"] + x["__c"]).alias("upto"), F.when(done["upto"] <= target, x["__v"]).otherwise(done["at"]).alias("at")))
    return walked["at"]


def tone(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Dominant brightness of each group of 0..255 samples: (keys.., dominant, median)."""
    v = F.col(value)
    kind = samples.schema[value].dataType
    counts = samples.where(v.isNotNull()).groupBy(*keys, v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    levels = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__v", "__c"))).alias("all"))  # a level is a row of it
    parts = levels.withColumns({"bright": F.filter("all", lambda x: x["__v"] >= 180), "dark": F.filter("all", lambda x: x["__v"] <= 90)})
    b, d = _size("bright") / _size("all"), _size("dark") / _size("all")
    dominant = (F.when((b >= 0.20) & (b >= d * 0.75), _level("bright", 0.70, kind)).when((d >= 0.20) & (d > b), _level("dark", 0.30, kind)))
    return parts.select(*keys, dominant.alias("dominant"), _level("all", 0.50, kind).alias("median"))


def recommended_fill(samples: DataFrame, keys: Sequence[str], fills: DataFrame, value: str = "value") -> DataFrame:
    """Black on light, white on dark, otherwise the fill that was asked for (`fills.fill`)."""
    level = F.coalesce("dominant", "median")
    choice = F.when(level >= 160, F.lit("black")).when(level <= 95, F.lit("white"))
    tones = tone(samples, keys, value).select(*keys, level.alias("brightness"), choice.alias("choice"))
    return fills.join(tones, list(keys), "left").withColumn("fill", F.coalesce("choice", "fill")).drop("choice")
