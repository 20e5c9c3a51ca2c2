"""Column functions on pixel regions. A region is four columns: left, top, right, bottom."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Region(NamedTuple):
    l: Column
    t: Column
    r: Column
    b: Column

    def columns(self, names: tuple[str, str, str, str] = ("l", "t", "r", "b")) -> list[Column]:
        return [c.alias(n) for c, n in zip(self, names)]


def region(alias: str | None = None, prefix: str = "") -> Region:
    dot = f"{alias}." if alias else ""
    return Region(*[F.col(f"{dot}{prefix}{side}") for side in "ltrb"])


def half_even(value: Column) -> Column:
    """Round to the nearest whole number, ties to even."""
    return F.bround(value.cast("double"), 0).cast("bigint")


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


# sizes, overlaps -------------------------------------------------------------------------

def width(g: Region) -> Column:
    return F.greatest(F.lit(0), g.r - g.l)


def height(g: Region) -> Column:
    return F.greatest(F.lit(0), g.b - g.t)


def center_x(g: Region) -> Column:
    return (g.l + g.r) / F.lit(2.0)


def center_y(g: Region) -> Column:
    return (g.t + g.b) / F.lit(2.0)


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def gap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def x_overlap(a: Region, b: Region) -> Column:
    return overlap_1d(a.l, a.r, b.l, b.r)


def y_overlap(a: Region, b: Region) -> Column:
    return overlap_1d(a.t, a.b, b.t, b.b)


def x_gap(a: Region, b: Region) -> Column:
    return gap_1d(a.l, a.r, b.l, b.r)


def y_gap(a: Region, b: Region) -> Column:
    return gap_1d(a.t, a.b, b.t, b.b)


def area(g: Region) -> Column:
    return width(g) * height(g)


def intersection(a: Region, b: Region) -> Column:
    return x_overlap(a, b) * y_overlap(a, b)


def iou(a: Region, b: Region) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def containment(a: Region, b: Region) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def touches(a: Region, b: Region) -> Column:
    """True when the closed rectangles share at least a point."""
    return (a.r >= b.l) & (b.r >= a.l) & (a.b >= b.t) & (b.b >= a.t)


# polygons, clipping, scaling -----------------------------------------------------------

def polygon_region(points: Column, page_width: Column, page_height: Column) -> Region:
    xs = F.transform(points, lambda p: F.element_at(p, 1))
    ys = F.transform(points, lambda p: F.element_at(p, 2))
    return Region(
        clip(F.floor(F.array_min(xs)), 0, page_width),
        clip(F.floor(F.array_min(ys)), 0, page_height),
        clip(F.ceil(F.array_max(xs)), 0, page_width),
        clip(F.ceil(F.array_max(ys)), 0, page_height),
    )


def scale_points(points: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    keep = (from_w <= 0) | (from_h <= 0) | ((from_w == to_w) & (from_h == to_h))
    sx = F.when(keep, F.lit(1.0)).otherwise(F.try_divide(to_w, from_w))
    sy = F.when(keep, F.lit(1.0)).otherwise(F.try_divide(to_h, from_h))
    return F.transform(points, lambda p: F.array(F.element_at(p, 1) * sx, F.element_at(p, 2) * sy))


def scale_region(g: Region, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Region:
    sx = F.when(from_w > 0, F.try_divide(to_w, from_w)).otherwise(F.lit(1.0))
    sy = F.when(from_h > 0, F.try_divide(to_h, from_h)).otherwise(F.lit(1.0))
    return Region(half_even(g.l * sx), half_even(g.t * sy), half_even(g.r * sx), half_even(g.b * sy))


def clip_region(g: Region, page_width: Column, page_height: Column) -> Region:
    return Region(clip(g.l, 0, page_width), clip(g.t, 0, page_height),
                  clip(g.r, 0, page_width), clip(g.b, 0, page_height))


def rounded(g: Region) -> Region:
    return Region(*[half_even(c) for c in g])


def is_positive(g: Region) -> Column:
    return (g.r > g.l) & (g.b > g.t)


def pad_region(g: Region, pad_x, pad_y, page_width: Column, page_height: Column) -> Region:
    pad_x = pad_x if isinstance(pad_x, Column) else F.lit(pad_x)
    pad_y = pad_y if isinstance(pad_y, Column) else F.lit(pad_y)
    return Region(F.greatest(F.lit(0), g.l - pad_x), F.greatest(F.lit(0), g.t - pad_y),
                  F.least(page_width, g.r + pad_x), F.least(page_height, g.b + pad_y))


# tiles -----------------------------------------------------------------------------------

def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Start offsets; every tile has the same stride except the last, which ends at the edge."""
    if overlap >= tile:
        raise ValueError("tile overlap must be smaller than the tile")
    stride = tile - overlap
    last = length - F.lit(tile)
    steps = F.ceil(F.greatest(last, F.lit(0)) / F.lit(stride)).cast("int")
    regular = F.transform(F.sequence(F.lit(0), steps), lambda i: F.least(i * stride, last).cast("bigint"))
    return F.when(last <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(regular)


def shift_region(g: Region, dx: Column, dy: Column, page_width: Column, page_height: Column) -> Region:
    return clip_region(Region(g.l + dx, g.t + dy, g.r + dx, g.b + dy), page_width, page_height)


def touches_inner_edge(g: Region, tile: Region, page_width: Column, page_height: Column,
                       margin: int = 8) -> Column:
    return (((tile.l > 0) & (g.l <= tile.l + margin)) | ((tile.t > 0) & (g.t <= tile.t + margin))
            | ((tile.r < page_width) & (g.r >= tile.r - margin))
            | ((tile.b < page_height) & (g.b >= tile.b - margin)))


# thousandths boxes [ymin, xmin, ymax, xmax] ----------------------------------------------

def _into_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Move an interval that sticks out on one side back into 0..1000, then clamp it."""
    span = high - low
    under = (low < 0) & (high <= 1000)
    over = ~under & (high > 1000) & (low >= 0)
    new_low = F.when(under, F.lit(0.0)).when(over, F.greatest(F.lit(0.0), F.lit(1000.0) - span)).otherwise(low)
    new_high = F.when(under, F.least(F.lit(1000.0), span)).when(over, F.lit(1000.0)).otherwise(high)
    return clip(new_low, 0.0, 1000.0), clip(new_high, 0.0, 1000.0)


def thousandths_to_region(box: Column, page_width: Column, page_height: Column) -> Region:
    y0, y1 = _into_range(F.get(box, 0).cast("double"), F.get(box, 2).cast("double"))
    x0, x1 = _into_range(F.get(box, 1).cast("double"), F.get(box, 3).cast("double"))
    return Region(half_even(x0 / 1000 * page_width), half_even(y0 / 1000 * page_height),
                  half_even(x1 / 1000 * page_width), half_even(y1 / 1000 * page_height))


def thousandths_valid(box: Column) -> Column:
    """Four values with positive extent both before and after moving into range."""
    y0, y1 = _into_range(F.get(box, 0).cast("double"), F.get(box, 2).cast("double"))
    x0, x1 = _into_range(F.get(box, 1).cast("double"), F.get(box, 3).cast("double"))
    return F.coalesce((F.size(box) == 4) & (F.get(box, 2) > F.get(box, 0)) & (F.get(box, 3) > F.get(box, 1))
                      & (y1 > y0) & (x1 > x0), F.lit(False))


def region_to_thousandths(g: Region, page_width: Column, page_height: Column) -> Column:
    return F.array(half_even(g.t / page_height * 1000), half_even(g.l / page_width * 1000),
                   half_even(g.b / page_height * 1000), half_even(g.r / page_width * 1000))


# growing and cropping --------------------------------------------------------------------

def expand(g: Region, widen: Column, taller: Column, page_width: Column, page_height: Column) -> Region:
    """Grow around the centre by the two ratios, round, and stay on the page."""
    w = (g.r - g.l).cast("double") * (1 + widen) / 2
    h = (g.b - g.t).cast("double") * (1 + taller) / 2
    cx, cy = center_x(g), center_y(g)
    return Region(F.greatest(F.lit(0), half_even(cx - w)), F.greatest(F.lit(0), half_even(cy - h)),
                  F.least(page_width, half_even(cx + w)), F.least(page_height, half_even(cy + h)))


def expand_fallback(g: Region, page_width: Column, page_height: Column) -> Region:
    return expand(g, F.lit(1.0), F.lit(0.25), page_width, page_height)


def expand_to_container(g: Region, width_ratio: Column, container_min: Column, container_max: Column,
                        taller: Column, page_width: Column, page_height: Column) -> Region:
    """Widen to a share of the container and push back from whichever side sticks out."""
    left_wall, right_wall = container_min * page_width, container_max * page_width
    room = right_wall - left_wall
    target = F.least(room, F.greatest((g.r - g.l).cast("double"), room * width_ratio))
    cx, cy = center_x(g), center_y(g)
    half = (g.b - g.t).cast("double") * (1 + taller) / 2
    left, right = cx - target / 2, cx + target / 2
    right_pushed = F.when(left < left_wall, right + (left_wall - left)).otherwise(right)
    left_pushed = F.when(left < left_wall, left_wall).otherwise(left)
    final_left = F.when(right_pushed > right_wall, left_pushed - (right_pushed - right_wall)).otherwise(left_pushed)
    final_right = F.least(right_pushed, right_wall)
    zero = F.lit(0.0)
    return Region(half_even(F.greatest(zero, final_left)), half_even(F.greatest(zero, cy - half)),
                  half_even(F.least(page_width.cast("double"), final_right)),
                  half_even(F.least(page_height.cast("double"), cy + half)))


def _floor_half(value: Column) -> Column:
    return F.floor(value / F.lit(2)).cast("bigint")


def crop_with_margin(g: Region, page_width: Column, page_height: Column, margin: int) -> Region:
    """Window around a box; what would fall off one side is added to the other."""
    out: list[Column] = []
    for low, high, limit in ((g.l, g.r, page_width), (g.t, g.b, page_height)):
        half = _floor_half(high - low + 2 * margin)
        mid = _floor_half(low + high)
        start, end = mid - half, mid + half
        spill_low = F.greatest(F.lit(0), -start)
        spill_high = F.greatest(F.lit(0), end - limit)
        out.append(F.greatest(F.lit(0), F.greatest(start, F.lit(0)) - spill_high))
        out.append(F.least(limit, F.least(end, limit) + spill_low))
    return Region(out[0], out[2], out[1], out[3])


def inset_region(g: Region) -> tuple[Region, Column]:
    """Shrink a found area by 1 % (4 px at least) unless it is too small for that."""
    w, h = g.r - g.l, g.b - g.t
    step = F.greatest(F.lit(4), half_even(F.least(w, h) * F.lit(0.01)))
    step = F.when((w <= step * 2 + 4) | (h <= step * 2 + 4), F.lit(0)).otherwise(step).cast("bigint")
    return Region(g.l + step, g.t + step, g.r - step, g.b - step), step


def found_area_rejection(found: Region, source: Region, page_width: Column, page_height: Column,
                         hits: Column, cardinal_hits: Column) -> Column:
    w, h = found.r - found.l, found.b - found.t
    sw, sh = source.r - source.l, source.b - source.t
    not_wider = w <= F.greatest(sw + 4, half_even(sw * F.lit(1.15)))
    not_taller = h <= F.greatest(sh + 4, half_even(sh * F.lit(1.05)))
    return (F.when(cardinal_hits < 3, "insufficient_cardinal_ray_boundaries")
            .when(hits < 4, "insufficient_total_ray_boundaries")
            .when((w < 8) | (h < 8), "ray_region_too_small")
            .when(w * h > page_width * page_height * F.lit(0.5), "ray_region_too_large")
            .when(not_wider & not_taller, "ray_region_not_larger_than_ocr_box"))


# type sizes ------------------------------------------------------------------------------

STROKE_WIDTH = 3.0
MIN_POINT_SIZE = 14.0


def scaled_stroke_width(configured: Column, page_height: Column) -> Column:
    base = F.lit(STROKE_WIDTH)
    by_page = F.when(page_height > 0, F.greatest(base, F.bround(page_height * F.lit(0.0012), 0))).otherwise(base)
    by_page = F.coalesce(by_page, base)
    value = F.when(configured.isNotNull(), F.greatest(F.lit(0.0), configured.cast("double"))).otherwise(base)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.greatest(value, by_page))


def scaled_min_point(configured: Column, page_height: Column) -> Column:
    base = F.lit(MIN_POINT_SIZE)
    by_page = F.coalesce(F.when(page_height > 0, F.greatest(base, page_height * F.lit(0.008))), base)
    own = F.when(configured.isNotNull(), F.greatest(F.lit(1.0), configured.cast("double"))).otherwise(base)
    return F.greatest(own, by_page)


def scaled_max_point(min_configured: Column, max_configured: Column, region_width: Column,
                     region_height: Column, page_height: Column) -> Column:
    low = scaled_min_point(min_configured, page_height)
    by_width, by_height = region_width * F.lit(0.24), region_height * F.lit(0.30)
    page_cap = F.coalesce(F.when(page_height > 0, F.greatest(F.lit(1.0), page_height * F.lit(0.024))),
                          F.greatest(F.lit(1.0), by_width, by_height))
    cap = F.least(F.greatest(low, page_cap), F.greatest(low, by_width), F.greatest(low, by_height))
    wanted = F.greatest(F.lit(1.0), max_configured.cast("double"))
    return F.greatest(low, F.when(max_configured.isNotNull(), F.least(cap, wanted)).otherwise(cap))


def search_window(g: Region, page_width: Column, page_height: Column) -> Region:
    """Area around a box in which a text container is looked for."""
    w, h = g.r - g.l, g.b - g.t
    longest = half_even(F.greatest(w, h) * F.lit(1.5))
    pad_x = F.greatest(F.lit(80), half_even(w * F.lit(3.0)), longest)
    pad_y = F.greatest(F.lit(80), half_even(h * F.lit(3.0)), longest)
    return pad_region(g, pad_x, pad_y, page_width, page_height)
