"""Figures over a tile grid: array columns in row-major order, higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_RATIO = 999.0


def peak(tiles: Column) -> Column:
    return F.array_max(tiles).cast("double")


def mean(tiles: Column) -> Column:
    return F.aggregate(tiles, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(tiles) > 0, F.size(tiles))


def median(tiles: Column) -> Column:
    """The middle value, or the mean of the two middle ones; null without any."""
    ordered, n = F.array_sort(tiles), F.size(tiles)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low.cast("double") + high.cast("double")) / 2)


def sharp_fraction(tiles: Column, ratio: float = 0.5) -> Column:
    """Share of tiles that reach ratio of the peak; 0 where the peak isn't positive."""
    top = F.array_max(tiles)
    share = F.size(F.filter(tiles, lambda x: x >= top * ratio)) / F.when(F.size(tiles) > 0, F.size(tiles))
    return F.when(top <= 0, F.lit(0.0)).otherwise(share)


def focus_point(tiles: Column, rows: Column, cols: Column) -> tuple[Column, Column]:
    """Centre of the first tile that has the peak, as x and y from 0 to 1."""
    spot = F.array_position(tiles, F.array_max(tiles)) - 1
    return (spot % cols + 0.5) / cols, (F.floor(spot / cols) + 0.5) / rows


def inside(rows: Column, cols: Column, box: dict[str, Column]) -> "callable":
    """A test of a tile's place (from 0) for the box: at least one tile, never beyond the grid."""

    def span(start: Column, extent: Column, n: Column) -> tuple[Column, Column]:
        first = F.least(F.greatest(F.floor(start * n), F.lit(0)), n - 1)
        return first, F.least(F.greatest(F.ceil((start + extent) * n), first + 1), n)

    (left, right), (top, bottom) = span(box["x"], box["w"], cols), span(box["y"], box["h"], rows)

    def test(i: Column) -> Column:
        row, col = F.floor(i / cols), i % cols
        return (col >= left) & (col < right) & (row >= top) & (row < bottom)

    return test


def within(tiles: Column, rows: Column, cols: Column, box: dict[str, Column]) -> Column:
    """The peak inside the box."""
    test = inside(rows, cols, box)
    return F.array_max(F.filter(tiles, lambda x, i: test(i))).cast("double")


def outside(tiles: Column, rows: Column, cols: Column, box: dict[str, Column]) -> Column:
    """The median outside the box; 0 where the box holds everything."""
    test = inside(rows, cols, box)
    return F.coalesce(median(F.filter(tiles, lambda x, i: ~test(i))), F.lit(0.0))


def ratio(subject: Column, background: Column, least: float = 2.0) -> Column:
    """Subject by background, 999 at most; null for a background below `least`."""
    return F.when(background >= least, F.least(F.try_divide(subject, background), F.lit(MOST_RATIO)))


def relative(subject: Column, top: Column) -> Column:
    """Subject by the frame's peak, 1 at most; null without a positive peak."""
    return F.when(top > 0, F.least(subject / top, F.lit(1.0)))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints: longs, or arrays of longs."""
    return F.bit_count(a.bitwiseXOR(b))


def distance_of_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
