"""Rectangles in frame coordinates (0 to 1, from the top left), as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sharpsieve.config import ZONES

Box = dict[str, Column]
LEAST = 1e-6
#: Where a stored point (x, y) is seen, for each EXIF orientation from 2 to 8.
TURNS = {
    2: lambda x, y: (1 - x, y),
    3: lambda x, y: (1 - x, 1 - y),
    4: lambda x, y: (x, 1 - y),
    5: lambda x, y: (y, x),
    6: lambda x, y: (1 - y, x),
    7: lambda x, y: (1 - y, 1 - x),
    8: lambda x, y: (y, 1 - x),
}


def of(column: Column) -> Box:
    return {k: column[k] for k in "xywh"}


def literal(x: float, y: float, w: float, h: float) -> Box:
    return {k: F.lit(float(v)) for k, v in zip("xywh", (x, y, w, h), strict=True)}


def struct(box: Box) -> Column:
    return F.struct(*[box[k].cast("double").alias(k) for k in "xywh"])


def zone(name: str) -> Box:
    return literal(*ZONES[name])


def clip(box: Box) -> Box:
    """The part inside the unit square, with a positive extent."""
    x, y = (F.least(F.greatest(box[k], F.lit(0.0)), F.lit(1.0)) for k in "xy")
    return {"x": x, "y": y, "w": F.greatest(F.least(box["w"], 1 - x), F.lit(LEAST)), "h": F.greatest(F.least(box["h"], 1 - y), F.lit(LEAST))}


def reorient(box: Box, orientation: Column) -> Box:
    """From stored into viewed position; unknown orientations and 1 change nothing."""
    far = (box["x"] + box["w"], box["y"] + box["h"])
    out: Box = {}
    for key in "xywh":
        picked = F.when(F.lit(False), box[key])
        for value, turn in TURNS.items():
            (ax, ay), (bx, by) = turn(box["x"], box["y"]), turn(*far)
            left, top = F.least(ax, bx), F.least(ay, by)
            moved = clip({"x": left, "y": top, "w": F.greatest(F.greatest(ax, bx) - left, F.lit(LEAST)), "h": F.greatest(F.greatest(ay, by) - top, F.lit(LEAST))})
            picked = picked.when(orientation == value, moved[key])
        out[key] = picked.otherwise(box[key])
    return out


def area(box: Box) -> Column:
    return box["w"] * box["h"]


def to_pixels(box: Box, width: Column, height: Column) -> dict[str, Column]:
    """left, top, right, bottom in pixels: at least one pixel, inside the frame; halves go to even."""
    c = clip(box)
    left, top = F.rint(c["x"] * width).cast("int"), F.rint(c["y"] * height).cast("int")
    right = F.least(F.greatest(left + 1, F.rint((c["x"] + c["w"]) * width).cast("int")), width)
    bottom = F.least(F.greatest(top + 1, F.rint((c["y"] + c["h"]) * height).cast("int")), height)
    return {"left": left, "top": top, "right": right, "bottom": bottom}


def viewed_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height as seen: orientations 5 to 8 lie on their side."""
    lies = F.coalesce(orientation.isin(5, 6, 7, 8), F.lit(False))
    return F.when(lies, height).otherwise(width), F.when(lies, width).otherwise(height)


def from_focus_record(record: dict[str, Column], fraction: float = 0.12, least_half: float = 0.02) -> Column:
    """The box (struct, or null) of a camera's focus record.

    record: AFAreaXPosition, AFAreaYPosition, AFAreaWidth, AFAreaHeight, FocusPixel, ExifImageWidth, ExifImageHeight, ImageWidth, ImageHeight.
    """
    number = lambda name: record[name].try_cast("double")
    size = lambda axis: F.coalesce(*[F.when(number(f"{s}{axis}") != 0, number(f"{s}{axis}")) for s in ("ExifImage", "Image")])
    width, height = size("Width"), size("Height")
    pair = F.split(F.trim(record["FocusPixel"].cast("string")), r"\s+")
    given = number("AFAreaXPosition").isNotNull() & number("AFAreaYPosition").isNotNull()
    x = F.when(given, number("AFAreaXPosition")).otherwise(F.get(pair, F.lit(0)).try_cast("double")) / width
    y = F.when(given, number("AFAreaYPosition")).otherwise(F.get(pair, F.lit(1)).try_cast("double")) / height
    half = lambda name, extent: F.greatest(F.coalesce(F.when(number(name) != 0, number(name) / extent / 2), F.lit(fraction / 2)), F.lit(least_half))
    half_w, half_h = half("AFAreaWidth", width), half("AFAreaHeight", height)
    box = clip({"x": x - half_w, "y": y - half_h, "w": 2 * half_w, "h": 2 * half_h})
    return F.when(x.between(0, 1) & y.between(0, 1), struct(box))
