"""Figures from capture data, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Without NULs and outer spaces; empty is missing."""
    return F.nullif(F.trim(F.regexp_replace(text, "\\x00", "")), F.lit(""))


def camera(make: Column, model: Column) -> Column:
    """The model alone if it starts with the make's first word, else make and model."""
    make, model = clean(make), clean(model)
    doubled = F.startswith(F.upper(model), F.get(F.split(F.upper(make), r"\s+"), F.lit(0)))
    return F.when(doubled, model).otherwise(F.nullif(F.concat_ws(" ", make, model), F.lit("")))


def reciprocal_margin(shutter: Column, focal: Column, focal_35mm: Column) -> Column:
    """Stops between the shutter and one over the focal length (its 35 mm equivalent if known); null unless both are positive."""
    length = F.coalesce(F.when(focal_35mm != 0, focal_35mm), focal)
    return F.when((length > 0) & (shutter > 0), F.log2(F.try_divide(F.try_divide(F.lit(1.0), length), shutter)))


def epoch(timestamp: Column) -> Column:
    """Seconds of 'YYYY:MM:DD HH:MM:SS' (parts may lack leading zeros), or null; the session's zone counts, so pin it."""
    parts = F.regexp_extract(F.trim(timestamp), r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$", 0)
    part = lambda k: F.lpad(F.regexp_extract(F.trim(timestamp), r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$", k), 4 if k == 1 else 2, "0")
    said = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    return F.when(parts != "", F.unix_timestamp(F.try_to_timestamp(said, F.lit("yyyy-MM-dd HH:mm:ss"))))


def blur_figures(jxx: Column, jyy: Column, jxy: Column, top: Column, sharp: float) -> dict[str, Column]:
    """Anisotropy, motion axis in degrees and likely cause, of a structure tensor's means."""
    trace = jxx + jyy
    flat = trace <= 1e-12
    spread = F.sqrt(F.greatest((jxx - jyy) * (jxx - jyy) + 4 * jxy * jxy, F.lit(0.0)))
    lean = spread / F.greatest(trace, F.lit(1e-12))
    axis = F.pmod(F.degrees(F.atan2(2 * jxy, jxx - jyy) / 2) + 90, F.lit(180.0))
    cause = F.when(flat, "featureless").when(top >= sharp, "sharp").when(lean >= 0.35, "motion").otherwise("defocus")
    return {
        "anisotropy": F.when(trace.isNull() | flat, F.lit(0.0)).otherwise(lean),
        "dominant_axis_degrees": F.when(trace.isNull() | flat, F.lit(0.0)).otherwise(axis),
        "likely_cause": F.when(trace.isNull(), F.lit("unknown")).otherwise(cause),
    }
