"""The report: one row for each frame, and its flat view for rules and spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"
SHARPNESS = {
    "global_acutance": "double", "max_local_acutance": "double", "median_acutance": "double", "sharp_fraction": "double", "focus_x": "double", "focus_y": "double",
    "subject_acutance": "double", "background_acutance": "double", "subject_background_ratio": "double", "subject_relative_acutance": "double",
}
EXPOSURE = dict.fromkeys(("highlight_clipped", "shadow_clipped", "dynamic_range", "mean_luma", "contrast"), "double")
BLUR = {"anisotropy": "double", "dominant_axis_degrees": "double", "likely_cause": "string"}
DETECTION = {"box": BOX, "source": "string", "confidence": "string", "note": "string"}
CAPTURE = {
    "camera": "string", "lens": "string", "iso": "int", "aperture": "double", "shutter_seconds": "double", "focal_length": "double", "focal_length_35mm": "double",
    "timestamp": "string", "orientation": "int", "reciprocal_margin": "double",
}


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


REPORT = {
    "file_idx": "bigint", "path": "string", "filename": "string", "width": "int", "height": "int",
    "sharpness": _struct(SHARPNESS), "exposure": _struct(EXPOSURE), "blur": _struct(BLUR), "detection": _struct(DETECTION), "capture": _struct(CAPTURE),
    "group_id": "int", "group_rank": "int", "group_size": "int", "rating": "int", "label": "string", "reasons": "array<string>",
    "tile_map": "array<array<double>>", "thumbnail": "binary", "error": "string",
}
REPORT_DDL = ", ".join(f"{k} {v}" for k, v in REPORT.items())

#: Columns that lead the spreadsheet; the others follow by name.
LEAD = (
    "filename", "rating", "group_id", "group_rank", "group_size", "is_group_best", "subject_source", "subject_acutance", "background_acutance",
    "subject_background_ratio", "max_local_acutance", "sharp_fraction", "likely_cause", "highlight_clipped",
)

#: Names that a rule may use, with their types: the flat view of a report.
FLAT = (
    {"filename": "string", "width": "int", "height": "int", "group_id": "int", "group_rank": "int", "group_size": "int", "is_group_best": "boolean"}
    | {"subject_source": "string", "subject_confidence": "string", "subject_found": "boolean"}
    | SHARPNESS | EXPOSURE | BLUR
    | {k: v for k, v in CAPTURE.items() if k != "reciprocal_margin"}
    | {"reciprocal_margin": "double", "subject_or_max_acutance": "double"}
)


def flat_columns() -> dict[str, Column]:
    """The flat view as columns over the nested report."""
    nested = {f"{s}.{k}": k for s, fields in (("sharpness", SHARPNESS), ("exposure", EXPOSURE), ("blur", BLUR), ("capture", CAPTURE)) for k in fields}
    out = {k: F.col(k) for k in ("filename", "width", "height", "group_id", "group_rank", "group_size")}
    out["is_group_best"] = is_group_best(F.col("group_rank"), F.col("group_size"))
    out |= {"subject_source": F.col("detection.source"), "subject_confidence": F.col("detection.confidence"), "subject_found": F.col("detection.box").isNotNull()}
    out |= {k: F.col(path) for path, k in nested.items()}
    out["subject_or_max_acutance"] = F.coalesce("sharpness.subject_acutance", "sharpness.max_local_acutance")
    return {k: out[k] for k in FLAT}


def is_group_best(rank: Column, size: Column) -> Column:
    """First of a group of several; never null."""
    return F.coalesce((rank == 0) & (size > 1), F.lit(False))


def flatten(reports: DataFrame, *keep: str) -> DataFrame:
    """keep, then the flat view."""
    return reports.select(*keep, *[c.alias(k) for k, c in flat_columns().items() if k not in keep])


def csv_view(reports: DataFrame) -> DataFrame:
    """The spreadsheet's columns in their order: the flat view, rating and error, without path, label and reasons."""
    flat = reports.select(*[c.alias(k) for k, c in flat_columns().items()], "rating", F.coalesce("error", F.lit("")).alias("error"))
    return flat.select(*[c for c in LEAD if c in flat.columns], *sorted(c for c in flat.columns if c not in LEAD))
