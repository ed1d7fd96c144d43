"""The whole run: files to rated reports, as one plan per step."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpsieve.config import Config
from sharpsieve.functions import boxes, capture, tiles
from sharpsieve.functions.rules import validate
from sharpsieve.operators import grouping, locate, rating
from sharpsieve.operators.scratch import Scratch
from sharpsieve.schema import BOX, REPORT
from sharpsieve.session import ship
from sharpsieve.sources import files as found
from sharpsieve.sources import images


def detections(frames: DataFrame, root: str | Path, config: Config) -> DataFrame:
    """frames with detection, by the configured chain."""
    candidates = []
    for name in config.subject.detectors:
        if name == "manual":
            entries, why = found.manual_boxes(frames.sparkSession, config.subject.sidecar)
            if entries is not None:
                frames = locate.join_by_longest_suffix(frames, entries, "box", out="_manual")
            candidates.append(locate.manual_candidate(F.col("_manual") if entries is not None else F.lit(None), why))
        elif name == "af-point":
            records, why = found.focus_records(frames.sparkSession, root)
            if records is not None:
                placed = records.withColumn("box", boxes.from_focus_record({k: F.col(k) for k in found.FOCUS_FIELDS}))
                frames = locate.join_by_path(frames, placed, "box", out="_focus")
            candidates.append(locate.focus_candidate(F.col("_focus") if records is not None else F.lit(None), F.col("orientation"), why))
        elif name == "face":
            candidates.append(locate.face_candidate())
        elif name == "saliency":
            candidates.append(locate.saliency_candidate(F.col("salient")))
        elif name == "zone":
            candidates.append(locate.zone_candidate(config.subject.zone))
        else:
            candidates.append(locate.null_candidate())
    located = frames.withColumn("detection", locate.chain(candidates))
    failed = F.struct(F.lit(None).cast(BOX).alias("box"), F.lit("none").alias("source"), F.lit("none").alias("confidence"), F.lit("file not analysed").alias("note"))
    return located.withColumn("detection", F.when(F.col("error").isNull(), F.col("detection")).otherwise(failed))


def sharpness(config: Config) -> dict[str, Column]:
    """The sharpness figures over tiles, tile_rows, tile_cols and detection.box."""
    t, rows, cols = F.col("tiles"), F.col("tile_rows"), F.col("tile_cols")
    box = boxes.clip(boxes.of(F.col("detection.box")))
    have = F.col("detection.box").isNotNull()
    x, y = tiles.focus_point(t, rows, cols)
    subject, background = F.when(have, tiles.within(t, rows, cols, box)), F.when(have, tiles.outside(t, rows, cols, box))
    return {
        "global_acutance": tiles.mean(t), "max_local_acutance": tiles.peak(t), "median_acutance": tiles.median(t),
        "sharp_fraction": tiles.sharp_fraction(t, config.sharpness.sharp_fraction_threshold), "focus_x": x, "focus_y": y,
        "subject_acutance": subject, "background_acutance": background,
        "subject_background_ratio": tiles.ratio(subject, background, config.sharpness.min_background_acutance), "subject_relative_acutance": tiles.relative(subject, tiles.peak(t)),
    }


def reports(frames: DataFrame, config: Config) -> DataFrame:
    """The report's columns up to grouping, and the fingerprint; failed files get zeros."""
    ok = F.col("error").isNull()
    told = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
    whole = {"subject_acutance", "background_acutance", "subject_background_ratio", "subject_relative_acutance"}
    sharp = F.struct(*[(F.when(ok, c) if k in whole else told(c)).cast("double").alias(k) for k, c in sharpness(config).items()])
    light = F.struct(*[told(F.col(k)).alias(k) for k in ("highlight_clipped", "shadow_clipped", "dynamic_range", "mean_luma", "contrast")])
    lean = capture.blur_figures(F.col("jxx"), F.col("jyy"), F.col("jxy"), tiles.peak(F.col("tiles")), config.sharpness.sharp_acutance)
    blur = F.struct(*[(F.when(ok, c).otherwise("unknown") if k == "likely_cause" else told(c)).alias(k) for k, c in lean.items()])
    margin = capture.reciprocal_margin(F.col("shutter_seconds"), F.col("focal_length"), F.col("focal_length_35mm"))
    taken = F.struct(
        capture.camera(F.col("make"), F.col("model")).alias("camera"), "lens", "iso", "aperture", "shutter_seconds", "focal_length", "focal_length_35mm", "timestamp", "orientation", margin.alias("reciprocal_margin"),
    )
    larger = F.coalesce(F.col("declared_width").cast("long") * F.col("declared_height") > F.col("frame_width").cast("long") * F.col("frame_height"), F.lit(False))
    size = [F.when(larger, F.col(f"declared_{x}")).otherwise(F.col(f"frame_{x}")) for x in ("width", "height")]
    width, height = boxes.viewed_size(*size, F.col("orientation"))
    grid = F.transform(F.sequence(F.lit(0), F.col("tile_rows") - 1), lambda r: F.transform(F.slice("tiles", r * F.col("tile_cols") + 1, F.col("tile_cols")), lambda v: F.round(v.cast("double"), 4)))
    return frames.select(
        "file_idx", "path", "filename", F.coalesce(F.when(ok, width), F.lit(0)).cast("int").alias("width"), F.coalesce(F.when(ok, height), F.lit(0)).cast("int").alias("height"),
        sharp.alias("sharpness"), light.alias("exposure"), blur.alias("blur"), "detection", taken.alias("capture"),
        F.lit(None).cast("int").alias("rating"), F.lit(None).cast("string").alias("label"),
        F.when(ok, F.array(F.concat(F.lit("loaded via "), "loader"))).otherwise(F.expr("cast(array() as array<string>)")).alias("reasons"),
        (F.when(ok, grid) if config.output.include_tile_map else F.lit(None).cast("array<array<double>>")).alias("tile_map"), "thumbnail", "error",
        F.when(ok, F.col("fingerprint")).alias("fingerprint"),
    )


def grouped(measured: DataFrame, config: Config) -> DataFrame:
    """measured with group_id (null for failed files, and without grouping)."""
    if not config.grouping.enabled:
        return measured.withColumn("group_id", F.lit(None).cast("int"))
    bits = config.grouping.hash_size**2
    usable = measured.where(F.col("fingerprint").isNotNull()).select("file_idx", "fingerprint", capture.epoch(F.col("capture.timestamp")).alias("t"))
    frames = usable.withColumn("h", F.col("fingerprint")[0]) if bits <= 64 else usable.withColumn("h", F.col("fingerprint"))
    ids = grouping.group_by_similarity(frames, max_distance=config.grouping.max_distance, max_gap=config.grouping.max_time_gap_seconds, hash_col="h", time_col="t", n_bits=64 * -(-bits // 64))
    return measured.join(ids, "file_idx", "left")


def run(spark: SparkSession, root: str | Path, config: Config | None = None) -> DataFrame:
    """The rated reports of all files under root; rules are checked before any file is read."""
    config = config or Config()
    validate(config.rating.rules, config.rating.rank_by)
    ship(spark)
    scratch = Scratch(spark)
    frames = images.read_frames(found.file_table(spark, root, config), root, config)
    measured = scratch.write(reports(detections(frames, root, config), config), "reports")
    ranked = rating.rank_in_groups(grouped(measured, config), rating.rank_score(config.rating.rank_by))
    return rating.rate(ranked, config.rating.rules).select(*REPORT)


def explain_one(spark: SparkSession, path: str | Path, config: Config | None = None) -> DataFrame:
    """The report of one file, rated without groups; a failed file isn't rated."""
    config = config or Config()
    validate(config.rating.rules, config.rating.rank_by)
    ship(spark)
    frames = images.read_frames(found.file_table(spark, path, config), path, config)
    one = reports(detections(frames, Path(path).parent, config), config.with_values(output__include_tile_map=True))
    alone = one.withColumns({"group_id": F.lit(None).cast("int"), "group_rank": F.lit(None).cast("int"), "group_size": F.lit(1)})
    rated = rating.rate(alone, config.rating.rules)
    sound = F.col("error").isNull()
    return rated.withColumns({"rating": F.when(sound, F.col("rating")), "label": F.when(sound, F.col("label"))}).select(*REPORT)
