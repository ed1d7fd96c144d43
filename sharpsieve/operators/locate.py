"""Where the subject is: boxes joined from camera records and sidecars, and the chain of detectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharpsieve.functions import boxes, paths
from sharpsieve.schema import BOX


def join_by_path(
    frames: DataFrame, records: DataFrame, value: str, *, path_col: str = "path", record_path: str = "SourceFile", idx_col: str = "idx", out: str = "box", by_name: bool = True
) -> DataFrame:
    """frames with out: the record's value by full path (lower case), else by file name if only one record's path has that name.

    Of records with one path the last by idx_col counts (of equal ones the larger value). Left join: no frame is lost.
    """
    keyed = records.where(F.col(value).isNotNull()).select(paths.key(F.col(record_path)).alias("_key"), F.col(value).alias("_value"), F.col(idx_col).alias("_idx"))
    whole = keyed.groupBy("_key").agg(F.max_by("_value", F.struct("_idx", "_value")).alias("_value"))
    looked = frames.withColumn("_fkey", paths.key(F.col(path_col)))
    found = looked.join(whole, F.col("_fkey") == F.col("_key"), "left")
    if not by_name:
        return found.select(*frames.columns, F.col("_value").alias(out))
    single = whole.groupBy(paths.file_name(F.col("_key")).alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.any_value("_value").alias("_named")).where("_n = 1").drop("_n")
    found = found.join(single, paths.file_name(F.col("_fkey")) == F.col("_name"), "left")
    return found.select(*frames.columns, F.coalesce("_value", "_named").alias(out))


def join_by_longest_suffix(
    frames: DataFrame, entries: DataFrame, value: str, *, idx_col: str = "file_idx", path_col: str = "path", key_col: str = "key", entry_idx: str = "idx", out: str = "box"
) -> DataFrame:
    """frames with out: the value of the entry whose key is the longest run of a path's last parts (8 at most, any case); of equal keys the last by entry_idx."""
    keyed = entries.select(F.array_join(F.transform(paths.components(F.col(key_col)), F.lower), "/").alias("_key"), F.col(value).alias("_value"), F.col(entry_idx).alias("_order"))
    keyed = keyed.groupBy("_key").agg(F.max_by("_value", F.struct("_order", "_value")).alias("_value"))
    tails = frames.select(F.col(idx_col).alias("_idx"), F.explode(paths.trailing_keys(F.col(path_col))).alias("_t")).select("_idx", "_t.depth", F.col("_t.key").alias("_key"))
    best = tails.join(keyed, "_key").groupBy("_idx").agg(F.max_by("_value", "depth").alias(out))  # depths of a frame differ: no ties
    return frames.join(best, F.col(idx_col) == F.col("_idx"), "left").drop("_idx")


#: What notes say of a box, and of its absence.
NOTES = {
    "zone": "fixed region; an assumption about composition, not a measurement",
    "none": "subject detection disabled",
    "manual": "drawn by hand",
    "manual missing": "no hand-drawn box for this file",
    "af-point": "where the camera was told to focus",
    "af-point missing": "no autofocus coordinates recorded for this frame",
    "saliency": "statistical salience, not a recognised object",
    "saliency missing": "no region stood out from the background",
    "saliency too large": "salient region covers the whole frame",
    "chain missing": "no detector produced a subject",
}


@dataclass
class Candidate:
    """One detector's answer: a box (struct or null), what to say of it, and why there is none. unavailable: a reason for all frames."""

    name: str
    box: Column
    confidence: str = "none"
    note: str = ""
    missing: Column | str = "nothing found"
    source: str | None = None
    unavailable: str | None = None


def chain(candidates: Sequence[Candidate]) -> Column:
    """The first candidate with a box, as a detection struct; what came before it is told in the note."""
    none = F.lit(None).cast(BOX)
    trail: list[Column] = []
    picked: Column | None = None
    for c in candidates:
        if c.unavailable is not None:
            trail.append(F.lit(f"{c.name} unavailable ({c.unavailable})"))
            continue
        told = F.concat_ws("; ", *trail) if trail else None
        note = F.lit(c.note)
        if told is not None:
            note = F.concat(F.lit(f"{c.note} [after "), told, F.lit("]")) if c.note else F.concat(F.lit("after "), told)
        found = F.struct(c.box.cast(BOX).alias("box"), F.lit(c.source or c.name).alias("source"), F.lit(c.confidence).alias("confidence"), note.alias("note"))
        picked = F.when(c.box.isNotNull(), found) if picked is None else picked.when(c.box.isNotNull(), found)
        why = F.coalesce(F.lit(c.missing) if isinstance(c.missing, str) else c.missing, F.lit("nothing found"))
        trail.append(F.concat(F.lit(f"{c.name}: "), why))
    all_told = F.concat_ws("; ", *trail) if trail else F.lit(NOTES["chain missing"])
    nothing = F.struct(none.alias("box"), F.lit("none").alias("source"), F.lit("none").alias("confidence"), all_told.alias("note"))
    return nothing if picked is None else picked.otherwise(nothing)


def zone_candidate(name: str) -> Candidate:
    return Candidate("zone", boxes.struct(boxes.zone(name)), "low", NOTES["zone"], source=f"zone:{name}")


def null_candidate() -> Candidate:
    return Candidate("none", F.lit(None).cast(BOX), missing=NOTES["none"])


def manual_candidate(box: Column, unavailable: str | None = None) -> Candidate:
    clipped = F.when(box.isNotNull(), boxes.struct(boxes.clip(boxes.of(box))))
    return Candidate("manual", clipped, "high", NOTES["manual"], NOTES["manual missing"], unavailable=unavailable)


def focus_candidate(box: Column, orientation: Column, unavailable: str | None = None) -> Candidate:
    turned = F.when(box.isNotNull(), boxes.struct(boxes.reorient(boxes.of(box), orientation)))
    return Candidate("af-point", turned, "high", NOTES["af-point"], NOTES["af-point missing"], unavailable=unavailable)


def saliency_candidate(box: Column, most_area: float = 0.75) -> Candidate:
    covers = F.when(box.isNotNull(), boxes.area(boxes.of(box)) > most_area)
    missing = F.when(covers, NOTES["saliency too large"]).otherwise(NOTES["saliency missing"])
    return Candidate("saliency", F.when(~covers, box), "low", NOTES["saliency"], missing)


def face_candidate(box: Column | None = None, eyes: Column | None = None) -> Candidate:
    """A recogniser's face boxes as a column; none comes with this library, as none of its dependencies recognises faces."""
    if box is None:
        return Candidate("face", F.lit(None).cast(BOX), unavailable="no face recogniser is installed")
    return Candidate("face", box, "medium", "detected face", "no face found")


def largest_face(faces: Column, *, least_width: float = 0.05, least_score: float = 0.9, prefer_eyes: bool = True, pad: float = 0.35) -> Column:
    """Of array<struct<x,y,w,h,score,left_eye,right_eye>> (eyes: struct<x,y> or null) the widest-area face that counts: struct<box, confidence>.

    With both eyes the box is theirs, padded by a share of their distance, and the confidence is high.
    """
    fit = F.filter(faces, lambda f: (f["w"] >= least_width) & (f["score"] >= least_score))
    ordered = F.array_sort(F.transform(fit, lambda f: F.struct((-(f["w"] * f["h"])).alias("order"), f.alias("face"))))
    face = F.get(ordered, F.lit(0))["face"]
    left, right = face["left_eye"], face["right_eye"]
    pad_by = F.hypot(left["x"] - right["x"], left["y"] - right["y"]) * pad
    x, y = F.least(left["x"], right["x"]) - pad_by, F.least(left["y"], right["y"]) - pad_by
    w, h = F.abs(left["x"] - right["x"]) + 2 * pad_by, F.abs(left["y"] - right["y"]) + 2 * pad_by
    eyes = left.isNotNull() & right.isNotNull() & F.lit(prefer_eyes)
    by_eyes = F.struct(boxes.struct(boxes.clip({"x": x, "y": y, "w": w, "h": h})).alias("box"), F.lit("high").alias("confidence"))
    by_face = F.struct(boxes.struct(boxes.clip(boxes.of(face))).alias("box"), F.lit("medium").alias("confidence"))
    return F.when(face.isNull(), F.lit(None)).when(eyes, by_eyes).otherwise(by_face)


def last_of_each(rows: DataFrame, key: str, idx: str) -> DataFrame:
    """Of rows with one key the last by idx."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(idx)))).where("_n = 1").drop("_n")
