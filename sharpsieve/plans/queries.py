"""Registered queries: each operator over the star-schema tables that stand in for frames, and SQL that says the same.

embeddings.embedding (64 floats) is an 8 by 8 tile grid, and the grey levels of a small
picture that is measured as a decoded file is; events are measurements with sources and times; labels are a second run;
pages have paths. Everything runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpsieve.config import DEFAULT_RULES, ZONES, Config, Rule
from sharpsieve.functions import boxes, capture, paths, tiles
from sharpsieve.functions.rules import compile_value, condition, frame_names
from sharpsieve.operators import compare, grouping, locate, rating, summary
from sharpsieve.operators.scratch import Scratch
from sharpsieve.plans import run as plan
from sharpsieve.schema import FLAT, LEAD, is_group_best
from sharpsieve.session import ship
from sharpsieve.sinks import names
from sharpsieve.sources import images

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- tile figures ---------------------------------------------------------------

_TILES = "list_transform(embedding, lambda x: abs(x)::DOUBLE * 100)"


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, tiles: absolute values as acutances."""
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.transform("embedding", lambda x: F.abs(x).cast("double") * 100).alias("tiles"))


@query(f"SELECT vec_id, round(list_max(t), 6) AS peak, round(list_sum(t) / len(t), 6) AS mean, round(list_median(t), 6) AS median FROM (SELECT vec_id, {_TILES} AS t FROM embeddings)")
def tile_peak_mean_median(spark, sf):
    t = F.col("tiles")
    return grids(spark, sf).select("vec_id", F.round(tiles.peak(t), 6).alias("peak"), F.round(tiles.mean(t), 6).alias("mean"), F.round(tiles.median(t), 6).alias("median"))


@query(f"SELECT vec_id, round(CASE WHEN list_max(t) <= 0 THEN 0 ELSE len(list_filter(t, lambda x: x >= list_max(t) * 0.5)) / len(t) END, 6) AS sharp_fraction FROM (SELECT vec_id, {_TILES} AS t FROM embeddings)")
def tile_sharp_fraction(spark, sf):
    return grids(spark, sf).select("vec_id", F.round(tiles.sharp_fraction(F.col("tiles"), 0.5), 6).alias("sharp_fraction"))


@query(f"SELECT vec_id, round(((list_position(t, list_max(t)) - 1) % 8 + 0.5) / 8, 6) AS focus_x, round(((list_position(t, list_max(t)) - 1) // 8 + 0.5) / 8, 6) AS focus_y FROM (SELECT vec_id, {_TILES} AS t FROM embeddings)")
def tile_focus_point(spark, sf):
    x, y = tiles.focus_point(F.col("tiles"), F.lit(8), F.lit(8))
    return grids(spark, sf).select("vec_id", F.round(x, 6).alias("focus_x"), F.round(y, 6).alias("focus_y"))


def subject_figures(box: dict[str, Column], least: float = 2.0) -> dict[str, Column]:
    t, n = F.col("tiles"), F.lit(8)
    subject, background = tiles.within(t, n, n, box), tiles.outside(t, n, n, box)
    return {"subject": subject, "background": background, "ratio": tiles.ratio(subject, background, least), "relative": tiles.relative(subject, tiles.peak(t))}


# the zone "center" covers columns and rows 2 to 5
_INSIDE = "((i - 1) % 8 BETWEEN 2 AND 5 AND (i - 1) // 8 BETWEEN 2 AND 5)"
_SUBJECT = f"""SELECT vec_id, list_max(list_filter(t, lambda x, i: {_INSIDE})) AS subject, list_median(list_filter(t, lambda x, i: NOT {_INSIDE})) AS background, list_max(t) AS peak
  FROM (SELECT vec_id, {_TILES} AS t FROM embeddings)"""


@query(f"""SELECT vec_id, round(subject, 6) AS subject, round(background, 6) AS background,
  round(CASE WHEN background >= 8 THEN least(subject / background, 999) END, 6) AS ratio, round(CASE WHEN peak > 0 THEN least(subject / peak, 1) END, 6) AS relative FROM ({_SUBJECT})""")
def tile_subject_background(spark, sf):
    figures = subject_figures(boxes.zone("center"), least=8.0)
    return grids(spark, sf).select("vec_id", *[F.round(c, 6).alias(k) for k, c in figures.items()])


# --- frames from rows: pictures of 9 by 8 pixels, measured as decoded files are -----

WIDE, HIGH = 9, 8
#: Where the built pictures are said to be: names there tell the orientation, so no header is read.
BUILT = "built/"
MEASURING = Config().with_values(subject__detectors=["zone"], rating__rank_by="round(max_local_acutance * 51 / 100)")


def pictures(spark, sf, broken: Column | None = None) -> DataFrame:
    """key, image, as Spark's image source gives them: grey levels (steps of 5) from each vector's 64 values, taken round; broken ones don't decode."""
    level = F.transform("embedding", lambda x: (F.floor(F.greatest(F.least((x.cast("double") + 0.5) * 51, F.lit(51.0)), F.lit(0.0))) * 5).cast("int"))
    bytes_ = F.unhex(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WIDE * HIGH - 1)), lambda i: F.array_repeat(F.lpad(F.hex(F.get("_level", i % 64)), 2, "0"), 3))), ""))
    bad = F.lit(False) if broken is None else broken
    size = lambda n: F.when(bad, F.lit(-1)).otherwise(F.lit(n))
    image = F.struct(size(HIGH).alias("height"), size(WIDE).alias("width"), F.lit(3).alias("nChannels"), F.when(bad, F.lit(b"")).otherwise(bytes_).alias("data"))
    key = F.concat(F.lit(BUILT), F.col("vec_id").cast("string"), F.lit("-0.png"))
    rows = table(spark, sf, "embeddings").repartition(2 * spark.sparkContext.defaultParallelism)  # a small file is one task, and pictures take long
    return rows.withColumn("_level", level).select(key.alias("key"), image.alias("image"))


def measured(spark, sf, *wanted: str) -> DataFrame:
    """vec_id and the wanted figures of its picture."""
    ship(spark)
    return images.measure(pictures(spark, sf), BUILT, MEASURING, wanted).withColumn("vec_id", F.regexp_extract("key", r"(\d+)-0", 1).cast("long"))


_L = "list_transform(range(0, 72), lambda i: least(floor(greatest((embedding[i % 64 + 1]::DOUBLE + 0.5) * 51, 0)), 51)::BIGINT)"
_AT = "l[({r}) * 9 + ({c}) + 1]"
_RESP = "list_transform(range(0, 42), lambda k: abs(9 * " + _AT.format(r="k // 7 + 1", c="k % 7 + 1") + "".join(" - " + _AT.format(r=f"k // 7 + 1 + {i}", c=f"k % 7 + 1 + {j}") for i in (-1, 0, 1) for j in (-1, 0, 1)) + "))"
_PICTURES = f"(SELECT vec_id, label, {_L} AS l FROM embeddings)"


@query(f"""SELECT vec_id, 6 AS tile_rows, 7 AS tile_cols, list_max(t)::BIGINT AS peak, list_sum(t)::BIGINT AS total, (list_position(t, list_max(t)) - 1)::BIGINT AS first FROM (SELECT vec_id, {_RESP} AS t FROM {_PICTURES})""")
def frame_tiles(spark, sf):
    """Luma, Laplacian and tile grid: each tile of so small a picture is one response, told in steps of levels."""
    steps = F.transform("tiles", lambda x: F.round(x.cast("double") * 51 / 100).cast("long"))
    rows = measured(spark, sf, "tiles").select("vec_id", "tile_rows", "tile_cols", steps.alias("t"))
    return rows.select("vec_id", "tile_rows", "tile_cols", F.array_max("t").alias("peak"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.array_position("t", F.array_max("t")) - 1).alias("first"))


@query(f"""SELECT vec_id, len(list_filter(l, lambda x: x = 51))::BIGINT AS high, len(list_filter(l, lambda x: x = 0))::BIGINT AS low, list_sum(l)::BIGINT AS total,
round((quantile_cont(x, 0.995) - quantile_cont(x, 0.005)) * 1000)::BIGINT AS range, round(stddev_pop(x), 2) AS contrast FROM (SELECT vec_id, l, unnest(l) AS x FROM {_PICTURES}) GROUP BY vec_id, l""")
def frame_exposure(spark, sf):
    """Clipped pixels, sum, range (in thousandths) and deviation of luma, in steps of levels."""
    n = WIDE * HIGH
    count = lambda c, k: F.round(F.col(c) * k).cast("long")
    return measured(spark, sf, *images.LIGHT).select(
        "vec_id", count("highlight_clipped", n).alias("high"), count("shadow_clipped", n).alias("low"), count("mean_luma", 51 * n).alias("total"), count("dynamic_range", 51_000).alias("range"), F.round(F.col("contrast") * 51, 2).alias("contrast"),
    )


_GX = "CASE WHEN k % 9 = 0 THEN 2 * (l[k + 2] - l[k + 1]) WHEN k % 9 = 8 THEN 2 * (l[k + 1] - l[k]) ELSE l[k + 2] - l[k] END"
_GY = "CASE WHEN k < 9 THEN 2 * (l[k + 10] - l[k + 1]) WHEN k >= 63 THEN 2 * (l[k + 1] - l[k - 8]) ELSE l[k + 10] - l[k - 8] END"


@query(f"""SELECT vec_id, sum(x * x)::BIGINT AS jxx, sum(y * y)::BIGINT AS jyy, sum(x * y)::BIGINT AS jxy FROM (SELECT vec_id, unnest(list_transform(range(0, 72), lambda k: {_GX})) AS x, unnest(list_transform(range(0, 72), lambda k: {_GY})) AS y FROM {_PICTURES}) GROUP BY vec_id""")
def frame_structure(spark, sf):
    """The structure tensor: sums of squared half steps of levels."""
    return measured(spark, sf, "jxx", "jyy", "jxy").select("vec_id", *[F.round(F.col(x) * (51 * 51 * 4 * WIDE * HIGH)).cast("long").alias(x) for x in ("jxx", "jyy", "jxy")])


@query()
def frame_salience(spark, sf):
    """The salient box: a spectrum of the whole picture, which SQL has no way to say; kernels are tested against numpy of their own."""
    return measured(spark, sf, "salient").select("vec_id", *[F.round(f"salient.{x}", 6).alias(x) for x in "xywh"])


# --- fingerprints and groups ------------------------------------------------------

DISTANCE = 18
_H = f"h AS (SELECT vec_id, CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END::BIGINT AS h FROM (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda k: CASE WHEN l[k // 8 * 9 + k % 8 + 2] > l[k // 8 * 9 + k % 8 + 1] THEN (1::HUGEINT << (63 - k)::INTEGER) ELSE 0::HUGEINT END)) AS b FROM {_PICTURES}))"
_PAIRS = f"""{_H},
p AS (SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.h, y.h))::INTEGER AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.h, y.h)) <= {DISTANCE})"""
_GROUPS = f"""WITH RECURSIVE {_PAIRS},
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(n, m) AS (SELECT vec_id, vec_id FROM h UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
c AS (SELECT n AS vec_id, min(m) AS root FROM r GROUP BY n),
g AS (SELECT vec_id, dense_rank() OVER (ORDER BY root) - 1 AS group_id FROM c)"""


def hashed(spark, sf) -> DataFrame:
    return measured(spark, sf, "fingerprint").select("vec_id", F.col("fingerprint")[0].alias("fingerprint"))


@query(f"WITH {_H} SELECT vec_id, h AS fingerprint FROM h")
def dhash_bits(spark, sf):
    return hashed(spark, sf)


@query(f"WITH {_PAIRS} SELECT * FROM p")
def hamming_pairs(spark, sf):
    return grouping.hamming_pairs(hashed(spark, sf), DISTANCE, id_col="vec_id")


@query(f"""WITH {_PAIRS}, t AS (SELECT event_id, epoch(ts) AS t FROM events)
SELECT p.* FROM p LEFT JOIN t x ON x.event_id = a LEFT JOIN t y ON y.event_id = b WHERE NOT coalesce(abs(x.t - y.t) > 86400 * 3, false)""")
def hamming_pairs_time_gap(spark, sf):
    times = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    times = times.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("event_id")), "event_id", "left_semi")  # pairs are many: they meet the times of frames alone
    pairs = grouping.hamming_pairs(hashed(spark, sf), DISTANCE, id_col="vec_id")
    for side in "ab":
        pairs = pairs.join(times.select(F.col("event_id").alias(f"e{side}"), F.col("t").alias(f"t{side}")), F.col(side) == F.col(f"e{side}"), "left")
    return pairs.where(grouping.within_gap(F.col("ta"), F.col("tb"), 86400 * 3)).select("a", "b", "distance")


def groups(spark, sf) -> DataFrame:
    return grouping.group_by_similarity(hashed(spark, sf), max_distance=DISTANCE, id_col="vec_id").select("vec_id", "group_id")


@query(f"{_GROUPS} SELECT vec_id, group_id::INTEGER AS group_id FROM g")
def near_dup_groups(spark, sf):
    return groups(spark, sf)


_RANKED = f"""{_GROUPS}, s AS (SELECT g.vec_id, group_id, round(list_max({_TILES}), 1) AS score FROM g JOIN embeddings USING (vec_id)),
k AS (SELECT vec_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC NULLS LAST, vec_id) - 1 AS r, count(*) OVER (PARTITION BY group_id) AS n FROM s)"""


def ranked(spark, sf) -> DataFrame:
    both = grids(spark, sf).join(groups(spark, sf), "vec_id")
    return rating.rank_in_groups(both, F.round(tiles.peak(F.col("tiles")), 1), idx_col="vec_id")


@query(f"{_RANKED} SELECT vec_id, group_id::INTEGER AS group_id, r::INTEGER AS group_rank, n::INTEGER AS group_size, r = 0 AND n > 1 AS is_group_best FROM k")
def group_rank_best(spark, sf):
    return ranked(spark, sf).select("vec_id", "group_id", "group_rank", "group_size", is_group_best(F.col("group_rank"), F.col("group_size")).alias("is_group_best"))


#: The rules of runs over built pictures; thresholds lie between levels.
FEW_RULES = (Rule("max_local_acutance >= 401", 4, "green", "crisp"), Rule("is_group_best", 3, None, "best of its group"), Rule("group_size > 1", 2, None, "beaten"), Rule("True", 1, None, "nothing else"))


def run_of_pictures(spark, sf) -> DataFrame:
    """A whole run over built pictures: about every tenth doesn't decode, becomes a row with an error, takes no part in groups, and is rated all the same."""
    ship(spark)
    name = F.concat(F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".png"))
    said = {"file_idx": F.col("vec_id"), "path": F.concat(F.lit("/shoot/"), name), "filename": name, "loader": F.lit("image"), "pixels_at": F.concat(F.lit(BUILT), F.col("vec_id").cast("string"), F.lit("-0.png"))}
    fields = [part.split(" ") for part in images.HEADERS.split(", ")]
    headers = table(spark, sf, "embeddings").select(*(said.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in fields))
    head = images.joined(headers, images.measure(pictures(spark, sf, F.col("label") == 9), BUILT, MEASURING))
    return rated_run(plan.reports(plan.detections(head, "/shoot", MEASURING), MEASURING))


def rated_run(reports: DataFrame) -> DataFrame:
    """Groups, ranks (while ranking, a frame is alone and has no rank) and ratings of measured reports."""
    grouped = plan.grouped(Scratch(reports.sparkSession).write(reports, "reports"), PICTURE_RUN)
    return rating.rate(rating.rank_in_groups(grouped, rating.rank_score(PICTURE_RUN.rating.rank_by)), FEW_RULES)


PICTURE_RUN = MEASURING.with_values(grouping__max_distance=DISTANCE, rating__rank_by="round(max_local_acutance * 51 / 100) if group_size == 1 and group_rank is None else 0")
_RUN = f"""WITH RECURSIVE {_H},
u AS (SELECT vec_id, h FROM h JOIN embeddings USING (vec_id) WHERE label <> 9),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE bit_count(xor(x.h, y.h)) <= {DISTANCE}),
r(n, m) AS (SELECT vec_id, vec_id FROM u UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
c AS (SELECT n AS vec_id, min(m) AS root FROM r GROUP BY n),
g AS (SELECT vec_id, dense_rank() OVER (ORDER BY root) - 1 AS group_id FROM c),
t AS (SELECT vec_id, group_id, list_max({_RESP}) AS score FROM g JOIN {_PICTURES} USING (vec_id)),
k AS (SELECT vec_id, group_id, score, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, vec_id) - 1 AS r, count(*) OVER (PARTITION BY group_id) AS n FROM t),
w AS (SELECT v.vec_id, group_id, coalesce(r, 0) AS r, coalesce(n, 1) AS n, score, label = 9 AS bad FROM embeddings v LEFT JOIN k USING (vec_id))"""


@query(f"""{_RUN} SELECT vec_id AS file_idx, CASE WHEN bad THEN 0 ELSE 9 END AS width, CASE WHEN bad THEN 0 ELSE 8 END AS height, CASE WHEN bad THEN lpad(vec_id::VARCHAR, 6, '0') || '.png: the image would not decode' END AS error,
CASE WHEN bad THEN 'file not analysed' ELSE 'fixed region; an assumption about composition, not a measurement' END AS note, CASE WHEN bad THEN NULL ELSE 'loaded via image' END AS loaded FROM w""")
def failed_frames(spark, sf):
    """Files that don't decode are rows with an error, sizes of 0 and no loader."""
    loaded = F.get(F.filter("reasons", lambda x: F.startswith(x, F.lit("loaded via"))), F.lit(0))
    return run_of_pictures(spark, sf).select("file_idx", "width", "height", "error", F.col("detection.note").alias("note"), loaded.alias("loaded"))


@query(f"""{_RUN} SELECT vec_id AS file_idx, group_id::DOUBLE AS group_id, r::INTEGER AS group_rank, n::INTEGER AS group_size,
CASE WHEN NOT bad AND score * 100.0 / 51 >= 401 THEN 4 WHEN n > 1 AND r = 0 THEN 3 WHEN n > 1 THEN 2 ELSE 1 END AS rating FROM w""")
def run_groups_and_ratings(spark, sf):
    """Group ids go to usable frames alone; ranks come from an expression that sees each frame alone."""
    return run_of_pictures(spark, sf).select("file_idx", F.col("group_id").cast("double").alias("group_id"), "group_rank", "group_size", "rating")


def frames(spark, sf) -> DataFrame:
    """A flat report for each vector: figures of its tiles; labels stand for how the subject was found (0 and 1: by hand or face; 2: salience; else not)."""
    figures = subject_figures(boxes.zone("center"), least=2.0)
    base = ranked(spark, sf)
    found = F.col("label") < 3
    flat = base.select(
        "vec_id", "group_id", "group_rank", "group_size", is_group_best(F.col("group_rank"), F.col("group_size")).alias("is_group_best"),
        F.concat(F.lit("DSC_"), F.lpad(F.col("vec_id").cast("string"), 5, "0"), F.lit(".NEF")).alias("filename"),
        F.round(tiles.peak(F.col("tiles")), 6).alias("max_local_acutance"), F.when(found, F.round(figures["subject"], 6)).alias("subject_acutance"),
        F.when(found, F.round(figures["background"], 6)).alias("background_acutance"), F.when(found, F.round(figures["ratio"], 6)).alias("subject_background_ratio"),
        F.round(tiles.sharp_fraction(F.col("tiles")), 6).alias("sharp_fraction"), F.round(F.col("tiles")[0] / 300, 6).alias("highlight_clipped"),
        F.when(F.col("label") == 0, "high").when(F.col("label") == 1, "medium").when(F.col("label") == 2, "low").otherwise("none").alias("subject_confidence"),
        F.when(F.col("label") == 0, "manual").when(F.col("label") == 1, "face").when(F.col("label") == 2, "saliency").otherwise("none").alias("subject_source"),
        found.alias("subject_found"), F.when(F.col("label") == 9, "unreadable").alias("error"),
    )
    return flat


_FRAMES = f"""{_RANKED}, q AS ({_SUBJECT}),
f AS (SELECT k.vec_id, group_id, r, n, r = 0 AND n > 1 AS best, 'DSC_' || lpad(k.vec_id::VARCHAR, 5, '0') || '.NEF' AS filename, label, round(peak, 6) AS peak,
  CASE WHEN label < 3 THEN round(subject, 6) END AS subject, CASE WHEN label < 3 THEN round(background, 6) END AS background,
  CASE WHEN label < 3 AND background >= 2 THEN round(least(subject / background, 999), 6) END AS ratio,
  round(CASE WHEN list_max({_TILES}) <= 0 THEN 0 ELSE len(list_filter({_TILES}, lambda x: x >= peak * 0.5)) / 64 END, 6) AS sharp_fraction,
  round(abs(embedding[1])::DOUBLE * 100 / 300, 6) AS clipped, label <= 1 AS independent,
  CASE label WHEN 0 THEN 'manual' WHEN 1 THEN 'face' WHEN 2 THEN 'saliency' ELSE 'none' END AS source, CASE label WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS confidence,
  CASE WHEN label = 9 THEN 'unreadable' END AS error
  FROM k JOIN q USING (vec_id) JOIN embeddings USING (vec_id))"""

#: The default rules with thresholds that suit the stand-in figures' range.
LADDER = tuple(Rule(r.when.replace("max_local_acutance < 12", "max_local_acutance < 27").replace("max_local_acutance >= 25", "max_local_acutance >= 32"), r.stars, r.label, r.reason) for r in DEFAULT_RULES)
_CONDITIONS = ("clipped > 0.05", "peak < 27", "independent AND ratio < 0.9", "best AND independent AND ratio >= 1.5", "independent AND ratio >= 3", "best", "independent AND ratio >= 1.5", "n > 1 AND NOT best", "peak >= 32", "true")
_M = [f"coalesce({c}, false)" for c in _CONDITIONS]
_RATED = f"""{_FRAMES}, d AS (SELECT *, CASE {' '.join(f'WHEN {m} THEN {k}' for k, m in enumerate(_M) if k)} END AS hit FROM f),
z AS (SELECT *, CASE hit {' '.join(f'WHEN {k} THEN {r.stars}' for k, r in enumerate(LADDER) if r.stars is not None)} END AS rating,
  coalesce(CASE hit {' '.join(f"WHEN {k} THEN '{r.label}'" for k, r in enumerate(LADDER) if r.stars is not None and r.label)} END, CASE WHEN {_M[0]} THEN 'yellow' END) AS label2,
  CASE WHEN {_M[0]} THEN '{LADDER[0].reason}; ' ELSE '' END || CASE hit {' '.join(f"WHEN {k} THEN '{r.reason}'" for k, r in enumerate(LADDER) if k)} END AS reasons FROM d)"""


def rated(spark, sf) -> DataFrame:
    flat = frames(spark, sf)
    return rating.rate(flat, LADDER, frame_names(flat))


@query(f"{_RATED} SELECT vec_id, rating::INTEGER AS rating, label2 AS label, reasons FROM z")
def rule_ladder_default(spark, sf):
    return rated(spark, sf).select("vec_id", "rating", "label", F.concat_ws("; ", "reasons").alias("reasons"))


@query(f"{_RATED} SELECT vec_id, filename FROM z WHERE error IS NULL AND coalesce(rating, 0) >= 4")
def keepers(spark, sf):
    return rating.keepers(rated(spark, sf)).select("vec_id", "filename")


@query(f"{_RATED} SELECT vec_id, filename || chr(9) || reasons AS line FROM z WHERE error IS NULL AND rating <= 2")
def rejects(spark, sf):
    return rating.rejects(rated(spark, sf)).select("vec_id", F.concat_ws("\t", "filename", F.concat_ws("; ", "reasons")).alias("line"))


@query(f"""{_RATED} SELECT vec_id, rating::INTEGER AS rating, row_number() OVER (ORDER BY coalesce(rating, -1) DESC, ratio DESC NULLS LAST, vec_id) AS place FROM z
WHERE coalesce(rating, 0) >= 2 AND (error IS NOT NULL OR coalesce(rating, 5) <= 2) AND contains(lower(filename), 'dsc_0')""")
def sheet_filter_sort(spark, sf):
    rows = rated(spark, sf).where(summary.sheet_filter(least=2, problems=True, text=" DSC_0 "))
    return summary.numbered(rows, [*summary.sheet_order("rating"), F.col("vec_id")], "place").select("vec_id", "rating", "place")


@query(f"""{_RATED} SELECT count(*) AS total, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL) AS analysed, count(DISTINCT group_id) AS "groups",
count(*) FILTER (n > 1) AS in_multi_frame_groups, count(*) FILTER (label < 3) AS subject_found FROM z""")
def run_summary(spark, sf):
    return summary.summarise(rated(spark, sf))


@query(f"{_RATED} SELECT source AS key, count(*) AS n FROM z WHERE label < 3 GROUP BY source")
def count_by_source(spark, sf):
    return summary.counted(rated(spark, sf), F.col("subject_source"), F.col("subject_found"))


@query(f"{_RATED} SELECT rating::VARCHAR AS key, count(*) AS n FROM z WHERE rating IS NOT NULL GROUP BY rating")
def count_by_rating(spark, sf):
    return summary.counted(rated(spark, sf), F.col("rating"))


@query(f"{_RATED} SELECT DISTINCT source AS subject_source FROM z")
def detector_sources(spark, sf):
    return summary.sources(rated(spark, sf))


@query(f"""{_RATED} SELECT filename, rating::INTEGER AS rating, group_id::INTEGER AS group_id, r::INTEGER AS group_rank, n::INTEGER AS group_size, best AS is_group_best, source AS subject_source,
subject AS subject_acutance, background AS background_acutance, ratio AS subject_background_ratio, peak AS max_local_acutance, sharp_fraction, clipped AS highlight_clipped,
coalesce(error, '') AS error, confidence AS subject_confidence, label < 3 AS subject_found, coalesce(subject, peak) AS subject_or_max_acutance FROM z""")
def csv_flat_projection(spark, sf):
    rows = rated(spark, sf).withColumn("subject_or_max_acutance", F.coalesce("subject_acutance", "max_local_acutance")).withColumn("error", F.coalesce("error", F.lit("")))
    lead = [c for c in LEAD if c in rows.columns]
    return rows.select(*lead, *sorted(c for c in rows.columns if c not in lead and (c in FLAT or c == "error")))


# --- the rule language ------------------------------------------------------------

_EVENTS = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 4) END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind, (event_id % 6 - 2)::BIGINT AS k FROM events)"


def gapped(spark, sf) -> DataFrame:
    """events with gaps: v and kind are missing in some rows; k runs from -2 to 3."""
    e = table(spark, sf, "events")
    gap = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    return e.select("event_id", "user_id", gap(7, F.round("value", 4)).alias("v"), gap(5, F.col("event_type")).alias("kind"), (F.col("event_id") % 6 - 2).alias("k"))


#: name: (rule, its kind, SQL over v, kind, k)
RULES = {
    "rule_ordered": ("v > 50", "bool", "coalesce(v > 50, false)"),
    "rule_not_ordered": ("not (v > 50)", "bool", "NOT coalesce(v > 50, false)"),
    "rule_equality": ('kind == "click" or v == None', "bool", "coalesce(kind = 'click', false) OR v IS NULL"),
    "rule_inequality": ('kind != "click"', "bool", "kind IS DISTINCT FROM 'click'"),
    "rule_chain": ("10 < v <= 60 != k", "bool", "coalesce(10 < v AND v <= 60, false) AND k IS DISTINCT FROM 60"),
    "rule_membership": ('kind in ["click", "view"] and k not in [1, None]', "bool", "coalesce(kind IN ('click', 'view'), false) AND k IS DISTINCT FROM 1 AND k IS NOT NULL"),
    "rule_contains": ('"ic" in kind', "bool", "coalesce(contains(kind, 'ic'), false)"),
    "rule_not_contains": ('"ic" not in kind', "bool", "coalesce(NOT contains(kind, 'ic'), false)"),
    "rule_identity": ("v is None or k is not None and kind is not None", "bool", "v IS NULL OR kind IS NOT NULL"),
    "rule_boolean": ("v and not kind or k", "bool", "(coalesce(v <> 0, false) AND NOT coalesce(kind <> '', false)) OR k <> 0"),
    "rule_arithmetic": ("v * 2 - k + 1", "number", "v * 2 - k + 1"),
    "rule_sign": ("-v + +k", "number", "-v + k"),
    "rule_division": ("v / k", "number", "CASE WHEN k <> 0 THEN v / k END"),
    "rule_modulo": ("k % -4 + v % 3", "number", "CASE WHEN k > 0 THEN k - 4 ELSE k END + v % 3.0::DOUBLE"),
    "rule_modulo_zero": ("v % k", "number", "CASE WHEN k > 0 THEN (v % k::DOUBLE) WHEN k < 0 AND (v % k::DOUBLE) > 0 THEN (v % k::DOUBLE) + k WHEN k < 0 AND v IS NOT NULL THEN 0 END"),
    "rule_modulo_fraction": ("v % 0.1 + -v % 0.7", "number", "v % 0.1::DOUBLE + CASE WHEN (v % 0.7::DOUBLE) > 0 THEN 0.7 - (v % 0.7::DOUBLE) ELSE 0 END"),
    "rule_power": ("k ** 2 + (k + 3) ** -1", "number", "k * k + 1.0 / (k + 3)"),
    "rule_power_undefined": ("k ** -1", "number", "CASE WHEN k <> 0 THEN 1.0 / k END"),
    "rule_choice": ('v if kind == "click" else k', "number", "CASE WHEN coalesce(kind = 'click', false) THEN v ELSE k END"),
    "rule_calls": ("max(v, k) - min([v, 10]) + abs(k)", "number", "CASE WHEN v IS NOT NULL THEN greatest(v, k) - least(v, 10) + abs(k) END"),
    "rule_round": ("round(v) + round(k / 2)", "number", "round_even(v, 0) + round_even(k / 2.0, 0)"),
    "rule_length": ("len(kind) + len([1, 2])", "number", "length(kind) + 2"),
    "rule_text": ('kind + "!" if kind else "none"', "text", "CASE WHEN coalesce(kind <> '', false) THEN kind || '!' ELSE 'none' END"),
}


def _rule(name: str, source: str, kind: str):
    def run(spark, sf):
        rows = gapped(spark, sf)
        names = frame_names(rows)
        value = condition(source, names) if kind == "bool" else compile_value(source, names).column
        return rows.select("event_id", (F.round(value.cast("double"), 6) if kind == "number" else value).alias("result"))

    run.__name__ = name
    return run


for _name, (_source, _kind, _sql) in RULES.items():
    _told = f"round(({_sql})::DOUBLE, 6)" if _kind == "number" else f"({_sql})"
    query(f"SELECT event_id, {_told} AS result FROM {_EVENTS}")(_rule(_name, _source, _kind))


@query("SELECT o_orderkey, coalesce(o_totalprice / 1000 >= 100, false) AND NOT coalesce(o_orderkey % 3 = 0, false) AS hit FROM orders")
def rule_over_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rows.select("o_orderkey", condition("o_totalprice / 1000 >= 100 and not o_orderkey % 3 == 0", frame_names(rows)).alias("hit"))


# --- measurements as columns --------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN jxx + jyy <= 1e-12 THEN 0 ELSE s / (jxx + jyy) END, 6) AS anisotropy,
CASE WHEN jxx + jyy <= 1e-12 THEN 'featureless' WHEN l_quantity >= 40 THEN 'sharp' WHEN s / (jxx + jyy) >= 0.35 THEN 'motion' ELSE 'defocus' END AS likely_cause
FROM (SELECT *, sqrt((jxx - jyy) * (jxx - jyy) + 4 * jxy * jxy) AS s FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount AS jxx, l_tax AS jyy, l_discount * l_tax AS jxy FROM lineitem))""")
def blur_figures(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("top"), F.col("l_discount").cast("double").alias("jxx"), F.col("l_tax").cast("double").alias("jyy"))
    lean = capture.blur_figures(F.col("jxx"), F.col("jyy"), F.col("jxx") * F.col("jyy"), F.col("top"), 40.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(lean["anisotropy"], 6).alias("anisotropy"), lean["likely_cause"].alias("likely_cause"))


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 5 > 0 THEN log2((1.0 / f) / ((p_partkey % 5) / 100.0)) END, 6) AS margin
FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_size * 2.0 ELSE p_size * 1.0 END AS f FROM part)""")
def reciprocal_margin(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size").cast("double")
    wide = F.when(p % 4 == 0, F.lit(0.0)).when(p % 4 != 1, size)
    return table(spark, sf, "part").select("p_partkey", F.round(capture.reciprocal_margin((p % 5) / 100, size * 2, wide), 6).alias("margin"))


@query("""SELECT s_suppkey, CASE WHEN starts_with(upper(model), split_part(upper(make), ' ', 1)) THEN model ELSE make || ' ' || model END AS camera
FROM (SELECT s_suppkey, n_name || ' CORPORATION' AS make, CASE WHEN s_suppkey % 2 = 0 THEN n_name || ' D' || s_suppkey ELSE 'X-T' || s_suppkey END AS model FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def camera_name(spark, sf):
    both = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    model = F.when(F.col("s_suppkey") % 2 == 0, F.concat("n_name", F.lit(" D"), key)).otherwise(F.concat(F.lit("X-T"), key))
    return both.select("s_suppkey", capture.camera(F.concat(F.lit(" "), "n_name", F.lit(" CORPORATION\x00")), model).alias("camera"))


_BOX = "SELECT c_custkey, (c_custkey % 13 - 3) / 10.0 AS x, (c_custkey % 7 - 1) / 8.0 AS y, (c_custkey % 5 + 1) / 6.0 AS w, (c_custkey % 3 + 1) / 4.0 AS h FROM customer"
_CLIP = "SELECT *, least(greatest(x, 0), 1) AS cx, least(greatest(y, 0), 1) AS cy, greatest(least(w, 1 - least(greatest(x, 0), 1)), 1e-6) AS cw, greatest(least(h, 1 - least(greatest(y, 0), 1)), 1e-6) AS ch FROM "


def boxed(spark, sf) -> tuple[DataFrame, dict]:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", ((k % 13 - 3) / 10).alias("x"), ((k % 7 - 1) / 8).alias("y"), ((k % 5 + 1) / 6).alias("w"), ((k % 3 + 1) / 4).alias("h"))
    return rows, {c: F.col(c) for c in "xywh"}


@query(f"SELECT c_custkey, round(cx, 6) AS x, round(cy, 6) AS y, round(cw, 6) AS w, round(ch, 6) AS h FROM ({_CLIP} ({_BOX}))")
def box_clip(spark, sf):
    rows, box = boxed(spark, sf)
    return rows.select("c_custkey", *[F.round(c, 6).alias(k) for k, c in boxes.clip(box).items()])


@query(f"""SELECT c_custkey, round(cx, 6) AS x, round(cy, 6) AS y, round(cw, 6) AS w, round(ch, 6) AS h FROM ({_CLIP} (SELECT c_custkey,
CASE o WHEN 2 THEN 1 - x - w WHEN 3 THEN 1 - x - w WHEN 5 THEN y WHEN 6 THEN 1 - y - h WHEN 7 THEN 1 - y - h WHEN 8 THEN y ELSE x END AS x,
CASE o WHEN 3 THEN 1 - y - h WHEN 4 THEN 1 - y - h WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 1 - x - w WHEN 8 THEN 1 - x - w ELSE y END AS y,
CASE WHEN o >= 5 THEN h ELSE w END AS w, CASE WHEN o >= 5 THEN w ELSE h END AS h FROM (SELECT *, c_custkey % 9 AS o FROM (SELECT c_custkey, cx AS x, cy AS y, cw AS w, ch AS h FROM ({_CLIP} ({_BOX})))))) """)
def box_reorient(spark, sf):
    rows, box = boxed(spark, sf)
    moved = boxes.clip(boxes.reorient(boxes.clip(box), (F.col("c_custkey") % 9).cast("int")))
    return rows.select("c_custkey", *[F.round(c, 6).alias(k) for k, c in moved.items()])


@query(f"""SELECT c_custkey, l::INTEGER AS "left", t::INTEGER AS top, least(greatest(l + 1, round_even((cx + cw) * 600, 0)), 600)::INTEGER AS "right", least(greatest(t + 1, round_even((cy + ch) * 400, 0)), 400)::INTEGER AS bottom
FROM (SELECT *, round_even(cx * 600, 0) AS l, round_even(cy * 400, 0) AS t FROM ({_CLIP} ({_BOX})))""")
def box_pixels(spark, sf):
    rows, box = boxed(spark, sf)
    return rows.select("c_custkey", *[c.alias(k) for k, c in boxes.to_pixels(box, F.lit(600), F.lit(400)).items()])


@query("SELECT o_orderkey, CASE WHEN o % 9 BETWEEN 5 AND 8 THEN 400 ELSE 600 END AS width, CASE WHEN o % 9 BETWEEN 5 AND 8 THEN 600 ELSE 400 END AS height FROM (SELECT o_orderkey, o_orderkey AS o FROM orders)")
def viewed_size(spark, sf):
    width, height = boxes.viewed_size(F.lit(600), F.lit(400), F.col("o_orderkey") % 9)
    return table(spark, sf, "orders").select("o_orderkey", width.alias("width"), height.alias("height"))


@query("""SELECT event_id, CASE WHEN cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 THEN round(greatest(cx - hw, 0), 6) END AS x, CASE WHEN cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 THEN round(greatest(cy - hh, 0), 6) END AS y,
CASE WHEN cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 THEN round(least(2 * hw, 1 - greatest(cx - hw, 0)), 6) END AS w, CASE WHEN cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 THEN round(least(2 * hh, 1 - greatest(cy - hh, 0)), 6) END AS h
FROM (SELECT event_id, (user_id % 7000) / 6016.0 AS cx, (event_id % 4500) / 4016.0 AS cy, greatest(CASE WHEN event_id % 4 = 0 THEN 984 / 6016.0 / 2 ELSE 0.06 END, 0.02) AS hw, greatest(CASE WHEN event_id % 4 = 0 THEN 16 / 4016.0 / 2 ELSE 0.06 END, 0.02) AS hh FROM events)""")
def focus_record_box(spark, sf):
    """Camera focus records: most as two positions, each third as a pair in a text; some with an area."""
    e = table(spark, sf, "events")
    x, y = (F.col("user_id") % 7000).cast("string"), (F.col("event_id") % 4500).cast("string")
    pair, sized = F.col("event_id") % 3 == 0, F.col("event_id") % 4 == 0
    record = {
        "AFAreaXPosition": F.when(~pair, x), "AFAreaYPosition": F.when(~pair, y), "FocusPixel": F.when(pair, F.concat_ws(" ", x, y)), "AFAreaWidth": F.when(sized, "984"), "AFAreaHeight": F.when(sized, "16"),
        "ExifImageWidth": F.when(F.col("event_id") % 2 == 0, "6016"), "ImageWidth": F.lit("6016"), "ExifImageHeight": F.lit("4016"), "ImageHeight": F.lit(None).cast("string"),
    }
    return e.select("event_id", boxes.from_focus_record(record).alias("b")).select("event_id", *[F.round(F.col(f"b.{k}"), 6).alias(k) for k in "xywh"])


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::DOUBLE END AS seconds FROM events""")
def capture_time(spark, sf):
    """Times written as cameras do, some of them not times at all."""
    said = F.when(F.col("event_id") % 11 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("ts", "yyyy:M:dd HH:m:ss"))
    return table(spark, sf, "events").select("event_id", capture.epoch(said).cast("double").alias("seconds"))


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'manual' WHEN event_id % 3 = 1 AND value > 50 THEN 'saliency' ELSE 'zone:left-third' END AS source,
CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence,
CASE WHEN event_id % 3 = 0 THEN 'drawn by hand [after af-point unavailable (no tool)]'
WHEN event_id % 3 = 1 AND value > 50 THEN 'statistical salience, not a recognised object [after af-point unavailable (no tool); manual: no hand-drawn box for this file]'
ELSE 'fixed region; an assumption about composition, not a measurement [after af-point unavailable (no tool); manual: no hand-drawn box for this file; saliency: ' ||
CASE WHEN event_id % 3 = 1 THEN 'salient region covers the whole frame' ELSE 'no region stood out from the background' END || ']' END AS note,
(CASE WHEN event_id % 3 = 0 THEN 0.5 WHEN event_id % 3 = 1 AND value > 50 THEN 0.25 ELSE {ZONES["left-third"][0]} END)::DOUBLE AS x FROM events""")
def detector_chain(spark, sf):
    k, none = F.col("event_id") % 3, F.lit(None)
    hand = F.when(k == 0, boxes.struct(boxes.literal(0.5, 0.5, 0.2, 0.2)))
    salient = F.when(k == 1, F.when(F.col("value") > 50, boxes.struct(boxes.literal(0.25, 0.25, 0.5, 0.5))).otherwise(boxes.struct(boxes.literal(0, 0, 1, 0.9))))
    links = [locate.focus_candidate(none, none, "no tool"), locate.manual_candidate(hand), locate.saliency_candidate(salient), locate.zone_candidate("left-third"), locate.null_candidate()]
    found = table(spark, sf, "events").select("event_id", locate.chain(links).alias("d"))
    return found.select("event_id", "d.source", "d.confidence", "d.note", F.col("d.box.x").alias("x"))


# --- joins by path --------------------------------------------------------------------


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")


_NAME = "split_part(lower(url), '/', -1)"


@query("""WITH r AS (SELECT lower(url) AS u, arg_max(page_id, page_id * 7 % 11 * 1000000000 + page_id) AS v FROM pages WHERE page_id % 3 = 0 GROUP BY 1)
SELECT page_id, url, v::DOUBLE AS focus FROM pages LEFT JOIN r ON u = lower(url)""")
def af_path_join(spark, sf):
    """Each third page has a record under its path in capitals, in an order of its own; without the fallback by name."""
    records = pages(spark, sf).where(F.col("page_id") % 3 == 0).select(F.upper("url").alias("SourceFile"), F.col("page_id").alias("v"), (F.col("page_id") * 7 % 11).alias("idx"))
    found = locate.join_by_path(pages(spark, sf), records, "v", path_col="url", out="focus", by_name=False)
    return found.select("page_id", "url", F.col("focus").cast("double").alias("focus"))


@query(f"""WITH r AS (SELECT lower(url) AS u, {_NAME} AS name, max(page_id) AS v FROM pages WHERE page_id % 2 = 0 GROUP BY ALL), s AS (SELECT name, max(v) AS v FROM r GROUP BY name HAVING count(*) = 1)
SELECT p.page_id, coalesce(r.v, s.v)::DOUBLE AS focus FROM pages p LEFT JOIN r ON r.u = lower(p.url) LEFT JOIN s ON s.name = split_part(lower(p.url), '/', -1)""")
def af_unique_basename(spark, sf):
    """By path, else by file name where one record only has it."""
    records = pages(spark, sf).where(F.col("page_id") % 2 == 0).select(F.col("url").alias("SourceFile"), F.col("page_id").alias("v"), F.col("page_id").alias("idx"))
    return locate.join_by_path(pages(spark, sf), records, "v", path_col="url", out="focus").select("page_id", F.col("focus").cast("double").alias("focus"))


_PARTS = "list_filter(string_split(lower(url), '/'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT page_id, {_PARTS} AS p FROM pages), e AS (SELECT array_to_string(p[-(1 + page_id % 3):], '/') AS key, min(page_id) * 2 AS v FROM t WHERE page_id % 5 = 0 GROUP BY 1),
x AS (SELECT page_id, d, array_to_string(p[-d:], '/') AS key FROM (SELECT page_id, p, unnest(range(1, least(len(p), 8) + 1)) AS d FROM t)),
b AS (SELECT page_id, arg_max(v, d) AS v FROM x JOIN e USING (key) GROUP BY page_id)
SELECT page_id, b.v::DOUBLE AS box FROM pages LEFT JOIN b USING (page_id)""")
def longest_suffix_match(spark, sf):
    """Each fifth page gives an entry under its last one to three path parts."""
    parts = paths.components(F.col("url"))
    entries = pages(spark, sf).where(F.col("page_id") % 5 == 0).select(F.array_join(F.slice(parts, -F.least(1 + F.col("page_id") % 3, F.size(parts)).cast("int"), 8), "/").alias("key"), (F.col("page_id") * 2).alias("v"), (-F.col("page_id")).alias("idx"))
    return locate.join_by_longest_suffix(pages(spark, sf), entries, "v", idx_col="page_id", path_col="url", out="box").select("page_id", F.col("box").cast("double").alias("box"))


@query(f"SELECT page_id, row_number() OVER (ORDER BY list_filter(string_split(url, '/'), lambda x: x <> ''), page_id)::INTEGER - 1 AS place FROM pages")
def path_order(spark, sf):
    keyed = pages(spark, sf).select("page_id", F.struct(paths.components(F.col("url")).alias("p"), "page_id").alias("key"))
    return grouping.dense_ids(keyed.select("key"), "key", "place").select("key.page_id", "place")


@query("SELECT page_id, lower(regexp_extract(split_part(url, '/', -1), '.(\\.[^.]+)$', 1)) AS suffix FROM pages")
def path_suffix(spark, sf):
    return pages(spark, sf).select("page_id", paths.suffix(F.col("url")).alias("suffix"))


@query("SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1f]', '-', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 80), ''), 'frame') AS name FROM pages")
def safe_names(spark, sf):
    return pages(spark, sf).select("page_id", paths.safe_part(F.col("url")).alias("name"))


# --- two runs ----------------------------------------------------------------------------


def two_runs(spark, sf) -> DataFrame:
    """The first run rates documents by length, and lacks each third; the second rates the labelled ones by their labels."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    name = lambda c: F.concat(F.lit("DSC_"), (c % 50).cast("string"), F.lit(".NEF"))
    shape = lambda df, key, stars, why: df.select(F.col(key).alias("idx"), F.concat(F.lit("/lib/"), F.col(key).cast("string")).alias("path"), name(F.col(key)).alias("filename"), stars.cast("int").alias("rating"), F.array(F.lit(why)).alias("reasons"))
    first = shape(docs.where(F.col("doc_id") % 3 != 0), "doc_id", F.when(F.col("n_chars") < 300, F.lit(None)).otherwise(F.col("n_chars") % 6), "length")
    second = shape(labels, "doc_id", F.col("quality") * 4 - F.col("toxic"), "label")
    return compare.matched(first, second)


_RUNS = """WITH x AS (SELECT '/lib/' || doc_id AS key, 'DSC_' || doc_id % 50 || '.NEF' AS filename, CASE WHEN n_chars >= 300 THEN n_chars % 6 END AS rating FROM documents WHERE doc_id % 3 <> 0),
y AS (SELECT '/lib/' || doc_id AS key, 'DSC_' || doc_id % 50 || '.NEF' AS filename, quality * 4 - toxic AS rating, doc_id AS idx FROM labels),
bx AS (SELECT *, CASE WHEN rating IS NULL THEN 'unrated' WHEN rating >= 4 THEN 'keeper' WHEN rating <= 2 THEN 'reject' ELSE 'middle' END AS b FROM x),
by_ AS (SELECT *, CASE WHEN rating IS NULL THEN 'unrated' WHEN rating >= 4 THEN 'keeper' WHEN rating <= 2 THEN 'reject' ELSE 'middle' END AS b FROM y),
ch AS (SELECT key AS path, by_.filename, bx.rating::DOUBLE AS "from", by_.rating::DOUBLE AS "to", (coalesce(by_.rating, 0) - coalesce(bx.rating, 0))::INTEGER AS delta, bx.b || ' -> ' || by_.b AS transition, idx
  FROM bx JOIN by_ USING (key) WHERE bx.rating IS DISTINCT FROM by_.rating)"""


def _as_doubles(moved: DataFrame) -> DataFrame:
    """Ratings can be missing; as doubles they compare alike everywhere."""
    return moved.withColumns({c: F.col(c).cast("double") for c in ("from", "to")})


@query(f'{_RUNS} SELECT path, filename, "from", "to", delta, transition FROM ch')
def compare_inner(spark, sf):
    return _as_doubles(compare.changes(two_runs(spark, sf)).drop("because", "idx"))


@query(f"{_RUNS} SELECT key FROM x WHERE key NOT IN (SELECT key FROM y)")
def compare_only_before(spark, sf):
    return compare.only_in(two_runs(spark, sf), "before")


@query(f"{_RUNS} SELECT key FROM y WHERE key NOT IN (SELECT key FROM x)")
def compare_only_after(spark, sf):
    return compare.only_in(two_runs(spark, sf), "after")


@query(f"{_RUNS} SELECT k AS bucket, (SELECT count(*) FROM bx WHERE b = k) AS n_before, (SELECT count(*) FROM by_ WHERE b = k) AS n_after FROM (VALUES ('keeper'), ('middle'), ('reject'), ('unrated')) t(k)")
def compare_buckets(spark, sf):
    return compare.bucket_counts(two_runs(spark, sf))


@query(f"{_RUNS} SELECT transition, count(*) AS n FROM ch GROUP BY transition")
def compare_movement(spark, sf):
    return compare.movement(two_runs(spark, sf))


@query(f'{_RUNS} SELECT path, filename, "from", "to", delta FROM ch ORDER BY abs(delta) DESC, filename, idx LIMIT 20')
def compare_top_movers(spark, sf):
    return _as_doubles(compare.top_movers(two_runs(spark, sf), 20).select("path", "filename", "from", "to", "delta"))


@query(f"""{_RUNS} SELECT path, CASE WHEN count(*) OVER (PARTITION BY filename) > 1 THEN array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[-2:], '/') ELSE filename END AS name FROM ch""")
def compare_shown_names(spark, sf):
    return compare.shown_names(compare.changes(two_runs(spark, sf))).select("path", "name")


@query("SELECT doc_id, CASE WHEN r IS NULL THEN 'unrated' WHEN r >= 4 THEN 'keeper' WHEN r <= 2 THEN 'reject' ELSE 'middle' END AS bucket FROM (SELECT doc_id, CASE WHEN n_chars >= 300 THEN n_chars % 6 END AS r FROM documents)")
def rating_buckets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rating.bucket(F.when(F.col("n_chars") >= 300, F.col("n_chars") % 6)).alias("bucket"))


# --- names and texts -----------------------------------------------------------------------


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def xml_escaped(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.xml_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(url, '(.)\\.[^.]*$', '\\1'), '[^0-9A-Za-z_.-]', '-', 'g'), 1, 60), ''), 'frame') AS slug FROM pages")
def path_slug(spark, sf):
    return pages(spark, sf).select("page_id", paths.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, lpad((row_number() OVER (ORDER BY page_id) - 1)::VARCHAR, 5, '0') || '-' || coalesce(nullif(substr(regexp_replace(regexp_replace(url, '(.)\\.[^.]*$', '\\1'), '[^0-9A-Za-z_.-]', '-', 'g'), 1, 60), ''), 'frame') || '.png' AS name FROM pages")
def indexed_names(spark, sf):
    return names.indexed(pages(spark, sf), ".png", name_col="url", idx_col="page_id").select("page_id", "name")


@query(f"SELECT page_id, d::INTEGER AS depth, array_to_string(p[-d:], '/') AS key FROM (SELECT page_id, p, unnest(range(1, least(len(p), 8) + 1)) AS d FROM (SELECT page_id, {_PARTS} AS p FROM pages))")
def trailing_keys(spark, sf):
    return pages(spark, sf).select("page_id", F.explode(paths.trailing_keys(F.col("url"))).alias("t")).select("page_id", "t.depth", "t.key")


@query(f"""WITH {_H}
SELECT x.vec_id AS vec_id, (bit_count(xor(x.h, y.h)) + bit_count(xor(y.h, x.h)))::INTEGER AS distance FROM h x JOIN h y ON y.vec_id = x.vec_id + 1""")
def wide_distance(spark, sf):
    """Fingerprints of two words each."""
    h = hashed(spark, sf)
    other = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fingerprint").alias("g"))
    pair = lambda a, b: F.array(F.col(a), F.col(b))
    return h.join(other, "vec_id").select("vec_id", tiles.distance_of_arrays(pair("fingerprint", "g"), pair("g", "fingerprint")).alias("distance"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'high' ELSE 'medium' END AS confidence,
round((CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0.15 - 0.1 * 0.35 WHEN event_id % 4 = 2 THEN 0.1 ELSE 0.5 END)::DOUBLE, 6) AS x FROM events""")
def face_box(spark, sf):
    """No face, one with eyes, one without, and two of which the larger counts."""
    k = F.col("event_id") % 4
    eye = lambda x, there: F.when(there, F.struct(F.lit(x).alias("x"), F.lit(0.15).alias("y")))
    face = lambda x, w, there: F.struct(F.lit(x).alias("x"), F.lit(0.1).alias("y"), F.lit(w).alias("w"), F.lit(0.2).alias("h"), F.lit(0.95).alias("score"), eye(0.15, there).alias("left_eye"), eye(0.25, there).alias("right_eye"))
    faces = F.filter(F.array(F.when(k > 0, face(0.1, 0.2, k == 1)), F.when(k == 3, face(0.5, 0.3, F.lit(False)))), lambda f: f.isNotNull())
    return table(spark, sf, "events").select("event_id", locate.largest_face(faces).alias("b")).select("event_id", "b.confidence", F.round("b.box.x", 6).alias("x"))
