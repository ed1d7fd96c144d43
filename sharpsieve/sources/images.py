"""From files to measurements: headers by random access, pixels by Spark's image source, figures by one numpy pass.

Neither files nor their paths pass through the driver's Python: tasks list folders and
read headers (a few kB of each file); raw files' embedded JPEGs, and files with hidden
names, which Spark's sources skip, are copied to the shared folder; Spark's image source
reads that folder and the root, and each task that decodes a frame measures it, so pixels
are never shuffled. Whatever fails becomes a row with an error.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sharpsieve.config import RAW, Config
from sharpsieve.errors import SieveError, UnreadableImage
from sharpsieve.functions import pixels
from sharpsieve.operators.scratch import Scratch
from sharpsieve.sources.bytes import Source
from sharpsieve.sources.containers import exif_base, read_layout
from sharpsieve.sources.files import Store, allowed_suffixes, literal
from sharpsieve.sources.tiff import Tiff, capture_fields, merged

CAPTURE = "make string, model string, lens string, iso int, aperture double, shutter_seconds double, focal_length double, focal_length_35mm double, timestamp string, orientation int"
HEADERS = f"file_idx bigint, path string, filename string, loader string, pixels_at string, declared_width int, declared_height int, upright boolean, {CAPTURE}, error string"
MEASURED = (
    "key string, frame_width int, frame_height int, tile_rows int, tile_cols int, tiles array<float>, jxx double, jyy double, jxy double, "
    "highlight_clipped double, shadow_clipped double, dynamic_range double, mean_luma double, contrast double, "
    "salient struct<x:double,y:double,w:double,h:double>, fingerprint array<bigint>, thumbnail binary, error string"
)
LIGHT = ("highlight_clipped", "shadow_clipped", "dynamic_range", "mean_luma", "contrast")
#: Results of a task that are given back at once: so many, or of so many bytes.
GIVEN_ROWS, GIVEN_BYTES = 200, 4_000_000

UNDECODED = "the image would not decode"


def decode_sensor(data: bytes) -> bytes | None:
    """The picture of a raw file's sensor at half size, upright, as PNG; None where rawpy isn't installed or can't read it."""
    try:
        import rawpy
    except ImportError:
        return None
    try:
        with rawpy.imread(io.BytesIO(data)) as raw:
            return pixels.png(raw.postprocess(half_size=True, no_auto_bright=True, use_camera_wb=True))
    except Exception as error:  # rawpy has errors of its own
        raise UnreadableImage(f"raw decode failed ({error})") from error


def header(path: str, suffix: str, sensor: bool = False) -> tuple[dict, bytes | None]:
    """A file's capture fields (with declared size and loader), and a raw file's picture: its largest embedded JPEG, or with `sensor` what rawpy makes of it."""
    source = Source(path)
    try:
        if suffix in RAW:
            if sensor and (decoded := decode_sensor(source.at(0, source.size))) is not None:
                try:
                    fields = capture_fields(merged(read_layout(source).directories))
                except UnreadableImage:
                    fields = capture_fields({})
                height, width = (2 * x for x in struct.unpack(">II", decoded[16:24])[::-1])
                lies = fields["orientation"] in (5, 6, 7, 8)  # the picture is upright; sizes are declared as stored
                return fields | {"loader": "raw-decode", "upright": True, "declared_width": height if lies else width, "declared_height": width if lies else height}, decoded
            layout = read_layout(source)
            if layout.largest is None:
                raise UnreadableImage("no embedded preview found")
            preview = source.at(layout.largest.offset, layout.largest.length)
            fields = capture_fields(merged(layout.directories))
            own = _exif(Source(preview))
            fields["orientation"] = own.get("orientation") or fields["orientation"]
            width, height = layout.size or (None, None)
            return fields | {"loader": "raw-preview", "declared_width": width, "declared_height": height}, preview
        return _exif(source) | {"loader": "image"}, None
    finally:
        source.close()


def _exif(source: Source) -> dict:
    """Capture fields of a JPEG or TIFF; none of anything else."""
    base = exif_base(source, 0, source.size)
    base = 0 if base is None and source.at(0, 4) in (b"II*\0", b"MM\0*") else base
    try:
        return capture_fields(merged(list(Tiff(source, base)))) if base is not None else capture_fields({})
    except ValueError:
        return capture_fields({})


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _hidden(path: str, root: str) -> bool:
    """Whether Spark's sources skip a file below root."""
    return path.startswith(root) and any(x[:1] in ("_", ".") for x in path[len(root) :].strip("/").split("/"))


def read_headers(files: DataFrame, root: str, previews: str, sensor: bool = False) -> DataFrame:
    """A row for each file with what its header says and where its pixels are to be read; previews: a shared folder for raw files' pictures.

    A picture's name there tells its orientation, as the task that decodes it has no other row.
    """

    def one(path: str, filename: str, suffix: str, file_idx: int) -> dict:
        row = {"file_idx": file_idx, "path": path, "filename": filename, "pixels_at": path}
        try:
            fields, preview = header(path, suffix, sensor)
            row |= {k: v for k, v in fields.items() if k not in row}
            if preview is None and _hidden(path, root):
                source = Source(path)
                preview = source.at(0, source.size)
                source.close()
            if preview is not None:
                row["pixels_at"] = f"{previews}/{file_idx:012d}-{0 if row.get('upright') else row.get('orientation') or 0}.jpg"
                store, place = pafs.FileSystem.from_uri(row["pixels_at"])
                with store.open_output_stream(place) as out:
                    out.write(preview)
        except SieveError as error:
            row["error"] = f"{filename}: {error}"
        except Exception as error:  # a corrupt file is a row, not the end
            row["error"] = f"unexpected failure: {error!r}"
        return row

    schema = _schema(HEADERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(**r) for r in batch.to_pylist()], schema=schema)

    return files.mapInArrow(run, HEADERS)


def _orientation(key: str, previews: str) -> int | None:
    """Of a decoded file: told by the name of what was copied, else by its header."""
    if key.startswith(previews):
        return int(key.rsplit("-", 1)[1].split(".")[0]) or None
    source = Source(key)
    try:
        return _exif(source).get("orientation")
    finally:
        source.close()


def kernels(config: Config) -> list[tuple]:
    """Columns of MEASURED, and what gives them for a frame and its luma."""
    c = config

    def grid(rgb, y) -> tuple:
        tiles = pixels.tile_map(y, c.sharpness.grid_long_edge)
        return (*tiles.shape, tiles.ravel().tolist())

    def salient(rgb, y) -> tuple:
        box = pixels.saliency_box(y)
        return (dict(zip("xywh", box, strict=True)) if box else None,)

    return [
        (LIGHT, lambda rgb, y: [pixels.exposure(y, c.exposure.percentile)[k] for k in LIGHT]), (("tile_rows", "tile_cols", "tiles"), grid),
        (("jxx", "jyy", "jxy"), lambda rgb, y: pixels.structure_tensor(y)), (("salient",), salient),
        (("fingerprint",), lambda rgb, y: (pixels.difference_hash(y, c.grouping.hash_size) if c.grouping.enabled else None,)),
        (("thumbnail",), lambda rgb, y: (pixels.thumbnail(rgb, c.input.thumbnail_edge),)),
    ]


def measure(images: DataFrame, previews: str, config: Config, wanted: Sequence[str] | None = None) -> DataFrame:
    """images: key, image (of Spark's source; of no size if it couldn't be decoded). One row each, MEASURED.

    Figures of which nothing is wanted are left null: by default the salient box, where no detector of config asks for it.
    """
    use = [(names, f) for names, f in kernels(config) if (set(names) & set(wanted) if wanted is not None else names != ("salient",) or "saliency" in config.subject.detectors)]

    def one(row: dict) -> dict:
        rgb = pixels.orient(pixels.from_spark_image(row["height"], row["width"], row["channels"], row["data"]), _orientation(row["key"], previews))
        y = pixels.luma(rgb, config.input.working_edge)
        out = {"frame_width": row["width"], "frame_height": row["height"]}
        for names, f in use:
            out |= zip(names, f(rgb, y), strict=True)
        return out

    schema = _schema(MEASURED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # a frame at a time: memory is one frame's, its batch's (64 MB) and that of a few results
                row = batch.slice(i, 1).to_pylist()[0]
                out = {"key": row["key"]}
                if not row["data"] or not row["width"] or row["width"] <= 0:
                    out["error"] = UNDECODED
                else:
                    try:
                        out |= one(row)
                    except Exception as error:
                        out["error"] = f"unexpected failure: {error!r}"
                done.append(out)
                held += len(out.get("thumbnail") or b"") + 8 * len(out.get("tiles") or ())
                if len(done) >= GIVEN_ROWS or held >= GIVEN_BYTES:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done, held = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    flat = images.select("key", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInArrow(run, MEASURED)


def plain_path(column: str) -> Column:
    """A path without its scheme; what Spark read comes as an encoded URI."""
    decoded = F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))
    return F.when(F.startswith(F.col(column), F.lit("file:")), F.regexp_replace(decoded, r"^file:/+", "/")).otherwise(F.col(column))


def _any_case(suffix: str) -> str:
    """A pattern for file names with a suffix, small or capital letters."""
    return "*" + "".join(f"[{x.lower()}{x.upper()}]" if x.isalpha() else x for x in suffix)


def pixel_rows(spark: SparkSession, root: str, previews: str, config: Config) -> DataFrame:
    """key (a path without its scheme), image: what Spark's image source decodes below root, and the copied pictures."""
    source = lambda: spark.read.format("image").option("dropInvalid", False)
    plain = source()
    if Store(root).kind() == "folder":
        wanted = sorted(allowed_suffixes(config) - RAW)
        plain = plain.option("recursiveFileLookup", config.input.recursive).option("pathGlobFilter", "{" + ",".join(map(_any_case, wanted)) + "}") if wanted else None
    rows = source().load(literal(previews)).select("image")
    if plain is not None:
        rows = rows.union(plain.load(literal(root)).select("image"))
    return rows.select(plain_path("image.origin").alias("key"), "image")


def read_frames(files: DataFrame, root: str | Path, config: Config) -> DataFrame:
    """Headers and measurements of each file, written once: every later step reads the table and no file is decoded twice."""
    spark, root = files.sparkSession, str(root)
    scratch = Scratch(spark)
    previews = f"{scratch.root}/previews"
    store, place = pafs.FileSystem.from_uri(previews)
    store.create_dir(place, recursive=True)
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    headers = scratch.write(read_headers(files.repartition(tasks), root, previews, config.input.prefer_raw_decode), "headers")
    plain = place if previews.startswith("file:") else previews
    measured = scratch.write(measure(pixel_rows(spark, root, previews, config), plain, config), "measured")
    return joined(headers, measured)


def joined(headers: DataFrame, measured: DataFrame) -> DataFrame:
    """HEADERS with the measurements of their pixels; an error of either is the row's, with the file's name."""
    both = headers.withColumnRenamed("error", "_header_error").join(measured.withColumnRenamed("error", "_pixel_error"), plain_path("pixels_at") == F.col("key"), "left")
    pixel_error = F.when(F.col("key").isNull(), UNDECODED).otherwise(F.col("_pixel_error"))
    named = F.when(pixel_error.isNotNull(), F.concat_ws(": ", "filename", pixel_error))
    return both.withColumn("error", F.coalesce("_header_error", named)).drop("_header_error", "_pixel_error", "key")
