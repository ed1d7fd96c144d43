"""Finding files, and the small tables that come with them."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpsieve.config import PLAIN, RAW, Config
from sharpsieve.errors import ConfigError
from sharpsieve.functions import boxes, paths
from sharpsieve.operators.scratch import Scratch
from sharpsieve.schema import BOX

#: Folders that the driver opens at most to share a tree out among tasks.
UNITS = 64
#: What is asked of exiftool.
FOCUS_FIELDS = ("SourceFile", "AFAreaXPosition", "AFAreaYPosition", "AFAreaWidth", "AFAreaHeight", "AFAreaMode", "FocusPixel", "ExifImageWidth", "ExifImageHeight", "ImageWidth", "ImageHeight")
FOCUS_OPTIONS = ("-j", "-n", "-q", "-r")
FOCUS_TIMEOUT = 300
#: Why a detector has no boxes, as reports tell it.
REASONS = {
    "no sidecar": "no sidecar at {}",
    "empty sidecar": "sidecar {} contains no boxes",
    "no tool": "exiftool is not installed (needed to read autofocus maker-notes)",
    "tool failed": "exiftool did not complete: {}",
    "tool said nothing": "exiftool returned no metadata",
    "no coordinates": "no files in this tree record autofocus coordinates",
}


def allowed_suffixes(config: Config) -> frozenset[str]:
    return frozenset(config.input.include_suffixes) or RAW | PLAIN


class Store:
    """Folders and files below a root, in the local file system or a store that pyarrow opens by URI."""

    def __init__(self, root: str):
        self.root = root
        self.prefix, self.files, self.base = "", pafs.LocalFileSystem(), root
        if "://" in root:
            self.files, self.base = pafs.FileSystem.from_uri(root)
            self.prefix = root.split("://")[0] + "://"

    def kind(self) -> str:
        found = self.files.get_file_info(self.base).type
        return {pafs.FileType.File: "file", pafs.FileType.Directory: "folder"}.get(found, "")

    def entries(self, folder: str) -> tuple[list[str], list[str]]:
        """Folders and files right below a folder; links are followed."""
        found = self.files.get_file_info(pafs.FileSelector(folder))
        return [i.path for i in found if i.type == pafs.FileType.Directory], [i.path for i in found if i.type == pafs.FileType.File]


def _units(store: Store, recursive: bool) -> list[tuple[str, bool]]:
    """(folder, with all below it): together all of the tree, in as many parts as tasks can share. Folders are opened until there are UNITS; no file is kept."""
    todo, opened = [store.base], []
    while recursive and todo and len(todo) < UNITS:
        folder = todo.pop(0)
        opened.append(folder)
        todo += store.entries(folder)[0]
    return [(x, False) for x in opened] + [(x, recursive) for x in todo]


def list_files(spark: SparkSession, root: str | Path, config: Config) -> DataFrame:
    """path: candidate files below a root, listed by tasks; a file is itself, whatever its suffix. Hidden files count, which is why Spark's own listing isn't used."""
    root = str(root)
    store = Store(root)
    kind = store.kind()
    if not kind:
        raise ConfigError(f"not a file or folder: {root}")
    if kind == "file":
        return spark.createDataFrame([(root,)], "path string")
    keep, units = allowed_suffixes(config), _units(store, config.input.recursive)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Store(root)
        for batch in batches:
            todo = list(zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist(), strict=True))
            while todo:
                folder, deep = todo.pop()
                folders, files = own.entries(folder)
                todo += [(x, True) for x in folders if deep]
                chosen = [own.prefix + x for x in files if os.path.splitext(x)[1].lower() in keep]
                yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.string())], names=["path"])

    tasks = max(1, min(len(units), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(units, "folder string, deep boolean").repartition(tasks).mapInArrow(walk, "path string")


def file_table(spark: SparkSession, root: str | Path, config: Config) -> DataFrame:
    """file_idx (in the order of paths, part by part; not without gaps), path, filename, suffix: a table in the shared folder."""
    scratch = Scratch(spark)
    listed = scratch.write(list_files(spark, root, config), "listed")
    name = F.element_at(F.split("path", "/"), -1)
    files = listed.orderBy(F.split("path", "/")).select(F.monotonically_increasing_id().alias("file_idx"), "path", name.alias("filename"), paths.suffix(F.col("path")).alias("suffix"))
    return scratch.write(files, "files")


def manual_boxes(spark: SparkSession, sidecar: str | Path) -> tuple[DataFrame | None, str | None]:
    """idx, key, box of a sidecar of hand-drawn boxes (a JSON object of x, y, w, h by path end), or why there is none. A malformed one is an error."""
    place = Path(sidecar)
    if not place.exists():
        return None, REASONS["no sidecar"].format(place)
    entries = parse_manual_boxes(spark.read.text(_file_uri(place), wholetext=True))
    wrong = entries.where("box is null").select("key").head()
    if wrong is not None:
        told = "the file isn't an object of boxes" if wrong.key is None else f"entry '{wrong.key}' needs numbers x, y, w and h, and an extent"
        raise ConfigError(f"{place}: {told}")
    return (None, REASONS["empty sidecar"].format(place)) if entries.isEmpty() else (entries, None)


def parse_manual_boxes(documents: DataFrame, column: str = "value") -> DataFrame:
    """idx, key, box of sidecars given as rows of JSON text; box is null for what isn't one, key too if a text isn't a JSON object."""
    parts = F.from_json(column, "map<string,string>")
    opened = documents.select(parts.alias("parts")).select(F.posexplode_outer("parts").alias("idx", "key", "said"), F.col("parts").isNull().alias("odd")).where("odd or key is not null")
    numbers = F.from_json("said", "struct<x:string,y:string,w:string,h:string>")
    sides = {k: numbers[k].try_cast("double") for k in "xywh"}
    sound = sides["w"].isNotNull() & (sides["w"] > 0) & (sides["h"] > 0) & sides["x"].isNotNull() & sides["y"].isNotNull()
    return opened.select("idx", "key", F.when(sound, F.struct(*(sides[k].alias(k) for k in "xywh"))).cast(BOX).alias("box"))


def _file_uri(path: Path) -> str:
    return literal(path.resolve().as_uri() if path.is_absolute() else str(path.resolve()))


def literal(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def focus_records(spark: SparkSession, root: str | Path) -> tuple[DataFrame | None, str | None]:
    """The cameras' focus records of a whole tree (focus_table), by one call of exiftool, or why there are none."""
    tool = shutil.which("exiftool")
    if tool is None:
        return None, REASONS["no tool"]
    said, why = b"", None
    try:
        said = subprocess.run([tool, *FOCUS_OPTIONS, *(f"-{x}" for x in FOCUS_FIELDS), str(root)], capture_output=True, timeout=FOCUS_TIMEOUT, check=False).stdout
    except (OSError, subprocess.TimeoutExpired) as error:
        why = REASONS["tool failed"].format(error)
    if why is None and not said.strip():
        why = REASONS["tool said nothing"]
    if why is not None:
        return None, why
    table = focus_table(spark.createDataFrame([(said.decode("utf-8", "replace"),)], "value string"))
    placed = table.where(boxes.from_focus_record({k: F.col(k) for k in FOCUS_FIELDS}).isNotNull())
    return (table, None) if not placed.isEmpty() else (None, REASONS["no coordinates"])


def focus_table(documents: DataFrame, column: str = "value") -> DataFrame:
    """idx and FOCUS_FIELDS as texts, of documents that are JSON arrays of records."""
    kind = "array<struct<" + ",".join(f"{k}:string" for k in FOCUS_FIELDS) + ">>"
    return documents.select(F.posexplode(F.from_json(column, kind)).alias("idx", "r")).select("idx", "r.*")


PHOTOS = "photos array<struct<path:string,filename:string,rating:int,label:string,reasons:array<string>>>"


def load_run(spark: SparkSession, path: str | Path) -> DataFrame:
    """idx, path, filename, rating, reasons of a saved report."""
    df = spark.read.schema(f"{PHOTOS}, config_source string").option("multiLine", True).json(str(path))
    first = df.select(F.col("photos").isNotNull().alias("ok")).head()
    if first is None or not first.ok:
        raise ConfigError(f"{path} isn't a saved report: it has no 'photos'")
    return df.select(F.posexplode("photos").alias("idx", "p")).select("idx", "p.path", "p.filename", "p.rating", F.coalesce("p.reasons", F.expr("cast(array() as array<string>)")).alias("reasons"))
