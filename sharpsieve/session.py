"""Sessions: a default one, the shared folder, and this package on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from sharpsieve.errors import ConfigError


def local_session(name: str = "sharpsieve") -> SparkSession:
    """The active session, or one for this machine."""
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    conf = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"}
    return SparkSession.builder.master("local[*]").appName(name).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_sharpsieve_sent", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sharpsieve-")) / "sharpsieve.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    context._sharpsieve_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where none is set and all tasks run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif not spark.sparkContext._jsc.sc().isLocal():
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            path = "file://" + tempfile.mkdtemp(prefix="sharpsieve-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")
