"""A Spark session with the settings that the engine expects, and the folder that its executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "netquarry", **conf: str) -> SparkSession:
    """The running session, or a new one; `conf` has dots written as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session uses a temporary one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a pattern, or of one path, on any file system that Spark knows; nothing if there are none."""
    files, place = _place(spark, pattern)
    return sorted(str(f.getPath()) for f in files.globStatus(place) or [])


def is_folder(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark knows."""
    files, place = _place(spark, path)
    out = files.create(place, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if it isn't there."""
    files, place = _place(spark, path)
    return spark.read.option("wholetext", True).text(path).first()["value"] if files.exists(place) else None


def lease(spark: SparkSession, path: str, take_over: bool = False) -> str:
    """Take the lease at a path, which one job holds at a time; RuntimeError if another one has it. take_over: set aside what a job that died has left."""
    files, place = _place(spark, path)
    if take_over:
        files.delete(place, False)
    if not files.createNewFile(place):
        raise RuntimeError(f"another job holds {path}")
    return path


def released(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, False)
