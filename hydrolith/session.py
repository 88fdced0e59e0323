"""Session set-up: settings for batch and streaming jobs, and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def build_session(app: str = "hydrolith", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as spark_sql_shuffle_partitions="64"."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once an application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="hydrolith-code-")) / "hydrolith.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, f"{ROOT.name}/{path.relative_to(ROOT)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share, below spark.checkpoint.dir; where that is unset, a local master gets one of its own (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="hydrolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/hydrolith/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path
