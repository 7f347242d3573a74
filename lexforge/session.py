"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def get_spark(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root, at = os.path.dirname(os.path.abspath(__file__)), tempfile.mkdtemp(prefix="lexforge-code-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        shutil.copytree(root, f"{at}/src/lexforge", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/lexforge-{app}", "zip", f"{at}/src"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir if the session names one.

    Only where it is unset (tests, one machine) a temporary folder is made and kept in the setting.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back, so later jobs don't recompute it and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*steps: DataFrame) -> None:
    """Delete the files of steps that cut wrote and nothing will read again."""
    release([s._cut_at for s in steps if getattr(s, "_cut_at", None)])


def release(paths: list[str] | None = None) -> None:
    """Delete written steps (all of this process if paths is None)."""
    for spark, path in list(_written):
        if paths is None or path in paths:
            try:
                jvm = spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # the JVM may be gone at exit
                pass
            _written.remove((spark, path))


atexit.register(release)
