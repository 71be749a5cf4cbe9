"""Sessions, and how this package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Where written tables are.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Whether shuffle files go as soon as their job has ended; what is written needs them no longer.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Arrow batches end at so many bytes instead of Spark's 64 MB: a worker's memory then depends on the longest row and not on thousands of rows.
BATCH_KEY, BATCH_BYTES, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 64 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once for an application, so that no executor needs a copy of the repository.

    Also bounds the session's Arrow batches, if their size is still Spark's own.
    """
    if spark.conf.get(BATCH_KEY, str(SPARKS_OWN)).rstrip("b") == str(SPARKS_OWN):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="evidentia-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(PACKAGE.rglob("*.py")):
                out.write(p, p.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which all executors see; only a session on one machine gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    named = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return df.checkpoint()


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str, figures: dict[str, Column] | None = None) -> DataFrame | tuple[DataFrame, dict[str, int]]:
    """df, written as Parquet in the shared folder and read back; the folder goes when the application ends.

    With figures, aggregates over df by name, also their values, which the writing job observes on its way.
    """
    seen = Observation()
    back = _written(df.observe(seen, *[c.alias(n) for n, c in figures.items()]) if figures else df, name)
    return (back, {n: seen.get[n] or 0 for n in figures}) if figures else back


def dealt(df: DataFrame, name: str, by: str) -> DataFrame:
    """df as saved() has it, with a folder for each value of by, so that a filter on it reads no other rows."""
    return _written(df, name, by)


def _written(df: DataFrame, name: str, *by: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_KEY, "false")
    spark.conf.set(CLEAN_KEY, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEAN_KEY, before)
    where, files = hadoop(spark, path)
    files.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete what saved() or dealt() wrote for df before the application ends. Nothing that is still to run may read it."""
    if path := _places.pop(df, None):
        where, files = hadoop(df.sparkSession, path)
        files.delete(where, True)


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
