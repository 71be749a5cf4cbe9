"""What the operators of this subpackage share: table reading, the shared folder, written cuts of a lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: space and the bytes 09 to 0D.
WS_CLASS = "[\\x20\\x09-\\x0D]"
#: A side of a join is broadcast only after a count has shown that it has at most so many (narrow) rows.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. The cluster names it in spark.checkpoint.dir; only a session on one machine gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="evidentia-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Paths of the tables written inside each open scratch() block, innermost last.
_scopes: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: the lineage ends there and a lost executor costs no recomputation.

    The folder goes when the application ends, or with the scratch() block around the call.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    where, files = hadoop(spark, path)
    files.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block go at its end. What is used afterwards must have been written by keep() before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where, files = hadoop(spark, path)
            files.delete(where, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """written(), for a table that outlives the scratch() block around the call."""
    held = _scopes.pop() if _scopes else None
    try:
        return written(df, name)
    finally:
        if held is not None:
            _scopes.append(held)


def whole_number_ids(docs: DataFrame) -> Column:
    """doc_id as bigint. Ids of another kind than whole numbers are an error, as a cast would make them null."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    return F.col("doc_id").cast("bigint").alias("doc_id")


@contextlib.contextmanager
def conf(spark: SparkSession, settings: dict[str, str]):
    """Session settings for the actions inside the block only."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where needed so that they clash with no column of df (names differ in more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
