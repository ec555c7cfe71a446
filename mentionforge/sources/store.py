"""Small files that decide what counts, created once, and tables that cut lineage, in folders all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes ``text`` to a new file; false if there is one already, whoever wrote it."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception as e:  # another writer came first
        if "AlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_small(spark: SparkSession, path: str, limit: int = 1 << 16) -> str | None:
    """The text of a file of at most ``limit`` bytes; None without one."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    size = fs.getFileStatus(p).getLen()
    if size > limit:
        raise ValueError(f"{path} has {size} bytes")
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's entries, in order; none without the folder."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """The files without a byte at ``path`` (a file, a folder or a pattern), which Spark's readers pass over."""
    fs, p = _at(spark, path)
    found = list(fs.globStatus(p) or [])
    inside = [x for d in found if d.isDirectory() for x in fs.listStatus(d.getPath())]
    plain = [x for x in found + inside if not x.isDirectory() and x.getPath().getName()[0] not in "_."]
    return [x.getPath().toString() for x in plain if x.getLen() == 0]


def unique() -> str:
    """A name that nothing else has."""
    return uuid.uuid4().hex


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in the cluster's ``spark.checkpoint.dir``, or a local one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{unique()}"


def write_out(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back, for tables that are used several times: plans stay short, and nothing
    is lost with an executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
