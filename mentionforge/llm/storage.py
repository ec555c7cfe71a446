"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set: a local folder in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.saved_at = path
    return saved


def discard(*tables: DataFrame) -> None:
    """Delete what ``save`` wrote for tables that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(conf).delete(path, True)


def as_row(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` in one, ``row``, so that no name of it can clash with what is added."""
    return docs.select(F.struct("*").alias("row"))


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The column ``text``, or the field of that name in ``row``."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, th, text. Rows with one doc_id and one text share a key and a result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame):
    """Join condition on (doc_id, th) that also pairs null ids."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
