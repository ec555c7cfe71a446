"""Raw sources, each read on its own: optional ones may fail, required ones may not."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .store import write_out

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_type", "entity_name", "alias", "confirmation_id", "desc")])
#: Fields that a raw row can't do without.
NEEDED = ("entity_type", "entity_name")


@dataclass(frozen=True)
class Source:
    """A source of raw rows: JSON lines, or parquet (layout) at ``path``."""

    name: str
    path: str
    required: bool = True
    layout: str = "lines"


class Intake(NamedTuple):
    rows: DataFrame  #: sound rows of all sources: source, then RAW
    quarantine: DataFrame  #: source, file, record (as JSON text), problem: rows that don't count
    report: DataFrame  #: a row a source: source, required, status (ok, degraded, failed), n_rows, n_bad, error


def _said(e: Exception) -> str:
    """The line of an error that tells its first cause."""
    lines = str(e).split("\n")
    causes = [x.removeprefix("Caused by: ") for x in lines if x.startswith("Caused by: ")]
    return (causes or lines)[-1 if causes else 0]


def _missing(at: str = "") -> Column:
    absent = F.concat_ws(", ", *[F.when(F.coalesce(F.trim(f"{at}{f}"), F.lit("")) == "", f) for f in NEEDED])
    return F.when(absent != "", F.concat(F.lit("missing: "), absent))


def _judged(spark: SparkSession, source: Source) -> DataFrame:
    """Every row of a source: file, record, problem (null: sound), raw."""
    file = F.col("_metadata.file_path").alias("file")
    if source.layout == "parquet":
        found = spark.read.parquet(source.path)
        said = {f.name: f.dataType for f in found.schema.fields}
        wrong = [f.name for f in RAW.fields if not isinstance(said.get(f.name, T.StringType()), T.StringType)] + [f for f in NEEDED if f not in said]
        if wrong:
            raise ValueError(f"missing columns, or columns that aren't text: {', '.join(sorted(wrong))}")
        raw = F.struct(*[(F.col(f"`{f.name}`") if f.name in said else F.lit(None).cast("string")).alias(f.name) for f in RAW.fields])
        rows = found.select(file, raw.alias("raw"))
        return rows.select("file", F.to_json("raw").alias("record"), _missing("raw.").alias("problem"), "raw")
    lines = spark.read.text(source.path).select(file, F.col("value").alias("record")).where(F.trim("record") != "")
    parsed = lines.select("*", F.try_parse_json("record").alias("item"))
    problem = F.when(F.col("item").isNull(), "not JSON").otherwise(files.item_problem("item", RAW))
    rows = parsed.select("file", "record", problem.alias("problem"), F.from_json("record", RAW).alias("raw"))
    return rows.select("file", "record", F.coalesce("problem", _missing("raw.")).alias("problem"), "raw")


def read_sources(spark: SparkSession, sources: list[Source]) -> Intake:
    """The sound rows of ``sources``, what was put aside, and how each source fared.

    Each source is read, judged and written out by jobs of its own, so that a file that can't be read fails
    that source alone. A required source that can't be read, or has one row that isn't sound, stops the intake with a
    ValueError before anything is returned. An optional source that can't be read gives no rows (failed); the bad rows of one
    that can be read go to quarantine, its sound rows count (degraded). Other columns are left out. A source without
    rows is ok. Names of sources are to be distinct.
    """
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("two sources have one name")
    shape = "source string, file string, record string, problem string, raw struct<" + ", ".join(f"`{f.name}`: string" for f in RAW.fields) + ">"
    every, report = spark.createDataFrame([], shape), []
    for s in sources:  # as many as are named
        try:
            judged = write_out(_judged(spark, s).select(F.lit(s.name).alias("source"), "*"), f"source-{s.name}")
            n_bad, n_rows = judged.agg(F.count("problem"), F.count("*") - F.count("problem")).first()
        except (PySparkException, Py4JJavaError, ValueError) as e:
            if s.required:
                raise ValueError(f"required source {s.name} can't be read: {e}") from e
            report.append((s.name, s.required, "failed", 0, 0, _said(e)))
            continue
        if n_bad and s.required:
            some = "; ".join(f"{r.file}: {r.problem}" for r in judged.where("problem is not null").limit(5).collect())  # a few to name in the error
            raise ValueError(f"required source {s.name} has {n_bad} bad rows: {some}")
        report.append((s.name, s.required, "degraded" if n_bad else "ok", n_rows, n_bad, None))
        every = every.unionByName(judged)
    return Intake(
        every.where("problem is null").select("source", "raw.*"), every.where("problem is not null").select("source", "file", "record", "problem"),
        spark.createDataFrame(report, "source string, required boolean, status string, n_rows long, n_bad long, error string"),
    )
