"""Reading, registering and storing quote tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.schema import QUOTE_SCHEMA


def read_quotes(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = QUOTE_SCHEMA,
    header: bool = True,
) -> DataFrame:
    """Read quotes from CSV. ``schema=None`` infers types at the price of a second scan."""
    reader = spark.read.option("header", header)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def profile_source(df: DataFrame) -> DataFrame:
    """Row count, distinct keys and column count, as one row.

    Distinct keys come from grouped counts, so no task holds a set of all keys.
    """
    key = df.columns[0]
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_rows"),
        F.count(key).alias("n_keys"),
    ).withColumn("n_columns", F.lit(len(df.columns)))


def source_partitions(df: DataFrame) -> DataFrame:
    """Rows, partitions that hold rows and rows of the fullest one, as one row. Counted in place, without a shuffle of rows."""
    per_part = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    return per_part.agg(
        F.coalesce(F.sum("n"), F.expr("0L")).alias("n_rows"),
        F.count("*").alias("n_partitions"),
        F.max("n").alias("fullest"),
    )


def preview(df: DataFrame, n: int = 5, key: str = "quote_id") -> DataFrame:
    """The first ``n`` rows by every column, led by ``key`` so the answer is the same each time."""
    rest = [c for c in df.columns if c != key]
    return df.orderBy(key, *rest).limit(n)


def register(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` visible to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Replace table ``name`` by the rows of ``df`` and return the stored table.

    With ``folder`` the rows go to a fresh path there; otherwise to the warehouse.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if folder is not None:
        writer = writer.option("path", _fresh(folder))
    writer.saveAsTable(name)
    return load_table(df.sparkSession, name)


def load_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else one in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of the driver's machine")
    return warehouse + "/forecourt-copies"


def _fresh(folder: str) -> str:
    return os.path.join(folder, f"forecourt-{uuid.uuid4().hex}")


# Paths of the copies that this process made, by application.
_COPIES: dict[str, list[str]] = {}


def remove_copies(spark: SparkSession, made_before: int = 0) -> None:
    """Delete the copies that ``store`` made in this session, but for the first ``made_before``.

    Frames that still read them fail afterwards.
    """
    made = _COPIES.get(spark.sparkContext.applicationId, [])
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    while len(made) > made_before:
        path = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(settings).delete(path, True)


@contextmanager
def scoped_copies(spark: SparkSession) -> Iterator[None]:
    """Copies made inside are removed at the end; results must be written or fetched before."""
    before = len(_COPIES.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        remove_copies(spark, before)


def store(df: DataFrame, folder: str | None = None, fmt: str = "parquet") -> str:
    """Write ``df`` under a fresh path of the shared folder and return the path."""
    path = _fresh(folder or shared_folder(df.sparkSession))
    _COPIES.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` read back from a parquet copy in the shared folder.

    Use it where several jobs read the same expensive rows: the copy outlives
    lost executors and cuts the lineage.
    """
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(store(df, folder))
