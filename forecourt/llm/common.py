"""Words, stored copies and table reading shared by the corpus operators."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.sources.quotes import stored

SPACE = "\x20\t\n\x0b\x0c\r"

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# What str.split() also takes for white space.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def words(text: str | None) -> list[str]:
    """The runs of characters other than ASCII white space."""
    if not text:
        return []
    return WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def ascii_lower(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def lowered(column) -> F.Column:
    """The same as ``ascii_lower`` as a column expression."""
    return F.translate(column, _UPPER, _UPPER.lower())


#: Rows that Spark hands to Python at once. Texts are long; Spark's default suits short rows.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Let Python workers started from now on find this package, and give them texts in small batches."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


__all__ = ["SPACE", "WORD", "ascii_lower", "free_name", "lowered", "prepare", "stored", "table", "words"]
