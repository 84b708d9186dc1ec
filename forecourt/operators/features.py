"""Feature columns: logs, named feature sets, dummies, standardisation and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.functions.columns import key_bucket, log10_or_null
from forecourt.functions.frames import beside
from forecourt.operators.aggregates import make_model_key, skewness_table
from forecourt.schema import LABEL, NUMERIC_FEATURES, SKEWED_FEATURES

# Categorical columns of each feature set; all sets add the numeric features.
FEATURE_SETS = {
    "make": ("region_short_code", "make"),
    "segment": ("region_short_code",),
    "make_source": ("region_short_code", "seller_source", "make"),
    "make_zip_source": ("region_short_code", "location_zip", "seller_source", "make"),
    "make_model": ("region_short_code", "make", "make_model"),
    "make_model_source": ("region_short_code", "seller_source", "make", "make_model"),
    "make_model_zip_source": (
        "region_short_code",
        "location_zip",
        "seller_source",
        "make",
        "make_model",
    ),
}


def log10_features(df: DataFrame, cols: Sequence[str] = SKEWED_FEATURES) -> DataFrame:
    """Replace columns by their base-10 log; zero and below become null."""
    return df.withColumns({c: log10_or_null(F.col(c)) for c in cols})


def auto_log(
    df: DataFrame,
    cols: Sequence[str] = NUMERIC_FEATURES,
    threshold: float = 0.5,
    label: str = LABEL,
) -> DataFrame:
    """Log the columns whose skewness is above ``threshold`` in size, never the label.

    One aggregate row comes to the driver to choose the columns.
    """
    candidates = [c for c in cols if c != label]
    flagged = skewness_table(df, candidates, threshold).filter("is_skewed")
    chosen = {r.feature for r in flagged.collect()}
    return log10_features(df, [c for c in candidates if c in chosen])


def feature_set(
    df: DataFrame,
    name: str = "make",
    logs: bool = True,
    label: str = LABEL,
    key: str | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """The columns of a named feature set, with the known margin as ``label``.

    ``logs`` takes the base-10 log of the two skewed features. ``key`` keeps a
    key column for splitting and joining back, ``extra`` other columns.
    """
    if logs:
        df = log10_features(df)
    cats = [make_model_key().alias(c) if c == "make_model" else F.col(c) for c in FEATURE_SETS[name]]
    keys = [F.col(key)] if key else []
    return df.select(*keys, *cats, *NUMERIC_FEATURES, F.col(LABEL).alias(label), *extra)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, in order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def levels_by_count(df: DataFrame, col: str) -> list:
    """Levels of a column, most frequent first, ties in level order. Each becomes a column of its own."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return [r[col] for r in counts.orderBy(F.desc("n"), col).collect()]


def one_hot(
    df: DataFrame,
    col: str,
    base: str | None = None,
    prefix: str | None = None,
    levels: Sequence | None = None,
    keep: bool = False,
) -> DataFrame:
    """A 0/1 column per level, without the base level; the base defaults to the rarest.

    Levels are named ``prefix + level`` in level order. Pass ``levels`` to use
    those of another frame; a level outside them gets zeros.
    """
    ranked = list(levels) if levels is not None else levels_by_count(df, col)
    if base is None and ranked:
        base = ranked[-1]
    elif base is not None and base not in ranked:
        raise ValueError(f"base level {base!r} is not among the levels of {col}")
    prefix = f"{col}_" if prefix is None else prefix
    dummies = {
        f"{prefix}{v}": F.when(F.col(col) == v, 1).otherwise(0)
        for v in sorted(ranked)
        if v != base
    }
    out = df.withColumns(dummies) if dummies else df
    return out if keep else out.drop(col)


def scale_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per column, as one row."""
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
    )


def standardize(df: DataFrame, cols: Sequence[str], stats_from: DataFrame | None = None) -> DataFrame:
    """Centre and divide by the population deviation of ``stats_from`` (default: the rows themselves).

    A constant column becomes null.
    """
    stats = scale_stats(df if stats_from is None else stats_from, cols)

    def scaled(c: str) -> Column:
        if c not in cols:
            return F.col(f"`{c}`")
        centred = F.col(f"`{c}`").cast("double") - F.col(f"`{c}_mean`")
        return F.try_divide(centred, F.col(f"`{c}_std`")).alias(c)

    return beside(df, stats).select(*[scaled(c) for c in df.columns])


def split_name(key: str = "quote_id", train_pct: int = 70) -> Column:
    """``train`` or ``test`` by a hash of the key."""
    return F.when(key_bucket(F.col(key), 100) < train_pct, "train").otherwise("test")


def hash_split(df: DataFrame, key: str = "quote_id", train_pct: int = 70) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same rows whatever the partitioning."""
    is_train = key_bucket(F.col(key), 100) < train_pct
    return df.filter(is_train), df.filter(~is_train)


def random_split(df: DataFrame, train: float = 0.7, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Spark's own seeded split; it depends on how the rows are partitioned."""
    a, b = df.randomSplit([train, 1 - train], seed=seed)
    return a, b


def fold(key: str = "quote_id", k: int = 3, level: int = 1) -> Column:
    """Fold 0..k-1 of a row; ``level`` 2 gives inner folds unrelated to the outer ones."""
    return key_bucket(F.col(key), k, level)
