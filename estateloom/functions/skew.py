"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
_SALT = "__salt"


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[Column | str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``big`` to the much smaller ``small`` on ``keys``, each key of ``big`` spread over ``salts`` partitions.

    ``spread`` are columns of ``big`` that vary within one key. ``small`` is repeated ``salts`` times, a fixed factor, so
    nothing is collected or broadcast, and rows of ``big`` with null keys are spread as well (a left join keeps them).
    """
    salted = big.withColumn(_SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, _SALT], how).drop(_SALT)


def spread(df: DataFrame, key: str, waves: int = 3) -> DataFrame:
    """``df`` over at least ``waves`` partitions per core, for work that costs much more than reading its rows.

    Inputs that already come in that many splits, as large ones do, are not shuffled. ``key`` must be near unique.
    """
    n = df.sparkSession.sparkContext.defaultParallelism * waves
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


#: most bytes, as stored, of a written table that is sent to every executor
BROADCAST_BYTES = 8 * 1024 * 1024


def fitted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[Column | str], how: str = "left") -> DataFrame:
    """Join ``big`` to a written table: broadcast if the table's stored size is at most ``BROADCAST_BYTES``, else salted."""
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return big.join(F.broadcast(small), keys, how) if size <= BROADCAST_BYTES else salted_join(big, small, keys, spread, how)
