"""Hints to the optimizer: filters that stay where they are, broadcasts of a checked size, joins without a broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on columns that are costly to compute.

    The optimizer moves a filter below the projection that makes its columns and so computes them a
    second time, once per mention. A column that is not deterministic keeps the filter where it is.
    """
    return df.withColumn("__here", F.spark_partition_id()).where(condition & (F.col("__here") >= 0)).drop("__here")


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``use`` mentions a costly value several times: an array of one is made and mapped."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Rows up to which a table is broadcast once counted.
SMALL = 10_000


def broadcast_if_small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def not_sent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    The optimizer takes a side for as large as the compressed files it is made from, times the share of
    the columns read; words, variants or links exploded from them are a hundred times that in the
    driver's memory. So joins of sides that grow with the input are merged, whatever their files weigh.
    """
    return df.hint("merge")
