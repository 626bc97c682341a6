"""Per-key results when a few keys hold most records: multi-level tree aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class Measure:
    """A mergeable aggregate: how rows make a state, how states merge."""

    name: str
    init: Column
    merge: str = "sum"


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


#: Rows of a chunk that is combined locally, and states of one key that meet in a merge, at most.
CHUNK_ROWS, FAN_IN = 2_048, 8


def _chunk(partitions: int, rows: int) -> Column:
    """Number of a row's chunk: runs of ``rows`` rows of its partition; the first chunks of all partitions, then the second ones.

    The row's place in its partition is the lower part of the id Spark counts up, so nothing is
    shuffled or counted to number the chunks.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.floor(place / F.lit(rows)).cast("bigint") * F.lit(partitions) + F.spark_partition_id()


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    measures: list[Measure],
    fan_in: int = FAN_IN,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per-key results of mergeable measures, merged through rounds of fan-in ``fan_in``.

    The input is cut into chunks of ``chunk_rows`` rows; each chunk is combined locally, and the states
    of ``fan_in`` chunks merge in each round until one is left, so that no reducer ever gets more than
    ``fan_in`` states of one key, and there are as many rounds as the logarithm of the number of chunks.
    That number is looked up first by a scan that reads no column; only it reaches the driver. Keys may
    be null (null is a key). States: ``sum``, ``min`` or ``max`` of ``init``; nulls in ``init`` do not
    count. Columns of the input may have any name, also those of measures. An empty table gives an
    empty result.
    """
    if fan_in < 2 or chunk_rows < 1:
        raise ValueError("fan_in must be at least 2 and chunk_rows at least 1")
    node = "__node"
    partitions = max(1, df._jdf.queryExecution().toRdd().getNumPartitions())
    chunk = _chunk(partitions, chunk_rows)
    width = (df.select(chunk.alias(node)).agg(F.max(node)).first()[0] or 0) + 1
    level = df.select(*keys, *[m.init.alias(m.name) for m in measures], chunk.alias(node))
    while True:
        # the map side of the first round combines a chunk's rows, that of later rounds what states it has
        width = -(-width // fan_in)
        by = keys
        if width > 1:
            level = level.withColumn(node, F.floor(F.col(node) / fan_in).cast("bigint"))
            by = [*keys, node]
        level = level.groupBy(*by).agg(*[_MERGE[m.merge](m.name).alias(m.name) for m in measures])
        if width <= 1:
            return level


def distinct_counts(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact number of distinct non-null values per key, without sending a key to one task.

    Pairs of key and value are made distinct first, hashed on both; the counts then go up the tree.
    """
    # written once: the tree looks up its number of chunks before it reads them
    pairs = materialize(df.where(F.col(value).isNotNull()).select(*keys, value).distinct())
    return tree_aggregate(pairs, keys, [Measure(name, F.lit(1).cast("bigint"))])


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of the rows where ``key`` is not null: ``key_value``, ``n_rows``.

    No rows where the table is empty or all keys are null.
    """
    keyed = df.select(F.col(key).cast("string").alias("key_value")).where(F.col("key_value").isNotNull())
    counts = tree_aggregate(keyed, ["key_value"], [Measure("n_rows", F.lit(1).cast("bigint"))])
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.where(F.col("n_rows") >= F.lit(share) * total)
