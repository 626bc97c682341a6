"""Filling fixed-capacity containers with items: best fit planned over the histogram of lengths."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, read_bytes

#: Steps a capacity is divided into for planning; lengths are rounded up to a step. A capacity up to this is planned by the token.
STEPS = 200_000
#: Rows of a plan up to which it is broadcast.
SMALL_PLAN = 100_000
#: Rows of one length that are ranked in one task, about.
ROWS_PER_BUCKET = 200_000

_ENCODERS: dict[bytes, object] = {}


def _encoder(body: bytes):
    key = hashlib.sha256(body).digest()
    if key not in _ENCODERS:
        import tiktoken

        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, body.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def _vocabulary(spark: SparkSession, path: str) -> bytes:
    """The rank file, from the driver's disk or any file system Spark knows; a vocabulary is of fixed size."""
    local = Path(path)
    body = local.read_bytes() if "://" not in path and local.exists() else read_bytes(spark, path)
    if body is None:
        raise FileNotFoundError(path)
    return body


def token_lengths(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens`` under the rank file ``vocabulary``; null and empty texts have 0.

    The file is read once and sent to the workers, which need not have it.
    """
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(_vocabulary(spark, vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shipped.value)
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch["text"].tolist()]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": pd.Series(sizes, dtype="int64")})

    slim = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    return slim.mapInPandas(count, "doc_id bigint, n_tokens bigint")


def plan_best_fit(histogram: dict[int, int], capacity: int, first: int = 1) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts of equal lengths, longest first.

    Returns ``(length, from_rank, items, per_container, first_container)``: the items of that length
    with rank ``from_rank`` onwards (counted from 0) fill containers from ``first_container`` on,
    ``per_container`` each. Containers of equal free space are handled as one run, so the work and
    the plan grow with the number of lengths, not of items.
    """
    free: list[tuple[int, int, int]] = []  # (free space, first container, containers)
    plan = []
    bins = first
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length <= 0:
            continue
        while left:
            at = bisect_left(free, (length, -1, -1))
            if at < len(free):
                space, start, count = free.pop(at)
            else:
                space, start = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            each = space // length
            whole = min(count, left // each)
            if whole:
                plan.append((length, rank, whole * each, each, start))
                rank, left = rank + whole * each, left - whole * each
                if space - each * length:
                    insort(free, (space - each * length, start, whole))
            start, count = start + whole, count - whole
            if count and left and left < each:
                plan.append((length, rank, left, left, start))
                if space - left * length:
                    insort(free, (space - left * length, start, 1))
                rank, left, start, count = rank + left, 0, start + 1, count - 1
            if count:
                insort(free, (space, start, count))
    return plan


_PIECES = "array<struct<container_id:bigint,piece_no:int,start_token:bigint,n_tokens:bigint>>"
_PACKED = "limit_id int, capacity_tokens int, container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"


def pack(lengths: DataFrame, limits: DataFrame) -> DataFrame:
    """Assign every document to containers of each capacity.

    ``lengths`` has ``doc_id``, ``n_tokens`` (null counts as 0); ``limits`` has ``limit_id``,
    ``capacity_tokens`` (rows without a positive capacity are ignored). A document longer than the
    capacity is cut into full containers and a rest; no other is split. Result: ``limit_id``,
    ``capacity_tokens``, ``container_id`` (from 1 per limit), ``doc_id``, ``piece_no`` (from 1),
    ``start_token`` (from 0), ``n_tokens``. Documents without tokens take no space and stand in
    container 1. Documents repeated under one id are packed each. An empty table gives no rows.

    Only counts per length reach the driver, at most STEPS of one limit at a time: of a capacity above
    STEPS lengths are planned in steps of capacity / STEPS tokens, rounded up, which leaves at most that
    much unused per item. Documents take planned slots by their rank within their length: the slots of
    a length are one row, so the join gives one row per item. Ranks are computed in buckets, so that a
    length most documents share is spread over many tasks.
    """
    spark = lengths.sparkSession
    # token counts are costly to make: written once, then counted and read
    lengths = materialize(lengths.select("doc_id", "n_tokens"))
    rows_in = lengths.count()
    caps = {r[0]: r[1] for r in limits.select("limit_id", "capacity_tokens").collect() if r[1] and r[1] > 0}
    size = F.coalesce(F.col("n_tokens"), F.lit(0))
    if not caps:
        return spark.createDataFrame([], _PACKED)
    every = F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity"), F.lit(-(-c // STEPS)).alias("step")) for i, c in sorted(caps.items())])
    wide = lengths.select("doc_id", size.cast("bigint").alias("n"), F.explode(every).alias("l")).select("doc_id", "n", "l.*")
    # full containers of long documents need no planning: they are numbered after the planned ones
    full = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint")
    items = wide.withColumn("full", full).withColumn("rest", F.col("n") - F.col("full") * F.col("capacity")).withColumn("size", F.ceil(F.col("rest") / F.col("step")).cast("bigint")).drop("step")
    buckets = max(1, -(-rows_in // ROWS_PER_BUCKET)) * 4
    # repeated ids are told apart by a number within their bucket
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "n"), F.lit(buckets)).cast("int"))
    items = materialize(items)
    cells = materialize(items.groupBy("limit_id", "size", "bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f")))
    rows, lasts = [], []
    for limit, capacity in sorted(caps.items()):
        by_length = cells.where(F.col("limit_id") == limit).groupBy("size").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).orderBy("size").toArrow()
        sizes, counts, fulls = (by_length[c].to_pylist() for c in ("size", "c", "f"))
        slots: dict[int, list] = {n: [] for n in sizes}
        last = 0
        for length, rank, n, each, start in plan_best_fit({n: c for n, c in zip(sizes, counts) if n > 0}, capacity // -(-capacity // STEPS)):
            slots[length].append((rank, rank + n, each, start))
            last = max(last, start + -(-n // each) - 1)
        for n, before in zip(sizes, [0, *accumulate(fulls)]):
            rows.append((limit, n, last + before, slots[n]))
    plan = spark.createDataFrame(rows, "limit_id int, size bigint, full1 bigint, slots array<struct<lo:bigint,hi:bigint,each:bigint,start:bigint>>")
    plan = F.broadcast(plan) if len(rows) <= SMALL_PLAN else plan
    before = W.partitionBy("limit_id", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("limit_id", "size", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("full0"))
    within = W.partitionBy("limit_id", "size", "bucket").orderBy("doc_id", "n")
    ranked = (
        items.withColumn("r", F.row_number().over(within) - 1)
        .withColumn("f0", F.coalesce(F.sum("full").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(offsets, ["limit_id", "size", "bucket"])
        .join(plan, ["limit_id", "size"])
    )
    rank = F.col("r") + F.col("rank0")
    slot = F.get(F.filter("slots", lambda s: (s["lo"] <= rank) & (rank < s["hi"])), F.lit(0))
    one = ranked.select("limit_id", "capacity", "doc_id", "full", "rest", rank.alias("rank"), (F.col("f0") + F.col("full0") + F.col("full1")).alias("base"), slot.alias("s"))
    big = lambda v: F.lit(v).cast("bigint")
    piece = lambda at, no, start, n: F.struct(at.cast("bigint").alias("container_id"), no.cast("int").alias("piece_no"), start.cast("bigint").alias("start_token"), n.cast("bigint").alias("n_tokens"))
    cuts = F.transform(F.when(F.col("full") > 0, F.sequence(big(1), "full")).otherwise(F.array().cast("array<bigint>")), lambda i: piece(F.col("base") + i, i, (i - 1) * F.col("capacity"), F.col("capacity")))
    at = F.col("s.start") + F.floor((F.col("rank") - F.col("s.lo")) / F.col("s.each"))
    tail = F.when(F.col("rest") > 0, F.array(piece(at, F.col("full") + 1, F.col("full") * F.col("capacity"), F.col("rest"))))
    tail = tail.when(F.col("full") == 0, F.array(piece(big(1), big(1), big(0), big(0)))).otherwise(F.array().cast(_PIECES))
    return one.select("limit_id", F.col("capacity").alias("capacity_tokens"), "doc_id", F.explode(F.concat(cuts, tail)).alias("p")).select(
        "limit_id", "capacity_tokens", "p.container_id", "doc_id", "p.piece_no", "p.start_token", "p.n_tokens"
    )


def audit(packed: DataFrame, lengths: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per limit: what must hold of an assignment, as counts of what does not.

    ``missing`` documents, containers above the capacity (``overfull``), documents cut though they fit
    (``cut_short``), documents whose pieces do not follow each other to their length (``broken``), and
    whether containers are at most a hundredth, and one, above the least number (``tight``).
    """
    caps = limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens")
    docs = lengths.groupBy("doc_id").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n"), F.max(F.coalesce("n_tokens", F.lit(0))).alias("longest"), F.count(F.lit(1)).alias("copies"))
    pieces = packed.groupBy("limit_id", "capacity_tokens", "doc_id").agg(
        F.sum("n_tokens").alias("sum"), F.count(F.lit(1)).alias("k"), F.max("piece_no").alias("last"), F.count_if(F.col("start_token") != (F.col("piece_no") - 1) * F.col("capacity_tokens")).alias("off")
    )
    joined = pieces.join(docs, "doc_id")
    by_doc = joined.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("sum").alias("tokens"), F.count_if((F.col("longest") <= F.col("capacity_tokens")) & (F.col("k") > F.col("copies"))).alias("cut_short"),
        F.count_if((F.col("sum") != F.col("n")) | (F.col("off") > 0)).alias("broken"),
    )
    filled = packed.groupBy("limit_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    by_box = filled.groupBy("limit_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    total = docs.agg(F.count(F.lit(1)).alias("all"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return caps.join(by_doc, "limit_id").join(by_box.drop("capacity_tokens"), "limit_id").crossJoin(total).select(
        "limit_id", "capacity_tokens", "n_documents", (F.col("all") - F.col("n_documents")).alias("missing"), "overfull", "cut_short", "broken", (F.col("containers") <= least * 1.01 + 1).alias("tight")
    )
