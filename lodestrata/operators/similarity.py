"""Backward and forward word-vector similarity with field adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import bidf
from .barrier import not_sent

NEAR_ZERO = 1e-12


def word_vectors(docs: DataFrame) -> DataFrame:
    """``app``, ``q``, ``word``, ``x``: tf times ln(N/(1+df)), unit length, from strictly earlier quarters.

    ``docs`` has ``app``, ``q`` (quarter ordinal), ``tokens``. Zero weights are left out, so the first
    quarter has no vector at all.
    """
    size = F.size("tokens")
    tf = docs.where(size > 0).select("app", "q", (F.lit(1.0) / size).alias("one"), F.explode("tokens").alias("word")).groupBy("app", "q", "word").agg(F.sum("one").alias("tf"))
    earlier = W.partitionBy("word").orderBy("q").rowsBetween(W.unboundedPreceding, -1)
    df = tf.groupBy("word", "q").agg(F.count(F.lit(1)).alias("n")).select("word", "q", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("df"))
    per_q = docs.where(size > 0).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    n_docs = per_q.select("q", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("N"))
    w = tf.join(not_sent(df), ["word", "q"]).join(n_docs, "q").select("app", "q", "word", (F.col("tf") * bidf(F.col("N"), F.col("df"))).alias("w")).where("w is not null and w <> 0")
    return w.select("app", "q", "word", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("app")))).alias("x"))


def check_vectors(vectors: DataFrame, docs: DataFrame) -> None:
    """Raise ``ValueError`` unless every vector is that of a document with tokens, in its quarter, with each word once."""
    words = vectors.select("app", "q", "word")
    strangers = words.select("app", "q").distinct().join(docs.select("app", "q"), ["app", "q"], "left_anti").limit(1).count()
    repeated = words.groupBy("app", "word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if strangers or repeated:
        raise ValueError("vectors and documents do not fit together")


def scores(docs: DataFrame, granted: DataFrame, window: int = 8) -> DataFrame:
    """BS, FS and ``window_complete`` per document.

    BS: dot products with all documents of the same field in the ``window`` quarters before, less those
    of the same applicant; FS: with all documents of the ``window`` quarters after, less the same
    applicant. Vectors are summed per key first, so the work follows the number of words, not of
    pairs. Both are divided by the granted documents in the window. Documents without a vector score
    0; an empty field has no BS; empty keys match nothing. ``granted`` has ``q``, ``n``.
    """
    from ..session import materialize

    vectors = materialize(word_vectors(docs))
    meta = docs.select("app", "q", F.nullif(F.col("field"), F.lit("")).alias("field"), F.nullif(F.col("applicant"), F.lit("")).alias("applicant"))
    v = materialize(vectors.join(not_sent(meta.select("app", "field", "applicant")), "app"))

    def framed(keys: list[str], low: int, high: int, name: str) -> DataFrame:
        rows = v
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        daily = rows.groupBy(*keys, "word", "q").agg(F.sum("x").alias("s"))
        w = W.partitionBy(*keys, "word").orderBy("q").rangeBetween(low, high)
        return not_sent(daily.select(*keys, "word", "q", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias(name)))

    joined = (
        v.join(framed(["field"], -window, -1, "s1"), ["field", "word", "q"], "left")
        .join(framed(["applicant", "field"], -window, -1, "s2"), ["applicant", "field", "word", "q"], "left")
        .join(framed([], 1, window, "s3"), ["word", "q"], "left")
        .join(framed(["applicant"], 1, window, "s4"), ["applicant", "word", "q"], "left")
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    sums = joined.groupBy("app").agg(F.sum(F.col("x") * (z("s1") - z("s2"))).alias("b"), F.sum(F.col("x") * (z("s3") - z("s4"))).alias("f"))
    span = docs.agg(F.min("q").alias("q0"), F.max("q").alias("q1"))
    calendar = span.select(F.explode(F.sequence("q0", "q1")).alias("q"), "q0", "q1")
    dense = calendar.join(granted, "q", "left").fillna(0, ["n"])
    w = W.partitionBy(F.lit(1)).orderBy("q")
    totals = dense.select(
        "q", F.sum("n").over(w.rangeBetween(-window, -1)).alias("nb"), F.sum("n").over(w.rangeBetween(1, window)).alias("nf"),
        ((F.col("q") - window >= F.col("q0")) & (F.col("q") + window <= F.col("q1"))).cast("int").alias("window_complete"),
    )
    flat = lambda c: F.when(F.abs(z(c)) < NEAR_ZERO, F.lit(0.0)).otherwise(z(c))
    return meta.join(not_sent(sums), "app", "left").join(totals, "q", "left").select(
        "app", "q", "field", "applicant",
        F.when(F.col("field").isNotNull() & (F.col("nb") > 0), flat("b") / F.col("nb")).alias("bs"), F.when(F.col("nf") > 0, flat("f") / F.col("nf")).alias("fs"), "window_complete",
    )


def field_adjusted(scored: DataFrame) -> DataFrame:
    """Adds ``field_adjustment`` = (n_q / n_qf) (sum BS_qf / sum BS_q) and ``quality`` = adjustment FS / BS.

    Null where a denominator is 0 or missing; documents without a field are a field of their own.
    """
    q, qf = W.partitionBy("q"), W.partitionBy("q", "field")
    n = F.count(F.lit(1))
    adjustment = F.try_divide(n.over(q).cast("double"), n.over(qf)) * F.try_divide(F.sum("bs").over(qf), F.sum("bs").over(q))
    return scored.withColumn("field_adjustment", adjustment).withColumn("quality", F.try_divide(F.col("field_adjustment") * F.col("fs"), F.col("bs")))


def quality_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, mean and median quality, mean BS and FS per group."""
    return rows.groupBy(*keys).agg(
        F.count_distinct("app").alias("patent_count"), F.avg("quality").alias("quality_mean"), F.median("quality").alias("quality_median"), F.avg("bs").alias("bs_mean"), F.avg("fs").alias("fs_mean")
    )
