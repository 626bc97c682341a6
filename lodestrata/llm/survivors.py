"""Best representative of each duplicate group: one surviving value per application and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import full_date
from ..functions.values import half_width, is_no_value
from ..operators.barrier import computed_once, where_computed
from ..session import materialize

#: A precedence is learned from this many timestamped transitions, if the balance exceeds so many standard errors.
MIN_SUPPORT, MIN_SIGMA = 8, 2.5
#: Kinds of values over which precedence is learned; shapes are hashed to so many, which bounds what a group can hold.
KINDS = 256


def application_key(number: Column) -> Column:
    """Letters and digits of an application number, upper case, without a leading ``CN``; null where it has no value."""
    bare = F.regexp_replace(F.upper(half_width(number)), r"[^\p{L}\p{Nd}]", "")
    bare = F.regexp_replace(bare, "^CN", "")
    return F.when(~is_no_value(number) & (bare != ""), bare)


def application_number(key: Column) -> Column:
    """``CN``, digits, dot, last character."""
    return F.concat(F.lit("CN"), F.substring(key, F.lit(1), F.length(key) - 1), F.lit("."), F.right(key, F.lit(1)))


def value_kind(value: Column) -> Column:
    """The kind of a value, 0 to KINDS - 1: its notation, layout or completeness, read off the whole value.

    Runs of digits, letters and Han characters become one mark each and repeated groups of marks one
    group. A value of more than 16 such marks counts by its first and last mark and the magnitude of its
    length. Shapes are hashed to KINDS kinds; two shapes may share one, which only blurs what is learned.
    """
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[0-9]+", "9"), r"\p{IsHan}+", "H"), r"[A-Za-z]+", "A")
    shape = F.regexp_replace(F.regexp_replace(shape, r"\s+", " "), r"(.{1,8}?)\1+", "$1+")
    size = F.floor(F.log2(F.length(value) + 1)).cast("string")
    coarse = lambda s: F.concat(F.substring(s, 1, 1), size, F.right(s, F.lit(1)))
    named = computed_once(shape, lambda s: F.when(F.length(s) <= 16, s).otherwise(coarse(s)))
    return F.pmod(F.xxhash64(named), F.lit(KINDS)).cast("int")


def learn_precedence(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: kinds of which timestamped rows show that a value goes from the first to the second.

    ``nodes`` has ``app``, ``kind`` and ``first_at``, the first time of the kind under a trust level. In
    each group the kinds make a chain by their first time; a step counts for its direction. A direction
    is learned from at least MIN_SUPPORT steps if it outweighs the other by MIN_SIGMA standard errors.
    A chain has at most KINDS links, and the result at most KINDS * (KINDS - 1) / 2 rows.
    """
    first = nodes.where(F.col("first_at").isNotNull()).groupBy("app", "kind").agg(F.min("first_at").alias("at"))
    chains = first.groupBy("app").agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("chain")).where(F.size("chain") > 1)
    steps = chains.select(
        F.explode(F.transform(F.slice("chain", 2, F.size("chain") - 1), lambda x, i: F.struct(F.get(F.col("chain"), i).alias("a"), x.alias("b")))).alias("s")
    ).where("s.a.at < s.b.at")
    low, high = F.least("s.a.kind", "s.b.kind"), F.greatest("s.a.kind", "s.b.kind")
    up = F.count_if(F.col("s.a.kind") < F.col("s.b.kind"))
    counts = steps.groupBy(low.alias("low"), high.alias("high")).agg(up.alias("up"), F.count(F.lit(1)).alias("n"))
    balance = 2 * F.col("up") - F.col("n")
    learned = counts.where((F.col("n") >= MIN_SUPPORT) & (F.abs(balance) >= MIN_SIGMA * F.sqrt("n")))
    return learned.select(F.when(balance > 0, F.col("low")).otherwise(F.col("high")).alias("a"), F.when(balance > 0, F.col("high")).otherwise(F.col("low")).alias("b"))


def topologically_latest(nodes: DataFrame, precedence: DataFrame) -> DataFrame:
    """``app``, ``id``: the value no other value of its group comes after.

    ``nodes`` are the values of groups, by kind: ``dated`` (latest time and its id, null if none) and
    ``undated`` (largest id without a time, null if none). In the partial order of a group known times
    follow each other, and a kind precedes another as learned; of several latest values one with a
    known time goes first, then the later time, then the larger id. Where the order runs in a circle
    the latest known time stands, else the largest id.
    """
    newest = nodes.groupBy("app").agg(F.max("dated").alias("newest"), F.max("undated").alias("largest"))
    followed = (
        nodes.select("app", "kind").join(F.broadcast(precedence), F.col("kind") == F.col("a")).select("app", "kind", F.col("b").alias("__next"))
        .join(nodes.select(F.col("app").alias("__app"), F.col("kind").alias("__kind")), (F.col("app") == F.col("__app")) & (F.col("__next") == F.col("__kind")), "left_semi")
        .select(F.col("app").alias("__app"), F.col("kind").alias("__kind")).distinct()
    )
    last = nodes.join(followed, (F.col("app") == F.col("__app")) & (F.col("kind") == F.col("__kind")), "left_anti")
    # of the values with a known time only the newest has none after it
    both = F.array(F.struct(F.lit(True).alias("known"), F.col("dated.at").alias("at"), F.col("dated.id").alias("id")), F.struct(F.lit(False).alias("known"), F.lit(None).cast("timestamp").alias("at"), F.col("undated").alias("id")))
    latest = last.select("app", F.explode(both).alias("v")).where("v.id is not null").join(newest, "app").where("not v.known or (v.at = newest.at and v.id = newest.id)")
    chosen = latest.groupBy("app").agg(F.max("v").alias("v"))
    return newest.join(chosen, "app", "left").select("app", F.coalesce("v.id", "newest.id", "largest").alias("id"))


def survivors(rows: DataFrame) -> DataFrame:
    """The row whose value survives, per group.

    ``rows`` holds one field of one table: ``app`` (group; null: none), ``id``, ``value`` (or its
    ``kind``), ``competes`` (whether the value may survive), ``trust_rank`` (null: least trusted) and
    ``loaded_at``. Among the competing rows the lowest trust rank wins, then the latest ``loaded_at``,
    then the largest id. Where rows of the winning trust rank lack ``loaded_at``, the partial order of
    the group's values decides: known times, and the precedence learned from the timestamped rows of
    all groups. Groups of one row and groups in which nothing competes give no row. Result: ``app``,
    ``id``.

    All steps are aggregates with map-side combine, and a group is reduced to one state per kind of
    value before anything else, so a group of any size never meets in one task.
    """
    grouped = where_computed(rows, F.col("app").isNotNull())
    kind = F.col("kind") if "kind" in rows.columns else value_kind(F.col("value"))
    competing, at = F.col("competes"), F.col("loaded_at")
    dated = F.struct(at.alias("at"), F.col("id").alias("id"))
    nodes = materialize(
        grouped.select(
            "app", F.when(competing, F.coalesce("trust_rank", F.lit(2**31 - 1))).alias("trust"), F.when(competing, kind).alias("kind"),
            F.when(competing & at.isNotNull(), dated).alias("dated"), F.when(competing & at.isNull(), F.col("id")).alias("undated"),
        )
        .groupBy("app", "trust", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.max("dated").alias("dated"), F.min("dated.at").alias("first_at"), F.max("undated").alias("undated"))
    )
    levels = nodes.groupBy("app", "trust").agg(F.sum("n").alias("n"), F.max("dated").alias("dated"), F.max(F.col("undated").isNotNull()).alias("open"))
    best = (
        levels.groupBy("app").agg(F.sum("n").alias("n"), F.min(F.when(F.col("trust").isNotNull(), F.struct("trust", "dated", "open"))).alias("best")).where((F.col("n") >= 2) & F.col("best").isNotNull())
    )
    closed = best.where("not best.open").select("app", F.col("best.dated.id").alias("id"))
    # groups with a missing time where it matters; the trust levels beside the winning one no longer do
    open_groups = nodes.join(best.where("best.open").select(F.col("app").alias("__a"), F.col("best.trust").alias("__t")), (F.col("app") == F.col("__a")) & (F.col("trust") == F.col("__t")), "left_semi")
    return closed.unionAll(topologically_latest(open_groups.select("app", "kind", "dated", "undated"), learn_precedence(nodes.where("kind is not null"))))


def date_rows(records: DataFrame) -> DataFrame:
    """Competitors for ``application_date``: full calendar dates."""
    return records.select("app", "id", F.col("application_date").alias("value"), full_date(F.col("application_date")).isNotNull().alias("competes"), "trust_rank", "loaded_at")


def code_rows(records: DataFrame) -> DataFrame:
    """Competitors for ``ipc_all_raw``: anything that holds a value once separators and quotes are gone."""
    bare = F.regexp_replace("ipc_all_raw", r"[;；,，、|｜\"'“”\[\]\s]+", "")
    return records.select("app", "id", F.col("ipc_all_raw").alias("value"), (~is_no_value(bare)).alias("competes"), "trust_rank", "loaded_at")


def abstract_rows(records: DataFrame, share: float = 0.8) -> DataFrame:
    """Competitors for ``abstract_clean``: at least ``share`` of the longest of the group, in stored characters."""
    lengths = records.select("app", "id", "abstract_clean", F.length("abstract_clean").alias("__len"), (~is_no_value(F.col("abstract_clean"))).alias("__has"), "trust_rank", "loaded_at")
    slim = lengths.select("app", "id", value_kind(F.col("abstract_clean")).alias("kind"), "__len", "__has", "trust_rank", "loaded_at")
    longest = slim.where(F.col("app").isNotNull()).groupBy("app").agg(F.max("__len").alias("__longest"))
    joined = slim.join(longest, "app", "left")
    return joined.select("app", "id", "kind", F.coalesce(F.col("__has") & (F.col("__len") >= F.lit(share) * F.col("__longest")), F.lit(False)).alias("competes"), "trust_rank", "loaded_at")
