"""Codes of applications: edges, mass, diversity, point-in-time pairs and quarterly metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.dates import label_ordinal, ordinal_label, period_of_year, quarter_label, quarter_ordinal
from ..functions.keys import distance, pair_id, relatedness, smoothed_probability
from .barrier import broadcast_if_small

CURRENT, HISTORICAL = "2026.01", "2025.01"
TAXONOMY_SIZE, ALPHA = 655, 1.0
#: The metrics summarised by period.
PERIOD_METRICS = [
    "patent_count", "invention_patent_count", "utility_model_patent_count", "design_patent_count", "eligible_all_patent_count", "ipc_coded_patent_count", "ipc_coding_rate",
    "ipc_entropy", "ipc_hhi", "ipc_one_minus_hhi", "average_patent_scope", "median_patent_scope", "related_variety", "unrelated_variety", "average_technological_distance",
    "median_technological_distance", "rao_stirling_diversity", "multi_ipc_patent_share", "novel_pair_share", "novel_patent_share", "pair_rarity_mean",
]
ROLLING_SUMS = ["patent_count", "invention_patent_count", "novel_patent_count", "all_ipc_pair_count", "novel_ipc_pair_count"]


def taxonomy(dictionary: DataFrame) -> DataFrame:
    """``subclass`` and the scheme version it maps to: the current one, else the historical bridge."""
    valid = dictionary.where("is_valid and ipc_level = 'subclass'").where(F.col("scheme_version").isin(CURRENT, HISTORICAL))
    return valid.groupBy(F.col("ipc_code").alias("subclass")).agg(F.max("scheme_version").alias("taxonomy_version"))


def token_mappings(universe: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Every token of every application with its mapping status, scheme version and source.

    Without a dictionary every subclass counts as current.
    """
    tokens = universe.select(
        "application_no", "application_date", "ipc_main_subclass", F.posexplode(codes.code_tokens(F.col("raw_ipc_values"))).alias("pos", "t")
    ).select("application_no", "application_date", "ipc_main_subclass", "pos", "t.*")
    if dictionary is None:
        mapped = tokens.withColumn("taxonomy_version", F.when(F.col("subclass").isNotNull(), CURRENT))
    else:
        mapped = tokens.join(broadcast_if_small(taxonomy(dictionary)), "subclass", "left")
    status = F.when(F.col("taxonomy_version") == CURRENT, "current_subclass").when(F.col("taxonomy_version") == HISTORICAL, "historical_bridge_subclass").otherwise("unmatched")
    source = F.when(F.col("taxonomy_version") == CURRENT, f"ipc_dictionary_{CURRENT}").when(F.col("taxonomy_version") == HISTORICAL, f"ipc_dictionary_{HISTORICAL}_bridge")
    return mapped.withColumn("mapping_status", status).withColumn("mapping_source", source)


def unmatched_sample(universe: DataFrame, dictionary: DataFrame | None = None, n: int = 10_000) -> DataFrame:
    """The first ``n`` tokens without a subclass of the taxonomy, by quarter, application and position."""
    from .records import first_rows

    lost = token_mappings(universe, dictionary).where("mapping_status = 'unmatched'")
    rows = lost.select(quarter_label(F.col("application_date")).alias("quarter"), "application_no", F.col("pos").cast("int").alias("pos"), "raw_ipc", "mapping_status")
    return first_rows(rows, ["quarter", "application_no", "pos"], n)


def code_edges(universe: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Application and subclass with the fractional weight 1/k of its k mapped subclasses.

    The subclasses of an application are collected before they are weighted, so one shuffle on the
    application serves both.
    """
    mapped = token_mappings(universe, dictionary).where("mapping_status <> 'unmatched'")
    edges = mapped.groupBy("application_no", "subclass").agg(
        F.first("application_date").alias("application_date"),
        F.first("ipc_main_subclass").alias("main"),
        F.first("mapping_status").alias("mapping_status"),
        F.first("taxonomy_version").alias("taxonomy_version"),
        F.min_by("raw_ipc", "pos").alias("raw_ipc"),
    )
    k = F.count(F.lit(1)).over(W.partitionBy("application_no"))
    return edges.select(
        "application_no",
        "application_date",
        quarter_label(F.col("application_date")).alias("quarter"),
        F.col("subclass").alias("ipc_subclass"),
        (F.lit(1.0) / k).alias("fractional_weight"),
        F.coalesce(F.col("subclass") == F.col("main"), F.lit(False)).cast("int").alias("is_main_ipc"),
        "mapping_status",
        "taxonomy_version",
        "raw_ipc",
    )


def _ordered_sum(items: Column) -> Column:
    """Sum of an array from the left, so that a float result does not depend on how rows were spread."""
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + x)


def code_mass(edges: DataFrame, period: str = "quarter") -> DataFrame:
    """Sum of weights per period and subclass.

    Equal weights are counted and the few different ones summed in order, so the sum is the same
    however rows are spread.
    """
    counts = edges.groupBy(period, "ipc_subclass", "fractional_weight").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("fractional_weight").alias("w"), "n")))
    return counts.groupBy(period, "ipc_subclass").agg(_ordered_sum(F.transform(parts, lambda p: p["w"] * p["n"])).alias("mass"))


def diversity(mass: DataFrame, period: str = "quarter") -> DataFrame:
    """Entropy, concentration and its complement, related and unrelated variety per period.

    Variety is by three-character class: related = -sum p ln(m/g), unrelated = -sum p ln(g/T), with the
    mass m of a code, g of its class and T of the period; they add up to the entropy. Codes per period
    are at most those of the taxonomy; they are summed in order of class and code.
    """
    code = F.struct("ipc_subclass", F.col("mass").alias("m"))
    classes = mass.groupBy(period, F.substring("ipc_subclass", 1, 3).alias("class")).agg(F.array_sort(F.collect_list(code)).alias("codes"))
    classes = classes.withColumn("g", _ordered_sum(F.transform("codes", lambda c: c["m"])))
    periods = classes.groupBy(period).agg(F.array_sort(F.collect_list(F.struct("class", "g", "codes"))).alias("cs")).withColumn("t", _ordered_sum(F.transform("cs", lambda c: c["g"])))
    flat = F.flatten(F.transform("cs", lambda c: F.transform(c["codes"], lambda x: F.struct((x["m"] / F.col("t")).alias("p"), (x["m"] / c["g"]).alias("within"), (c["g"] / F.col("t")).alias("between")))))
    shares = periods.select(period, flat.alias("s"))
    total = lambda f: _ordered_sum(F.transform("s", f))
    hhi = total(lambda x: x["p"] * x["p"])
    return shares.select(
        period, F.size("s").cast("bigint").alias("unique_ipc_subclass_count"), total(lambda x: -x["p"] * F.log(x["p"])).alias("ipc_entropy"), hhi.alias("ipc_hhi"), (F.lit(1.0) - hhi).alias("ipc_one_minus_hhi"),
        total(lambda x: -x["p"] * F.log(x["within"])).alias("related_variety"), total(lambda x: -x["p"] * F.log(x["between"])).alias("unrelated_variety"),
    )


def application_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs of subclasses of one application, a < b, made inside one row per application."""
    sets = edges.groupBy("application_no").agg(F.first("application_date").alias("application_date"), F.array_sort(F.collect_set("ipc_subclass")).alias("c"))
    pairs = F.flatten(
        F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(a.alias("ipc_a"), b.alias("ipc_b"))))
    )
    return sets.where(F.size("c") > 1).select("application_no", "application_date", F.explode(pairs).alias("p")).select("application_no", "application_date", "p.*")


def _before(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Running sums of daily counts over strictly earlier days, per key."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("application_date").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*keys, "application_date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias(name))


def pair_events(edges: DataFrame, alpha: float = ALPHA, taxonomy_size: int = TAXONOMY_SIZE) -> DataFrame:
    """Every pair of every application against the state strictly before its date.

    Daily counts are aggregated first; what a date sees is a running sum that stops before it, and as
    a pair's codes occur on the very date of the pair, plain equi-joins find it.
    """
    pairs = application_pairs(edges)
    per_pair = pairs.groupBy("ipc_a", "ipc_b", "application_date").agg(F.count(F.lit(1)).alias("n"))
    per_code = edges.groupBy("ipc_subclass", "application_date").agg(F.count(F.lit(1)).alias("n"))
    per_day = per_pair.groupBy("application_date").agg(F.sum("n").alias("n"))
    n_pair = _before(per_pair, ["ipc_a", "ipc_b"], "historical_pair_count")
    n_code = _before(per_code, ["ipc_subclass"], "n_code")
    n_total = _before(per_day, [], "historical_total_pair_count")
    a = n_code.select(F.col("ipc_subclass").alias("ipc_a"), "application_date", F.col("n_code").alias("n_a"))
    b = n_code.select(F.col("ipc_subclass").alias("ipc_b"), "application_date", F.col("n_code").alias("n_b"))
    state = n_pair.join(a, ["ipc_a", "application_date"]).join(b, ["ipc_b", "application_date"]).join(n_total, "application_date")
    p = smoothed_probability(F.col("historical_pair_count"), F.col("historical_total_pair_count"), alpha, taxonomy_size)
    dist = distance(relatedness(F.col("historical_pair_count"), F.col("n_a"), F.col("n_b")))
    scored = state.select(
        "ipc_a", "ipc_b", "application_date", "historical_pair_count", "historical_total_pair_count",
        (F.col("historical_pair_count") == 0).cast("int").alias("historical_first"), p.alias("smoothed_pair_probability"), (-F.log(p)).alias("pair_rarity"),
        (F.lit(1.0) - dist).alias("technological_relatedness"), dist.alias("technological_distance"),
    )
    return pairs.join(scored, ["ipc_a", "ipc_b", "application_date"]).select(
        "application_no", "application_date", quarter_label(F.col("application_date")).alias("quarter"), "ipc_a", "ipc_b", pair_id(F.col("ipc_a"), F.col("ipc_b")).alias("pair_id"),
        "historical_pair_count", "historical_total_pair_count", "historical_first", "smoothed_pair_probability", "pair_rarity", "technological_relatedness", "technological_distance",
    )


def relatedness_matrix(edges: DataFrame, dictionary_codes: DataFrame | None = None) -> DataFrame:
    """All pairs a <= b of the codes seen (or of a given code list) with their final counts.

    The pairs of a taxonomy are its stated grid; the list is that of subclasses, a fixed few hundred.
    """
    counts = edges.groupBy("ipc_subclass").agg(F.count(F.lit(1)).alias("n"))
    pairs = application_pairs(edges).groupBy("ipc_a", "ipc_b").agg(F.count(F.lit(1)).alias("n_pair"))
    listed = counts if dictionary_codes is None else dictionary_codes.select(F.col("subclass").alias("ipc_subclass")).join(counts, "ipc_subclass", "left").fillna(0, ["n"])
    everything = listed.agg(F.array_sort(F.collect_list(F.struct("ipc_subclass", "n"))).alias("c"))
    grid = everything.select(
        F.explode(F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 1, F.size("c")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("g")
    ).select(F.col("g.a.ipc_subclass").alias("ipc_a"), F.col("g.b.ipc_subclass").alias("ipc_b"), F.col("g.a.n").alias("n_a"), F.col("g.b.n").alias("n_b"))
    joined = grid.join(pairs, ["ipc_a", "ipc_b"], "left")
    same = F.col("ipc_a") == F.col("ipc_b")
    n_pair = F.when(same, F.col("n_a")).otherwise(F.coalesce("n_pair", F.lit(0)))
    related = relatedness(n_pair, F.col("n_a"), F.col("n_b"))
    related = F.when(same, F.lit(1.0)).otherwise(related)
    return joined.select("ipc_a", "ipc_b", "n_a", "n_b", n_pair.alias("n_pair"), related.alias("relatedness"), distance(related).alias("distance"))


def rao_stirling(edges: DataFrame) -> DataFrame:
    """Rao-Stirling diversity per quarter, distances as they stood at its start.

    1 - sum p^2 - 2 sum_{a<b} p_a p_b r_ab, floored at 0; pairs without a history are at distance 1.
    Only pairs that occurred before can have relatedness. A pair's cumulative counts hold for intervals
    of quarters; each interval is spread over its quarters, so that every join is on the quarter too.
    """
    mass = code_mass(edges.withColumn("q", quarter_ordinal(F.col("application_date"))), "q")
    p = mass.withColumn("p", F.col("mass") / F.sum("mass").over(W.partitionBy("q"))).select("q", "ipc_subclass", "p")
    per_code = edges.groupBy(F.col("ipc_subclass"), quarter_ordinal(F.col("application_date")).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("ipc_subclass").orderBy("q").rowsBetween(W.unboundedPreceding, -1)
    seen = per_code.select("ipc_subclass", "q", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    pairs = application_pairs(edges).groupBy("ipc_a", "ipc_b", quarter_ordinal(F.col("application_date")).alias("pq")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("ipc_a", "ipc_b").orderBy("pq")
    last = F.broadcast(edges.agg(quarter_ordinal(F.max("application_date")).alias("last")))
    history = pairs.select("ipc_a", "ipc_b", (F.col("pq") + 1).alias("lo"), F.lead("pq").over(w).alias("hi"), F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("n_pair")).crossJoin(last)
    history = history.withColumn("hi", F.coalesce("hi", "last")).where("lo <= hi").select("ipc_a", "ipc_b", "n_pair", F.explode(F.sequence("lo", "hi")).alias("q"))
    known = p.join(seen, ["q", "ipc_subclass"])
    a = known.select("q", F.col("ipc_subclass").alias("ipc_a"), F.col("p").alias("p_a"), F.col("n").alias("n_a"))
    b = known.select("q", F.col("ipc_subclass").alias("ipc_b"), F.col("p").alias("p_b"), F.col("n").alias("n_b"))
    related = 2 * F.col("p_a") * F.col("p_b") * (1 - distance(relatedness(F.col("n_pair"), F.col("n_a"), F.col("n_b"))))
    cross = history.join(a, ["q", "ipc_a"]).join(b, ["q", "ipc_b"]).groupBy("q").agg(F.sum(related).alias("related"))
    own = diversity(mass, "q").select("q", "ipc_hhi")
    return own.join(cross, "q", "left").select(
        ordinal_label(F.col("q")).alias("quarter"), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("ipc_hhi") - F.coalesce("related", F.lit(0.0))).alias("rao_stirling_diversity")
    )


def quarterly_metrics(core: DataFrame, firm_edge_rows: DataFrame, universe: DataFrame, edges: DataFrame, events: DataFrame, start: str = "1985Q1", until: str | None = None) -> DataFrame:
    """The full quarterly row, gaps filled from ``start`` to the last quarter: zero counts, null ratios."""
    from .records import type_counts

    apps = universe.select("application_no", "patent_type_group", quarter_label(F.col("application_date")).alias("quarter"))
    scope = edges.groupBy("application_no", "quarter").agg(F.count(F.lit(1)).alias("k"))
    per_app = apps.join(scope.select("application_no", "k"), "application_no", "left")
    counts = per_app.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("patent_count"),
        F.count_if(F.col("patent_type_group") == "invention").alias("invention_patent_count"),
        F.count_if(F.col("patent_type_group") == "utility_model").alias("utility_model_patent_count"),
        F.count("k").alias("ipc_coded_patent_count"),
        F.avg("k").alias("average_patent_scope"),
        F.median("k").alias("median_patent_scope"),
        F.count_if(F.col("k") == 1).alias("single_ipc_patent_count"),
        F.count_if(F.col("k") > 1).alias("multi_ipc_patent_count"),
    )
    pair_app = events.groupBy("quarter", "application_no").agg(
        F.max("historical_first").alias("novel"), F.count(F.lit(1)).alias("n"), F.sum("historical_first").alias("n_novel"),
        F.avg("pair_rarity").alias("rarity"), F.sum("pair_rarity").alias("rarity_sum"), F.avg("technological_distance").alias("dist"),
    )
    pairs = pair_app.groupBy("quarter").agg(
        F.sum("novel").cast("bigint").alias("novel_patent_count"), F.sum("n").alias("all_ipc_pair_count"), F.sum("n_novel").cast("bigint").alias("novel_ipc_pair_count"),
        F.avg("rarity").alias("pair_rarity_mean"), F.try_divide(F.sum("rarity_sum"), F.sum("n")).alias("pair_rarity_pair_weighted_mean"),
        F.avg("dist").alias("average_technological_distance"), F.median("dist").alias("median_technological_distance"),
    )
    kinds = type_counts(core, firm_edge_rows).select(
        "quarter", F.col("design_count").alias("design_patent_count"), F.col("other_count").alias("other_patent_count"), F.col("eligible_all_count").alias("eligible_all_patent_count")
    )
    joined = counts.join(kinds, "quarter", "full").join(diversity(code_mass(edges)), "quarter", "left").join(rao_stirling(edges), "quarter", "left").join(pairs, "quarter", "left")
    last = F.lit(until) if until else F.max("quarter")
    calendar = joined.agg(F.sequence(label_ordinal(F.lit(start)), label_ordinal(last)).alias("qs")).select(F.explode("qs").alias("q")).select(ordinal_label(F.col("q")).alias("quarter"))
    zeros = [
        "patent_count", "invention_patent_count", "utility_model_patent_count", "design_patent_count", "other_patent_count", "eligible_all_patent_count", "ipc_coded_patent_count",
        "unique_ipc_subclass_count", "single_ipc_patent_count", "multi_ipc_patent_count", "novel_patent_count", "all_ipc_pair_count", "novel_ipc_pair_count",
    ]
    filled = calendar.join(joined, "quarter", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in zeros})
    missing = F.greatest(F.lit(0), F.col("patent_count") - F.col("ipc_coded_patent_count"))
    return filled.withColumns(
        {
            "design_patent_share": F.try_divide("design_patent_count", "eligible_all_patent_count"),
            "ipc_coding_rate": F.try_divide("ipc_coded_patent_count", "patent_count"),
            "ipc_missing_patent_count": missing,
            "ipc_missing_rate": F.try_divide(missing, "patent_count"),
            "multi_ipc_patent_share": F.try_divide("multi_ipc_patent_count", "ipc_coded_patent_count"),
            "novel_patent_share": F.try_divide("novel_patent_count", "multi_ipc_patent_count"),
            "novel_pair_share": F.try_divide("novel_ipc_pair_count", "all_ipc_pair_count"),
            "history_start_date": F.lit("1985-01-01"),
            "pre_sample_initialization_flag": (F.substring("quarter", 1, 4).cast("int") <= 1993).cast("int"),
        }
    )


def metrics_of_universe(universe: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """The quarterly row of a universe by itself, from its first to its last quarter.

    Nothing is known of applications outside it, so all eligible ones are its own. An empty universe
    gives no rows.
    """
    first = universe.agg(F.min(quarter_label(F.col("application_date")))).first()[0]
    core = universe.drop("eligible_firm_count", "all_firm_count")
    firms = universe.select("application_no", F.lit("").alias("stkcd"), F.lit(1).alias("baseline_eligible"))
    found = quarterly_metrics(core, firms, universe, edges, events, first or "1985Q1")
    return found if first else found.limit(0)


def rolling_4q(metrics: DataFrame, mass: DataFrame) -> DataFrame:
    """Four-quarter versions: sums, ratios of sums, and diversity over the pooled mass; null for the first three quarters."""
    w = W.orderBy("q").rowsBetween(-3, 0)
    n = F.count(F.lit(1)).over(w)
    total = lambda c: F.when(n == 4, F.sum(c).over(w))
    base = metrics.withColumn("q", label_ordinal(F.col("quarter")))
    sums = base.select(
        "quarter", "q", n.alias("__n"), *[total(c).alias(f"{c}_4q") for c in ROLLING_SUMS],
        F.try_divide(total("multi_ipc_patent_count"), total("ipc_coded_patent_count")).alias("multi_ipc_patent_share_4q"),
        F.try_divide(total("novel_patent_count"), total("multi_ipc_patent_count")).alias("novel_patent_share_4q"),
        F.try_divide(total("novel_ipc_pair_count"), total("all_ipc_pair_count")).alias("novel_pair_share_4q"),
    )
    pooled = (
        mass.select(F.explode(F.sequence(label_ordinal(F.col("quarter")), label_ordinal(F.col("quarter")) + 3)).alias("q"), "ipc_subclass", "mass")
        .groupBy("q", "ipc_subclass").agg(_ordered_sum(F.array_sort(F.collect_list("mass"))).alias("mass"))
    )
    spread = diversity(pooled, "q").select("q", *[F.col(c).alias(f"{c}_4q") for c in ("ipc_entropy", "ipc_hhi", "ipc_one_minus_hhi")])
    full = ["ipc_entropy_4q", "ipc_hhi_4q", "ipc_one_minus_hhi_4q"]
    return sums.join(spread, "q", "left").withColumns({c: F.when(F.col("__n") == 4, F.col(c)) for c in full}).drop("q", "__n")


def period_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Per period and metric: count, non-null count, sum, mean, median, first, last, min, max in quarter order."""
    long = metrics.select("quarter", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("quarter", columns, "metric", "value")
    keyed = long.withColumn("period", period_of_year(F.substring("quarter", 1, 4).cast("int"))).where("period is not null")
    has = F.when(F.col("value").isNotNull(), F.col("quarter"))
    return keyed.groupBy("period", "metric").agg(
        F.count(F.lit(1)).alias("quarter_count"), F.count("value").alias("non_null_count"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.median("value").alias("median"),
        F.min_by("value", has).alias("first"), F.max_by("value", has).alias("last"), F.min("value").alias("min"), F.max("value").alias("max"),
    )


def pair_history(events: DataFrame) -> DataFrame:
    """Per quarter: pair rows, first-ever pairs, and both cumulated."""
    firsts = events.groupBy("pair_id").agg(F.min("quarter").alias("quarter")).groupBy("quarter").agg(F.count(F.lit(1)).alias("new_pairs"))
    rows = events.groupBy("quarter").agg(F.count(F.lit(1)).alias("pair_occurrences"))
    w = W.orderBy("quarter").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(firsts, "quarter", "left").withColumn("new_pairs", F.coalesce("new_pairs", F.lit(0)))
    return joined.select("quarter", "pair_occurrences", "new_pairs", F.sum("pair_occurrences").over(w).alias("cumulative_occurrences"), F.sum("new_pairs").over(w).alias("cumulative_pairs"))


def pre_sample_counts(universe: DataFrame, events: DataFrame, last_year: int = 1993) -> DataFrame:
    """Per year up to ``last_year``: applications of the universe, and pairs and occurrences seen by its end."""
    years = universe.where(F.year("application_date") <= last_year).groupBy(F.year("application_date").alias("year")).agg(F.count(F.lit(1)).alias("record_count"))
    seen = events.where(F.year("application_date") <= last_year)
    firsts = seen.groupBy("pair_id").agg(F.min(F.year("application_date")).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("new"))
    rows = seen.groupBy(F.year("application_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    joined = years.join(firsts, "year", "left").join(rows, "year", "left")
    return joined.select("year", "record_count", total("new").alias("seen_pair_count"), total("n").alias("pair_occurrence_count"))


def annual_reconciliation(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Full outer join of two yearly counts with their difference and status.

    Both have ``year`` and ``n``. Status: ``missing_ours``, ``missing_theirs``, ``equal``, ``higher`` or ``lower``.
    """
    j = ours.select("year", F.col("n").alias("ours")).join(theirs.select("year", F.col("n").alias("theirs")), "year", "full")
    diff = F.col("ours") - F.col("theirs")
    status = (
        F.when(F.col("ours").isNull(), "missing_ours").when(F.col("theirs").isNull(), "missing_theirs").when(F.abs(diff) <= tolerance, "equal").when(diff > 0, "higher").otherwise("lower")
    )
    return j.select("year", "ours", "theirs", diff.alias("difference"), status.alias("status"))


#: Yearly counts compared with a panel: ours, and the panel's column where it has one.
COMPARED = {
    "patent_count": "patents_independent_annual", "invention_patent_count": "patents_invention_independent_annual", "utility_model_patent_count": "patents_utility_model_independent_annual",
    "design_patent_count": "patents_design_independent_annual", "other_patent_count": None,
}


def annual_comparison(metrics: DataFrame, panel: DataFrame) -> DataFrame:
    """Yearly sums of five counts of the quarterly table beside those of a firm-year panel, outer join.

    ``detail_*`` are ours, ``existing_panel_*`` the panel's (which has no count of other types), and the
    difference is that of all applications. The two count different things, which ``comparison_status``
    says. A panel without one of the columns raises ``ValueError`` naming it.
    """
    known = {c: p for c, p in COMPARED.items() if p}
    if missing := sorted({"year", *known.values()} - set(panel.columns)):
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    ours = metrics.groupBy(F.substring("quarter", 1, 4).cast("int").alias("year")).agg(*[F.sum(c).alias(f"detail_{c}") for c in COMPARED])
    theirs = panel.groupBy(F.col("year").cast("int").alias("year")).agg(*[F.sum(p).alias(f"existing_panel_{c.replace('_patent_count', '_count')}") for c, p in known.items()])
    joined = ours.join(theirs, "year", "full")
    return joined.withColumns({
        "detail_minus_existing_patent_count": F.col("detail_patent_count") - F.col("existing_panel_patent_count"), "comparison_status": F.lit("directional_not_like_for_like"),
    })
