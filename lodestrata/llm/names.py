"""Variant spellings of names typed by people: metric-space partitioning and exact radius joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.barrier import not_sent
from ..session import materialize
from .name_parts import Lexicon, damerau, parse_name

#: Names looked at to choose pivots, and most pivots.
SAMPLE, MAX_PIVOTS = 1024, 96
#: Copies of a part's code in the compared string: two parts that differ are that far apart.
CODE = 12
#: Edits (adjacent swaps count one) between two spellings of a stem, by kind of name.
RADIUS = {"zh": 1, "latin": 2, "person": 2}


def parse_names(names: DataFrame, lex: Lexicon) -> DataFrame:
    """``space``, ``name_id`` and the parts of every name that has a value."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for space, key, name in zip(batch["space"].tolist(), batch["name_id"].tolist(), batch["name"].tolist()):
                parts = parse_name(name, lex)
                if parts is not None:
                    rows.append((space, key, *parts))
            yield pd.DataFrame(rows, columns=["space", "name_id", "kind", "stem", "a", "b"])

    return names.select("space", "name_id", "name").mapInPandas(parse, "space string, name_id bigint, kind string, stem string, a string, b string")


def _distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


def choose_pivots(sample: list[str], radius: int, most: int = MAX_PIVOTS) -> list[str]:
    """Farthest-first pivots; as many as make cells smaller without copying most strings.

    A further pivot is taken while the string farthest from all pivots lies beyond what copying at
    the boundary reaches, so strings between cells stay few.
    """
    if not sample:
        return []
    pivots = [min(sample)]
    near = [_distance(s, pivots[0]) for s in sample]
    while len(pivots) < most:
        far = max(range(len(sample)), key=lambda i: (near[i], sample[i]))
        if near[far] < CODE:
            break
        pivots.append(sample[far])
        near = [min(d, _distance(s, sample[far])) for d, s in zip(near, sample)]
    return pivots


def deletions(text: str, radius: int) -> set[str]:
    """``text`` with up to ``radius`` characters left out. Strings within ``radius`` edits share one."""
    out = {text}
    for r in range(1, min(radius, len(text) - 1) + 1):
        for drop in combinations(range(len(text)), r):
            gone = set(drop)
            out.add("".join(c for i, c in enumerate(text) if i not in gone))
    return out


def cells_of(strings: DataFrame) -> DataFrame | None:
    """``strings`` with ``home``, the nearest pivot, and ``cells``, all pivots whose cell may hold a partner; None if there are no strings.

    Distances to pivots are Levenshtein's, over parts and stem; a pair within r edits with swaps is
    within R = 2r there. A string is copied to every cell whose pivot is at most 2R further than its
    nearest: a partner's home is then always among its cells (triangle inequality, twice).
    """
    spark = strings.sparkSession
    full = F.concat("code", "stem")
    sample = [r[0] for r in strings.select(full.alias("t")).orderBy(F.xxhash64("t"), "t").limit(SAMPLE).collect()]
    pivots = choose_pivots(sample, max(RADIUS.values()))
    if not pivots:
        return None
    distances = F.array(*[F.levenshtein(full, F.lit(p)) for p in pivots])
    # distances to all pivots are the costly part: spread them evenly, and compute them once
    placed = strings.repartition(spark.sparkContext.defaultParallelism * 2, "sid").withColumn("dist", distances).withColumn("reach", F.array_min("dist") + 4 * F.col("radius"))
    cells = F.filter(F.transform("dist", lambda d, i: F.when(d <= F.col("reach"), i)), lambda c: c.isNotNull())
    placed = placed.withColumn("home", (F.array_position("dist", F.array_min("dist")) - 1).cast("int")).withColumn("cells", cells)
    return materialize(placed.select("sid", "code", "stem", "radius", "home", "cells"))


def candidate_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of strings of one cell, one of them at home, whose stems share a deletion variant: ``sid_a < sid_b``, parts, stems and radius.

    Nothing but the cell keeps different parts apart here: what is in no common cell is never
    compared. Inside a cell the variants find all pairs within the radius without listing its pairs,
    and spread it over many tasks.
    """
    columns = ["cell", "variant", "sid", "code", "stem", "radius", "at_home"]

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sid, code, stem, radius, home, at in zip(*(batch[c].tolist() for c in ("sid", "code", "stem", "radius", "home", "cells"))):
                # one run of a code's copies is enough once strings are compared within a cell
                short = "".join(c for i, c in enumerate(code) if i == 0 or code[i - 1] != c)
                for v in deletions(stem, radius):
                    rows += [(int(c), v, sid, short, stem, int(radius), int(c) == home) for c in at]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    keyed = placed.mapInPandas(variants, "cell int, variant string, sid string, code string, stem string, radius int, at_home boolean")
    left, right = keyed.where("at_home").alias("x"), keyed.alias("y")
    candidates = left.join(not_sent(right), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.variant") == F.col("y.variant"))).where("x.sid <> y.sid")
    first = F.col("x.sid") < F.col("y.sid")
    pick = lambda c: (F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    (sid_a, sid_b), (code_a, code_b), (s, t) = pick("sid"), pick("code"), pick("stem")
    return candidates.select(sid_a.alias("sid_a"), sid_b.alias("sid_b"), code_a.alias("code_a"), code_b.alias("code_b"), s.alias("s"), t.alias("t"), F.col("x.radius").alias("radius")).distinct()


def radius_pairs(strings: DataFrame) -> DataFrame:
    """All pairs of strings within their radius: ``sid_a < sid_b`` and ``d``.

    ``strings`` has ``sid``, ``code`` (the rendered parts), ``stem`` and ``radius``. Strings go to the
    cell of their nearest pivot and to those their partners may be at home in (``cells_of``); inside a
    cell candidates are compared (``candidate_pairs``) by the true metric: Damerau-Levenshtein's
    distance of the stems, and parts that differ are farther apart than any radius. An empty table
    gives no pairs.
    """
    placed = cells_of(strings)
    if placed is None:
        return strings.sparkSession.createDataFrame([], "sid_a string, sid_b string, d int")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = [damerau(a, b) for a, b in zip(batch["s"].tolist(), batch["t"].tolist())]
            out = batch[["sid_a", "sid_b"]].assign(d=pd.Series(d, index=batch.index, dtype="int32"))
            yield out[out["d"] <= batch["radius"]]

    same = candidate_pairs(placed).where("code_a = code_b")
    return materialize(same.mapInPandas(exact, "sid_a string, sid_b string, d int"))


def _run(values: list[str], offset: int) -> dict[str, str]:
    """A private-use character per value, CODE copies of it."""
    return {v: chr(0xE000 + offset + i) * CODE for i, v in enumerate(values)}


def linked_names(names: DataFrame, lex: Lexicon) -> DataFrame:
    """``space``, ``name_id`` and ``entity`` of every name with a value.

    ``names`` has ``space`` (names of different spaces are never linked), ``name_id`` and ``name``.
    Names are taken apart; equal parts are one node. A node is compared by every part it has: town
    and stem, stem and line of business, stem alone; initial and surname. Two nodes are linked if
    their stems are within the radius and no known part disagrees; a stem with edits needs a part
    that agrees, or length. Complete nodes gather round their best supported neighbour; incomplete
    ones join the entity they fit if there is only one, else each other.

    Null and blank names belong to no entity; repeated names are of one entity; an empty table gives
    no rows.
    """
    parsed = materialize(parse_names(names, lex))
    part = ["space", "kind", "stem", "a", "b"]
    nodes = parsed.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.min("name_id").alias("first"))
    # 128 bits tell nodes and strings apart however many there are
    node_id = F.md5(F.concat_ws("\u0000", *part))
    full = (
        F.when(F.col("kind") == "zh", (F.col("a") != "") & (F.col("b") != ""))
        .when(F.col("kind") == "latin", F.col("a") != "")
        .otherwise((F.length("a") > 1) & (F.col("b") != ""))
    )
    nodes = materialize(nodes.withColumn("nid", node_id).withColumn("full", full))
    spaces = sorted(r[0] for r in nodes.select("space").distinct().collect())
    # views of a node; each is rendered as runs of private characters, so that a plain edit distance
    # over the whole string keeps different parts CODE edits apart
    initial = F.substring("a", 1, 1)
    views = F.array(
        F.struct(F.when((F.col("kind") == "zh") & (F.col("a") != ""), F.concat(F.lit("t:"), "a")).alias("v")),
        F.struct(F.when((F.col("kind") == "zh") & (F.col("b") != ""), F.concat(F.lit("z:"), "b")).alias("v")),
        F.struct(F.when((F.col("kind") == "latin") & (F.col("a") != ""), F.concat(F.lit("l:"), "a")).alias("v")),
        F.struct(F.when(F.col("kind") == "person", F.concat(F.lit("p:"), initial)).alias("v")),
        F.struct(F.when(F.col("kind") != "person", F.concat(F.lit("s:"), "kind")).alias("v")),
    )
    seen = nodes.select("nid", "space", "kind", "stem", F.explode(views).alias("s")).select("nid", "space", "kind", "stem", F.col("s.v").alias("view")).where("view is not null")
    seen = materialize(seen.withColumn("sid", F.md5(F.concat_ws("\u0000", "space", "view", "stem"))))
    labels = sorted(r[0] for r in seen.select("view").distinct().collect())
    runs = _run([*(f"space:{s}" for s in spaces), *labels], 0)
    mapping = F.create_map(*[x for k, v in runs.items() for x in (F.lit(k), F.lit(v))]) if runs else None
    strings = seen.groupBy("sid").agg(F.first("space").alias("space"), F.first("view").alias("view"), F.first("stem").alias("stem"), F.first("kind").alias("kind"))
    if mapping is None:
        return parsed.select("space", "name_id", F.lit(None).cast("string").alias("entity"))
    radius = F.when(F.col("kind") == "zh", RADIUS["zh"]).when(F.length("stem") >= 7, RADIUS["latin"]).otherwise(1)
    strings = strings.select("sid", F.concat(mapping[F.concat(F.lit("space:"), "space")], mapping[F.col("view")]).alias("code"), "stem", radius.alias("radius"))
    pairs = radius_pairs(materialize(strings))
    both = pairs.unionAll(pairs.select(F.col("sid_b"), F.col("sid_a"), "d")).unionAll(
        seen.select("sid", F.col("sid").alias("s2"), F.lit(0).alias("d")).distinct()
    )
    at = seen.select("nid", "sid")
    links = (
        at.select(F.col("nid").alias("u"), F.col("sid").alias("sid_a"))
        .join(not_sent(both), "sid_a")
        .join(not_sent(at.select(F.col("nid").alias("v"), F.col("sid").alias("sid_b"))), "sid_b")
        .where("u <> v")
        .select("u", "v", "d")
        .distinct()
    )
    left = nodes.select(*[F.col(c).alias(f"{c}_u") for c in ("nid", "kind", "stem", "a", "b", "full", "n")])
    right = nodes.select(*[F.col(c).alias(f"{c}_v") for c in ("nid", "kind", "stem", "a", "b", "full", "n")])
    fits = F.expr(
        """kind_u = kind_v
           AND (a_u = '' OR a_v = '' OR a_u = a_v OR (kind_u = 'person' AND (length(a_u) = 1 OR length(a_v) = 1) AND left(a_u, 1) = left(a_v, 1)))
           AND (b_u = '' OR b_v = '' OR b_u = b_v)
           AND (d = 0 OR (kind_u = 'zh' AND ((a_u <> '' AND a_u = a_v) OR (b_u <> '' AND b_u = b_v)))
                OR (kind_u = 'latin' AND ((a_u <> '' AND a_u = a_v) OR length(stem_u) >= 7))
                OR (kind_u = 'person' AND length(stem_u) >= 6))"""
    )
    edges = materialize(
        links.join(not_sent(left), F.col("u") == F.col("nid_u")).join(not_sent(right), F.col("v") == F.col("nid_v")).where(fits).select("u", "v", "d", "full_u", "full_v")
    )
    rooted = _gather(nodes.where("full"), edges.where("full_u and full_v"))
    rooted = materialize(rooted)
    # incomplete nodes: the one entity among the nearest complete neighbours
    near = edges.where("not full_u and full_v").join(not_sent(rooted.select(F.col("nid").alias("v"), "entity")), "v")
    best = near.groupBy("u").agg(F.min("d").alias("dm"))
    tied = near.join(not_sent(best), "u").where("d = dm").groupBy("u").agg(F.min("entity").alias("e0"), F.max("entity").alias("e1"))
    placed = tied.where("e0 = e1").select(F.col("u").alias("nid"), F.col("e0").alias("entity"))
    settled = materialize(rooted.unionByName(placed))
    loose = nodes.join(not_sent(settled.select("nid")), "nid", "left_anti")
    loose = materialize(loose)
    open_edges = edges.join(not_sent(loose.select(F.col("nid").alias("u"))), "u", "left_semi").join(not_sent(loose.select(F.col("nid").alias("v"))), "v", "left_semi")
    entity = settled.unionByName(_gather(loose, open_edges))
    return parsed.withColumn("nid", node_id).join(not_sent(entity), "nid").select("space", "name_id", "entity")


def _gather(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nid`` and ``entity``: each node follows its best supported neighbour to the end.

    Support is the number of known parts, then of links, then of names; a node better than all its
    neighbours is an entity. As ranks rise along the way there are no circles; the way is halved in
    each round (pointer doubling) until every node points at an entity, so there are as many rounds
    as the logarithm of the longest way.
    """
    degree = edges.groupBy(F.col("u").alias("nid")).agg(F.count(F.lit(1)).alias("deg"))
    known = (F.col("a") != "").cast("int") + (F.length("a") > 1).cast("int") + (F.col("b") != "").cast("int")
    rank = F.struct(known.alias("known"), F.coalesce("deg", F.lit(0)).alias("deg"), F.col("n").alias("n"), F.col("nid").alias("nid"))
    ranked = nodes.join(not_sent(degree), "nid", "left").select("nid", rank.alias("rank"))
    reach = edges.select("u", "v").join(not_sent(ranked.select(F.col("nid").alias("v"), "rank")), "v").select(F.col("u").alias("nid"), "rank")
    hop = materialize(ranked.unionAll(reach.select("nid", "rank")).groupBy("nid").agg(F.max("rank").alias("r")).select("nid", F.col("r.nid").alias("entity"), F.lit(True).alias("moved")))
    while True:
        further = hop.select(F.col("nid").alias("entity"), F.col("entity").alias("next"))
        hop = materialize(hop.join(not_sent(further), "entity").select("nid", F.col("next").alias("entity"), (F.col("next") != F.col("entity")).alias("moved")))
        if not hop.where("moved").limit(1).count():
            return hop.select("nid", "entity")


def name_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of names of one entity, the smaller id first."""
    a = linked.select(F.col("space").alias("field_name"), F.col("entity").alias("e"), F.col("name_id").alias("name_id_a"))
    b = linked.select(F.col("space").alias("f"), F.col("entity").alias("e2"), F.col("name_id").alias("name_id_b"))
    return a.join(not_sent(b), (F.col("field_name") == F.col("f")) & (F.col("e") == F.col("e2")) & (F.col("name_id_a") < F.col("name_id_b"))).select("field_name", "name_id_a", "name_id_b")
