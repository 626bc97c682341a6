"""Several values packed in one field: infer the delimiters of each source, split, keep positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import NO_VALUE_MARKS, half_width, is_no_value
from .barrier import where_computed

# Quoting pairs around one packed value.
QUOTED = r"\"[^\"]*\"|'[^']*'|“[^”]*”"


@dataclass(frozen=True)
class Candidate:
    """A separator that may be in use: its pattern in the text, and the characters it consists of."""

    name: str
    pattern: str


# Candidate separators. Blanks separate only between the end of one value and the
# letter that begins the next, as blanks also stand inside values.
CANDIDATES = [
    Candidate("semicolon", ";+"),
    Candidate("wide semicolon", "；+"),
    Candidate("comma", ",+"),
    Candidate("wide comma", "，+"),
    Candidate("enumeration comma", "、"),
    Candidate("bar", r"[|｜]+"),
    Candidate("line break", r"[\r\n]+"),
    Candidate("tab", r"\t"),
    Candidate("wide blank", r"　"),
    Candidate("blanks", r"(?<=[0-9)\]INin])[  ]{2,}(?=[A-Za-z][0-9?])"),
    Candidate("blank", r"(?<=[0-9)\]INin])[  ](?=[A-Za-z][0-9?])"),
    Candidate("full stop", r"(?<=[0-9A-Za-z])\.(?=[A-Za-z])"),
    Candidate("hyphen", r"(?<=[0-9])-(?=[A-Za-z])"),
    Candidate("ampersand", "&"),
    Candidate("plus", r"\+"),
    Candidate("hash", "#"),
]

#: A classification code as it is typed: blanks inside, a version in brackets, one trailing flag.
CODE = r"[A-Za-z][0-9]{2}[A-Za-z]\s*[0-9]+\s*[/／]\s*[0-9]+(?:\s*[\[(（][0-9]{4}\.[0-9]{2}[\])）])?(?:\s?[INin](?![A-Za-z0-9]))?"

_CUT = "\u0001"
_NEVER = "(?!)"

#: Occurrences over all sources that weigh as much as those of the source itself.
PRIOR = 20.0


def skeleton(value: Column, piece: str = CODE) -> Column:
    """The layout of a packed field: quoted and regular pieces become one letter each, ends are bare."""
    regular = F.regexp_replace(F.regexp_replace(value, QUOTED, "Q"), piece, "Q")
    return F.regexp_replace(regular, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")


def score_delimiters(
    df: DataFrame,
    source: list[str],
    value: str,
    candidates: list[Candidate] | None = None,
    piece: str = CODE,
) -> DataFrame:
    """Score every candidate separator of every source.

    Rows are reduced to layouts before the shuffle, so a source holding most rows costs its few
    layouts only. ``regular`` is the share of a candidate's occurrences that stand between two
    regular pieces, ``consistent`` the share of values using it whose piece count equals their count
    of regular pieces, both shrunk by PRIOR occurrences towards their value over all sources;
    ``score`` is their product, ``overall`` the same over all sources. Null values are ignored; an empty input gives no rows.
    """
    candidates = candidates or CANDIDATES
    layouts = (
        df.where(F.col(value).isNotNull())
        .select(*source, skeleton(F.col(value), piece).alias("__layout"))
        .groupBy(*source, "__layout")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    any_cut = "|".join(f"(?:{_on_layout(c.pattern)})" for c in candidates)
    stats = []
    for c in candidates:
        cut = _on_layout(c.pattern)
        stats.append(
            F.struct(
                F.lit(c.name).alias("candidate"),
                F.lit(c.pattern).alias("pattern"),
                F.regexp_count("__layout", F.lit(cut)).alias("hits"),
                F.regexp_count("__layout", F.lit(rf"(?<=Q\s{{0,3}}){cut}(?=\s*Q)")).alias("good"),
            )
        )
    per_layout = layouts.select(
        *source,
        "__n",
        F.regexp_count("__layout", F.lit("Q")).alias("__typed"),
        F.size(F.filter(F.split("__layout", any_cut), lambda p: F.trim(p) != "")).alias("__pieces"),
        F.explode(F.array(*stats)).alias("s"),
    ).where("s.hits > 0")
    counted = per_layout.groupBy(*source, F.col("s.candidate").alias("candidate"), F.col("s.pattern").alias("pattern")).agg(
        F.sum("__n").alias("n_values"),
        F.sum(F.col("__n") * F.col("s.good")).alias("__good"),
        F.sum(F.col("__n") * F.col("s.hits")).alias("__hits"),
        F.sum(F.when(F.col("__typed") == F.col("__pieces"), F.col("__n")).otherwise(0)).alias("__even"),
    )
    # a source with few occurrences leans on what the candidate does in all sources
    everywhere = W.partitionBy("candidate")
    shrunk = lambda a, n: (F.col(a) + PRIOR * F.sum(a).over(everywhere) / F.sum(n).over(everywhere)) / (F.col(n) + PRIOR)
    return (
        counted.withColumn("regular", shrunk("__good", "__hits"))
        .withColumn("consistent", shrunk("__even", "n_values"))
        .withColumn("score", F.col("regular") * F.col("consistent"))
        .withColumn("overall", F.sum("__good").over(everywhere) / F.sum("__hits").over(everywhere) * F.sum("__even").over(everywhere) / F.sum("n_values").over(everywhere))
        .drop("__good", "__hits", "__even")
    )


def _on_layout(pattern: str) -> str:
    """A candidate's pattern where values have become the letter Q."""
    return pattern.replace("(?<=[0-9)\\]INin])", "(?<=[0-9)\\]INinQ])").replace("(?=[A-Za-z][0-9?])", "(?=Q|[A-Za-z][0-9?])").replace(
        "(?<=[0-9A-Za-z])", "(?<=[0-9A-PR-Za-z])"
    )


#: Rows of sources and candidates whose delimiter sets may be broadcast; beyond it they are joined by the key.
MAX_BROADCAST_SOURCES = 50_000


def split_packed(
    df: DataFrame,
    source: list[str],
    value: str,
    threshold: float = 0.5,
    candidates: list[Candidate] | None = None,
    piece: str = CODE,
) -> DataFrame:
    """All columns of ``df`` plus ``pieces``, the array of the values packed in ``value``.

    The separators of each source (the columns ``source``) are those whose score reaches
    ``threshold``; one that does not occur in a source counts there as it does over all sources. A
    separator inside a quoted piece belongs to that piece. Enclosing quotes and list
    brackets are dropped, full-width forms become half-width, white space is removed, letters become
    upper case; empty pieces and marks that stand for nothing are left out. Null gives an empty
    array; a null source is a source of its own; a value without separators gives one piece.
    A column of the input named ``pieces`` is kept as ``in_pieces``.
    """
    spark = df.sparkSession
    df = df.withColumnsRenamed({"pieces": "in_pieces"} if "pieces" in {*df.columns} - {*source, value} else {})
    candidates = candidates or CANDIDATES
    scored = score_delimiters(df, source, value, candidates, piece)
    # a few rows per source; looked at once to learn whether they are small enough to broadcast
    rows = scored.select(*source, "pattern", "score", "overall").limit(MAX_BROADCAST_SOURCES + 1).collect()
    if len(rows) <= MAX_BROADCAST_SOURCES:
        usual = sorted({r["pattern"] for r in rows if r["overall"] >= threshold})
        seen: dict[tuple, dict[str, bool]] = {}
        for r in rows:
            seen.setdefault(tuple(r[: len(source)]), {})[r["pattern"]] = r["score"] >= threshold
        made = [(*key, "|".join(sorted({p for p, ok in use.items() if ok} | {p for p in usual if p not in use})) or _NEVER) for key, use in seen.items()]
        schema = T.StructType([*[scored.schema[c] for c in source], T.StructField("__cut", T.StringType())])
        chosen = F.broadcast(spark.createDataFrame(made, schema))
    else:
        usual = sorted(r[0] for r in scored.where(F.col("overall") >= threshold).select("pattern").distinct().collect())
        used, known = F.collect_set(F.when(F.col("score") >= threshold, F.col("pattern"))), F.collect_set("pattern")
        both = F.array_union(used, F.array_except(F.array(*[F.lit(p) for p in usual]).cast("array<string>"), known))
        chosen = scored.groupBy(*source).agg(F.when(F.size(both) > 0, F.array_join(F.array_sort(both), "|")).otherwise(_NEVER).alias("__cut"))
    keys = [f"__source{i}" for i in range(len(source))]
    chosen = chosen.select(*[F.col(s).alias(k) for s, k in zip(source, keys)], "__cut")
    on = [df[s].eqNullSafe(chosen[k]) for s, k in zip(source, keys)]
    joined = df.join(chosen, on, "left").drop(*keys)
    cut = F.coalesce("__cut", F.lit("|".join(usual) or _NEVER))
    return joined.withColumn("pieces", pieces(F.col(value), cut)).drop("__cut")


def pieces(value: Column, separators: Column) -> Column:
    """Split one value by the alternation ``separators``, quotes respected, and clean the pieces."""
    bare = F.regexp_replace(value, r"^\s*\[([\s\S]*)\]\s*$", "$1")
    # Separators are set between control characters, also inside quotes; quoted pieces are then
    # matched as wholes, and the control characters inside them vanish with the white space.
    cut = F.regexp_replace(bare, separators, F.lit(f"{_CUT}$0{_CUT}"))
    quoted = rf"[\s\[{_CUT}]*(?:\"[^\"]*\"|'[^']*'|“[^”]*”)[^{_CUT}]*"
    found = F.regexp_extract_all(cut, F.lit(rf"{quoted}|[^{_CUT}]+"), F.lit(0))
    cleaned = F.filter(F.transform(found, clean_piece), lambda p: ~p.rlike(r"^[;,、|.&+#]*$"))
    kept = F.filter(cleaned, lambda p: ~p.isin(NO_VALUE_MARKS))
    return F.when(is_no_value(value), F.array().cast("array<string>")).otherwise(kept)


def clean_piece(piece: Column) -> Column:
    """Half-width, upper case, without white space and without enclosing quotes."""
    flat = F.regexp_replace(piece, rf"(?U)[\s{_CUT} 　]+", "")
    return F.upper(half_width(F.regexp_replace(flat, r"^[\"'“”‘’]+|[\"'“”‘’]+$", "")))


def explode_pieces(df: DataFrame, keep: list[str], minimum: int = 1) -> DataFrame:
    """One row per piece of fields with at least ``minimum`` of them, position counted from 1."""
    return where_computed(df, F.size("pieces") >= minimum).select(*keep, F.posexplode("pieces").alias("__at", "ipc_value")).select(
        *keep, (F.col("__at") + 1).cast("int").alias("pos"), "ipc_value"
    )
