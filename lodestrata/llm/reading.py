"""Reading level of each document: vocabulary coverage rank and sentence complexity, calibrated in SQL."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Tokens of a script whose ranks are sent to the tasks; the ranks of rarer ones are joined to the documents that need them.
VOCABULARY = 65_536
#: Shares of a document's tokens its smallest vocabulary must cover.
SHARES = (0.5, 0.8, 0.9)
FEATURES = [*(f"coverage_{int(s * 100)}" for s in SHARES), "sentence_tokens", "clause_tokens", "token_chars"]
#: Labelled documents of a level count this much of the pooled spread as their own.
SHRINK = 20.0

_ASCII = re.compile(r"[a-z]+(?:['-][a-z]+)*")
_LETTER = r"[^\W\d_\u3400-\u9fff]"
_WORD = re.compile(rf"{_LETTER}+(?:['’-]{_LETTER}+)*")
_FIRST_HAN, _LAST_HAN = 0x3400, 0x9FFF
_NO_HAN = np.zeros(0, dtype=np.uint32)
_SENTENCE = re.compile(r"[。!?;；｡]|\.(?=\s|$)|\n")
_CLAUSE = re.compile(r"[。!?;；｡,、:]|\.(?=\s|$)|\n")


def _folded(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def _tokens(folded: str) -> tuple[np.ndarray, list[str]]:
    """All tokens of a text: Han characters (as offsets) and words of any other script."""
    if folded.isascii():
        return _NO_HAN, _ASCII.findall(folded)
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    han = codes[(codes >= _FIRST_HAN) & (codes <= _LAST_HAN)] - _FIRST_HAN
    return han, _WORD.findall(folded)


def _script_of(word: str) -> str:
    """Latin words, accented ones included, are one script; all others another."""
    return "latin" if word[0] < "\u0250" or "\u1e00" <= word[0] <= "\u1eff" else "other"


def vocabulary_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``script`` (han, latin, other), ``token``, ``n`` over all tokens of all documents. Each task sends one row per distinct token."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        han = np.zeros(_LAST_HAN - _FIRST_HAN + 1, dtype=np.int64)

        def rows(counts) -> pd.DataFrame:
            return pd.DataFrame(counts, columns=["script", "token", "n"])

        for batch in batches:
            for body in batch["text"].tolist():
                if body:
                    chars, found = _tokens(_folded(body))
                    words.update(found)
                    if len(chars):
                        han += np.bincount(chars, minlength=len(han))
            if len(words) > 500_000:
                yield rows([(_script_of(t), t, n) for t, n in words.items()])
                words.clear()
        yield rows([(_script_of(t), t, n) for t, n in words.items()])
        yield rows([("han", chr(_FIRST_HAN + int(i)), int(han[i])) for i in np.flatnonzero(han)])

    slim = documents.select(documents[text].alias("text"))
    return slim.mapInPandas(count, "script string, token string, n bigint").groupBy("script", "token").agg(F.sum("n").alias("n"))


def vocabulary_ranks(counts: DataFrame) -> DataFrame:
    """``script``, ``token``, ``rank``, ``upto``: one more than the number of more frequent tokens of the script, and the number of those at least as frequent.

    Tokens of one count share a rank. The ranks are made of the numbers of tokens per count, which are
    few however large the vocabulary, so no task sorts a vocabulary.
    """
    per_count = counts.groupBy("script", "n").agg(F.count(F.lit(1)).alias("m"))
    above = W.partitionBy("script").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    classes = per_count.withColumn("upto", F.sum("m").over(above)).select("script", "n", (F.col("upto") - F.col("m") + 1).alias("rank"), "upto")
    return counts.join(classes, ["script", "n"]).select("script", "token", "rank", "upto")


def _places(n: int) -> list[int]:
    """Where in the sorted ranks of ``n`` tokens each share of SHARES is reached."""
    return [math.ceil(n * s) for s in SHARES]


def document_features(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``script`` and the features of every document, null where it has no token.

    ``coverage_S`` is the logarithm of the size of the smallest frequency-ranked vocabulary that
    covers S percent of the document's tokens, all of them: Han characters and words, each ranked in
    its script. ``sentence_tokens`` and ``clause_tokens`` are the logarithms of the mean length of
    sentences and clauses, ``token_chars`` the mean token length. ``script`` is that of most tokens.

    The VOCABULARY most frequent tokens of each script are sent to the tasks. Where a share of a
    document is only reached among rarer ones, their ranks are joined by token, so every rank is exact
    whatever the size of the vocabulary.
    """
    ranks = materialize(vocabulary_ranks(vocabulary_counts(documents, text)))
    shipped = documents.sparkSession.sparkContext.broadcast({script: dict(zip(*_top(ranks, script))) for script in ("han", "latin", "other")})
    columns = ["row", "doc_id", "script", *FEATURES, "n_ranked", "places", "rare"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = shipped.value
        known = {**top["latin"], **top["other"]}
        han_ranks = np.zeros(_LAST_HAN - _FIRST_HAN + 1, dtype=np.int64)
        for token, rank in top["han"].items():
            han_ranks[ord(token) - _FIRST_HAN] = rank
        for batch in batches:
            rows = []
            for row, doc, body in zip(batch["row"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist()):
                folded = _folded(body or "")
                chars, words = _tokens(folded)
                n = len(chars) + len(words)
                if not n:
                    rows.append((row, doc, None, *[None] * len(FEATURES), 0, [], []))
                    continue
                found = np.fromiter((known.get(t, 0) for t in words), dtype=np.int64, count=len(words))
                every = np.concatenate([han_ranks[chars], found])
                order = np.sort(every[every > 0])
                places = _places(n)
                cover = [math.log(order[p - 1]) if p <= len(order) else None for p in places]
                rare = []
                if places[-1] > len(order):
                    lost = Counter(t for t, r in zip(words, found) if not r)
                    rare = [(_script_of(t), t, k) for t, k in lost.items()]
                    rare += [("han", chr(_FIRST_HAN + int(c)), int(k)) for c, k in zip(*np.unique(chars[han_ranks[chars] == 0], return_counts=True))]
                latin = sum(1 for t in words if t[0] < "\u0250") if len(words) * 2 >= n else 0
                script = "han" if len(chars) > len(words) else "latin" if latin * 2 >= len(words) else "other"
                sentences = sum(1 for s in _SENTENCE.split(folded) if s.strip())
                clauses = sum(1 for s in _CLAUSE.split(folded) if s.strip())
                size = (len(chars) + sum(map(len, words))) / n
                rows.append((row, doc, script, *cover, math.log(n / max(1, sentences)), math.log(n / max(1, clauses)), size, len(order), places, rare))
            yield pd.DataFrame(rows, columns=columns)

    slim = documents.select(F.monotonically_increasing_id().alias("row"), documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    schema = "row bigint, doc_id bigint, script string, " + ", ".join(f"{f} double" for f in FEATURES) + ", n_ranked int, places array<int>, rare array<struct<script:string,token:string,k:int>>"
    measured = materialize(slim.mapInPandas(measure, schema))
    # rare tokens of the documents that need them, with their ranks, then the place of each share among them
    open_rows = measured.where(F.size("rare") > 0)
    ranked = open_rows.select("row", F.explode("rare").alias("t")).select("row", "t.script", "t.token", "t.k").join(ranks, ["script", "token"])
    tails = ranked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "k"))).alias("tail"))
    step = lambda a, t: F.struct((a["left"] - t["k"]).cast("int").alias("left"), F.when((a["left"] > 0) & (a["left"] <= t["k"]), t["rank"]).otherwise(a["rank"]).alias("rank"))
    at = lambda i: F.aggregate("tail", F.struct((F.get("places", F.lit(i)) - F.col("n_ranked")).cast("int").alias("left"), F.lit(None).cast("bigint").alias("rank")), step, lambda a: F.log(a["rank"]))
    filled = measured.join(tails, "row", "left")
    covers = {f: F.coalesce(F.col(f), at(i)).alias(f) for i, f in enumerate(FEATURES[: len(SHARES)])}
    return filled.select("doc_id", "script", *[covers.get(f, F.col(f)) for f in FEATURES])


def _top(ranks: DataFrame, script: str) -> tuple[list[str], list[int]]:
    """The tokens and ranks of a script's counts that lie wholly within the VOCABULARY most frequent; at most so many."""
    rows = ranks.where((F.col("script") == script) & (F.col("upto") <= VOCABULARY)).select("token", "rank").toArrow()
    return rows["token"].to_pylist(), rows["rank"].to_pylist()


def calibrate(features: DataFrame, labels: DataFrame) -> dict[str, Column]:
    """Per script, the level as a SQL expression over the features.

    One aggregation gives, per script and level, the number of ratings and the first and second
    moments of the features; the quadratic discriminants that follow (covariances shrunk towards the
    pooled one) are written as SQL arithmetic. Every rating counts; levels without ratings are never
    given. A script without ratings has no expression.
    """
    k = len(FEATURES)
    joined = features.join(labels.select(F.col("doc_id").alias("__d"), "reading_level"), F.col("doc_id") == F.col("__d")).where("script is not null and reading_level is not null")
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    crosses = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = joined.groupBy("script", "reading_level").agg(F.count(F.lit(1)).alias("n"), *sums, *crosses).collect()
    out = {}
    for script in sorted({r["script"] for r in moments}):
        rows = sorted((r for r in moments if r["script"] == script), key=lambda r: r["reading_level"])
        total = sum(r["n"] for r in rows)
        means, scatters = {}, {}
        for r in rows:
            mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
            second = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    second[i, j] = second[j, i] = r[f"c{i}_{j}"]
            means[r["reading_level"]] = mean
            scatters[r["reading_level"]] = second - r["n"] * np.outer(mean, mean)
        pooled = sum(scatters.values()) / total + 1e-3 * np.eye(k)
        scores = []
        for r in rows:
            level, n = r["reading_level"], r["n"]
            spread = (scatters[level] + SHRINK * pooled) / (n + SHRINK) + 1e-4 * np.eye(k)
            inverse = np.linalg.inv(spread)
            _, logdet = np.linalg.slogdet(spread)
            base = float(math.log(n / total) - 0.5 * logdet)
            d = [f"({f} - ({float(means[level][i])!r}D))" for i, f in enumerate(FEATURES)]
            terms = [f"({float(inverse[i, j] * (1 if i == j else 2))!r}D) * {d[i]} * {d[j]}" for i in range(k) for j in range(i, k)]
            scores.append(f"struct(({base!r}D) - 0.5D * ({' + '.join(terms)}) AS score, {level} AS level)")
        out[script] = F.expr(f"array_max(array({', '.join(scores)})).level")
    return out


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``script``, the features and ``reading_level`` (1 to 5) of every document.

    Null where the text is null, holds no letter, or is of a script without ratings. Documents repeated under one id give a row each; labels of unknown documents are ignored.
    """
    features = materialize(document_features(documents, doc_id, text))
    rules = calibrate(features, labels)
    level = F.lit(None).cast("int")
    for script, rule in rules.items():
        level = F.when(F.col("script") == script, rule).otherwise(level)
    return features.withColumn("reading_level", level)
