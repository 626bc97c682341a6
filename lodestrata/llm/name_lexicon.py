"""What typed names are made of, learned from the names: legal forms, forms of lines of business, given names, everyday forms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.barrier import not_sent
from ..session import materialize
from .name_parts import Lexicon, bare_zh, damerau, is_han, latin_words
from .unify import transducer

#: A piece of a name is taken as learned from this many stems, or this share of the names if that is more.
SUPPORT, SHARE = 3, 1 / 20_000
#: Share of a piece's stems that must have one line of business for it to be a form of that line.
PURE = 0.8
#: A word of this share of the Latin names, beside so many different stems, is common; so at most a few thousand are.
COMMON, STEMS = 0.003, 4
#: Words are forms of each other if this share of the rarer one's stems has both, in different names.
SWAPPED = 0.3
#: Words that stand together in less than this share of the rarer one's names exclude each other.
TOGETHER = 0.05


def learn_lexicon(names: DataFrame, firms: DataFrame) -> Lexicon:
    """The lexicon of a column of names.

    ``names`` has ``name``; ``firms`` is a clean register with ``full_name`` (town, short name, line of
    business, legal form), ``short_name`` and ``industry``. Towns and lines of business come from the
    register. Legal forms are what follows a line of business, everyday forms of a line what stands in
    its place beside a stem known from complete names; of Latin names, common words are classed by what
    they stand beside and what takes their place. Nothing is listed beforehand; what a small table does
    not show is not learned. All counts are over all names; only pieces and words above a share of the
    names, whose number is bounded by that share, reach the driver. Null names and an empty table or
    register teach nothing.
    """
    town = F.expr("substring(full_name, 1, locate(short_name, full_name) - 1)")
    known = firms.where("locate(short_name, full_name) > 1 and industry is not null").select(town.alias("t"), "industry").distinct().collect()
    lex = Lexicon(sorted({r["t"] for r in known}), sorted({r["industry"] for r in known}))
    typed = materialize(_typed(names, lex))
    n = typed.count()
    least = max(SUPPORT, int(n * SHARE))
    lex = _learn_han(typed.where("han"), lex, least)
    return _learn_latin(typed.where("not han"), lex)


def _typed(names: DataFrame, lex: Lexicon) -> DataFrame:
    """Every name with a value, unified: ``han``, ``body``, of complete Han names the parts, of others the words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"].tolist():
                text = transducer()(name).lower() if name else ""
                if not any(c.isalnum() for c in text):
                    continue
                if is_han(text):
                    body, town = bare_zh(text, lex)
                    core = _complete(body, lex) if town else None
                    rows.append((True, body, *(core or (None, None, None)), []))
                else:
                    rows.append((False, text, None, None, None, latin_words(text)))
            yield pd.DataFrame(rows, columns=["han", "body", "stem", "line", "tail", "words"])

    return names.select("name").mapInPandas(run, "han boolean, body string, stem string, line string, tail string, words array<string>")


def _complete(body: str, lex: Lexicon) -> tuple[str, str, str] | None:
    """Stem, line of business and what follows it, of a name without its town; the longest line counts."""
    for line in sorted(lex.business, key=len, reverse=True):
        at = body.find(line, 2)
        if 2 <= at <= 8:
            return body[:at], line, body[at + len(line) :]
    return None


def _learn_han(typed: DataFrame, lex: Lexicon, least: int) -> Lexicon:
    complete = typed.where("stem is not null")
    total = complete.count()
    per_line = complete.groupBy("tail", "line").agg(F.count(F.lit(1)).alias("n"))
    tails = per_line.groupBy("tail").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("line", F.struct("n", "line")).alias("line")).where(F.col("n") >= max(least, total // 2000)).collect()
    legal = sorted((r["tail"] for r in tails if r["tail"] and r["top"] < PURE * r["n"]), key=lambda t: (-len(t), t))
    # what follows one line only, before a legal form, belongs to the line
    added = {r["line"] + _without_end(r["tail"], legal): r["line"] for r in tails if r["tail"] and r["top"] >= PURE * r["n"] and _without_end(r["tail"], legal)}
    sizes = complete.groupBy(F.length("stem").alias("size")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= total * 0.02).orderBy(F.desc("n"), "size").collect()
    stem_sizes = [r["size"] for r in sizes]
    lex = lex.with_learned(legal=legal, stem_sizes=stem_sizes, forms=added)
    if not stem_sizes:
        return lex
    # stems written more than once in full, with one line of business
    stems = complete.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.max("line").alias("__last")).where("n > 1 and line = __last").select("stem", "line")
    rest = typed.where("stem is null").select("body").distinct()
    windows = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("body") - size + 1)), lambda i: F.struct(i.alias("at"), F.substring("body", i, F.lit(size)).alias("stem")))
    cut = F.flatten(F.array(*[windows(size) for size in stem_sizes[:3]]))
    found = rest.select("body", F.explode(cut).alias("c")).select("body", "c.at", "c.stem").join(not_sent(stems), "stem")
    after = F.expr("substring(body, at + length(stem))")
    endings = F.array(*[F.lit(f) for f in legal]).cast("array<string>")
    ending = F.get(F.filter(endings, lambda f: F.endswith(after, f) & (F.length(after) > F.length(f))), F.lit(0))
    bare = F.left(after, F.length(after) - F.coalesce(F.length(ending), F.lit(0)))
    pieces = found.select("stem", "line", F.explode(F.array(F.struct(F.lit("after").alias("side"), after.alias("x")), F.struct(F.lit("bare").alias("side"), bare.alias("x")), F.struct(F.lit("before").alias("side"), F.expr("left(body, at - 1)").alias("x")))).alias("p")).select("stem", "line", "p.*").where("x <> ''").distinct()
    counted = pieces.groupBy("side", "x", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("side", "x").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("line", F.struct("n", "line")).alias("line"), F.count(F.lit(1)).alias("lines"))
    learned = counted.where(F.col("n") >= least).collect()
    forms = {r["x"]: r["line"] for r in learned if r["side"] == "bare" and len(r["x"]) > 1 and r["top"] >= PURE * r["n"] and r["x"] not in legal and r["x"] not in lex.business}
    # what stands before several lines in their forms may stand before any
    ahead = Counter(x[: -len(line)] for x, line in forms.items() if x.endswith(line))
    forms |= added | {x + line: line for x, n in ahead.items() if n >= SUPPORT for line in lex.business}
    more = [r["x"] for r in learned if r["side"] == "after" and r["lines"] >= STEMS and r["top"] < PURE * r["n"]]
    opening = [r["x"] for r in learned if r["side"] == "before" and r["lines"] >= STEMS and r["top"] < PURE * r["n"]]
    return lex.with_learned(legal=sorted({*legal, *more}, key=lambda t: (-len(t), t)), forms=forms, opening=sorted(opening, key=lambda t: (-len(t), t)))


def _without_end(text: str, endings: list[str]) -> str:
    """``text`` without the longest of the endings it ends in."""
    return text[: -len(next((e for e in endings if text.endswith(e)), "")) or None]


def _learn_latin(typed: DataFrame, lex: Lexicon) -> Lexicon:
    names = typed.select(F.monotonically_increasing_id().alias("i"), F.array_distinct("words").alias("words"))
    total = names.count()
    words = names.select("i", F.explode("words").alias("w"))
    counts = words.where(F.length("w") > 1).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    often = _common_words(names, words, counts, total)
    if not often:
        return lex
    # the stem of a name: of its other words the best supported one, then the longest
    flagged = words.where(F.length("w") > 2).join(F.broadcast(_listed(names, often)), "w", "left_anti").join(not_sent(counts), "w")
    stems = flagged.groupBy("i").agg(F.max_by("w", F.struct("df", F.length("w"), "w")).alias("stem"), F.max("df").alias("df"))
    kept = F.array(*[F.lit(w) for w in sorted(often)])
    slim = materialize(names.join(not_sent(stems), "i").select("stem", (F.col("df") > 1).alias("again"), F.array_sort(F.array_intersect("words", kept)).alias("c"), (F.size(F.filter(F.array_except("words", kept), lambda w: F.length(w) <= 2)) > 0).alias("initial")))
    spread = {r["w"]: (r["stems"], r["n"], r["initials"]) for r in slim.select("stem", "again", "initial", F.explode("c").alias("w")).groupBy("w").agg(F.count_distinct(F.when(F.col("again"), F.col("stem"))).alias("stems"), F.count(F.lit(1)).alias("n"), F.count_if("initial").alias("initials")).collect()}
    common = {w: s for w, s in spread.items() if s[0] >= STEMS}
    pair = lambda c: F.explode(F.flatten(F.transform(c, lambda a, k: F.transform(F.slice(c, k + 2, F.size(c)), lambda b: F.struct(a.alias("u"), b.alias("v"))))))
    together = {(r["u"], r["v"]): r["n"] for r in slim.select(pair(F.col("c")).alias("p")).groupBy("p.u", "p.v").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the common words of all names of a stem are at most all common words
    per_stem = slim.groupBy("stem").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("c"))
    shared = {(r["u"], r["v"]): r["n"] for r in per_stem.select(pair(F.col("c")).alias("p")).groupBy("p.u", "p.v").agg(F.count(F.lit(1)).alias("n")).collect()}
    return lex.with_learned(latin=class_words(common, together, shared))


def _listed(df: DataFrame, words: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(w,) for w in words], "w string")


def _common_words(names: DataFrame, words: DataFrame, counts: DataFrame, total: int) -> list[str]:
    """Words of a share COMMON of the names, and rarer ones that stand beside another uncommon word in most of their names.

    A stem stands beside common words; a rare form of a common word stands beside a stem, another one each
    time. Rare words of two letters are initials, and those within one edit of a common word typing errors.
    """
    frequent = [r["w"] for r in counts.where(F.col("df") >= max(STEMS + 1, total * COMMON)).select("w").collect()]
    rest = words.where(F.length("w") > 1).join(F.broadcast(_listed(names, frequent)), "w", "left_anti") if frequent else words.where(F.length("w") > 1)
    beside = rest.withColumnRenamed("w", "o").where(F.length("o") > 2)
    others = rest.join(not_sent(beside), "i").where("w <> o").groupBy("w").agg(F.count_distinct("o").alias("others"))
    least = max(STEMS, total // 50_000)
    rare = others.where((F.col("others") >= least) & (F.length("w") > 2)).join(not_sent(counts), "w").where(F.col("others") >= 0.5 * F.col("df"))
    found = {r["w"]: r["df"] for r in rare.select("w", "df").collect()}
    kept = list(frequent)
    for w in sorted(found, key=lambda w: (-found[w], w)):
        if len(w) < 5 or not any(abs(len(c) - len(w)) <= 1 and len(c) >= 5 and damerau(c, w, 1) <= 1 for c in kept):
            kept.append(w)
    return sorted(kept)


def class_words(common: dict[str, tuple[int, int, int]], together: dict[tuple[str, str], int], shared: dict[tuple[str, str], int]) -> dict[str, tuple[str, str]]:
    """Word -> (slot, class): slots ``line``, ``legal``, ``given`` and ``none``.

    ``common`` has the stems, names and names with an initial of every word; ``together`` the names with
    both of two words, ``shared`` the stems. Words that always stand together are one; words that take
    each other's place beside one stem are forms of one class, named by its most frequent word. Words
    that stand beside no other class are given names; the others fall into two slots none of which has
    two classes in one name; a word beside both is of none.
    """
    parent = {w: w for w in common}

    def find(w: str) -> str:
        while parent[w] != w:
            w = parent[w]
        return w

    both = lambda table, u, v: table.get((min(u, v), max(u, v)), 0)
    ordered = sorted(common)
    joins = []
    for i, u in enumerate(ordered):
        for v in ordered[i + 1 :]:
            fewest, most = sorted((common[u][1], common[v][1]))
            t, s = both(together, u, v), both(shared, u, v)
            stems = min(common[u][0], common[v][0])
            if t >= 0.8 * most:
                joins.append((2.0, u, v))
            elif t < TOGETHER * fewest and s >= SUPPORT and s >= SWAPPED * stems:
                joins.append((s / stems, u, v))
    # the clearest first; forms of words that stand together are no forms of each other
    held = {w: [w] for w in common}
    for share, u, v in sorted(joins, key=lambda j: (-j[0], -both(shared, j[1], j[2]), j[1:])):
        a, b = find(u), find(v)
        if a == b or (share < 2 and any(both(together, x, y) >= TOGETHER * min(common[x][1], common[y][1]) and both(together, x, y) > 1 for x in held[a] for y in held[b])):
            continue
        parent[b] = a
        held[a] += held.pop(b)
    members = defaultdict(list)
    for w in common:
        members[find(w)].append(w)
    name = {root: max(ws, key=lambda w: (common[w][1], w)) for root, ws in members.items()}
    near: dict[str, Counter] = defaultdict(Counter)
    size = {root: sum(common[w][1] for w in ws) for root, ws in members.items()}
    for (u, v), n in together.items():
        if u in parent and v in parent and find(u) != find(v):
            near[find(u)][find(v)] += n
            near[find(v)][find(u)] += n
    beside = {r: {o for o, n in near[r].items() if n >= max(2, TOGETHER / 2 * min(size[r], size[o]))} for r in members}
    slot: dict[str, str] = {}
    lone = [r for r in members if not beside[r]]
    for r in lone:
        initials = sum(common[w][2] for w in members[r])
        slot[r] = "given" if initials >= TOGETHER * size[r] else "none"
    # a class beside two classes that stand beside each other belongs to neither slot
    graph = {r: set(b) for r, b in beside.items() if b}
    while True:
        triangles = Counter(r for r, b in graph.items() for o in b for p in graph.get(o, ()) if p in b)
        if not triangles:
            break
        worst = max(triangles, key=lambda r: (triangles[r] / (1 + size[r]), r))
        slot[worst] = "none"
        graph = {r: b - {worst} for r, b in graph.items() if r != worst}
    colour: dict[str, int] = {}
    for start in sorted(graph, key=lambda r: (-size[r], r)):
        queue = [start] if start not in colour else []
        for r in queue:
            if r not in colour:
                colour[r] = 1 - next((colour[o] for o in graph[r] if o in colour), 1)
                queue += sorted(graph[r])
    counts = Counter(colour.values())
    line = max(counts, default=0, key=lambda c: (counts[c], -c))
    for r, c in colour.items():
        slot[r] = "line" if c == line else "legal"
    return {w: (slot.get(find(w), "none"), name[find(w)]) for w in common}

