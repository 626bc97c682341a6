"""N-grams of dated texts in blocks of dates: what is exchanged are the grams of a block, never those of a document."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a block, and of all texts per slice of the grams.
BLOCK, SLICE = 1_500_000, 5_000_000
#: Characters of a round at least.
ROUND = 30_000_000
#: In the place of a group: all grams of earlier rounds.
EARLIER = -1


def blocks_of(per_day: DataFrame, block: int = BLOCK) -> DataFrame:
    """``per_day`` (``date``, ``chars``) with ``grp``, which rises with the date, and ``parts``.

    Successive dates share a group up to about ``block`` characters; a date of more has one to itself,
    in several parts. Both are thus bounded however the texts are spread over the dates.
    """
    before = F.coalesce(F.sum("chars").over(W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heavy = F.col("chars") > block
    parts = F.when(heavy, F.ceil(F.col("chars") / block)).otherwise(1).cast("int")
    return per_day.withColumn("grp", F.floor(before / block).cast("bigint") * 2 + heavy.cast("int")).withColumn("parts", parts)


def cuts_of(chars: int, block: int, rounds: int, least: int) -> list[int]:
    """The groups at which a new round begins, for texts of ``chars`` characters, at most ``rounds`` of at least ``least``."""
    rounds = max(1, min(rounds, chars // least))
    return [2 * -(-chars * r // (rounds * block)) for r in range(1, rounds)]


def part_of(app: Column, parts: Column) -> Column:
    """The part of its group a document belongs to."""
    return F.pmod(F.xxhash64(app), parts).cast("int")


class Block:
    """The distinct grams of some texts and how often every text has each.

    ``gram``, ``doc`` and ``tf`` are entries in order of gram and document. Grams are numbered as they
    appear, so the same texts in the same order give the same numbers.
    """

    def __init__(self, texts: list[str], low: int, high: int, buckets: int | None, slices: int):
        self.text = "".join(texts)
        chars = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
        letter, known = pd.factorize(chars)
        ids, at = letter.astype(np.int64), np.arange(len(chars))
        spread = chars.astype(np.uint64)
        self.first, self.size, slot, entries, total = [], [], [], [], 0
        for n in range(1, high + 1):
            if n > 1:
                # an n-gram is an (n-1)-gram and a further character
                keep = left[at] >= n
                at, ids = at[keep], ids[keep]
                ids = pd.factorize(ids * len(known) + letter[at + n - 1])[0].astype(np.int64)
                spread = spread[keep] * np.uint64(0x9E3779B97F4A7C15) + chars[at + n - 1]
            if n < low or not len(at):
                continue
            count = int(ids.max()) + 1
            first = np.empty(count, np.int64)
            first[ids[::-1]] = np.arange(len(ids))[::-1]
            entries.append(((ids + total).astype(np.int32), doc[at]))
            self.first.append(at[first])
            self.size.append(np.full(count, n, np.int8))
            slot.append(((spread[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(slices))
            total += count
        none = np.empty(0, np.int64)
        self.first, self.size = np.concatenate([none, *self.first]), np.concatenate([none.astype(np.int8), *self.size])
        slot = np.concatenate([none, *slot]).astype(np.int64)
        gram = np.concatenate([none.astype(np.int32), *[e[0] for e in entries]])
        docs = np.concatenate([none.astype(np.int32), *[e[1] for e in entries]])
        self.names = None
        if buckets:
            hashed = np.fromiter((int(hashlib.md5(g.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % buckets for g in self.strings(np.arange(total))), np.int64, total)
            number, self.names = pd.factorize(hashed)
            gram, total = number.astype(np.int32)[gram], len(self.names)
            slot = self.names % slices
        # texts follow each other, so within a gram and length documents are in order; buckets mix lengths
        order = np.lexsort((docs, gram)) if buckets else np.argsort(gram, kind="stable")
        gram, docs = gram[order], docs[order]
        start = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (docs[1:] != docs[:-1])]) if len(gram) else none
        self.gram, self.doc, self.tf = gram[start], docs[start], np.diff(np.r_[start, len(gram)])
        self.start = np.searchsorted(self.gram, np.arange(total))
        self.total, self.slots = total, [np.flatnonzero(slot == k) for k in range(slices)]

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[i : i + n] for i, n in zip(self.first[which].tolist(), self.size[which].tolist())]

    def packed(self, which: np.ndarray) -> bytes:
        """The grams as bytes: the lengths, then the characters; of buckets their numbers."""
        if self.names is not None:
            return packed(self.names[which], True)
        return packed(self.strings(which), False)


def packed(grams, hashed: bool) -> bytes:
    """Grams, or numbers of buckets, as ``unpacked`` reads them."""
    if hashed:
        return np.asarray(grams).astype("<i4").tobytes()
    return np.fromiter(map(len, grams), np.int8, len(grams)).tobytes() + "".join(grams).encode("utf-8", "surrogatepass")


def unpacked(body: bytes, n: int, hashed: bool) -> list:
    """The ``n`` grams of ``packed``."""
    if hashed:
        return np.frombuffer(body, "<i4").tolist()
    sizes, text = np.frombuffer(body[:n], np.int8), body[n:].decode("utf-8", "surrogatepass")
    ends = np.cumsum(sizes, dtype=np.int64)
    return [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


class Weights:
    """Unit-length tf-idf weights of a block's entries, with the document frequencies of strictly earlier dates."""

    def __init__(self, block: Block, dates: np.ndarray, history: np.ndarray, before: np.ndarray):
        self.block = b = block
        self.day = np.cumsum(np.r_[0, dates[1:] != dates[:-1]])[b.doc]
        fresh = np.r_[True, (b.gram[1:] != b.gram[:-1]) | (self.day[1:] != self.day[:-1])]
        #: Entries that begin a gram's date, and the number of that date of each entry.
        self.begin, self.run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        self.df = before[b.gram] + (self.begin[self.run] - b.start[b.gram])
        w = b.tf * (np.log((history[b.doc] + 1) / (self.df + 1)) + 1)
        norm = np.sqrt(np.bincount(b.doc, w * w, len(dates)))
        self.u = w / norm[b.doc]

    def sums(self) -> np.ndarray:
        """Per gram."""
        return np.add.reduceat(self.u, self.block.start)

    def scores(self, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: product with the sum of earlier texts, share of unseen grams, growth of the squared norm within the block."""
        b = self.block
        d = np.add.reduceat(self.u, self.begin)
        gram, upto = b.gram[self.begin], np.cumsum(d) - d
        s = before[gram] + upto - upto[self.run[b.start]][gram]
        product = np.bincount(b.doc, self.u * s[self.run], n)
        unseen = np.bincount(b.doc, np.where(self.df == 0, b.tf, 0), n) / np.maximum(np.bincount(b.doc, b.tf, n), 1)
        growth = np.bincount(self.day[self.begin], 2 * s * d + d * d, int(self.day.max()) + 1)
        within = np.zeros(n)
        within[b.doc] = (np.cumsum(growth) - growth)[self.day]
        return product, unseen, within


def centroid_scores(docs: DataFrame, low: int, high: int, buckets: int | None, slices: int, cuts: list[int] = ()) -> DataFrame:
    """``app``, ``num``, ``unseen``, ``norm2`` of every document with an n-gram.

    ``docs`` has ``app``, ``date``, ``text``, ``history`` (documents of strictly earlier dates), ``grp``
    and ``part`` (``blocks_of``). A block counts its grams; per slice of the grams the counts of earlier
    groups are added up; with them a block weighs its texts and sums the weights; these are added up in
    the same way, and with them a block scores its texts. N-grams are made anew from the texts each time
    and are never written. The groups are taken in rounds that begin at ``cuts``; a round starts from the
    totals of the grams of those before, so that only what one round has counted and added up is on disk.
    """
    from ..session import discard, materialize

    key, hashed = ["grp", "part"], bool(buckets)

    def block(rows: pd.DataFrame) -> tuple[pd.DataFrame, Block]:
        rows = rows.sort_values(["date", "app"], ignore_index=True)
        return rows, Block(rows["text"].tolist(), low, high, buckets, slices)

    def column(state: pd.DataFrame, b: Block, name: str, kind: str) -> np.ndarray:
        out = np.zeros(b.total, kind)
        for k, body in zip(state["slice"].tolist(), state[name].tolist()):
            if body is not None:
                out[b.slots[k]] = np.frombuffer(body, kind)
        return out

    def weighed(rows: pd.DataFrame, state: pd.DataFrame) -> tuple[pd.DataFrame, Block, Weights | None]:
        rows, b = block(rows)
        w = Weights(b, rows["date"].to_numpy(), rows["history"].to_numpy(), column(state, b, "df", "<i8")) if b.total else None
        return rows, b, w

    def count(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b = block(rows)[1]
        n = np.diff(np.r_[b.start, len(b.gram)]).astype("<i4")
        return pd.DataFrame([(*k, i, len(at), b.packed(at), n[at].tobytes()) for i, at in enumerate(b.slots) if len(at)], columns=[*key, "slice", "n", "grams", "counts"])

    def adders(last: bool) -> tuple[Callable, Callable]:
        """Those of a round; the last keeps no totals for another."""

        def add_counts(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(key, ignore_index=True)
            grams = [unpacked(g, n, hashed) for g, n in zip(rows["grams"].tolist(), rows["n"].tolist())]
            ids, known = pd.factorize(np.array([x for g in grams for x in g], object if not hashed else np.int64))
            del grams
            ids = np.split(ids.astype("<i4"), np.cumsum(rows["n"].to_numpy())[:-1])
            counts = [np.frombuffer(c, "<i8" if g == EARLIER else "<i4") for g, c in zip(rows["grp"].tolist(), rows["counts"].tolist())]
            before, _, total = _added(rows["grp"].tolist(), ids, counts, "<i8")
            out = rows[[*key, "slice"]].assign(ids=[i.tobytes() for i in ids], df=[x.tobytes() for x in before], n=0, grams=None, counts=None)
            if last:
                return out[out["grp"] != EARLIER]
            # numbered in order: those of earlier rounds come first and keep their places
            kept = pd.DataFrame([(EARLIER, 0, rows["slice"][0], None, None, len(known), packed(known, hashed), total.tobytes())], columns=out.columns)
            return pd.concat([out[out["grp"] != EARLIER].astype({"grams": object, "counts": object}), kept], ignore_index=True)

        def add_sums(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(key, ignore_index=True)
            sums = [np.frombuffer(x, "<f8") for x in rows["sums"]]
            ids = [np.frombuffer(i, "<i4") if i is not None else np.arange(len(x)) for i, x in zip(rows["ids"].tolist(), sums)]
            before, growth, total = _added(rows["grp"].tolist(), ids, sums, "<f8")
            out = rows[[*key, "slice"]].assign(s=[x.tobytes() for x in before], growth=growth)
            if last:
                return out[out["grp"] != EARLIER]
            kept = pd.DataFrame([(EARLIER, 0, rows["slice"][0], total.tobytes(), 0.0)], columns=out.columns)
            return pd.concat([out[out["grp"] != EARLIER], kept], ignore_index=True)

        return add_counts, add_sums

    def weigh(k: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        _, b, w = weighed(rows, state)
        sums = w.sums() if w else None
        out = [(*k, i, ids, sums[b.slots[i]].astype("<f8").tobytes()) for i, ids in zip(state["slice"].tolist(), state["ids"].tolist())]
        return pd.DataFrame(out, columns=[*key, "slice", "ids", "sums"])

    def score(k: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows, b, w = weighed(rows, state)
        if w is None:
            return pd.DataFrame([], columns=["app", "grp", "num", "unseen", "within", "growth"])
        num, unseen, within = w.scores(column(state, b, "s", "<f8"), len(rows))
        out = pd.DataFrame({"app": rows["app"], "grp": k[0], "num": num, "unseen": unseen, "within": within, "growth": 0.0})
        out = out[np.bincount(b.doc, minlength=len(rows)) > 0].reset_index(drop=True)
        out.loc[0, "growth"] = state.sort_values("slice")["growth"].sum()
        return out

    app = docs.schema["app"].dataType.simpleString()
    scored, earlier, added, bounds = None, None, None, [None, *cuts, None]
    for first, end in zip(bounds, bounds[1:]):
        own, (add_counts, add_sums) = docs, adders(last=end is None)
        if first is not None:
            own = own.where(F.col("grp") >= first)
        if end is not None:
            own = own.where(F.col("grp") < end)
        counts = own.select(*key, "app", "date", "text").groupBy(*key).applyInPandas(count, "grp bigint, part int, slice int, n int, grams binary, counts binary")
        if earlier is not None:
            counts = counts.unionByName(earlier.where(F.col("grp") == EARLIER).select(counts.columns))
        was, earlier = earlier, materialize(counts.groupBy("slice").applyInPandas(add_counts, "grp bigint, part int, slice int, ids binary, df binary, n int, grams binary, counts binary"), remove_exchanged=True)
        discard(was)
        counted = earlier.where(F.col("grp") != EARLIER).select(*key, "slice", "ids", "df")
        sums = own.groupBy(*key).cogroup(counted.groupBy(*key)).applyInPandas(weigh, "grp bigint, part int, slice int, ids binary, sums binary")
        if added is not None:
            sums = sums.unionByName(added.where(F.col("grp") == EARLIER).select(*key, "slice", F.lit(None).cast("binary").alias("ids"), F.col("s").alias("sums")))
        was, added = added, materialize(sums.groupBy("slice").applyInPandas(add_sums, "grp bigint, part int, slice int, s binary, growth double"), remove_exchanged=True)
        discard(was)
        state = counted.drop("ids").unionByName(added.where(F.col("grp") != EARLIER), allowMissingColumns=True)
        scores = own.groupBy(*key).cogroup(state.groupBy(*key)).applyInPandas(score, f"app {app}, grp bigint, num double, unseen double, within double, growth double")
        scores = materialize(scores, remove_exchanged=True)
        scored = scored.unionByName(scores) if scored is not None else scores
    discard(earlier)
    discard(added)
    groups = scored.groupBy("grp").agg(F.sum("growth").alias("growth"))
    base = groups.select("grp", F.coalesce(F.sum("growth").over(W.partitionBy(F.lit(1)).orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    return scored.join(materialize(base, remove_exchanged=True), "grp").select("app", "num", "unseen", (F.col("base") + F.col("within")).alias("norm2"))


def _added(groups: list[int], ids: list[np.ndarray], values: list[np.ndarray], kind: str) -> tuple[list[np.ndarray], list[float], np.ndarray]:
    """For rows in order of group: the sums of earlier groups, how much the group adds to the squared norm (at its first row), and the sums of all."""
    total = np.zeros(max((int(i.max()) + 1 for i in ids if len(i)), default=0), kind)
    before, growth, at = [], [], 0
    while at < len(groups):
        end = at
        while end < len(groups) and groups[end] == groups[at]:
            before.append(total[ids[end]])
            end += 1
        touched = ids[at] if end == at + 1 else np.unique(np.concatenate(ids[at:end]))
        old = total[touched]
        for i, v in zip(ids[at:end], values[at:end]):
            total[i] += v
        more = total[touched] - old
        growth += [float(np.sum(2.0 * old * more + more * more)), *[0.0] * (end - at - 1)]
        at = end
    return before, growth, total
