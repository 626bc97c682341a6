"""Evaluation texts leaking into training text: pigeonhole pieces, verified by Myers' bit-parallel distance."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .unify import LOOK_ALIKES

#: One edit is allowed for this many symbols.
PER_EDIT = 10
#: Shortest passage that counts: characters (Chinese items), words (others).
MIN_CHARS, MIN_WORDS = 40, 15
#: Symbols of test items searched for in one pass over the corpus; more items take more passes.
MAX_BLOCK_SYMBOLS = 2_000_000

_LOOK_ALIKE = re.compile("[" + "".join(LOOK_ALIKES) + "]")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_JUNK = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[\u3400-\u9fff]")


def fold(text: str) -> str:
    """Case, width, compatibility forms, look-alike letters and invisible characters made equal."""
    if text.isascii():
        return text.lower()
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    # before the case is lost: the look of a letter of another script depends on it
    return _LOOK_ALIKE.sub(lambda m: LOOK_ALIKES[m.group()], text).lower()


def chars_of(folded: str) -> str:
    """Letters, digits and Han characters only."""
    return _JUNK.sub("", folded)


def words_of(folded: str) -> list[str]:
    """Runs of letters and digits."""
    return _WORD.findall(folded)


class Lanes:
    """All windows of ``length`` symbols of one item, side by side in one integer.

    Each window has its own lane of Myers' bit vectors with a guard bit on top, so one pass over a
    text gives the edit distance of every window to the best substring ending at each symbol.
    """

    def __init__(self, symbols, length: int) -> None:
        n = len(symbols)
        self.length, self.lanes, self.width = length, n - length + 1, length + 1
        ones = self._progression(self.lanes)
        self.low = ones
        self.top = ones << (length - 1)
        self.full = ones * ((1 << length) - 1)
        masks: dict = {}
        steps = [0]
        for i in range(min(length, self.lanes)):
            steps.append(steps[-1] | 1 << (i * length))
        for p, s in enumerate(symbols):
            first, last = max(0, p - length + 1), min(p, self.lanes - 1)
            # window a holds symbol p at offset p - a, that is at bit a * width + p - a
            masks[s] = masks.get(s, 0) | (steps[last - first + 1] << (p + first * length))
        self.masks = masks
        self.bits = length.bit_length() + 1

    def _progression(self, count: int) -> int:
        return ((1 << (count * self.width)) - 1) // ((1 << self.width) - 1)

    def within(self, text, budget: int) -> bool:
        """Whether some window is within ``budget`` edits of some substring of ``text``."""
        full, top, low, shift = self.full, self.top, self.low, self.length - 1
        positive, negative = full, 0
        score = low * self.length
        alarm = low << self.bits
        lift = low * ((1 << self.bits) - 1 - budget)
        masks = self.masks
        for s in text:
            eq = masks.get(s, 0)
            xv = eq | negative
            xh = ((((eq & positive) + positive) ^ positive) | eq) & full
            ph = negative | (full & ~(xh | positive))
            mh = positive & xh
            score += ((ph & top) >> shift) - ((mh & top) >> shift)
            if (score + lift) & alarm != alarm:
                return True
            ph = (ph << 1) & full
            positive = ((mh << 1) & full) | (full & ~(xv | ph))
            negative = ph & xv
        return False


def window_lengths(n: int, least: int) -> list[int]:
    """Window lengths that decide for all passages of at least ``least`` symbols (or the whole item).

    A passage of L symbols may hold L // 10 edits; lengths with the same budget are decided by the
    shortest of them.
    """
    if n <= least:
        return [n] if n else []
    return sorted({least} | set(range(-(-least // PER_EDIT) * PER_EDIT, n + 1, PER_EDIT)))


@dataclass
class Item:
    """A test item: its symbols, the windows that decide, the pieces sought and the gram filter."""

    key: int
    symbols: object
    lengths: list[int]
    piece: int
    gram: int
    grams: list

    def need(self, n: int) -> int:
        """Grams a window of ``n`` symbols shares with its match: an edit destroys ``gram`` of them at most."""
        return max(1, n - self.gram + 1 - self.gram * (n // PER_EDIT))


def make_item(key: int, text: str, chinese: bool) -> Item | None:
    """Pieces and filters of one test item; None if it holds no symbol."""
    folded = fold(text or "")
    symbols = chars_of(folded) if chinese else tuple(words_of(folded))
    lengths = window_lengths(len(symbols), MIN_CHARS if chinese else MIN_WORDS)
    if not lengths:
        return None
    # pigeonhole: of budget + 1 pieces one is intact, so every passage holds an exact run this long
    piece = max(1, min(n // (n // PER_EDIT + 1) for n in lengths))
    gram = min(4 if chinese else 2, piece)
    grams = [symbols[i : i + gram] for i in range(len(symbols) - gram + 1)]
    return Item(key, symbols, lengths, piece, gram, grams)


class Searcher:
    """Finds the items of one block in documents."""

    def __init__(self, items: list[tuple[int, str, str]]) -> None:
        import ahocorasick

        self.items: list[Item] = []
        self.automata: dict[bool, object] = {}
        for chinese in (True, False):
            found = ahocorasick.Automaton()
            where: dict[str, list[tuple[int, int]]] = {}
            for key, lang, text in items:
                if (lang == "zh") != chinese:
                    continue
                item = make_item(key, text, chinese)
                if item is None:
                    continue
                self.items.append(item)
                at = len(self.items) - 1
                for i in range(len(item.symbols) - item.piece + 1):
                    part = item.symbols[i : i + item.piece]
                    where.setdefault(part if chinese else " " + " ".join(part) + " ", []).append((at, i))
            for piece, spots in where.items():
                found.add_word(piece, tuple(dict.fromkeys(a for a, _ in spots)))
            if where:
                found.make_automaton()
                self.automata[chinese] = found
        self.lanes: dict[tuple[int, int], Lanes] = {}

    def leaked(self, text: str | None) -> list[int]:
        """Keys of the items of which the text holds a passage."""
        if not text:
            return []
        folded = fold(text)
        out: list[int] = []
        if True in self.automata and _HAN.search(folded):
            symbols = chars_of(folded)
            hits: dict[int, list[int]] = {}
            for end, spots in self.automata[True].iter(symbols):
                for at in spots:
                    hits.setdefault(at, []).append(end)
            out += self._verified(symbols, hits)
        if False in self.automata:
            words = tuple(words_of(folded))
            flat = " " + " ".join(words) + " "
            hits = {}
            starts = None
            for end, spots in self.automata[False].iter(flat):
                if starts is None:
                    starts, at_char = [], 1
                    for w in words:
                        starts.append(at_char)
                        at_char += len(w) + 1
                for at in spots:
                    hits.setdefault(at, []).append(bisect_right(starts, end - 1) - 1)
            out += self._verified(words, hits)
        return out

    def _verified(self, symbols, hits: dict[int, list[int]]) -> list[int]:
        """Items whose gram matches and windows bear the hits out."""
        if not hits:
            return []
        reach = max(len(self.items[at].symbols) for at in hits) * (PER_EDIT + 1) // PER_EDIT + 1
        where: dict[int, dict] = {}
        spans: list[list[int]] = []
        for end in sorted({e for ends in hits.values() for e in ends}):
            if spans and end - reach <= spans[-1][1]:
                spans[-1][1] = end + reach
            else:
                spans.append([max(0, end - reach), end + reach])
        out = []
        for at in hits:
            item = self.items[at]
            g = item.gram
            if g not in where:
                # positions of the grams of the document around its hits, once for all items
                found: dict = {}
                for low, high in spans:
                    for j in range(low, min(high, len(symbols) - g + 1)):
                        found.setdefault(symbols[j : j + g], []).append(j)
                where[g] = found
            if self._holds(at, symbols, where[g]):
                out.append(item.key)
        return out

    def _holds(self, at: int, symbols, where: dict) -> bool:
        item = self.items[at]
        most = len(item.symbols) // PER_EDIT + 1
        # matching grams by diagonal; a passage drifts by its edits at most, so two bands hold it
        bands: dict[int, set[int]] = {}
        for p, gram in enumerate(item.grams):
            for j in where.get(gram, ()):
                band = (j - p) // most
                bands.setdefault(band, set()).add(j)
                bands.setdefault(band + 1, set()).add(j)
        for spots in bands.values():
            if len(spots) < item.need(item.lengths[0]):
                continue
            spots = sorted(spots)
            for n in item.lengths:
                need, budget = item.need(n), n // PER_EDIT
                width = n + budget
                dense = [i for i in range(len(spots) - need + 1) if spots[i + need - 1] - spots[i] <= width]
                if dense and self._lanes(at, n).within(symbols[max(0, spots[dense[0]] - width) : spots[dense[-1] + need - 1] + width + item.gram], budget):
                    return True
        return False

    def _lanes(self, at: int, n: int) -> Lanes:
        lanes = self.lanes.get((at, n))
        if lanes is None:
            lanes = Lanes(self.items[at].symbols, n)
            if n == self.items[at].lengths[0] and len(self.lanes) < 1024:
                self.lanes[at, n] = lanes
        return lanes


_SEARCHERS: dict[int, Searcher] = {}


def _searcher(block: tuple) -> Searcher:
    key = hash(block)
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(list(block))
    return _SEARCHERS[key]


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``item_id`` of every document that holds an item or a long passage of it.

    ``items`` has ``item_id``, ``lang`` and ``item_text`` and is the stated query set: it is split into
    blocks of a fixed number of symbols, each small enough to ship to every task, and the documents
    are scanned once per block, whole and without any shuffle. Null and empty texts hold nothing;
    empty items are found nowhere; repeated documents are reported each. No rows for an empty table.
    """
    spark = documents.sparkSession
    rows = [(int(r[0]), r[1] or "", r[2] or "") for r in items.select("item_id", "lang", "item_text").toLocalIterator()]
    blocks: list[list[tuple[int, str, str]]] = [[]]
    size = 0
    for row in sorted(rows):
        if size + len(row[2]) > MAX_BLOCK_SYMBOLS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
        size += len(row[2])
    slim = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    out = None
    for block in blocks:
        shipped = spark.sparkContext.broadcast(tuple(block))

        def scan(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            search = _searcher(shipped.value)
            for batch in batches:
                ids, found = [], []
                for doc, body in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                    for item in search.leaked(body):
                        ids.append(doc)
                        found.append(item)
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "item_id": pd.Series(found, dtype="int64")})

        part = slim.mapInPandas(scan, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionAll(part)
    return out
