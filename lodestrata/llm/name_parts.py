"""Parts of typed names: town, stem, line of business; given name, surname."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace
from functools import cached_property

from .unify import transducer

def damerau(a: str, b: str, limit: int = 3) -> int:
    """Damerau-Levenshtein distance (adjacent swaps count one), a true metric; ``limit + 1`` if above it."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    last: dict[str, int] = {}
    top = len(a) + len(b)
    rows = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        rows[i + 1][1] = i
    for j in range(len(b) + 1):
        rows[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            i1, j1 = last.get(y, 0), seen
            if x == y:
                seen = j
            rows[i + 1][j + 1] = min(
                rows[i][j] + (x != y), rows[i + 1][j] + 1, rows[i][j + 1] + 1, rows[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1)
            )
        last[x] = i
    return min(rows[-1][-1], limit + 1)


@dataclass(frozen=True)
class Lexicon:
    """What names are made of: towns and lines of business of a register, and what is learned from the names."""

    towns: list[str]
    business: list[str]
    #: everyday forms of lines of business
    forms: dict[str, str] = field(default_factory=dict)
    #: what stands after the line of business, longest first, and before everything else
    legal: list[str] = field(default_factory=list)
    opening: list[str] = field(default_factory=list)
    #: lengths of stems, the most usual first
    stem_sizes: list[int] = field(default_factory=list)
    #: common Latin words with their slot (line, legal, given, none) and class
    latin: dict[str, tuple[str, str]] = field(default_factory=dict)

    def with_learned(self, **parts) -> Lexicon:
        return replace(self, **parts)

    @cached_property
    def all_forms(self) -> dict[str, str]:
        return {b: b for b in self.business} | self.forms

    @cached_property
    def by_length(self) -> list[str]:
        return sorted(self.all_forms, key=lambda f: (-len(f), f))

    @cached_property
    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """A town in brackets, and one at the start."""
        town = "|".join(sorted(map(re.escape, self.towns), key=len, reverse=True)) or "(?!)"
        return re.compile(rf"[(〔\[【]({town})市?[)〕\]】]"), re.compile(rf"^({town})市?")

    @cached_property
    def usual(self) -> int:
        """The most usual length of a stem; 0 where nothing is known."""
        return self.stem_sizes[0] if self.stem_sizes else 0

    @cached_property
    def long_words(self) -> list[str]:
        return [w for w in sorted(self.latin) if len(w) >= 5]

    def town_like(self, text: str) -> str | None:
        """The only town within one edit, if the text is not itself one."""
        if text.endswith("市") and len(text) > 2:
            text = text[:-1]
        near = [t for t in self.towns if damerau(text, t, 1) <= 1]
        return near[0] if len(near) == 1 else None

    def business_like(self, text: str) -> str | None:
        """The only line of business within one edit of one of its forms of three characters or more."""
        if text in self.all_forms:
            return self.all_forms[text]
        near = {self.all_forms[f] for f in self.by_length if len(f) >= 2 and len(text) >= 2 and (len(f) >= 3 or len(text) >= 3) and damerau(text, f, 1) <= 1}
        return near.pop() if len(near) == 1 else None

    def word(self, text: str) -> tuple[str, str] | None:
        """Slot and class of a common word, also one with a typing error in it."""
        found = self.latin.get(text)
        if found is None and len(text) >= 5:
            near = {self.latin[w] for w in self.long_words if abs(len(w) - len(text)) <= 1 and damerau(text, w, 1) <= 1}
            found = near.pop() if len(near) == 1 else None
        return found


_HAN = re.compile("[㐀-鿿]")
_SHARE = re.compile(r"(?<=[㐀-鿿])[a-z]$")
_MARKS = re.compile(r"[()〔〕\[\]【】·.,，、:*-]+")


def is_han(text: str) -> bool:
    return bool(_HAN.search(text))


def bare_zh(text: str, lex: Lexicon) -> tuple[str, str]:
    """A Han name without blanks, marks and town, and the town; what follows a colon goes first."""
    text = _SHARE.sub("", re.sub(r"\s+", "", text))
    bracketed, leading = lex.patterns
    town = ""
    found = bracketed.search(text)
    if found:
        town = found.group(1)
        text = text[: found.start()] + text[found.end() :]
    head, colon, tail = text.partition(":")
    if colon and tail:
        text = tail + head if len(tail) > len(head) else head + tail
    text = _MARKS.sub("", text)
    if not town:
        found = leading.match(text)
        if found and len(text) > found.end():
            town, text = found.group(1), text[found.end() :]
    return text, town


def _cut_legal(text: str, lex: Lexicon) -> str:
    """Drop what names end in behind the line of business, also the longer forms with a typing error."""
    whole = text
    while True:
        form = next((f for f in lex.legal if text.endswith(f) and len(text) > len(f) + 1), None)
        if form is None:
            break
        text = text[: -len(form)]
    if text == whole:
        for form in [f for f in lex.legal if len(f) >= 4]:
            for size in (len(form), len(form) - 1, len(form) + 1):
                if len(text) > size + 3 and damerau(text[-size:], form, 1) <= 1:
                    return text[:-size]
    return text


def parse_name(name: str | None, lex: Lexicon) -> tuple[str, str, str, str] | None:
    """``(kind, stem, a, b)``; unknown parts are empty strings.

    zh: a is the town, b the line of business. latin: a is the line of business, b the legal form.
    person: stem is the surname, a the given name (or its initial), b the middle initial. None for no value.
    """
    if name is None:
        return None
    text = transducer()(name).lower()
    if not any(c.isalnum() for c in text):
        return None
    return _parse_zh(text, lex) if is_han(text) else _parse_latin(text, lex)


def _parse_zh(text: str, lex: Lexicon) -> tuple[str, str, str, str]:
    text, town = bare_zh(text, lex)
    while True:
        opening = next((o for o in lex.opening if text.startswith(o) and len(text) - len(o) >= 2), None)
        if opening is None:
            break
        text = text[len(opening) :]
    if not town:
        found = lex.patterns[1].match(text)
        if found and len(text) - found.end() >= 2:
            town, text = found.group(1), text[found.end() :]
    # line of business and legal form before the stem
    for form in lex.by_length:
        if text.startswith(form):
            rest = text[len(form) :]
            for legal in lex.legal:
                if rest.startswith(legal) and len(rest) - len(legal) in lex.stem_sizes:
                    return "zh", rest[len(legal) :], town, lex.all_forms[form]
    text = _cut_legal(text, lex)
    options = [f for f in lex.by_length if text.endswith(f) and len(text) - len(f) >= 2]
    if options:
        # a line of the register stands before a form that leaves a stem of the usual length, such as a damaged line
        whole = options[0] in lex.business and len(text) - len(options[0]) >= lex.usual - 1
        form = options[0] if whole else next((f for f in options if len(text) - len(f) == lex.usual), options[0])
        stem, business = text[: -len(form)], lex.all_forms[form]
    else:
        stem, business = text, ""
        for size in lex.stem_sizes if town else [*lex.stem_sizes, *(n + 2 for n in lex.stem_sizes), *(n + 3 for n in lex.stem_sizes)]:
            like = lex.business_like(text[size:]) if len(text) - size >= 2 else None
            if like:
                stem, business = text[:size], like
                break
    if not town and lex.usual and len(stem) > lex.usual:
        head, tail = stem[: -lex.usual], stem[-lex.usual :]
        guess = lex.town_like(head)
        if guess:
            town, stem = guess, tail
        elif business and any(damerau(head, t, 1) <= 1 for t in lex.towns):
            stem = tail  # a damaged town that could be several
    return "zh", stem, town, business


def _plain(text: str) -> str:
    """Without accents, which are often left out when typing."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def latin_words(text: str) -> list[str]:
    """Words of a name; letters that stand alone one after the other are one word (g. m. b. h., a. k.)."""
    words = [w for w in re.split(r"[\s,;&+/()\"]+", re.sub(r"(?<=\b\w)\.(?=\w\b)", ". ", text)) if w]
    out, run = [], ""
    for w in words:
        w = w.replace(".", "").strip("-'\"*")
        if len(w) == 1:
            run += w
            continue
        if run:
            out.append(run)
            run = ""
        if w:
            out.append(w)
    return [*out, run] if run else out


def _parse_latin(text: str, lex: Lexicon) -> tuple[str, str, str, str]:
    words = latin_words(text)
    slots: dict[str, set[str]] = {"line": set(), "legal": set(), "given": set()}
    rest, small = [], ""
    for w in words:
        found = lex.word(w)
        if found and found[0] in slots:
            slots[found[0]].add(found[1])
        elif found is None and len(w) <= 2:
            small += w
        elif found is None:
            rest.append(w)
    if len(rest) == 1 and not slots["line"] and not slots["legal"] and len(small) <= 2 and (len(slots["given"]) == 1 or (small and not slots["given"])):
        given = min(slots["given"], default="")
        return ("person", _plain(rest[0]), _plain(given), small[:1]) if given and len(small) <= 1 else ("person", _plain(rest[0]), small[:1] if not given else _plain(given), small[1:2])
    long = [w for w in rest if len(w) >= 6]
    stem = long if len(long) == 1 else rest
    if not stem:
        stem, slots = words, {"line": set(), "legal": set()}
    return "latin", _plain(" ".join(sorted(stem))), " ".join(sorted(slots["line"])), " ".join(sorted(slots["legal"]))
