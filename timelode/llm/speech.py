"""Text of recognised speech: speaker labels, times, sound annotations, fillers. A small per-row helper."""

from __future__ import annotations

import re
from functools import lru_cache

# Hesitations, and words that count as hesitations only where punctuation sets them off.
FILLERS = (
    "uh", "uhm", "um", "umm", "er", "erm", "hm", "hmm", "mm", "mmm", "mhm",
    "eh", "ehm", "äh", "ähm", "öh", "euh", "hein", "hum", "bah", "ehh",
)
SET_OFF_FILLERS = (
    "like", "you know", "i mean", "sort of", "kind of",
    "cioè", "diciamo", "insomma", "tipo",
    "also", "halt", "sozusagen",
    "du coup", "genre", "ben",
    "o sea", "pues", "este", "bueno",
)
ROLES = "host|guest|instructor|moderator|panelist|student|speaker|presenter|teacher"
TITLES = ("dr", "prof", "mr", "mrs", "ms", "sig", "sra", "sr", "frau", "herr", "mme", "m")

_WORD = r"[^\W\d_][\w'’-]*"
_LABEL = re.compile(
    rf"""
    <v\s+(?P<voice>[^<>]{{2,80}})>
  | \[(?P<box>\s*{_WORD}(?:[ ,.]+{_WORD}){{0,3}}\s*)\](?!\w)
  | \bSPEAKER\s+(?P<key>\w+)\s*\|
  | (?:>>\s*|[—–]\s+)?@(?P<handle>[\w.-]+)\s*:(?=\s|$)
  | (?P<mark>>>\s*|[—–]\s+)?(?<![\w'’-])(?P<name>(?:{_WORD}\.?,?\s+)?[^\W_][\w'’-]*)(?:\s+\((?:{ROLES})\))?\s*:(?=\s|$)
  | (?<![\w'’-])(?P<dash>{_WORD})\s+[-–—]\s
    """,
    re.X | re.I,
)
#: No label does without one of these; most segments have none.
_MARK = re.compile(r"[:\]>|]|\s[-–—]\s")
_STAMP = re.compile(r"^\s*[\[(]?\d{1,4}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])]?\s*(?:-+>\s*)?")
_NOTE = re.compile(
    r"(?<!\w)\[[^\[\]\d]{1,60}\]|(?<!\w)<[^<>\d]{1,60}>|(?<!\w)\*[^*\d]{1,60}\*|♪[^♪\d]{0,60}♪?|(?<!\w)\([^\W\d_]{1,40}(?:[ '’-][^\W\d_]{1,40}){0,3}\)"
)
_BRACKET = re.compile(r"[\[<*♪(]")
_SURE = re.compile(rf"(?<!\w)(?:{'|'.join(FILLERS)})(?!\w)(?:\s*(?:\.\.\.|…|,))?", re.I)
_MAYBE = "|".join(w.replace(" ", r"\s+") for w in SET_OFF_FILLERS)
_AFTER = re.compile(rf",\s*(?:{_MAYBE})(?!\w)\s*(?:,|(?=[.?!…]|$))", re.I)
_BEFORE = re.compile(rf"(?<!\w)(?:{_MAYBE})\s*(?:\.\.\.|…)|^\s*(?:{_MAYBE})\s*,", re.I)
_ANY = re.compile(rf"(?<!\w)(?:{'|'.join(FILLERS)}|{_MAYBE})(?!\w)", re.I)
_TWICE = re.compile(r"(?<!\w)([^\W\d_][\w'’]*)(?:\s+\1)+(?!\w)", re.I)
_SPOKEN = re.compile(r"\w")


def clean(text: str) -> str:
    """Speech without stamps, sound annotations, fillers and stutters, in single spaces."""
    text = _STAMP.sub(" ", text, count=1)
    if _BRACKET.search(text):
        text = _NOTE.sub(" ", text)
    text = _SURE.sub(" ", text)
    text = _BEFORE.sub(" ", _AFTER.sub(" ", text))
    text = _TWICE.sub(r"\1", re.sub(r"\s+", " ", text))
    text = re.sub(r"\s+([,.;:?!])", r"\1", text)
    text = re.sub(r",(?:\s*,)+", ",", text)
    text = re.sub(r"^[\s,.;:–—>-]+|\s+$", "", text)
    return text if _SPOKEN.search(_ANY.sub(" ", text)) else ""


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, neighbours swapped counting as one; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


class Speakers:
    """Looks up who a label can mean: candidates with the number of edits each needs."""

    def __init__(self, rows: list[tuple[str, str, str, str]]):
        """rows: speaker_id, given_name, family_name, handle."""
        self.people = [(i, g.lower(), f.lower()) for i, g, f, _ in rows]
        self.keys = {i.lower(): i for i, *_ in rows}
        self.handles = {h.lower(): i for i, _, _, h in rows if h}
        self.words: dict[str, list[str]] = {}
        for i, g, f in self.people:
            for w in {g, f}:
                self.words.setdefault(w, []).append(i)
        # Names by what is left when a character is taken out: two names one slip apart have an entry in common.
        self.shorter: dict[str, set[str]] = {}
        for w in self.words:
            for x in self._short(w):
                self.shorter.setdefault(x, set()).add(w)
        self.initials: dict[str, list[tuple[str, str, str]]] = {}
        for p in self.people:
            for c in {p[1][:1], p[2][:1]}:
                self.initials.setdefault(c, []).append(p)
        self.given = {i: g for i, g, _ in self.people}
        self.named = lru_cache(200_000)(self._named)

    @staticmethod
    def _short(word: str) -> set[str]:
        return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}

    def near(self, word: str) -> set[str]:
        """The names at most one slip away."""
        found = set().union(*(self.shorter.get(x, ()) for x in self._short(word)))
        return {w for w in found if distance(word, w, 1) <= 1}

    def one(self, word: str) -> list[tuple[str, int]]:
        """A single name, in which one slip is allowed."""
        if word in self.keys:
            return [(self.keys[word], 0)]
        if word in self.words:
            return [(i, 0) for i in self.words[word]]
        if len(word) < 6:
            return []
        return [(i, 1) for i in sorted({i for w in self.near(word) for i in self.words[w]})]

    def two(self, first: str, second: str) -> list[tuple[str, int]]:
        """Given and family name in either order, one of which may be misspelt beyond recognition of its own."""
        if first in TITLES:
            return self.one(second)
        if len(first) == 1:
            return [(i, d) for i, d in self.one(second) if self.given[i][:1] == first]
        found = []
        for i, g, f in {*self.initials.get(first[:1], ()), *self.initials.get(second[:1], ())}:
            for a, b in ((g, f), (f, g)):
                if (first[:1] != a[:1] and second[:1] != b[:1]) or abs(len(first) - len(a)) > 4 or abs(len(second) - len(b)) > 5:
                    continue
                d = distance(first, a, 4)
                d += distance(second, b, 5 - d) if d <= 4 else 9
                if d <= 5 and 2 * d <= len(first) + len(second) - 6:
                    found.append((i, d))
        least = min((d for _, d in found), default=0)
        return sorted({(i, d) for i, d in found if d <= least + 1})

    def _named(self, phrase: str) -> tuple[tuple[tuple[str, int], ...], int]:
        """Candidates for a phrase that ends in a label, and how many of its last words the label has."""
        words = re.findall(r"[\w'’-]+", phrase.lower())
        if len(words) >= 2 and (found := self.two(words[-2], words[-1])):
            return tuple(found), 2
        if words and (found := self.one(words[-1])):
            return tuple(found), 1
        return (), 0

    def split(self, text: str) -> list[tuple[tuple[tuple[str, int], ...] | None, str]]:
        """The text cut at its labels: (candidates or None for what precedes the first label, raw speech)."""
        if not _MARK.search(text):
            return [(None, text)]
        out, start, label, at = [], 0, None, 0
        while m := _LABEL.search(text, at):
            at = m.end()
            begin = m.start()
            kind = m.lastgroup if m.lastgroup != "mark" else "name"
            if m["key"] is not None:
                found = ((self.keys[m["key"].lower()], 0),) if m["key"].lower() in self.keys else ()
            elif m["handle"] is not None:
                h = m["handle"].lower()
                found = ((self.handles[h], 0),) if h in self.handles else tuple((i, 1) for x, i in self.handles.items() if distance(h, x, 1) <= 1)
            elif m["dash"] is not None:
                w = m["dash"]
                found = tuple(self.one(w.lower())) if w.isupper() or w.lower() in self.words else ()
            else:
                phrase = m["voice"] or m["box"] or m["name"]
                found, used = self.named(phrase)
                if m["box"] and found and used < len(re.findall(r"[\w'’-]+", phrase)):
                    found = ()
                if found and m["name"] is not None and used == 1 and len(phrase.split()) == 2:
                    begin = m.start("name") + phrase.rfind(phrase.split()[-1])
            if not found:
                at = m.start() + max(1, (m.end() - m.start()) if kind in ("voice", "box") else len(m[0].split()[0]))
                continue
            out.append((label, text[start:begin]))
            label, start = found, m.end()
        out.append((label, text[start:]))
        return out
