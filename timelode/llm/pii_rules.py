"""Grammar of personal information: how each kind is written, and where a mention begins and ends.

Used only to label the bounded training sample of the tagger.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

TYPES = ("email", "phone", "national_id", "address", "person")

# Spellings of @ and of the dot, digit words, street words, titles.
_SP = r"[ \t ]"
_AT_TIGHT = rf"(?:@|＠|&#64;|&commat;|{_SP}*(?:\(at\)|\[at\]|\{{at\}}|<at>){_SP}*|{_SP}+[@＠]{_SP}+)"
_AT_WORD = rf"{_SP}+(?:at|chiocciola|arroba|arobase|klammeraffe|ät){_SP}+"
_DOT_WORD = rf"(?:{_SP}*(?:\[dot\]|\(dot\)|\{{dot\}}|\[\.\]){_SP}*|{_SP}+(?:dot|punto|punkt|point){_SP}+)"
_DIGIT_WORDS = (
    "zero oh one two three four five six seven eight nine double triple "
    "null eins zwei zwo drei vier fünf sechs sieben acht neun "
    "zéro un deux trois quatre cinq sept huit neuf "
    "uno due tre quattro cinque sei sette otto nove "
    "cero dos tres cuatro cinco seis siete ocho nueve"
).split()
_STREET_AFTER = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|way|square|sq|terrace|close|boulevard|blvd"
_STREET_FR = "rue|avenue|boulevard|place|quai|allée|impasse|chemin|cours|bd|av\\.?"
_STREET_IT = "via|viale|piazza|piazzale|corso|largo|vicolo|strada|v\\.le|p\\.zza"
_STREET_ES = "c/|calle|avenida|avda\\.?|plaza|paseo|ronda|camino"
_STREET_DE = "straße|strasse|str\\.|weg|platz|allee|gasse|ring|ufer|damm"
# Parts of an address are bounded as mail itself bounds them, so that no text makes the search quadratic.
_PART = r"[A-Za-z0-9À-ÖØ-öø-ÿ_+-]{1,64}"
_EMAIL = re.compile(
    rf"(?<![\w.+-])(?P<local>{_PART}(?:(?:\.|{_DOT_WORD}){_PART}){{0,12}})(?:(?P<tight>{_AT_TIGHT})|(?P<word>{_AT_WORD}))"
    rf"(?P<domain>{_PART}(?:(?:\.|{_DOT_WORD}){_PART}){{0,12}}?(?:\.|{_DOT_WORD})(?P<top>[A-Za-z]{{2,24}}))(?![\w-])(?!(?:\.|{_DOT_WORD})[A-Za-z]{{2}})",
    re.I,
)
_SPELLED_DOT = re.compile(_DOT_WORD, re.I)

_SEP = r"[ .\-/ ‐‑–]"
_EXT = r"(?:,?\s?\(?(?:ext\.?|extension|x|int\.?|interno|durchwahl|dw|poste|anexo|app\.?)[  ]?\d{1,6}\)?)?"
_EXT_SPOKEN = r"(?:,? (?:extension|ext\.?) (?:\d{1,6}|(?:(?:%s)[ -]?)+))?" % "|".join(_DIGIT_WORDS)
_PHONE = re.compile(
    rf"""(?<![\w@/.+\-–])(?:
    (?:\+{_SEP}?|00{_SEP}?(?=(?:{_SEP}?[\d()]){{10}}))[1-9]\d{{0,2}}(?:{_SEP}?\(\d{{1,5}}\))?\d{{0,14}}(?:{_SEP}\d{{1,14}}){{0,7}}
  | \(\+?\d{{1,3}}\){_SEP}?\d{{1,14}}(?:{_SEP}\d{{1,14}}){{1,7}}
  | \(?[2-9]\d\d\)?{_SEP}\d{{3}}{_SEP}\d{{4}}
  | [2-9]\d\d/\d{{7}} | \(?[2-9]\d\d\)?{_SEP}\d{{7}}
  | \(?0\d{{1,4}}\)?{_SEP}\d{{4,9}}(?:{_SEP}\d{{1,4}})?
  | 0\d(?:{_SEP}\d\d){{4}}
  | \(?0\d\d\)?{_SEP}\d{{4}}{_SEP}\d{{4}}
  | 0\d{{4}}{_SEP}?\d{{6}}
  | 0[1-9]\d{{8,9}} | [2-9]\d{{9}}
    ){_EXT}(?![\w@])(?![\-–/:.]\d)""",
    re.X | re.I,
)
_DIGIT = "|".join(sorted(set(_DIGIT_WORDS), key=len, reverse=True))
_SPOKEN = re.compile(rf"(?<!\w)(?:(?:plus )?(?:{_DIGIT})(?:,? |-)){{6,}}(?:{_DIGIT})(?!\w){_EXT_SPOKEN}", re.I)

_ID = re.compile(
    r"""(?<![\w@/.+\-–:])(?:
    \d{3}[-  ]\d\d[-  ]\d{4} | \d{9}
  | [1-478][  ]?\d\d[  ]?(?:0[1-9]|1[0-2]|[2-9]\d)[  ]?\d[\dAB][  ]?\d{3}[  ]?\d{3}(?:[  ]?\d\d)?
  | [A-Z]{3}[  ]?[A-Z]{3}[  ]?\d\d[A-Z]\d\d[  ]?[A-Z]\d{3}[A-Z]
  | [A-Z]{2}[  ]?\d\d[  ]?\d\d[  ]?\d\d[  ]?[A-D]
  | \d{8}[-  ]?[A-Z] | [XYZ][-  ]?\d{7}[-  ]?[A-Z]
  | \d\d[  ]\d{3}[  ]\d{3}[  ]\d{3}
    )(?![\w@])(?![\-–/:.]\d)""",
    re.X | re.I,
)

_W = r"[^\W\d_][\w'’-]*"
_NO = r"\d{1,4}(?:[  ]?(?:bis|ter)(?!\w)|/[A-Za-z](?!\w)|[A-Za-z](?!\w)|[  ][A-Za-z](?![\w.]))?"
_NO_AFTER = r"\d{1,4}(?:[  ]?(?:bis|ter)(?!\w)|[  ]?/[  ]?[A-Za-z](?!\w)|[A-Za-z](?!\w))?"
_ADDRESS = re.compile(
    rf"""(?<![\w@/.:-])(?:
    (?P<en>{_NO}[  ]+(?P<en1>{_W}(?:[  ]+{_W}){{0,2}})[  ]+(?:{_STREET_AFTER})(?!\w))
  | (?P<fr>{_NO},?[  ]+(?:{_STREET_FR})[  ]+(?P<fr1>{_W}(?:[  ]+{_W}){{0,3}}))
  | (?P<it>(?:{_STREET_IT})[  ]+(?P<it1>{_W}(?:[  ]+{_W}){{0,3}}),?[  ]+(?:n\.?[  ]?)?{_NO_AFTER})
  | (?P<es>(?:{_STREET_ES})[  ]*(?P<es1>{_W}(?:[  ]+{_W}){{0,3}}),?[  ]+(?:n[º.°]?[  ]?)?{_NO_AFTER})
  | (?P<de>(?:{_W}[  -])?(?P<de1>{_W}?)(?:{_STREET_DE})[  ]+{_NO_AFTER})
    )(?!\w)""",
    re.X | re.I,
)

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_VOWELS = "aeiouyàèéìòùáíóúäöü"
_SPLIT = re.compile(rf"([^{_VOWELS}]*)([{_VOWELS}]+)(.*)", re.S)


class Names:
    """Names of a lexicon and words built like them: root + consonants + vowels + ending, each learned
    from the lexicon's names of the same kind."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.known: dict[str, set[str]] = {}
        for name, kind in rows:
            self.known.setdefault(name.lower(), set()).add(kind)
        self.models = {kind: self._learn([n for n, ks in self.known.items() if kind in ks]) for kind in ("given", "family")}
        self.kinds = lru_cache(500_000)(self._kinds)
        self.flag = lru_cache(500_000)(lambda word: sum({"given": 1, "family": 2}[k] for k in self._kinds(word)))

    @staticmethod
    def _learn(names: list[str]):
        prefixes = Counter(n[:i] for n in names for i in range(2, min(8, len(n) - 2)))
        roots, split = set(), []
        for n in names:
            root = next((n[:i] for i in range(2, min(7, len(n) - 2)) if prefixes[n[:i]] >= (2 if i > 2 else 6)), "")
            while root and len(root) < len(n) - 3 and prefixes[n[: len(root) + 1]] == prefixes[root]:
                root = n[: len(root) + 1]
            if root:
                roots.add(root)
                split.append(n[len(root) :])
        parts = [m.groups() for s in split if (m := _SPLIT.fullmatch(s))]
        first = {c for c, n in Counter(p[0] for p in parts).items() if n >= 2}
        middle = {c for c, n in Counter(p[1] for p in parts).items() if n >= 2}
        last = {c for c, n in Counter(p[2] for p in parts).items() if n >= 2}
        return roots, first, middle, last

    def invent(self, rng, kind: str) -> str:
        """A word built like the lexicon's names of one kind."""
        roots, *parts = (sorted(x) for x in self.models[kind])
        return rng.choice(roots) + "".join(rng.choice(x) for x in parts) if roots and all(parts) else ""

    def _kinds(self, word: str) -> frozenset[str]:
        word = word.lower()
        out = set(self.known.get(word, ()))
        if not out:
            for kind, (roots, first, middle, last) in self.models.items():
                for i in range(2, min(8, len(word) - 2)):
                    if word[:i] in roots and (m := _SPLIT.fullmatch(word[i:])) and m[1] in first and m[2] in middle and m[3] in last:
                        out.add(kind)
                        break
        return frozenset(out)


class Rules:
    def __init__(self, names: list[tuple[str, str]]):
        self.names = Names(names)

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) of all mentions, in order, none overlapping."""
        spans: list[tuple[str, int, int]] = []
        taken = bytearray(len(text))

        def add(kind: str, start: int, end: int) -> None:
            if end > start and not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                spans.append((kind, start, end))

        for m in _EMAIL.finditer(text):
            if m["word"] and not _SPELLED_DOT.search(m["domain"]):
                continue
            add("email", m.start(), m.end())
        for m in _ADDRESS.finditer(text):
            if (end := self._address_end(m)) is not None:
                add("address", m.start(), end)
        for m in _ID.finditer(text):
            add("national_id", m.start(), m.end())
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in re.split(r"(?i)ext|x|int|durch|dw|poste|app|anexo", m[0])[0])
            if 8 <= digits <= 15:
                add("phone", m.start(), m.end())
        for m in _SPOKEN.finditer(text):
            add("phone", m.start(), m.end())
        for start, end in self._persons(text, taken):
            add("person", start, end)
        return sorted(spans, key=lambda s: s[1])

    def _named(self, words: str) -> int:
        """How many of the first words look like a name: name-like, or capitalised next to such a word."""
        n = 0
        for w in words.split():
            if not (self.names.kinds(w) or (w[:1].isupper() and len(w) > 2)):
                break
            n += 1
        return n

    def _address_end(self, m: re.Match) -> int | None:
        kind = m.lastgroup.rstrip("1") if m.lastgroup else ""
        kind = next(k for k in ("en", "fr", "it", "es", "de") if m[k])
        if kind == "de":
            stem = m["de1"]
            return m.end() if stem and (self.names.kinds(stem) or stem[:1].isupper()) else None
        words = m[kind + "1"]
        if kind == "fr":  # the street's name ends the mention: keep its name-like words
            pieces = list(re.finditer(_W, words))
            last = None
            for i, w in enumerate(pieces):
                if self.names.kinds(w[0]) or (i == 0 and w[0][:1].isupper()):
                    last = w.end()
                elif i == 0 and w[0].lower() in ("de", "du", "des", "la", "le"):
                    continue
                else:
                    break
            return None if last is None else m.start("fr1") + last
        pieces = words.split()
        if kind == "en" and pieces[0].lower() in ("old", "new", "north", "south", "east", "west", "upper", "lower") and len(pieces) > 1:
            pieces = pieces[1:]
        if kind in ("it", "es") and pieces[0].lower() in ("di", "della", "del", "de", "la", "dei", "san", "santa") and len(pieces) > 1:
            pieces = pieces[1:]
        good = all(self.names.kinds(p) or (p[:1].isupper() and p[1:2].islower()) for p in pieces)
        return m.end() if good else None

    def _may_name(self, word: str) -> bool:
        """Long words of any shape; short ones only as the lexicon's own names, with a capital."""
        return len(word) >= 5 or (word[:1].isupper() and word.lower() in self.names.known)

    def _persons(self, text: str, taken: bytearray) -> list[tuple[int, int]]:
        words = [(m.start(), m.end(), k) for m in _TOKEN.finditer(text) if self._may_name(m[0]) and not taken[m.start()] and (k := self.names.kinds(m[0]))]
        out = []
        i = 0
        while i < len(words):
            start, end, kinds = words[i]
            if text[max(0, start - 1) : start] in ("_", "@", "/", ".") and start and text[start - 1] != "." or text[end : end + 1] in ("_", "@") or text[max(0, start - 1) : start].isdigit() or text[end : end + 1].isdigit():
                i += 1
                continue
            first, last = i, i
            while last + 1 < len(words):
                between = text[words[last][1] : words[last + 1][0]]
                a, b = words[last][2], words[last + 1][2]
                if re.fullmatch(r"[  ]+(?:[^\W\d_]\.[  ]*)?", between) and "family" in b and ("given" in a or last > first):
                    last += 1
                elif re.fullmatch(r",[  ]+", between) and last == first and "family" in a and "given" in b and "given" not in a:
                    last += 1
                    tail = re.match(r"[  ]+[^\W\d_]\.(?=\W|$)", text[words[last][1] :])
                    if tail:
                        words[last] = (words[last][0], words[last][1] + tail.end(), words[last][2])
                    break
                else:
                    break
            start, end = words[first][0], words[last][1]
            lead = re.search(r"(?<![\w.])(?:(?P<t>M\.)[  ]+)?(?P<i>[^\W\d_]\.[  ]*(?:[^\W\d_]\.[  ]*)?)$", text[max(0, start - 12) : start])
            if lead and "family" in words[last][2] and last == first:
                begin = max(0, start - 12) + lead.start("i")
                title = lead["t"] is None and text[begin : begin + 2] == "M." and _title_m(text, begin, end)
                if title:
                    m = re.match(r"M\.[  ]+", text[begin:start])
                    begin += m.end() if m else 0
                start = begin
            if "given" in words[first][2] and first == last:
                tail = re.match(r"[  ]+[^\W\d_]\.(?=[  ]*(?:$|[<\n]))", text[end:])
            out.append((start, end))
            i = last + 1
        return out


def _title_m(text: str, begin: int, end: int) -> bool:
    """Whether `M.` stands for the French title: the words that follow the mention are French."""
    after = re.sub(r"^\s*<[^>]*>", "", text[end : end + 60])[:30]
    return bool(re.match(r"[\s,]*(?:l'a|a|est|et|dit|arrive)\b", after, re.I))
