"""Duplicates hidden by formatting: records equal but for spacing, case, punctuation or field order.

A lookup table over code points folds letters and digits and maps everything else to 0 (skipped). Whole
Arrow batches of code points run through it into rolling polynomial hashes of words, fields and records;
no canonical string is built. Rows that collide are compared with their group's first record: two pointers
walk both codes past their skipped characters, all pairs of a batch at once, flat lists field by field.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.session import checkpointed
from timelode.sources.tables import records

_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HEAD = np.uint64(0xA0761D6478BD642F)
_QUOTES = "\"'`´“”„‟‘’‚‛«»‹›"


def _fold(code: int) -> int:
    """The folded character of a word, or 0 for one that is skipped."""
    c = chr(code)
    if c != "_" and not c.isalnum() and not unicodedata.category(c).startswith("M"):
        return 0
    low = c.lower()
    return ord(low) if len(low) == 1 else code


@lru_cache(1)
def fold_table() -> np.ndarray:
    return np.fromiter((_fold(c) for c in range(1 << 16)), np.uint32, 1 << 16)


def folded(codes: np.ndarray) -> np.ndarray:
    table = fold_table()
    out = table[np.minimum(codes, 0xFFFF)]
    rare = np.nonzero(codes > 0xFFFF)[0]
    if len(rare):
        some, where = np.unique(codes[rare], return_inverse=True)
        out[rare] = np.array([_fold(int(c)) for c in some], np.uint32)[where]
    return out


_OPENING = re.compile(rf"[\s>$#`;]*(\{{?)[\s{_QUOTES}]*")
_FIELD = re.compile(rf"(?:^|(?<=[\s{{,{_QUOTES}]))([^\W\d]\w*)([{_QUOTES}]?)\s*([=:])")
_OPTION = re.compile(r"(?<=\s)--(?=\w)")
_NESTED = re.compile(r"[(){}<>]")
_HEAD_WORDS = re.compile(r"[\s>$#`]*\w[\w./:@\\\s-]*$")


def _before(text: str, at: int, skipped) -> str:
    """The last character before `at` that isn't skipped."""
    at -= 1
    while at >= 0 and skipped(text[at]):
        at -= 1
    return text[at] if at >= 0 else ""


def field_starts(text: str) -> tuple[list[int], bool]:
    """Where the named fields of a flat list begin (objects, mappings, assignments, a command's --options),
    and whether words of a command stand before them. No fields for any other code."""
    head = _OPENING.match(text)
    body = text[head.end() :].rstrip()
    if head[1] and body.rstrip(";` \n\t").endswith("}"):
        body = body.rstrip(";` \n\t")[:-1]
    fields = []
    if not _NESTED.search(body):
        for m in _FIELD.finditer(text, head.end()):
            after, before = text[m.end() : m.end() + 2], _before(text, m.start(1), str.isspace)
            if m[3] == "=":
                named = after[:1] not in ("=", ">")
            elif after == "//":
                named = False
            else:
                line = _before(text, m.start(1), " \t\xa0".__contains__)
                named = bool(m[2]) or not after[:1].strip() or after[:1] in _QUOTES + "[" or before in ("{", ",") or line in ("", "\n")
            if named:
                fields.append(m.start(1))
        if fields and fields[0] == head.end():
            return fields, False
    options = [m.end() for m in _OPTION.finditer(text)]
    if options and _HEAD_WORDS.match(text[: options[0] - 2]):
        return options, True
    return [], False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(values: np.ndarray, starts: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of `values` that begins at `starts`; arithmetic modulo 2^64."""
    place = np.arange(len(values)) - np.repeat(starts, np.diff(starts, append=len(values)))
    powers = np.cumprod(np.full(int(place.max()) + 1, base, np.uint64))
    return _mix(np.add.reduceat(values * powers[place], starts))


class _Scan:
    """The folded characters of many texts, one after the other, and their segments: the fields of flat lists,
    the words before a command's options, or the whole of any other text. Texts without words have none."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.fold = fold = folded(codes) if len(codes) else np.zeros(0, np.uint32)
        first = fold != 0
        inside = first.copy()
        inside[begins[sizes > 0]] = False
        first[1:] &= (fold[:-1] == 0) | ~inside[1:]
        self.words = words = np.nonzero(first)[0]
        owner = np.searchsorted(begins, words, "right") - 1
        opens = np.diff(owner, prepend=-1) != 0
        head = np.zeros(len(words), bool)
        for i, text in enumerate(texts if len(words) else ()):
            fields, command = field_starts(text)
            if fields:
                at = np.searchsorted(words, begins[i] + np.array(fields))
                opens[at[at < len(words)]] = True
                at = np.searchsorted(words, begins[i])
                if at < len(words):
                    head[at] = command
        self.opens = np.nonzero(opens)[0]
        #: Of each segment: its text, whether it is a command's head, the first and the end of its characters.
        self.owner, self.head, self.start = owner[self.opens], head[self.opens], words[self.opens]
        ends = begins + sizes
        self.end = np.minimum(np.append(self.start[1:], len(fold)), ends[self.owner]) if len(self.owner) else self.start

    def hashes(self, base: np.uint64) -> np.ndarray:
        """The hash of each segment's words in order."""
        if not len(self.words):
            return np.zeros(0, np.uint64)
        # Characters between two words are 0 in `fold`, so a word's run may extend to the next word.
        word = _rolling(self.fold[self.words[0] :].astype(np.uint64), self.words - self.words[0], base)
        segment = _rolling(word, self.opens, base ^ _HEAD)
        return np.where(self.head, _mix(segment ^ _HEAD), segment)


def code_hashes(texts: list[str]) -> np.ndarray:
    """Three independent hashes (n, 3) of each text's words in order, the fields of flat lists in any order.
    0 for a text without words."""
    out = np.zeros((len(texts), len(_BASES)), np.uint64)
    scan = _Scan(texts)
    edges = np.nonzero(np.diff(scan.owner, prepend=-1))[0]
    for j, base in enumerate(_BASES):
        if len(edges):
            out[scan.owner[edges], j] = np.add.reduceat(scan.hashes(base), edges) | np.uint64(1)
    return out


#: Characters that the walk compares at once where both texts run alike.
_STRIDE = 32


def _walk(a: np.ndarray, i: np.ndarray, i_end: np.ndarray, b: np.ndarray, j: np.ndarray, j_end: np.ndarray) -> np.ndarray:
    """Whether the stretches a[i:i_end] and b[j:j_end] of folded characters have the same words: two pointers per
    pair go from character to character, each past those that are skipped (0), all pairs in step."""

    def ahead(fold: np.ndarray) -> np.ndarray:  # the next character that isn't skipped, from each place on
        at = np.where(np.append(fold, 1) != 0, np.arange(len(fold) + 1), len(fold))
        return np.minimum.accumulate(at[::-1])[::-1]

    next_a, next_b = ahead(a), ahead(b)
    a, b = np.append(a, np.zeros(_STRIDE, a.dtype)), np.append(b, np.zeros(_STRIDE, b.dtype))
    same = np.ones(len(i), bool)
    i, j, live, begun = i.copy(), j.copy(), np.arange(len(i)), np.zeros(len(i), bool)
    stride = np.arange(_STRIDE)
    while len(live):
        # Where both run alike they go on together.
        p, q = i[live], j[live]
        alike = a[p[:, None] + stride] == b[q[:, None] + stride]
        run = np.where(alike.all(axis=1), _STRIDE, alike.argmin(axis=1))
        run = np.maximum(0, np.minimum(run, np.minimum(i_end[live] - p, j_end[live] - q)))
        begun[live] |= run > 0
        p, q = p + run, q + run
        # Then each goes past what it skips.
        at_p, at_q = np.minimum(next_a[p], i_end[live]), np.minimum(next_b[q], j_end[live])
        over_p, over_q = at_p >= i_end[live], at_q >= j_end[live]
        going = ~over_p & ~over_q
        gap_p, gap_q = a[at_p - 1] == 0, b[at_q - 1] == 0  # a new word begins here, in one or in both
        differ = (over_p != over_q) | (going & ((a[at_p] != b[at_q]) | (begun[live] & (gap_p != gap_q))))
        same[live[differ]] = False
        i[live], j[live] = at_p + 1, at_q + 1
        begun[live] = True
        live = live[going & ~differ]
    return same


def same_codes(a: list[str], b: list[str]) -> np.ndarray:
    """Exact comparison of pairs of texts. Segments are paired by their hash, then walked; texts without words
    are like none."""
    x, y = _Scan(a), _Scan(b)
    count_x, count_y = (np.bincount(s.owner, minlength=len(a)) for s in (x, y))
    same = (count_x == count_y) & (count_x > 0)
    pick_x, pick_y = (np.lexsort((s.hashes(_BASES[0]), ~s.head, s.owner)) for s in (x, y))
    pick_x, pick_y = pick_x[same[x.owner[pick_x]]], pick_y[same[y.owner[pick_y]]]
    alike = x.head[pick_x] == y.head[pick_y]
    alike &= _walk(x.fold, x.start[pick_x], x.end[pick_x], y.fold, y.start[pick_y], y.end[pick_y])
    same[x.owner[pick_x][~alike]] = False
    return same


def same_code(a: str, b: str) -> bool:
    return bool(same_codes([a], [b])[0])


def _hash_codes(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        h = code_hashes(texts).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(h[:, j]) for j in range(3))], ["id", "code", "h1", "h2", "h3"])


def _verify(batches):
    for batch in batches:
        ids, codes, first_ids, firsts = (batch.column(i).to_pylist() for i in range(4))
        same = same_codes(codes, firsts) | np.array([i == f for i, f in zip(ids, first_ids, strict=True)], bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same, pa.bool_())], ["id", "first_id", "same"])


#: Parts over which the rows of one code are spread.
SALTS = 32


def _compared(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row_id, keep_id) of the rows that have the code of the first row with the same `keys`, and the other rows.

    A code's rows are spread over SALTS parts; only ids are aggregated, and each part that occurs gets one copy of
    the first row's code.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "salt").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    firsts = parts.groupBy(*keys).agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    single = firsts.where("n = 1").select(F.col("first_id").alias("row_id"), F.col("first_id").alias("keep_id"))
    shared = parts.select(*keys, "salt").join(firsts.where("n > 1").select(*keys, "first_id"), keys)
    member = salted.join(shared, [*keys, "salt"])
    head = member.where("id = first_id").select(*keys, F.col("code").alias("first_code")).join(shared.select(*keys, "salt"), keys)
    pairs = member.join(head, [*keys, "salt"]).select("id", "code", "first_id", "first_code")
    checked = checkpointed(pairs.mapInArrow(_verify, "id string, first_id string, same boolean"))
    alike = checked.where("same").select(F.col("id").alias("row_id"), F.col("first_id").alias("keep_id"))
    return single.unionByName(alike), rows.join(checked.where("NOT same").select("id"), "id", "left_semi")


def copy_groups(df: DataFrame, *, row_id: str, code: str) -> DataFrame:
    """row_id, keep_id: for each record the smallest id among the records with the same code.

    Records with a NULL id or NULL code, or whose code has no word or number, are left out; rows that
    repeat an id count once (of codes that differ under one id the smallest counts); an empty table gives
    no row; other columns are ignored. A code that a third of all records share is spread over SALTS parts.
    Rows that collide in two hashes without having the same code are compared again within their third hash.
    """
    rows = checkpointed(
        df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{code}`").alias("code"))
        .dropna()
        .groupBy("id")
        .agg(F.min("code").alias("code"))
        .mapInArrow(_hash_codes, "id string, code string, h1 bigint, h2 bigint, h3 bigint")
        .where("h1 <> 0")
    )
    out, others = _compared(rows, ["h1", "h2"])
    while not others.isEmpty():  # true collisions of 128 bits; every pass settles at least the first row of each
        more, others = _compared(checkpointed(others), ["h1", "h2", "h3"])
        out = out.unionByName(more)
    return out


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(records(spark, sf_dir, "code_blocks", "id", "code"), row_id="id", code="code")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code block that is a copy, with the smallest id of its set of copies."""
    return _groups(spark, sf_dir).where("row_id <> keep_id").select("keep_id", F.col("row_id").alias("copy_id"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per code with the number of its code blocks."""
    return _groups(spark, sf_dir).groupBy("keep_id").agg(F.count("*").alias("copies"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL: dict[str, str] = {}  # field order isn't expressible in SQL; tests/llm hold it against brute force
