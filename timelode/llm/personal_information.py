"""Personal information inside free text, found by a character BiLSTM-CRF.

The tagger is trained in numpy on windows of a bounded sample of documents whose spans a grammar has labelled
(names and digits are varied, so that it learns shapes and contexts, and from some round on many windows lie
where it still errs): each shard trains for one round, the driver averages the shards' parameters, and so on.
Every document is then cut into overlapping windows, their scores are blended where they overlap, and the best
path through the whole document gives the mentions, their kinds and places. The grammar has no say in them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm import tagger
from timelode.llm.pii_rules import TYPES, Rules
from timelode.session import checkpointed
from timelode.sources.tables import table


@dataclass(frozen=True)
class Training:
    """Bounds of the training: at most train_documents texts, of each at most slice_chars characters (from a
    place that its key decides). They bound the training only; documents are searched whole."""

    train_documents: int = 8192
    slice_chars: int = 3000
    shards: int = 6
    rounds: int = 8
    windows: int = 4500
    width: int = 128
    batch: int = 64
    hidden: int = 48
    rate: float = 0.012
    #: The first round that looks for the tagger's errors on the sample.
    mining: int = 2


@dataclass(frozen=True)
class Decoding:
    width: int = 384
    overlap: int = 64
    batch: int = 512
    chunk: int = 400_000


MAX_NAMES = 1_000_000
TAGS = 1 + 3 * len(TYPES)
_WORD = re.compile(r"[^\W\d_]{3,}")


def inputs(text: str, rules: Rules) -> np.ndarray:
    """What the tagger reads of a text: per code point its class and what the lexicon says of its word."""
    x = tagger.kinds(text).astype(np.int64) * tagger.FLAGS
    for m in _WORD.finditer(text):
        if flag := rules.names.flag(m[0]):
            x[m.start() : m.end()] += flag
    return x


def _other(kind: int, mention: str, rng: random.Random, rules: Rules) -> str:
    """The mention with other digits or names."""
    if TYPES[kind] in ("phone", "national_id"):
        return re.sub(r"\d", lambda m: m[0] if rng.random() < 0.4 else rng.choice("0123456789"), mention)

    def name(m: re.Match) -> str:
        flag = rules.names.flag(m[0])
        word = rules.names.invent(rng, "given" if flag & 1 else "family") if flag and rng.random() < 0.7 else ""
        if not word:
            return m[0]
        return word.upper() if m[0].isupper() else word.capitalize() if m[0][:1].isupper() else word

    return re.sub(r"[^\W\d_]{5,}", name, mention)


class _Sample:
    """Labelled texts of one shard and windows drawn from them."""

    def __init__(self, docs: list[tuple[str, list[tuple[int, int, int]]]], rules: Rules):
        self.docs, self.rules = docs, rules
        self.x = [inputs(t, rules) for t, _ in docs]
        self.y = [tagger.tags_of(len(t), s) for t, s in docs]
        self.by_kind: dict[int, list[tuple[int, int]]] = {}
        self.odd: list[tuple[int, int]] = []  # places that look like a mention and are none
        for i, (text, spans) in enumerate(docs):
            for kind, a, _ in spans:
                self.by_kind.setdefault(kind, []).append((i, a))
            self.odd += [(i, m.start()) for m in re.finditer(r"\d[\d .\-/()]{5,}|@|＠", text) if not self.y[i][m.start()]]
            self.odd += [(i, int(a)) for a in np.nonzero((self.x[i] % tagger.FLAGS > 0) & (self.y[i] == 0))[0][::6]]

    def errors(self, p: dict, how: Decoding) -> list[tuple[int, int]]:
        """Where the tagger and the labels differ."""
        out = []
        for i, found in enumerate(decode([t for t, _ in self.docs], p, self.rules, how)):
            wrong = set(found) ^ set(self.docs[i][1])
            out += [(i, a) for _, a, _ in sorted(wrong)]
        return out

    def windows(self, hard: list[tuple[int, int]], count: int, width: int, rng: random.Random):
        kinds = sorted(self.by_kind)
        x, y = np.full((count, width), tagger.PAD, np.int64), np.zeros((count, width), np.int64)
        for row in range(count):
            draw, vary = rng.random(), rng.random() < 0.7
            if hard and draw < 0.35:
                (i, at), vary = rng.choice(hard), rng.random() < 0.4
            elif kinds and draw < 0.75:
                i, at = rng.choice(self.by_kind[rng.choice(kinds)])
            elif self.odd and draw < 0.88:
                i, at = rng.choice(self.odd)
            else:
                i = rng.randrange(len(self.docs))
                at = rng.randrange(max(1, len(self.docs[i][0])))
            start = max(0, min(at - rng.randrange(width - 10), len(self.x[i]) - width))
            text, spans = self.docs[i]
            xs, ys, size, before = [], [], 0, start
            for kind, a, b in spans if vary else ():
                if a >= start and b <= start + width:
                    new = _other(kind, text[a:b], rng, self.rules)
                    xs += [self.x[i][before:a], inputs(new, self.rules)]
                    ys += [self.y[i][before:a], tagger.tags_of(len(new), [(kind, 0, len(new))])]
                    before = b
            xs.append(self.x[i][before : before + width])
            ys.append(self.y[i][before : before + width])
            one, tags = np.concatenate(xs)[:width], np.concatenate(ys)[:width]
            x[row, : len(one)], y[row, : len(one)] = one, tags
        return x, y


def train_round(sample: _Sample, p: dict, how: Training, decoding: Decoding, round_: int, seed: int) -> tuple[dict, float]:
    """One shard's parameters after a round."""
    hard = sample.errors(p, decoding) if round_ >= how.mining else []
    x, y = sample.windows(hard, how.windows, how.width, random.Random(seed))
    rates = tuple(how.rate * (1 - 0.95 * (round_ + d) / how.rounds) for d in (0, 1))
    return tagger.train(p, x, y, batch=how.batch, rates=rates, seed=seed)


def decode(texts: list[str], p: dict, rules: Rules, how: Decoding) -> Iterator[list[tuple[int, int, int]]]:
    """For each text its mentions (kind, start, end), in chunks of bounded size."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > how.chunk:
            yield from _decode(part, p, rules, how)
            part, size = [], 0
    if part:
        yield from _decode(part, p, rules, how)


def _decode(texts: list[str], p: dict, rules: Rules, how: Decoding) -> list[list[tuple[int, int, int]]]:
    xs = [inputs(t, rules) for t in texts]
    where = []  # (length, text, start) of each window
    for i, x in enumerate(xs):
        last = max(0, len(x) - how.width)
        where += [(min(how.width, len(x)), i, s) for s in [*range(0, last, how.width - how.overlap), last] if len(x)]
    where.sort()
    sizes = np.array([len(x) for x in xs])
    starts = np.cumsum(sizes) - sizes
    scores, weights = np.zeros((int(sizes.sum()), TAGS), np.float32), np.zeros((int(sizes.sum()), 1), np.float32)
    for at in range(0, len(where), how.batch):
        windows = where[at : at + how.batch]
        x = np.full((windows[-1][0], len(windows)), tagger.PAD, np.int64)
        for j, (n, i, s) in enumerate(windows):
            x[:n, j] = xs[i][s : s + n]
        e = tagger.emissions(p, x)
        for j, (n, i, s) in enumerate(windows):  # a window counts less towards its ends
            place = np.arange(1, n + 1, dtype=np.float32)
            w = np.minimum(np.minimum(place, place[::-1]), how.overlap)[:, None]
            a = int(starts[i]) + s
            scores[a : a + n] += w * e[:n, j]
            weights[a : a + n] += w
    scores /= weights
    stretches = tagger.open_stretches(scores, p["T"], starts, sizes)
    paths = tagger.viterbi([scores[starts[i] + a : starts[i] + b] for i, a, b in stretches], p["T"])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, start, _), path in zip(stretches, paths, strict=True):
        out[i] += [(kind, start + a, start + b) for kind, a, b in tagger.spans_of(path)]
    return out


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def _unpack(raw: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


_SPANS = "array<struct<kind:int,start_pos:int,end_pos:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))


def _label(names: list[tuple[str, str]]):
    def label(batches):
        rules = Rules(names)
        for batch in batches:
            spans = [[{"kind": TYPES.index(k), "start_pos": a, "end_pos": b} for k, a, b in rules.find(t)] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS_ARROW)], ["shard", "key", "text", "spans"])

    return label


def _train_shards(names: list[tuple[str, str]], p: dict, how: Training, decoding: Decoding, round_: int):
    def train(batches):
        rules, shards = Rules(names), {}
        for batch in batches:
            for shard, key, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                shards.setdefault(shard, []).append((key, text, [(s["kind"], s["start_pos"], s["end_pos"]) for s in spans]))
        for shard, docs in sorted(shards.items()):
            docs.sort(key=lambda d: d[0])
            new, loss = train_round(_Sample([d[1:] for d in docs], rules), p, how, decoding, round_, 1000 * round_ + shard)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_pack(new)], pa.binary()), pa.array([loss])], ["shard", "params", "loss"])

    return train


def lexicon(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The known names, a small dimension (checked against MAX_NAMES) that every task holds."""
    speakers = table(spark, sf_dir, "speakers")
    rows = (
        table(spark, sf_dir, "name_lexicon").select("name", "kind")
        .unionByName(speakers.select(F.col("given_name").alias("name"), F.lit("given").alias("kind")))
        .unionByName(speakers.select(F.col("family_name").alias("name"), F.lit("family").alias("kind")))
        .dropna().distinct().limit(MAX_NAMES + 1).collect()
    )
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    return sorted((r[0], r[1]) for r in rows)


def _sampled(documents: DataFrame, how: Training) -> DataFrame:
    """shard, key, text: the documents with the smallest hashes of their keys, cut, whatever the partitions."""
    place = F.xxhash64("key")
    most = documents.select(place.alias("place")).orderBy("place").limit(how.train_documents).agg(F.max("place")).first()[0]
    start = F.pmod(F.xxhash64("key", F.lit("slice")), F.greatest(F.lit(1), F.length("text") - how.slice_chars + 1)) + 1
    cut = documents.where(place <= F.lit(most)).select("key", F.col("text").substr(start.cast("int"), F.lit(how.slice_chars)).alias("text"))
    shard = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(how.shards)).cast("int").alias("shard")
    return cut.groupBy("key").agg(F.min("text").alias("text")).select(shard, "key", "text")


def _slots(spark: SparkSession, n: int) -> list[int]:
    """n keys that a repartition into n parts sends to n different parts."""
    tried = spark.range(100 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part")).groupBy("part").agg(F.min("id").alias("id")).collect()
    return sorted(r["id"] for r in tried)


def train_tagger(documents: DataFrame, names: list[tuple[str, str]], how: Training = Training(), decoding: Decoding = Decoding()) -> dict[str, np.ndarray]:
    """Parameters of the tagger, trained on at most how.train_documents of `documents` (key bigint, text string).
    They can be kept (`save_tagger`) and given to the operators, which train where they get none."""
    p = tagger.initial(TAGS, hidden=how.hidden)
    slots = _slots(documents.sparkSession, how.shards)
    sample = _sampled(documents, how).repartition(how.shards, F.element_at(F.array(*(F.lit(s).cast("bigint") for s in slots)), F.col("shard") + 1))
    labelled = checkpointed(sample.mapInArrow(_label(names), f"shard int, key bigint, text string, spans {_SPANS}"))
    for round_ in range(how.rounds):
        rows = labelled.mapInArrow(_train_shards(names, p, how, decoding, round_), "shard int, params binary, loss double").collect()  # one row per shard
        if not rows:
            break
        shards = [_unpack(bytes(r["params"]), p) for r in sorted(rows, key=lambda r: r["shard"])]
        p = {k: np.mean([s[k] for s in shards], axis=0).astype(np.float32) for k in p}
    return p


def save_tagger(spark: SparkSession, p: dict[str, np.ndarray], path: str) -> None:
    """Writes the parameters as a small table."""
    rows = [(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in sorted(p.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, raw binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_tagger(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    rows = spark.read.parquet(path).collect()  # one row per array of the tagger
    return {r["name"]: np.frombuffer(bytes(r["raw"]), np.float32).reshape(r["shape"]) for r in rows}


def _find(names: list[tuple[str, str]], p: dict, how: Decoding):
    """Per text its mentions."""

    def find(texts: list[str]) -> Iterator[list[tuple[str, int, int]]]:
        rules = Rules(names)
        for found in decode(texts, p, rules, how):
            yield [(TYPES[k], a, b) for k, a, b in found]

    return find


def _emit_spans(find):
    def emit(batches):
        for batch in batches:
            row, kind, start, end = [], [], [], []
            for i, spans in enumerate(find(batch.column(1).to_pylist())):
                for k, s, e in spans:
                    row.append(i)
                    kind.append(k)
                    start.append(s)
                    end.append(e)
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "pii_type", "start_pos", "end_pos"])

    return emit


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a typed placeholder in place of each mention."""
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _emit_masked(find):
    def emit(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = list(find(texts))
            masked = pa.array([mask(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), masked, pa.array([len(s) for s in spans], pa.int64())], ["doc_id", "masked_text", "mentions"])

    return emit


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")).dropna()


def _spread(rows: DataFrame) -> DataFrame:
    """Few partitions with much to compute are cut into more; many stay as they are."""
    wanted = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted, "key")


def find_personal_information(
    documents: DataFrame, names: list[tuple[str, str]], *, doc_id: str = "doc_id", text: str = "text",
    parameters: dict[str, np.ndarray] | None = None, training: Training = Training(), decoding: Decoding = Decoding(),
) -> DataFrame:
    """doc_id, pii_type, start_pos, end_pos: every mention, in code points; end_pos is exclusive.

    Documents with a NULL id or text give no row, nor do empty texts; a repeated document gives its rows
    again; texts of any length are read whole; an empty table gives no row; other columns are ignored.
    """
    rows = _texts(documents, doc_id, text)
    find = _find(names, train_tagger(rows, names, training, decoding) if parameters is None else parameters, decoding)
    return _spread(rows).mapInArrow(_emit_spans(find), "doc_id bigint, pii_type string, start_pos bigint, end_pos bigint")


def mask_personal_information(
    documents: DataFrame, names: list[tuple[str, str]], *, doc_id: str = "doc_id", text: str = "text",
    parameters: dict[str, np.ndarray] | None = None, training: Training = Training(), decoding: Decoding = Decoding(),
) -> DataFrame:
    """doc_id, masked_text, mentions: each text with a placeholder like [EMAIL] for each mention.
    Documents with a NULL id or text are left out; texts without mentions come out unchanged."""
    rows = _texts(documents, doc_id, text)
    find = _find(names, train_tagger(rows, names, training, decoding) if parameters is None else parameters, decoding)
    return _spread(rows).mapInArrow(_emit_masked(find), "doc_id bigint, masked_text string, mentions bigint")


def p8_found(spark: SparkSession, sf_dir: str, training: Training = Training()) -> DataFrame:
    """The places and kinds of personal information in all documents."""
    return find_personal_information(table(spark, sf_dir, "documents"), lexicon(spark, sf_dir), training=training).distinct()


def p8_masked(spark: SparkSession, sf_dir: str, training: Training = Training()) -> DataFrame:
    """All documents with typed placeholders for personal information."""
    return mask_personal_information(table(spark, sf_dir, "documents"), lexicon(spark, sf_dir), training=training)


QUERIES = {"p8_found": p8_found, "p8_masked": p8_masked}
SQL: dict[str, str] = {}  # a learned tagger isn't expressible in SQL; tests/llm measure it on held-out text
