"""Speech transcripts into clean speaker turns.

A hidden Markov model over runs of speech, the stretches from one label to the next: its states are the
participants of the video; a run's label emits with a cost per edit, or at a price where it names somebody else;
its words emit with the participant's language profile; transitions between participants are estimated per video.
Every run's speaker is that of the best path. Videos are decoded in time buckets that are summed up and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm.speech import Speakers, clean
from timelode.operators.scan import running_max
from timelode.session import checkpointed
from timelode.sources.tables import media_ms, records, table

NOISE_BELOW = 0.30
PAUSE_MS = 60_000
BUCKET_MS = 3_600_000
MAX_SPEAKERS = 100_000
#: Weights of the model in nats: an edit of a label; a label that names somebody else; the share of the words'
#: log-likelihood, and the number of words beyond which a run's words don't weigh more together.
EDIT_COST, SLIP, WORD_WEIGHT, MOST_WORDS = 4.0, 40.0, 0.25, 40
#: Share of the video's own language mixed into each profile, and moves mixed into each participant's transitions.
MIX, MOVE_PRIOR = 0.015, 2.0

_CANDS = "array<struct<speaker:string,cost:double>>"
_CANDS_ARROW = pa.list_(pa.struct([("speaker", pa.string()), ("cost", pa.float64())]))


def _parse(people: list[tuple]):
    def parse(batches):
        speakers = Speakers(people)
        for batch in batches:
            row, piece, cands, text = [], [], [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                parts = speakers.split(raw)
                for j, (label, speech) in enumerate(parts):
                    said = clean(speech)
                    if label is None and not said:
                        continue
                    row.append(i)
                    piece.append(j)
                    cands.append(None if label is None else [{"speaker": s, "cost": float(c)} for s, c in label])
                    text.append(said)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(piece, pa.int32()), pa.array(cands, _CANDS_ARROW), pa.array(text, pa.string())],
                ["video_id", "start_ms", "id", "piece", "cands", "text"],
            )

    return parse


def speech_pieces(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """video_id, start_ms, id, piece, cands, text: each segment cut at its labels and cleaned.

    `speakers` is a small dimension (checked against MAX_SPEAKERS) that every task holds.
    """
    people = [tuple(r) for r in speakers.select("speaker_id", "given_name", "family_name", "handle").dropna(subset=["speaker_id", "given_name", "family_name"]).distinct().limit(MAX_SPEAKERS + 1).collect()]
    if len(people) > MAX_SPEAKERS:
        raise ValueError(f"more than {MAX_SPEAKERS} speakers")
    people = sorted((i, g, f, h or "") for i, g, f, h in people)
    speech = segments.where("confidence IS NULL OR NOT confidence < %s" % NOISE_BELOW)
    return (
        speech.select("video_id", media_ms("start_seconds").alias("start_ms"), "id", "text")
        .dropna()
        .mapInArrow(_parse(people), f"video_id string, start_ms bigint, id string, piece int, cands {_CANDS}, text string")
    )


def _ord() -> Column:
    return F.struct("start_ms", "id", "piece")


def spoken_pieces(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """video_id, start_ms, id, piece, text, speaker_id: all speech with the speaker of the likeliest path.

    Segments with a NULL id, video, start or text are left out, as is noise (confidence below NOISE_BELOW;
    NULL counts as speech). Speech of a video in which nobody is ever named has no speaker and is left out.
    Equal rows count once; segments that start together are ordered by id; an empty table gives no row.
    """
    pieces = checkpointed(speech_pieces(segments, speakers)).withColumn("bucket", F.floor(F.col("start_ms") / BUCKET_MS)).withColumn("ord", _ord())
    # A run goes from one label to the next; what precedes a video's first label is a run too.
    labelled = pieces.withColumn("label", F.when(F.col("cands").isNotNull(), F.struct(F.col("ord").alias("run"), "cands")))
    runs = running_max(labelled, ["video_id"], "bucket", ["start_ms", "id", "piece"], "label", "gov", inclusive=True)
    none = F.struct(F.lit(-1).cast("bigint").alias("start_ms"), F.lit("").alias("id"), F.lit(-1).alias("piece"))
    runs = checkpointed(
        runs.select("video_id", "bucket", "start_ms", "id", "piece", "text", F.col("cands").alias("own"), F.coalesce("gov.run", none).alias("run"), F.col("gov.cands").alias("cands"))
    )
    decided = _decoded(runs)
    # A run of any length is joined by time buckets.
    here = runs.select("video_id", "run", "bucket").distinct().join(decided, ["video_id", "run"])
    return runs.where("text <> ''").join(here, ["video_id", "run", "bucket"]).select("video_id", "start_ms", "id", "piece", "text", F.col("speaker").alias("speaker_id"))


def _evidence(runs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """What the words say: (video_id, bucket, r, speaker, gain) of runs, the speaker NULL for the number of telling
    words, and (video_id, speaker, total) of the profiles.

    Language profiles are counts of words in runs under a label with one meaning. Only words that one or two of a
    video's participants use tell them apart. A run's own words don't count for its own label.
    """
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    words = runs.where("text <> ''").select("video_id", F.floor(F.col("run.start_ms") / BUCKET_MS).alias("bucket"), "r", "sure", word).where("word <> ''")
    profile = words.where("sure IS NOT NULL").groupBy("video_id", "word", F.col("sure").alias("speaker")).agg(F.count("*").alias("n"))
    telling = profile.groupBy("video_id", "word").agg(F.collect_list(F.struct("speaker", "n")).alias("users"), F.sum("n").alias("all")).where("size(users) <= 2")
    telling = checkpointed(telling)
    totals = telling.select("video_id", F.explode("users").alias("u")).groupBy("video_id", F.col("u.speaker").alias("speaker")).agg(F.sum("u.n").alias("total"))
    told = words.repartition(parts, "video_id", "word").join(telling.repartition(parts, "video_id", "word"), ["video_id", "word"])
    told = told.groupBy("video_id", "word", "bucket", "r", "sure").agg(F.count("*").alias("times"), F.first("users").alias("users"), F.first("all").alias("all"))

    def gain(u: Column) -> Column:
        others = u["n"] - F.when(u["speaker"].eqNullSafe(F.col("sure")), F.col("times")).otherwise(0)
        return F.struct(u["speaker"].alias("speaker"), (F.col("times") * F.log1p(others / (MIX * F.col("all")))).alias("gain"))

    counted = F.array(F.struct(F.lit(None).cast("string").alias("speaker"), F.col("times").cast("double").alias("gain")))
    each = told.select("video_id", "bucket", "r", F.concat(F.transform("users", gain), counted).alias("gains")).select("video_id", "bucket", "r", F.explode("gains").alias("g"))
    return each.groupBy("video_id", "bucket", "r", F.col("g.speaker").alias("speaker")).agg(F.sum("g.gain").alias("gain")), totals


_RUN = "struct<start_ms:bigint,id:string,piece:int>"
_STEP = f"video_id string, bucket bigint, run {_RUN}, speaker string, firsts array<string>, lasts array<string>, scores array<double>"
_ENDS = "video_id string, bucket bigint, first string, last string"


def _decoded(runs: DataFrame) -> DataFrame:
    """video_id, run, speaker: the best path of the model over the runs of every video.

    Buckets are summed up on their own, from each state of their first run to each of their last (a max-plus
    product); one summary per bucket is followed along the video; buckets with more than one way are walked
    again between the states found for their ends.
    """
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sure = F.when(F.size("cands") == 1, F.col("cands")[0]["speaker"])
    runs = runs.withColumn("sure", sure).withColumn("r", F.xxhash64("run"))
    heads = runs.where("own IS NOT NULL").select("video_id", "bucket", "start_ms", "id", "piece", "run", "r", "cands", "sure")
    moves = running_max(heads.withColumn("mark", F.when(F.col("sure").isNotNull(), F.struct("run", "sure"))), ["video_id"], "bucket", ["start_ms", "id", "piece"], "mark", "prior")
    moves = moves.where("sure IS NOT NULL AND prior IS NOT NULL").groupBy("video_id", F.col("prior.sure").alias("before"), F.col("sure").alias("after")).agg(F.count("*").alias("n"))
    gains, totals = _evidence(runs, parts)

    # One row per video, of the size of its participants (squared at most), copied to its buckets.
    participants = heads.select("video_id", F.explode("cands.speaker").alias("speaker")).distinct()
    cast = participants.join(totals, ["video_id", "speaker"], "left").groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("speaker", F.coalesce("total", F.lit(0)).cast("double").alias("total")))).alias("cast"))
    paths = moves.groupBy("video_id").agg(F.collect_list(F.struct("before", "after", F.col("n").cast("double").alias("n"))).alias("moves"))
    model = checkpointed(cast.join(paths, "video_id", "left"))
    opening = runs.where("cands IS NULL").select("video_id", "run", "r").distinct().select("video_id", F.lit(-1).cast("bigint").alias("bucket"), "run", "r", F.lit(None).cast(_CANDS).alias("cands"))
    steps = heads.select("video_id", "bucket", "run", "r", "cands").unionByName(opening)
    models = model.join(steps.select("video_id", "bucket").distinct(), "video_id")
    seen = steps.unionByName(gains, allowMissingColumns=True).unionByName(models, allowMissingColumns=True)
    seen = checkpointed(seen.repartition(parts, "video_id", "bucket"))

    summed = checkpointed(seen.groupBy("video_id", "bucket").applyInArrow(_sum_up, _STEP))
    plain = summed.where("run IS NOT NULL").select("video_id", "run", "speaker")
    ends = summed.where("run IS NULL").select("video_id", "bucket", "firsts", "lasts", "scores")
    several = ends.where("size(scores) > 1").select("video_id", "bucket")
    chosen = (
        ends.unionByName(model.withColumn("bucket", F.lit(None).cast("bigint")), allowMissingColumns=True)
        .join(several.select("video_id").distinct(), "video_id", "left_semi")
        .groupBy("video_id")
        .applyInArrow(_choose_ends, _ENDS)
    )
    again = seen.join(several, ["video_id", "bucket"], "left_semi").unionByName(chosen, allowMissingColumns=True)
    walked = again.repartition(parts, "video_id", "bucket").groupBy("video_id", "bucket").applyInArrow(_walk_between, f"video_id string, run {_RUN}, speaker string")
    return plain.unionByName(walked)


class Model:
    """The hidden Markov model of one video: its participants, the transitions between them, emissions of runs."""

    def __init__(self, cast: list[dict], moves: list[dict] | None):
        self.names = [c["speaker"] for c in cast]
        self.at = {n: k for k, n in enumerate(self.names)}
        n = len(self.names)
        counts = np.zeros((n, n))
        for m in moves or ():
            counts[self.at[m["before"]], self.at[m["after"]]] = m["n"]
        self.start = np.log((counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * n))
        self.move = np.log((counts + MOVE_PRIOR * np.exp(self.start)) / (counts.sum(axis=1, keepdims=True) + MOVE_PRIOR))
        #: A state that another beats by more than twice what transitions can differ is on no best path.
        low, high = min(self.move.min(), self.start.min()), max(self.move.max(), self.start.max())
        self.most = 2 * (high - low) + 1e-9
        totals = np.array([c["total"] for c in cast])
        self.unseen = np.log(MIX * max(totals.sum(), 1) / (MIX * max(totals.sum(), 1) + totals))

    def states(self, cands: list[dict] | None, length: float, gains: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
        """The participants that may speak a run, and their emissions: the label's edits, or the price of a label
        that names somebody else, and the words' likelihood against the video's own language."""
        e = np.zeros(len(self.names))
        if cands is not None:
            e -= SLIP
            for c in cands:
                e[self.at[c["speaker"]]] = -EDIT_COST * c["cost"]
        if length:
            words = length * self.unseen
            for speaker, gain in gains:
                words[self.at[speaker]] += gain
            e += WORD_WEIGHT * min(1.0, MOST_WORDS / length) * words
        keep = np.nonzero(e >= e.max() - self.most)[0]
        return keep, e[keep]

    def forward(self, steps: list[tuple[np.ndarray, np.ndarray]], firsts: np.ndarray | None = None):
        """Best scores from each state of the first step to each of the last, and the way back."""
        states, e = steps[0]
        score = np.full((len(states), len(states)), -np.inf)
        np.fill_diagonal(score, e)
        if firsts is not None:
            score = score[np.searchsorted(states, firsts)]
        back = []
        for after, e in steps[1:]:
            ways = score[:, :, None] + self.move[np.ix_(states, after)]
            back.append(ways.argmax(axis=1))
            score = ways.max(axis=1) + e
            states = after
        return score, back

    @staticmethod
    def path(steps: list, back: list, first: int, last: int) -> list[int]:
        """The states of the best way that ends in the last step's state number `last`."""
        out = [last]
        for way in reversed(back):
            out.append(int(way[first, out[-1]]))
        return [int(states[k]) for (states, _), k in zip(steps, reversed(out), strict=True)]


def _opened(table: pa.Table) -> tuple[Model, list[dict], list[tuple[np.ndarray, np.ndarray]]]:
    rows = table.to_pylist()
    model = next(Model(r["cast"], r["moves"]) for r in rows if r["cast"] is not None)
    runs = sorted((r for r in rows if r["run"] is not None), key=lambda r: (r["run"]["start_ms"], r["run"]["id"], r["run"]["piece"]))
    lengths = {r["r"]: r["gain"] for r in rows if r["gain"] is not None and r["speaker"] is None}
    gains: dict[int, list[tuple[str, float]]] = {}
    for r in rows:
        if r["gain"] is not None and r["speaker"] is not None:
            gains.setdefault(r["r"], []).append((r["speaker"], r["gain"]))
    return model, runs, [model.states(r["cands"], lengths.get(r["r"], 0.0), gains.get(r["r"], [])) for r in runs]


_RUN_ARROW = pa.struct([("start_ms", pa.int64()), ("id", pa.string()), ("piece", pa.int32())])
_STEP_ARROW = pa.schema(
    [("video_id", pa.string()), ("bucket", pa.int64()), ("run", _RUN_ARROW), ("speaker", pa.string())]
    + [("firsts", pa.list_(pa.string())), ("lasts", pa.list_(pa.string())), ("scores", pa.list_(pa.float64()))]
)


def _sum_up(table: pa.Table) -> pa.Table:
    """The summary of a bucket, and where there is but one way through it, the speakers of its runs."""
    if not any(c is not None for c in table["cast"].to_pylist()):
        return _STEP_ARROW.empty_table()  # nobody is named in the video
    model, runs, steps = _opened(table)
    score, back = model.forward(steps)
    key = {"video_id": table["video_id"][0].as_py(), "bucket": table["bucket"][0].as_py()}
    firsts, lasts = ([model.names[k] for k in steps[i][0]] for i in (0, -1))
    out = [key | {"firsts": firsts, "lasts": lasts, "scores": score.ravel().tolist()}]
    if score.size == 1:
        out += [key | {"run": r["run"], "speaker": model.names[k]} for r, k in zip(runs, model.path(steps, back, 0, 0), strict=True)]
    return pa.Table.from_pylist(out, _STEP_ARROW)


def _choose_ends(table: pa.Table) -> pa.Table:
    """The states of the best path at both ends of every bucket of a video with more than one way."""
    rows = table.to_pylist()
    model = next(Model(r["cast"], r["moves"]) for r in rows if r["cast"] is not None)
    buckets = sorted((r for r in rows if r["firsts"] is not None), key=lambda r: r["bucket"])
    score, back, before = None, [], None
    for r in buckets:
        firsts, lasts = (np.array([model.at[n] for n in r[c]]) for c in ("firsts", "lasts"))
        within = np.array(r["scores"]).reshape(len(firsts), len(lasts))
        if score is None:
            enter, came = model.start[firsts], None
        else:
            ways = score[:, None] + model.move[np.ix_(before, firsts)]
            enter, came = ways.max(axis=0), ways.argmax(axis=0)
        ways = enter[:, None] + within
        back.append((firsts, lasts, came, ways.argmax(axis=0)))
        score, before = ways.max(axis=0), lasts
    out, last = [], int(score.argmax())
    for r, (firsts, lasts, came, entered) in zip(reversed(buckets), reversed(back), strict=True):
        first = int(entered[last])
        if len(firsts) * len(lasts) > 1:
            out.append({"video_id": r["video_id"], "bucket": r["bucket"], "first": model.names[firsts[first]], "last": model.names[lasts[last]]})
        last = int(came[first]) if came is not None else 0
    return pa.Table.from_pylist(out, pa.schema([("video_id", pa.string()), ("bucket", pa.int64()), ("first", pa.string()), ("last", pa.string())]))


def _walk_between(table: pa.Table) -> pa.Table:
    """The speakers of a bucket's runs between the states chosen for its ends."""
    model, runs, steps = _opened(table)
    ends = next(r for r in table.select(["first", "last"]).to_pylist() if r["first"] is not None)
    _, back = model.forward(steps, np.array([model.at[ends["first"]]]))
    path = model.path(steps, back, 0, int(np.searchsorted(steps[-1][0], model.at[ends["last"]])))
    out = [{"video_id": table["video_id"][0].as_py(), "run": r["run"], "speaker": model.names[k]} for r, k in zip(runs, path, strict=True)]
    return pa.Table.from_pylist(out, pa.schema([("video_id", pa.string()), ("run", _RUN_ARROW), ("speaker", pa.string())]))


def speaker_turns(segments: DataFrame, speakers: DataFrame, *, pause_ms: int = PAUSE_MS) -> DataFrame:
    """The pieces of `spoken_pieces` with `turn`, the place of the piece that opens their turn: a turn ends
    when the speaker changes or the next spoken segment starts more than `pause_ms` after the one before."""
    spoken = spoken_pieces(segments, speakers).withColumn("bucket", F.floor(F.col("start_ms") / BUCKET_MS)).withColumn("ord", _ord())
    spoken = checkpointed(spoken.withColumn("me", F.struct("ord", "speaker_id")))
    order = ["start_ms", "id", "piece"]
    after = running_max(spoken, ["video_id"], "bucket", order, "me", "last")
    opens = (
        F.col("last").isNull()
        | (F.col("last.speaker_id") != F.col("speaker_id"))
        | (F.col("start_ms") - F.col("last.ord.start_ms") > pause_ms)
    )
    marked = after.withColumn("opening", F.when(opens, F.col("ord")))
    return running_max(marked, ["video_id"], "bucket", order, "opening", "turn", inclusive=True)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = records(spark, sf_dir, "transcript_segments", "id", "video_id", "start_seconds", "text", "confidence")
    return speaker_turns(segments, table(spark, sf_dir, "speakers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn: its speaker and the first and last segment with speech of it."""
    place = F.struct("start_ms", "id")
    return (
        _turns(spark, sf_dir)
        .groupBy("video_id", "turn")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("speaker_id").alias("speaker_id"))
        .select("video_id", F.col("first.id").alias("first_segment_id"), F.col("last.id").alias("last_segment_id"), "speaker_id")
        .distinct()
    )


def p4_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of all turns, one row per piece, in the order (video_id, start_ms, segment_id, piece)."""
    return _turns(spark, sf_dir).select(
        "video_id", F.col("turn.id").alias("turn_segment_id"), F.col("turn.piece").alias("turn_piece"), "speaker_id", "start_ms", F.col("id").alias("segment_id"), "piece", "text"
    )


QUERIES = {"p4_found": p4_found, "p4_speech": p4_speech}
SQL: dict[str, str] = {}  # label lookup by edit distance and decoding aren't expressible in SQL
