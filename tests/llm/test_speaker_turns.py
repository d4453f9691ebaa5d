import itertools
import math
import random
import re
from collections import Counter

import pytest

from timelode.llm.speaker_turns import MIX, Model, speaker_turns, spoken_pieces
from timelode.llm.speech import Speakers, clean, distance

PEOPLE = [("S1", "Alvorin", "Kestandri", "akestandri"), ("S2", "Bermitka", "Wickolund", "bwickolund"), ("S3", "Bermitta", "Zornaric", "bzornaric")]
SPEAKERS = "speaker_id string, given_name string, family_name string, handle string"
SEGMENTS = "id string, video_id string, start_seconds double, text string, confidence double, ord int"

LABELS = [
    "Alvorin Kestandri: hi", "alvorin: hi", "Kestandri, Alvorin: hi", "[Alvorin Kestandri] hi", "<v Alvorin Kestandri> hi", ">> Alvorin: hi", "@akestandri: hi",
    "Dr. Kestandri: hi", "A. Kestandri: hi", "KESTANDRI - hi", "SPEAKER S1 | hi", "S1: hi", "Alvorin Kestandri (host): hi", "Alvorin KESTTANDRI: hi", "— Alvorin: hi",
    "[00:01:02] alvorin: hi", "00:00:33.382 --> >> Alvorin: hi",
]


@pytest.mark.parametrize("text", LABELS)
def test_labels(text):
    parts = [(p, clean(t)) for p, t in Speakers(PEOPLE).split(text)]
    assert [(p[0][0], t) for p, t in parts if t] == [("S1", "hi")]


@pytest.mark.parametrize("text", ["Alvorin, you go on", "note: this matters", "step 2: wait", "we ask Kestandri.", "the page (see section 4)", "port 80: open", "read items[0] first"])
def test_no_labels(text):
    assert [p for p, _ in Speakers(PEOPLE).split(text)] == [None]


def test_label_within_a_segment():
    got = Speakers(PEOPLE).split("so it ends. Bermitka Wickolund: right, >> Alvorin: yes")
    assert [(p and p[0][0], clean(t)) for p, t in got] == [(None, "so it ends."), ("S2", "right,"), ("S1", "yes")]


def test_clean():
    assert clean("[00:00:01]  uhm, the the, you know, file *music* (see section 4) items[0] ♪ la ♪") == "the file (see section 4) items[0]"
    assert clean("(applause) uh... <laughter>") == "" and clean("") == ""


def test_distance():
    assert distance("abcd", "abdc", 3) == 1 and distance("abc", "xyz", 1) == 2


def turns(spark, rows):
    found = speaker_turns(spark.createDataFrame([(*r, 1) for r in rows], SEGMENTS), spark.createDataFrame(PEOPLE, SPEAKERS))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["start_ms"], r["id"], r["piece"])):
        out.setdefault((r["video_id"], r["turn"]["id"], r["turn"]["piece"]), []).append((r["id"], r["speaker_id"]))
    return [(v[0][0], v[-1][0], v[0][1]) for v in out.values()]


def test_turns_with_noise_pauses_and_buckets(spark):
    rows = [
        ("a", "v", 1.0, "Alvorin: one", 0.9), ("b", "v", 5.0, "Bermitka: lost in noise", 0.1), ("c", "v", 9.0, "two", None), ("d", "v", 20.0, "[music]", 0.9),
        ("e", "v", 80.0, "three", 0.9), ("f", "v", 90.0, "four. Bermitka: five", 0.9), ("g", "v", 3601.0, "six", 0.9), ("h", "v", 3610.0, "S2: seven", 0.3),
        ("a", "v", 1.0, "Alvorin: one", 0.9), ("n", None, 1.0, "x", 0.9), ("m", "v", None, "x", 0.9), ("o", "w", 1.0, "nobody is named here", 0.9),
    ]
    rows = list(dict.fromkeys(rows))
    assert turns(spark, rows) == [("a", "c", "S1"), ("e", "f", "S1"), ("f", "f", "S2"), ("g", "h", "S2")]


def spoken(spark, rows, **kw):
    got = spoken_pieces(spark.createDataFrame([(*r, 1) for r in rows], SEGMENTS), spark.createDataFrame(PEOPLE, SPEAKERS))
    return {r["id"]: r["speaker_id"] for r in got.collect()}


def talk(*lines, step=9.0):
    return [(f"{k:03d}", "v", k * step, text, 0.9) for k, text in enumerate(lines)]


FLOUR, PROXY = "recipes need flour and sugar and yeast", "the gateway proxy routes packets again"


def test_a_missing_label_is_inferred_from_words(spark):
    rows = talk("gateway proxy routes gateway packets " * 4, f"Alvorin: {FLOUR}", f"S2: {PROXY}", f"S1: {FLOUR}")
    assert spoken(spark, rows)["000"] == "S2"
    rows[0] = ("000", "v", 0.0, "flour and sugar need yeast " * 4, 0.9)
    assert spoken(spark, rows)["000"] == "S1"


def test_an_ambiguous_label_is_decided_by_words_or_by_transitions(spark):
    # "Bermitxa" is as near to Bermitka as to Bermitta.
    rows = talk(f"S2: {PROXY}", f"S3: {FLOUR}", f"S2: {PROXY}", f"S3: {FLOUR}", "Bermitxa: " + "gateway proxy routes gateway packets " * 4)
    assert spoken(spark, rows)["004"] == "S2"
    rows[4] = ("004", "v", 36.0, "Bermitxa: " + "flour and sugar need yeast " * 4, 0.9)
    assert spoken(spark, rows)["004"] == "S3"
    # With words that tell nothing, the speaker who follows S1 elsewhere in this video.
    for usual, other in (("S2", "S3"), ("S3", "S2")):
        lines = [f"S1: yes", f"{usual}: yes"] * 6 + [f"{other}: yes", f"{other}: yes", "S1: yes", "Bermitxa: yes"]
        assert spoken(spark, talk(*lines))["015"] == usual


def test_a_swapped_label_is_overruled_by_many_words_only(spark):
    who = ["S1", "S2", "S2"]
    said = [f"{who[k % 3]}: " + f"{(FLOUR, PROXY, PROXY)[k % 3]} " * (18, 9, 9)[k % 3] for k in range(120)]
    end = ["S1: " + FLOUR, "S1: " + f"{PROXY} " * 12, "S2: yes", "S1: " + f"{PROXY}"]
    got = spoken(spark, talk(*said, *end))
    assert got["121"] == "S2" and got["123"] == "S1" and got["120"] == "S1" and got["000"] == "S1"


def test_buckets_join_to_the_best_path(spark):
    """Ambiguous labels over many hours: the decoding by buckets equals a search of all paths."""
    rng = random.Random(5)
    lines = [rng.choice(["S1: yes", "S2: yes", "S3: no", "Bermitxa: flour", "Bermitxa: proxy", "Bermitxa: yes", "Bermitxa: and"]) for _ in range(60)]
    lines = [f"S2: {PROXY}", f"S3: {FLOUR}"] * 2 + lines
    got = spoken(spark, talk(*lines, step=700.0))
    people = Speakers(PEOPLE)
    labels = [dict(people.split(x)[-1][0]) for x in lines]
    texts = [re.findall(r"[^\W\d_]+", clean(people.split(x)[-1][1]).lower()) for x in lines]
    sure = [next(iter(c)) if len(c) == 1 else None for c in labels]
    profile, moves, last = Counter(), Counter(), None
    for s, words in zip(sure, texts, strict=True):
        if s:
            profile.update((s, w) for w in words)
            moves[last, s] += last is not None
            last = s
    telling = {w for _, w in profile if sum((s, w) in profile for s in ("S1", "S2", "S3")) <= 2}
    prior = {w: MIX * sum(profile[s, w] for s in ("S1", "S2", "S3")) for w in telling}
    model = Model([{"speaker": s, "total": sum(n for (x, w), n in profile.items() if x == s and w in telling)} for s in ("S1", "S2", "S3")], [{"before": a, "after": b, "n": n} for (a, b), n in moves.items() if n])
    steps = []
    for c, s, words in zip(labels, sure, texts, strict=True):
        times = Counter(w for w in words if w in telling)
        gains = [(x, sum(n * math.log1p((profile[x, w] - n * (x == s)) / prior[w]) for w, n in times.items())) for x in model.names]
        steps.append(model.states([{"speaker": x, "cost": d} for x, d in c.items()], sum(times.values()), gains))
    # Single states cut the path, so the search of all paths goes piece by piece.
    best, piece = [], []
    for k, (states, _) in enumerate(steps):
        piece.append(k)
        if len(states) == 1 or k == len(steps) - 1:
            options = [[int(x) for x in steps[i][0]] for i in piece]

            def score(path, piece=piece):
                total = 0.0
                for n, (i, s) in enumerate(zip(piece, path, strict=True)):
                    before = best[-1] if n == 0 and best else path[n - 1] if n else None
                    total += steps[i][1][list(steps[i][0]).index(s)] + (model.start[s] if before is None else model.move[before, s])
                return total

            best += max(itertools.product(*options), key=score)
            piece = []
    assert sum(len(x[0]) > 1 for x in steps) > 5
    assert [got[f"{k:03d}"] for k in range(len(lines))] == [model.names[k] for k in best]


def test_near_names_match_brute_force():
    rng = random.Random(2)
    people = [(f"P{i}", *("".join(rng.choice("abco") for _ in range(rng.choice([5, 6, 7]))) for _ in range(2)), "") for i in range(300)]
    speakers = Speakers(people)
    names = {w for _, g, f, _ in people for w in (g, f)}
    for _ in range(200):
        w = list(rng.choice(sorted(names)))
        w[rng.randrange(len(w))] = rng.choice("abcox")
        w = "".join(w)
        assert speakers.near(w) == {x for x in names if distance(w, x, 1) <= 1}


def test_empty_transcript(spark):
    assert turns(spark, []) == []
