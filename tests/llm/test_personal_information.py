import random

import numpy as np
import pytest

from timelode.llm import tagger
from timelode.llm.personal_information import Decoding, Training, decode, find_personal_information, load_tagger, mask, mask_personal_information, save_tagger, train_tagger
from timelode.llm.pii_rules import TYPES, Rules

ROOTS, LINKS, VOWELS, ENDS = ("Zal", "Mor", "Quin", "Tes"), ("v", "n", "st"), "aeio", ("rion", "tka", "lde")
NAMES = [(r + c + v + e, "given") for r in ROOTS for c in LINKS for v in VOWELS[:3] for e in ENDS[:2]]
NAMES += [(r + v + e, "family") for r in ("Wick", "Brask", "Corv") for v in VOWELS for e in ("lund", "ndri", "sson")]

CASES = [
    ("write to ann.lee+x@mail.example.", [("email", "ann.lee+x@mail.example")]),
    ("a [at] b [dot] example or a.b dot c at d-e dot test", [("email", "a [at] b [dot] example"), ("email", "a.b dot c at d-e dot test")]),
    ("scrivi a pia punto neri chiocciola posta punto example", [("email", "pia punto neri chiocciola posta punto example")]),
    ("sign in as admin @ console, pinned at Tool@1.2.3", []),
    ("call +49 (0)30 23125-347 or (617) 555-0163 ext. 12", [("phone", "+49 (0)30 23125-347"), ("phone", "(617) 555-0163 ext. 12")]),
    ("text two oh two, five five five, oh one three eight if", [("phone", "two oh two, five five five, oh one three eight")]),
    ("checksum 0063072052, ticket 41847-5045, see 10.1.2.3:80, isbn 97886569742, part 8727-30-7908", []),
    ("SSN 943-08-7215 id QQ 31 60 82 B DNI 00924312-B CF fnvlpr46t17z793q", [("national_id", x) for x in ("943-08-7215", "QQ 31 60 82 B", "00924312-B", "fnvlpr46t17z793q")]),
    ("at 198/A Wickulund Street, second floor", [("address", "198/A Wickulund Street")]),
    ("133, boulevard Corvasson. Büro: Braskolundstraße 238; via libera alle 31; street mode 16 is new", [("address", "133, boulevard Corvasson"), ("address", "Braskolundstraße 238")]),
    ("via Zalvarion Wickandri, 209", [("address", "via Zalvarion Wickandri, 209")]),
    ("Dr. Q. Braskesson and Wickilund, Mornetka met zalvetka corvandri", [("person", "Q. Braskesson"), ("person", "Wickilund, Mornetka"), ("person", "zalvetka corvandri")]),
    ("from Wicklund to Brasksson, my name is not important", []),
    ("", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_grammar(text, expected):
    assert [(k, text[s:e]) for k, s, e in Rules(NAMES).find(text)] == expected


def test_short_names_of_the_lexicon_count():
    rules = Rules([*NAMES, ("Anna", "given"), ("Lee", "family")])
    assert [(k, s, e) for k, s, e in rules.find("as Anna Lee showed; anna and lee are words here")] == [("person", 3, 11)]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tagger.initial(7, embed=4, hidden=3).items()}
    x, y = rng.integers(0, tagger.KINDS * tagger.FLAGS, (9, 2)), np.array([[0, 1, 2, 3, 0, 4, 6, 0, 0], [2, 3, 1, 3, 4, 5, 6, 0, 0]]).T
    _, g = tagger.gradients(p, x, y)
    for k in p:
        where = {"E": (x[2, 1] // tagger.FLAGS, 1), "T": (2, 3)}.get(k) or tuple(rng.integers(0, n) for n in p[k].shape)
        old, losses = p[k][where], []
        for d in (1e-4, -1e-4):
            p[k][where] = old + d
            losses.append(tagger.gradients(p, x, y)[0])
        p[k][where] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - g[k][where]) < 1e-4, k


def test_viterbi_is_the_best_path_that_tears_no_mention():
    rng = np.random.default_rng(1)
    e, t = [rng.standard_normal((n, 4)).astype(np.float32) for n in (6, 1, 4)], rng.standard_normal((4, 4)).astype(np.float32)
    may = tagger.allowed(4) == 0
    for scores, path in zip(e, tagger.viterbi(e, t), strict=True):
        fits = [q for q in np.ndindex(*[4] * len(scores)) if q[0] in (0, 1) and q[-1] in (0, 3) and all(may[a, b] for a, b in zip(q, q[1:], strict=False))]
        assert tuple(path) == max(fits, key=lambda q: sum(scores[i, k] for i, k in enumerate(q)) + sum(t[a, b] for a, b in zip(q, q[1:], strict=False)))


def test_only_surely_empty_text_is_left_out_of_the_search():
    rng = np.random.default_rng(2)
    left = 0
    for _ in range(40):
        sizes = rng.integers(0, 60, 4)
        e, t = rng.standard_normal((sizes.sum(), 7)).astype(np.float32), rng.standard_normal((7, 7)).astype(np.float32)
        e[:, 0] += rng.uniform(2, 5)
        starts = np.cumsum(sizes) - sizes
        expected = [tagger.spans_of(q) for q in tagger.viterbi([e[a : a + n] for a, n in zip(starts, sizes, strict=True) if n], t)]
        stretches, found = tagger.open_stretches(e, t, starts, sizes), {i: [] for i, n in enumerate(sizes) if n}
        for (i, a, _), q in zip(stretches, tagger.viterbi([e[starts[i] + a : starts[i] + b] for i, a, b in stretches], t), strict=True):
            found[i] += [(k, a + s, a + z) for k, s, z in tagger.spans_of(q)]
        assert list(found.values()) == expected
        left += sizes.sum() - sum(b - a for _, a, b in stretches)
    assert left > 0


def documents(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        who = f"{rng.choice(NAMES[:18])[0]} {rng.choice(NAMES[-12:])[0]}"
        mention = rng.choice([f"write to {who.split()[0].lower()}@mail.example now", f"as {who} showed last week", f"call 617-555-0{rng.randrange(100, 199)} today", "SSN 9%02d-12-3456 was seen" % rng.randrange(99), f"come to {rng.randrange(200)} Wickolund Street", "nothing to see here"])
        words = " ".join(rng.choice(["the", "build", "cache", "opens", "port 80", "we", "measure", "a", "queue"]) for _ in range(rng.choice([0, 5, 60])))
        rows.append((i, f"{words} {mention} {words}", "x", 1))
    return rows


SMALL = Training(train_documents=400, shards=3, rounds=5, windows=1200, hidden=32, mining=3)


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in documents(500, 7)], "key bigint, text string")
    return train_tagger(df, NAMES, SMALL)


def labelled(rows):
    rules = Rules(NAMES)
    return {(i, *m) for i, text, *_ in rows if i is not None and text for m in rules.find(text)}


def test_held_out_mentions_and_dirt(spark, trained):
    rows = documents(600, 1)
    rows += [(9001, None, "x", 1), (None, "a@b.example", "x", 1), (9002, "", "x", 1), (9003, "the build cache opens " * 4000 + "write to zalvarion@mail.example now", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, pii_type int")
    found = [tuple(r) for r in find_personal_information(df, NAMES, parameters=trained).collect()]
    expected = labelled(rows)
    assert len(set(found)) == len(found)
    both = set(found) & expected
    assert len(both) >= 0.9 * len(expected) and len(both) >= 0.9 * len(found)
    assert any(i == 9003 for i, *_ in both)
    # A repeated document gives its rows again.
    twice = find_personal_information(df.where("doc_id < 50").unionAll(df.where("doc_id < 50")), NAMES, parameters=trained)
    assert sorted(tuple(r) for r in twice.collect()) == sorted([r for r in found if r[0] < 50] * 2)


def test_the_tagger_finds_not_the_grammar(spark):
    """Without training there is next to no true case, whatever the grammar knows."""
    rows = documents(300, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, pii_type int")
    found = {tuple(r) for r in find_personal_information(df, NAMES, parameters=tagger.initial(1 + 3 * len(TYPES))).collect()}
    assert len(found & labelled(rows)) <= 0.02 * len(labelled(rows))


def test_windows_of_a_long_text_agree(trained):
    """Where windows lie doesn't change what is found, nor do the texts beside it."""
    rows = documents(120, 5)
    long, rules = " ".join(r[1] for r in rows), Rules(NAMES)
    whole = list(decode([long], trained, rules, Decoding()))[0]
    other = list(decode(["x", long, ""], trained, rules, Decoding(width=512, overlap=96, chunk=100)))
    assert other[0] == [] and other[2] == [] and len(set(whole) & set(other[1])) >= 0.95 * len(whole)


def test_parameters_can_be_kept(spark, trained, tmp_path):
    save_tagger(spark, trained, f"file://{tmp_path}/tagger")
    again = load_tagger(spark, f"file://{tmp_path}/tagger")
    assert again.keys() == trained.keys() and all((again[k] == trained[k]).all() for k in trained)


def test_training_is_the_same_whatever_the_partitions(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in documents(60, 7)], "key bigint, text string")
    how = Training(train_documents=40, shards=2, rounds=2, windows=40, hidden=8, mining=1)
    a, b = train_tagger(df, NAMES, how), train_tagger(df.repartition(5), NAMES, how)
    assert all((a[k] == b[k]).all() for k in a)


def test_masking(spark, trained):
    assert mask("x a@b.example y", [("email", 2, 13)]) == "x [EMAIL] y"
    df = spark.createDataFrame(documents(60, 2), "doc_id bigint, text string, key string, pii_type int")
    rows = mask_personal_information(df, NAMES, parameters=trained).collect()
    assert len(rows) == 60 and all(r["masked_text"] for r in rows) and any("[EMAIL]" in r["masked_text"] for r in rows)
    assert find_personal_information(df.limit(0), NAMES, training=Training(shards=2, rounds=1)).count() == 0
