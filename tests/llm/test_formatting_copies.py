import random
import re

import pytest

from timelode.llm.formatting_copies import code_hashes, copy_groups, same_code, same_codes

COPIES = [
    ("SELECT a, b FROM t;", "select a\n,b from t"),
    ('{"name": "x1", "port": 80, "tags": [a, b]}', "PORT=80\nTAGS=\"[a, b]\"\nNAME=x1"),
    ("name: x1\nurl: http://a.b.example:78/c\nport: 80", '{”url”:\xa0”http://a.b.example:78/c”, ”port”: 80, ”name”: ”x1”}'),
    ("tool run it --a 1 --b=two words", "$ tool  run it \\\n --b two words --a=1"),
    ("{\n  host: `n6`,\n  name: `k`,\n}", "name: k\nhost: n6"),
    ("def f(x):\n    return x", "DEF F(X): RETURN X ;"),
    ("naïve_Ünit = Straße", "NAÏVE_ÜNIT  =  straße"),
]
OTHERS = [
    ("a b", "ab"), ("a_b", "a b"), ("name: x\nport: 80", "name: 80\nport: x"), ("tags: [a, b]\nname: x", "tags: [b, a]\nname: x"),
    ("FROM a\nRUN b", "RUN b\nFROM a"), ("tool run --a 1", "run tool --a 1"), ("x = 1\nprint(x)", "print(x)\nx = 1"), ("1 2", "1 2 2"),
]


@pytest.mark.parametrize("a,b", COPIES)
def test_copies(a, b):
    h = code_hashes([a, b])
    assert (h[0] == h[1]).all() and same_code(a, b)


@pytest.mark.parametrize("a,b", OTHERS)
def test_others(a, b):
    h = code_hashes([a, b])
    assert (h[0] != h[1]).all() and not same_code(a, b)


def test_words_alone_match_brute_force():
    texts = [f"{a}{s}{b}" for a in ("foo", "bar1", "x_y", "é😀z") for b in ("foo", "9") for s in (" ", "\n", "-", "", ", (")] + ["", "  ", "w" * 200_000]
    h = code_hashes(texts)
    words = [tuple(re.findall(r"\w+", t.lower())) for t in texts]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert ((h[i] == h[j]).all()) == (a == b)
    assert not h[texts.index("")].any() and not h[texts.index("  ")].any()


def test_groups_with_dirt(spark):
    rows = [("b", "a b"), ("a", "A, B!"), ("c", "b a"), ("d", None), (None, "a b"), ("e", " ?! "), ("f", ""), ("a", "A, B!")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "id string, code string, h1 int, first string")
    assert {tuple(r) for r in copy_groups(df, row_id="id", code="code").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert copy_groups(df.limit(0), row_id="id", code="code").count() == 0


@pytest.mark.parametrize("third", [False, True])
def test_true_collisions_are_told_apart(spark, monkeypatch, third):
    from timelode.llm import formatting_copies as fc

    hashed = fc._hash_codes

    def colliding(batches):
        import pyarrow as pa

        for b in hashed(batches):
            one = pa.array([1] * len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), one, one, one if third else b.column(4)], b.schema.names)

    monkeypatch.setattr(fc, "_hash_codes", colliding)
    df = spark.createDataFrame([("a", "x y"), ("b", "X, Y"), ("c", "z"), ("d", "Z!"), ("e", "q")], "id string, code string")
    assert {tuple(r) for r in fc.copy_groups(df, row_id="id", code="code").collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")}


def test_walks_of_many_pairs_match_brute_force():
    rng = random.Random(3)

    def text():
        return "".join(rng.choice(["ab", "Ab", "a", "b", " ", ".", "\n", "(", "_", "é", "😀", "x" * rng.choice([1, 40])]) for _ in range(rng.choice([0, 1, 5, 30])))

    def loose(t):  # the same words, written in another way
        return "".join(rng.choice([c, c.upper() if len(c.upper()) == 1 else c]) if re.match(r"\w", c) else rng.choice([" ", "..", "\n\t"]) for c in t) + rng.choice(["", " ;"])

    a = [text() for _ in range(500)]
    b = [loose(t) if rng.random() < 0.6 else text() for t in a]
    a, b = a + ["w" * 100_000 + " end", "w" * 100_000], b + ["W" * 100_000 + "\n\nEND", "w" * 99_999]
    words = lambda t: re.findall(r"\w+", t.lower())
    assert same_codes(a, b).tolist() == [bool(words(x)) and words(x) == words(y) for x, y in zip(a, b, strict=True)]
    fields = [(f"{{a: {i % 3}, b: {j % 3}}}", f"B={j % 2}\nA={i % 2}") for i in range(3) for j in range(3)]
    assert same_codes(*map(list, zip(*fields, strict=True))).tolist() == [i < 2 and j < 2 for i in range(3) for j in range(3)]
    assert same_codes([], []).tolist() == []


def test_a_code_shared_by_most_rows_is_spread(spark):
    df = spark.createDataFrame([(f"{i:04d}", rng_text(i)) for i in range(400)], "id string, code string")
    got = {r["row_id"]: r["keep_id"] for r in copy_groups(df, row_id="id", code="code").collect()}
    assert got == {f"{i:04d}": "0000" if i % 3 else f"{i:04d}" if i else "0000" for i in range(400)}


def rng_text(i):
    return "Let x = 1;" + " " * (i % 5) if i % 3 or not i else f"let y{i} = 2"
