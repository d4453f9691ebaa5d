from pyspark.sql import functions as F

from timelode.functions import code_rules as cr
from timelode.functions import text as tx


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


def test_truncated_collapses_and_cuts(spark):
    assert one(spark, "  a \n b c ", lambda c: tx.truncated(c, 20)) == "a b c"
    assert one(spark, "abcdefghij", lambda c: tx.truncated(c, 7)) == "abcd..."
    assert one(spark, None, lambda c: tx.truncated(c, 7)) is None


def test_clock_and_back(spark):
    assert one(spark, "01:02:03", tx.seconds_of_clock) == 3723
    assert one(spark, "02:03", tx.seconds_of_clock) == 123
    assert one(spark, "2 min", tx.seconds_of_clock) is None
    rows = spark.createDataFrame([(0.5,), (1.5,), (3723.2,), (-4.0,)], "c double").select(tx.clock(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["00:00:00", "00:00:02", "01:02:03", "00:00:00"]


def test_slug(spark):
    assert one(spark, "Perché è così? (2)", tx.slug) == "perche-e-cosi-2"
    assert one(spark, "Žluťoučký kůň", tx.slug) == "zlutoucky-kun" and one(spark, "Čeština ﬁn Søren x²", tx.slug) == "cestina-fin-sren-x2"
    assert one(spark, "!!!", tx.slug) is None and one(spark, "日本", tx.slug) is None and one(spark, None, tx.slug) is None


def test_chat_turns(spark):
    got = one(spark, "user: hi there\nassistant: well\nuser: x", tx.chat_turns)
    assert [(r["role"], r["content"]) for r in got] == [("user", "hi there"), ("assistant", "well"), ("user", "x")]


def test_normal_code(spark):
    assert one(spark, "\r\n    a = 1  \r\n\n\n\n      b\n", cr.normal_code) == "a = 1\n\n  b"
    assert one(spark, " \n ", cr.normal_code) == ""


def test_kinds(spark):
    cases = {
        "$ npm create vite@latest my-app": ("terminal_command", "bash"),
        '{"a": 1}': ("configuration", "json"),
        "<p>hello</p>": ("source_code", "html"),
        "def f():\n    return 1": ("source_code", "python"),
        "const x = 1;": ("source_code", "javascript"),
        "x=>y": ("source_code", "javascript"),
        "C:\\\\work> dir /s": ("terminal_command", "bash"),
        "name: a\nport: 1": ("configuration", "yaml"),
        "Traceback: it broke badly when it was run again": ("error_message", "other"),
        "src/app/main.py": ("file_path", "other"),
        "Save as": ("ui_label", "other"),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", cr.code_kind(F.col("c")).alias("k"))
    assert {r["c"]: tuple(r["k"]) for r in df.collect()} == cases
