"""No text, however long or odd, makes a search over it quadratic."""

import time

import pytest

from timelode.llm.formatting_copies import code_hashes, same_code
from timelode.llm.pii_rules import Rules
from timelode.llm.speech import Speakers, clean

ODD = ["a" * 200_000, "a dot " * 50_000, "a.b@" * 50_000, "1 " * 100_000, "+" + "1" * 100_000 + "x", "one " * 60_000, "Via A, " * 30_000, " " * 200_000 + ":", "(" + "a" * 100_000, "a: " * 50_000, "[a " * 50_000, "x --a 1" + " --b 2" * 50_000]


@pytest.mark.parametrize("text", ODD, ids=[t[:6] for t in ODD])
def test_linear(text):
    began = time.time()
    Rules([("Zalvarion", "given")]).find(text)
    for _, speech in Speakers([("S1", "Alvorin", "Kestandri", "a")]).split(text):
        clean(speech)
    assert same_code(text, text + " ;") == bool(code_hashes([text])[0, 0])
    assert time.time() - began < 10
