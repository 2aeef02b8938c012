"""Sums of constants: doubled, long, and against strings that are really added."""

import random
import time

import pytest

from polyglossa.llm import secrets


def found(text):
    return {text[a:b] for a, k, b in secrets.scan(text) if secrets.KINDS[k] == "literal"}


def test_doublings():
    text = 'k0 = "aB3$zQ9!"\n' + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(64)) + "token = k64\n"
    began = time.time()
    assert found(text) == {"aB3$zQ9!"} and time.time() - began < 1
    text = 'k0 = "aB3$zQ9!"\n' + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(5000)) + "token = k5000\n"
    began = time.time()
    assert found(text) == {"aB3$zQ9!"} and time.time() - began < 2


def test_long_sums():
    n = 1_000_000
    text = "token = " + " + ".join(['"aB3$zQ9!"'] * n)
    began = time.time()
    assert sum(k == 3 for _, k, _ in secrets.scan(text)) == n and time.time() - began < 25  # in proportion to 14 MB
    text = 'part = "Zx81kQpL"\ntoken = part' + " + part" * 100_000
    began = time.time()
    assert found(text) == {"Zx81kQpL"} and time.time() - began < 3


@pytest.mark.parametrize("seed", range(40))
def test_added_values(seed):
    """Counts, ends and words of a sum are those of the string."""
    r = random.Random(seed)
    parts = ["exam", "ple", "<", ">", "x", "XX", "*", "$", "ab1", "Q", "pla", "ceholder", " ", "", "9-"]
    pieces = r.choices(parts, k=r.randint(1, 9))
    value = secrets.Value(pieces[0])
    for p in pieces[1:]:
        value.add(secrets.Value(p))
    whole = secrets.Value("".join(pieces))
    assert (value.counts, value.n, value.head, value.tail, value.worded) == (whole.counts, whole.n, whole.head, whole.tail, whole.worded)
    assert all(secrets.secret_literal(value, s) == secrets.secret_literal(whole, s) for s in range(5))


def test_unknown_terms_and_order():
    assert found('token = "aB3$zQ9!" + other') == set()
    assert found('a = "aB3$"\nb = a + "zQ9!"\na = "later"\napi_key = b + "77Yy"') == {"aB3$", "zQ9!", "77Yy"}
    assert found('token = "your" + "Zx81kQpL0vB2"') == set() and found('token = "yo" + "urZx81kQpL0vB2"') == set()
