"""Toxic words of many rare forms are told by their beginnings."""

import random

import numpy as np

from polyglossa.llm import toxicity


COMMON = ["worthless", "pathetic", "disgusting", "moronic"]


def texts(seed, n, toxic):
    """toxic: 0 for none; else every other text has common words, and every other one rare forms of two words."""
    r = random.Random(seed)
    parts = ["ung", "heit", "schen", "lich", "ber", "kein", "zu", "erst", "ver", "enpf", "chau", "tra", "loser", "wei", "quen", "vor"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 3)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(r.randint(30, 90))]
        if toxic:
            for at in r.sample(range(len(words)), r.randint(2, 4)):
                words[at] = r.choice(["gromp", "vazik"]) + "".join(r.choices("abcdefgh", k=3)) if toxic > 1 else r.choice(COMMON)
            toxic = 3 - toxic
        out.append(" ".join(words).encode())
    return out


def test_rare_forms():
    model = toxicity.train(texts(1, 240, 1), texts(2, 700, 0), 32)
    scorer = toxicity.Scorer(model.toxic, model.ordinary, model.window)
    x = (scorer.features(texts(3, 200, 1) + texts(4, 400, 0)) - np.array(model.mean)) / np.array(model.scale)
    score = 1 / (1 + np.exp(-(model.weights[0] + x @ np.array(model.weights[1:]))))
    assert (score[:200] >= 0.7).mean() > 0.9, (score[:200] >= 0.7).mean()
    assert (score[200:] >= 0.7).mean() < 0.02


def test_typical():
    found = toxicity.typical(texts(1, 240, 1), texts(2, 700, 0))
    assert {b"gromp", b"vazik"} <= set(found[-6:])  # nearest to the text
    assert all(w.startswith((b"gromp", b"vazik", *(w.encode() for w in COMMON))) for w in found)
    assert found == toxicity.typical(texts(1, 240, 1)[::-1], texts(2, 700, 0)[::-1])
