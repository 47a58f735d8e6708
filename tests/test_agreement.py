"""Agreement of texts: what difflib gives, without going over the lists again for every match."""

import difflib
import random

from lectern.operators import evaluate as E


def test_ratio_equals_the_sequence_matcher(monkeypatch):
    rng = random.Random(5)
    for most in (2, 30, 10**6):
        monkeypatch.setattr(E, "MANY_RUNS", most)
        for _ in range(500):
            k = rng.choice([0, 1, 2, 5, 20, 60])
            a, b = ([str(rng.randint(0, k)) for _ in range(rng.randint(0, 40))] for _ in "ab")
            b = a[: rng.randint(0, 20)] + b + a[rng.randint(0, 40) :] if rng.random() < 0.4 else b
            assert E.sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


def test_long_texts_are_not_gone_over_for_every_match(monkeypatch):
    class Counted(str):
        def __eq__(self, other):
            seen[0] += 1
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    seen = [0]
    a = [Counted(f"w{i}") for i in range(3_000)]
    b = [f"w{i}" if i % 2 else "none" for i in range(3_000)]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert E.sequence_ratio(a, b) == 0.5
    assert seen[0] < 20 * len(a)
