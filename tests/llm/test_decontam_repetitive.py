"""Repetitive texts and items: the same leaks as without shortening, in bounded time."""

import random
import time

import numpy as np
import pyarrow as pa
from sparkloom.llm import decontam


def found(text, index):
    raw = decontam.K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    return decontam.leaks(raw, np.array([0, len(raw)]), index)


def test_shortening_changes_no_result(monkeypatch):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcde ") for _ in range(n))
    unit = lambda: rnd.choice(["a", "-", "ab", "xyz", "= ", "abcdefgh", "0123456"])
    cases = []
    for _ in range(30):
        items = [(i, word(rnd.randint(0, 60)) + unit() * rnd.randint(1, 200) + word(rnd.randint(40, 120))) for i in range(3)]
        text = word(50) + unit() * rnd.randint(300, 1500) + word(30) + rnd.choice(items)[1][rnd.randint(0, 40) :] + unit() * rnd.randint(1, 900)
        cases.append((items, text))
    with monkeypatch.context() as m:
        m.setattr(decontam, "shortened", lambda data: data)
        want = [found(text, decontam.Patterns(items)) for items, text in cases]
    got = [found(text, decontam.Patterns(items)) for items, text in cases]
    assert got == want and sum(map(bool, got)) > 10 and not all(map(bool, got))


def test_what_stays_of_a_stretch():
    for unit in ("a", "ab", "abcdefgh"):
        for n in (1, 500, 520, 5000):
            raw = np.frombuffer(("x" + unit * n + "yz").encode(), np.uint8)
            short = decontam.shortened(raw).tobytes().decode()
            assert short[0] == "x" and short[-2:] == "yz" and len(short) <= decontam.STRETCH + 4 * len(unit) + 3
            assert short[1:-2] == unit * ((len(short) - 3) // len(unit))


def test_time_is_bounded():
    index = decontam.Patterns([(1, "a" * 500), (2, "start " + "-" * 300 + " end"), (3, "ab" * 200)])
    began = time.time()
    for text in ("a" * 200_000, "-" * 200_000, "ab" * 100_000, ("-" * 70 + "\n") * 800):
        found(text, index)
    assert time.time() - began < 60


def test_a_text_of_several_pieces():
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    item = " ".join(words[30_000:30_030])
    index = decontam.Patterns([(1, item), (2, "an item of its own"), (3, "not there at all, in any of the pieces " * 3)])
    for at in (0, 17_000, 29_999, 59_990):
        text = " ".join([*words[:at], "an item of its own", *words[at:]])
        assert decontam._by_text(pa.array([text, "", None, item], pa.string()), index) == [{1, 2}, set(), set(), {1}]
