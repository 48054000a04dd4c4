"""Decontamination against a brute force over every window of the items."""

import random

import numpy as np
from test_decontam import changed, edits_within, prose

from sparkloom.llm import decontam


def raw(text):
    return decontam.K.LOWER[np.frombuffer(text.encode(), np.uint8)]


def found(texts, index):
    data = [raw(t) for t in texts]
    return set(decontam.leaks(np.concatenate(data), np.append(0, np.cumsum([len(d) for d in data])), index))


def least_edits(windows, text):
    """Least edits between any of the windows (rows of one length) and any part of the text."""
    n, m = windows.shape
    column = np.tile(np.arange(m + 1), (n, 1))
    best, step = m, np.arange(m + 1)
    for byte in text:
        new = np.zeros_like(column)
        new[:, 1:] = np.minimum(column[:, :-1] + (windows != byte), column[:, 1:] + 1)
        column = np.minimum.accumulate(new - step, axis=1) + step
        best = min(best, int(column[:, -1].min()))
    return best


def brute(texts, items, rate):
    out = set()
    for k, item in enumerate(map(raw, items)):
        m = min(decontam.WINDOW, len(item))
        windows = np.stack([item[s : s + m] for s in range(len(item) - m + 1)])
        out |= {(i, k) for i, t in enumerate(texts) if least_edits(windows, raw(t)) <= int(m * rate)}
    return out


def test_least_edits():
    rnd = random.Random(3)
    for _ in range(20):
        a, t = prose(rnd, 4).encode()[:20], prose(rnd, 9).encode()
        assert least_edits(np.frombuffer(a, np.uint8)[None, :], t) == edits_within(a, t)


def test_every_window_of_an_item(monkeypatch):
    rnd = random.Random(5)
    items = [prose(rnd, n) for n in (60, 45, 30, 9, 16)]
    texts = []
    for i in range(90):
        item = items[i % 5]
        size = rnd.choice([70, 84, 96, 96, 105, 130])
        at = rnd.randint(0, max(0, len(item) - size))
        texts.append(f"{prose(rnd, rnd.randint(0, 12))} {changed(rnd, item[at : at + size], rnd.choice([0, 0, 3, 5, 8, 10, 13]))}{prose(rnd, rnd.randint(0, 6))}")
    texts[7:7] = ["", items[0], items[1] + items[2]]
    want = brute(texts, items, decontam.EDIT_RATE)
    assert 20 < len(want) < len(texts)
    index = decontam.Patterns(list(enumerate(items)))
    assert found(texts, index) == want
    monkeypatch.setattr(decontam, "HITS", 40)  # many slices of the shared q-grams
    monkeypatch.setattr(decontam, "ALIGNED", 3)
    assert found(texts, index) == want


def test_verbatim_excerpts_at_every_offset():
    rnd = random.Random(6)
    item = prose(rnd, 60)
    size = decontam.WINDOW
    texts = [f"{prose(rnd, 8)} {cut}{prose(rnd, 8)}" for cut in (item[a : a + size] for a in range(len(item) - size))]
    assert found(texts, decontam.Patterns([(1, item)])) == {(i, 0) for i in range(len(texts))}


def test_copies_with_every_tenth_word_replaced():
    rnd = random.Random(8)
    items = [prose(rnd, 45) for _ in range(40)]
    texts = []
    for item in items:
        words = item.split()
        for i in range(rnd.randrange(10), len(words), 10):
            words[i] = "".join(rnd.choice("bkmowz") for _ in range(rnd.randint(5, 8)))
        texts.append(f"{prose(rnd, 10)} {' '.join(words)} {prose(rnd, 10)}")
    assert found(texts, decontam.Patterns(list(enumerate(items)))) == {(i, i) for i in range(40)}


def test_items_too_short_for_the_filter():
    items = [(1, "Who wrote the novel Emma?"), (2, "Emma"), (3, " née A. \n"), (4, "emma"), (None, "x1"), (5, ""), (6, " \t"), (7, "z" * 31), (8, "谁写了"), (9, "?!")]
    texts = {
        "so WHO WROTE the novel Emma?": {1, 2, 4},
        "Emmas and gEmma, xx1 x12 née a": set(),
        "Gemma met (emma)": {2, 4},
        "éEmma Emmaé": set(),
        "was née a.": {3},
        "énée a. née A.b": {3},
        "x1": {None},
        "z" * 32: set(),
        f"-{'z' * 31}-": {7},
        "问谁写了它": {8},
        "what?!no": {9},
        "": set(),
        "Em": set(),
        "ma": set(),
    }
    index = decontam.Patterns(items)
    assert decontam._by_text(decontam.pa.array(list(texts)), index) == list(texts.values())
    assert decontam._by_text(decontam.pa.array([None, "Emma"]), decontam.Patterns(items[1:2])) == [set(), {2}]
