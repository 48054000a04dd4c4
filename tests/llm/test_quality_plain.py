"""The classifier's features and its learning against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkloom.llm import quality

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def plain_features(text):
    """Counts of words with their shapes, of pairs of words, and of pairs of shapes."""
    words = TOKEN.findall((text or "").encode())
    shapes = []
    for w in words:
        upper = [chr(c).isascii() and chr(c).isupper() for c in w[:2]]
        shapes.append(4 + (len(w) > 1) if not (w[:1].isalnum() or w[0] >= 128) else 3 if w[:1].isdigit() else upper[0] + all(upper) * (len(w) > 1))
    low = [w.lower() for w in words]
    found = Counter(("word", *x) for x in zip(low, shapes))
    found += Counter(("twice",) if a == b else ("pair", a, b) for a, b in zip(low, low[1:]))
    return found + Counter(("shapes", *x) for x in zip(shapes, shapes[1:]))


def texts(seed, n):
    rnd = random.Random(seed)
    parts = ["the", "The", "THE", "a", "A1", "7up", "$$", "!", "é", "É", "x-y", "...", "42"]
    return ["", None, " \n"] + ["".join(rnd.choice(parts) + rnd.choice([" ", " ", "\n", ""]) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_features_are_the_plain_ones():
    rows = texts(1, 200)
    index, values, at = quality.vectors(pa.array(rows, pa.string()), bits=44)  # no two names meet
    names = {}
    for i, text in enumerate(rows):
        want = plain_features(text)
        total = sum(want.values())
        got = sorted(zip(values[at[i] : at[i + 1]].tolist(), index[at[i] : at[i + 1]].tolist()))
        assert [round(v * total / quality.NORM) for v, _ in got] == sorted(want.values()), text
        for name, count in want.items():  # a name always has one index
            names.setdefault(name, {j for v, j in got if round(v * total / quality.NORM) == count})
            names[name] &= {j for v, j in got if round(v * total / quality.NORM) == count}
    assert all(names.values())


def plain_ftrl(rows, epochs):
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for vector, y in rows:
            w = {i: weight(i) for i in vector}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * v for i, v in vector.items())))))
            for i, v in vector.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return weight


def test_updates_and_scores_are_the_plain_ones():
    rnd = random.Random(2)
    rows = [(t, float(("$$" in (t or "")) ^ (rnd.random() < 0.1))) for t in texts(3, 60)]
    column = pa.array([t for t, _ in rows], pa.string())
    index, values, at = quality.vectors(column)
    parts = [(index[at[i] : at[i + 1]], values[at[i] : at[i + 1]]) for i in range(len(rows))]
    weights, bias = quality.fit_ftrl([(i, v, y) for (i, v), (_, y) in zip(parts, rows)], epochs=3)
    weight = plain_ftrl([(dict(zip(i.tolist(), v.tolist())) | {"bias": 1.0}, y) for (i, v), (_, y) in zip(parts, rows)], 3)
    assert math.isclose(bias, weight("bias"), abs_tol=1e-9) and np.flatnonzero(weights).size > 20
    assert all(math.isclose(weights[i], weight(i), abs_tol=1e-9) for i in set(index.tolist()))
    got = quality.score_batch(column, weights, bias)
    for (i, v), p in zip(parts, got):
        assert math.isclose(p, 1 / (1 + math.exp(-(bias + sum(weight(j) * x for j, x in zip(i.tolist(), v.tolist()))))), abs_tol=1e-9)


def test_accuracy_on_the_held_out_rows(spark):
    """The labelled rows of the test data that are not learned from."""
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.exists(f"{folder}/labels.parquet"):
        return
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(scored) > 20 and sum(r.predicted == r.quality for r in scored) >= 0.9 * len(scored)
