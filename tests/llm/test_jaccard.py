import random
import re

import numpy as np

from sparkloom.llm import jaccard

WORD = re.compile("[^\x20\x09-\x0d]+")
IN = "doc_id long, text string, component_id string, n_shingles int"


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(top(i), []).append(1 << 63 if r[0] is None else r[0])
    ids = [min(least[top(i)]) for i in range(len(rows))]
    return sorted(((r[0], len(s), None if c == 1 << 63 else c) for r, s, c in zip(rows, sets, ids)), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    words = [str(i) for i in range(400)]
    rows = [(1, None, "x", 1), (3, "", None, 1), (5, " \n", None, 1), (7, "One", None, 1), (9, "one", None, 1), (11, "one two", None, None), (None, "null", None, 1), (None, "null", None, 1)]
    for f in range(14):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 9, 12, 20, 40, 90, 300]))]
        for _ in range(rnd.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, max(1, len(text) // 60), len(text) // 25])):
                k = rnd.randrange(len(text))
                text[k : k + 1] = rnd.choice([[], ["n" + str(rnd.randint(0, 9))], [text[k], "m"]])
            rows.append((rnd.randint(20, 10**6), " ".join(text), None, f))
    rows.append(rows[20])
    return rows


def test_components(spark, monkeypatch):
    for seed, n, percent, piece in ((1, 3, 90, 256), (2, 5, 80, 2)):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        rows = corpus(seed)
        df = spark.createDataFrame(rows, IN).repartition(4)
        got = sorted(map(tuple, jaccard.jaccard_components(df, words=n, percent=percent).collect()), key=repr)
        want = brute(rows, n, percent)
        assert got == want
        if percent == 80:
            kept = jaccard.keep_one_of_each(df, words=n, percent=percent)
            assert kept.columns == df.columns
            assert sorted(((r.doc_id) for r in kept.collect()), key=repr) == sorted({*(w[2] for w in want if w[1]), *(w[0] for w in want if not w[1])}, key=repr)
    assert jaccard.jaccard_components(spark.createDataFrame([], IN)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for _ in range(1500):
            size = int(rng.choice([5, 9, 10, 11, 19, 20, 33, 60, 150, 400, 1000]))
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            drop = int(rng.integers(0, size * (100 - percent) // 100 + 1))
            room = (size - drop) * 100 // percent - size
            add = int(rng.integers(0, room + 1)) if room > 0 else 0
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
            both = size - drop
            assert 100 * both >= percent * (size + add)
            if drop + add:
                assert set(jaccard.signatures(np.unique(a), percent).tolist()) & set(jaccard.signatures(np.unique(b), percent).tolist()), (size, drop, add)
