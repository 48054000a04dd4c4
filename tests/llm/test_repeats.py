"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from sparkloom.llm.substrings import dedup_substrings
from sparkloom.llm.suffixes import dedup_suffixes

WORD = re.compile("[^\x20\x09-\x0d]+")
IN = "doc_id long, text string, kept_text string, key long"


def corpus(seed, n=30, width=12):
    rnd = random.Random(seed)
    shared = [" ".join(rnd.choice("abcdé") * rnd.randint(1, 3) for _ in range(rnd.randint(5, 40))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(shared) if rnd.random() < 0.5 else " ".join(str(rnd.randint(0, 500)) for _ in range(rnd.randint(1, width))))
        rows.append((i * 3, rnd.choice([" ", "\n", "  "]).join(parts), "x", 1))
    rows += [(1, None, None, None), (2, "", None, None), (4, " \t ", None, 5), (None, shared[0], "y", 2), (None, shared[0], "y", 2)]
    long = " ".join(str(rnd.randint(0, 9)) for _ in range(300))
    rows += [(50, "x" + long, None, 1), (61, long + "y", None, 1), (62, "q" + long[100:400] + "r" + long[:90], None, 1)]
    rows += [(5, "a " * 3000, None, None), (7, rows[3][1], None, None), (rows[2][0], rows[2][1], None, None)]
    return rows


def brute_words(rows, k):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - k + 1):
            seen[tuple(w[i : i + k])] += 1
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, k):
    big = 1 << 63
    ids = [big if r[0] is None else r[0] for r in rows]
    texts = [(r[1] or "").encode() for r in rows]
    least = {}
    for d, t in zip(ids, texts):
        for i in range(len(t) - k + 1):
            least[t[i : i + k]] = min(d, least.get(t[i : i + k], big))
    out = []
    for r, d, t in zip(rows, ids, texts):
        gone = [False] * (len(t) + 1)
        for i in range(len(t) - k + 1):
            if least[t[i : i + k]] < d:
                gone[i : i + k] = [True] * k
        spans = sum(g and not p for p, g in zip([False, *gone], gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_words(spark):
    for seed, k, q in ((1, 8, 3), (2, 35, 8)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, IN).repartition(5)
        got = dedup_substrings(df, min_words=k, anchor_words=q, digest=True).collect()
        assert sorted(map(tuple, got), key=repr) == brute_words(rows, k)


def test_words_shows_text_and_runs(spark):
    rows = [(1, "p q a b c d x", None, None), (2, "a b c d y", None, None)]
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, IN), min_words=4, anchor_words=2).collect()}
    assert got[1].kept_text == "p q x" and got[2].kept_text == "y"
    assert [(r.start, r.end) for r in got[1].removed] == [(2, 6)]


def test_bytes(spark):
    for seed, k, q in ((2, 50, 16),):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, IN).repartition(5)
        got = dedup_suffixes(df, min_bytes=k, bucket_bytes=q, digest=True).collect()
        assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, k)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], IN)
    assert dedup_substrings(empty).count() == 0 and dedup_suffixes(empty).count() == 0


def test_long_texts_cross_pieces(spark):
    import numpy as np

    from sparkloom.llm import kernels as K

    old, K.PIECE = K.PIECE, 64
    try:
        rnd = np.random.default_rng(0)
        tokens = rnd.integers(0, 3, 1000).astype(np.uint64)
        offsets = np.array([0, 10, 10, 500, 1000])
        text, first, count, _, _ = K.segments(tokens, offsets, 3, 9)
        starts = {(t, f + j) for t, f, c in zip(text, first, count) for j in range(c)}
        assert starts == {(t, i) for t in range(4) for i in range(offsets[t + 1] - offsets[t] - 8)}
        hashes = K.hash_ranges(tokens, np.arange(900), np.arange(900) + 9)
    finally:
        K.PIECE = old
    again = K.hash_ranges(tokens, np.arange(900), np.arange(900) + 9)
    assert (hashes == again).all()
