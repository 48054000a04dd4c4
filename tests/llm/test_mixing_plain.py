"""Which documents the mix takes, by a plain sort of the sampling keys."""

import math
import random
import re
import struct

import xxhash

from sparkloom.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def h(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def draw(doc, text):
    doc = (1 << 63) - 1 if doc is None else doc
    key = signed(h(doc, text))
    u = ((h(key, doc, struct.pack("<i", mixing.SEED)) >> 11) + 0.5) / (1 << 53)
    raw = [w.encode() for w in WORD.findall(text)]
    letters = sum(chr(c).isalpha() and c < 128 or c >= 128 for w in raw for c in w)
    quality = min(1.0, max(0.1, letters / max(1, sum(map(len, raw)))))
    return -math.log(u) / quality, key


def test_taken_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        source = rnd.choice(["a", "a", "a", "b", "c", "d", None])
        text = " ".join(rnd.choice(["word", "été", "42", "$$", "x1", "naïve"]) for _ in range(rnd.choice([0, 1, 5, 30, 200])))
        rows.append((rnd.choice([None, i, i]) if source else i, text, source))
    rows += [(900, None, "a"), (901, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {}
    for r in mixing.mix_sources(df).collect():
        got.setdefault((r.doc_id, r.size, r.source_size), []).append(r.copies)
        target = r.target
    by = {}
    for doc, text, source in rows:
        by.setdefault(source, []).append((doc, text or ""))
    targets = {r.source_size: r.target for r in mixing.mix_sources(df).collect()}
    want = {}
    for own in by.values():
        total = sum(len(WORD.findall(t)) for _, t in own)
        target = targets[total]
        epochs = math.floor(target / total) if total else 0
        budget, before = target - epochs * total, 0
        for doc, text in sorted(own, key=lambda x: (draw(*x), (1 << 63) - 1 if x[0] is None else x[0])):
            size = len(WORD.findall(text))
            copies = 0 if not size else epochs + (epochs < mixing.MAX_EPOCHS and before + size / 2 <= budget)
            before += size
            want.setdefault((doc, size, total), []).append(copies)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
