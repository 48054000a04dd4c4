"""Each stage's decisions by code that is not the package's own."""

import math
import random
import zlib

import corpus_pipeline
import numpy as np
from sparkloom.llm import decontam, mixing, quality
from test_decontam_whole import brute
from test_mixing_plain import WORD, draw, h, signed
from test_quality_plain import plain_features, plain_ftrl
from test_rows import brute_pii, brute_targets
from tests_support import shingle_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice(("an", "the", "er", "ti", "on", "ha")) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(16)) for i in range(4)]
    docs = []
    for i in range(120):
        text = prose(rnd.randint(30, 70))
        if i % 5 == 0:
            text = " ".join(w + rnd.choice(["$$$", "!!"]) for w in text.split())
        elif i % 7 == 0:
            text = docs[rnd.randrange(len(docs))][1] + rnd.choice(["", " end", " the end of it all and so on it went"])
        elif i % 11 == 0:
            text += " " + rnd.choice(items)[1].upper() + " " + prose(9)
        elif i % 13 == 0:
            text += " mail me@example.com or call +1 (743) 555-3824, card 4111 1111 1111 1111"
        docs.append((i, text, "en", rnd.choice("abc"), len(text)))
    return docs, items, [(i, int(i % 5 > 0), 0) for i in range(120)]


def plain_scores(docs, labels):
    kind = {i: float(y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}

    def vector(text):
        found = plain_features(text)
        total = sum(found.values())
        return {k: float(np.float32(n * quality.NORM / total)) for k, n in found.items()} | {("bias",): 1.0}

    texts = {d[0]: d[1] for d in docs}
    order = sorted(kind, key=lambda i: (signed(h(i)), i))
    weight = plain_ftrl([(vector(texts[i]), kind[i]) for i in order], quality.EPOCHS)
    return {i: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in vector(t).items()))) for i, t in texts.items()}


def redacted(text):
    spans, out, done = sorted(((s, e, k) for k, s, e in brute_pii(text)), key=lambda x: (x[0], ("email", "ip", "card", "phone").index(x[2]))), "", 0
    for s, e, k in spans:
        if s >= done:
            out += text[done:s] + f"[{k.upper()}]"
        done = max(done, e)
    return out + text[done:]


def test_stages(spark, tmp_path):
    docs, items, labels = corpus()
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append({r.doc_id: r for r in now.collect()})

    texts, scores = {d[0]: d[1] for d in docs}, plain_scores(docs, labels)
    assert set(kept[0]) == {i for i, p in scores.items() if p >= 0.5} and 60 < len(kept[0]) < 120
    groups = shingle_groups({i: texts[i] for i in kept[0]}, 5, 80)
    assert set(kept[1]) == {min(g) for g in groups} and len(kept[1]) < len(kept[0])
    ids = sorted(kept[1])
    leaked = {ids[i] for i, _ in brute([texts[i] for i in ids], [t for _, t in items], decontam.EDIT_RATE)}
    assert set(kept[2]) == set(ids) - leaked and leaked
    assert {i: (r.text, r.n_chars) for i, r in kept[3].items()} == {i: (redacted(texts[i]), len(redacted(texts[i]))) for i in kept[2]}
    by = {}
    for r in kept[3].values():
        by.setdefault(r.source, []).append((r.doc_id, r.text))
    size = {s: sum(len(WORD.findall(t)) for _, t in own) for s, own in by.items()}
    targets, want = brute_targets(size, mixing.WEIGHTS, mixing.MAX_EPOCHS), {}
    for source, own in by.items():
        epochs, before = math.floor(targets[source] / size[source] + 1e-9), 0
        for doc, text in sorted(own, key=lambda x: (draw(*x), x[0])):
            n = len(WORD.findall(text))
            want[doc] = epochs + (epochs < mixing.MAX_EPOCHS and before + n / 2 <= targets[source] - epochs * size[source])
            before += n
    assert {i: r.copies for i, r in kept[4].items()} == {i: c for i, c in want.items() if c}
