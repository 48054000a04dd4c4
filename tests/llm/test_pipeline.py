"""The pipeline's stages on a small corpus, each against a plain version of what it decides."""

import os
import random

import corpus_pipeline
from sparkloom.llm import decontam, mixing, pii, quality
from tests_support import shingle_groups


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(folder, f"{name}.parquet"))


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(("an", "the", "er", "ti", "on", "ha")) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(40)) for i in range(5)]
    docs = []
    for i in range(150):
        text = prose(rnd.randint(30, 120))
        if i % 5 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 7 == 0 and docs:
            text = docs[rnd.randrange(len(docs))][1] + rnd.choice(["", " end"])
        elif i % 11 == 0:
            text += " " + rnd.choice(items)[1] + " " + prose(9)
        elif i % 13 == 0:
            text += " mail me@example.com or call +1 (743) 555-3824"
        docs.append((i, text, "en", rnd.choice("abc"), len(text)))
    docs += [(200, None, "en", None, None), (201, "", "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    write(spark, folder, "documents", docs, schema)
    write(spark, folder, "labels", [(i, int(i % 5 > 0), 0) for i in range(0, 150)], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", items, "item_id long, text string")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources to target weights"]

    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if i < 4:
            assert out.columns == now.columns, name
        out.write.parquet(f"{folder}/stage{i}")
        now = spark.read.parquet(f"{folder}/stage{i}")
        kept.append({r.doc_id: r for r in now.collect()})
    whole = {d[0]: d for d in docs}

    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {i for i, t in ((d[0], d[1]) for d in docs) if quality.score_batch(quality.pa.array([t], quality.pa.string()), *model)[0] >= 0.5}
    assert set(kept[0]) == good and not [i for i in good if i < 150 and i % 5 == 0] and len(good) >= 115

    groups = shingle_groups({i: whole[i][1] for i in good}, 5, 80)
    assert set(kept[1]) == {min(g) for g in groups}
    index = decontam.Patterns(items)
    import numpy as np

    def clean(text):
        raw = decontam.K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        return not decontam.leaks(raw, np.array([0, len(raw)]), index)

    assert set(kept[2]) == {i for i in kept[1] if clean(whole[i][1])}
    assert not any(t in (r.text or "") for r in kept[2].values() for _, t in items) and len(kept[2]) < len(kept[1])
    for i, r in kept[3].items():
        assert r.text == pii.redact(whole[i][1]) and (r.text is None or r.n_chars == len(r.text))
    assert set(kept[3]) == set(kept[2]) and not any("@" in (r.text or "") for r in kept[3].values())
    mixed = {r.doc_id: r for r in mixing.mix_sources(spark.read.parquet(f"{folder}/stage3")).collect()}
    assert {i: r.taken for i, r in kept[4].items()} == {i: r.taken for i, r in mixed.items() if r.copies}
    assert {r.text for r in kept[4].values()} <= {r.text for r in kept[3].values()}

    done = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, folder).collect()}
    assert done == {i: r.taken for i, r in kept[4].items()}
