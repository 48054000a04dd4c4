import random

import numpy as np

from sparkloom.llm import decontam


def edits_within(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(rnd, text, n):
    out = list(text)
    for _ in range(n):
        k = rnd.randrange(len(out))
        out[k : k + 1] = rnd.choice([[], [rnd.choice("xyz")], [out[k], rnd.choice("xyz")]])
    return "".join(out)


def prose(rnd, n):
    return " ".join("".join(rnd.choice(("an", "the", "er", "ti", "é")) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_same_as_edit_distance_to_every_pattern(spark):
    rnd = random.Random(7)
    items = [(i, prose(rnd, rnd.choice([8, 12, 20, 40]))) for i in range(8)] + [(None, None), (50, ""), (51, "short one"), (None, prose(rnd, 20))]
    rows = [(0, None, "x", 1), (1, "", None, 1), (None, "clean", None, 1)]
    for i in range(120):
        base = rnd.choice([t for _, t in items if t and len(t) > 40])
        cut = rnd.choice([0, 0, len(base) // 2])
        middle = changed(rnd, base[cut:].upper() if i % 9 == 0 else base[cut:], rnd.choice([0, 1, 3, 5, 8, 12]))
        rows.append((i + 2, f"{prose(rnd, rnd.randint(0, 30))} {middle}{prose(rnd, rnd.randint(0, 9))}", None, i))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, contaminated int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontam.Patterns(items)
    wanted = []
    for doc, text, *_ in rows:
        raw = decontam.K.LOWER[np.frombuffer((text or "").encode(), np.uint8)].tolist()
        found = {-1 if index.items[p] is None else index.items[p] for p, t in enumerate(index.texts) if raw and edits_within(t.tolist(), raw) <= index.budget[p]}
        wanted.append((doc, bool(found), len(found), sorted(found)))
    old, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 300
    try:
        got = sorted(map(tuple, decontam.find_leaks(df, bench).collect()), key=repr)
    finally:
        decontam.BLOCK_BYTES = old
    assert got == sorted(wanted, key=repr)
    assert 20 < sum(w[1] for w in wanted) < 110
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in wanted if not w[1]), key=repr)
    assert decontam.find_leaks(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
