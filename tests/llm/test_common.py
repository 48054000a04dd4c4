"""Connected components and global numbering against plain versions."""

import random

from sparkloom.llm.common import RANK, Cuts, components, numbered


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = chain + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(-5, 7), (200, 200), (300, 301), (301, 300)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    got = components(Cuts(spark, "t"), df).collect()
    assert len(got) == len(label) and {r.node: r.label for r in got} == label
    assert components(Cuts(spark, "t"), df.limit(0)).count() == 0


def test_numbered(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(200)]
    got = numbered(Cuts(spark, "t"), spark.createDataFrame(rows, "a int, b int").repartition(4), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r[RANK])] == sorted(rows) and sorted(r[RANK] for r in got) == list(range(200))
    assert numbered(Cuts(spark, "t"), spark.createDataFrame([], "a int"), "a").count() == 0
