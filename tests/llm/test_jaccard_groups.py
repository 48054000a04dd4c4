"""One row of each group of linked texts, whatever the ids are."""

import random

from sparkloom.llm import jaccard


def test_ids_do_not_merge_groups(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(str(rnd.randrange(10**6)) for _ in range(40))
    near = lambda t: t + " end"
    nulls, shared, linked, mixed = [text() for _ in range(5)], [text(), text()], text(), text()
    rows = [(None, t) for t in nulls] + [(None, near(nulls[0])), (None, nulls[1]), (None, None), (None, " ")]
    rows += [(7, shared[0]), (7, shared[1]), (9, near(shared[1])), (7, None), (3, linked), (2, near(linked)), (None, mixed), (5, near(mixed))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one_of_each(df, words=5, percent=80).collect()]
    assert len(kept) == len(set(kept))
    got = set(kept)
    assert {(None, t) for t in nulls[1:]} <= got
    assert len(got & {(None, nulls[0]), (None, near(nulls[0]))}) == 1
    # one id with two texts that don't link; a null id gives way to a real one
    assert got - {(None, t) for t in (*nulls, near(nulls[0]))} == {(7, shared[0]), (7, shared[1]), (2, near(linked)), (5, near(mixed)), (7, None), (None, None), (None, " ")}
