"""The classifier's sample is held once in the driver."""

import random
import tracemalloc

from sparkloom.llm import quality


def test_sample_is_held_once(spark, monkeypatch):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(str(rnd.random()) for _ in range(2500))) for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    fit, seen = quality.fit_ftrl, {}

    def measured(rows, *args):
        seen["sample"] = sum(i.nbytes + v.nbytes for i, v, _ in rows)
        seen["own"] = sum(i.nbytes + v.nbytes for i, v, _ in rows if i.flags.owndata)
        seen["before"] = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        model = fit(rows, *args, bits=quality.BITS, epochs=1)
        seen["more"] = tracemalloc.get_traced_memory()[1] - seen["before"]
        return model

    monkeypatch.setattr(quality, "fit_ftrl", measured)
    tracemalloc.start()
    try:
        quality.train(docs, labels)
    finally:
        tracemalloc.stop()
    weights = 8 << quality.BITS
    assert seen["sample"] > 8 * 10**6 and seen["own"] == 0
    assert seen["more"] < 12 * weights, "the rows are copied while the model is fitted"
