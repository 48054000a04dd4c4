"""Every operator and stage: several Arrow batches, a very long text, clashing column names, empty tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import decontam, jaccard, licenses, mixing, pii, quality, syncmers
from sparkloom.llm.substrings import dedup_substrings
from sparkloom.llm.suffixes import dedup_suffixes
from test_jaccard import brute as brute_jaccard
from test_repeats import brute_bytes, brute_words

SCHEMA = "doc_id long, text string, key long, doc string, block long, part int, found string, size long, copies int, n long, c long, label string, spans string, source string, lang string, n_chars long"


def rows():
    """4700 short texts, with copies, near copies, repeated rows, nulls, and one of 40,000 words."""
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 12, 50]))) for _ in range(300)]
    texts = []
    for i in range(4700):
        text = rnd.choice(base) if i % 3 else " ".join(rnd.choice(words) for _ in range(8))
        texts.append(text + rnd.choice(["", "", " end", "\n"]))
    texts[10:14] = [None, "", " \t", " ".join(rnd.choice(words) for _ in range(40_000))]
    out = [(i if i % 50 else None, t, i, "d", 1, 2, None, 5, 9, 1, 2, "x", "s", rnd.choice(["a", "b", None]), "en", len(t or "")) for i, t in enumerate(texts)]
    return out + out[20:23]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """One partition, so that a task gets several batches."""
    folder = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 900)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, rows()[13][1][:600]), (2, "a short item here"), (3, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_repeats_over_several_batches(spark, table):
    plain = [(r[0], r[1]) for r in rows()]
    df = spark.read.parquet(f"{table}/documents.parquet")
    got = sorted(map(tuple, dedup_substrings(df, digest=True).collect()), key=repr)
    assert got == brute_words(plain, 35)
    got = sorted(map(tuple, dedup_suffixes(df, digest=True).collect()), key=repr)
    assert got == brute_bytes(plain, 50)


def test_links_over_several_batches(spark, table):
    plain = [r for r in rows() if r[1] is None or len(r[1]) < 10_000][:1500]
    df = spark.createDataFrame(plain, SCHEMA).coalesce(1)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=repr) == brute_jaccard(plain, 3, 90)


def test_rows_and_columns_stay(spark, table):
    df, n = spark.read.parquet(f"{table}/documents.parquet"), len(rows())
    labels, items = spark.read.parquet(f"{table}/labels.parquet"), spark.read.parquet(f"{table}/benchmark.parquet")
    model = quality.train(df, labels)
    for out in (quality.score_quality(df, model), syncmers.fingerprint_edits(df), mixing.mix_sources(df), decontam.find_leaks(df, items), pii.digest_spans(pii.detect_pii(df)), licenses.scan_licenses(df), jaccard.jaccard_components(df)):
        got = out.collect()
        assert len(got) == n and sum(r.doc_id is None for r in got) == sum(r[0] is None for r in rows())
    leaked = {r.doc_id for r in decontam.find_leaks(df, items).where("contaminated").collect()}
    assert leaked == {13}
    small = {r.doc_id: r["items"] for r in decontam.find_leaks(df, items, block_bytes=100).collect() if r.contaminated}
    assert small == {13: [1]} and decontam.drop_leaks(df, items, block_bytes=100).count() == n - 1
    # no rows, and each stage's columns
    for name, stage in corpus_pipeline.STAGES:
        for some in (df.limit(0), df.where("doc_id < 40")):
            out = stage(spark, some, table)
            assert out.columns[: len(df.columns)] == df.columns, name
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == df.columns
            assert out.count() <= some.count()


def test_conversations_over_several_batches(spark):
    from sparkloom.llm import chat

    turns = [(i // 3 if i % 97 else None, i % 3, ["user", "assistant", None][i % 3], [f"t{i}", None, "", "<|im_end|>"][i % 4], 7) for i in range(5000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, loss int").coalesce(1)
    got = chat.digest_conversations(chat.format_conversations(df.select("conv_id", "turn", "role", "text")))
    assert got.count() == len({t[0] for t in turns}) and got.agg(F.sum("n_turns")).first()[0] == 5000
    assert chat.digest_conversations(chat.format_conversations(df.limit(0).select("conv_id", "turn", "role", "text"))).count() == 0
