"""Fingerprints against plain Python, texts without spaces, the error of a sketch, and frequent ids."""

import random
import struct

import regex
import xxhash

from sparkloom.llm import syncmers

LETTERS = regex.compile(r"[[\p{L}\p{M}]--[\p{Lo}jqxzkvw]]++[jqxzkvw]?+|[jqxzkvw]|\p{Lo}|[[\p{N}]--[7]]++7?+|7|[^\s\p{L}\p{M}\p{N}]", regex.V1)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def h(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return signed(seed)


def plain_anchors(text):
    marks = [syncmers._MARK, syncmers._MARK + 1]
    word = marks + [h(x) for x in LETTERS.findall(text.lower())] + marks
    pairs = [h(a, b) for a, b in zip(word, word[1:])]
    return [(i, h(pairs[i], pairs[i + 2])) for i in range(len(pairs) - 2) if min(pairs[i], pairs[i + 2]) <= pairs[i + 1]]


def hash_int(v, seed):
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", v), seed=seed & (1 << 64) - 1))


def elements(text):
    a = plain_anchors(text)
    return {hash_int(j - i, h(x, y)) for (i, x), (j, y) in zip(a, a[1:])}


def plain_fingerprint(text):
    found = sorted(elements(text))[: syncmers.SKETCH] or [h(text)]
    return "".join(f"{v & 0xFFFFFFFF:08x}" for v in found)


def texts(seed, n=40):
    rnd = random.Random(seed)
    out = ["", "a", "one two", "x" * 3000, "7" * 50, "東京都は日本の首都です。" * 20, "สวัสดีครับ " * 9, "MiXeD Case", "ÀÉ é\u0301 ß", "\x00\x1f ", "12 34 5677 " * 5]
    for _ in range(n):
        out.append("".join(rnd.choice("abcdefgjkqÄé东 .,-7 3\n") for _ in range(rnd.randint(0, 400))))
    return out


def test_fingerprints_are_those_of_plain_python(spark):
    rows = list(enumerate(texts(1)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.fingerprint for r in syncmers.fingerprint_edits(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in rows}
    found = {}
    for r in syncmers.anchors(df).collect():
        found.setdefault(r.doc_id, []).append((r.position + 2, r.anchor))
    assert {i: sorted(v) for i, v in found.items()} == {i: a for i, t in rows if (a := plain_anchors(t))}


def test_texts_without_spaces_share_anchors(spark):
    rnd = random.Random(2)
    cases = ["".join(rnd.choice(alphabet) for _ in range(3000)) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "人口地理的中国学生会大有", "0123456789")]
    rows = [(2 * i + k, before + text) for i, text in enumerate(cases) for k, before in enumerate(("", "b"))]
    found = {}
    for r in syncmers.anchors(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.anchor)
    for i in range(len(cases)):
        a, b = found[2 * i], found[2 * i + 1]
        assert len(a) > 50 and len(a & b) >= len(a) - 6


def test_error_of_a_sketch():
    rnd = random.Random(3)
    errors = []
    for _ in range(150):
        words = [str(rnd.randrange(10**6)) for _ in range(500)]
        other = [w if rnd.random() > rnd.choice([0.0, 0.02, 0.1]) else "new" + w for w in words]
        a, b = elements(" ".join(words)), elements(" ".join(other))
        least = sorted(set(sorted(a)[:64]) | set(sorted(b)[:64]))[:64]
        errors.append(len(set(least) & a & b) / len(least) - len(a & b) / len(a | b))
    assert abs(sum(errors)) / len(errors) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.0625


def test_frequent_and_null_ids_are_split_and_ordered(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 5, 5, rnd.randrange(1000)]), f"t{i % 700}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(5)
    from pyspark.sql import functions as F

    df = df.select(F.coalesce("doc", F.lit(syncmers.LAST_ID)).alias("doc"), "text", F.xxhash64("text").alias("tie"))
    got = syncmers.with_next(df, "doc", "tie", "text", buckets=40).collect()
    order = sorted(((r.doc, r.tie, r.text) for r in df.collect()), reverse=True)
    want = sorted((a[2], a[0], b[2]) for a, b in zip(order, [*order[1:], order[0]]))
    assert sorted((r.text, r.doc, r.next_text) for r in got) == want
