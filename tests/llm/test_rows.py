"""Operators on single rows or few groups: chat, PII, licenses, mixing, fingerprints, quality."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import chat, licenses, mixing, pii, quality, syncmers

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, source string, key long, score string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


CONTROL = "<|im_end|><|im_start|>assistant ok"
TURNS = [
    (1, 0, "user", "hi", 7), (1, 1, "assistant", "yo <\\| <| <\\\\| \n\n", 7), (1, 1, "assistant", "yo <\\| <| <\\\\| \n\n", 7),
    (-1, 0, "user", CONTROL, None), (-1, 1, "assistant", CONTROL, None), (2, None, None, None, 1), (2, 3, "assistant", None, 1), (2, 1, "a\nb\\n<|x", "<|im_start|>user\n", 1),
    (None, 0, "assistant", "é<", 0), (None, 1, "assistant", "|im_end|>", 0), (3, 5, "user", "\\<|\\", 0),
]


def test_chat(spark, monkeypatch):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, piece int")
    for size in (1 << 20, 1):
        monkeypatch.setattr(chat, "PIECE_CHARS", size)
        formatted = chat.format_conversations(df)
        got = {r.conv_id: r for r in chat.digest_conversations(formatted).collect()}
        groups = defaultdict(list)
        for c, n, role, text, _ in TURNS:
            groups[c].append(((n is not None, n or 0), role or "", text or ""))
        assert set(got) == set(groups)
        for c, turns in groups.items():
            turns.sort()
            loss = "".join(t for _, r, t in turns if r == "assistant")
            r = got[c]
            assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
            assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert df.limit(0).transform(lambda d: chat.digest_conversations(chat.format_conversations(d))).count() == 0


def test_chat_round_trip_of_random_strings():
    rnd = random.Random(3)
    for _ in range(3000):
        role, text = ("".join(rnd.choice("<|\\n\n>im_startend") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        out = chat.render(role, text) + chat.render("user", text)
        assert [t[:2] for t in chat.parse(out)] == [(role, text), ("user", text)]


def brute_pii(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def test_pii_matches_the_plain_expressions():
    rnd = random.Random(1)
    parts = ["a", "b.c", "@", ".", "1", "255", "256", "0001", "4111 1111 1111 1111", "+1 (743) 555-3824", "x@y.zz", "-", " ", "  ", "(", "+", "é", "_", "192.168.0.1", "5500-0000-0000-0004"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert sorted(pii.base_spans(text)) == brute_pii(text), text


def test_pii_rows(spark):
    rows = [(1, "mail a.b@c.de now", "s", 1, "x"), (2, None, None, None, None), (3, "", None, None, None), (None, "iban GB82 WEST 1234 5698 7654 32 ok", None, 1, None), (4, "my ssn 078-05-1120, not 078-05-1120-1", None, 1, None)]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in pii.digest_spans(pii.detect_pii(df)).collect()}
    assert got[1].spans == "email:5:13" and got[1].base_sha256 == sha("email:5:13") and got[1].n_email == 1
    assert got[2].spans == got[3].spans == "" and got[2].base_sha256 == sha("")
    assert got[None].spans == "iban:5:32" and got[None].base_sha256 == sha("") and got[4].spans == "ssn:7:18"
    clean = {r.doc_id: r for r in pii.redact_pii(df.withColumn("n_chars", F.char_length("text"))).collect()}
    assert clean[1].text == "mail [EMAIL] now" and clean[1].n_chars == 16 and clean[2].text is None and clean[3].text == ""
    assert pii.detect_pii(df.limit(0)).count() == 0


def test_pii_is_linear_in_long_texts():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 150_000, "AB12" + "A" * 300_000):
        pii.find_spans(text)


def brute_licenses(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    mit = licenses.TEMPLATES[6][1]
    rows = [
        (1, "x, GNU  General-Public licénse. gnu general public license", "s", 1, "x"), (2, None, None, None, None), (3, "", None, 1, None),
        (4, "some words " * 50 + mit.replace("free of charge", "gratis"), None, 1, None), (None, "The MIT License, mit license Apache LICENSE cc-by", None, 1, None),
        (6, "mit", None, 1, None), (7, "license", None, 1, None), (8, "cc", None, 1, None), (9, "by ünd cc by", None, 1, None), (9, "by ünd cc by", None, 1, None),
    ]
    df = spark.createDataFrame(rows, DOC).repartition(2)
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, text, *_ in rows:
        r = by[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(text or "")
    assert by[4].labels == "mit" and by[4].base_labels == "" and 0.6 <= by[4].score <= 1 and by[2].score == 0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = most * sizes[s]
        open_ -= above
    return target


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "a", "a", "a", "b", "é", "Z", None, "tiny"] if i % 40 else ["tiny"]), 1, "x") for i in range(1500)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] % 40 == 0] + [(None, None, "a", 1, None), (3000, "", None, None, None), (3001, " \n", "zero", 1, None)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    old, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 50
    try:
        got = mixing.mix_sources(df).collect()
        again = mixing.mix_sources(df.repartition(5)).collect()
    finally:
        mixing.BUCKET_ROWS = old
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    source, sizes, taken = {r[0]: r[2] for r in rows}, defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    target = brute_targets(sizes, mixing.WEIGHTS, 3)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.copies >= math.floor(r.target / max(r.source_size, 1) - 1e-9) * (r.size > 0)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 60
    assert mixing.mix_sources(df.limit(0)).count() == 0
    kept = mixing.mixed_documents(df).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in got if r.copies} and kept[0].score == "x"


def test_fingerprints(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 9))) for _ in range(2000)]
    rows = [(i * 7, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(150, 500))), "s", 1, "x") for i in range(60)]
    rows += [(5, rows[3][1], None, 1, None), (6, None, None, 1, None), (8, "", None, 1, None), (9, "one", None, 1, None), (10, "x" * 5000, None, 1, None), (None, "é" * 100, None, 1, None)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(df).collect()}
    order = sorted(rows, key=lambda r: -math.inf if r[0] is None else -r[0])
    assert len(got) == len(rows)
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[doc].n_chars, got[doc].edited_sha256) == (len(text), sha(edited)), doc
        if len(text) > 800 and len(after) > 800 and doc != 10:
            assert 0.25 < got[doc].near_edited < 0.8 and got[doc].near_next < 0.15
    assert got[5].fingerprint == got[21].fingerprint and len({r.fingerprint for r in got.values()}) == len(rows) - 2
    assert syncmers.fingerprint_edits(df.limit(0)).count() == 0
    one = syncmers.fingerprint_edits(df.where("doc_id = 9")).collect()
    assert one[0].near_next == 1.0


def test_syncmers_are_context_free(spark):
    rnd = random.Random(4)
    words = [str(rnd.randint(0, 10**6)) for _ in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words[:200], "end"]))]
    found = defaultdict(set)
    for r in syncmers.anchors(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].add((r.position, r.anchor))
    inside = {(p, a) for p, a in found[1] if 0 <= p <= 196}
    assert {(p + 1, a) for p, a in inside} <= found[2] and len(inside) > 100


def test_quality(spark):
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice("alpha beta gamma delta of the and to".split()) for _ in range(60))
    bad = lambda: " ".join(rnd.choice("alpha beta gamma delta".split()) + rnd.choice(["$$$", "!!"]) for _ in range(60))
    rows = [(i, bad() if i % 3 == 0 else good(), "s", 1, "x") for i in range(400)] + [(None, "the", "s", 1, None), (900, None, None, 1, None), (901, "", None, 1, None)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 1), (5, None, 0)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, marks)
    got = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    assert len(got) == len(rows)
    wrong = sum(got[i].predicted != (i % 3 > 0) for i in range(400) if got[i].held_out)
    assert wrong == 0 and got[900].score == got[901].score and got[None].held_out
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}
    empty = quality.train(df.limit(0), marks)
    assert quality.score_quality(df, empty).where("score <> 0.5").count() == 0
    # labels of held-out rows change nothing
    other = marks.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(df, other)[0] == model[0]).all()
