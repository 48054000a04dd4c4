"""Secrets and scores, against plain rules on planted rows."""

import random
import re

from sparkloom.llm import pii


def kinds(text):
    return [(k, text[s:e]) for k, s, e, _ in pii.find_spans(text)]


def test_keys_and_passwords():
    aws, gh = "AKIA" + "ABCD1234" * 2, "ghp_" + "aB3" * 12
    for key in (aws, gh, "sk-" + "x1Y2" * 8, "-----BEGIN RSA PRIVATE KEY-----"):
        assert kinds(f"use {key} now") == [("key", key)], key
    assert kinds("x" + aws) == [] and kinds(aws + "9") == []
    assert kinds('password = "hunter2!" ok') == [("secret", "hunter2!")] and kinds("pwd: abcdef") == [("secret", "abcdef")]
    assert kinds("the password is long") == [] and kinds("bypassword=abcdefg") == []


def test_long_strings_need_a_word_nearby():
    rnd = random.Random(3)
    found = clean = 0
    for _ in range(400):
        value = "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice([20, 32, 40, 64]))) + "a1"
        words = " ".join("".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 9))) for _ in range(12))
        for name in ("token", "api_key", "SECRET", "auth"):
            found += ("secret", value) in kinds(f'{words} {name} = "{value}" {words}')
        far = kinds(f"{words} sum {value} {words}") + kinds(f"{words} token {words} {words} {words} {value}")
        clean += not any(k == "secret" for k, _ in far)
    assert found == 1600 and clean == 400


def plain_score(text, kind, start, end):
    near = set(re.findall("[a-z]+", (text[max(0, start - 40) : start] + " " + text[end : end + 40]).lower()))
    return min(1.0, pii.PRIOR[kind] + 0.3 * bool(near & set(pii.CONTEXT[kind])))


def test_scores(spark):
    texts = ["card 4111 1111 1111 1111", "4111 1111 1111 1111", "mail a@b.cc", "nothing", None, "", 'token = "' + "a1" * 20 + '"', "ssn 078-05-1120", "ssn 000-05-1120", "078-05-1120"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest_spans(pii.detect_pii(df)).collect()}
    for i, text in enumerate(texts):
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        assert got[i].n_spans == len(spans)
        assert got[i].scores == ",".join(f"{plain_score(text, k, int(s), int(e)):.1f}" for k, s, e in spans)
    assert [i for i in got if got[i].n_spans] == [0, 1, 2, 6, 7]


def test_long_runs_take_linear_time():
    for text in ("password" * 40_000, "token a1" + "b" * 300_000, "key " + "a1-" * 100_000, "eyJ" * 100_000, "sk-" * 100_000, "password= " * 30_000):
        pii.find_spans(text)
