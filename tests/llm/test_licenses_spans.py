"""Labels of edited license texts: recall, and the plain diagonal vote."""

import random
import re
from collections import defaultdict

from sparkloom.llm import licenses
from sparkloom.llm.common import KEY, TEXT

K = licenses.K_WORDS


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def plain(text):
    """(template, start, end, score) by comparing words at each pair of positions."""
    w, out = words(text), set()
    for t, (_, template) in enumerate(licenses.TEMPLATES):
        p = words(template)
        met = defaultdict(set)
        for i in range(len(w) - K + 1):
            for j in range(len(p) - K + 1):
                if w[i : i + K] == p[j : j + K]:
                    met[i - j].add(j)
        bands, last = [], None
        for d in sorted(met):
            if last is None or d - last > licenses.NEAR:
                bands.append([])
            bands[-1].append(d)
            last = d
        for band in bands:
            got = {j + x for d in band for j in met[d] for x in range(K)}
            at = [d + j for d in band for j in met[d]]
            if len(got) / len(p) >= licenses.MIN_COVERED:
                out.add((t, min(at), max(at) + K, round(len(got) / len(p), 9)))
    return out


def test_spans_are_those_of_a_plain_vote_and_labels_are_found(spark):
    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("abdeiklmnorst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    texts, wanted = [], []
    for t, (label, template) in enumerate(licenses.TEMPLATES):
        for _ in range(6):
            p = template.split()
            if len(p) > 14:
                for _ in range(len(p) // 15):
                    i = rnd.randrange(len(p))
                    p[i : i + 1] = rnd.choice([[], ["changed"], [p[i], "more"]])
            texts.append(f"{prose(rnd.randint(0, 60))} {rnd.choice([' ', chr(10) + '# '])}{' '.join(p)} {prose(rnd.randint(0, 60))}")
            wanted.append(label)
    clean = [prose(80) for _ in range(40)] + ["the license of the software is free of charge to any person", "software distributed under any law"]
    rows = list(enumerate(texts + clean)) + [(None, None), (900, ""), (901, "a " * 50_000 + licenses.TEMPLATES[0][1]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    right = sum(w in got[i].labels.split(",") for i, w in enumerate(wanted))
    assert right >= 0.95 * len(wanted) and len(wanted) == 6 * len(licenses.TEMPLATES)
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(len(texts), len(texts) + len(clean)))
    assert got[901].labels == "apache" and got[None].labels == got[900].labels == ""
    keyed = licenses.keyed(df)
    found = defaultdict(set)
    for r in licenses.license_spans(keyed).collect():
        found[r["key"]].add((r.template, r.start, r.end, round(r.score, 9)))
    for r in keyed.where("length(__loom_text) < 5000").collect():
        assert found[r[KEY]] == plain(r[TEXT]), r[TEXT]
