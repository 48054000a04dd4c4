"""Sketches rule out no pair that links; pieces emit forests, or all pairs, without refuted ones."""

import numpy as np
import pyarrow as pa
from sparkloom.llm import jaccard


def pairs(seed, n):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        size = int(rng.choice([1, 3, 40, 64, 65, 200, 700, 3000]))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.3, 0.8, 0.95, 1.0])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, size // 4 + 2))).astype(np.uint64)]))
        if len(b):
            yield a, b


def test_no_link_is_lost_and_most_others_are():
    known = list(pairs(1, 600))
    left, right = (jaccard.Sketches(pa.array([jaccard.sketch(p[i]) for p in known], pa.binary())) for i in (0, 1))
    every, (n_a, n_b) = np.arange(len(known)), (np.array([len(p[i]) for p in known]) for i in (0, 1))
    for percent in (80, 90):
        got = jaccard.may_link(left, every, right, every, n_a, n_b, percent)
        both = np.array([len(np.intersect1d(*p)) for p in known])
        links = 100 * both >= percent * (n_a + n_b - both)
        assert (got[links] >= both[links] / (n_a + n_b - both)[links] - 1e-12).all() and links.sum() > 50
        far = 100 * both < (percent - 15) * (n_a + n_b - both)
        assert (got[far] > 0).mean() < 0.1 and far.sum() > 50


def test_a_crowded_cell_rules_nothing_out():
    crowd = (np.arange(40, dtype=np.uint64) << np.uint64(40)) + np.uint64(5)
    assert jaccard.sketch(crowd) == b""
    s = jaccard.Sketches(pa.array([b"", jaccard.sketch(np.arange(40, dtype=np.uint64) << np.uint64(16))], pa.binary()))
    n = np.array([40])
    assert jaccard.may_link(s, np.array([0]), s, np.array([1]), n, n, 80)[0] > 0


def test_forests_and_refuted_pairs():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(np.append(base[i:], rng.integers(0, 1 << 63, 3).astype(np.uint64))) for i in range(12)]
    sets += [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(5)]

    def run(forest, refuted=(), cut=100):
        no = [[b for x, b in refuted if x == c] or None for c in range(len(sets))]
        rows = [(7, 0, 0, 0, c, c, len(s), jaccard.sketch(s), no[c]) for c, s in enumerate(sets)]
        kinds = [pa.int64()] * 7 + [pa.binary(), pa.list_(pa.int64())]
        table = pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["sig", "i", "j", "own", "c", "comp", "n", "sketch", "no"])
        return [p for b in jaccard._pieces(iter(table.to_batches(cut)), 80, forest) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]

    every = {(b, a) for b in range(12) for a in range(b)}
    for cut in (100, 5):  # a piece may go on in the next batch
        assert set(run(False, cut=cut)) == every and len(run(False, cut=cut)) == len(every)
        forest = run(True, cut=cut)
        assert len(forest) == 11 and set(forest) <= every
        assert set(run(False, forest, cut)) == every - set(forest) and not set(run(True, forest, cut)) & set(forest)
