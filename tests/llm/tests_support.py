"""Plain versions that several tests compare with."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def shingle_groups(texts, n, percent):
    """Sets of ids connected by links between texts of similar shingle sets."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    group = {i: {i} for i in sets}
    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and 100 * both >= percent * (len(x) + len(y) - both) and group[ids[a]] is not group[ids[b]]:
                merged = group[ids[a]] | group[ids[b]]
                for i in merged:
                    group[i] = merged
    return {frozenset(g) for g in group.values()}
