"""Benchmark decontamination by the q-gram lemma.

The patterns of a benchmark item are all its windows of WINDOW bytes, one at each offset; a shorter item
is one pattern. A text is contaminated if some region of it is within floor(EDIT_RATE * m) edits of a
pattern of m bytes (bytes compared with A-Z as a-z). By the q-gram lemma such a region shares at least
m - q + 1 - q * e q-grams with the pattern, on diagonals that differ by e at most: the q-grams of whole
items are counted in overlapping bands of diagonals, windows of a band with fewer than the bound are
dropped without loss, and the rest are verified by banded alignment. Items of fewer than MIN_ITEM bytes, which the lemma can't filter,
are looked for as they are, without white space around them, where they begin and end at word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import DOC, KEY, OWN, TEXT, Cuts, bounded_batches, keyed, real_id

Q = 8
WINDOW = 96
EDIT_RATE = 0.1
#: Items of fewer bytes have no edit budget.
MIN_ITEM = 32
#: Bytes of benchmark text that the driver and an executor hold an index of at a time; a larger benchmark takes more passes.
BLOCK_BYTES = 2 << 20
_BITS = 22
#: Shared q-grams and alignments that are held at a time, about.
HITS, ALIGNED = 1 << 18, 4096
#: Longer texts are searched in pieces of K.PIECE bytes that overlap by so many, more than any region has.
OVERLAP = 512
#: Periods, in bytes, of repetitive stretches that are shortened, and what stays of one.
PERIODS, STRETCH = range(1, 9), 512


def shortened(data: np.ndarray) -> np.ndarray:
    """The text with stretches that repeat a short period cut to STRETCH bytes and a part of the period.

    A region is shorter than what stays, so it touches one end of a stretch at most, and each region of
    the whole text is one of the shortened text as well; joints within a stretch make no new ones."""
    for period in PERIODS:
        same = np.zeros(len(data) + 1, np.int8)
        same[period:-1] = data[period:] == data[:-period] if len(data) > period else 0
        steps = np.diff(np.append(np.int8(0), same))
        start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        long = end - start > STRETCH + period
        if long.any():
            keep = np.ones(len(data), bool)
            for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
                keep[a + STRETCH : a + STRETCH + (b - a - STRETCH) // period * period] = False
            data = data[keep]
    return data


class Patterns:
    """The index of one block of items: edit budgets of their windows, and the places of their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, window: int = WINDOW, rate: float = EDIT_RATE, least: int = MIN_ITEM):
        raws = [(item, shortened(K.LOWER[np.frombuffer((text or "").encode(), np.uint8)])) for item, text in items]
        long = [(item, raw) for item, raw in raws if len(raw) >= max(least, q)]
        short = [(item, raw.tobytes().strip()) for item, raw in raws if len(raw) < max(least, q)]
        #: Items to be found as they are: by size, bytes and their items.
        self.exact: dict[int, dict[bytes, list[int | None]]] = {}
        for item, raw in short:
            if raw:
                self.exact.setdefault(len(raw), {}).setdefault(raw, []).append(item)
        self.q, self.ids = q, [item for item, _ in long]
        lengths = np.array([len(raw) for _, raw in long], np.int64)
        self.sizes = np.minimum(lengths, window)
        self.starts = lengths - self.sizes + 1
        # an edit budget that leaves no q-gram to share can't be filtered; short patterns get a smaller one
        self.edits = np.minimum((self.sizes * rate).astype(np.int64), np.maximum((self.sizes - q) // q, 0))
        self.bound = self.sizes - q + 1 - q * self.edits
        self.flat = np.concatenate([raw for _, raw in long]) if long else np.zeros(0, np.uint8)
        self.begin = np.append(0, np.cumsum(lengths)).astype(np.int64)
        counts = lengths - q + 1
        item = np.repeat(np.arange(len(lengths)), counts)
        at = K.ranges(counts) if len(counts) else np.zeros(0, np.int64)
        grams = grams_of(self.flat, q)[self.begin[item] + at] if len(item) else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.item, self.at = item[order], at[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        #: Sorted: the number of each place's q-gram and, in it, of its item.
        self.order = np.repeat(np.arange(len(self.grams)), self.last - self.first) * len(long) + self.item
        #: The item of each q-gram that only one item has, else -1.
        ends = (self.item[self.first], self.item[self.last - 1]) if len(order) else (self.first, self.first)
        self.sole = np.where(ends[0] == ends[1], ends[0], -1)  # items ascend within a q-gram
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @cached_property
    def _windows(self) -> list[tuple[int | None, np.ndarray, int]]:
        long = [(self.ids[i], self.flat[b : b + self.sizes[i]], int(self.edits[i])) for i in range(len(self.ids)) for b in range(self.begin[i], self.begin[i] + self.starts[i])]
        return long + [(item, np.frombuffer(raw, np.uint8), 0) for known in self.exact.values() for raw, items in known.items() for item in items]

    @cached_property
    def items(self) -> list[int | None]:
        """The item of each pattern."""
        return [w[0] for w in self._windows]

    @cached_property
    def texts(self) -> list[np.ndarray]:
        """The bytes of each pattern; the search itself doesn't list them."""
        return [w[1] for w in self._windows]

    @cached_property
    def budget(self) -> list[int]:
        """The edit budget of each pattern."""
        return [w[2] for w in self._windows]


def grams_of(data: np.ndarray, q: int) -> np.ndarray:
    """The hash of each q-gram of bytes."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    sums = K.prefix(K.BYTE_VALUES[data], K.MULTS[0])
    return K.mix((sums[q:] - sums[:-q]) * K.powers(K.MULTS[0], len(data) + 1)[1][: len(data) - q + 1])


def aligned(patterns: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edits between each pattern (row of n bytes) and any part of its region (row of n + b bytes)
    along the band of b + 1 diagonals; regions are padded with values that match nothing."""
    n, width = patterns.shape[1], regions.shape[1] - patterns.shape[1] + 1
    step = np.arange(width)
    row = np.zeros((len(patterns), width), np.int32)
    for i in range(n):
        new = row + (patterns[:, i : i + 1] != regions[:, i : i + width])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row.min(axis=1)


def _hits(data: np.ndarray, offsets: np.ndarray, index: Patterns):
    """Places of the q-grams that the texts share with items: (byte, number of the q-gram, text)."""
    q = index.q
    grams = grams_of(data, q)
    hit = np.flatnonzero(index.maybe[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
    where = np.searchsorted(index.grams, grams[hit])
    known = where < len(index.grams)
    hit, where = hit[known], where[known]
    known = index.grams[where] == grams[hit]
    hit, where = hit[known], where[known]
    text = np.searchsorted(offsets, hit, "right") - 1
    whole = hit + q <= offsets[text + 1]
    return hit[whole], where[whole], text[whole]


def _by_items(hit, where, text, offsets, index: Patterns, low: int, high: int):
    """Candidates among the items low..high-1, in as many parts as bound the places that are held at a time."""
    first, last = (np.searchsorted(index.order, where * len(index.ids) + x) for x in (low, high))
    total = int((last - first).sum())
    if total > 2 * HITS and high - low > 1:
        middle = (low + high) // 2
        yield from _by_items(hit, where, text, offsets, index, low, middle)
        yield from _by_items(hit, where, text, offsets, index, middle, high)
    elif total:
        yield _candidates(hit, first, last - first, text, offsets, index)


def _candidates(hit: np.ndarray, first: np.ndarray, counts: np.ndarray, text: np.ndarray, offsets: np.ndarray, index: Patterns):
    """(text, item, lowest diagonal, first and last start) of runs of windows that meet the bound."""
    place = np.repeat(first, counts) + K.ranges(counts)
    item, at = index.item[place], index.at[place]
    text = np.repeat(text, counts)
    diagonal = np.repeat(hit, counts) - offsets[text] - at
    band = diagonal // (index.edits[item] + 1)  # bands of two steps, one apart: e + 1 neighbouring diagonals share one
    pair = text * len(index.ids) + item
    least, span = band.min() - 1, band.max() - band.min() + 2
    key = np.concatenate([pair * span + band - least, pair * span + band - 1 - least])
    order = np.argsort(key)
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    count = np.diff(np.append(new, len(key)))
    enough = np.repeat(count >= index.bound[item[order[new] % len(item)]], count)
    order = order[enough]
    order = order[np.lexsort((at[order % len(at)], key[order]))]
    key, at, item, text = key[order], at[order % len(at)], item[order % len(item)], text[order % len(text)]
    if not len(key):
        return [np.zeros(0, np.int64)] * 5
    # a window meets the bound if it covers some q-gram of the band and the one that is bound - 1 later
    end = np.arange(len(key)) + index.bound[item] - 1
    inside = end < len(key)
    end = np.minimum(end, len(key) - 1)
    reach = index.sizes[item] - index.q
    good = inside & (key[end] == key) & (at[end] - at <= reach)
    low, high = np.maximum(at[end] - reach, 0), np.minimum(at, index.starts[item] - 1)
    good &= low <= high
    key, item, text, low, high = (x[good] for x in (key, item, text, low, high))
    if not len(key):
        return [np.zeros(0, np.int64)] * 5
    # both ends ascend within a band: runs that touch are one
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] > high[:-1] + 1)))
    last = np.append(new[1:], len(key)) - 1
    return text[new], item[new], (key[new] % span + least) * (index.edits[item[new]] + 1), low[new], high[last]


def _edits(data: np.ndarray, offsets: np.ndarray, index: Patterns, text, item, low, start) -> np.ndarray:
    """Least edits of the window of each item at each start, on the band's diagonals."""
    out = np.zeros(len(text), np.int64)
    sizes, edits = index.sizes[item], index.edits[item]
    for m, e in np.unique(np.stack([sizes, edits]), axis=1).T.tolist():
        mine = np.flatnonzero((sizes == m) & (edits == e))
        for i in range(0, len(mine), ALIGNED):
            part = mine[i : i + ALIGNED]
            at = (low[part] + start[part])[:, None] + np.arange(m + 2 * e + 1)[None, :]
            inside = (at >= 0) & (at < (offsets[1:] - offsets[:-1])[text[part]][:, None])
            regions = np.where(inside, data[np.clip(offsets[text[part]][:, None] + at, 0, len(data) - 1)], 256).astype(np.int16)
            rows = index.flat[(index.begin[item[part]] + start[part])[:, None] + np.arange(m)[None, :]].astype(np.int16)
            out[part] = aligned(rows, regions)
    return out


def _joined(before: bytes, after: bytes) -> bool:
    """Whether the place between two pieces of text is inside a word. Scripts without spaces have no words here."""
    a, b = before[-4:].decode(errors="ignore")[-1:], after[:4].decode(errors="ignore")[:1]
    return all((c.isalnum() or c == "_") and not ("\u0e00" <= c < "\u10a0" or "\u1780" <= c < "\u1800" or c >= "\u2e80") for c in (a, b)) if a and b else False


def exact_leaks(data: np.ndarray, offsets: np.ndarray, index: Patterns, cut: tuple[bool, bool] = (False, False)) -> set[tuple[int, int | None]]:
    """(text, item) of the short items that a text has between word boundaries. ``cut``: whether the texts go
    on before their first and after their last byte; what touches those is left to the neighbouring piece."""
    found = set()
    for size, known in index.exact.items():
        grams = grams_of(data, size)
        names = {int(grams_of(np.frombuffer(raw, np.uint8), size)[0]): raw for raw in known}
        hit = np.flatnonzero(np.isin(grams, np.array(list(names), np.uint64)))
        text = np.searchsorted(offsets, hit, "right") - 1
        whole = hit + size <= offsets[text + 1]
        hit, text = hit[whole], text[whole]
        done = set()
        for a, t, name in zip(hit.tolist(), text.tolist(), grams[hit].tolist(), strict=True):
            if (t, name) in done:
                continue
            raw, (low, high) = names[name], offsets[t : t + 2].tolist()
            if cut[0] and a - low < 4 or cut[1] and high - a - size < 4:
                continue
            around = data[max(low, a - 4) : a].tobytes(), data[a + size : min(high, a + size + 4)].tobytes()
            if data[a : a + size].tobytes() == raw and not _joined(around[0], raw) and not _joined(raw, around[1]):
                done.add((t, name))
                found |= {(t, item) for item in known[raw]}
    return found


def leaks(data: np.ndarray, offsets: np.ndarray, index: Patterns) -> list[tuple[int, int]]:
    """Verified (text, number of the item) pairs, distinct and sorted."""
    if not len(index.grams) or not len(data):
        return []
    hit, where, owner = _hits(data, offsets, index)
    # texts whose q-grams are in many places of items for each byte are repetitive
    many = np.bincount(owner, index.last[where] - index.first[where], len(offsets) - 1) > 16 * np.diff(offsets)
    if many.any():
        texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        texts = [shortened(x) if m else x for x, m in zip(texts, many.tolist(), strict=True)]
        data, offsets = np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts])).astype(np.int64)
        hit, where, owner = _hits(data, offsets, index)
    found, i = np.zeros(0, np.int64), 0
    while i < len(hit):
        # a slice takes up the bytes before it that a region may begin in
        before = np.cumsum(index.last[where[i:]] - index.first[where[i:]])
        j = i + max(1, int(np.searchsorted(before, HITS, "right")))
        k = int(np.searchsorted(hit, hit[i] - 2 * int(index.sizes.max())))
        for text, item, low, first, last in _by_items(hit[k:j], where[k:j], owner[k:j], offsets, index, 0, len(index.ids)):
            # windows d apart differ by d edits at most on the same diagonals, so one of v edits rules out
            # those nearer than v - e; the two sides that it leaves of its run are halved in turn
            while len(text):
                middle = (first + last) // 2
                over = _edits(data, offsets, index, text, item, low, middle) - index.edits[item]
                pair = text * len(index.ids) + item
                found = np.union1d(found, pair[over <= 0])
                text, item, low, pair = (np.append(x, x) for x in (text, item, low, pair))
                first, last = np.append(first, middle + over), np.append(middle - over, last)
                left = (first <= last) & ~np.isin(pair, found)
                text, item, low, first, last = (x[left] for x in (text, item, low, first, last))
        # places of an item that the text is known to have needn't be looked at again
        sole = index.sole[where[j:]]
        left = np.append(np.arange(j), j + np.flatnonzero((sole < 0) | ~np.isin(owner[j:] * len(index.ids) + sole, found)))
        hit, where, owner, i = hit[left], where[left], owner[left], j
    return [divmod(x, len(index.ids)) for x in found.tolist()]


def _cut_pieces(offsets: np.ndarray):
    """Slices (first text, last text, begin, end) of a batch: texts of K.PIECE bytes in all, or pieces of a longer one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        begin = int(offsets[i])
        if offsets[i + 1] - begin > K.PIECE:
            end = int(offsets[i + 1])
            for a in range(begin, end - OVERLAP, K.PIECE - OVERLAP):
                yield i, i + 1, a, min(end, a + K.PIECE)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, begin + K.PIECE, "right")) - 1)
        yield i, j, begin, int(offsets[j])
        i = j


def _by_text(column: pa.Array, index: Patterns) -> list[set]:
    """Item ids found in each text."""
    data, offsets = K.utf8(column)
    found = [set() for _ in range(len(column))]
    for i, j, a, b in _cut_pieces(offsets):
        part, own = K.LOWER[data[a:b]], np.clip(offsets[i : j + 1], a, b) - a
        for text, item in leaks(part, own, index):
            found[i + text].add(index.ids[item])
        for text, item in exact_leaks(part, own, index, (a > offsets[i], b < offsets[j])):
            found[i + text].add(item)
    return found


def benchmark_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Patterns]:
    """Indexes of blocks of the benchmark of about ``block_bytes``, one at a time; one empty index of none."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // block_bytes + 1
    part = F.pmod(F.xxhash64("id", "t"), F.lit(n))
    for k in range(n):
        yield Patterns(sorted(((r.id, r.t) for r in rows.where(part == k).distinct().collect()), key=repr))


def _found(texts: DataFrame, index: Patterns) -> DataFrame:
    """(key, doc, items) of ``keyed`` rows for one block of the benchmark."""

    def run(batches):
        for b in batches:
            found = [sorted({-1 if x is None else x for x in own}) for own in _by_text(b.column(2), index)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["key", "doc", "items"])

    return texts.select(KEY, DOC, TEXT).mapInArrow(run, "key long, doc long, items array<long>")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items and items (ids of the benchmark items with a region in the text).

    Every whole text meets every item: one pass over the texts for each block of items, without a shuffle
    if there is one block. Otherwise what each further block finds is written, and joined in the end; never
    is more than one block held. Null and empty texts, and an empty benchmark, give none; items without id
    count as -1; null ids stay null; repeated rows are searched each; extra columns are ignored; an empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    texts, cuts = keyed(docs, id_col, text_col), None
    blocks = benchmark_blocks(items, block_bytes=block_bytes)
    rows, more = _found(texts, next(blocks)), []
    for index in blocks:
        cuts = cuts or Cuts(docs.sparkSession, "leaks")
        more.append(cuts.write(_found(texts, index).where("size(items) > 0").select("key", "doc", "items")))
    if more:
        hits = more[0]
        for one in more[1:]:
            hits = hits.union(one)
        hits = hits.groupBy("key", "doc").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("others"))
        rows = rows.join(hits, ["key", "doc"], "left").withColumn("items", F.array_sort(F.array_union("items", F.coalesce("others", F.array().cast("array<long>")))))
    return rows.select(real_id("doc").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without any region of the benchmark, with all their columns, without a shuffle.

    Each block of the benchmark is a pass over what the one before kept, which is written between them.
    Null and empty texts stay; repeated rows are judged each; an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    name, schema, cuts, kept = OWN + "searched", docs.schema, None, None
    for index in benchmark_blocks(items, block_bytes=block_bytes):
        if kept is not None:
            cuts = cuts or Cuts(docs.sparkSession, "leaks")
            docs = cuts.write(kept)

        def run(batches, index=index):
            for b in batches:
                keep = [not x for x in _by_text(b.column(b.num_columns - 1), index)]
                yield b.select(list(range(b.num_columns - 1))).filter(pa.array(keep, pa.bool_()))

        kept = docs.withColumn(name, F.col(text_col)).mapInArrow(run, schema)
    return kept
