"""N-gram Jaccard join with PartEnum signatures: exact links and their connected components.

Sets of equal content are one class from the start. Sizes are cut into bands of ratio BAND; a set
takes part in its own band and in each that a larger partner may lie in, so every similar pair meets
in the band of its larger set. There, two sets with similarity t or more differ in k elements at most,
k from the band's largest size. The domain is hashed into n1 parts; as k differences can't put two or
more into each part, at least n1 - k / 2 parts have one difference at most. Each part is hashed into
three; two of the three then agree, so enumerating the three pairs gives a common signature. Some
parts beyond the necessary number allow a set to leave out its empty signatures as long as fewer of
its parts have one than must agree; else it keeps them.

Signatures are sorted in a round of ``census``: a block of texts sends each once and gets back which of
them other classes have too, and the least class that has it, its centre. Classes are compared with their
centres; then, where a signature's other members still are in different components, those with one
another, in pieces of a bounded number of members. A pair is compared by size, then by counts of its sets'
elements in hashed cells, whose common part is never less than that of the sets. Of the pairs that pass, a
piece emits a forest over its components, likeliest pairs first; these have their whole sets compared. That is
done again with the new components, without the pairs that were refuted; what then still passes between different
components, which are pairs just below the limit for the most part, is compared as a whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from . import kernels as K
from .census import Block
from .common import DOC, KEY, LAST_ID, OWN, TEXT, Cuts, components, keyed, map_batches, real_id

WORDS, PERCENT = 3, 90
BAND = 1.5
#: Parts beyond the necessary number, as a share of it.
SPARE = 0.15
#: Members of a signature that are compared with one another, or with as many others, at a time.
PIECE = 1024
#: Passes over what the stars leave apart: forests, and in the last one all pairs that may link.
PASSES = 3
#: Cells of a sketch: a power of two, about the set's size.
LEAST_CELLS, MOST_CELLS = 64, 1 << 15
GROUP = OWN + "group"


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and n + 1 offsets. A-Z count as a-z. A text of fewer
    words than a shingle has one shingle of all of them; a text without words has none."""
    data, offsets = K.utf8(texts)
    _, _, by_text, hashes = K.word_hashes(K.LOWER[data], offsets, K.SPACE)
    sizes = np.diff(by_text)
    counts = np.where(sizes >= words, sizes - words + 1, (sizes > 0).astype(np.int64))
    text = np.repeat(np.arange(len(sizes)), counts)
    start = K.ranges(counts) + by_text[text]
    grams = K.hash_ranges(hashes, start, np.minimum(start + words, by_text[text + 1]), K.MULTS[3])
    at = np.append(0, np.cumsum(counts))
    sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.concatenate(sets) if sets else grams, np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def class_hash(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.append(np.uint64(0), np.cumsum(K.mix(elements ^ np.uint64(K.MULTS[1]))))
    return K.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


@cache
def band_limits(most: int) -> np.ndarray:
    """Least sizes of the bands, up to one above ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


def signatures(elements: np.ndarray, percent: int, part_of: int = 0, parts: int = 1) -> np.ndarray:
    """PartEnum signatures of one set in all its bands, or in each of ``parts`` bands the one that is ``part_of``."""
    size = len(elements)
    if not size:
        return np.zeros(0, np.uint64)
    limits = band_limits(1 << (size * 100 // percent).bit_length())
    low, high = (int(np.searchsorted(limits, x, "right")) - 1 for x in (size, size * 100 // percent))
    mixed = K.mix(elements)
    part, third = (elements >> np.uint64(32)).astype(np.int64), (elements & np.uint64(0xFFFFFFFF)).astype(np.int64) % 3
    out = []
    for band in range(low, high + 1):
        k = 2 * (int(limits[band + 1]) - 1) * (100 - percent) // (100 + percent)
        if k == 0 or band % parts != part_of:
            continue  # only equal sets link; or a band of another pass
        n1 = k // 2 + 1
        n1 += int(n1 * SPARE)
        agree = n1 - k // 2
        cell = (part % n1) * 3 + third
        sums, counts = np.zeros(3 * n1, np.uint64), np.bincount(cell, minlength=3 * n1).reshape(n1, 3)
        np.add.at(sums, cell, mixed)
        sums = sums.reshape(n1, 3)
        pairs = sums.sum(axis=1, keepdims=True) - sums
        left = counts.sum(axis=1, keepdims=True) - counts
        name = np.arange(3 * n1, dtype=np.uint64).reshape(n1, 3) + np.uint64(band << 40)
        found = K.mix(pairs + K.mix(name + np.uint64(1)) + left.astype(np.uint64))
        empty = left == 0
        keep = ~empty if int(empty.any(axis=1).sum()) < agree else np.ones_like(empty)
        out.append(found[keep])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _base(batch: pa.RecordBatch, words: int) -> pa.RecordBatch:
    elements, at = shingle_sets(batch.column(2), words)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(class_hash(elements, at).view(np.int64))], ["key", "doc", "n", "c"])


def slices(percent: int) -> int:
    """Passes in which signatures are handled, by band, so that their shuffle stays near the size of the
    texts: a lower similarity has more signatures."""
    return 1 if percent >= 90 else 2


def _signed(block: Block, words: int, percent: int, part: int, parts: int):
    """Classes of a block, each once: its text's number, name and set; and all signatures with the class of each."""
    texts = pa.Array.from_buffers(pa.large_binary(), len(block.keys), [None, pa.py_buffer(block.offsets.astype(np.int64)), pa.py_buffer(block.data)])
    elements, at = shingle_sets(texts, words)
    names, first = np.unique(class_hash(elements, at), return_index=True)
    sets = [elements[at[i] : at[i + 1]] for i in first.tolist()]
    sigs = [signatures(x, percent, part, parts) for x in sets]
    owner = np.repeat(np.arange(len(names)), [len(x) for x in sigs])
    return first, names.view(np.int64), sets, np.concatenate(sigs) if sigs else np.zeros(0, np.uint64), owner


def sketch(elements: np.ndarray) -> bytes:
    """How many elements fall into each cell, four bits for each; empty if a cell has too many."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (len(elements) - 1).bit_length()))
    counts = np.bincount((elements >> np.uint64(16)).astype(np.int64) & (cells - 1), minlength=cells)
    return (counts[0::2] << 4 | counts[1::2]).astype(np.uint8).tobytes() if counts.max() < 16 else b""


def _ask_signatures(block: Block, words: int, percent: int, part: int, parts: int, rounds: int) -> list[dict]:
    _, names, _, sigs, owner = _signed(block, words, percent, part, parts)
    # sets are compared later, so signatures may meet by chance
    return census.asked(sigs, np.zeros(len(sigs), np.uint32), names[owner], rounds, True)[0]


MEMBERS = "c long, n long, sketch binary, body binary, size long, sigs binary, lows binary"


def _members(block: Block, got: list[dict], words: int, percent: int, part: int, parts: int) -> pa.RecordBatch:
    """Classes with signatures that others have too: size, sketch, text, those signatures and their centres."""
    first, names, sets, sigs, owner = _signed(block, words, percent, part, parts)
    _, place = census.asked(sigs, np.zeros(len(sigs), np.uint32), names[owner], 1, True)
    alive, low = census.read_answers(got, names[owner], place)
    sigs, owner, low = sigs[alive], owner[alive], low[alive]
    at = np.searchsorted(owner, np.arange(len(names) + 1))
    rows = []
    for i in np.unique(owner).tolist():
        t, own = int(first[i]), slice(at[i], at[i + 1])
        text = block.data[block.offsets[t] : block.offsets[t + 1]].tobytes()
        rows.append({"c": int(names[i]), "n": len(sets[i]), "sketch": sketch(sets[i]), "body": pa.compress(text, codec="zstd", asbytes=True), "size": len(text), "sigs": sigs[own].tobytes(), "lows": low[own].tobytes()})
    kinds = [("c", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("body", pa.binary()), ("size", pa.int64()), ("sigs", pa.binary()), ("lows", pa.binary())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _edges(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(class, centre of one of its signatures)"""
    lows = [np.unique(np.frombuffer(x, np.int64)) for x in batch.column(1).to_pylist()]
    a, b = np.repeat(batch.column(0).to_numpy(), [len(x) for x in lows]), np.concatenate(lows)
    return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])


def _rest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(signature, class) but for the centres."""
    sigs, lows = (np.concatenate([np.frombuffer(x, np.int64) for x in batch.column(i).to_pylist()]) for i in (1, 2))
    c = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in batch.column(1).to_pylist()])
    return pa.RecordBatch.from_arrays([pa.array(sigs[c != lows]), pa.array(c[c != lows])], ["sig", "c"])


class Sketches:
    """The sketches of a batch, by number of cells; the double number is added up in pairs."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        self.cells = np.array([2 * len(x) for x in raw], np.int64)
        self.raw, self.by = raw, {}

    def of(self, rows: np.ndarray, cells: int) -> np.ndarray:
        if cells not in self.by:
            place, counts = np.full(len(self.raw), -1), []
            for i in np.flatnonzero((self.cells == cells) | (self.cells == 2 * cells)).tolist():
                place[i] = len(counts)
                both = np.frombuffer(self.raw[i], np.uint8)
                own = np.empty(2 * len(both), np.uint8)
                own[0::2], own[1::2] = both >> 4, both & 15
                counts.append(own if len(own) == cells else own[:cells] + own[cells:])
            self.by[cells] = place, np.array(counts, np.uint8)
        place, counts = self.by[cells]
        return counts[place[rows]]


def may_link(left: Sketches, a: np.ndarray, right: Sketches, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The largest similarity that sizes and sketches leave to each pair (a, b) of sets of n_a and n_b elements; 0
    if that is too little."""
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    out = fits * np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    cells_a, cells_b = left.cells[a], right.cells[b]
    cells = np.minimum(cells_a, cells_b)
    known = np.flatnonzero(fits & (cells > 0) & (np.maximum(cells_a, cells_b) <= 2 * cells))
    for size in np.unique(cells[known]).tolist():
        mine = known[cells[known] == size]
        for i in range(0, len(mine), max(1, (1 << 22) // size)):
            part = mine[i : i + max(1, (1 << 22) // size)]
            most = np.minimum(left.of(a[part], size), right.of(b[part], size)).sum(axis=1, dtype=np.uint32).astype(np.int64)
            union = n_a[part] + n_b[part] - most
            out[part] = (100 * most >= percent * union) * most / union
    return out


def _likely(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Of (a, b, their sizes and sketches) the pairs that may link."""
    every = np.arange(batch.num_rows)
    keep = may_link(Sketches(batch.column(4)), every, Sketches(batch.column(5)), every, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
    return batch.select([0, 1]).filter(pa.array(keep > 0))


def _pieces(batches, percent: int, forest: bool):
    """Rows (sig, i, j, own, c, comp, n, sketch, no), sorted by the first three: pairs of one piece, or of two,
    that may link, as a forest over components or all of them. ``no`` lists the classes that a class is known not
    to link with."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = [held.column(i).to_numpy() for i in range(3)]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))
        last = int(np.flatnonzero(new)[-1])  # the last piece may go on in the next batch
        if last:
            yield from _within(held.slice(0, last), np.cumsum(new[:last]), percent, forest)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield from _within(held, np.zeros(held.num_rows, np.int64), percent, forest)


def _within(rows: pa.RecordBatch, group: np.ndarray, percent: int, forest: bool):
    i, j, own, c, comp, n = (rows.column(k).to_numpy() for k in range(1, 7))
    sketches, known = Sketches(rows.column(7)), rows.column(8)
    refuted = set(zip(np.repeat(c, known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist(), known.flatten().to_pylist(), strict=True))
    left, right, scores = [], [], []
    for step in range(1, int(np.bincount(group).max())):
        a = np.flatnonzero((group[step:] == group[:-step]) & (comp[step:] != comp[:-step]) & ((i == j)[step:] | (own[step:] != own[:-step])))
        score = may_link(sketches, a, sketches, a + step, n[a], n[a + step], percent)
        left.append(a[score > 0])
        right.append(a[score > 0] + step)
        scores.append(score[score > 0])
    if not left:
        return
    left, right, scores = (np.concatenate(x) for x in (left, right, scores))
    root, u, v = {}, [], []

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    order = np.argsort(-scores, kind="stable")
    left, right = left[order], right[order]
    for a, b, x, y in zip(c[left].tolist(), c[right].tolist(), comp[left].tolist(), comp[right].tolist(), strict=True):
        x, y = top(x), top(y)
        pair = max(a, b), min(a, b)
        if x != y and pair not in refuted:
            if forest:
                root[max(x, y)] = min(x, y)
            refuted.add(pair)  # not twice
            u.append(pair[0])
            v.append(pair[1])
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])


def _linked(batch: pa.RecordBatch, words: int, percent: int) -> pa.RecordBatch:
    """Of (a, b, their texts, packed) the pairs whose sets link."""
    bodies = []
    for k in (2, 4):
        bodies.append(pa.array([pa.decompress(x, size, codec="zstd", asbytes=True) if size else b"" for x, size in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True)], pa.large_binary()))
    (x, at), (y, to) = (shingle_sets(texts, words) for texts in bodies)
    keep = []
    for i in range(batch.num_rows):
        own, other = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
        both = len(np.intersect1d(own, other, assume_unique=True))
        keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
    return batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])


def link_classes(cuts: Cuts, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, label) of the classes that link with others."""
    written = cuts.write(census.blocks(texts.select(KEY, DOC, TEXT)))
    found, parts = [], slices(percent)
    for part in range(parts):
        got = census.rounds(cuts, written, True, [lambda b, _, rounds, part=part: _ask_signatures(b, words, percent, part, parts, rounds)])
        members = census.with_answers(written, got).where("found is not null")
        found.append(cuts.write(members.mapInArrow(lambda batches, part=part: (_members(Block.of(row), row["found"], words, percent, part, parts) for batch in batches for row in batch.to_pylist()), MEMBERS)))
        cuts.drop(got)
    cuts.drop(written)
    members = found[0]
    for more in found[1:]:
        members = members.union(more)
    # copies in several blocks, and sets with signatures in several passes, have several rows
    sets = cuts.write(members.groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first(F.struct("body", "size")).alias("text")))

    def compared(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("c").alias(side), F.col("text.body").alias("body_" + side), F.col("text.size").alias("size_" + side)), side)
        pairs = pairs.select("a", "b", "body_a", "size_a", "body_b", "size_b")
        return cuts.write(map_batches(pairs, lambda b: _linked(b, words, percent), "a long, b long"))

    pairs = map_batches(members.select("c", "lows"), _edges, "a long, b long").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("c").alias(side), F.col("n").alias("n_" + side), F.col("sketch").alias("s_" + side)), side)
    pairs = map_batches(pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b"), lambda b: _likely(b, percent), "a long, b long")
    likely = cuts.write(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    linked = compared(likely)
    rest = map_batches(members.select("c", "sigs", "lows"), _rest, "sig long, c long").distinct()
    links, refuted, made = linked, cuts.write(likely.exceptAll(linked)), [likely, linked]
    for i in range(PASSES):
        labels = cuts.write(components(cuts, links.toDF("u", "v")))
        # signatures whose members, but for the centre, are still apart; of those with the same members one
        comp = F.coalesce("label", "c")
        parts = rest.join(labels, F.col("c") == F.col("node"), "left").select("sig", "c", comp.alias("comp"))
        hashes = [F.sum(F.pmod(F.xxhash64("c", F.lit(k)), F.lit(1 << 40))).alias(f"h{k}") for k in range(3)]
        apart = parts.groupBy("sig").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("many"), *hashes).where("least < most")
        apart = cuts.write(apart.groupBy("many", "h0", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("many") / PIECE).cast("int").alias("pieces")))
        parts = cuts.write(parts.join(apart, "sig"))
        for frame in (*found, apart):
            cuts.drop(frame)
        rest, found = parts.select("sig", "c"), [parts, labels]
        rows = parts.withColumn("own", F.pmod(F.xxhash64("c"), F.col("pieces")).cast("int"))
        rows = rows.select("sig", "c", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
        rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "comp")
        no = refuted.groupBy(F.col("a").alias("c")).agg(F.collect_list("b").alias("no"))
        about = sets.select("c", "n", "sketch").join(no, "c", "left")
        rows = rows.join(about, "c").select("sig", "i", "j", "own", "c", "comp", "n", "sketch", "no")
        rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        likely = cuts.write(rows.mapInArrow(lambda batches, forest=i < PASSES - 1: _pieces(batches, percent, forest), "a long, b long").distinct())
        made.append(likely)
        if not likely.head(1):
            break
        linked = compared(likely)
        links = links.union(linked)
        if i < PASSES - 1:
            before, refuted = refuted, cuts.write(refuted.union(likely.exceptAll(linked)))
            cuts.drop(before)
        made.append(linked)
    out = cuts.write(components(cuts, links.toDF("u", "v")))
    for frame in (sets, refuted, *made, *found):
        cuts.drop(frame)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, keep_key: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    Two texts link if 100 * shared shingles >= percent * all their shingles. component_id is the least
    id reachable by links, the row's own included. Null, empty and blank texts have no shingles and
    link with nothing. Null ids count after all others; a component of null ids only has a null
    component_id. Repeated rows link with each other. Extra columns are ignored; an empty table gives
    an empty result. keep_key adds the row's key and its group of linked texts, null without shingles: ids
    may be null or shared by texts that don't link, so component_id doesn't tell groups apart.
    """
    cuts = Cuts(docs.sparkSession, "jaccard")
    texts = keyed(docs, id_col, text_col)
    base = cuts.write(map_batches(texts, lambda b: _base(b, words), "key long, doc long, n long, c long"))
    labels = link_classes(cuts, texts, words, percent)
    classes = base.where("n > 0").groupBy("c").agg(F.min("doc").alias("least"))
    classes = classes.join(labels, classes["c"] == labels["node"], "left").select("c", "least", F.coalesce("label", "c").alias("label"))
    least = classes.groupBy("label").agg(F.min("least").alias("component"))
    classes = cuts.write(classes.join(least, "label").select(F.col("c").alias("class"), "component", "label"))
    both = base.join(classes, (base["c"] == classes["class"]) & (F.col("n") > 0), "left")
    out = [real_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")]
    out[2] = F.when(F.coalesce("component", "doc") != LAST_ID, F.coalesce("component", "doc")).alias("component_id")
    return both.select(*[F.col("key").alias(KEY), F.col("label").alias(GROUP)] * keep_key, *out)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked texts, that of least id, with all its columns; of texts without
    words all stay. Of rows with the same id and text one stays, of others with the least id that of least hash."""
    cuts = Cuts(docs.sparkSession, "keep")
    found = cuts.write(jaccard_components(docs, id_col, text_col, words, percent, keep_key=True))
    kept = found.where("n_shingles > 0").groupBy(GROUP).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)), KEY)).alias("one")).select(F.col(f"one.{KEY}").alias(OWN + "kept"))
    key = keyed(docs, id_col, text_col, *[F.col(f"`{c}`").alias(OWN + "c" + str(i)) for i, c in enumerate(docs.columns)])
    blank = found.where("n_shingles = 0").select(F.col(KEY).alias(OWN + "kept")).distinct()
    columns = [F.col(OWN + "c" + str(i)).alias(c) for i, c in enumerate(docs.columns)]
    full = key.join(kept.union(blank), F.col(KEY) == F.col(OWN + "kept"), "left_semi")
    repeated = found.where("n_shingles > 0").groupBy(KEY).count().where("count > 1").select(F.col(KEY).alias(OWN + "many"))
    if not repeated.head(1):
        return full.select(*columns)
    full = full.join(repeated, F.col(KEY) == F.col(OWN + "many"), "left")
    single = full.where(F.col(OWN + "many").isNull()).select(*columns)
    several = full.where(F.col(OWN + "many").isNotNull()).dropDuplicates([KEY]).select(*columns)
    return single.union(several)
