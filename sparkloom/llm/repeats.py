"""Exact repeated windows over a corpus, found through winnowed anchors.

Shared by substring dedup on words and suffix-bucket dedup on bytes. A window of W tokens selects one
anchor, the q-gram of least hash in it, by its content alone. So equal windows have equal anchors at
equal offsets, and only windows whose anchor occurs twice can repeat. Neighbouring windows with the
same anchor form a run; each round of sorting (see ``census``) settles or drops most of what is left:

1. texts and anchors: a text that others have as a whole is settled (one owner stays as a source of
   windows); anchors that nobody else has are dropped with their windows;
2. runs, by anchor and content of all their windows: equal runs are settled as a whole, one stays;
3. blocks of neighbouring windows, aligned on the anchor, in smaller and smaller sizes: by the core that
   all windows of a whole block have in common (not had by others: dropped) and by content (had by
   others: settled);
4. single windows.

What a block of texts sends is bounded by the names in it, whatever their groups' sizes are; no step
emits pairs, joins on a name, or brings the members of a group together as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import census
from . import kernels as K
from .census import Block
from .common import LAST_ID, Cuts


@dataclass(frozen=True)
class Windows:
    """width: tokens of a window; q: tokens of an anchor; words: tokens are words, else bytes;
    earlier: a window counts as repeated if a smaller id has it, else if it occurs anywhere else."""

    width: int
    q: int
    words: bool
    earlier: bool
    #: Windows in a block, level by level; the last is 1.
    levels: tuple[int, ...] = (1,)
    #: Gives token ranges 64-bit names, equal for equal content.
    names: Callable = K.hash_ranges

    def tokens(self, block: Block):
        """Token array, offsets by text, table of token values or None."""
        if not self.words:
            return block.data, block.offsets, K.BYTE_VALUES
        _, _, by_text, hashes = K.word_hashes(block.data, block.offsets, K.SPACE)
        return hashes, by_text, None

    def owners(self, block: Block) -> np.ndarray:
        return block.docs if self.earlier else block.keys


class _Step:
    """One round's view of a block."""

    def __init__(self, win: Windows, block: Block, got: list[dict], parts: int):
        self.win, self.got, self.parts, self.owner = win, got, parts, win.owners(block)
        self.tokens, self.offsets, self.table = win.tokens(block)
        self.state = next((census.unpack(x["state"]) for x in got if x["part"] < 0), {})

    def name(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of token ranges; equal ranges with another salt are other names."""
        names = self.win.names(self.tokens, start, end, K.MULTS[2], self.table)
        return names if salt is None else K.mix(names ^ salt), (K.hash_ranges(self.tokens, start, end, K.MULTS[3], self.table) >> np.uint64(32)).astype(np.uint32)

    def send(self, names: np.ndarray, checks: np.ndarray, owners: np.ndarray, **state: np.ndarray) -> list[dict]:
        """Rows that ask for names, and the row with what the block keeps until they are answered."""
        rows, place = census.asked(names, checks, owners, self.parts, self.win.earlier)
        if state:
            state = {k: v.astype(np.int32) if k in ("text", "rows") else v for k, v in state.items()}
            rows.append({"part": -1, "state": census.pack(place=place.astype(np.int32), **state)})
        return rows

    def answers(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(had by others, least owner) of what the block asked about, whose texts are ``text``."""
        return census.read_answers(self.got, self.owner[text], self.state["place"])

    def settled(self, alive: np.ndarray, low: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are repeated, and which stay in the search: those that may still be, and one owner's of equal ones."""
        return (low < owner, low >= owner) if self.win.earlier else (alive, ~alive | (low == owner))


def _places(first: np.ndarray, off: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A place: the first window, how far the anchor starts from it, the number of windows."""
    return first << 16 | off << 8 | count


def _initial(step: _Step) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Names of the texts as wholes, then of their anchors; and the runs of windows."""
    raw, at = step.tokens.view(np.uint8), step.offsets * step.tokens.itemsize
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    whole = np.frombuffer(digests, np.uint64)
    runs = K.segments(step.tokens, step.offsets, step.win.q, step.win.width, step.table)
    names = np.concatenate([whole[::2], K.mix(runs[3])])
    # an anchor's bucket may hold others too, as all of a run's bytes are compared later
    return names, np.append((whole[1::2] >> np.uint64(32)).astype(np.uint32), np.zeros(len(runs[3]), np.uint32)), runs


def _ask_texts(win: Windows, block: Block, got: list[dict], parts: int) -> list[dict]:
    step = _Step(win, block, got, parts)
    names, checks, runs = _initial(step)
    return step.send(names, checks, step.owner[np.append(np.arange(len(step.owner)), runs[0])])


def _ask_runs(win: Windows, block: Block, got: list[dict], parts: int) -> list[dict]:
    step = _Step(win, block, got, parts)
    names, checks, (text, first, count, anchor, off) = _initial(step)
    n = len(step.owner)
    _, place = census.asked(names, checks, step.owner[np.append(np.arange(n), text)], parts, win.earlier)
    step.state = {"place": place}
    alive, low = step.answers(np.append(np.arange(n), text))
    done, stay = step.settled(alive[:n], low[:n], step.owner)
    whole = done & (np.diff(step.offsets) >= win.width)
    keep = alive[n:] & stay[text]
    text, first, count, off = (x[keep] for x in (text, first, count, off))
    start = first + step.offsets[text]
    names, checks = step.name(start, start + count + win.width - 1, off.astype(np.uint64) << np.uint64(8) | count.astype(np.uint64))
    return step.send(names, checks, step.owner[text], whole=whole, text=text, at=_places(first, off, count), rows=text[:0], done=first[:0])


def _ask_blocks(win: Windows, block: Block, got: list[dict], parts: int, size: int, before: int) -> list[dict]:
    """Blocks of ``size`` windows of what the last round (``before`` windows a block, 0: runs) left open."""
    step = _Step(win, block, got, parts)
    if not step.state:
        return []
    rows, done, text, at = _left(step, before)
    first, off, count = at >> 16, at >> 8 & 255, at & 255
    low = (off - count + 1) // size
    counts = off // size - low + 1
    place, high_off, low_off, text = (np.repeat(x, counts) for x in (first + off, off, off - count + 1, text))
    number = np.repeat(low, counts) + K.ranges(counts)
    high, least = np.minimum(high_off, number * size + size - 1), np.maximum(low_off, number * size)
    at, base = _places(place - high, high, high - least + 1), place + step.offsets[text]
    # equal windows have equal anchors at equal offsets: their content holds the anchor, and names the offsets
    order = np.argsort(base - high, kind="stable")
    text, at, base, high, least, number = (x[order] for x in (text, at, base, high, least, number))
    names, checks = step.name(base - high, base - least + win.width, (high << 8 | least).astype(np.uint64))
    if size > 1:
        core = base - number * size
        core = step.name(core, core - size + 1 + win.width, ~number.astype(np.uint64))
        names, checks = np.append(core[0], names), np.append(core[1], checks)
    owner = step.owner[text]
    return step.send(names, checks, np.append(owner, owner) if size > 1 else owner, whole=step.state["whole"], text=text, at=at, rows=rows, done=done)


def _left(step: _Step, size: int) -> tuple:
    """(texts and places settled so far; texts and places that are still open) after a round of blocks."""
    s = step.state
    text, at = s["text"], s["at"]
    if size > 1:
        alive, low = step.answers(np.append(text, text))
        core, alive, low = alive[: len(text)], alive[len(text) :], low[len(text) :]
    else:
        alive, low = step.answers(text)
        core = np.ones(len(text), bool)
    done, stay = step.settled(alive, low, step.owner[text])
    stay &= core
    return np.append(s["rows"], text[done]), np.append(s["done"], at[done]), text[stay], at[stay]


def covered(win: Windows, block: Block, got: list[dict]) -> tuple[np.ndarray, _Step]:
    """A mask of the block's tokens that lie in repeated windows."""
    step = _Step(win, block, got, 1)
    steps = np.zeros(len(step.tokens) + 1, np.int32)
    if step.state:
        text, at, _, _ = _left(step, win.levels[-1])
        start = (at >> 16) + step.offsets[text]
        np.add.at(steps, start, 1)
        np.add.at(steps, start + (at & 255) + win.width - 1, -1)
        whole = np.flatnonzero(step.state["whole"])
        np.add.at(steps, step.offsets[whole], 1)
        np.add.at(steps, step.offsets[whole + 1], -1)
    return np.cumsum(steps[:-1], dtype=np.int32) > 0, step


def cut_repeats(cuts: Cuts, texts: DataFrame, win: Windows, cut: Callable[[Block, np.ndarray, _Step], pa.RecordBatch], schema: str) -> DataFrame:
    """``cut`` of each block of ``keyed`` rows and the mask of its tokens in repeated windows."""
    written = cuts.write(census.blocks(texts))
    steps = [lambda b, got, parts: _ask_texts(win, b, got, parts), lambda b, got, parts: _ask_runs(win, b, got, parts)]
    before = 0
    for size in win.levels:
        steps.append(lambda b, got, parts, size=size, before=before: _ask_blocks(win, b, got, parts, size, before))
        before = size
    found = census.rounds(cuts, written, win.earlier, steps)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                yield cut(block, *covered(win, block, row.get("found") or []))

    return census.with_answers(written, found).mapInArrow(run, schema)


def real_ids(docs: np.ndarray) -> pa.Array:
    """Ids as the caller knows them: null again where they were null."""
    return pa.array(docs, mask=docs == LAST_ID)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    steps = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
