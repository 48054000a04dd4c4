"""Rounds of sorting between blocks of texts and buckets of names.

A block is a row that holds some MB of whole texts. In a round, each block names what it asks about (a
text, an anchor, a run of windows), the names of all blocks are sorted in parts of equal size, and the
block gets back, for each of its names, whether others have it and the least owner. A block sends a name
once, however often it has it, so a name that a third of all rows have is one entry for each block. A row
holds all names of a block and a part, packed: the rows grow with the names, never with pairs of them.
Names are dealt by hash, so no part follows a frequent name; names are 96 bits where they decide
something.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import DOC, KEY, TEXT, Cuts, bounded_batches

#: Bytes of text to a part of a round, on average.
PART_BYTES = 4 << 20
BLOCKS = "block long, size long, keys binary, docs binary, sizes binary, body binary"
NAMES = "part int, block long, names binary, checks binary, owners binary, several binary, state binary"
SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("names", "checks", "owners", "several", "state"))])
ANSWERS = "part int, block long, n int, alive binary, low binary"


def pack(**columns: np.ndarray) -> bytes:
    """Arrays of one length each as compressed Arrow messages."""
    sink = pa.BufferOutputStream()
    for name, values in columns.items():
        batch = pa.RecordBatch.from_arrays([pa.array(values)], [name])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    source, out = pa.BufferReader(raw), {}
    while source.tell() < source.size():
        table = pa.ipc.open_stream(source).read_all()
        out[table.schema.names[0]] = table.column(0).to_numpy()
    return out


@dataclass
class Block:
    """Texts with their row keys and ids: bytes of all, and where each begins."""

    keys: np.ndarray
    docs: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @staticmethod
    def of(row: dict) -> Block:
        sizes = np.frombuffer(row["sizes"], np.int64)
        body = pa.decompress(row["body"], row["size"], codec="zstd", asbytes=True) if row["size"] else b""
        return Block(np.frombuffer(row["keys"], np.int64), np.frombuffer(row["docs"], np.int64), np.append(0, np.cumsum(sizes)), np.frombuffer(body, np.uint8))


def blocks(texts: DataFrame) -> DataFrame:
    """``keyed`` rows as rows of BLOCKS. A block's number holds only once the rows are written."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = K.utf8(b.column(2))
            keys, docs = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i in (0, 1))
            body = pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else b""
            row = [number, len(data), keys, docs, np.diff(offsets).tobytes(), body]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)], ["block", "size", "keys", "docs", "sizes", "body"])
            number += 1

    return texts.select(KEY, DOC, TEXT).mapInArrow(run, BLOCKS)


def part_count(written: DataFrame) -> int:
    """Parts of a round over written blocks."""
    return (written.agg(F.sum("size")).first()[0] or 0) // PART_BYTES + 1


def grouped(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal names together, and where each begins in it."""
    order = np.argsort(names)
    new = names[order][1:] != names[order][:-1]
    other = checks[order][1:] != checks[order][:-1]
    if np.any(other & ~new):  # equal in 64 bits only
        order = np.lexsort((checks, names))
        new = names[order][1:] != names[order][:-1]
        other = checks[order][1:] != checks[order][:-1]
    return order, np.flatnonzero(np.append(True, new | other)) if len(names) else np.zeros(0, np.int64)


def asked(names: np.ndarray, checks: np.ndarray, owners: np.ndarray, parts: int, by_owner: bool) -> tuple[list[dict], np.ndarray]:
    """Rows of NAMES for what a block asks about, and the place of each name in the answer.

    by_owner: a name counts as had by others if another owner has it, else if it occurs twice."""
    if not len(names):
        return [], np.zeros(0, np.int64)
    order, new = grouped(names, checks)
    counts = np.diff(np.append(new, len(names)))
    place = np.empty(len(names), np.int64)
    place[order] = np.repeat(np.arange(len(new)), counts)
    owners = owners[order]
    low = np.minimum.reduceat(owners, new)
    several = np.maximum.reduceat(owners, new) != low if by_owner else counts > 1
    names, checks = names[order][new], checks[order][new]
    part = ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    last = np.append(first[1:], len(part))
    rows = [
        {"part": int(part[a]), "names": names[a:b].tobytes(), "checks": checks[a:b].tobytes(), "owners": low[a:b].tobytes(), "several": np.packbits(several[a:b]).tobytes()}
        for a, b in zip(first.tolist(), last.tolist(), strict=True)
    ]
    return rows, place


def answer(table: pa.Table, by_owner: bool) -> pa.Table:
    """All names of a part, sorted: for each row, which of its names others have too, and their least owners."""
    rows = table.num_rows
    names = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
    counts = np.array([len(x) for x in names])
    at = np.append(0, np.cumsum(counts)).tolist()
    names = np.concatenate(names)
    checks = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("checks").to_pylist()])
    owners = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("owners").to_pylist()])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), counts.tolist(), strict=True)])
    order, new = grouped(names, checks)
    sizes = np.diff(np.append(new, len(order)))
    low = np.minimum.reduceat(owners[order], new)
    alive = np.maximum.reduceat(several[order], new) > 0
    alive |= np.maximum.reduceat(owners[order], new) != low if by_owner else sizes > 1
    every, least = np.empty(len(order), bool), np.empty(len(order), np.int64)
    every[order], least[order] = np.repeat(alive, sizes), np.repeat(low, sizes)
    bits = [np.packbits(every[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    lows = [least[a:b][every[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"part": table.column("part"), "block": table.column("block"), "n": pa.array(counts, pa.int32()), "alive": pa.array(bits, pa.binary()), "low": pa.array(lows, pa.binary())}) if rows else table


def read_answers(found: list[dict], owners: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each name that a block asked about: whether others have it, and its least owner (its own, if none)."""
    found = sorted((x for x in found if x["part"] >= 0), key=lambda x: x["part"])
    if not found:
        return np.zeros(len(place), bool), owners
    alive = np.concatenate([np.unpackbits(np.frombuffer(x["alive"], np.uint8), count=x["n"]) for x in found]) > 0
    low = np.zeros(len(alive), np.int64)
    low[alive] = np.concatenate([np.frombuffer(x["low"], np.int64) for x in found])
    alive = alive[place]
    return alive, np.where(alive, low[place], owners)


def ask(written: DataFrame, found: DataFrame | None, step: Callable[[Block, list[dict]], list[dict]]) -> DataFrame:
    """Each block with what it got back (and kept for itself) in the last round: what it asks about in the next one."""
    rows = written if found is None else with_answers(written, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = step(Block.of(row), row.get("found") or [])
                for x in out:
                    x["block"] = row["block"]
                for i in range(0, len(out), 256):
                    yield pa.RecordBatch.from_pylist(out[i : i + 256], SENT)

    return rows.mapInArrow(run, NAMES)


def with_answers(written: DataFrame, found: DataFrame) -> DataFrame:
    lists = found.groupBy("block").agg(F.collect_list(F.struct("part", "n", "alive", "low", "state")).alias("found"))
    return written.join(lists, "block", "left")


def rounds(cuts: Cuts, written: DataFrame, by_owner: bool, steps: list[Callable[[Block, list[dict]], list[dict]]]) -> DataFrame:
    """What each block got back in the last of the rounds, and kept for itself.

    Names are written beside what the blocks keep, and removed as soon as they are answered."""
    parts, found, old = part_count(written), None, []
    for step in steps:
        sent = ask(written, found, lambda block, got, step=step: step(block, got, parts))
        if found is None:  # nothing is kept, so the names needn't be written before they are sorted
            names, kept = sent, None
        else:
            names, kept = cuts.split(sent, F.col("part") < 0)
        got = names.groupBy("part").applyInArrow(lambda t: answer(t, by_owner), ANSWERS)
        got = cuts.write(got.withColumn("state", F.lit(None).cast("binary")))
        cuts.drop(names)
        for frame in old:
            cuts.drop(frame)
        found, old = got, [got]
        if kept is not None:
            found = got.unionByName(kept.select("part", "block", F.lit(0).alias("n"), *[F.lit(None).cast("binary").alias(c) for c in ("alive", "low")], "state"))
            old.append(kept)
    return found
