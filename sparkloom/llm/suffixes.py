"""Suffix-array dedup by bucket-pointer refinement, on bytes.

The suffixes are those that start at sampled positions: in each window of the required length the
q-gram of least hash is sampled, so no repeated string is without a sampled suffix at the same offset.
Initial buckets are equal q-grams, sorted over the whole corpus; a bucket of a single text is final and
dropped. What is left is sorted again by its bucket and the bucket names of later (and, as a window may
begin before its sample, earlier) offsets: first for the whole run of windows that have the sample, then
for smaller and smaller blocks of windows, then for single ones. The name of 2h bytes is made of the names of h bytes
here and at offset h, and so on recursively from the q-grams on, so each round's sort keys are
identifiers of the round before and of later offsets. Identifiers are hashes of content instead of ranks, so
that a pointer at a later offset needs no look-up in another task. After each round texts get back which
of their buckets are still shared, and the least id in each.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .census import Block
from .common import Cuts, keyed
from .repeats import Windows, cut_repeats, real_ids, runs

MIN_BYTES = 50
BUCKET_BYTES = 16
#: Windows in a block, round by round.
LEVELS = (18, 6, 1)


def bucket_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int, table: np.ndarray, q: int = BUCKET_BYTES) -> np.ndarray:
    """Names of the byte ranges (each of q bytes or more) by recursive refinement.

    The name of 2h bytes is made of the name of h bytes here and that of h bytes at offset h; a range
    between two powers takes the names at its start and at its end less h, which overlap. Only names
    that some range needs are computed.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    salt, i = np.uint64(mult), 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + K.PIECE, "left")))
        s, e = starts[i:j] - low, ends[i:j] - low
        part = data[low : low + int(e.max())]
        sums, inverse = K.prefix(table[part], mult), K.powers(mult, len(part) + 1)[1]

        def name(at, h, sums=sums, inverse=inverse):
            if h == q:
                return K.mix((sums[at + q] - sums[at]) * inverse[at])
            return K.mix(name(at, h // 2) * salt + name(at + h // 2, h // 2))

        got, h, longest = np.zeros(j - i, np.uint64), q, int((e - s).max())
        while h <= longest:
            fits = np.flatnonzero((e - s >= h) & (e - s < 2 * h))
            got[fits] = K.mix(name(s[fits], h) * salt + name(e[fits] - h, h) + (e - s)[fits].astype(np.uint64))
            h *= 2
        out[order[i:j]] = got
        i = j
    return out


def _cut(block: Block, mask: np.ndarray, digest: bool) -> pa.RecordBatch:
    n_removed, n_spans, kept, removed = [], [], [], []
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        own, gone = block.data[a:b], mask[a:b]
        s, e = runs(gone)
        rest = (own[~gone] if len(s) else own).tobytes()
        n_removed.append(b - a - len(rest))
        n_spans.append(len(s))
        kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
        if not digest:
            removed.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
    out = {"doc_id": real_ids(block.docs), "n_bytes": pa.array(np.diff(block.offsets)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64())}
    if digest:
        out["kept_sha256"] = pa.array(kept, pa.string())
    else:
        out |= {"kept_bytes": pa.array(kept, pa.binary()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
    return pa.RecordBatch.from_pydict(out)


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, bucket_bytes: int = BUCKET_BYTES, digest: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``min_bytes`` bytes that also starts in a text of smaller id.

    Texts are UTF-8; cuts may fall inside a character, hence bytes come back. A null text is empty.
    Null ids rank after all others and equal each other; rows of equal id do not remove from each
    other. Texts shorter than the limit lose nothing. Extra columns are ignored; an empty table gives
    an empty result. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and kept_bytes
    with the removed ranges, or with ``digest`` the remaining bytes' kept_sha256 instead.
    """
    if not 0 < bucket_bytes <= min_bytes - LEVELS[0] + 1 or min_bytes - bucket_bytes >= 250:
        raise ValueError(f"bucket_bytes must be in 1..min_bytes - {LEVELS[0] - 1}, and less than 250 below min_bytes")
    cuts = Cuts(docs.sparkSession, "suffixes")
    win = Windows(min_bytes, bucket_bytes, words=False, earlier=True, levels=LEVELS, names=partial(bucket_names, q=bucket_bytes))
    tail = "kept_sha256 string" if digest else "kept_bytes binary, removed array<struct<start:long,end:long>>"
    return cut_repeats(cuts, keyed(docs, id_col, text_col), win, lambda block, mask, _: _cut(block, mask, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {tail}")
