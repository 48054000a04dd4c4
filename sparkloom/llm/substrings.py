"""Substring dedup by seed and extend, on words.

Seeds are winnowed anchors that occur twice in the corpus. A seed is extended both ways over the run of all
windows that select it: runs of equal content are repeats as a whole, and where runs of one seed differ, their
windows are compared one by one. Runs of neighbouring seeds join to maximal repeats, kept from the length
threshold on by construction, as each window has that length. Occurrences of a seed are never paired; they
are sorted by the content around it (see ``census``), so a seed that a third of all texts have costs as much as any.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .census import Block
from .common import Cuts, keyed
from .repeats import Windows, cut_repeats, real_ids, runs

MIN_WORDS = 35
ANCHOR_WORDS = 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def _cut(block: Block, mask: np.ndarray, digest: bool) -> pa.RecordBatch:
    starts, ends, by_text = K.word_spans(block.data, block.offsets, K.SPACE)
    n_removed, kept, removed = [], [], []
    raw = block.data.tobytes()
    for low, high in zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True):
        gone = mask[low:high]
        s, e = starts[low:high][~gone].tolist(), ends[low:high][~gone].tolist()
        text = b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])
        n_removed.append(high - low - len(s))
        kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        if not digest:
            removed.append([{"start": x, "end": y} for x, y in zip(*(r.tolist() for r in runs(gone)), strict=True)])
    out = {"doc_id": real_ids(block.docs), "n_words": pa.array(np.diff(by_text)), "n_removed": pa.array(n_removed, pa.int64())}
    if digest:
        out["kept_sha256"] = pa.array(kept, pa.string())
    else:
        out |= {"kept_text": pa.array(kept, pa.string()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
    return pa.RecordBatch.from_pydict(out)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, digest: bool = False) -> DataFrame:
    """Remove every word that lies in a run of ``min_words`` words found anywhere else in the corpus.

    Words are runs of bytes other than space and \\t-\\r, compared unchanged. Winnowing guarantees a
    shared anchor in each such run; matches are extended to their maximal length through the windows
    around the anchors (see ``repeats``). All occurrences go, also the first, and also those that
    repeat within one document. A null text is empty and has no words; texts shorter than the limit
    lose nothing. Repeated rows are separate documents, so their long runs repeat each other. A null
    id stays null. Extra columns are ignored. An empty table gives an empty result.

    Returns doc_id, n_words, n_removed, and kept_text (kept words joined by one space) with the
    removed maximal runs as word ranges, or with ``digest`` the kept text's kept_sha256 instead.
    """
    if not 0 < anchor_words <= min_words or min_words - anchor_words >= 250:
        raise ValueError("anchor_words must be in 1..min_words, and less than 250 below it")
    cuts = Cuts(docs.sparkSession, "substrings")
    texts = keyed(docs, id_col, text_col)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else SCHEMA
    win = Windows(min_words, anchor_words, words=True, earlier=False)
    return cut_repeats(cuts, texts, win, lambda block, mask, _: _cut(block, mask, digest), schema)
